"""Fixed values that show up in results: patterns, messages, prompts, limits, rates."""

# --- white space -----------------------------------------------------------------------------
# The white-space set used by every trim: ASCII controls, NBSP, the Unicode space separators,
# line/paragraph separators and the BOM. WS_CHARS feeds btrim, WS_CLASS feeds regular expressions.
WS_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS_CLASS = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)

# --- character classes (fixed values) ----------------------------------------------------------
CJK_CLASS = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]"
KANA_PATTERN = "[ぁ-んァ-ン]"
NAME_PATTERN = "[ァ-ヶー]{2,}|[一-龥]{2,6}"
TOKEN_PATTERN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}A-Za-z0-9_]{2,}"

# --- chapter headings (fixed values) -----------------------------------------------------------
HEADING_PATTERN = (
    rf"^(?:第[{WS_CLASS}]*[0-9０-９一二三四五六七八九十百千万零〇两]+[{WS_CLASS}]*[章节回话卷部].{{0,80}}"
    rf"|[Cc][Hh][Aa][Pp][Tt][Ee][Rr][{WS_CLASS}]+[0-9]+.{{0,80}}"
    r"|序章|终章|尾声|后记|番外.{0,40})$"
)
MIN_HEADINGS = 2
PART_CHARS = 9000

# --- limits (fixed values) -----------------------------------------------------------------------
MIN_CHUNK_CHARS = 600
DEFAULT_CHUNK_CHARS = 1800
ERROR_CHARS = 2000
QA_TERM_LIMIT = 500
SUMMARY_TERM_LIMIT = 12
SUMMARY_NAME_LIMIT = 10
SUMMARY_CHARS = 360
LOCATION_LIMIT = 8
REPEAT_LIMIT = 5
REPEAT_MIN_CHARS = 8
REPEAT_MIN_COUNT = 3
PREVIOUS_SUMMARIES = 3
REPORT_QA = 80
REPORT_SUMMARIES = 60
REPORT_CONSISTENCY = 60
CACHE_VERSION = 1

# --- model endpoints and cost per character (fixed values) ---------------------------------------
BASE_URLS = {
    "openai-compatible": "http://localhost:11434/v1",
    "openai": "https://api.openai.com/v1",
    "deepseek": "https://api.deepseek.com",
    "gemini": "https://generativelanguage.googleapis.com/v1beta",
    "claude": "https://api.anthropic.com/v1",
}
DEFAULT_PROVIDER = "openai-compatible"
DEFAULT_MODEL = "gpt-4.1-mini"
DEFAULT_TEMPERATURE = 0.35
CLAUDE_MAX_TOKENS = 4096
CHAR_RATES = {
    "openai": 0.0000012,
    "deepseek": 0.00000035,
    "gemini": 0.0000005,
    "claude": 0.0000022,
    "openai-compatible": 0.0000002,
    "demo": 0.0,
}
DEFAULT_CHAR_RATE = 0.000001

# --- texts (fixed values) --------------------------------------------------------------------------
NONE_TEXT = "无"
UNTITLED_CHAPTER = "未命名章节"
UNTITLED_PROJECT = "未命名项目"
NO_SUMMARY = "暂无可用摘要。"
DEFAULT_PROMPT = (
    "你是专业文学翻译。请把{{sourceLanguage}}小说翻译为{{targetLanguage}}，"
    "保持人物称呼、段落结构和叙事语气一致。只输出译文，不要解释。"
)
TEMPLATE_SYSTEM = "你是一个严格遵守用户翻译模板的文学翻译助手。只输出最终译文。"
INTERRUPTED_MESSAGE = "服务重启后任务已中断，可在页面中继续翻译。"
MSG_EMPTY = "译文为空。"
MSG_SHORT = "译文长度明显偏短，可能漏译。"
MSG_LONG = "译文长度明显偏长，可能出现解释或重复。"
MSG_UNTRANSLATED = "译文中仍有较多日文字符，可能存在未翻译内容。"
MSG_INSTRUCTION = "译文疑似包含模型解释性开头。"
INSTRUCTION_PATTERN = rf"(?i)^(?:sure|here is|以下是|当然|翻译如下)[:：{WS_CLASS}]"
PRESETS = (
    (
        "faithful",
        "忠实直译",
        0.2,
        "你是严谨的文学翻译。请将{{sourceLanguage}}小说翻译为{{targetLanguage}}，"
        "保持原意、叙述顺序和段落结构。专有名词遵循术语表。只输出译文。",
    ),
)
