"""Table schemas as DDL, so that importing them needs no session."""

SEG_KEYS = ["job_id", "segment_id"]

TEXT_BOOK = (
    "book_id string, name string, encoding string, score double, text string"
)
BOOKS = (
    "book_id string, name string, title string, format string, encoding string, files int"
)
CHAPTERS = (
    "book_id string, chapter_index int, title string, text string, source_path string"
)
REJECTS = ("book_id string, name string, reason string")
TERM_FIELDS = (
    "id string, source string, target string, aliases array<string>, note string, "
    "category string, match_type string"
)
GLOSSARY = (f"project_id string, term_idx int, {TERM_FIELDS}")
CONTEXT_BANK = (
    "project_id string, item_idx int, id string, title string, text string"
)
CACHE = (
    "version int, key string, created_at timestamp, provider string, model string, "
    "source_language string, target_language string, text string, usage string"
)
MEMBERS = (
    "book_id string, name string, member_path string, bytes binary, reject string"
)
ATTEMPTS = (
    "job_id string, segment_id string, attempt int, status string, error string, ts timestamp"
)

# A project document as a user exports or imports it.
PROJECT_DOCUMENT = (
    "id string, title string, "
    "book struct<title:string,chapters:array<struct<title:string,text:string>>>, "
    "settings map<string,string>, "
    "contextBank array<struct<id:string,title:string,text:string,content:string>>, "
    "chapterSummaries array<struct<chapterIndex:int,title:string,summary:string,"
    "characters:array<string>,terms:array<struct<source:string,target:string,note:string>>,"
    "updatedAt:string>>, "
    "qaIssues array<struct<type:string,severity:string,message:string,source:string,"
    "target:string,chapterIndex:int,chapterTitle:string,segmentIndex:int,segmentId:string>>, "
    "consistencyIssues array<struct<type:string,severity:string,source:string,target:string,"
    "message:string,locations:array<struct<chapterIndex:int,chapterTitle:string,"
    "segmentIndex:int>>>>, "
    "results array<struct<title:string,sourceText:string,translatedText:string>>, "
    "glossary string, lastJobId string, createdAt string, updatedAt string, exportedAt string"
)


def names(ddl: str) -> list[str]:
    """The column names of a flat schema."""
    return [field.split()[0] for field in ddl.split(",")]
