"""Model request bodies and model responses as data; no transport."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.config import JobConfig
from bookflow.functions.text import non_empty


def join_url(base: str, suffix: str) -> str:
    return base.rstrip("/") + suffix


def request_url(provider: str, base_url: str, model: str) -> str:
    base = base_url or C.BASE_URLS.get(provider) or C.BASE_URLS[C.DEFAULT_PROVIDER]
    if provider == "gemini":
        return join_url(base, f"/models/{quote(model, safe=_URI_SAFE)}:generateContent")
    return join_url(base, "/messages" if provider == "claude" else "/chat/completions")


# Fixed value: the marks that URI component encoding leaves as they are.
_URI_SAFE = "-_.!~*'()"


def _turn(content: Column, role: str | None = None) -> Column:
    parts = F.array(F.struct(content.alias("text"))).alias("parts")
    return F.struct(F.lit(role).alias("role"), parts) if role else F.struct(parts)


def request_body(cfg: JobConfig, provider: str, system: Column, user: Column) -> Column:
    model = F.lit(cfg.model or C.DEFAULT_MODEL).alias("model")
    temperature = F.lit(cfg.effective_temperature).alias("temperature")

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    if provider == "gemini":
        fields = [
            _turn(system).alias("systemInstruction"),
            F.array(_turn(user, "user")).alias("contents"),
            F.struct(temperature).alias("generationConfig"),
        ]
    elif provider == "claude":
        fields = [
            model,
            F.lit(cfg.max_tokens or C.CLAUDE_MAX_TOKENS).alias("max_tokens"),
            temperature,
            system.alias("system"),
            F.array(message("user", user)).alias("messages"),
        ]
    else:
        fields = [
            model,
            temperature,
            F.lit(False).alias("stream"),
            F.array(message("system", system), message("user", user)).alias("messages"),
        ]
    return F.to_json(F.struct(*fields))


def build_requests(prompts: DataFrame, cfg: JobConfig) -> DataFrame:
    """One ``provider, url, body`` per segment, without any key."""
    provider = cfg.provider or C.DEFAULT_PROVIDER
    return prompts.select(
        "job_id",
        "segment_id",
        F.lit(provider).alias("provider"),
        F.lit(request_url(provider, cfg.base_url, cfg.model or C.DEFAULT_MODEL)).alias("url"),
        request_body(cfg, provider, F.col("system"), F.col("user")).alias("body"),
    )


_GEMINI = (
    "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>,"
    "usageMetadata string"
)
_CLAUDE = "content array<struct<text:string>>, usage string"
_CHAT = "choices array<struct<message:struct<content:string>,text:string>>, usage string"


def _part_texts(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def parse_responses(df: DataFrame) -> DataFrame:
    """``provider, status, status_text, raw`` -> adds ``text, usage, error, retryable``.

    Bodies that are no JSON give an empty text; a status outside 2xx gives an error instead.
    """
    ok = F.col("status").between(200, 299)
    parsed = df.withColumns(
        {
            "__g": F.when(F.col("provider") == "gemini", F.from_json("raw", _GEMINI)),
            "__c": F.when(F.col("provider") == "claude", F.from_json("raw", _CLAUDE)),
            "__o": F.when(~F.col("provider").isin("gemini", "claude"), F.from_json("raw", _CHAT)),
        }
    )
    first = F.get("__o.choices", F.lit(0))
    chat = F.coalesce(non_empty(first["message"]["content"]), first["text"])
    gemini = _part_texts(F.get("__g.candidates", F.lit(0))["content"]["parts"])
    text = (
        F.when(F.col("provider") == "gemini", gemini)
        .when(F.col("provider") == "claude", _part_texts(F.col("__c.content")))
        .otherwise(chat)
    )
    usage = F.coalesce("__g.usageMetadata", "__c.usage", "__o.usage")
    error = F.concat(
        F.lit("API "),
        F.col("status").cast("string"),
        F.lit(" "),
        F.coalesce("status_text", F.lit("")),
        F.lit(": "),
        F.substring("raw", 1, C.ERROR_CHARS),
    )
    return parsed.select(
        *df.columns,
        F.when(ok, F.coalesce(text, F.lit(""))).alias("text"),
        F.when(ok, usage).alias("usage"),
        F.when(~ok, error).alias("error"),
        F.when(~ok, (F.col("status") == 429) | (F.col("status") >= 500)).alias("retryable"),
    )
