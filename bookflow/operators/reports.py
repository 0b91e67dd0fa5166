"""Results, consistency, estimates, listings and the job report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.config import JobConfig
from bookflow.functions.text import non_empty
from bookflow.operators.glossary import join_small, match_terms, small_glossary
from bookflow.operators.segments import segment_pieces
from bookflow.operators.tables import union_ids
from bookflow.operators.tables import redact
from bookflow.operators.work import job_outcome, progress
from bookflow.schemas import SEG_KEYS
from bookflow.session import materialize


def reassemble(results: DataFrame) -> DataFrame:
    """``job_id, chapter_index, translated_text``: non-empty translations in segment order."""
    kept = results.filter(F.coalesce("translated_text", F.lit("")) != "")
    ordered = F.sort_array(F.collect_list(F.struct("segment_index", "translated_text")))
    texts = F.transform(ordered, lambda x: x["translated_text"])
    return kept.groupBy("job_id", "chapter_index").agg(
        F.array_join(texts, "\n\n").alias("translated_text")
    )


def attach_segments(chapters: DataFrame, reassembled: DataFrame) -> DataFrame:
    """``chapter_results``: chapters with a translation, source and translated text."""
    return (
        chapters.select("job_id", "chapter_index", "title", F.col("text").alias("source_text"))
        .join(reassembled, ["job_id", "chapter_index"])
        .filter(F.col("translated_text") != "")
    )


# --- consistency -------------------------------------------------------------------------------


def _source_hits(results: DataFrame, terms: DataFrame, small: bool | None) -> DataFrame:
    """Segments that contain a term's source (no aliases, any status) and lack its target."""
    wanted = terms.filter(F.col("target") != "")
    places = ["chapter_index", "chapter_title", "segment_index"]
    translated = F.coalesce("translated_text", F.lit(""))
    if small_glossary(wanted) if small is None else small:
        marked = F.transform(
            "matched",
            lambda t: F.struct(
                t["term_idx"],
                t["source"],
                t["target"],
                (~F.contains(translated, t["target"])).alias("missing"),
            ),
        )
        rows = join_small(results, wanted, False, "text")
        return rows.select(*SEG_KEYS, *places, F.explode(marked).alias("m")).select(
            *SEG_KEYS, *places, "m.*"
        )
    # the pairs are keys only, the texts come back by segment
    pairs = match_terms(results, wanted, SEG_KEYS, any_name=False, small=False)
    return (
        pairs.join(
            wanted.select("project_id", "term_idx", "source", "target"), ["project_id", "term_idx"]
        )
        .join(results.select(*SEG_KEYS, *places, "translated_text"), SEG_KEYS)
        .select(
            *SEG_KEYS,
            *places,
            "term_idx",
            "source",
            "target",
            (~F.contains(translated, F.col("target"))).alias("missing"),
        )
    )


def _seen_missing(hits: DataFrame) -> DataFrame:
    return (
        hits.groupBy("job_id", "term_idx", "source", "target")
        .agg(F.count("*").alias("seen"), F.count_if("missing").alias("missing"))
        .filter((F.col("seen") >= 2) & (F.col("missing") > 0))
    )


def term_consistency(
    results: DataFrame, terms: DataFrame, small: bool | None = None
) -> DataFrame:
    """Terms seen in two or more segments of a job and missing their target in some."""
    return _seen_missing(_source_hits(results, terms, small))


def first_locations(missing: DataFrame, n: int = C.LOCATION_LIMIT) -> DataFrame:
    """The first ``n`` places per job and term; the limit applies before the shuffle too."""
    keys = ["job_id", "term_idx"]
    order = ["chapter_index", "segment_index", "segment_id"]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    place = F.struct("chapter_index", "chapter_title", "segment_index")
    return (
        missing.withColumn("__r", rank)
        .filter(F.col("__r") <= n)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("__r", place.alias("place")))).alias("ls"))
        .select(*keys, F.transform("ls", lambda x: x["place"]).alias("locations"))
    )


def consistency_issues(
    results: DataFrame, terms: DataFrame, small: bool | None = None
) -> DataFrame:
    # the search is done once; two aggregates read its keys
    hits = materialize(_source_hits(results, terms, small), "hits")
    found = _seen_missing(hits).join(
        first_locations(hits.filter("missing")), ["job_id", "term_idx"]
    )
    message = F.concat(
        F.lit("术语「"),
        F.col("source"),
        F.lit("」在 "),
        F.col("seen").cast("string"),
        F.lit(" 个片段出现，其中 "),
        F.col("missing").cast("string"),
        F.lit(" 个片段未使用「"),
        F.col("target"),
        F.lit("」。"),
    )
    return found.select(
        "job_id",
        "term_idx",
        F.lit("consistency").alias("type"),
        F.lit("warning").alias("severity"),
        "source",
        "target",
        message.alias("message"),
        "seen",
        "missing",
        "locations",
    )


# --- reports -------------------------------------------------------------------------------------


def cap_issues(df: DataFrame, n: int, order: list[str], by: str = "job_id") -> DataFrame:
    """The first ``n`` rows of every job, as a report shows them."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return df.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def estimate(chapters: DataFrame, cfg: JobConfig, by: str = "book_id") -> DataFrame:
    """Chapters, characters, segments and rough cost of every book."""
    rate = C.CHAR_RATES.get(cfg.provider, C.DEFAULT_CHAR_RATE)
    sized = segment_pieces(
        chapters.select(by, F.length("text").alias("chars"), "text"), cfg
    ).select(by, "chars", F.size("pieces").alias("segments"))
    return (
        sized.groupBy(by)
        .agg(
            F.count("*").alias("chapters"),
            F.sum("chars").alias("chars"),
            F.sum("segments").alias("segments"),
        )
        .withColumn("cost", F.col("chars") * F.lit(rate))
    )


def list_projects(projects: DataFrame, chapters: DataFrame, results: DataFrame) -> DataFrame:
    """Listing rows: title with fallbacks and the chapter and result counts."""
    n_chapters = chapters.groupBy("project_id").agg(F.count("*").alias("chapter_count"))
    n_results = results.groupBy("project_id").agg(F.count("*").alias("result_chapters"))
    joined = projects.join(n_chapters, "project_id", "left").join(n_results, "project_id", "left")
    title = F.coalesce(
        non_empty(F.col("title")), non_empty(F.col("book_title")), F.lit(C.UNTITLED_PROJECT)
    )
    return joined.select(
        "project_id",
        title.alias("title"),
        "updated_at",
        "created_at",
        "last_job_id",
        F.coalesce("result_chapters", F.lit(0)).alias("result_chapters"),
        F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"),
    )


# What a job may bring for its project, and what only the project has.
_SYNCED = {
    "book_title": "string", "glossary": "string", "context_bank": "string", "settings": "map<string,string>",
    "total": "bigint", "done": "bigint",
}
_OWN = {"created_at": "timestamp", "last_job_total": "bigint", "last_job_done": "bigint"}


def sync_projects(projects: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Project headers after their jobs ran: the job's fields replace the project's.

    ``jobs`` has at most one row per project. The title is kept if there is one, the glossary
    falls back to the existing one, as do book title, settings (without model keys) and context bank,
    and the job id joins the project's ids. A project that a job brings is created ``now``. Result,
    issue and summary tables are keyed by job and replaced as tables.
    """
    jobs = jobs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in _SYNCED.items() if c not in jobs.columns])
    projects = projects.select(
        "*", *[F.lit(None).cast(t).alias(c) for c, t in (_SYNCED | _OWN).items() if c not in projects.columns]
    )
    j = jobs.select(
        F.col("project_id"),
        *[F.col(c).alias(f"__j_{c}") for c in jobs.columns if c != "project_id"],
    )
    joined = projects.join(j, "project_id", "full")
    synced = F.col("__j_job_id").isNotNull()
    title = F.coalesce(
        non_empty(F.col("title")), non_empty(F.col("__j_book_title")), F.lit(C.UNTITLED_PROJECT)
    )
    ids = F.when(synced, union_ids(F.col("job_ids"), F.col("__j_job_id"))).otherwise(
        F.col("job_ids")
    )
    return joined.select(
        "project_id",
        F.when(synced, title).otherwise(F.col("title")).alias("title"),
        F.coalesce(non_empty(F.col("__j_book_title")), F.col("book_title")).alias("book_title"),
        F.coalesce(non_empty(F.col("__j_glossary")), F.col("glossary")).alias("glossary"),
        F.coalesce(non_empty(F.col("__j_context_bank")), F.col("context_bank")).alias("context_bank"),
        F.map_filter(
            F.coalesce("__j_settings", "settings"), lambda k, _: ~k.isin("apiKey", "api_key")
        ).alias("settings"),
        F.coalesce("__j_job_id", "last_job_id").alias("last_job_id"),
        F.coalesce("__j_status", "last_job_status").alias("last_job_status"),
        F.coalesce("__j_percent", "last_job_percent").alias("last_job_percent"),
        *[F.coalesce(f"__j_{c}", f"last_job_{c}").alias(f"last_job_{c}") for c in ("total", "done")],
        ids.alias("job_ids"),
        F.coalesce(F.col("created_at"), F.when(synced, now)).alias("created_at"),
        F.when(synced, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def job_report(
    results: DataFrame,
    chapter_results: DataFrame,
    qa_issues: DataFrame,
    summaries: DataFrame,
    consistency: DataFrame,
    configs: DataFrame,
) -> DataFrame:
    """One row per job: progress, outcome, counts and config, without its key.

    Counts of all tables come from one aggregation over their job ids.
    """
    prog = progress(results)
    tables = {
        "results": chapter_results, "qa_count": qa_issues, "summary_count": summaries,
        "consistency_count": consistency,
    }
    kinds = None
    for name, df in tables.items():
        rows = df.select("job_id", F.lit(name).alias("kind"))
        kinds = rows if kinds is None else kinds.unionByName(rows)
    counts = kinds.groupBy("job_id").agg(*[F.count_if(F.col("kind") == n).alias(n) for n in tables])
    safe = redact(configs)
    fields = [c for c in safe.columns if c != "job_id"]
    config = safe.select("job_id", F.to_json(F.struct(*fields)).alias("config"))
    out = prog.join(job_outcome(prog), "job_id", "left").join(counts, "job_id", "left")
    return out.join(config, "job_id", "left").fillna(0, list(tables))


def job_record(
    report: DataFrame,
    chapter_results: DataFrame,
    qa_issues: DataFrame,
    summaries: DataFrame,
    consistency: DataFrame,
) -> DataFrame:
    """``job_id, section, place, json``: the whole record of each job, as lines.

    The report row comes first (section ``job``), then every result, issue and summary with all its
    columns; ``place`` orders a section. No job is gathered, however many issues it has.
    """

    def lines(section: str, df: DataFrame, *place: str) -> DataFrame:
        fields = [c for c in df.columns if c != "job_id"]
        order = F.array(*[F.col(c).cast("long") for c in place]) if place else F.array().cast("array<bigint>")
        return df.select(
            "job_id", F.lit(section).alias("section"), order.alias("place"), F.to_json(F.struct(*fields)).alias("json")
        )

    return (
        lines("job", report)
        .unionByName(lines("results", chapter_results, "chapter_index"))
        .unionByName(lines("qa", qa_issues, "chapter_index", "segment_index", "issue_no"))
        .unionByName(lines("summaries", summaries, "chapter_index"))
        .unionByName(lines("consistency", consistency, "term_idx"))
    )
