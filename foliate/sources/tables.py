"""Domain views over the star-schema tables.

Each view is a deterministic projection of whole tables. Views of one document are computed inside
its row (``split`` → ``filter`` → ``posexplode``), so numbering the blocks needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.functions.ordered import id_bucket, ranked
from foliate.functions.text import block_id, is_blank, once, run_of, sha, strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan that has fewer partitions than cores, as one small file has.

    At scale a scan has far more partitions than cores and is left alone. Rows are placed by key, so
    later per-document windows and joins find them in place.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def template_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template version per document; its template is the document's source."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("template_id"),
        F.col("doc_id").alias("template_version_id"),
        sha("text").alias("content_hash"),
    )
    return ranked(
        docs, ["template_id"], [F.col("template_version_id")], id_bucket("template_version_id"), "version_number"
    )


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of every document as paragraph blocks."""
    return text_blocks_of(documents(spark, sf_dir))


def text_blocks_of(docs: DataFrame) -> DataFrame:
    """Paragraph blocks of rows ``(doc_id, source, text)``, batch or stream."""
    lines = F.filter(F.split("text", "\n"), lambda line: ~is_blank(line))
    rows = once(
        docs.select(F.col("doc_id").alias("template_version_id"), F.col("source").alias("template_id"), "text"),
        {"lines": lines},
    )
    # Count before exploding: neither the text nor the array travels with every line.
    exploded = rows.withColumn("total_blocks", F.size("lines").cast("bigint")).select(
        "template_version_id", "template_id", "total_blocks", F.posexplode("lines").alias("position", "text")
    )
    sequence = (F.col("position") + 1).cast("bigint")
    return exploded.select(
        "template_version_id",
        "template_id",
        block_id("paragraph", sequence, F.substring(strip("text"), 1, 50)).alias("block_id"),
        F.col("position").cast("bigint").alias("position"),
        sequence.alias("sequence"),
        F.lit("paragraph").alias("block_type"),
        F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("string").alias("style_name"),
        "text",
        "total_blocks",
    )


# --- HTML pages -------------------------------------------------------------------------------
# Cut marks: \x01 starts a piece, \x02 ends its tag name.
_NOISE = r"(?is)<!--.*?-->|<(?:script|style|title)[^>]*>.*?</(?:script|style|title)>"
_OPEN = r"(?i)<(h[1-6]|p|li)(?:[ \t\n\r/][^>]*)?>"
_CLOSE = r"(?i)</?(?:h[1-6]|p|li|ul|ol|nav|article|section|div|body|html|head|header|footer|aside|main|form|blockquote|table|thead|tbody|tfoot|tr|td|th|caption|dl|dt|dd|pre|figure|figcaption|option)(?:[ \t\n\r/][^>]*)?>"
_TAG = r"<[^>]*>"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))


def _entities(c: Column) -> Column:
    for name, char in _ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs and list items of every page, in order, as raw elements.

    Text outside of these (in a div, a table cell, or bare) is a paragraph, so all visible text is kept.
    """
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    html = F.regexp_replace("html", _NOISE, "")
    html = F.regexp_replace(html, _OPEN, "\x01$1\x02")
    html = F.regexp_replace(html, _CLOSE, "\x01-\x02")
    html = F.regexp_replace(html, _TAG, "")
    cut = once(pages.select(F.col("page_id").alias("template_version_id"), "html"), {"pieces": F.split(html, "\x01")})
    pieces = cut.select("template_version_id", F.posexplode("pieces").alias("ord", "piece"))
    tag = F.when(F.col("piece").contains("\x02"), F.lower(F.substring_index("piece", "\x02", 1))).otherwise("-")
    pieces = pieces.withColumns(
        {"tag": tag, "text": strip(_entities(F.substring_index("piece", "\x02", -1)))}
    ).filter((F.col("tag") != "-") | (F.col("text") != ""))
    style = (
        F.when(F.col("tag") == "li", "List Bullet")
        .when(F.col("tag").isin("p", "-"), "Normal")
        .otherwise(F.concat(F.lit("Heading "), F.substring("tag", 2, 1)))
    )
    return pieces.select(
        "template_version_id",
        F.col("ord").cast("bigint").alias("ord"),
        F.lit("p").alias("kind"),
        style.alias("style_name"),
        F.lit(None).cast("int").alias("outline_level"),
        F.lit(False).alias("has_numbering"),
        F.lit(None).cast("int").alias("list_level"),
        F.lit(False).alias("page_break"),
        F.when(F.col("text") == "", F.array().cast(_RUNS)).otherwise(run_of(F.col("text"))).alias("runs"),
        "text",
    )


_RUNS = (
    "array<struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,"
    "font_name:string,font_size:double,color:string,highlight:string>>"
)


def page_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and language of every page."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.col("page_id").alias("template_version_id"),
        _entities(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)</title>", 1)).alias("title"),
        F.regexp_extract("html", r'(?i)<html[^>]*lang="([^"]*)"', 1).alias("lang"),
    )


# --- clients, documents, attempts -------------------------------------------------------------
def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer with nation and region as a client-data payload."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("c_custkey").alias("client_id"),
        F.col("c_name").alias("client_name"),
        F.create_map(
            F.lit("nation"), F.col("n_name"),
            F.lit("region"), F.col("r_name"),
            F.lit("segment"), F.col("c_mktsegment"),
        ).alias("data_fields"),
    )


def document_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order, of template ``src<key mod 20>``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"),
        F.col("o_custkey").alias("client_id"),
        F.concat(F.lit("src"), (F.col("o_orderkey") % 20).cast("string")).alias("template_id"),
        F.col("o_orderdate").alias("created_at"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns are answers, system turns are failed calls; numbered from 0 per conversation."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id").filter(F.col("role").isin("assistant", "system"))
    rows = turns.select(
        F.col("conv_id").alias("section_id"),
        "turn",
        (F.col("role") == "assistant").alias("llm_ok"),
        F.col("text").alias("raw_output"),
    )
    numbered = ranked(rows, ["section_id"], [F.col("turn")], id_bucket("turn"), "_rank")
    return numbered.withColumn("attempt_no", F.col("_rank") - 1).drop("_rank", "turn")


# --- jobs and audit ---------------------------------------------------------------------------
_STATUS = {"signup": "PENDING", "view": "RUNNING", "click": "RUNNING", "purchase": "COMPLETED", "error": "FAILED"}


def _status() -> Column:
    out = F.when(F.col("event_type") == "signup", "PENDING")
    for name, status in list(_STATUS.items())[1:]:
        out = out.when(F.col("event_type") == name, status)
    return out


def events_of(raw: DataFrame) -> DataFrame:
    """Events with key ``k`` of their properties and the job status they stand for."""
    return raw.withColumns(
        {"k": F.get_json_object("props", "$.k").cast("bigint"), "status": _status()}
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_of(events_of(table(spark, sf_dir, "events")))


def jobs_of(events: DataFrame) -> DataFrame:
    """One job per event; type, times and payload derive from its key, time and value."""
    types = F.array(*[F.lit(t) for t in K.JOB_TYPES])
    started = F.when(F.col("status") != "PENDING", F.col("ts") + F.make_dt_interval(secs=F.col("k").cast("decimal(18,6)")))
    done = F.when(
        F.col("status").isin("COMPLETED", "FAILED"),
        F.col("ts") + F.make_dt_interval(mins=(F.col("k") + 1).cast("int")),
    )
    payload = F.to_json(
        F.struct(
            F.col("k").cast("string").alias("document_id"),
            F.col("user_id").cast("string").alias("template_version_id"),
        )
    )
    return events.select(
        F.col("event_id").alias("job_id"),
        F.get(types, (F.col("k") % 5).cast("int")).alias("job_type"),
        "status",
        payload.alias("payload"),
        F.when(F.col("status") == "COMPLETED", F.to_json(F.struct((F.col("k") % 7).alias("version_number")))).alias("result"),
        F.when(F.col("status") == "FAILED", F.concat(F.lit("error "), F.col("k").cast("string"))).alias("error"),
        F.col("ts").alias("created_at"),
        started.alias("started_at"),
        done.alias("completed_at"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_events_of(events_of(table(spark, sf_dir, "events")))


def job_events_of(events: DataFrame) -> DataFrame:
    """Status changes of one job per user, in time order."""
    return events.select(
        F.col("user_id").alias("job_id"), "event_id", "status", "ts", F.lit(None).cast("string").alias("reason")
    )


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows: the version key alternates between the three names that occur in the log."""
    number = (F.col("k") % 5).cast("int")
    metadata = F.to_json(
        F.struct(
            F.col("k").cast("string").alias("document_id"),
            F.col("user_id").cast("string").alias("job_id"),
            F.when(F.col("k") % 3 == 0, number).alias("version_number"),
            F.when(F.col("k") % 3 == 1, number).alias("version"),
            F.when(F.col("k") % 3 == 2, number).alias("version_intent"),
        )
    )
    kinds = F.array(F.lit("DOCUMENT"), F.lit("DOCUMENT_VERSION"), F.lit("GENERATION_BATCH"), F.lit("SECTION_OUTPUT"))
    action = F.concat(
        F.lit("SECTION_GENERATION_"),
        F.when(F.col("status") == "PENDING", "INITIATED").when(F.col("status") == "RUNNING", "STARTED").otherwise(F.col("status")),
    )
    return events_of(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("id"),
        F.get(kinds, (F.col("k") % 4).cast("int")).alias("entity_type"),
        F.col("user_id").alias("entity_id"),
        action.alias("action"),
        metadata.alias("metadata"),
        F.col("ts").alias("timestamp"),
    )
