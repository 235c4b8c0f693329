"""Files: raw sources, parsed and rendered artefacts, and JSON logs."""

from __future__ import annotations

import fnmatch
import functools
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliate.functions import constants as K
from foliate.functions.text import first_of
from foliate.session import stored

LOG = (
    "timestamp string, level string, logger string, message string, module string, function string, line int, "
    "correlation_id string, job_id string, document_id string, template_id string, exception string, "
    "extra map<string,string>, _corrupt string"
)


def scan(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """Raw files as ``(path, modificationTime, length, content)``; one file is one row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def key_ids(path: Column) -> dict[str, Column]:
    """Ids out of ``templates/<id>/<version>/source.docx`` and ``documents/<id>/<version>/output.docx``."""
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(path, r"(templates|documents)/([^/]+)/(\d+)/([^/]+)\z", i), F.lit(""))

    return {"kind": part(1), "owner_id": part(2), "version_number": part(3).try_cast("int"), "file_name": part(4)}


def source_key(template_id: Column, version: Column) -> Column:
    return F.concat(F.lit("templates/"), template_id.cast("string"), F.lit("/"), version.cast("string"), F.lit("/source.docx"))


def output_key(document_id: Column, version: Column) -> Column:
    return F.concat(F.lit("documents/"), document_id.cast("string"), F.lit("/"), version.cast("string"), F.lit("/output.docx"))


def missing(expected: DataFrame, present: DataFrame, *key: str) -> DataFrame:
    """Expected artefacts that are not there: one join instead of a request per key."""
    return expected.join(present.select(*key), list(key), "left_anti")


def acceptable(name: Column, content_type: Column) -> Column:
    """Upload filter on file name and content type; an absent value does not reject."""
    fine_name = name.isNull() | (name == "") | F.lower(name).endswith(K.UPLOAD_EXTENSION)
    fine_type = content_type.isNull() | (content_type == "") | content_type.isin(*K.UPLOAD_CONTENT_TYPES)
    return fine_name & fine_type


def _inspect(content: bytes) -> str | None:
    """First structural fault of a file, NULL for a readable document."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        names = set(archive.namelist())
    except Exception:
        return "invalid_format"
    if K.CONTENT_TYPES_PART not in names:
        return "invalid_format"
    if K.BODY_PART not in names:
        return "missing_content"
    try:
        archive.read(K.BODY_PART)
    except Exception:
        return "corrupted_file"
    return None


@F.pandas_udf(StringType())
def _structure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda c: None if c is None else _inspect(c))


def _by_size(size: Column, limit: int) -> Column:
    return first_of([(size == 0, "empty_file"), (size > limit, "file_too_large")])


def quality_gate(files: DataFrame, limit: int = K.MAX_FILE_BYTES) -> DataFrame:
    """``error_type`` per file: empty, too large, no archive, missing parts, unreadable; NULL when fine.

    For files that are rows already. Size and emptiness are decided on columns; only files that pass reach the archive check.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    early = _by_size(size, limit)
    rows = files.withColumns({"file_size": size, "_early": early})
    rows = rows.withColumn("_fault", _structure(F.when(F.col("_early").isNull(), F.col("content"))))
    return rows.withColumn("error_type", F.coalesce("_early", "_fault")).drop("_early", "_fault")


def _plain(path: Column) -> Column:
    """A path as the scan writes it: one slash behind the scheme, nothing encoded."""
    return F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def empty_files(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """Files without a byte. Scans pass over them, so they are those that the file index lists and a scan does not show.

    The index holds the names of all files on the driver, as it does for every scan.
    """
    rows = scan(spark, path, pattern)
    listed = spark.createDataFrame([(name,) for name in rows.inputFiles()], "value string")
    listed = listed.select(_plain(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))).alias("path"))
    return listed.join(rows.select(_plain(F.col("path")).alias("path")), "path", "left_anti").select("path", F.lit(0).cast("bigint").alias("length"))


def gated_scan(
    spark: SparkSession, path: str, pattern: str = "*.docx", limit: int = K.MAX_FILE_BYTES, listed: DataFrame | None = None
) -> DataFrame:
    """The same for files in storage: ``(path, length, error_type)``.

    Sizes come from the listing, so a file that is empty or too large is never opened; the limits on ``length`` reach the
    reader of the other pass as pushed filters. Files whose size passes are read one by one and inspected.
    A scan keeps the names of all files on the driver; for folders of more than some ten thousand, give a ``listing`` of them.
    """
    size = F.col("length")
    if listed is not None:
        rows = listed.select("path", "length").withColumn("error_type", _by_size(size, limit))
        fitting = _dealt(rows.filter("error_type IS NULL")).select("path", "length").mapInArrow(_inspected, rows.schema)
        return rows.filter("error_type IS NOT NULL").unionByName(fitting)
    early = scan(spark, path, pattern).filter(size > limit).select("path", "length").unionByName(empty_files(spark, path, pattern))
    early = early.withColumn("error_type", _by_size(size, limit))
    fitting = scan(spark, path, pattern).filter((size > 0) & (size <= limit))
    return early.unionByName(fitting.select("path", "length", _structure("content").alias("error_type")))


def accepted_files(spark: SparkSession, path: str, gate: DataFrame, pattern: str = "*.docx", limit: int = K.MAX_FILE_BYTES) -> DataFrame:
    """Contents of the files that a stored gate let pass, opened where its rows are; no folder is listed again."""
    size = F.col("length")
    good = gate.filter(F.col("error_type").isNull() & (size > 0) & (size <= limit) & _named(pattern))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, own = _store(name)
                info = store.get_file_info(own)
                if not info.is_file or not 0 < info.size <= limit:
                    continue
                rows.append((name, info.mtime, info.size, _content(name)))
                held += info.size
                if held > _HELD:
                    yield _batch(rows, _FILES)
                    rows, held = [], 0
        yield _batch(rows, _FILES)

    rows = _dealt(good.select("path")).mapInArrow(read, "path string, modificationTime timestamp, length bigint, content binary")
    return rows.withColumn("modificationTime", F.date_trunc("millisecond", "modificationTime"))


#: Bytes of contents that a task holds, and files or folders that one task opens.
_HELD = 4 << 20
_PER_TASK = 5000
_FILES = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])
_ENTRIES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])
_GATED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("error_type", pa.string())])


def _named(pattern: str) -> Column:
    """Whether the file name of ``path`` fits a pattern of ``*``, ``?`` and ``[...]``."""
    return F.substring_index("path", "/", -1).rlike("^" + fnmatch.translate(pattern)[:-2] + r"\z")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


@functools.cache
def _root(root: str):
    return fs.FileSystem.from_uri(root + "/")


def _store(path: str):
    """The store of a qualified path, as a task opens it, and the path inside."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    root = re.match("[^:/]+://[^/]*", path).group()
    store, base = _root(root)
    return store, base.rstrip("/") + path.removeprefix(root)


def _content(path: str) -> bytes:
    store, own = _store(path)
    with store.open_input_stream(own) as f:
        return f.read()


def _inspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        yield _batch([(n, size, _inspect(_content(n))) for n, size in zip(names, batch.column(1).to_pylist())], _GATED)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files and folders directly below each folder; names that Spark's scans pass over are left out."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            store, own = _store(folder)
            found = store.get_file_info(fs.FileSelector(own))
            seen = [x for x in found if not (x.base_name[:1] == "." or x.base_name[:1] == "_" and "=" not in x.base_name or x.base_name.endswith("._COPYING_"))]
            rows = [(f"{folder.rstrip('/')}/{x.base_name}", x.size, x.type == fs.FileType.Directory) for x in seen]
            for at in range(0, len(rows), _PER_TASK):
                yield _batch(rows[at : at + _PER_TASK], _ENTRIES)


def _dealt(rows: DataFrame) -> DataFrame:
    """Paths dealt to tasks by their number: bytes say nothing of the work, so adaptive execution must not merge them."""
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(n, max(cores, -(-n // _PER_TASK)))), "path")


def listing(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """``(path, length)`` of all files below a folder, those without a byte too.

    Tasks list the folders level by level, and each level is a stored table: no name comes to the driver. Paths are as a scan
    writes them. Tasks open local (mounted) folders and the stores that Arrow knows (HDFS, S3, GCS, Azure).
    """
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString()
    folders, out = spark.createDataFrame([(own,)], "path string"), None
    while not folders.isEmpty():
        level = stored(_dealt(folders).mapInArrow(_listed, "path string, length bigint, folder boolean"), "listing")
        files = level.filter(~F.col("folder") & _named(pattern)).select("path", "length")
        out = files if out is None else out.unionByName(files)
        folders = level.filter("folder").select("path")
    return out


# --- artefacts --------------------------------------------------------------------------------
def write_batch(rows: DataFrame, path: str, batch: int, form: str = "parquet") -> None:
    """Rows of one batch of work. A batch owns its folder ``batch=n``: written again, it replaces what it wrote before
    and touches no other batch, so a repeated or resumed job leaves no row twice."""
    out = rows.withColumn("batch", F.lit(batch))
    out.write.format(form).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").save(path)


def read_batches(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """All rows with their batch, read with the caller's schema; what does not fit it stays in ``_corrupt``."""
    if form == "json":
        reader = spark.read.schema(f"{schema}, batch int, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        return reader.json(path)
    return spark.read.schema(f"{schema}, batch int").format(form).load(path).withColumn("_corrupt", F.lit(None).cast("string"))


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of each key (a version, a document) from the last batch that wrote it; broken rows have no key and go."""
    fine = rows.filter("_corrupt IS NULL").drop("_corrupt")
    last = fine.groupBy(*key).agg(F.max("batch").alias("batch"))
    return fine.join(last, [*key, "batch"], "left_semi")


def broken(rows: DataFrame) -> DataFrame:
    return rows.filter("_corrupt IS NOT NULL").select("batch", F.col("_corrupt").alias("line"))


def parsed_of(versions: DataFrame, parsed: DataFrame) -> DataFrame:
    """Parsed blocks of the given versions; a version without any comes once, with NULLs."""
    return versions.join(parsed, ["template_id", "template_version_id"], "left")


def output_rows(renditions: DataFrame, buckets: int = 256) -> DataFrame:
    """Rendered texts with their key. Folders below a batch are hash buckets: a folder per document would not scale."""
    return renditions.withColumns({
        "output_path": output_key(F.col("document_id"), F.col("version_number")),
        "bucket": F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"),
    })


# --- logs -------------------------------------------------------------------------------------
def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Structured log files; unreadable lines stay in ``_corrupt``."""
    return spark.read.schema(LOG).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def parse_logs(lines: DataFrame, value: str = "value") -> DataFrame:
    """The same for lines that are already rows."""
    parsed = F.from_json(value, LOG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("log")).select("log.*")


def logs_by_correlation(logs: DataFrame) -> DataFrame:
    """Lines, errors, first and last time of every correlation id."""
    return logs.filter(F.col("correlation_id").isNotNull()).groupBy("correlation_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"),
        F.count_if(F.col("exception").isNotNull()).alias("exceptions"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
    )
