"""WARC archives: a writer of one gzip member per record, and a reader that splits archives by byte range.

*Writer.* Of rows with equal payloads the one with the smallest page_id is a response, the others are revisits
that name it. Each record is one gzip member. Spark's text writer puts the members behind one another: a member
ends with the high byte of its length, zero below 16 MB, so that byte serves as the line separator; a larger
member is followed by an empty member, which ends with zero as well.

*Reader.* Spark deals out byte ranges of the archives. A task cuts its range at the gzip magic; a piece is a candidate
member. A candidate counts if its gzip header is sound and it decodes to a WARC header. A candidate that decodes without an end
held the magic bytes by chance; the next pieces are appended until it ends. A record belongs to the range in which it starts.
What such a record has beyond its range is returned as a fragment by the next ranges and joined by file; those are the only
rows that are shuffled, and a second pass over the ranges finds them.

The reader takes any archive of gzip members whose name does not end in ``.gz`` (Spark would decompress the file as a whole).

Defined results: a null html is an empty payload; null urls are written as empty; rows that share the smallest page_id of a payload are
all responses; a null page_id comes last (a group of nulls only has responses only); payloads below
``least`` bytes are responses; further columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import arrays as A
from foliate.llm.common import shared_dir, stored

MAGIC = b"\x1f\x8b\x08"
#: The same bytes as a separator for Spark's reader.
SEPARATOR = MAGIC.decode("latin-1")
ID = "urn:page:"
RECORDS = (
    "record_type string, page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "refers_to bigint, payload binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page) -> str:
    return f"<{ID}{'' if page is None else page}>"


def _page(text: str | None) -> int | None:
    name = (text or "").strip("<>").removeprefix(ID)
    return int(name) if name.lstrip("-").isdigit() else None


def member(page, url: str | None, payload: bytes, first, revisit: bool) -> bytes:
    """One record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page)}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(first)}"]
    head.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = press.compress(data) + press.flush()
    return out if out[-1] == 0 else out + _empty()


def _empty() -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(b"") + press.flush()


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archives of all rows of ``pages(page_id, url, html)`` in the folder ``path``."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.when(F.length("payload") >= least, F.sha1("payload")))
    # Only payloads that occur twice or more take part in the join.
    again = rows.filter("sha is not null").groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = stored(again.filter("n > 1").select(F.col("sha").alias("_sha"), "first"), "again")
    marked = rows.join(again, rows["sha"] == again["_sha"], "left").select(
        "page_id",
        "url",
        "payload",
        "first",
        (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"),
    )

    def run(batches):
        for batch in batches:
            for part in A.slices(batch, "payload"):
                out = [member(*row)[:-1] for row in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    members = marked.mapInArrow(run, "value binary")
    # The cast keeps the bytes as they are; the separator is the byte that each member ends with.
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _record(data: bytes) -> dict | None:
    """The parts of a decoded member; None unless it is a WARC record."""
    if not data.startswith(b"WARC/"):
        return None
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    block = block[: int(fields.get("content-length") or 0)]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields.get("warc-type") == "revisit"
    size = len(payload)
    if revisit:
        for line in http.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                size = int(line.partition(b":")[2])
    named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not revisit and named and named != digest(payload):
        raise ValueError(f"record {fields.get('warc-record-id')}: payload does not match its digest")
    return {
        "record_type": fields.get("warc-type"),
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": named or digest(payload),
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload": None if revisit else payload,
    }


class Members:
    """Members from consecutive pieces: whole records, and what is left at either end of a range."""

    def __init__(self, open_: list[bytes] | None = None):
        self.head: list[bytes] = []  # pieces before the first record: the end of a record of an earlier range
        self.open: list[bytes] = open_ or []  # pieces of a record that has not ended
        self.started = bool(open_)

    def feed(self, piece: bytes):
        """Records that end with this piece (each piece had the magic bytes before it)."""
        for pieces in ([*self.open, piece], [piece]) if self.open else ([piece],):
            text, whole, sound = decoded(MAGIC + MAGIC.join(pieces))
            if sound:
                break
            # What was open is no member; the piece may be one by itself.
            if not self.started:
                self.head += self.open if len(pieces) > 1 else [piece]
            self.open = []
        else:
            return
        if not whole:
            self.open = pieces
            return
        self.open, self.started = [], True
        record = _record(text)
        if record:
            yield record


def decoded(data: bytes) -> tuple[bytes, bool, bool]:
    """(text, whole, sound) of one candidate member; bytes behind its end are ignored."""
    press = zlib.decompressobj(31)
    try:
        text = press.decompress(data)
    except zlib.error:
        return b"", False, False
    return text, press.eof, text.startswith(b"WARC/"[: len(text)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in ``path``."""
    lines = (
        spark.read.option("lineSep", SEPARATOR)
        .option("encoding", "ISO-8859-1")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("piece"),
        )
    )
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = f"{RECORDS}, file string, block bigint, head array<binary>, open array<binary>"
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    all_names = [*names, "file", "block", "head", "open"]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(all_names, types)], all_names)

    def run(batches):
        where, members, out, size = None, None, [], 0

        def rest():
            if members is not None and (members.head or members.open):
                out.append({"file": where[0], "block": where[1], "head": members.head, "open": members.open})

        for batch in batches:
            for file, block, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != where:
                    rest()
                    where, members = (file, block), Members()
                    if block == 0:
                        continue  # what stands before the first magic of a file
                for record in members.feed(piece):
                    out.append(record)
                    size += len(record["payload"] or b"")
                if size > 4 << 20:
                    yield batch_of(out)
                    out, size = [], 0
        rest()
        if out:
            yield batch_of(out)

    def join(t: pa.Table) -> pa.Table:
        """Records of one file that run over the end of a range."""
        out, members = [], Members()
        for r in sorted(t.to_pylist(), key=lambda r: r["block"]):
            for piece in r["head"] or []:
                if members.open:
                    out += members.feed(piece)
            if r["open"]:
                members = Members(r["open"])
        return pa.table({n: pa.array([x.get(n) for x in out], k) for n, k in zip(names, types)})

    parsed = lines.mapInArrow(run, kinds)
    whole = parsed.filter("file is null").select(*names)
    fragments = parsed.filter("file is not null").select("file", "block", "head", "open")
    return whole.unionByName(fragments.groupBy("file").applyInArrow(join, RECORDS))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives below the shared folder, read them back, one row per record."""
    path = shared_dir(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
