"""Operator 7: WARC archives with an index that is written first and read by coalesced byte ranges.

Writing: one gzip member per record, in archives of bounded size. Records with equal payloads of at least
``MIN_SHARED`` bytes are kept once, as the response of the largest page_id; the others are revisits that name it.
The index (archive, offset, length, url, digest, ...) holds what the writing tasks return, so it names only the
archives of tasks that ended well: a lost executor's half-written archive is never read.

Reading: index rows are chosen, sorted by archive and offset, and neighbours at most ``GAP`` bytes apart are
read as one range of at most ``RUN`` bytes (a longer record is a range of its own). Ranges are dealt over tasks of about
``RUN`` bytes each, and over all cores if there are fewer; MOST_TASKS bounds the tasks, not what they read.

Records are named by their archive and offset, so names never repeat. What WARC has no header for stands in extension
headers: the page of a record, the page that a revisit refers to, and the length of the payload that it leaves out.

Defined cases: a null html is an empty payload, a null url an empty one; repeated rows are records of their
own (of equal page_ids among equal payloads all are responses); a row without page_id can be a revisit but not
what others refer to; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwise.llm.common import materialise, scratch, table

MIN_SHARED = 1000
ARCHIVE_BYTES = 64 << 20
GAP = 64 << 10
RUN = 8 << 20
MOST_TASKS = 50_000
DATE = "2024-01-01T00:00:00Z"

INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None, place: str = "") -> bytes:
    """One record, named by its ``place``. A revisit keeps its headers and the length (``size``) of the payload that it leaves out."""
    body = b"" if refers_to is not None else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page: {'' if page_id is None else page_id}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {size}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """The record in one gzip member, its payload length and digest computed anew for a response."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    out = {"page_id": int(fields["X-Page"]) if fields["X-Page"] else None, "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload": body}
    if out["record_type"] == "response":
        return out | {"payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest(), "refers_to": None}
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return out | {"payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "refers_to": int(fields["X-Refers-To-Page"])}


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    out, name, at = None, "", 0
    try:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    # A name of its own for each attempt: a task that runs twice never shares a file.
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(r["page_id"], r["url"], r["payload"] or b"", r["size"], r["digest"], r["refers_to"], f"{name}:{at}"))
                out.write(data)
                kind = "response" if r["refers_to"] is None else "revisit"
                rows.append((r["page_id"], f"{folder}/{name}", at, len(data), r["url"], r["digest"], kind, r["refers_to"]))
                at += len(data)
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _INDEX.types, strict=True)], schema=_INDEX)
    finally:
        if out is not None:
            out.close()


_INDEX = pa.schema([("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder``; returns their index, as a written table."""
    spark = pages.sparkSession
    folder = folder or scratch(spark)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= MIN_SHARED
    # Of the payloads only those that occur again; counts and maxima are made before the shuffle.
    shared = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").select("digest", "_last")
    marked = rows.join(shared, "digest", "left")
    refers = F.when(long & F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("page_id")), F.col("_last"))
    marked = marked.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", F.octet_length("payload").alias("size"), refers.alias("refers_to"))
    return materialise(marked.mapInArrow(_Writer(folder), INDEX))


class _Writer:
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write(self.folder, batches)


def ranges(index: DataFrame) -> DataFrame:
    """(archive, start, stop, parts): the byte ranges to read for the rows of ``index``; parts are (offset, length) inside."""
    # Cells of RUN bytes bound both a range and what is sorted together; an archive has a bounded number of them.
    cells = index.select("archive", "offset", "length", F.expr(f"offset div {RUN}").alias("cell"))
    w = Window.partitionBy("archive", "cell").orderBy("offset")
    new = F.coalesce((F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(w) > GAP).cast("int"), F.lit(1))
    runs = cells.withColumn("run", new).withColumn("run", F.sum("run").over(w))
    return runs.groupBy("archive", "cell", "run").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("parts")
    ).select("archive", "start", "stop", "parts")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            files, path = _open(r["archive"])
            with files.open_input_file(path) as f:
                f.seek(r["start"])
                data = io.BytesIO(f.read(r["stop"] - r["start"])).getbuffer()
            rows, held = [], 0
            for p in r["parts"]:
                at = p["offset"] - r["start"]
                rows.append(parse(bytes(data[at : at + p["length"]])))
                held += len(rows[-1]["payload"])
                if held > RUN:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)


def read_records(index: DataFrame) -> DataFrame:
    """The records that the rows of ``index`` name, with their payloads (empty for revisits)."""
    spark = index.sparkSession
    size = index.agg(F.sum("length")).first()[0] or 0
    # An index is small beside what it names: adaptive execution would read all archives in a task or two.
    tasks = max(-(-size // RUN), min(spark.sparkContext.defaultParallelism, -(-size // (1 << 18))), 1)
    return ranges(index).repartition(min(tasks, MOST_TASKS), "archive", "start").mapInArrow(_read, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
FROM m
"""
