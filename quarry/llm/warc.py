"""WARC archives: writing captures, and assembling transactions from records.

Each capture is three records: a request, a response (or a revisit of an equal payload) and
metadata; request and metadata name the response in WARC-Concurrent-To. Every record is a gzip
member of its own, as readers of WARC files expect, and files end in .warc.gz. Reading takes files
whole (their size is bounded in bytes), streams through the members and follows Content-Length, so
payloads may hold anything.

Payloads are compressed before anything else and never shuffled as they are: which captures are
revisits is found from digests alone, and only headers and digests meet when transactions are put
together.

Spark's text sink writes the files, so they may lie wherever Spark can write. It ends each row with a
separator; a row is a run of gzip members without its last byte, and the separator is that byte: the
length at the end of a member is little-endian, so its last byte is zero.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import new_path, remove, table, tune, written, written_path

LEAST_REVISIT, DATE, LEVEL = 100, "2024-01-01T00:00:00Z", 6
#: A row of the sink holds members of so many bytes, or one capture; a file holds so many rows.
ROW_BYTES, ROWS_PER_FILE = 4 << 20, 16
SUFFIX = ".warc.gz"


def member(block: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(block) + z.flush()


def _record_id(salt: str, uid: int, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{salt} {kind} {uid}'.encode()).hexdigest())}>"


def _record(kind: str, record_id: str, uri: str | None, content: str, block: bytes, *more: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {uri}")
    lines += [*more, f"Content-Type: {content}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _responses(salt: str):
    """uid, page_id, url, html -> uid, page_id, url, n, digest, member: each page as a response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, digests, members = [], [], []
            for uid, url, html in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = (html or "").encode("utf-8", "surrogatepass")
                ns.append(len(raw))
                digests.append(hashlib.sha256(raw).hexdigest())
                members.append(member(_record("response", _record_id(salt, uid, "response"), url, "application/http; msgtype=response", _http(len(raw)) + raw, f"WARC-Payload-Digest: sha256:{digests[-1]}")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ns, pa.int64()), pa.array(digests, pa.string()), pa.array(members, pa.binary())], ["uid", "page_id", "url", "n", "digest", "member"])

    return run


def _rows(salt: str):
    """Captures -> rows of the sink: the members of request, response or revisit, and metadata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for uid, page_id, url, n, digest, response, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                me = _record_id(salt, uid, "response")
                to_me = f"WARC-Concurrent-To: {me}"
                if first is not None:
                    response = member(
                        _record(
                            "revisit", me, url, "application/http; msgtype=response", _http(n), f"WARC-Payload-Digest: sha256:{digest}",
                            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(salt, first, 'response')}",
                        )
                    )
                request = member(_record("request", _record_id(salt, uid, "request"), url, "application/http; msgtype=request", f"GET {url if url is not None else '/'} HTTP/1.1\r\n\r\n".encode("utf-8", "surrogatepass"), to_me))
                fields = b"" if page_id is None else f"page-id: {quote(page_id)}\r\n".encode()
                capture = request + response + member(_record("metadata", _record_id(salt, uid, "metadata"), url, "application/warc-fields", fields, to_me))
                if held and size + len(capture) > ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
                    held, size = [], 0
                held.append(capture)
                size += len(capture)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

    return run


def _rename(spark: SparkSession, folder: str) -> None:
    """Give the sink's files their suffix; names alone change, one file in some tens of megabytes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(path(f"{folder}/part-*.txt")) or []:
        if not fs.rename(f.getPath(), path(f.getPath().toString().removesuffix(".txt") + SUFFIX)):
            raise OSError(f"could not rename {f.getPath()}")


def write_archives(pages: DataFrame, folder: str, rows_per_file: int = ROWS_PER_FILE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write every row of pages as a capture.

    Of equal payloads of LEAST_REVISIT bytes or more the smallest id (null last, then the first row) is
    the response, the others revisit it. Ids of any type that casts to a string will do. Null html is
    empty; a null url has no Target-URI; line breaks in a url are escaped; repeated rows are captures
    of their own; other columns are ignored; an empty table gives no records.
    """
    spark, salt = pages.sparkSession, uuid.uuid4().hex
    url = F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("page_id"), url.alias("url"), F.col(html_col).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    found, captured = written_path(rows.mapInArrow(_responses(salt), f"uid long, page_id {kind}, url string, n long, digest string, member binary"), "captures")
    again = found.filter(F.col("n") >= LEAST_REVISIT).select("digest", "uid", "page_id")
    firsts = again.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid")).alias("of"), F.count("*").alias("many"))
    firsts = firsts.filter("many > 1").select("digest", F.col("of.uid").alias("first"))
    revisits, repeated = written_path(again.join(firsts, "digest").filter("uid <> first").select("uid", "first"), "revisits")
    # revisits need no payload, so none of theirs goes on
    out = found.join(revisits, "uid", "left").select("uid", F.col("page_id").cast("string"), "url", "n", "digest", F.when(F.col("first").isNull(), F.col("member")), "first")
    out = out.mapInArrow(_rows(salt), "value binary").select(F.col("value").cast("string"))
    out.write.option("compression", "none").option("lineSep", "\0").option("maxRecordsPerFile", rows_per_file).text(folder)
    _rename(spark, folder)
    remove(spark, captured)
    remove(spark, repeated)
    return folder


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        heads = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            heads[k.strip().lower()] = v.strip()
        n = int(heads["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut off")
        yield heads, block


#: The columns of a record: page_id from metadata, n_bytes and payload from responses.
_FIELDS = "record_id string, kind string, concurrent_to string, refers_to string, uri string, declared string, page_id string, n_bytes long, digest string, payload binary"


def records(spark: SparkSession, folder: str, payloads: bool = False, id_type: str = "long") -> DataFrame:
    """One row per record in a folder of archives, gzip or plain. A response's digest is computed from
    its payload and held against the declared one; payloads themselves come along if asked for."""
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for content in b.column(0).to_pylist():
                raw = io.BytesIO(content)
                for h, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if content[:2] == b"\x1f\x8b" else raw):
                    kind, page, n, digest, body = h["warc-type"], None, None, None, None
                    declared = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        n, digest = len(body), hashlib.sha256(body).hexdigest()
                        if declared not in (None, digest):
                            raise ValueError(f"payload of {h['warc-record-id']} is damaged")
                    elif kind == "metadata":
                        fields = dict(x.split(b": ", 1) for x in block.split(b"\r\n") if b": " in x)
                        page = unquote(fields[b"page-id"].decode()) if b"page-id" in fields else None
                    rows.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), declared, page, n, digest, body if payloads else None))
                    if len(rows) >= 256:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(folder).select("content").mapInArrow(run, _FIELDS)
    return found.withColumn("page_id", F.col("page_id").cast(id_type))


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, page_id, and structs request, response, metadata.

    Records of one capture meet by the identifier that WARC-Concurrent-To names, else their own. A
    missing record is a null struct.
    """
    key = F.coalesce("concurrent_to", "record_id")
    one = lambda kinds, *cols: F.max(F.when(F.col("kind").isin(*kinds), F.struct(*cols)))
    together = found.groupBy(key.alias("record_id")).agg(
        one(("request",), F.col("record_id").alias("id"), "uri").alias("request"),
        one(("response", "revisit"), F.col("record_id").alias("id"), "kind", "uri", "refers_to", "declared", "n_bytes", "digest", "payload").alias("response"),
        one(("metadata",), F.col("record_id").alias("id"), "page_id").alias("metadata"),
    )
    return together.withColumn("page_id", F.col("metadata.page_id"))


def resolved(transactions: DataFrame) -> DataFrame:
    """Adds `of`, the capture whose payload a revisit repeats: its page_id, n_bytes and digest. Only
    revisits are joined; transactions are read twice, so write them first."""
    first = transactions.filter("response.kind = 'response'").select(F.col("response.id").alias("to"), F.struct("page_id", "response.n_bytes", "response.digest").alias("of"))
    again = F.coalesce(F.col("response.kind") == "revisit", F.lit(False))
    revisits = transactions.filter(again).join(first, F.col("response.refers_to") == F.col("to"), "left").drop("to")
    return revisits.unionByName(transactions.filter(~again).withColumn("of", F.lit(None).cast(first.schema["of"].dataType)))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(tune(spark), sf_dir, "pages")
    folder = write_archives(pages, new_path(spark, "warc"))
    found = records(spark, folder, id_type=pages.schema["page_id"].dataType.simpleString())
    rows = resolved(written(captures(found).filter("response is not null"), "transactions"))
    return rows.select(
        "page_id",
        F.coalesce("response.n_bytes", "of.n_bytes").alias("payload_bytes"),
        F.coalesce("response.digest", "of.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("of.page_id").alias("refers_to"),
    )


OP8_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
