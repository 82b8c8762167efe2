"""A content-addressed store of token ids.

A rolling hash over the last 16 ids cuts each document's ids into chunks, so equal passages give
equal chunks wherever they stand. A chunk is named by its BLAKE2b digest and stored once. A
document's recipe lists its chunks and carries their Merkle root; each file of recipes has a
manifest row with the Merkle root over its documents.

Folders of a store (all Parquet, written by Spark alone):
  segments/   digest, n, body (a width byte, 2 or 4, then little-endian ids; null in rows that only
              refer to a chunk), and for each use of a chunk doc_id, uid, k
  recipes/    doc_id, uid, n_tokens, part, at, local_start, root, chunks array<struct<digest, n>>, by doc_id;
              at and local_start count the documents and ids before it in its file
  manifest/   part, n_docs, n_tokens, base, root (of the Merkle tree over its documents)

Chunk bodies cross the network once. A task sends a body once; later uses of the same chunk are sent
without it and are dealt by document, so a text that a third of all documents share loads no task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import default_path, encoder
from quarry.llm.common import n_partitions, new_path, table, tune

END_ID, VOCABULARY = 1, "word_bpe_49k.json"
#: Chunk lengths in ids: at least, about (a power of 2), at most.
LEAST, ABOUT, MOST = 64, 512, 4096
#: Documents in a block of a manifest's tree.
TREE = 1024
#: Digests that a task remembers as sent; forgetting one costs a repeated body, nothing else.
_SENT = 200_000


def marks(ids: np.ndarray, about: int = ABOUT) -> np.ndarray:
    """Where a chunk may end: a hash of the last 16 ids has a certain remainder."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint64(step)
    return np.flatnonzero((h >> np.uint64(20)) & np.uint64(about - 1) == 0) + 1


def cuts(found: list[int], n: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of n ids, the last being n. Marks before the 16th id count for nothing, as
    chunks are longer, so marks may be found over many documents in a row."""
    ends, last = [], 0
    for m in [*found, n]:
        while m - last > most:
            last += most
            ends.append(last)
        if m - last >= least or (m == n and m > last):
            ends.append(m)
            last = m
    return ends


def pack_ids(ids: np.ndarray) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return (b"\4" + ids.astype("<u4").tobytes()) if wide else (b"\2" + ids.astype("<u2").tobytes())


def unpack_ids(body: bytes) -> np.ndarray:
    return np.frombuffer(body, f"<u{body[0]}", offset=1).astype("<u4")


def digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Leaves are digests of chunks, whose first byte is 2 or 4, inner nodes start with 1; an odd node
    moves up alone."""
    level = leaves or [bytes(16)]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = up + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of CRC-32, bits reflected."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(maxsize=1 << 16)
def _shift(n_bytes: int) -> int:
    out, power, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            out = _times(power, out)
        power = _times(power, power)
        n >>= 1
    return out


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """crc32 of byte strings in a row from (crc32, length) of each."""
    crc = 0
    for c, n in parts:
        crc = c ^ (_times(_shift(n), crc) if crc else 0)
    return crc


def _chunked(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sent = encoder(path, end_id), set()
        for b in batches:
            at, ks, keys, names, ns, bodies = [], [], [], [], [], []
            raws = enc.encode(b.column(2).to_pylist())
            every = np.frombuffer(b"".join(raws), "<u4")
            firsts = np.cumsum([0, *(len(r) // 4 for r in raws)])
            found = marks(every)
            of = np.searchsorted(found, firsts, "right").tolist()
            for i, (first, stop) in enumerate(zip(firsts.tolist(), firsts[1:].tolist(), strict=False)):
                last, inside = 0, found[of[i] : of[i + 1]] - first
                for k, end in enumerate(cuts(inside.tolist(), stop - first)):
                    body = pack_ids(every[first + last : first + end])
                    name = digest(body)
                    at.append(i)
                    ks.append(k)
                    names.append(name)
                    ns.append(end - last)
                    last = end
                    if name in sent:
                        keys.append(None)
                        bodies.append(None)
                        continue
                    keys.append(name)
                    bodies.append(body)
                    if len(sent) >= _SENT:
                        sent.clear()
                    sent.add(name)
            rows = pa.array(at, pa.int64())
            cols = [b.column(0).take(rows), b.column(1).take(rows), pa.array(ks, pa.int32()), pa.array(keys, pa.binary()), pa.array(names, pa.binary()), pa.array(ns, pa.int32()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "uid", "k", "key", "digest", "n", "body"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the body of a chunk that this task has already passed on."""
    seen: set[bytes] = set()
    for b in batches:
        body = b.column("body")
        keep = body.is_valid().to_numpy(zero_copy_only=False).copy()
        names = b.column("digest").to_pylist()
        for i in np.flatnonzero(keep).tolist():
            if names[i] in seen:
                keep[i] = False
            else:
                seen.add(names[i])
        yield b.set_column(b.schema.get_field_index("body"), "body", pc.if_else(pa.array(keep), body, pa.scalar(None, pa.binary())))


def _lists(column: pa.Array, *fields: str) -> tuple[list[int], list[list]]:
    """Offsets of a column of lists of structs, and its structs' fields, all rows in a row."""
    flat = column.flatten()
    return [0, *np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)).tolist()], [flat.field(f).to_pylist() for f in fields]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, start, before = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.column("n_tokens").to_pylist()
        at, (names,) = _lists(b.column("chunks"), "digest")
        roots = [merkle(names[x:y]) for x, y in zip(at, at[1:], strict=False)]
        starts = start + np.cumsum([0, *n])
        start = int(starts[-1])
        cols = [b.column("doc_id"), b.column("uid"), b.column("n_tokens"), pa.array([part] * len(n), pa.int32()), pa.array(np.arange(before, before + len(n)), pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(roots, pa.binary()), b.column("chunks")]
        before += len(n)
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "uid", "n_tokens", "part", "at", "local_start", "root", "chunks"])


def _roots(leaf: bool):
    """Rows (..., list of (place, root)) -> Merkle roots of the lists; leaves are hashed first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [[x["root"] for x in row] for row in b.column("below").to_pylist()]
            if leaf:
                lists = [[hashlib.blake2b(b"\3" + x, digest_size=16).digest() for x in row] for row in lists]
            names = [*b.schema.names[:-1], "root"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([merkle(row) for row in lists], pa.binary())], names)

    return run


def _manifest(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, base, root of each file of recipes. Its Merkle tree stands over blocks of
    TREE documents, a power of 2, so that no row lists more than TREE roots or the roots of all blocks of a file."""
    parts = recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    block = F.floor(F.col("at") / TREE).alias("block")
    low = recipes.groupBy("part", block).agg(F.sort_array(F.collect_list(F.struct("at", "root"))).alias("below"))
    low = low.mapInArrow(_roots(True), "part int, block long, root binary")
    top = low.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("block", "root"))).alias("below"))
    parts = parts.join(top.mapInArrow(_roots(False), "part int, root binary"), "part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each file
    return parts.select("part", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "root")


def write_store(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write every row of docs to a new store in `folder` and return it.

    A null or empty text is its end id alone; null ids come first; rows that repeat an id follow
    each other and share chunks; other columns are ignored; an empty table gives an empty store.
    """
    spark, path = docs.sparkSession, path or default_path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_chunked(path, end_id), f"doc_id {kind}, uid long, k int, key binary, digest binary, n int, body binary")
    n = n_partitions(spark)
    dealt = rows.repartition(n, F.coalesce(F.xxhash64("key"), F.lit(0)), F.when(F.col("key").isNull(), F.xxhash64("uid")).otherwise(0)).drop("key")
    dealt.mapInArrow(_once, dealt.schema).write.option("compression", "zstd").parquet(f"{folder}/segments")
    uses = spark.read.schema(dealt.schema).parquet(f"{folder}/segments").select("doc_id", "uid", "k", "digest", "n")
    listed = uses.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("k", "digest", "n"))).alias("c"))
    listed = listed.select("doc_id", "uid", "n_tokens", F.transform("c", lambda x: F.struct(x["digest"].alias("digest"), x["n"].alias("n"))).alias("chunks"))
    ordered = listed.repartitionByRange(n, "doc_id", "uid").sortWithinPartitions("doc_id", "uid")
    shape = f"doc_id {kind}, uid long, n_tokens long, part int, at long, local_start long, root binary, chunks array<struct<digest:binary,n:int>>"
    ordered.mapInArrow(_recipes, shape).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    recipes = spark.read.schema(shape).parquet(f"{folder}/recipes")
    parts = _manifest(recipes)
    parts.write.parquet(f"{folder}/manifest")
    return folder


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, ns, crcs = b.column("digest").to_pylist(), b.column("n").to_pylist(), []
        for name, n, body in zip(names, ns, b.column("body").to_pylist(), strict=True):
            ids = unpack_ids(body)
            if digest(body) != name or len(ids) != n:
                raise ValueError(f"chunk {name.hex()} is damaged")
            crcs.append(zlib.crc32(ids))
        yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(crcs, pa.int64())], ["digest", "crc"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, (names, ns, parts) = _lists(b.column("chunks"), "digest", "n", "crc")
        crcs = []
        for root, x, y in zip(b.column("root").to_pylist(), at, at[1:], strict=False):
            if merkle(names[x:y]) != root:
                raise ValueError("a recipe does not match its Merkle root")
            crcs.append(crc32_joined([(c, 4 * n) for c, n in zip(parts[x:y], ns[x:y], strict=True)]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of a store, the recipes held against the manifest."""
    segments, recipes, manifest = (spark.read.parquet(f"{folder}/{x}") for x in ("segments", "recipes", "manifest"))
    now = _manifest(recipes)
    if now.exceptAll(manifest.select(now.columns)).count() or manifest.select(now.columns).exceptAll(now).count():
        raise ValueError("recipes do not match the manifest")
    return segments, recipes, manifest


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored bytes. Every chunk is
    read and held against its digest, every recipe against its Merkle root. The checksum of a
    document's ids is put together from its chunks' checksums, so bodies need no second shuffle."""
    segments, recipes, manifest = _parts(spark, folder)
    chunks = segments.filter("body is not null").select("digest", "n", "body").mapInArrow(_read_chunks, "digest binary, crc long")
    listed = recipes.join(F.broadcast(manifest.select("part", "base")), "part")  # one row for each file of recipes
    uses = listed.select("uid", F.posexplode("chunks").alias("k", "c")).select("uid", "k", "c.digest", "c.n")
    found = uses.join(chunks, "digest").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "digest", "n", "crc"))).alias("chunks"))
    whole = listed.select("uid", "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "root").join(found, "uid", "left")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(_verified, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, uid, ids array<long>: every document's ids, put together from the stored chunks."""
    segments, recipes, _ = _parts(spark, folder)
    bodies = segments.filter("body is not null").select("digest", "body")
    uses = recipes.select("uid", "doc_id", F.posexplode("chunks").alias("k", "c")).select("uid", "k", "c.digest")
    found = uses.join(bodies, "digest").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "body"))).alias("b"))
    found = recipes.select("uid", "doc_id", "root").join(found, "uid", "left")
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root, row in zip(b.column("root").to_pylist(), b.column("b").to_pylist(), strict=True):
                if merkle([digest(x["body"]) for x in row or []]) != root:
                    raise ValueError("chunks of a document are damaged or lost")
            ids = [np.concatenate([unpack_ids(x["body"]) for x in row]).tolist() for row in b.column("b").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("uid"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "uid", "ids"])

    return found.select("doc_id", "uid", "root", "b").mapInArrow(run, f"doc_id {kind}, uid long, ids array<long>")


def op7_token_id_store(spark, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    return read_digests(spark, write_store(docs, new_path(spark, "token-store")))
