"""Best-two-fit packing of token sequences.

Pieces of one length can stand for each other, so bins are planned over the histogram of lengths
(`size` counters, whatever the number of documents): fill a bin greedily with the longest pieces
that fit, then replace its smallest piece with two unpacked ones that fit the widened gap more
tightly, and use the pattern as often as the counts allow. Each use of a pattern runs some length
down below what it needs, so there are at most about size * ln(size) patterns. Pieces then take
their places by their rank within their length: a local rank from the task that wrote them plus an
offset from a table of counts, so that no task ever sorts or holds all pieces of a length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import default_path, encoder
from quarry.llm.common import table, tune, written

SIZE, END_ID, VOCABULARY = 1024, 2, "byte_bpe_50k.json"


def plan(counts: list[int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """counts[n]: pieces of n tokens. [(lengths in one bin, how many such bins)], all pieces placed."""
    c = np.array(counts, np.int64)
    out: list[tuple[list[int], int]] = []
    for longest in range(size, 0, -1):
        while c[longest]:
            free = c.copy()
            bin_, gap = [longest], size - longest
            free[longest] -= 1
            while gap:
                fits = np.flatnonzero(free[1 : gap + 1])
                if not len(fits):
                    break
                n = int(fits[-1]) + 1
                bin_.append(n)
                free[n] -= 1
                gap -= n
            while gap and len(bin_) > 1:
                least = bin_[-1]
                free[least] += 1
                if not (two := _two(free, least, gap + least)):
                    free[least] -= 1
                    break
                bin_ = sorted([*bin_[:-1], *two], reverse=True)
                for n in two:
                    free[n] -= 1
                gap += least - sum(two)
            uses = Counter(bin_)
            times = min(int(c[n]) // k for n, k in uses.items())
            for n, k in uses.items():
                c[n] -= k * times
            out.append((bin_, times))
    return out


def _two(free: np.ndarray, more_than: int, room: int) -> tuple[int, int] | None:
    """Two free lengths of at most `room` together, as much as possible, and over `more_than`."""
    there = free[: room + 1] > 0
    for total in range(room, max(more_than, 1), -1):
        small = np.arange(1, total // 2 + 1)
        ok = there[small] & there[total - small]
        if total % 2 == 0:
            ok[-1] &= free[total // 2] > 1
        if ok.any():
            a = int(small[np.flatnonzero(ok)[-1]])
            return total - a, a
    return None


def places(patterns: list[tuple[list[int], int]], size: int = SIZE) -> dict[int, np.ndarray]:
    """For each length an array of (first rank, first sequence, offset), by rank."""
    rank, seq = [0] * (size + 1), 0
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for bin_, times in patterns:
        at = 0
        for n in bin_:
            rows.setdefault(n, []).append((rank[n], seq, at))
            rank[n] += times
            at += n
        seq += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and cut what is longer than `size`: all pieces but the first are full.

    Columns: id, piece, start, length, ids (binary, little-endian unsigned 32-bit), pid and rank (the
    number of earlier pieces of that length from the same task). Write it before use: pid and rank
    belong to that one run.
    """
    path = path or default_path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, seen = encoder(path, end_id), TaskContext.get().partitionId(), [0] * (size + 1)
        for b in batches:
            at, piece, start, length, ids, rank = [], [], [], [], [], []
            for i, body in enumerate(enc.encode(b.column(1).to_pylist())):
                n = len(body) // 4
                cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(i)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    ids.append(body[4 * x : 4 * y])
                    rank.append(seen[y - x])
                    seen[y - x] += 1
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([pid] * len(at), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "piece", "start", "length", "ids", "pid", "rank"])

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return got.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary, pid int, rank long").withColumnRenamed("id", id_col)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces(), once written."""
    counts = written(cut.groupBy("pid", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = [0] * (size + 1)
    for n, k in counts.groupBy("length").agg(F.sum("n")).collect():  # `size` rows at most
        histogram[n] = k
    where = places(plan(histogram, size), size)
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["pid", "length"])
    names = [c for c in cut.columns if c not in ("pid", "rank")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy() + b.column("base").to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                rows, of = where[n], length == n
                k = np.searchsorted(rows[:, 0], rank[of], "right") - 1
                seq[of] = rows[k, 1] + rank[of] - rows[k, 0]
                offset[of] = rows[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = SIZE, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its ids and its place: id, piece, start, length, ids, sequence_id, offset.

    A null or empty text is its end id alone. Null ids and repeated rows are documents like any
    other; other columns are ignored; an empty table gives an empty result.
    """
    return pack(written(pieces(docs, size, path, end_id, id_col, text_col), "pieces"), size)


def packed_digest(docs: DataFrame) -> DataFrame:
    """pack_documents with a checksum in place of the ids."""
    cut = written(pieces(docs), "pieces").withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_digest(table(tune(spark), sf_dir, "documents"))
