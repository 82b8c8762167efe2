"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments. If two fingerprints differ in at most `distance`
bits and the segments' radii r satisfy sum(r + 1) > distance, then in some segment they differ in
at most r bits (pigeonhole). So each fingerprint is entered in a table under each segment's value,
and looks up the Hamming ball of that radius around its own value; what is fetched is verified over
all 64 bits. Of each pair only one side needs to look: the one whose lowest differing bit is 0, which
halves the balls. Equal fingerprints are one entry from the start.

Large buckets: a bucket of over `block` rows is cut into blocks by a hash; every pair of blocks is a
unit of its own, so that no task holds a whole bucket. Within a unit, links are found by
breadth-first search over packed words, and a spanning forest goes out rather than all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import n_partitions, table, tune, written
from quarry.llm.components import connected_components

#: (lowest bit, bits, radius) by the number of distinct fingerprints: keys about as long as its
#: logarithm keep buckets short. Any plan finds every pair; only the work differs.
PLANS = ((1 << 27, ((0, 21, 1), (21, 21, 1), (42, 22, 0))), (None, ((0, 32, 2), (32, 32, 1))))
DISTANCE, WORDS, SEED, BLOCK = 4, 4, 42, 4096
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of word shingles, unsigned. A text of fewer words is one shingle; none gives 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1]
    ends = ends[words - 1 :]
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        h = np.array([digest(joined[s:e], seed) for s, e in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp long) for every row; the text itself is read once and goes nowhere."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, words) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, fp long")
    return got.withColumnRenamed("id", id_col)


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]


def _rows(fps: DataFrame, plan) -> DataFrame:
    """(seg, key, fp): each fingerprint under its own values and, looking up, under half their balls."""
    parts = []
    for seg, (low, bits, radius) in enumerate(plan):
        key = f"(shiftrightunsigned(fp, {low}) & {(1 << bits) - 1}L)"
        masks = ", ".join(f"{m}L" for m in _masks(bits, radius))
        keys = f"array({key})"
        if masks:
            keys = f"concat({keys}, transform(filter(array({masks}), m -> ({key} & (m & (-m))) = 0L), m -> {key} ^ m))"
        parts.append(f"transform({keys}, (k, i) -> struct({seg} AS seg, k AS key, i = 0 AS own))")
    return fps.select("fp", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("x")).select("x.seg", "x.key", "x.own", "fp")


class Forest:
    """Union-find over fingerprints; add() tells whether an edge joins two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _search(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one large unit."""
    left, out = np.unique(values), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            f = front.pop()
            hit = np.bitwise_count(left ^ f) <= distance
            if hit.any():
                new = left[hit]
                out += [(int(f), int(x)) for x in new]
                front += list(new)
                left = left[~hit]
    return out


def _linker(distance: int, small: int = 1 << 12, at_once: int = 1 << 21):
    """Rows sorted by unit -> edges (a, b). Small units of a batch are expanded together."""

    def pairs(unit: np.ndarray, own: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        size = np.diff(np.append(first, len(unit)))
        owns = np.add.reduceat(own.astype(np.int64), first)
        use = (owns > 0) & (size > 1)
        large = use & (owns * size > small)
        for s, n in zip(first[large].tolist(), size[large].tolist(), strict=True):
            if found := _search(fp[s : s + n], distance):
                a, b = np.array(found, np.uint64).T
                yield a, b
        many = use & ~large
        group = np.repeat(np.arange(len(first)), size)
        look = np.flatnonzero(own & many[group])  # every own row meets every row of its unit
        reach = size[group[look]]
        for part in np.array_split(np.arange(len(look)), max(1, int(reach.sum()) // at_once + 1)):
            if not len(part):
                continue
            r = reach[part]
            left = np.repeat(look[part], r)
            right = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r) + np.repeat(first[group[look[part]]], r)
            a, b = fp[left], fp[right]
            ok = (np.bitwise_count(a ^ b) <= distance) & (a != b)
            yield a[ok], b[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[tuple[np.ndarray, ...]] = []

        def flush(rows) -> Iterator[pa.RecordBatch]:
            if not len(rows[0]):
                return
            for a, b in pairs(*rows):
                kept = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.add(x, y)]
                if kept:
                    cols = np.array(kept, np.uint64).view(np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

        for batch in batches:
            unit, own, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append((unit, own.astype(bool), fp.view(np.uint64)))
            if sum(len(x[0]) for x in held) < 1 << 16:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
            yield from flush([c[:cut] for c in rows])
            held = [tuple(c[cut:] for c in rows)]
        if held:
            yield from flush([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def links(fps: DataFrame, distance: int = DISTANCE, plan=None, block: int = BLOCK) -> DataFrame:
    """fps: distinct values in column fp. Edges (a, b) at `distance` bits or fewer that connect
    exactly what all such pairs connect."""
    if plan is None:
        n = fps.count()
        plan = next(p for most, p in PLANS if most is None or n <= most)
    if sum(r + 1 for _, _, r in plan) <= distance:
        raise ValueError("these radii would miss pairs")
    rows = _rows(fps, plan)
    hot = rows.groupBy("seg", "key").count().filter(F.col("count") > block)
    hot = written(hot.select("seg", "key", F.ceil(F.col("count") / block).cast("int").alias("nb")), "hot")
    rows = rows.join(hot, ["seg", "key"], "left")
    me = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    split = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(me, j).alias("i"), F.greatest(me, j).alias("j")))
    rows = rows.withColumn("p", F.explode(F.when(F.col("nb").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(split)))
    rows = rows.select(F.xxhash64("seg", "key", "p.i", "p.j").alias("unit"), "own", "fp")
    rows = rows.repartition(n_partitions(fps.sparkSession), "unit").sortWithinPartitions("unit")
    return rows.mapInArrow(_linker(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id that
    links reach, itself included).

    A null or blank text has fingerprint 0 and links like any other. Repeated rows stay repeated;
    a null id takes part and is nobody's component_id unless no other id is there. Other columns
    are ignored whatever their names. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, words), "fingerprints").withColumnRenamed(id_col, "__id")
    nodes = written(fps.groupBy("fp").agg(F.min("__id").alias("least")), "nodes")
    parts = connected_components(links(nodes.select("fp"), distance, block=block), "a", "b").withColumnRenamed("node", "fp")
    joined = nodes.join(parts, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = parts.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component"))
    named = joined.join(whole, "root", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(named, "fp").select(F.col("__id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(tune(spark), sf_dir, "documents"))
