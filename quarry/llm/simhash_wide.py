"""Near copies of a Jaccard similarity or more, found by SimHash and multi-index hashing.

This is the wide form of op 1's method, for similarities at which 64 bits tell too little: a SimHash
of BITS bits over the distinct shingles of a text, cut into segments. Each segment's table holds
every fingerprint; the Hamming ball of radius 1 around a segment's value is fetched, and what comes
is verified over all bits. The number of segments follows from RECALL, the chance that a pair at the
least similarity (MISS of its bits differ) meets in some ball; it is the same whatever the number
of texts, only the length of the segments grows with it, which keeps the balls' tables short.

A ball of radius 1 lies within the union of two sets: values that agree on the first half of the
segment, and those that agree on the second. So each fingerprint goes to two units for each
segment, and a unit enumerates the balls around its own members against its own table; no list of
neighbours is ever shuffled. Units of over BLOCK rows are cut into pairs of blocks.

Links by distance form groups (connected components), in which the texts themselves decide: pairs
are compared by their shingles, the nearest first, unless links found before connect them already.
Groups of over GROUP texts or SHINGLES shingles are cut into pairs of blocks, too. No task emits more links than it has
texts.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import n_partitions, remove, written, written_path
from quarry.llm.components import connected_components
from quarry.llm.simhash import Forest

WORDS, LEAST, SEED = 5, 0.8, 42
#: Bits of a fingerprint; the share of them in which texts of similarity LEAST differ (a little over
#: what is measured); the chance to find such a pair; the greatest share at which texts are compared.
BITS, MISS, RECALL, APART = 512, 0.15, 0.99, 0.18
BLOCK, GROUP, SHINGLES = 1 << 16, 4096, 1 << 20
#: Pairs looked at together, and shingles hashed together.
_PAIRS, _CHUNK = 1 << 20, 1 << 11
_MIX = [np.uint64(k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF) for k in range(BITS // 64)]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a text's runs of words, sorted. A text of fewer words is one shingle."""
    tokens = [t.encode("utf-8", "surrogatepass") for t in (text or "").lower().split()]
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(tokens) - words + 1)]
    ends = ends[min(words, len(tokens)) - 1 :]
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def fingerprint(found: np.ndarray) -> bytes:
    """SimHash of a set of shingles, BITS bits: one where over half of the hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(found), _CHUNK):
        h = np.stack([found[at : at + _CHUNK] ^ k for k in _MIX], axis=1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of so many bits fit a byte
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(found), bitorder="little").tobytes()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(x) for x in b.column(1).to_pylist()]
        names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        cols = [b.column(0), pa.array(names, pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array(map(fingerprint, sets), pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["row", "digest", "n", "fp"])


def segments(texts: int, recall: float = RECALL, miss: float = MISS) -> list[np.ndarray]:
    """The places of the segments' bits: some 16 texts share a segment's value by chance, and a pair of
    which a share of `miss` bits differs meets in some ball of radius 1 with a chance of `recall`.
    Once all bits are used, further segments take them in another order."""
    bits = max(14, 2 * math.ceil((math.log2(max(texts, 2)) - 4) / 2))
    meet = (1 - miss) ** bits + bits * miss * (1 - miss) ** (bits - 1)
    many, at_once = math.ceil(math.log(1 - recall) / math.log(1 - meet)), BITS // bits
    rng = np.random.default_rng(SEED)
    orders = [np.arange(BITS), *(rng.permutation(BITS) for _ in range(many // at_once))]
    return [orders[k // at_once][k % at_once * bits :][:bits] for k in range(many)]


def apart(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most bits in which sets of n and m shingles may differ and be compared. In small sets ties
    between ones and zeros add differences."""
    return np.floor(BITS * (APART + 0.1 / np.sqrt(np.maximum(1, np.minimum(n, m)))))


def _keys(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values of some bits, one for each row."""
    return bits[:, places] @ (np.int64(1) << np.arange(len(places), dtype=np.int64))


def _halves(cut: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(number, bits) of the units' halves of segments; a number's other half is the number ^ 1."""
    return [(2 * seg + half, np.array_split(places, 2)[half]) for seg, places in enumerate(cut) for half in (0, 1)]


def _units(cut: list[np.ndarray]):
    """Rows (node, n, fp) -> (unit, node, n, fp): two units for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = _bits(_wide(b.column(2)))
            for number, places in _halves(cut):
                unit = (np.int64(number) << np.int64(40)) | _keys(bits, places)
                yield pa.RecordBatch.from_arrays([pa.array(unit), b.column(0), b.column(1), b.column(2)], ["unit", "node", "n", "fp"])

    return run


def _unit_sizes(cut: list[np.ndarray]):
    """Rows (fp) -> (unit, many), one row for each unit and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: Counter[int] = Counter()
        for b in batches:
            bits = _bits(_wide(b.column(0)))
            for number, places in _halves(cut):
                units, many = np.unique((np.int64(number) << np.int64(40)) | _keys(bits, places), return_counts=True)
                for u, k in zip(units.tolist(), many.tolist(), strict=True):
                    sizes[u] += k
        yield pa.RecordBatch.from_arrays([pa.array(sizes.keys(), pa.int64()), pa.array(sizes.values(), pa.int64())], ["unit", "many"])

    return run


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")


def _wide(column: pa.Array) -> np.ndarray:
    """A column of fingerprints as (rows, words)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _close(fp: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs (a, b) of rows are to be compared: near enough, and of like numbers of shingles."""
    out = np.zeros(len(a), bool)
    # 64 bits first, at four deviations, then all
    maybe = np.flatnonzero((np.bitwise_count(fp[a, 0] ^ fp[b, 0]) <= 24) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b])))
    for k in range(0, len(maybe), _PAIRS // 8):
        some = maybe[k : k + _PAIRS // 8]
        x, y = a[some], b[some]
        d = np.bitwise_count(fp[x] ^ fp[y]).sum(1, dtype=np.int64)
        out[some] = d <= apart(n[x], n[y])
    return out


def _ball_pairs(key: np.ndarray, bits: int, at_once: int = _PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose keys differ in one of the lowest `bits` bits or in none. Rows are sorted by key."""
    values, first, count = np.unique(key, return_index=True, return_counts=True)
    of = np.repeat(np.arange(len(values)), count)
    for flip in [0, *(1 << k for k in range(bits))]:
        if flip:
            look = np.flatnonzero(key & flip == 0)  # half of the ball: the other side has the bit
            hit = np.searchsorted(values, key[look] | flip)
            ok = hit < len(values)
            ok[ok] = values[hit[ok]] == key[look[ok]] | flip
            look, hit = look[ok], hit[ok]
            start, many = first[hit], count[hit]
        else:
            look = np.arange(len(key))
            start = look + 1
            many = first[of] + count[of] - start
            look, start, many = look[many > 0], start[many > 0], many[many > 0]
        done = np.cumsum(many)
        k = 0
        while k < len(look):
            stop = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + at_once, "right")))
            r = many[k:stop]
            yield np.repeat(look[k:stop], r), np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r) + np.repeat(start[k:stop], r)
            k = stop


def _search(fp: np.ndarray, n: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links in a large unit, breadth first: whole balls of the full distance
    are taken from what is left, so that near copies cost one step for many of them."""
    left = np.arange(len(n))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            f = front.pop()
            hit = _close(fp, n, np.full(len(left), f), left, least)
            if hit.any():
                new = left[hit]
                yield np.full(len(new), f), new
                front += new.tolist()
                left = left[~hit]


def _linker(cut: list[np.ndarray], least: float, large: int = 1 << 24):
    """Rows (unit, place, node, n, fp) sorted by unit -> (a, b), a forest of the links of each task."""

    halves = dict(_halves(cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows_held, enough = 0, 1 << 15

        def flush(unit, place, node, n, fp) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1], [True])))
            forest, out = Forest(), []
            for s, e in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                if e - s < 2:
                    continue
                f, k, other = fp[s:e], n[s:e], halves[int(place[s]) ^ 1]
                key = _keys(_bits(f), other)
                order = np.argsort(key, kind="stable")
                f, k, key, who = f[order], k[order], key[order], node[s:e][order]
                many = np.unique(key, return_counts=True)[1]
                pairs = _search(f, k, least) if int((many * many).sum()) > large else ((a[ok], b[ok]) for a, b in _ball_pairs(key, len(other)) if (ok := _close(f, k, a, b, least)).any())
                for a, b in pairs:
                    out += [(x, y) for x, y in zip(who[a].tolist(), who[b].tolist(), strict=True) if x != y and forest.add(x, y)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held.append((*cols, _wide(b.column(4))))
            rows_held += len(b)
            if rows_held < enough:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
            if end:
                yield from flush(*(c[:end] for c in rows))
            held = [tuple(c[end:] for c in rows)]
            rows_held = len(held[0][0])
            enough = max(1 << 15, 2 * rows_held)
        if rows_held:
            yield from flush(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def blocks(rows: DataFrame, key: str, sizes: DataFrame, name: Column) -> DataFrame:
    """Adds `pair` to rows (repeating them): 0 in groups by `key` that are not in sizes (key, nb); one there
    is cut into nb parts by a hash of `name`, and each pair of its parts has a number of its own."""
    hot = written(sizes, "hot")
    me = F.pmod(F.xxhash64(name), F.col("nb"))
    split = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1), lambda j: F.least(me, j) * F.col("nb") + F.greatest(me, j))
    return rows.join(hot, key, "left").withColumn("pair", F.explode(F.when(F.col("nb").isNull(), F.array(F.lit(0).cast("long"))).otherwise(split))).drop("nb")


def links(nodes: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """nodes (node, n, fp): (a, b) that connect what the links by distance connect."""
    cut = segments(nodes.count())
    sizes = nodes.select("fp").mapInArrow(_unit_sizes(cut), "unit long, many long").groupBy("unit").agg(F.ceil(F.sum("many") / block).cast("long").alias("nb")).filter("nb > 1")
    rows = nodes.select("node", "n", "fp").mapInArrow(_units(cut), "unit long, node long, n int, fp binary")
    rows = blocks(rows, "unit", sizes, F.col("node")).withColumn("place", F.shiftright("unit", 40).cast("int"))
    rows = rows.select(F.xxhash64("unit", "pair").alias("unit"), "place", "node", "n", "fp")
    rows = rows.repartition(n_partitions(nodes.sparkSession), "unit").sortWithinPartitions("unit", "place")
    return rows.mapInArrow(_linker(cut, least), "a long, b long")


def _verifier(least: float):
    """Rows (unit, node, n, fp, text) sorted by unit -> (a, b): what pairs of texts of `least` or more connect."""

    def pairs(node: list[int], n: np.ndarray, fp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        found: list[tuple[np.ndarray, ...]] = []
        for i in range(len(node) - 1):
            b = np.arange(i + 1, len(node))
            b = b[_close(fp, n, np.full(len(b), i), b, least)]
            found.append((np.bitwise_count(fp[i] ^ fp[b]).sum(1, dtype=np.int64), np.full(len(b), i), b))
        if not found:
            return []
        d, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        order, forest, out = np.argsort(d, kind="stable"), Forest(), []
        for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
            if forest.root(i) != forest.root(j) and similarity(sets[i], sets[j]) >= least:
                forest.add(i, j)
                out.append((node[i], node[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, node, n, fp, sets = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(node) > 1 and (out := pairs(node, np.array(n), np.frombuffer(b"".join(fp), np.uint64).reshape(len(fp), -1), sets)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

        for b in batches:
            for u, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if u != unit:
                    yield from done()
                    unit, node, n, fp, sets = u, [], [], [], []
                node.append(row[0])
                n.append(row[1])
                fp.append(row[2])
                sets.append(shingles(row[3]))
        yield from done()

    return run


def verified(candidates: DataFrame, nodes: DataFrame, texts: DataFrame, least: float = LEAST, group: int = GROUP, most: int = SHINGLES) -> DataFrame:
    """candidates (a, b), nodes (node, n, fp), texts (node, text): (a, b) that connect what pairs of
    similarity `least` or more connect, of texts that the candidates connect. Only their texts move."""
    groups = connected_components(candidates, "a", "b")
    groups = written(groups.join(nodes, "node"), "groups")
    sizes = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum("n") / most)).cast("long").alias("nb")).filter("nb > 1")
    units = blocks(groups, "root", sizes, F.col("node")).select("node", F.xxhash64("root", "pair").alias("unit"), "n", "fp")
    rows = texts.join(groups.select("node"), "node", "left_semi").join(units, "node").select("unit", "node", "n", "fp", "text")
    rows = rows.repartition(n_partitions(texts.sparkSession), "unit").sortWithinPartitions("unit")
    return rows.mapInArrow(_verifier(least), "a long, b long")


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of docs (all columns) for each component of texts of similarity `least` or more by runs of
    WORDS words: that of the smallest doc_id (null last), of equal ids the first in reading order.

    Null, empty and blank texts are alike. Rows are numbered once, in a written copy, so that docs may
    be any DataFrame with any other columns. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    numbered = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")), "numbered")
    row = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), F.col("place"))
    rows = numbered.select(row.alias("row"), F.col("row.text").alias("text"))
    entries, at = written_path(rows.mapInArrow(_entries, f"row {rows.schema['row'].dataType.simpleString()}, digest binary, n int, fp binary"), "entries")
    # texts of equal shingles are one node, named by the place of its first row
    nodes = written(entries.groupBy("digest").agg(F.min("row").alias("least")).select("least", F.col("least.place").alias("node")), "nodes")
    own = F.col("row.place").alias("node")
    several = written(entries.select(own, "n", "fp").filter("n > 0").join(nodes.select("node"), "node", "left_semi"), "several")
    found = written(links(several, least), "links")
    texts = numbered.select(F.col("place").alias("node"), F.col("row.text").alias("text"))
    parts = connected_components(verified(found, several, texts, least), "a", "b")
    named = nodes.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = named.groupBy("root").agg(F.min("least").alias("kept")).select(F.col("kept.place").alias("place"))
    places = entries.select(F.col("row.place").alias("place"))
    gone = written(places.join(kept, "place", "left_anti"), "gone")  # far fewer than are kept, as a rule
    remove(spark, at)
    return numbered.join(gone, "place", "left_anti").select("row.*")
