"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is contained in a document only if every one of its shingles is, so for full
containment one token per window, its rarest shingle, is a sufficient prefix. Rarity is counted over
all documents. A document's shingles meet the prefixes of all windows in a hash index; a meeting
fixes where the window must start (positional bound) and end (length bound), and the words there
are compared one by one.

The index of up to `block_windows` windows goes to the executors; documents are never shuffled then. A
larger benchmark is joined: documents give their shingles that may be in a window (a bitmap of a
fixed size tells), which are counted; each window takes its rarest as its prefix; then documents
give the places of prefixes with the words around them, which meet the windows by a join on the
prefix and are compared word by word. So the documents are read twice, whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import table, tune, written

WINDOW, SHINGLE, BLOCK_WINDOWS = 10, 4, 500_000
#: Bits of the bitmap of shingles, as a power of 2, and those of one of its rows.
MAP_BITS, ROW_BITS = 26, 15
#: Bytes of words in UTF-8: digits, letters and all bytes of signs beyond ASCII, after lower-casing A-Z.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once; longer texts are cut between words.
_PART = 1 << 20


class Words:
    """A text's words as stretches of its lower-case bytes, with a 64-bit hash of each.

    Hashes are polynomials in the bytes, for all words at once: differences of a running sum, moved
    to the same power by the multiplier's inverse.
    """

    _powers = _inverses = np.zeros(0, np.uint64)

    def __init__(self, text: str | None) -> None:
        self.raw = (text or "").encode("utf-8", "surrogatepass").lower()
        raw = np.frombuffer(self.raw, np.uint8)
        inside = _IN_WORD[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = np.zeros(len(self.starts), np.uint64)
        done = 0
        while done < len(self.starts):
            first = int(self.starts[done])
            stop = max(done + 1, int(np.searchsorted(self.ends, first + _PART, "right")))
            self.hashes[done:stop] = self._hash(raw[first : int(self.ends[stop - 1])], self.starts[done:stop] - first, self.ends[done:stop] - first)
            done = stop

    @classmethod
    def _hash(cls, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(raw)
        if len(cls._powers) < n:
            size = max(n, 2 * len(cls._powers))
            cls._powers = np.cumprod(np.full(size, _MULT))
            cls._inverses = np.cumprod(np.full(size, np.uint64(pow(int(_MULT), -1, 1 << 64))))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * cls._powers[:n], out=total[1:])
        h = (total[ends] - total[starts]) * cls._inverses[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def __len__(self) -> int:
        return len(self.starts)

    def joined(self, first: int, end: int) -> bytes:
        """Words first..end, with a space between."""
        return b" ".join([self.raw[a:b] for a, b in zip(self.starts[first:end].tolist(), self.ends[first:end].tolist(), strict=True)])


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, by first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * _MULT + h[k : n + k]
        out ^= out >> np.uint64(31)
    return out


class _Set:
    """Membership of hashes: a bitmap first, then binary search."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        bits = max(16, int(len(self.values)).bit_length() + 5)
        self.down = np.uint64(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[self.values >> self.down] = True

    def where(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are members, and their numbers in `values`."""
        at = np.flatnonzero(self.map[h >> self.down])
        k = np.searchsorted(self.values, h[at])
        ok = k < len(self.values)
        ok[ok] = self.values[k[ok]] == h[at][ok]
        return at[ok], k[ok]


def windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item string, w binary): each item's distinct windows, words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = Words(text)
                n = min(window, len(words))
                found = list({words.joined(i, i + n) for i in range(len(words) - n + 1)}) if n else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], ["item", "w"])

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "item string, w binary").distinct()


class _Index:
    """Windows by their prefix: the shingle that is rarest over the documents."""

    def __init__(self, rows: list, shingle: int) -> None:
        owners: dict[bytes, list[str]] = {}
        for r in rows:
            owners.setdefault(bytes(r["w"]), []).append(r["item"])
        self.windows = sorted(owners)
        self.owners = [owners[w] for w in self.windows]
        words = [Words(w.decode("utf-8", "surrogatepass")) for w in self.windows]
        self.sizes = [len(w) for w in words]
        self.all = [_shingles(w.hashes, min(shingle, len(w))) for w in words]
        self.widths = sorted({min(shingle, n) for n in self.sizes})

    def every(self) -> np.ndarray:
        return np.concatenate([*self.all, np.zeros(0, np.uint64)])

    def order(self, counts: dict[int, int]) -> None:
        """Choose each window's prefix."""
        at: dict[int, list[tuple[int, int]]] = {}
        for i, hs in enumerate(self.all):
            k = min(range(len(hs)), key=lambda j: (counts.get(int(hs[j]), 0), int(hs[j])))
            at.setdefault(int(hs[k]), []).append((k, i))
        self.prefixes = _Set(np.array(list(at), np.uint64))
        self.at = [at[int(h)] for h in self.prefixes.values]
        del self.all

    def find(self, words: Words) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items these are of."""
        n = len(words)
        edge, items = np.zeros(n + 1, np.int64), set()
        for width in self.widths:
            for p, k in zip(*(x.tolist() for x in self.prefixes.where(_shingles(words.hashes, width))), strict=True):
                for offset, i in self.at[k]:
                    start, end = p - offset, p - offset + self.sizes[i]
                    if start >= 0 and end <= n and words.joined(start, end) == self.windows[i]:
                        edge[start] += 1
                        edge[end] -= 1
                        items.update(self.owners[i])
        return np.cumsum(edge)[:n] > 0, items


def _counts(docs: DataFrame, index: _Index) -> dict[int, int]:
    """How often each shingle of the index occurs over all documents; one row per shingle and task."""
    every, widths = _Set(index.every()), index.widths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(every.values), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                h = Words(text).hashes
                for width in widths:
                    np.add.at(total, every.where(_shingles(h, width))[1], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(every.values[some].view(np.int64)), pa.array(total[some])], ["h", "n"])

    rows = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    return {r["h"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in rows}


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _scan(docs: DataFrame, index: _Index, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, spans, items = [], [], []
            for text in b.column(2).to_pylist():
                words = Words(text)
                hit, found = index.find(words)
                n_words.append(len(words))
                spans.append(_spans(hit))
                items.append(sorted(found))
            cols = [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "uid", "n_words", "spans", "items"])

    return docs.mapInArrow(run, f"id {kind}, uid long, n_words long, spans array<struct<first:long,end:long>>, items array<string>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one document that touch or overlap are one."""
    for b in batches:
        spans = []
        for found in b.column("spans").to_pylist():
            out: list[dict] = []
            for s in sorted(found, key=lambda s: s["first"]):
                if out and s["first"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(dict(s))
            spans.append(out)
        yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(spans, _SPANS)], ["uid", "spans"])


def _bitmap(hashes: DataFrame) -> bytes:
    """Which values the highest MAP_BITS bits of `h` take: MAP_BITS bits, however many hashes there are."""
    place = F.shiftrightunsigned("h", 64 - MAP_BITS) + 1  # Spark's bitmaps count from 1
    rows = hashes.groupBy(F.bitmap_bucket_number(place).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out, size = bytearray(1 << MAP_BITS - 3), 1 << ROW_BITS - 3  # at most 2^(MAP_BITS - ROW_BITS) rows
    for r in rows:
        out[(r["row"] - 1) * size : r["row"] * size] = r["bits"]
    return bytes(out)


def _in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - MAP_BITS)
    return np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)


def _window_parts(shingle: int):
    """Rows (w, wid) -> (wid, at, size, h): the shingles of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for w, wid in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = Words(w.decode("utf-8", "surrogatepass"))
                hs = _shingles(words.hashes, min(shingle, len(words))).view(np.int64).tolist()
                rows += [(wid, k, len(words), h) for k, h in enumerate(hs)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["wid", "at", "size", "h"])

    return run


def _seen(bits: bytes, widths: list[int]):
    """Rows (text) -> (h, n): how often shingles that may be in a window occur, summed over a batch."""
    shared = np.frombuffer(bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text in b.column(0).to_pylist():
                hashes = Words(text).hashes
                for width in widths:
                    h = _shingles(hashes, width)
                    found.append(h[_in_map(shared, h)])
            h, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


def _around(bits: bytes, widths: list[int], window: int):
    """Rows (uid, text) -> (uid, p, h, before, words): places of shingles that may be prefixes, with the
    words of every window that could hold one there, `before` of them ahead of it."""
    shared = np.frombuffer(bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, rows = Words(text), []
                for width in widths:
                    h = _shingles(words.hashes, width)
                    for p in _in_map(shared, h).tolist():
                        first = max(0, p - window + 1)
                        rows.append((uid, p, int(h[p : p + 1].view(np.int64)[0]), p - first, words.joined(first, min(len(words), p + window))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["uid", "p", "h", "before", "words"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings of a document and a window -> (uid, wid, first, end) where all words are equal."""
    for b in batches:
        keep, first, end = [], [], []
        for p, before, words, at, size, w in zip(*(b.column(c).to_pylist() for c in ("p", "before", "words", "at", "size", "w")), strict=True):
            here = words.split(b" ")
            ok = at <= before and here[before - at : before - at + size] == w.split(b" ")
            keep.append(ok)
            if ok:
                first.append(p - at)
                end.append(p - at + size)
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("uid").filter(keep), b.column("wid").filter(keep), pa.array(first, pa.int64()), pa.array(end, pa.int64())], ["uid", "wid", "first", "end"])


def _n_words(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(Words(t)) for t in b.column(2).to_pylist()], pa.int64())], ["id", "uid", "n_words"])

    return run, f"id {kind}, uid long, n_words long"


def _joined(docs: DataFrame, every: DataFrame, window: int, shingle: int, kind: str) -> DataFrame:
    """The findings for a benchmark of any size, by joins. docs: (id, uid, text), every: (item, w)."""
    docs = written(docs, "docs")
    named = written(every.select("w").distinct().withColumn("wid", F.monotonically_increasing_id()), "named")
    parts = written(named.select("w", "wid").mapInArrow(_window_parts(shingle), "wid long, at int, size int, h long"), "parts")
    widths = sorted({min(shingle, r["size"]) for r in parts.select("size").distinct().collect()})  # `window` rows at most
    counts = docs.select("text").mapInArrow(_seen(_bitmap(parts), widths), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rarest = parts.join(counts, "h", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at", "size")).alias("x"))
    prefixes = written(rarest.select("wid", "x.h", "x.at", "x.size").join(named, "wid"), "prefixes")
    places = docs.select("uid", "text").mapInArrow(_around(_bitmap(prefixes), widths, window), "uid long, p long, h long, before int, words binary")
    met = places.join(prefixes, "h").select("uid", "wid", "p", "before", "words", "at", "size", "w")
    hits = written(met.mapInArrow(_compare, "uid long, wid long, first long, end long"), "hits")
    spans = hits.select("uid", F.struct("first", "end").alias("s")).distinct().groupBy("uid").agg(F.collect_list("s").alias("spans")).mapInArrow(_merge, "uid long, spans array<struct<first:long,end:long>>")
    owners = hits.select("uid", "wid").distinct().join(named, "wid").join(every, "w").select("uid", "item").distinct()
    items = owners.groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    run, shape = _n_words(kind)
    rows = docs.select("id", "uid", "text").mapInArrow(run, shape).join(spans, "uid", "left").join(items, "uid", "left")
    return rows.select("id", "uid", "n_words", F.coalesce("spans", F.array().cast("array<struct<first:bigint,end:bigint>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, spans (word positions in occurrences of windows, merged)
    and items (ids as strings, sorted, of the items these are of).

    A null or empty text has no words, spans or items; an item without words has no windows; an item
    whose id is null is named by the empty string; items that share a window are all named. Repeated
    documents stay repeated. Other columns are ignored. Without items nothing is found.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"))
    every = written(windows(items, window, item_col, item_text_col), "windows")
    if every.count() > block_windows:
        out = _joined(docs, every, window, shingle, kind)
    else:
        index = _Index(every.collect(), shingle)  # block_windows rows at most
        index.order(_counts(docs, index))
        out = _scan(docs, index, kind)
    return out.drop("uid").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs (all columns) that hold no window of an item."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return contamination(rows, items, id_col="row").filter(F.size("spans") == 0).select("row.*")


def digested(found: DataFrame) -> DataFrame:
    """Counts and a checksum in place of spans and items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    return digested(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM sized),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
met AS (SELECT DISTINCT doc_id, n, i, item_id FROM doc_windows JOIN item_windows USING (n, k)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(0, n)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
