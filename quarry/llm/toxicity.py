"""Toxicity by multiple-instance learning.

Labels belong to documents, the cause to sentences; one of over SPAN words counts as several. A sentence's score is a logistic function of
the weights of its words (the word and its beginnings, hashed), a document's is the noisy-or of its
sentences: 1 - prod(1 - p). Both are trained together from document labels, after which sentence
scores tell where the offence is.

The fit runs on a bounded sample (MOST_OF_CLASS whole documents of each class, fewer if they are of over
MOST_CHARS characters together, in the order of a hash of their ids); scoring covers whole texts. Weights are a fixed
number of hash buckets, whatever the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import fold, table, tune, written

BUCKETS, BEGINNINGS = 1 << 18, (4, 5, 6)
MOST_OF_CLASS, MOST_CHARS = {1: 2500, 0: 5000}, 25_000_000
FOLDS = 5
SPAN = 40
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 150_000


def features(word: str) -> list[int]:
    """Hash buckets of a lower-case word."""
    parts = [f"w{word}", *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def sentences(text: str) -> Iterator[list[str]]:
    """Lower-case words of each sentence that has any, at most SPAN words in a row."""
    low = text.lower()
    if len(low) == len(text):  # then each character became one
        found = map(_WORD.findall, _SENTENCE.findall(low))
    else:
        found = ([w.lower() for w in _WORD.findall(s)] for s in _SENTENCE.findall(text))
    for words in found:
        for k in range(0, len(words), SPAN):
            yield words[k : k + SPAN]


def places(text: str) -> Iterator[tuple[int, int]]:
    """(first, end) character positions of what `sentences` gives: the sentence, or its words."""
    for m in _SENTENCE.finditer(text):
        words = list(_WORD.finditer(m[0]))
        for k in range(0, len(words), SPAN):
            first = words[k].start() if k else 0
            yield m.start() + first, m.start() + words[k + SPAN - 1].end() if k + SPAN < len(words) else m.end()


def instances(text: str | None) -> list[list[str]]:
    """Distinct words of each sentence."""
    return [list(dict.fromkeys(words)) for words in sentences(text or "")]


class _Features(dict):
    def __missing__(self, word: str) -> list[int]:
        self[word] = f = features(word)
        return f


def gradient(w: np.ndarray, bias: float, x: np.ndarray, sent: np.ndarray, doc: np.ndarray, y: np.ndarray, weights: tuple[float, float]) -> tuple[float, np.ndarray, float]:
    """Loss of the noisy-or of documents' sentences and its derivatives by w and the bias. x: buckets of
    words, sent: the sentence of each, doc: the document of each sentence, y: labels of documents."""
    z = np.bincount(sent, w[x], len(doc)) + bias
    soft = np.logaddexp(0, z)
    clean = np.bincount(doc, soft, len(y))  # exp of minus this: no sentence offends
    none = np.exp(-clean)
    some = np.maximum(1 - none, 1e-6)
    loss = float(np.where(y > 0, -weights[1] * np.log(some), weights[0] * clean).sum())
    factor = np.where(y > 0, -weights[1] * none / some, weights[0])
    dz = np.exp(z - soft) * factor[doc]
    return loss, np.bincount(x, dz[sent], len(w)), float(dz.sum())


def fit(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), epochs: int = 28, rate: float = 0.6, l2: float = 1e-4, least: float = 0.3, pace: float = 0.1, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of the hash buckets and the bias. weights: of a document of class 0 and of class 1.
    pace: the rate of the bias. Without labels of both kinds nothing offends. Weights under `least` are dropped: in a long text they add up to noise."""
    if not 0 < sum(labels) < len(labels):
        return np.zeros(BUCKETS, np.float32), -np.inf
    known, ids, words_of, sents_of = _Features(), [], [], []
    for text in texts:
        sents = [[x for w in words for x in known[w]] for words in instances(text)]
        ids.append(np.array([x for s in sents for x in s], np.int32))
        words_of.append(np.array([len(s) for s in sents], np.int32))
        sents_of.append(len(sents))
    y = np.array(labels, np.float64)
    w, bias = np.zeros(BUCKETS), -6.0
    g2, b2, rng = np.full(BUCKETS, 1e-8), 1e-8, np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            if not len(part):
                continue
            x = np.concatenate([ids[i] for i in part])
            sent = np.repeat(np.arange(sum(sents_of[i] for i in part)), np.concatenate([words_of[i] for i in part]))
            doc = np.repeat(np.arange(len(part)), [sents_of[i] for i in part])
            _, gw, gb = gradient(w, bias, x, sent, doc, y[part], weights)
            gw += l2 * len(part) * w
            g2 += gw * gw
            b2 += gb * gb
            w -= rate * gw / np.sqrt(g2)
            bias = min(-3.0, bias - pace * gb / np.sqrt(b2))
    return np.where(np.abs(w) < least, 0, w).astype(np.float32), float(bias)


class Scorer:
    """Scores whole texts; remembers the weight of each distinct word."""

    def __init__(self, w: np.ndarray, bias: float) -> None:
        self.w, self.bias, self.known = w, bias, {}

    def _weight(self, word: str) -> float:
        if (v := self.known.get(word)) is None:
            if len(self.known) > _MEMO:
                self.known.clear()
            v = self.known[word] = float(self.w[features(word)].sum())
        return v

    def logits(self, text: str | None) -> np.ndarray:
        """Of the sentences that have words."""
        get = self._weight
        return np.array([sum(map(get, words)) for words in instances(text)], np.float64) + self.bias

    def judge(self, text: str | None, least: float = 0.5) -> tuple[float, list[dict]]:
        """The score, and the sentences (character positions in the text) that offend with probability
        `least` or more."""
        z = self.logits(text)
        score, hit = float(-np.expm1(-np.logaddexp(0, z).sum())), z >= (np.log(least / (1 - least)) if least else -np.inf)
        if not hit.any():
            return score, []
        p = np.exp(-np.logaddexp(0, -z))
        return score, [{"first": x, "end": y, "p": float(p[k])} for k, (x, y) in enumerate(places(text)) if hit[k]]

    def score(self, text: str | None) -> float:
        return self.judge(text)[0]

    def locate(self, text: str | None, least: float = 0.5) -> list[dict]:
        return self.judge(text, least)[1]


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int], tuple[float, float]]:
    """The rows to fit on, by a hash of their ids, none of the held-out fold; weights that restore
    the classes' shares. Only ids, labels and lengths of the documents that have a letter are sorted out in
    full; the whole texts of the chosen few (of MOST_CHARS in a class, or a single one of more) join a table of
    a proven size (the sum of MOST_OF_CLASS)."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(fold(F.col("doc_id"), FOLDS) != 0)
    texts = docs.select("doc_id", "text").filter(F.col("text").rlike(r"\p{L}"))
    known = written(known.join(texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("chars")), "doc_id"), "known")
    there = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in MOST_OF_CLASS.items()]
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # over these few
    chosen = picked[0].unionByName(picked[1]).withColumn("before", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    chosen = chosen.filter(F.col("before") < MOST_CHARS).select("doc_id", "toxic")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    used = {y: sum(r["toxic"] == y for r in rows) for y in MOST_OF_CLASS}
    share = {y: there.get(y, 0) / n if n else 1.0 for y, n in used.items()}
    least = min(share.values())
    return [r["text"] for r in rows], [int(r["toxic"]) for r in rows], (share[0] / least, share[1] / least)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (of any type, even a struct of a whole row), score, predicted and spans, the sentences that
    offend. A null or empty text has no sentences and scores 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, score double, spans array<struct<first:int,end:int,p:double>>"
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            found = [scorer.judge(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], span_type)], ["id", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, shape).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted and spans, the sentences that offend with
    a probability of a half or more, as character positions and that probability.

    Labels of the held-out fold are never read. A null or empty text scores 0. Without usable labels
    of both kinds every text scores 0. Labels that contradict each other count as toxic. A null id is held
    out or not as the empty text is. Repeated rows stay repeated; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = scored(docs, fit(*sample(docs, labels))).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == 0)
    return found.select(F.col("doc_id").alias(id_col), "held_out", "score", "predicted", "spans")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (all columns) that are not predicted toxic."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return scored(rows, fit(*sample(docs, labels)), "row").filter("predicted = 0").select("row.*")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
