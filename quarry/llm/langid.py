"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes, white space, digits and signs included, in both directions and
gives every position log-probabilities of the languages. A document's are the sum over all its
positions, tempered because neighbouring positions say much the same. Whole texts are read, in
windows of CORE positions that are scored, with MARGIN more on either side for the states to settle;
beyond a text's ends stand zero bytes. Windows of many texts run side by side.

Training is backpropagation through time in numpy, on a sample bounded for each language
(about DOCS_OF_LANG documents, TRAIN_CHARS characters of each); every position of a document is
labelled with its language.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fold, table, tune

FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
DOCS_OF_LANG, TRAIN_CHARS, MOST_LANGS = 300, 2_000, 500
EMBED, HIDDEN, CORE, MARGIN, TEMPER = 12, 16, 96, 16, 40.0
#: Windows that run side by side, fewer where there are many classes; length of a window in training.
AT_ONCE, TRAIN_WINDOW = 2048, 64
#: First and last small letters of alphabets, for words of no language.
SCRIPTS = ((0x61, 0x7A), (0xDF, 0x17F), (0x3B1, 0x3C9), (0x430, 0x45F), (0x561, 0x586), (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0xE01, 0xE30), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters and passes. Batches for training are (time, batch)."""

    def __init__(self, classes: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": make(256, EMBED) * 4, "V": make(2 * HIDDEN, classes), "c": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": make(EMBED, 3 * HIDDEN), f"U{d}": make(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States after each step, in time's own order."""
        p, n, H = self.p, x.shape, HIDDEN
        gates = (p["E"] @ p[f"W{d}"] + p[f"b{d}"])[x]
        h, out = np.zeros((n[1], H), gates.dtype), np.zeros((*n, H), gates.dtype)
        for t in range(n[0]) if d == "f" else range(n[0] - 1, -1, -1):
            a, u = gates[t], h @ p[f"U{d}"]
            zr = _sigmoid(a[:, : 2 * H] + u[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(a[:, 2 * H :] + r * u[:, 2 * H :])
            if keep is not None:
                keep.append((t, h, z, r, c, u[:, 2 * H :]))
            h = out[t] = c + z * (h - c)
        return out

    def log_probs(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, batch, classes)."""
        both = np.concatenate([self._run(x, d, None if keep is None else keep.setdefault(d, [])) for d in "fb"], axis=2)
        logits = both @ self.p["V"] + self.p["c"]
        logits -= logits.max(2, keepdims=True)
        if keep is not None:
            keep["h"] = both
        return logits - np.log(np.exp(logits).sum(2, keepdims=True))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions where the mask is 1, and its gradient by
        backpropagation through time."""
        p, H, keep = self.p, HIDDEN, {}
        lp = self.log_probs(x, keep)
        total = mask.sum()
        d = np.exp(lp)
        d[:, np.arange(len(y)), y] -= 1
        d *= (mask / total)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["V"], g["c"] = np.tensordot(keep["h"], d, ((0, 1), (0, 1))), d.sum((0, 1))
        dh_all = d @ p["V"].T
        for k, way in enumerate("fb"):
            U, dh, da_all = p[f"U{way}"], np.zeros((len(y), H), np.float32), np.zeros((*x.shape, 3 * H), np.float32)
            for t, h, z, r, c, uc in reversed(keep[way]):
                dn = dh + dh_all[t, :, k * H : k * H + H]
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], 1)
                da_all[t] = np.concatenate([dz, dr, dc], 1)
                g[f"U{way}"] += h.T @ du
                dh = dn * z + du @ U.T
            by_byte = np.zeros((256, 3 * H), np.float32)
            flat, rows = x.reshape(-1), da_all.reshape(-1, 3 * H)
            order = np.argsort(flat, kind="stable")
            there, first = np.unique(flat[order], return_index=True)
            by_byte[there] = np.add.reduceat(rows[order], first)
            g[f"b{way}"] = by_byte.sum(0)
            g[f"W{way}"] = p["E"].T @ by_byte
            g["E"] += by_byte @ p[f"W{way}"].T
        loss = -float((lp[:, np.arange(len(y)), y] * mask).sum() / total)
        return loss, g


def train(pools: list[np.ndarray], steps: int = 800, size: int = 96, rate: float = 0.012, seed: int = 11) -> Network:
    """pools: for each language (of equal weight) the bytes of its texts, zero bytes around each. Adam
    with a falling rate, over windows that hold a byte of a text."""
    rng, net = np.random.default_rng(seed), Network(len(pools))
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in "mv")
    span = np.arange(TRAIN_WINDOW)[:, None]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(pools), size)
        x = np.concatenate([pools[c][rng.integers(0, len(pools[c]) - TRAIN_WINDOW + 1) + span] for c in y], axis=1)
        mask = (x != 0).astype(np.float32)
        _, g = net.gradients(x, mask, y)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        at = rate * (1 - step / (steps + 1)) * min(1.0, 2.0 / (norm + 1e-9))
        for k, a in g.items():
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            net.p[k] -= (at * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def pool(texts: list[str]) -> np.ndarray:
    """Bytes of texts with zero bytes around each, one window long at least."""
    gap = bytes(MARGIN)
    raw = gap + gap.join(t.encode("utf-8", "surrogatepass") for t in texts) + gap
    return np.frombuffer(raw.ljust(TRAIN_WINDOW, b"\0"), np.uint8)


class Labeller:
    """Probabilities of positions and documents. Arrays have features first, so that every operation
    runs over many windows in a row."""

    def __init__(self, net: Network | None, langs: list[str]) -> None:
        self.langs = langs
        if net is None:
            return
        H, p = HIDDEN, net.p
        halved = np.repeat(np.array([0.5, 1.0], np.float32), [2 * H, H])  # sigmoid(x) = (tanh(x / 2) + 1) / 2
        self.gates = {d: np.ascontiguousarray(((p["E"] @ p[f"W{d}"] + p[f"b{d}"]) * halved).T) for d in "fb"}
        self.U = {d: np.ascontiguousarray((p[f"U{d}"] * halved).T) for d in "fb"}
        self.V = {d: np.ascontiguousarray(p["V"][k * H : k * H + H].T) for k, d in enumerate("fb")}
        self.c = p["c"][:, None]
        self.at_once = max(64, AT_ONCE * 8 // max(8, len(langs)))

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """x: (time, windows) -> states of the CORE positions, (CORE, HIDDEN, windows)."""
        H, n, gates, U = HIDDEN, x.shape[1], self.gates[d], self.U[d]
        h, out = np.zeros((H, n), np.float32), np.empty((CORE, H, n), np.float32)
        a, u, c = np.empty((3 * H, n), np.float32), np.empty((3 * H, n), np.float32), np.empty((H, n), np.float32)
        for t in range(MARGIN + CORE) if d == "f" else range(2 * MARGIN + CORE - 1, MARGIN - 1, -1):
            np.take(gates, x[t], axis=1, out=a, mode="clip")
            np.matmul(U, h, out=u)
            zr = a[: 2 * H]
            zr += u[: 2 * H]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(zr[H:], u[2 * H :], out=c)
            c += a[2 * H :]
            np.tanh(c, out=c)
            h = h - c
            h *= zr[:H]
            h += c
            if MARGIN <= t < MARGIN + CORE:
                out[t - MARGIN] = h
        return out

    def _log_probs(self, x: np.ndarray) -> np.ndarray:
        """(CORE, classes, windows)."""
        logits = np.matmul(self.V["f"], self._states(x, "f"))
        logits += np.matmul(self.V["b"], self._states(x, "b"))
        logits += self.c
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        return logits

    def _windows(self, raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, number of the text, positions of it in the core) of windows, some at a time."""
        size = np.array([len(r) for r in raws])
        gap, room = bytes(MARGIN), bytes(2 * MARGIN + CORE)
        every = np.frombuffer(gap + gap.join(raws) + room, np.uint8)
        first = np.cumsum(size + MARGIN) - size - MARGIN  # of the margin before each text
        count = -(-size // CORE)
        of = np.repeat(np.arange(len(raws)), count)
        at = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * CORE
        left = size[of] - at
        span = np.arange(2 * MARGIN + CORE)[:, None]
        for k in range(0, len(of), self.at_once):
            some, n = of[k : k + self.at_once], left[k : k + self.at_once]
            x = every[span + (first[some] + at[k : k + self.at_once])]
            if (n < CORE + MARGIN).any():  # what follows a text is not of it
                x[span >= n + MARGIN] = 0
            yield x, some, np.minimum(n, CORE)

    def positions(self, text: str) -> np.ndarray:
        """Log-probabilities at every byte of a text, (bytes, classes)."""
        raw = text.encode("utf-8", "surrogatepass")
        out = []
        for x, _, n in self._windows([raw]) if raw else ():
            lp = self._log_probs(x)
            out += [lp[:k, :, i] for i, k in enumerate(n.tolist())]
        return np.concatenate([np.zeros((0, len(self.langs)), np.float32), *out])

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its probability for each text."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        use = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        if not use:
            return out
        total = np.zeros((len(self.langs), len(use)))
        for x, of, n in self._windows([texts[i].encode("utf-8", "surrogatepass") for i in use]):
            lp = self._log_probs(x)
            if (n < CORE).any():
                lp *= (np.arange(CORE)[:, None] < n)[:, None, :]
            for c, row in enumerate(lp.sum(0)):
                total[c] += np.bincount(of, row, len(use))
        total /= TEMPER
        p = np.exp(total - total.max(0))
        p /= p.sum(0)
        for i, k, q in zip(use, p.argmax(0).tolist(), p.max(0).tolist(), strict=True):
            out[i] = (self.langs[k], q)
        return out


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Texts to train on by language, none of the held-out fold. Counts cover all rows with a letter; a hash
    of the id then keeps about DOCS_OF_LANG of each language (fewer past MOST_LANGS languages), so that one
    pass and no shuffle finds them. Of a text of over TRAIN_CHARS characters, so many are taken in a row,
    from a place of its hash, of its letters alone if there are none there. So the driver holds
    MOST_LANGS * DOCS_OF_LANG * TRAIN_CHARS characters at most. Languages without a letter are reported, none other is left out."""
    learn = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    lettered = F.col("text").rlike(r"\p{L}")
    found = learn.groupBy("lang").agg(F.count_if(lettered).alias("n")).collect()
    counts = {r["lang"]: r["n"] for r in found if r["n"]}
    if len(counts) < len(found):
        warnings.warn(f"no letter to learn from: {sorted(r['lang'] for r in found if not r['n'])}", stacklevel=2)
    if not counts:
        return {}
    most = DOCS_OF_LANG * min(1.0, MOST_LANGS / len(counts))
    if most < 1:
        raise ValueError(f"{len(counts)} languages are more than can be learned")
    letters = F.regexp_replace("text", r"[^\p{L}\p{M}]+", " ")

    def part(of):
        return F.substring(of, F.pmod(F.xxhash64("text"), F.greatest(F.length(of) - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1, F.lit(TRAIN_CHARS))

    there = part(F.col("text"))
    piece = F.when(F.length("text") <= TRAIN_CHARS, F.col("text")).when(there.rlike(r"\p{L}"), there).otherwise(part(letters))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most / n))])
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(17)), F.lit(1_000_000)) / 1_000_000
    learn = learn.filter(lettered)
    rows = learn.filter(chance < F.element_at(share, F.col("lang"))).select("lang", piece.alias("text")).collect()
    if missing := set(counts) - {r["lang"] for r in rows}:  # few ids, all of a high hash
        rows += learn.filter(F.col("lang").isin(*missing)).groupBy("lang").agg(F.min(piece).alias("text")).collect()
    out: dict[str, list[str]] = {k: [] for k in sorted(counts)}
    for r in sorted(rows, key=lambda r: (r["lang"], r["text"])):
        out[r["lang"]].append(r["text"])
    return out


def no_language(letters: str, n: int, rng: np.random.Generator) -> list[str]:
    """n words of no language: letters in no order, half of them of the alphabets given, half of others."""
    kinds = [np.array([ord(c) for c in letters])] * len(SCRIPTS) + [np.array([c for c in range(a, b + 1) if chr(c).isalpha()]) for a, b in SCRIPTS]
    sizes, of = rng.integers(1, 13, n), rng.integers(len(kinds), size=n)
    return ["".join(map(chr, rng.choice(kinds[k], m))) for k, m in zip(of.tolist(), sizes.tolist(), strict=True)]


def fit(texts_of: dict[str, list[str]], seed: int = 3, steps: int = 800, reject: bool = False) -> tuple[Network | None, list[str]]:
    """The network and its classes. reject: with a class UNKNOWN of words of no language besides."""
    texts_of = {k: x for k, x in texts_of.items() if any(map(has_letter, x))}
    if reject and set(texts_of) - {UNKNOWN}:
        rng = np.random.default_rng(seed)
        words = no_language("".join(sorted({c for x in texts_of.values() for t in x for c in t.lower() if c.isalpha()})), 60 * DOCS_OF_LANG, rng)
        texts_of[UNKNOWN] = texts_of.get(UNKNOWN, []) + [" ".join(words[k : k + 60]) for k in range(0, len(words), 60)]
    langs = list(texts_of)
    return (train([pool(x) for x in texts_of.values()], steps) if langs else None), langs


def labelled(docs: DataFrame, model: tuple[Network | None, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (of any type, even a struct of a whole row), lang_pred, score. A null text or one without a
    letter is `und` with score 0, as is every text if nothing could be learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(*shared.value)
        for b in batches:
            found = labeller.label(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score.

    A null text or one without a letter is `und` with score 0, as is every text if nothing could be
    learned. Rows whose lang is null teach nothing. A null id belongs to the fold of the empty text.
    Repeated rows stay repeated; other columns are ignored.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return labelled(docs, fit(sample(known)), id_col, text_col).withColumn("held_out", fold(F.col(id_col), FOLDS) == HELD_OUT)


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs (all columns) in a language that could be told: a text without a letter is in none,
    nor is one that the network holds for words of no language. If no language could be learned, every
    text with a letter is kept."""
    model = fit(sample(docs), reject=True)
    if not set(model[1]) - {UNKNOWN}:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct("*").alias("row"), "text")
    return labelled(rows, model, "row").filter(F.col("lang_pred") != UNKNOWN).select("row.*")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return language(table(tune(spark), sf_dir, "documents"))
