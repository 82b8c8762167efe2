"""Whole-text encoding with the tokenizers library, with a memo of pre-tokens.

BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in a row. For texts in
the alphabet below (ASCII and the letters and signs of Latin-1), where the library's splitting
pattern has no corner cases, the pre-tokens are found here and each distinct one is encoded by the
library's model once; any other text goes to the library whole. All ways give the same ids
(tests/llm). Texts without apostrophes or runs of white space are split and looked up in groups, by
array operations; others piece by piece.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

_ALPHABET = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t\n\r "
_CONTRACTED = "'(?:s|t|re|ve|m|ll|d)"
#: A leading space stays with its word; a run of white space leaves its last sign to what follows.
_WITH_SPACE = re.compile(f" ?[{_L}]+|{_CONTRACTED}| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: White space dropped, digits one by one.
_NO_SPACE = re.compile(f"[{_L}]+|{_CONTRACTED}|[{_N}]|[^{_S}{_L}{_N}]+")
_TWO_SPACES = re.compile(rb"[\t\n\r ]{2}")
#: Pre-tokens that a process remembers at most.
MEMO_PIECES = 400_000


def default_path(name: str) -> str:
    """A vocabulary file's place: the public_tokenizers package, or QUARRY_TOKENIZERS."""
    if folder := os.environ.get("QUARRY_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_signs() -> dict[int, int]:
    """Byte-level BPE writes each byte as one printable sign: itself if printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: b if b in plain else next(rest) for b in range(256)}


class _Pieces:
    """Known pre-tokens and their ids in flat arrays, found by a direct-mapped table of hashes.

    Whole groups of texts are looked up at once; what finds its slot taken goes to a dictionary. A hash
    only proposes a pre-token: its bytes are compared with the text's, so a collision of hashes costs
    time and nothing else. A full store starts anew.
    """

    BITS = 21

    def __init__(self, tokenize, most: int) -> None:
        self.tokenize, self.signs, self.most = tokenize, _byte_signs(), most
        self._reset()

    def _reset(self) -> None:
        self.n = 0
        self.more: dict[int, int] = {}
        self.slot = np.full(1 << self.BITS, -1, np.int32)
        self.key = np.zeros(1 << 12, np.uint64)
        self.at = np.zeros((1 << 12, 2), np.int64)  # first id, first byte
        self.size = np.zeros((1 << 12, 2), np.int64)  # ids, bytes
        self.ids, self.raw = np.zeros(1 << 14, "<u4"), np.zeros(1 << 15, np.uint8)
        self.ends = [0, 0]

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros((max(n - len(a), len(a)), *a.shape[1:]), a.dtype)])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of pre-tokens by hash, -1 where unknown."""
        k = self.slot[h >> np.uint64(64 - self.BITS)]
        k = np.where((k >= 0) & (self.key[k] == h), k, -1)
        if self.more:
            rest = np.flatnonzero(k < 0)
            k[rest] = [self.more.get(x, -1) for x in h[rest].tolist()]
        return k

    def ids_of(self, piece: str) -> list[int]:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1")
        return [t.id for t in self.tokenize(piece.translate(self.signs))]

    def learn(self, h: np.ndarray, parts: list[bytes]) -> None:
        if self.n + len(parts) > self.most:
            self._reset()
        found = [self.ids_of(p.decode("latin-1")) for p in parts]
        n, m = self.n, self.n + len(parts)
        self.key, self.at, self.size = self._room(self.key, m), self._room(self.at, m), self._room(self.size, m)
        self.key[n:m] = h
        for k, (pool, rows) in enumerate((("ids", found), ("raw", parts))):
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            first = self.ends[k]
            flat = np.frombuffer(b"".join(rows), np.uint8) if k else np.fromiter((x for r in rows for x in r), "<u4", int(sizes.sum()))
            setattr(self, pool, self._room(getattr(self, pool), first + len(flat)))
            getattr(self, pool)[first : first + len(flat)] = flat
            self.size[n:m, k] = sizes
            self.at[n:m, k] = first + np.cumsum(sizes) - sizes
            self.ends[k] = first + len(flat)
        s = h >> np.uint64(64 - self.BITS)
        free = self.slot[s] < 0
        self.slot[s[free]] = np.arange(n, m)[free]
        lost = np.flatnonzero(self.slot[s] != np.arange(n, m))
        self.more.update(zip(h[lost].tolist(), (n + lost).tolist(), strict=True))
        self.n = m

    def gather(self, k: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (0) or bytes (1) of pre-tokens in a row, and how many of each."""
        sizes = self.size[k, which]
        before = np.cumsum(sizes) - sizes
        index = np.arange(int(sizes.sum())) + np.repeat(self.at[k, which] - before, sizes)
        return (self.raw if which else self.ids)[index], sizes


#: Classes of Latin-1 signs: 1 white space, 2 letter, 3 digit, 4 other; 0 between texts.
_CLASS = np.zeros(256, np.uint8)
for _c, _signs in ((4, _ALPHABET), (1, b"\t\n\r "), (2, bytes(i for i in _ALPHABET if re.match(f"[{_L}]", chr(i)))), (3, bytes(i for i in _ALPHABET if re.match(f"[{_N}]", chr(i))))):
    _CLASS[list(_signs)] = _c
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts looked up at once; longer texts go piece by piece.
_GROUP = 1 << 17
_POWERS = np.cumprod(np.full(_GROUP + 1, _MULT))
_INVERSES = np.cumprod(np.full(_GROUP + 1, np.uint64(pow(int(_MULT), -1, 1 << 64))))


class Encoder:
    """encode(texts) -> for each text its ids and then end_id, as little-endian unsigned 32-bit integers.

    Strings of special tokens within a text are ordinary text. A null text counts as empty.
    """

    def __init__(self, path: str, end_id: int, most: int = MEMO_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.end = np.array([end_id], "<u4").tobytes()
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        self.split, self.lower = self._splitter(shape)
        self.known = _Pieces(self.tokenizer.model.tokenize, most)

    def _splitter(self, shape: dict):
        """How a vocabulary of a known form splits; else none: then the library does it all."""
        pre, normal = shape.get("pre_tokenizer") or {}, shape.get("normalizer")
        if shape.get("post_processor") or shape.get("truncation") or shape.get("padding") or sys.byteorder != "little":
            return None, False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and normal is None:
            return self._with_space, False
        steps = [x.get("type") for x in (normal or {}).get("normalizers", ())]
        parts = pre.get("pretokenizers", ())
        if steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in parts] == ["Split", "ByteLevel"] and parts[0].get("invert"):
            return self._no_space, True
        return None, False

    @staticmethod
    def _no_space(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of pre-tokens where white space is dropped: runs of letters or of other signs, digits."""
        inside, digit, same = kind > 1, kind == 3, kind[1:] == kind[:-1]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~same | digit[1:]
        last[:-1] &= ~same | digit[:-1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @staticmethod
    def _with_space(kind: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where white space is kept and never stands two in a row: a space goes with the run
        after it, any other stands alone."""
        space = raw == 0x20
        edge = kind[1:] != kind[:-1]
        first = kind > 1
        first[1:] &= edge & ~space[:-1]
        first |= kind == 1
        starts = np.flatnonzero(first)
        stops = np.flatnonzero(first | (kind == 0))
        return starts, stops[np.searchsorted(stops, starts, "right")]

    def _simple(self, text: str) -> bytes | None:
        """A text's Latin-1 bytes if its pre-tokens show in its classes alone."""
        if self.split is None or "'" in text:
            return None
        try:
            raw = (text.lower() if self.lower else text).encode("latin-1")
        except UnicodeEncodeError:
            return None
        if len(raw) >= _GROUP or raw.translate(None, _ALPHABET):
            return None
        if not self.lower and _TWO_SPACES.search(raw):
            return None
        return raw

    def _pieces(self, text: str) -> bytes:
        """One text: by its pre-tokens if it is in the alphabet, else by the library."""
        try:
            odd = bool(text.encode("latin-1").translate(None, _ALPHABET))
        except UnicodeEncodeError:
            odd = True
        if self.split is None or odd:
            (whole,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            return np.array(whole.ids, "<u4").tobytes() + self.end
        parts = _NO_SPACE.findall(text.lower()) if self.lower else _WITH_SPACE.findall(text)
        once = {p: array("I", self.known.ids_of(p)).tobytes() for p in set(parts)}
        return b"".join(map(once.__getitem__, parts)) + self.end

    def _group(self, texts: list[bytes]) -> list[bytes] | None:
        """Texts of a group together; none if a hash deceived."""
        joined = b"\0".join([*texts, b""])
        raw = np.frombuffer(joined, np.uint8)
        kind = _CLASS[raw]
        starts, ends = self._no_space(kind) if self.lower else self._with_space(kind, raw)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * _POWERS[: len(raw)], out=total[1:])
        h = (total[ends] - total[starts]) * _INVERSES[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        k = self.known.find(h)
        for _ in range(2):  # the store may begin anew once
            miss = np.flatnonzero(k < 0)
            if not len(miss):
                break
            new, of = np.unique(h[miss], return_index=True)
            of = miss[of]
            self.known.learn(new, [joined[a:b] for a, b in zip(starts[of].tolist(), ends[of].tolist(), strict=True)])
            k = self.known.find(h)
        if (k < 0).any():
            return None
        letters, sizes = self.known.gather(k, 1)
        if not np.array_equal(sizes, ends - starts):
            return None
        inside = np.arange(len(letters)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        if not np.array_equal(letters, raw[inside]):
            return None
        ids, sizes = self.known.gather(k, 0)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(starts, bounds)]
        return [ids[a:b].tobytes() + self.end for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            if held:
                got = self._group([r for _, r in held])
                for n, (i, _) in enumerate(held):
                    out[i] = self._pieces(texts[i] or "") if got is None else got[n]
                held.clear()

        for i, text in enumerate(texts):
            if (raw := self._simple(text or "")) is None:
                out[i] = self._pieces(text or "")
                continue
            if size + len(raw) + 1 > _GROUP:
                flush()
                size = 0
            held.append((i, raw))
            size += len(raw) + 1
        flush()
        return out


@lru_cache(maxsize=4)
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for each process, so that its memo outlives a task."""
    return Encoder(path, end_id)
