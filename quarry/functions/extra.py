"""Functions that no expression gives: Arrow-batched, vectorised over a batch."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, LongType, StringType

from quarry.functions.library import named


@F.pandas_udf(StringType())
def nfc_normalize(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(LongType())
def length_grapheme(s: pd.Series) -> pd.Series:
    import regex

    find = regex.compile(r"\X").findall
    return s.map(lambda x: len(find(x)), na_action="ignore").astype("Int64")


def _slice_graphemes(x: str, start: int, n: int | None) -> str:
    import regex

    parts = regex.findall(r"\X", x)
    a = start - 1 if start > 0 else len(parts) + start
    return "".join(parts[max(a, 0) : None if n is None else max(a + n, 0)])


def _graphemes(of):
    @F.pandas_udf(StringType())
    def run(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else of(x, int(k)) for x, k in zip(s, n, strict=True)])

    return run


substring_grapheme = _graphemes(lambda x, k: _slice_graphemes(x, k, None))
left_grapheme = _graphemes(lambda x, k: _slice_graphemes(x, 1, k))
right_grapheme = _graphemes(lambda x, k: _slice_graphemes(x, -k, None) if k else "")


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (y for y, u in zip(b, used, strict=True) if u), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def _jaro_winkler(a: str, b: str) -> float:
    j = _jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j) if j > 0.7 else j


def _damerau(a: str, b: str) -> int:
    """Edits with transpositions of characters, any substring edited more than once."""
    far, last = len(a) + len(b), {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            cost = x != y
            if not cost:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


def _pairs(kind: DataType, of):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else of(x, y) for x, y in zip(a, b, strict=True)])

    return run


jaro_similarity = _pairs(DoubleType(), _jaro)
jaro_winkler_similarity = _pairs(DoubleType(), _jaro_winkler)
damerau_levenshtein = _pairs(LongType(), _damerau)


@F.pandas_udf(DoubleType())
def nextafter(x: pd.Series, y: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series(np.nextafter(x.astype("float64"), y.astype("float64")))


@F.pandas_udf(StringType())
def json_merge_patch(a: pd.Series, b: pd.Series) -> pd.Series:
    import json

    def merge(x, y):
        if not isinstance(y, dict):
            return y
        out = dict(x) if isinstance(x, dict) else {}
        for k, v in y.items():
            if v is None:
                out.pop(k, None)
            else:
                out[k] = merge(out.get(k), v)
        return out

    return pd.Series([None if x is None or y is None else json.dumps(merge(json.loads(x), json.loads(y)), separators=(",", ":")) for x, y in zip(a, b, strict=True)])


for _f in ("nfc_normalize", "length_grapheme", "substring_grapheme", "left_grapheme", "right_grapheme", "jaro_similarity", "jaro_winkler_similarity", "damerau_levenshtein", "nextafter", "json_merge_patch"):
    named(_f)(globals()[_f])

#: An address without its mask.
named("host")(lambda inet: F.split_part(inet, F.lit("/"), F.lit(1)))
