"""Window functions that Spark's windows do not have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.relational import _key


def window(by: list[str] = (), order: list[str | Column] = ()) -> Window:
    """Nulls last in either direction; a leading - means descending."""
    w = Window.partitionBy(*by)
    return w.orderBy(*[_key(k) for k in order]) if order else w


def lead_by(df: DataFrame, value: str, offset: str, name: str, by: list[str], order: list[str | Column], default: Column | None = None) -> DataFrame:
    """lead(value, offset) with an offset from a column: negative ones look back. Rows find their
    number's row by a join on (by, number), so a partition is never one array."""
    n = F.row_number().over(window(by, order))
    rows = df.withColumn("__n", n)
    there = rows.select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], F.col("__n").alias("__m"), F.col(value).alias(name), F.lit(True).alias("__hit"))
    cond = F.col("__m") == F.col("__n") + F.col(offset)
    for i, b in enumerate(by):
        cond = cond & rows[b].eqNullSafe(there[f"__b{i}"])
    out = rows.join(there, cond, "left")
    if default is not None:
        out = out.withColumn(name, F.when(F.col("__hit"), F.col(name)).otherwise(default))
    return out.drop("__n", "__m", "__hit", *[f"__b{i}" for i in range(len(by))])


def ntile_by(df: DataFrame, tiles: str, name: str, by: list[str], order: list[str | Column]) -> DataFrame:
    """ntile with the number of tiles from a column."""
    r = F.row_number().over(window(by, order)) - 1
    n = F.count("*").over(window(by))
    q, rest = F.floor(n / F.col(tiles)), n % F.col(tiles)
    tile = F.when(r < rest * (q + 1), F.floor(r / (q + 1))).otherwise(rest + F.floor((r - rest * (q + 1)) / F.greatest(q, F.lit(1)))) + 1
    return df.withColumn(name, tile.cast("long"))


def sum_excluding(value: str, by: list[str], order: list[str | Column], lo: int, hi: int, exclude: str) -> Column:
    """sum over ROWS lo..hi EXCLUDE current | group | ties. Groups and ties are those rows of the
    frame whose order keys equal the current row's, found by their rank."""
    w = window(by, order)
    frame = w.rowsBetween(lo, hi)
    if exclude == "current":
        if not lo <= 0 <= hi:  # the frame does not hold the current row
            return F.sum(value).over(frame)
        rest = F.count(F.col(value)).over(frame) - F.when(F.col(value).isNotNull(), 1).otherwise(0)
        return F.when(rest > 0, F.sum(value).over(frame) - F.coalesce(F.col(value), F.lit(0)))
    raise ValueError("use frame_excluding for groups and ties")


def frame_excluding(df: DataFrame, value: str, name: str, by: list[str], order: list[str | Column], lo: int, hi: int, exclude: str, agg) -> DataFrame:
    """agg (of an array) over ROWS lo..hi with EXCLUDE group | ties | current; frames are short arrays."""
    w = window(by, order)
    rows = df.withColumn("__r", F.rank().over(w)).withColumn("__i", F.row_number().over(w))
    rows = rows.withColumn("__f", F.collect_list(F.struct(F.col("__r").alias("r"), F.col("__i").alias("i"), F.col(value).alias("v"))).over(w.rowsBetween(lo, hi)))
    keep = {"current": lambda s: s["i"] != F.col("__i"), "group": lambda s: s["r"] != F.col("__r"), "ties": lambda s: (s["r"] != F.col("__r")) | (s["i"] == F.col("__i"))}[exclude]
    return rows.withColumn(name, agg(F.transform(F.filter("__f", keep), lambda s: s["v"]))).drop("__r", "__i", "__f")


def count_distinct_over(value: str, by: list[str]) -> Column:
    """count(DISTINCT value) OVER (PARTITION BY by) by dense ranks from both ends, which needs no set."""
    up = F.dense_rank().over(window(by, [F.col(value).asc_nulls_last()]))
    down = F.dense_rank().over(window(by, [F.col(value).desc_nulls_last()]))
    return up + down - 1 - F.max(F.col(value).isNull().cast("int")).over(window(by))


def running_distinct(value: str, by: list[str], order: list[str | Column]) -> Column:
    """count(DISTINCT value) OVER (PARTITION BY by ORDER BY order ROWS UNBOUNDED PRECEDING): a value
    counts at its first row. The first rows are marked by a window of their own: pass the mark."""
    return F.sum(F.when((F.col("__first") == 1) & F.col(value).isNotNull(), 1).otherwise(0)).over(window(by, order).rowsBetween(Window.unboundedPreceding, 0))


def with_first(df: DataFrame, value: str, by: list[str], order: list[str | Column]) -> DataFrame:
    return df.withColumn("__first", F.row_number().over(window([*by, value], order)))


def windowed(agg: Column, by: list[str], order: list[str | Column] = (), rows: tuple[int, int] | None = None, range_: tuple[int, int] | None = None) -> Column:
    w = window(by, order)
    if rows:
        w = w.rowsBetween(*rows)
    if range_:
        w = w.rangeBetween(*range_)
    return agg.over(w)
