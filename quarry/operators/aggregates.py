"""Aggregates that need two passes, each of which shuffles partial results only, whatever the group's
size; and aggregates by states of a fixed size, which are stored, combined and finished later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, bucket, count): one row per value, nulls left out."""
    return df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("bucket")).agg(F.count("*").alias("count"))


def entropy(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, entropy) in bits, from the counts of values."""
    n, total = F.col("count"), F.sum("count")
    return histogram(df, by, x).groupBy(*by).agg((F.log2(total.cast("double")) - F.sum(n * F.log2(n.cast("double"))) / total).alias("entropy"))


def mad(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, mad): the median of distances to the median. Spark's percentile counts equal values first."""
    value = F.col(x).cast("double")
    middle = df.groupBy(*by).agg(F.percentile(value, 0.5).alias("__m"))
    joined = df.select(*by, value.alias("__x")).join(middle, by) if by else df.select(value.alias("__x")).crossJoin(F.broadcast(middle))  # one row
    return joined.groupBy(*by).agg(F.percentile(F.abs(F.col("__x") - F.col("__m")), 0.5).alias("mad"))


def mode(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, mode): the most frequent value, of several the smallest."""
    return histogram(df, by, x).groupBy(*by).agg(F.min(F.struct((-F.col("count")).alias("n"), "bucket"))["bucket"].alias("mode"))


# States: (the state of rows, the state of states, the value of a state)

_SAME = {"min": F.min, "max": F.max, "bool_and": F.bool_and, "bool_or": F.bool_or}


def export_state(name: str, x: Column | str) -> Column:
    """The state of an aggregate over a group's rows, for columns of a roll-up that are combined later:
    count, sum, avg, min, max, bool_and, bool_or, approx_count_distinct (a sketch)."""
    x = F.col(x) if isinstance(x, str) else x
    if name in _SAME:
        return F.struct(_SAME[name](x).alias("value"))
    if name == "count":
        return F.struct(F.count(x).alias("value"))
    if name == "sum":
        return F.struct(F.sum(x).alias("value"))
    if name == "avg":
        return F.struct(F.sum(x.cast("double")).alias("value"), F.count(x).alias("n"))
    if name == "approx_count_distinct":
        return F.struct(F.hll_sketch_agg(x).alias("value"))
    raise ValueError(f"no state of {name}")


def combine_states(name: str, state: Column | str) -> Column:
    """The state of the rows of all states of a group. Null states count for no rows."""
    state = F.col(state) if isinstance(state, str) else state
    value = state["value"]
    if name in _SAME:
        return F.struct(_SAME[name](value).alias("value"))
    if name == "count":
        return F.struct(F.coalesce(F.sum(value), F.lit(0).cast("long")).alias("value"))
    if name == "sum":
        return F.struct(F.sum(value).alias("value"))
    if name == "avg":
        return F.struct(F.sum(value).alias("value"), F.coalesce(F.sum(state["n"]), F.lit(0).cast("long")).alias("n"))
    if name == "approx_count_distinct":
        return F.struct(F.hll_union_agg(value).alias("value"))
    raise ValueError(f"no state of {name}")


def finish_state(name: str, state: Column | str) -> Column:
    """The aggregate's value; of a state without rows null, for counts 0."""
    state = F.col(state) if isinstance(state, str) else state
    if name == "count":
        return F.coalesce(state["value"], F.lit(0))
    if name == "avg":
        return F.when(state["n"] > 0, state["value"] / state["n"])
    if name == "approx_count_distinct":
        return F.coalesce(F.hll_sketch_estimate(state["value"]), F.lit(0))
    return state["value"]
