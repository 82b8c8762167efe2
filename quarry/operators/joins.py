"""Joins that Spark has no operator for, as compositions that shuffle on keys.

Each takes and returns DataFrames; column names of both sides must differ unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import written


def asof_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: list[tuple[str, str]] = (), how: str = "inner", op: str = ">=") -> DataFrame:
    """For each left row the nearest right row of equal `by` columns with left_ts `op` right_ts.

    op is one of >= > <= <. how: inner, left or right (right: the right rows that no left row took
    come too, without a left side). One shuffle: both sides are put in one stream, ordered by time
    within the keys, and the last right row so far is carried along. Of right rows with equal time
    the greatest by its other columns wins. Rows with a null key or time match nothing.

    Rows of one key make one window, which spills but is not split; where a key holds a large share
    of all rows, use asof_join_within. Without keys the stream is cut by time into as many ranges as
    there are shuffle partitions, and each range takes over the last right row of those before it.
    """
    back = op in (">=", ">")
    keys = [f"__k{i}" for i in range(len(by))]
    lcols, rcols = left.columns, right.columns
    lside = left.select(*[F.col(a).alias(k) for k, (a, _) in zip(keys, by, strict=True)], F.col(left_ts).alias("__ts"), F.lit(0).alias("__right"), F.struct(*lcols).alias("__l"), F.lit(None).cast(right.select(F.struct(*rcols).alias("r")).schema["r"].dataType).alias("__r"))
    rside = right.filter(F.col(right_ts).isNotNull()).select(*[F.col(b).alias(k) for k, (_, b) in zip(keys, by, strict=True)], F.col(right_ts).alias("__ts"), F.lit(1).alias("__right"), F.lit(None).cast(left.select(F.struct(*lcols).alias("l")).schema["l"].dataType).alias("__l"), F.struct(*rcols).alias("__r"))
    right_first = op in (">=", "<=")  # at equal times the right row comes before the left one
    time = F.col("__ts").asc_nulls_first() if back else F.col("__ts").desc_nulls_first()
    side = F.col("__right").desc() if right_first else F.col("__right").asc()
    w = Window.partitionBy(*keys).orderBy(time, side, F.col("__r")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    both = lside.unionByName(rside)
    both = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)) if keys else _carried(both, time, [time, side, F.col("__r")])
    both = both.withColumn("__m", F.when(known & F.col("__ts").isNotNull(), F.col("__m")))
    if how == "right":
        hit = both.filter("__right = 0 and __m is not null").select("__l", F.col("__m").alias("__r"))
        rest = _not_in(right, hit.select("__r.*").distinct())
        return hit.select("__l.*", "__r.*").unionByName(rest.select(*[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lcols], *rcols))
    out = both.filter("__right = 0")
    if how == "inner":
        out = out.filter("__m is not null")
    return out.select("__l.*", *[F.col("__m")[c].alias(c) for c in rcols])


def _carried(both: DataFrame, time: Column, order: list[Column]) -> DataFrame:
    """Adds __m, the last __r so far in the order, without one task seeing all rows. Equal times share a range."""
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = written(both.repartitionByRange(n, time).withColumn("__part", F.spark_partition_id()), "asof")
    w = Window.partitionBy("__part").orderBy(*order)
    both = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = both.withColumn("__i", F.row_number().over(w)).groupBy("__part").agg(F.max_by("__m", "__i").alias("__end"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carry = ends.select("__part", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    return both.join(F.broadcast(carry), "__part").withColumn("__m", F.coalesce("__m", "__carry")).drop("__part", "__carry")


def asof_join_within(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: list[tuple[str, str]], seconds: int) -> DataFrame:
    """As asof_join with >= and how="left", looking back `seconds` at most. Time is cut into buckets of
    that length; a right row serves its own bucket and the next, so a hot key is spread over time."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    l = left.withColumn("__lb", bucket(left_ts))  # noqa: E741
    r = right.withColumn("__rt", F.col(right_ts)).withColumn("__rb", F.explode(F.array(bucket(right_ts), bucket(right_ts) + 1)))
    out = asof_join(l, r, left_ts, right_ts, [*by, ("__lb", "__rb")], "left")
    near = F.unix_micros(F.col(left_ts).cast("timestamp")) - F.unix_micros(F.col("__rt").cast("timestamp")) <= seconds * 1_000_000
    return out.select(*left.columns, *[F.when(near, F.col(c)).alias(c) for c in right.columns])


def _not_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that are not in b, nulls being equal; repeated rows stay."""
    other = b.toDF(*[f"__{c}" for c in b.columns])
    cond = F.lit(True)
    for c in a.columns:
        cond = cond & a[c].eqNullSafe(other[f"__{c}"])
    return a.join(other, cond, "left_anti")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, by: list[tuple[str, str]] = (), how: str = "inner", closed: str = "[)") -> DataFrame:
    """left.point within right's interval low..high. Intervals go to every bucket of `width` that they
    touch, points to theirs; equal buckets meet in a hash or sort-merge join, the bounds are checked
    there. Choose width near the intervals' usual length: longer ones cost a row per bucket. With how
    right or full, right rows that hold no point come once, without a left side."""
    if how in ("right", "full"):
        part = range_join(left, right, point, low, high, width, by, "left" if how == "full" else "inner", closed)
        hit = range_join(left, right, point, low, high, width, by, "inner", closed).select(*right.columns).distinct()
        nulls = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns]
        return part.unionByName(_not_in(right, hit).select(*nulls, *right.columns))
    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    spread = right.withColumn("__b", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    points = left.withColumn("__b", F.floor(F.col(point).cast("double") / width))
    x = points[point]
    inside = (x >= spread[low] if closed[0] == "[" else x > spread[low]) & (x <= spread[high] if closed[1] == "]" else x < spread[high])
    cond = (points["__b"] == spread["__b"]) & inside
    for a, b in by:
        cond = cond & (points[a] == spread[b])
    return points.join(spread.filter(F.col(low).isNotNull() & F.col(high).isNotNull()), cond, how).drop("__b")


def overlap_join(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], width: float, by: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs whose half-open ranges overlap. Both are entered in every bucket that they touch; a pair is
    taken in the first bucket they share, so it comes once without a distinct."""
    spread = lambda d, r, c: d.withColumn(c, F.explode(F.sequence(F.floor(F.col(r[0]).cast("double") / width), F.floor(F.col(r[1]).cast("double") / width))))
    x, y = spread(a, a_range, "__x"), spread(b, b_range, "__y")
    first = F.greatest(F.floor(x[a_range[0]].cast("double") / width), F.floor(y[b_range[0]].cast("double") / width))
    cond = (F.col("__x") == F.col("__y")) & (F.col("__x") == first) & (x[a_range[0]] < y[b_range[1]]) & (y[b_range[0]] < x[a_range[1]])
    for p, q in by:
        cond = cond & (x[p] == y[q])
    return x.join(y, cond).drop("__x", "__y")


def positions(df: DataFrame, order: list[str], name: str = "__pos") -> DataFrame:
    """Rows numbered from 0 in an order, without one task seeing all of them: a range partition sorts,
    each part is counted, and its rows add what came before. The sorted rows are written once with their
    part and place, so that adaptive plans cannot cut them differently for the count and for the rows."""
    keys = [F.col(c).asc_nulls_last() for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    numbered = written(sorted_.withColumn("__id", F.monotonically_increasing_id()), "positions").withColumn("__part", F.shiftright("__id", 33))
    counts = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + local).drop("__id", "__part", "__base")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side in the given orders; the shorter side ends in nulls."""
    return positions(left, left_order).join(positions(right, right_order), "__pos", "full").drop("__pos")


def mark_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, mark: str = "mark") -> DataFrame:
    """left with a three-valued column: whether left_col IN (select right_col)."""
    keys = right.select(F.col(right_col).alias("__k"))
    seen = keys.filter("__k is not null").distinct().withColumn("__hit", F.lit(True))
    facts = keys.agg(F.count("*").alias("__n"), F.count_if(F.col("__k").isNull()).alias("__nulls"))
    out = left.join(seen, left[left_col] == seen["__k"], "left").crossJoin(F.broadcast(facts))  # facts is one row
    value = F.when(F.col("__n") == 0, False).when(F.col("__hit"), True).when(F.col(left_col).isNull() | (F.col("__nulls") > 0), None).otherwise(False)
    return out.withColumn(mark, value).drop("__k", "__hit", "__n", "__nulls")


def single_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], value: str, name: str) -> DataFrame:
    """A correlated scalar subquery: one matching value per left row (of several, the smallest), or null."""
    keys = [b for _, b in on]
    one = right.groupBy(*keys).agg(F.min(value).alias(name)).toDF(*[f"__s{i}" for i in range(len(keys))], name)
    cond = F.lit(True)
    for i, (a, _) in enumerate(on):
        cond = cond & (left[a] == one[f"__s{i}"])
    return left.join(one, cond, "left").drop(*[f"__s{i}" for i in range(len(keys))])


def inequality_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Any condition without an equality. Spark compares all pairs; the smaller side is sent around if
    it is under the session's broadcast threshold. For one comparison use merge_join, for ranges
    range_join or overlap_join."""
    return left.join(right, condition, how)


def merge_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, op: str = ">", parts: int = 64) -> DataFrame:
    """Pairs with left_col `op` right_col, one of > >= < <=. Both sides are cut at the same quantiles of the
    left column: a left row meets the right rows of its own range by comparing them, and those of the
    ranges below (above) it without, so what is compared is a small part of all pairs, and each pair
    of ranges is a task of its own. Nulls match nothing. Where only the number of pairs is asked for, use
    merge_counts."""
    there = left.filter(F.col(left_col).isNotNull())
    cuts = sorted(set(there.approxQuantile(left_col, [k / parts for k in range(1, parts)], 0.01)))
    rank = lambda c: sum((F.when(F.col(c) >= x, 1).otherwise(0) for x in cuts), F.lit(0))
    l = there.withColumn("__lp", rank(left_col))  # noqa: E741
    r = right.filter(F.col(right_col).isNotNull()).withColumn("__rp", rank(right_col))
    below = op in (">", ">=")
    reach = F.sequence(F.col("__rp"), F.lit(len(cuts))) if below else F.sequence(F.lit(0), F.col("__rp"))
    r = r.withColumn("__lp2", F.explode(reach))  # the left ranges that a right row meets
    x, y = l[left_col], r[right_col]
    compare = {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]
    return l.join(r, (l["__lp"] == r["__lp2"]) & ((l["__lp"] != r["__rp"]) | compare)).drop("__lp", "__rp", "__lp2")


def merge_counts(left: DataFrame, right: DataFrame, left_col: str, right_col: str, op: str = ">", name: str = "n") -> DataFrame:
    """left with the number of pairs that merge_join makes of each row, for aggregates that need no pairs; rows
    without a pair stay out. Right rows are counted by value, and the values of both sides are cut by range:
    each takes the running sum of its range and what the ranges before it hold, so no task sees all values
    and no pair is made."""
    up = op in (">", ">=")
    side = lambda d, c, n: d.select(F.col(c).alias("__v"), F.lit(n).cast("long").alias("__c")).filter(F.col("__v").isNotNull())
    values = side(left, left_col, 0).unionByName(side(right, right_col, 1)).groupBy("__v").agg(F.sum("__c").alias("__c"))
    order = F.col("__v").asc() if up else F.col("__v").desc()
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = written(values.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()), "merge")
    so_far = F.sum("__c").over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    if op in (">", "<"):
        so_far = so_far - F.col("__c")  # equal values make no pair
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = values.groupBy("__part").agg(F.sum("__c").alias("__in")).select("__part", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__base"))
    found = values.withColumn("__run", so_far).join(F.broadcast(base), "__part").select("__v", (F.col("__base") + F.col("__run")).alias(name))
    return left.join(found.filter(F.col(name) > 0), left[left_col] == found["__v"]).drop("__v")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An equality join whose hot left keys are spread over `salts` tasks, the right side repeated. With how
    right or full, right rows whose key no left row has come once."""
    if how in ("right", "full", "outer", "right_outer", "full_outer"):
        part = salted_join(left, right, on, salts, "inner" if how.startswith("right") else "left")
        rest = right.join(left.select(*on).distinct(), on, "left_anti")
        return part.unionByName(rest, allowMissingColumns=True).select(*part.columns)
    l = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))  # noqa: E741
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*on, "__salt"], how).drop("__salt")
