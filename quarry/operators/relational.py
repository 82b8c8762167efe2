"""Operators on rows: ordering, limits, set operations, pivots, samples, recursion, distinct on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import scratch, written


def order_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Nulls last in either direction. A leading - on a name means descending."""
    return df.orderBy(*[_key(k) for k in keys])


def _key(k: str | Column) -> Column:
    if isinstance(k, Column):
        return k
    return F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last()


def top_n(df: DataFrame, n: int, *keys: str | Column, offset: int = 0) -> DataFrame:
    """Each task keeps its best n; only those meet."""
    return order_by(df, *keys).limit(n + offset).offset(offset) if offset else order_by(df, *keys).limit(n)


def limit_percent(df: DataFrame, percent: float, *keys: str | Column) -> DataFrame:
    """The first percent of the rows, rounded down. The count is a job of its own; then this is a top-n."""
    return top_n(df, int(df.count() * percent / 100), *keys)


def distinct_on(df: DataFrame, on: list[str], *keys: str | Column) -> DataFrame:
    """The first row of each group in the order of keys, by a min over structs that Spark combines
    before it shuffles; keys must order all rows of a group and sort ascending by name."""
    if all(isinstance(k, str) and not k.startswith("-") for k in keys) and not any(df.schema[k].nullable for k in keys):
        rest = [c for c in df.columns if c not in on and c not in keys]
        best = df.groupBy(*on).agg(F.min(F.struct(*keys, *rest)).alias("__b"))
        return best.select(*on, "__b.*").select(*df.columns)
    w = Window.partitionBy(*on).orderBy(*[_key(k) for k in keys])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_n_per_group(df: DataFrame, by: list[str], n: int, *keys: str | Column) -> DataFrame:
    """Spark turns the rank filter into a limit for each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*[_key(k) for k in keys])
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Filter by a condition on window functions."""
    return df.withColumn("__q", condition).filter("__q").drop("__q")


def union_by_name(a: DataFrame, b: DataFrame, all_: bool = True) -> DataFrame:
    both = a.unionByName(b, allowMissingColumns=True)
    return both if all_ else both.distinct()


def pivot(df: DataFrame, on: str, values: list, agg: Callable[[Column], Column], value: str, by: list[str], count: bool = False) -> DataFrame:
    """One column per value: filtered aggregates in one pass. An empty cell is the aggregate of nothing:
    0 for counts, else null."""
    cells = [agg(F.when(F.col(on) == v, F.col(value))).alias(str(v)) for v in values]
    out = df.groupBy(*by).agg(*cells)
    return out.fillna(0, [str(v) for v in values]) if count else out


def pivot_values(df: DataFrame, on: str, most: int = 100_000) -> list:
    """The distinct values to pivot on, in order; more than `most` is an error."""
    rows = df.select(on).distinct().orderBy(on).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} values to pivot on")
    return [r[0] for r in rows if r[0] is not None]


def unpivot(df: DataFrame, columns: list[str | tuple[str, ...]], name: str = "name", value: str | tuple[str, ...] = "value", include_nulls: bool = False) -> DataFrame:
    """A row for each of `columns`. Several columns may go into one row: columns are tuples then, value a
    tuple of as many names, and the row's name is that of the tuple's first column. Rows of nulls
    alone go, unless include_nulls."""
    if not isinstance(value, str):
        ids = [c for c in df.columns if not any(c in x for x in columns)]
        rows = F.array(*[F.struct(F.lit(x[0]).alias(name), *[F.col(c).alias(v) for c, v in zip(x, value, strict=True)]) for x in columns])
        out = df.select(*ids, F.explode(rows).alias("__r")).select(*ids, "__r.*")
        return out if include_nulls else out.dropna("all", subset=list(value))
    ids = [c for c in df.columns if c not in columns]
    out = df.unpivot(ids, columns, name, value)
    return out if include_nulls else out.filter(F.col(value).isNotNull())


def unnest(df: DataFrame, *lists: str) -> DataFrame:
    """Several lists side by side, shorter ones padded with null; rows without elements go."""
    if len(lists) == 1:
        return df.withColumn(lists[0], F.explode(lists[0]))
    zipped = df.withColumn("__z", F.explode(F.arrays_zip(*[F.coalesce(F.col(c), F.array()).alias(c) for c in lists])))
    return zipped.select(*[F.col(f"__z.{c}").alias(c) if c in lists else F.col(c) for c in df.columns])


def unnest_deep(df: DataFrame, column: str, max_depth: int | None = None) -> DataFrame:
    """unnest(column, recursive := true): lists in lists become rows, structs columns, down to max_depth
    levels of lists, or all. Rows without elements go."""
    depth = 0
    while df.schema[column].dataType.typeName() == "array" and (max_depth is None or depth < max_depth):
        df, depth = df.withColumn(column, F.explode(column)), depth + 1
    if df.schema[column].dataType.typeName() == "struct" and (max_depth is None or depth < max_depth):
        return df.select(*[c for c in df.columns if c != column], f"{column}.*")
    return df


def sample(df: DataFrame, percent: float | None = None, rows: int | None = None, seed: int = 42) -> DataFrame:
    """Bernoulli by percent; a fixed number of rows by the smallest of hashed random keys, which is a top-n."""
    if rows is None:
        return df.sample(fraction=percent / 100, seed=seed)
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(rows).drop("__r")


def recursive(start: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, most: int = 10_000) -> DataFrame:
    """WITH RECURSIVE: step makes new rows of the last ones until none are new. With distinct, rows
    seen before are dropped (UNION), by one anti-join with all of them; else all are kept (UNION ALL).
    Each round is written to the session's shared folder, so plans stay short and a lost executor costs
    one round at most."""
    spark, folder = start.sparkSession, scratch(start.sparkSession, "recursion")
    last = written(start.distinct() if distinct else start, "", f"{folder}/round=0")
    seen = spark.read.schema(last.schema)
    for k in range(1, most + 1):
        new = step(last)
        if distinct:
            new = new.subtract(seen.parquet(*[f"{folder}/round={i}" for i in range(k)]))
        last = written(new.select(*[F.col(a).cast(f.dataType).alias(f.name) for a, f in zip(new.columns, last.schema, strict=True)]), "", f"{folder}/round={k}")
        if last.isEmpty():
            return seen.parquet(*[f"{folder}/round={i}" for i in range(k)])
    raise RuntimeError(f"no end after {most} rounds")


def summarize(df: DataFrame) -> DataFrame:
    """One row per column: name, type, min, max, approx_unique, avg, std, q25, q50, q75, count, null_percentage.
    One pass over the data for all columns."""
    aggs, n = [F.count("*").alias("__n")], [f.name for f in df.schema.fields]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        number = f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")
        ordered = f.dataType.typeName() not in ("map", "variant", "array", "struct", "binary")
        null = F.lit(None).cast("string")
        aggs.append(
            F.struct(
                (F.min(c).cast("string") if ordered else null).alias("min"),
                (F.max(c).cast("string") if ordered else null).alias("max"),
                (F.approx_count_distinct(c) if ordered else F.lit(None).cast("long")).alias("approx_unique"),
                (F.avg(c).cast("double") if number else F.lit(None).cast("double")).alias("avg"),
                (F.stddev(c) if number else F.lit(None).cast("double")).alias("std"),
                *[(F.percentile_approx(c, q).cast("string") if number else null).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)],
                F.count(c).alias("seen"),
            ).alias(f"__c{i}")
        )
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"), F.col(f"__c{i}").alias("s")) for i, (name, f) in enumerate(zip(n, df.schema.fields, strict=True))]
    out = row.select("__n", F.explode(F.array(*parts)).alias("c")).select("c.column_name", "c.column_type", "c.s.*", "__n")
    return out.withColumn("count", F.col("__n")).withColumn("null_percentage", F.when(F.col("__n") > 0, F.round(100 * (1 - F.col("seen") / F.col("__n")), 2))).drop("__n", "seen")
