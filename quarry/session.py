"""A session whose defaults follow the engine's rules."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, checked casts and arithmetic, plans that adapt at run time, skewed joins split.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cte.recursion.level.limit": "100000",
}


def session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return pin(builder.config(map={k.replace("__", "."): v for k, v in conf.items()}).getOrCreate())


def pin(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Tables of a folder as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
