"""Sources, sinks, changes to tables, search and streams as queries: what was written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.session import table
from quarry.sources import readers, tables
from quarry.streaming.windows import windowed_counts

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None):
    def put(of):
        QUERIES[name] = of
        if sql:
            ORACLE_SQL[name] = sql
        return of

    return put


_SUPPLIERS = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


@query("source_csv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def source_csv(s, d):
    out = tables.copy_to(table(s, d, "supplier"), tables.scratch(s, "csv"), "csv", header=True, compression="gzip")
    return readers.read_csv(s, out, _SUPPLIERS)


@query("source_json", "SELECT event_id, event_type, value FROM events")
def source_json(s, d):
    out = tables.copy_to(table(s, d, "events").select("event_id", "event_type", "value"), tables.scratch(s, "json"), "json")
    return readers.read_json(s, out, "event_id long, event_type string, value double")


@query("source_orc", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'")
def source_orc(s, d):
    out = tables.copy_to(table(s, d, "orders"), tables.scratch(s, "orc"), "orc")
    return s.read.orc(out).filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")


@query("source_hive_partitions", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_returnflag")
def source_hive_partitions(s, d):
    out = tables.copy_to(table(s, d, "lineitem"), tables.scratch(s, "hive"), partition_by=["l_returnflag"], rows_per_file=50_000)
    return readers.read_parquet(s, out).filter("l_returnflag <> 'N'").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("source_union_by_name", "SELECT r_regionkey, r_name, NULL::INTEGER AS extra FROM region UNION ALL SELECT r_regionkey, r_name, r_regionkey + 1 FROM region")
def source_union_by_name(s, d):
    out = tables.scratch(s, "named")
    table(s, d, "region").write.parquet(f"{out}/a")
    table(s, d, "region").withColumn("extra", F.col("r_regionkey") + 1).write.parquet(f"{out}/b")
    return readers.read_parquet(s, [f"{out}/a", f"{out}/b"], union_by_name=True).select("r_regionkey", "r_name", "extra")


@query("source_metadata", "SELECT 'r_name' AS path_in_schema, count(*) AS n FROM region")
def source_metadata(s, d):
    out = tables.copy_to(table(s, d, "region").coalesce(1), tables.scratch(s, "meta"))
    return readers.parquet_metadata(s, out).filter("path_in_schema = 'r_name'").groupBy("path_in_schema").agg(F.sum("num_values").alias("n"))


@query("source_range", "SELECT CAST(range AS BIGINT) AS range FROM range(3, 50000, 7)")
def source_range(s, d):
    return readers.range_(s, 3, 50000, 7)


@query("source_series", "SELECT CAST(generate_series AS BIGINT) AS generate_series FROM generate_series(10, -10, -5)")
def source_series(s, d):
    return readers.range_(s, 10, -10, -5, inclusive=True)


@query("source_timestamps", "SELECT range FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 6 HOUR)")
def source_timestamps(s, d):
    return readers.range_timestamps(s, "2024-01-01", "2024-02-01", "6 hours")


def _balances(s, d) -> tables.StoredTable:
    return tables.StoredTable(s, tables.scratch(s, "table")).create(table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"))


@query("dml_update_delete", "SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey = 3 THEN round(s_acctbal * 2, 2) ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0 OR s_nationkey = 3")
def dml_update_delete(s, d):
    t = _balances(s, d).update({"s_acctbal": F.round(F.col("s_acctbal") * 2, 2)}, F.col("s_nationkey") == 3)
    return t.delete((F.col("s_suppkey") % 5 == 0) & (F.col("s_nationkey") != 3)).read()


@query("dml_upsert", "SELECT coalesce(n.k, s_suppkey) AS s_suppkey, s_nationkey, coalesce(n.v, s_acctbal) AS s_acctbal FROM supplier FULL JOIN (SELECT n_nationkey::BIGINT * 7 AS k, n_nationkey::DOUBLE AS v FROM nation) n ON k = s_suppkey")
def dml_upsert(s, d):
    new = table(s, d, "nation").select((F.col("n_nationkey").cast("long") * 7).alias("s_suppkey"), F.lit(None).cast("int").alias("s_nationkey"), F.col("n_nationkey").cast("double").alias("s_acctbal"))
    return _balances(s, d).upsert(new, ["s_suppkey"], values=["s_acctbal"]).read()


@query("dml_insert_ignore", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT k, 0, 0.0 FROM (SELECT n_nationkey::BIGINT * 7 AS k FROM nation) WHERE k NOT IN (SELECT s_suppkey FROM supplier)")
def dml_insert_ignore(s, d):
    new = table(s, d, "nation").select((F.col("n_nationkey").cast("long") * 7).alias("s_suppkey"), F.lit(0).alias("s_nationkey"), F.lit(0.0).alias("s_acctbal"))
    return _balances(s, d).upsert(new, ["s_suppkey"], "ignore").read()


@query("stream_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(s, d):
    """The table as a stream, run to its end; the windows that were kept up to date are the result."""
    src = s.read.parquet(f"{d}/events.parquet")
    stream = s.readStream.schema(src.schema).parquet(_folder_of(s, d))
    out, name = tables.scratch(s, "stream"), "quarry_windows"
    counts = windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "6 hours", late="3650 days")
    q = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).trigger(availableNow=True).queryName(name).start()
    q.awaitTermination()
    return s.read.parquet(f"{out}/rows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _folder_of(s, d) -> str:
    """Streams read folders: the events as a folder of their own."""
    out = tables.scratch(s, "events")
    s.read.parquet(f"{d}/events.parquet").write.parquet(out)
    return out
