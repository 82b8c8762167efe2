"""Analytical queries over the star schema, the joins by predicate transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.transfer import JoinGraph, JoinOrder, TransferMode
from quarry.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None):
    def put(of):
        QUERIES[name] = of
        if sql:
            ORACLE_SQL[name] = sql
        return of

    return put


def _net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))



@query("q1_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus")
def q1(s: SparkSession, d: str) -> DataFrame:
    return (
        table(s, d, "lineitem")
        .filter("l_shipdate <= timestamp_ntz'2001-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(_net()), 2).alias("sum_disc"), F.round(F.sum(_net() * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
    )


def _shipping(s, d) -> JoinGraph:
    return (
        JoinGraph()
        .add("l", table(s, d, "lineitem").filter("l_shipdate > timestamp_ntz'1998-03-15'").select("l_orderkey", "l_extendedprice", "l_discount"))
        .add("o", table(s, d, "orders").filter("o_orderdate < timestamp_ntz'1998-03-15'").select("o_orderkey", "o_custkey", "o_orderdate"))
        .add("c", table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey"))
        .join("l", "o", ("l_orderkey", "o_orderkey"))
        .join("o", "c", ("o_custkey", "c_custkey"))
    )


_Q3 = "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10"


def _q3(s, d, mode, order=JoinOrder.CATALYST, seed=0):
    rows = _shipping(s, d).execute(mode, order, seed)
    return rows.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(_net()), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("q3_shipping_priority", _Q3)
def q3(s, d):
    return _q3(s, d, TransferMode.NONE)


def _local_suppliers(s, d) -> JoinGraph:
    """A cyclic graph: customer and supplier share the nation."""
    return (
        JoinGraph()
        .add("l", table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"))
        .add("o", table(s, d, "orders").filter("o_orderdate >= timestamp_ntz'1997-01-01' and o_orderdate < timestamp_ntz'1998-01-01'").select("o_orderkey", "o_custkey"))
        .add("c", table(s, d, "customer").select("c_custkey", "c_nationkey"))
        .add("s", table(s, d, "supplier").select("s_suppkey", "s_nationkey"))
        .add("n", table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
        .add("r", table(s, d, "region").filter("r_name = 'ASIA'").select("r_regionkey"))
        .join("l", "o", ("l_orderkey", "o_orderkey"))
        .join("o", "c", ("o_custkey", "c_custkey"))
        .join("l", "s", ("l_suppkey", "s_suppkey"))
        .join("c", "s", ("c_nationkey", "s_nationkey"))
        .join("s", "n", ("s_nationkey", "n_nationkey"))
        .join("n", "r", ("n_regionkey", "r_regionkey"))
    )


_Q5 = "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name"


def _q5(s, d, mode, order=JoinOrder.CATALYST, seed=0):
    return _local_suppliers(s, d).execute(mode, order, seed).groupBy("n_name").agg(F.round(F.sum(_net()), 2).alias("revenue"))


@query("q5_local_suppliers", _Q5)
def q5(s, d):
    return _q5(s, d, TransferMode.NONE)


for _m in (TransferMode.BLOOM_JOIN, TransferMode.PT, TransferMode.RPT, TransferMode.RPT_RANDOM_ROOT):
    query(f"transfer_{_m.value}_q3", _Q3)(lambda s, d, m=_m: _q3(s, d, m))
    query(f"transfer_{_m.value}_q5", _Q5)(lambda s, d, m=_m: _q5(s, d, m))
for _o in (JoinOrder.LEFT_DEEP, JoinOrder.RANDOM_LEFT_DEEP, JoinOrder.RANDOM_BUSHY):
    query(f"transfer_rpt_q5_{_o.value}", _Q5)(lambda s, d, o=_o: _q5(s, d, TransferMode.RPT, o, 11))


@query("transfer_outer", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY c_custkey")
def transfer_outer(s, d):
    g = JoinGraph().add("c", table(s, d, "customer").filter("c_acctbal > 0").select("c_custkey")).add("o", table(s, d, "orders").filter("o_totalprice > 250000").select("o_custkey", "o_orderkey"))
    return g.join("c", "o", ("c_custkey", "o_custkey"), how="left").execute(TransferMode.RPT).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("q6_forecast", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def q6(s, d):
    return table(s, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'1998-01-01' and l_discount between 0.05D and 0.07D and l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("q10_returns", "SELECT c_custkey, c_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-04-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
def q10(s, d):
    g = (
        JoinGraph()
        .add("l", table(s, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount"))
        .add("o", table(s, d, "orders").filter("o_orderdate >= timestamp_ntz'1998-01-01' and o_orderdate < timestamp_ntz'1998-04-01'").select("o_orderkey", "o_custkey"))
        .add("c", table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"))
        .add("n", table(s, d, "nation").select("n_nationkey", "n_name"))
        .join("l", "o", ("l_orderkey", "o_orderkey"))
        .join("o", "c", ("o_custkey", "c_custkey"))
        .join("c", "n", ("c_nationkey", "n_nationkey"))
    )
    return g.execute(TransferMode.NONE).groupBy("c_custkey", "c_name", "n_name").agg(F.round(F.sum(_net()), 2).alias("revenue")).orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query("q12_priorities", "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY l_linestatus")
def q12(s, d):
    li = table(s, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'1999-01-01'").select("l_orderkey", "l_linestatus")
    hot = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return table(s, d, "orders").select("o_orderkey", "o_orderpriority").join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_linestatus").agg(F.count_if(hot).alias("high"), F.count_if(~hot).alias("low"))


@query("q13_order_counts", "SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'P' GROUP BY c_custkey) GROUP BY n")
def q13(s, d):
    o = table(s, d, "orders").filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.coalesce("n", F.lit(0)).alias("n")).agg(F.count("*").alias("customers"))


@query("q18_large_orders", "SELECT c_name, o_orderkey, round(sum(l_quantity), 2) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, o_orderkey")
def q18(s, d):
    big = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).filter("q > 200")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(big, F.col("o_orderkey") == F.col("l_orderkey"))
    # order keys repeat in neither side here, so the sum per order is that of the inner query
    return o.join(table(s, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_name", "o_orderkey").agg(F.round(F.sum("q"), 2).alias("q"))
