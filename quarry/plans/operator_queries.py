"""Operators over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import call as f
from quarry.operators import aggregates as A
from quarry.operators import joins as J
from quarry.operators import relational as R
from quarry.operators import windows as W
from quarry.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None):
    def put(of):
        QUERIES[name] = of
        if sql:
            ORACLE_SQL[name] = sql
        return of

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


# Projection and filters


@query("projection_filter", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('A', 'R')")
def projection_filter(s, d):
    return t(s, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1998-01-01' and l_discount between 0.02 and 0.06 and l_returnflag in ('A', 'R')").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("predicates_3vl", "SELECT p_partkey, nullif(p_size, 10) IS DISTINCT FROM 10 AS d, nullif(p_size, 10) IS NOT DISTINCT FROM NULL AS nd, coalesce(nullif(p_size, 10), -1) AS co, CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 30 THEN 'mid' ELSE 'high' END AS band, p_size NOT IN (1, 2, 3) AS ni, (nullif(p_size, 10) > 5) IS TRUE AS tr, (nullif(p_size, 10) > 5) IS NULL AS un, TRY_CAST(p_name AS INTEGER) AS bad, ifnull(nullif(p_size, 10), 0) AS ifn FROM part")
def predicates_3vl(s, d):
    n = F.nullif(F.col("p_size"), F.lit(10))
    return t(s, d, "part").select(
        "p_partkey", (~n.eqNullSafe(F.lit(10))).alias("d"), n.eqNullSafe(F.lit(None)).alias("nd"), F.coalesce(n, F.lit(-1)).alias("co"),
        F.when(F.col("p_size") < 10, "low").when(F.col("p_size") < 30, "mid").otherwise("high").alias("band"), (~F.col("p_size").isin(1, 2, 3)).alias("ni"),
        F.coalesce(n > 5, F.lit(False)).alias("tr"), (n > 5).isNull().alias("un"), F.col("p_name").try_cast("int").alias("bad"), F.ifnull(n, F.lit(0)).alias("ifn"),
    )


@query("star_exclude_replace", "SELECT * EXCLUDE (p_retailprice) REPLACE (p_size + 1 AS p_size) FROM part")
def star_exclude_replace(s, d):
    return t(s, d, "part").drop("p_retailprice").withColumn("p_size", F.col("p_size") + 1)


@query("collate_nocase", "SELECT p_type, lower(p_brand) AS b, count(*) AS n FROM part WHERE p_brand COLLATE NOCASE = 'BRAND#12' OR p_brand COLLATE NOCASE > 'brand#3' GROUP BY ALL")
def collate_nocase(s, d):
    b = F.lower("p_brand")
    return t(s, d, "part").filter((b == "brand#12") | (b > "brand#3")).groupBy("p_type", b.alias("b")).agg(F.count("*").alias("n"))


@query("unnest_zipped", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest([p_size, 1, 2]) AS k FROM part")
def unnest_zipped(s, d):
    df = t(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"), F.array("p_size", F.lit(1), F.lit(2)).alias("k"))
    return R.unnest(df, "w", "k")


@query("pivot", "SELECT l_returnflag, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), NULL) AS F, sum(l_quantity) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def pivot(s, d):
    df = t(s, d, "lineitem").withColumn("l_quantity", F.col("l_quantity"))
    return R.pivot(df, "l_linestatus", R.pivot_values(df, "l_linestatus"), F.sum, "l_quantity", ["l_returnflag"])


@query("unpivot", "SELECT * FROM (UNPIVOT (SELECT s_suppkey, s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier) ON nation, balance INTO NAME name VALUE value)")
def unpivot(s, d):
    return R.unpivot(t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance")), ["nation", "balance"])


@query("sample_bernoulli", None)
def sample_bernoulli(s, d):
    return R.sample(t(s, d, "lineitem"), percent=10)


@query("sample_reservoir", None)
def sample_reservoir(s, d):
    return R.sample(t(s, d, "orders"), rows=100)


# Joins


@query("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(s, d):
    c = t(s, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return t(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
def join_left(s, d):
    o = t(s, d, "orders").filter("o_totalprice > 300000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("join_right", "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(s, d):
    return t(s, d, "supplier").filter("s_acctbal > 5000").join(t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("join_full", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM (SELECT p_partkey FROM part WHERE p_size < 20) a FULL JOIN (SELECT p_partkey FROM part WHERE p_size > 10) b ON a.p_partkey = b.p_partkey")
def join_full(s, d):
    p = t(s, d, "part")
    return p.filter("p_size < 20").select(F.col("p_partkey").alias("a")).join(p.filter("p_size > 10").select(F.col("p_partkey").alias("b")), F.col("a") == F.col("b"), "full")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join_using_self", "SELECT r_name, count(*) AS n FROM nation a JOIN nation b USING (n_regionkey) JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def join_using_self(s, d):
    n = t(s, d, "nation").select("n_regionkey")
    return n.join(n, "n_regionkey").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(s, d):
    return t(s, d, "region").crossJoin(t(s, d, "nation")).select("r_name", "n_name")  # 5 and 25 rows at any scale


@query("join_positional", "SELECT a.s_suppkey, b.n_name FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) a FULL JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) b USING (i)")
def join_positional(s, d):
    return J.positional_join(t(s, d, "supplier").select("s_suppkey"), t(s, d, "nation").select("n_nationkey", "n_name"), ["s_suppkey"], ["n_nationkey"]).select("s_suppkey", "n_name")


_PRICES = "(SELECT user_id AS u, ts AS pts, max(event_id) AS pid FROM events WHERE event_type = 'view' GROUP BY ALL)"


def _asof(s, d, how, op):
    e = t(s, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").groupBy(F.col("user_id").alias("u"), F.col("ts").alias("pts")).agg(F.max("event_id").alias("pid"))
    return J.asof_join(left, right, "ts", "pts", [("user_id", "u")], how, op).select("event_id", "pid", "pts")


@query("join_asof", f"SELECT event_id, pid, pts FROM events ASOF JOIN {_PRICES} v ON user_id = u AND ts >= pts WHERE event_type = 'purchase'")
def join_asof(s, d):
    return _asof(s, d, "inner", ">=")


@query("join_asof_left", f"SELECT event_id, pid, pts FROM (SELECT * FROM events WHERE event_type = 'purchase') ASOF LEFT JOIN {_PRICES} v ON user_id = u AND ts > pts")
def join_asof_left(s, d):
    return _asof(s, d, "left", ">")


@query("join_asof_forward", f"SELECT event_id, pid, pts FROM events ASOF JOIN {_PRICES} v ON user_id = u AND ts <= pts WHERE event_type = 'purchase'")
def join_asof_forward(s, d):
    return _asof(s, d, "inner", "<=")


@query("join_asof_right", f"SELECT event_id, pid, pts FROM (SELECT * FROM events WHERE event_type = 'purchase') ASOF RIGHT JOIN {_PRICES} v ON user_id = u AND ts >= pts")
def join_asof_right(s, d):
    return _asof(s, d, "right", ">=")


@query("join_asof_within", f"SELECT event_id, CASE WHEN ts - pts <= INTERVAL 6 HOUR THEN pid END AS pid FROM (SELECT * FROM events WHERE event_type = 'purchase') ASOF LEFT JOIN {_PRICES} v ON user_id = u AND ts >= pts")
def join_asof_within(s, d):
    e = t(s, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").groupBy(F.col("user_id").alias("u"), F.col("ts").alias("pts")).agg(F.max("event_id").alias("pid"))
    return J.asof_join_within(left, right, "ts", "pts", [("user_id", "u")], 6 * 3600).select("event_id", "pid")


@query("join_range", "SELECT p_partkey, low FROM part JOIN (SELECT s_acctbal / 5 AS low, s_acctbal / 5 + 20 AS high FROM supplier) ON p_retailprice >= low AND p_retailprice < high")
def join_range(s, d):
    r = t(s, d, "supplier").select((F.col("s_acctbal") / 5).alias("low"), (F.col("s_acctbal") / 5 + 20).alias("high"))
    return J.range_join(t(s, d, "part"), r, "p_retailprice", "low", "high", 20.0).select("p_partkey", "low")


@query("join_overlap", "SELECT a.s_suppkey AS a, b.c_custkey AS b FROM supplier a JOIN customer b ON a.s_acctbal < b.c_acctbal + 50 AND b.c_acctbal < a.s_acctbal + 50")
def join_overlap(s, d):
    a = t(s, d, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("al"), (F.col("s_acctbal") + 50).alias("ah"))
    b = t(s, d, "customer").select(F.col("c_custkey").alias("b"), F.col("c_acctbal").alias("bl"), (F.col("c_acctbal") + 50).alias("bh"))
    return J.overlap_join(a, b, ("al", "ah"), ("bl", "bh"), 50.0).select("a", "b")


@query("join_inequality", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey")
def join_inequality(s, d):
    n, r = t(s, d, "nation"), t(s, d, "region")
    return J.inequality_join(n, r, n["n_regionkey"] > r["r_regionkey"]).select("n_name", "r_name")


@query("join_mark", "SELECT p_partkey, nullif(p_size, 3) IN (SELECT nullif(s_nationkey, 7) FROM supplier) AS mark FROM part")
def join_mark(s, d):
    p = t(s, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(3)).alias("k"))
    return J.mark_join(p, t(s, d, "supplier").select(F.nullif(F.col("s_nationkey"), F.lit(7)).alias("n")), "k", "n").select("p_partkey", "mark")


@query("join_single", "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS one FROM customer")
def join_single(s, d):
    return J.single_join(t(s, d, "customer"), t(s, d, "orders"), [("c_custkey", "o_custkey")], "o_orderkey", "one").select("c_custkey", "one")


@query("join_lateral", "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)")
def join_lateral(s, d):
    best = R.top_n_per_group(t(s, d, "orders"), ["o_custkey"], 2, "-o_totalprice", "o_orderkey")
    return t(s, d, "customer").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("join_salted", "SELECT l_orderkey, l_linenumber, l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_salted(s, d):
    return J.salted_join(t(s, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey"), t(s, d, "supplier"), ["s_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "s_name")


@query("subquery_all_any", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size = 5) OR p_size = ANY (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def subquery_all_any(s, d):
    p = t(s, d, "part")
    top = p.filter("p_size = 5").agg(F.max("p_retailprice").alias("m"))
    keys = t(s, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("k")).distinct().withColumn("hit", F.lit(True))
    return p.crossJoin(F.broadcast(top)).join(keys, F.col("p_size") == F.col("k"), "left").filter("m is null or p_retailprice >= m or hit").select("p_partkey")


@query("correlated_average", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
def correlated_average(s, d):
    li = t(s, d, "lineitem")
    mean = li.groupBy("l_partkey").agg((F.avg("l_quantity") * 0.5).alias("m"))
    return li.join(mean, "l_partkey").filter("l_quantity < m").select("l_orderkey", "l_linenumber", "l_partkey")


# Aggregation


@query("group_by", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL HAVING count(*) > 10")
def group_by(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).filter("n > 10")


@query("ungrouped", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem")
def ungrouped(s, d):
    return t(s, d, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(s, d):
    df = t(s, d, "lineitem")
    cols = [F.col("l_returnflag"), F.col("l_linestatus")]
    return df.groupingSets([cols, cols[:1], []], *cols).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


@query("cube", "SELECT o_orderstatus, o_orderpriority, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(s, d):
    return t(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.sum("o_custkey").alias("s"))


@query("rollup", "SELECT r_name, n_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup(s, d):
    return t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("distinct_on", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1")
def distinct_on(s, d):
    return R.distinct_on(t(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("agg_mad", "SELECT l_returnflag, round(mad(l_extendedprice), 4) AS mad FROM lineitem GROUP BY l_returnflag")
def agg_mad(s, d):
    return A.mad(t(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_returnflag", F.round("mad", 4).alias("mad"))


@query("agg_entropy", "SELECT l_returnflag, round(entropy(l_partkey), 6) AS entropy FROM lineitem GROUP BY l_returnflag")
def agg_entropy(s, d):
    return A.entropy(t(s, d, "lineitem"), ["l_returnflag"], "l_partkey").select("l_returnflag", F.round("entropy", 6).alias("entropy"))


@query("agg_histogram", "SELECT l_returnflag, l_suppkey AS bucket, count(*) AS count FROM lineitem GROUP BY ALL")
def agg_histogram(s, d):
    return A.histogram(t(s, d, "lineitem"), ["l_returnflag"], "l_suppkey")


@query("approximate", "SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS close FROM events GROUP BY event_type")
def approximate(s, d):
    a, n = f("approx_count_distinct", F.col("user_id")), F.count_distinct("user_id")
    return t(s, d, "events").groupBy("event_type").agg((F.abs(a - n) <= 0.1 * n).alias("close"))


@query("summarize", "SELECT column_name, CAST(min AS VARCHAR) AS min, CAST(count AS BIGINT) AS count FROM (SUMMARIZE SELECT o_orderkey, o_custkey, o_orderstatus FROM orders)")
def summarize(s, d):
    return R.summarize(t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")).select("column_name", "min", "count")


# Windows


@query("window_ranks", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS r, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)")
def window_ranks(s, d):
    w, v = W.window(["o_orderstatus"], ["o_orderdate", "o_orderkey"]), W.window(["o_orderstatus"], ["o_orderdate"])
    long = lambda c: c.cast("long")
    return t(s, d, "orders").select("o_orderkey", long(F.row_number().over(w)).alias("rn"), long(F.rank().over(v)).alias("r"), long(F.dense_rank().over(v)).alias("dr"), F.round(F.percent_rank().over(v), 9).alias("pr"), F.round(F.cume_dist().over(v), 9).alias("cd"), long(F.ntile(4).over(w)).alias("nt"))


@query("window_values", "SELECT event_id, lag(value, 2, -1) OVER w AS lg, lead(event_type) OVER w AS ld, first_value(event_id) OVER w AS fv, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv, nth_value(event_id, 3) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_values(s, d):
    w = W.window(["user_id"], ["ts", "event_id"])
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t(s, d, "events").select("event_id", F.lag("value", 2, -1.0).over(w).alias("lg"), F.lead("event_type").over(w).alias("ld"), F.first("event_id").over(w).alias("fv"), F.last("event_id").over(whole).alias("lv"), F.nth_value("event_id", 3).over(w).alias("nv"))


@query("window_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n, max(value) FILTER (event_type = 'view') OVER (PARTITION BY user_id) AS m FROM events")
def window_frames(s, d):
    w = W.window(["user_id"], ["ts", "event_id"]).rowsBetween(-2, 1)
    day = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    m = F.max(F.when(F.col("event_type") == "view", F.col("value"))).over(Window.partitionBy("user_id"))
    return t(s, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("s"), F.count("*").over(day).alias("n"), m.alias("m"))


@query("window_ignore_nulls", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lp FROM events")
def window_ignore_nulls(s, d):
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return t(s, d, "events").select("event_id", F.last(bought, True).over(W.window(["user_id"], ["ts", "event_id"])).alias("lp"))


@query("window_exclude", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW), 4) AS s FROM events")
def window_exclude(s, d):
    return t(s, d, "events").select("event_id", F.round(W.sum_excluding("value", ["user_id"], ["ts", "event_id"], -3, 3, "current"), 4).alias("s"))


@query("window_exclude_ties", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey // 4 ROWS BETWEEN 0 PRECEDING AND 0 FOLLOWING EXCLUDE TIES) AS BIGINT) AS s FROM orders")
def window_exclude_ties(s, d):
    df = t(s, d, "orders").withColumn("q", f("//", F.col("o_orderkey"), 4))
    return W.frame_excluding(df, "o_custkey", "s", ["o_orderpriority"], ["o_orderdate", "q"], 0, 0, "ties", lambda a: f("list_aggregate", a, "sum").cast("long")).select("o_orderkey", "s")


@query("window_distinct", "SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id) AS n FROM events")
def window_distinct(s, d):
    return t(s, d, "events").select("event_id", W.count_distinct_over("event_type", ["user_id"]).cast("long").alias("n"))


@query("window_running_distinct", "SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def window_running_distinct(s, d):
    df = W.with_first(t(s, d, "events"), "event_type", ["user_id"], ["ts", "event_id"])
    return df.select("event_id", W.running_distinct("event_type", ["user_id"], ["ts", "event_id"]).alias("n"))


@query("window_lead_by", "SELECT event_id, lead(event_id, CAST(user_id % 3 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ld FROM events")
def window_lead_by(s, d):
    df = t(s, d, "events").withColumn("k", F.col("user_id") % 3)
    return W.lead_by(df, "event_id", "k", "ld", ["user_id"], ["ts", "event_id"]).select("event_id", "ld")


@query("window_ntile_by", "SELECT event_id, ntile(user_id % 4 + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM events")
def window_ntile_by(s, d):
    df = t(s, d, "events").withColumn("k", F.col("user_id") % 4 + 1)
    return W.ntile_by(df, "k", "nt", ["user_id"], ["ts", "event_id"]).select("event_id", "nt")


@query("window_quantile", "SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS m FROM events")
def window_quantile(s, d):
    frame = F.collect_list("value").over(W.window(["user_id"], ["ts", "event_id"]).rowsBetween(-4, 0))
    return t(s, d, "events").withColumn("a", frame).select("event_id", F.round(f("list_aggregate", F.col("a"), "median"), 6).alias("m"))


@query("qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def qualify(s, d):
    return R.top_n_per_group(t(s, d, "orders"), ["o_custkey"], 3, "-o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


# Order, limits, sets


@query("order_limit", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25 OFFSET 5")
def order_limit(s, d):
    return R.top_n(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), 25, "-l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", offset=5)


@query("limit_percent", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i, count(*) OVER () AS n FROM orders) WHERE i <= floor(n * 0.4)")
def limit_percent(s, d):
    return R.limit_percent(t(s, d, "orders"), 40, "o_totalprice", "o_orderkey").select("o_orderkey")


@query("order_nulls", "SELECT k, row_number() OVER (ORDER BY k ASC NULLS LAST, p) AS i FROM (SELECT nullif(p_size, 5) AS k, p_partkey AS p FROM part)")
def order_nulls(s, d):
    df = t(s, d, "part").select(F.nullif(F.col("p_size"), F.lit(5)).alias("k"), F.col("p_partkey").alias("p"))
    return J.positions(df, ["k", "p"], "i").select("k", (F.col("i") + 1).alias("i"))


@query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(s, d, "supplier").select("s_nationkey"))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(s, d, "supplier").select("s_nationkey")).distinct()


@query("union_by_name", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL BY NAME SELECT n_name AS name, n_nationkey AS nk FROM nation")
def union_by_name(s, d):
    return R.union_by_name(t(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), t(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nk")))


for _op, _sql in (("except", "EXCEPT"), ("except_all", "EXCEPT ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL")):

    @query(_op, f"SELECT nullif(p_size, 3) AS k FROM part WHERE p_retailprice < 1500 {_sql} SELECT nullif(p_size, 3) FROM part WHERE p_type = 'SMALL' OR p_size < 4")
    def _set(s, d, op=_op):
        p = t(s, d, "part").withColumn("k", F.nullif(F.col("p_size"), F.lit(3)))
        a, b = p.filter("p_retailprice < 1500").select("k"), p.filter("p_type = 'SMALL' or p_size < 4").select("k")
        return {"except": a.subtract, "except_all": a.exceptAll, "intersect": a.intersect, "intersect_all": a.intersectAll}[op](b)


@query("recursive_cte", "WITH RECURSIVE r AS (SELECT 1 AS a, 1 AS b UNION SELECT b, (a + b) % 1000 FROM r WHERE b < 900) SELECT a, b FROM r")
def recursive_cte(s, d):
    from quarry.sources.tables import shared_folder

    shared_folder(s)
    return R.recursive(s.createDataFrame([(1, 1)], "a int, b int"), lambda r: r.filter("b < 900").selectExpr("b as a", "(a + b) % 1000 as b"))


@query("recursive_graph", "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey // 2 AS b FROM orders), r AS (SELECT a, b FROM e WHERE a > 100 UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, CAST(b AS BIGINT) AS b FROM r")
def recursive_graph(s, d):
    from quarry.sources.tables import shared_folder

    shared_folder(s)
    e = t(s, d, "orders").select(F.col("o_custkey").alias("a"), f("//", F.col("o_custkey"), 2).alias("b")).distinct()
    step = e.select(F.col("a").alias("m"), F.col("b").alias("to"))
    return R.recursive(e.filter("a > 100"), lambda r: r.join(step, F.col("b") == F.col("m")).select("a", F.col("to").alias("b")))
