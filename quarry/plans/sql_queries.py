"""Queries in the engine's own dialect: the same text goes to `quarry.sql` and to the oracle."""

from __future__ import annotations

from quarry.operators.transfer import TransferMode
from quarry.session import register
from quarry.sql import sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

TEXTS = {
    "sql_casts": "SELECT p_partkey, p_size::VARCHAR || '!' AS s, (p_retailprice * 10)::BIGINT AS b, CAST(p_size AS DOUBLE) AS d, TRY_CAST(p_name AS INTEGER) AS n FROM part",
    "sql_from_first": "FROM nation SELECT n_name, n_regionkey WHERE n_nationkey < 10",
    "sql_exclude": "SELECT * EXCLUDE (p_retailprice, p_type) FROM part",
    "sql_lists": "SELECT p_partkey, [p_size, 2, 3][1] AS a, array_length(string_split(p_name, ' ')) AS n, len(p_name) AS w, array_to_string([x * 2 for x in [p_size, 1, 7] if x > 1], ',') AS c, array_to_string([p_size, 5, 6, 7][2:3], '-') AS s, list_contains([1, 2, p_size], 7) AS h FROM part",
    "sql_structs": "SELECT p_partkey, {'a': p_size, 'b': p_name}.b AS b, MAP {'k': p_size}['k'] AS m FROM part",
    "sql_lambda": "SELECT p_partkey, array_to_string(list_transform([p_size, 3], lambda x: x + 1), ',') AS t FROM part",
    "sql_division": "SELECT p_partkey, p_partkey // 7 AS q, round(p_partkey / 7, 6) AS d, p_size ** 2 AS p, p_partkey % 7 AS m FROM part",
    "sql_qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "sql_distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice, o_orderkey",
    "sql_group_all": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS c, max(o_orderdate) AS d FROM orders GROUP BY ALL HAVING count(*) > 5",
    "sql_order_nulls": "SELECT nullif(p_size, 5) AS k, p_partkey FROM part ORDER BY k DESC, p_partkey LIMIT 30",
    "sql_joins": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name",
    "sql_semi_anti": "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "sql_subqueries": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer WHERE c_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_name LIKE '%A%')",
    "sql_with": "WITH big AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), few AS (FROM big WHERE s > 500000) SELECT count(*) AS n FROM few",
    "sql_recursive": "WITH RECURSIVE t(i, f) AS (SELECT 1, 1 UNION ALL SELECT i + 1, f * 2 FROM t WHERE i < 20) SELECT i, f FROM t",
    "sql_sets": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 ORDER BY k",
    "sql_windows": "SELECT event_id, sum(value::DECIMAL(18,4)) OVER w AS s, lag(event_id) OVER w AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "sql_json": "SELECT event_id, props->>'k' AS k, json_extract_string(props, '$.k') AS e FROM events",
    "sql_dates": "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, extract(year FROM o_orderdate) AS y, o_orderdate + INTERVAL '2 days' AS d, monthname(o_orderdate) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'",
    "sql_patterns": "SELECT p_partkey, p_type GLOB 'S*' AS g, p_type SIMILAR TO '(S|L).*' AS s, p_name ILIKE '%A%' AS i, regexp_matches(p_name, '[xyz]') AS r FROM part",
    "sql_range": "SELECT range * 3 AS x FROM range(5, 500, 5) WHERE range % 2 = 0",
    "sql_aggregates": "SELECT l_returnflag, arg_max(l_orderkey, l_orderkey * 100 + l_linenumber) AS a, md5(string_agg(l_linenumber::VARCHAR, '-' ORDER BY l_orderkey, l_linenumber, l_partkey)) AS g, round(median(l_quantity), 3) AS m, count(*) FILTER (WHERE l_tax > 0.04) AS f FROM lineitem GROUP BY l_returnflag",
    "sql_percent": "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20%",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "sql_asof": "SELECT e.event_id, v.pid, v.pts FROM events e ASOF JOIN (SELECT user_id AS u, ts AS pts, max(event_id) AS pid FROM events WHERE event_type = 'view' GROUP BY ALL) v ON e.user_id = v.u AND e.ts >= v.pts WHERE e.event_type = 'purchase'",
    "sql_asof_left": "SELECT * FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id AS u, ts AS pts, max(event_id) AS pid FROM events WHERE event_type = 'view' GROUP BY ALL) v ON v.u = e.user_id AND v.pts > e.ts",
    "sql_positional": "SELECT * FROM (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 30) a POSITIONAL JOIN (SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey) b",
    "sql_union_by_name": "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL BY NAME SELECT n_name AS name, n_nationkey AS n FROM nation UNION ALL BY NAME SELECT s_suppkey AS k FROM supplier",
    "sql_union_by_name_distinct": "WITH a AS (SELECT c_nationkey AS k, 1 AS x FROM customer) SELECT * FROM a UNION BY NAME SELECT 1 AS x, s_nationkey AS k FROM supplier ORDER BY k",
    "sql_ordered_aggregates": "SELECT l_suppkey, array_to_string(list(l_linenumber ORDER BY l_orderkey DESC, l_partkey, l_linenumber DESC), ',') AS a, string_agg(l_returnflag, '-' ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) AS b, array_to_string(list(l_partkey ORDER BY nullif(l_linenumber, 3) DESC NULLS FIRST, l_orderkey, l_partkey), ',') AS c, array_to_string(list(l_partkey ORDER BY nullif(l_linenumber, 3), l_orderkey, l_partkey), ',') AS d, first(l_orderkey ORDER BY l_extendedprice DESC, l_orderkey) AS f FROM lineitem GROUP BY l_suppkey",
    "sql_quantified": "SELECT p_partkey, p_size > ANY (SELECT s_nationkey FROM supplier) AS a, p_size <= ALL (SELECT n_nationkey FROM nation) AS b, p_size < ANY (SELECT nullif(n_nationkey, 3) FROM nation) AS c, p_size >= ALL (SELECT n_nationkey FROM nation WHERE false) AS d FROM part WHERE p_size <> ALL (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
    "sql_ordinals": "SELECT n_name, n_regionkey FROM nation ORDER BY #2 DESC, #1 LIMIT 7",
    "sql_slices_down": "SELECT p_partkey, array_to_string([p_size, 2, 3, 4, 5][5:1:-2], ',') AS a, array_to_string([p_size, 2, 3][:-:-1], ',') AS b, array_to_string([p_size, 2, 3, 4][4:2:-1], ',') AS c FROM part",
    "sql_method_calls": "SELECT n_nationkey, n_name.lower().reverse() AS r FROM nation",
}


#: Run with transfer over the join graph that their text has.
TRANSFERRED = {
    "sql_transfer_local": "SELECT n_name, round(sum(l.l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders o, lineitem l, supplier s, nation AS n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s.s_nationkey = n_nationkey AND r_name = 'ASIA' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND (l_quantity > 5 OR l_tax > 0.01) GROUP BY n_name ORDER BY revenue DESC",
    "sql_transfer_with": "WITH big AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 3) SELECT c_name, n_name, big.n FROM customer c JOIN nation ON c.c_nationkey = n_nationkey JOIN big ON big.k = c_custkey WHERE n_name LIKE '%A%' AND c_acctbal > 0",
    "sql_transfer_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b, region WHERE a.n_regionkey = b.n_regionkey AND a.n_regionkey = r_regionkey AND r_name <> 'ASIA' AND a.n_nationkey < b.n_nationkey",
    "sql_transfer_outer": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3 GROUP BY c_custkey",
}


def _run(text: str, transfer=None):
    def run(spark, sf_dir):
        register(spark, sf_dir, *TABLES)
        return sql(spark, text, transfer)

    return run


QUERIES = {name: _run(text) for name, text in TEXTS.items()} | {name: _run(text, TransferMode.RPT) for name, text in TRANSFERRED.items()}
ORACLE_SQL = TEXTS | TRANSFERRED
