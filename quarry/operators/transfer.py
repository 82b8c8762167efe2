"""Predicate transfer: semi-join reduction over a whole join graph before any join runs.

A join graph has relations (DataFrames with their local filters) and edges (equal columns). Transfer
walks the graph twice, first towards the root and then away from it; on each step one relation is
filtered by a Bloom filter over the join keys of its neighbour. On a tree this leaves hardly a row
that will not join, whatever join order follows. Bloom filters have false positives only and the
real joins still run, so results never change.

Modes:
  NONE        no reduction
  BLOOM_JOIN  each edge reduces its larger side by its smaller one, once
  PT          all edges point from small to large; forward, then backward
  RPT         a maximum spanning tree rooted at the largest relation; leaves to root, then back

A Bloom filter is built where its rows are (an aggregate whose partial results are merged by Spark)
and has at most MOST_BITS bits, whatever the data; past the size where it would let too much
through, the reduction is a semi-join instead, which Spark plans by size. Filters are scalar subqueries
of the plan that uses them: the driver starts no job for a step, and equal subqueries run once.

Relations are sized by their rows after their own filters, counted once for each plan (a scan of the
filters' columns); beyond COUNT_BYTES, where filters have their greatest size anyhow, by their bytes.
The left-deep order is the one of the fewest estimated rows in between, by those counts and the distinct
keys of each edge. A relation that nothing has filtered, neither its plan nor a step before, reduces no other: on
foreign keys it could not.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, LEAST_BITS, MOST_BITS, COUNT_BYTES = 8, 512, 1 << 26, 4 << 30
#: A relation of fewer rows is not worth a filter that only its own joins would use.
LEAST_TARGET = 10_000
#: Sets of joined relations that the search for a left-deep order keeps of each size, the cheapest ones.
MOST_SETS = 1000
_ROWS: dict[int, float] = {}
_DISTINCT: dict[tuple, float | None] = {}


class TransferMode(Enum):
    NONE = "none"
    BLOOM_JOIN = "bloom_join"
    PT = "pt"
    RPT = "rpt"
    RPT_RANDOM_ROOT = "rpt_random_root"


class JoinOrder(Enum):
    CATALYST = "catalyst"
    LEFT_DEEP = "left_deep"
    RANDOM_LEFT_DEEP = "random_left_deep"
    RANDOM_BUSHY = "random_bushy"


@dataclass
class Relation:
    name: str
    df: DataFrame
    rows: float


@dataclass
class Edge:
    """left.lcol = right.rcol for every pair in `on`."""

    left: str
    right: str
    on: list[tuple[str, str]]
    how: str = "inner"

    def may_reduce(self, name: str) -> bool:
        """Whether `name` may lose rows that the other side does not match."""
        if name == self.left:
            return self.how in ("inner", "right", "left_semi")
        return self.how in ("inner", "left", "left_semi", "left_anti")

    def other(self, name: str) -> str:
        return self.right if name == self.left else self.left

    def keys(self, name: str) -> list[str]:
        return [a if name == self.left else b for a, b in self.on]


@dataclass
class Step:
    """Filter `target` by the keys of `source`."""

    source: str
    target: str
    edge: Edge


@dataclass
class JoinGraph:
    relations: dict[str, Relation] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)

    def add(self, name: str, df: DataFrame, rows: float | None = None) -> JoinGraph:
        """rows: an estimate; else the optimizer's size of the plan, which needs no job."""
        self.relations[name] = Relation(name, df, estimated(df) if rows is None else rows)
        return self

    def join(self, left: str, right: str, *on: str | tuple[str, str], how: str = "inner") -> JoinGraph:
        self.edges.append(Edge(left, right, [(c, c) if isinstance(c, str) else c for c in on], how))
        return self

    # Schedules

    def _size(self, name: str) -> tuple[float, str]:
        return (self.relations[name].rows, name)

    def spanning_tree(self, rng: random.Random | None = None) -> list[tuple[str, str, Edge]]:
        """(parent, child, edge) from the largest relation of each connected part on, growing by the
        largest relation in reach; with rng from any relation on, by the same growth."""
        out, done = [], set()
        roots = sorted(self.relations, key=self._size, reverse=True)
        if rng:
            rng.shuffle(roots)
        for root in roots:
            if root in done:
                continue
            done.add(root)
            while reach := [(e.other(n), n, e) for e in self.edges for n in (e.left, e.right) if n in done and e.other(n) not in done]:
                child, parent, edge = max(reach, key=lambda x: self._size(x[0]))
                done.add(child)
                out.append((parent, child, edge))
        return out

    def schedule(self, mode: TransferMode, seed: int = 0) -> list[Step]:
        """Every step of the mode, in order. The seed chooses a random root."""
        if mode is TransferMode.NONE:
            return []
        if mode in (TransferMode.RPT, TransferMode.RPT_RANDOM_ROOT):
            tree = self.spanning_tree(random.Random(seed) if mode is TransferMode.RPT_RANDOM_ROOT else None)
            forward = [(c, p, e) for p, c, e in reversed(tree)]
        else:
            directed = [(*sorted((e.left, e.right), key=self._size), e) for e in self.edges]
            forward = sorted(directed, key=lambda x: (self._size(x[0]), self._size(x[1])))
        back = [] if mode is TransferMode.BLOOM_JOIN else [(b, a, e) for a, b, e in reversed(forward)]
        return [Step(a, b, e) for a, b, e in [*forward, *back] if a != b and e.may_reduce(b)]

    def reduce(self, mode: TransferMode, seed: int = 0) -> dict[str, DataFrame]:
        """The relations after transfer. Left out are steps from a relation that is still whole, and those
        to a small one that filters no other afterwards."""
        now = {n: r.df for n, r in self.relations.items()}
        steps = self.schedule(mode, seed)
        less = {n for n, r in self.relations.items() if not steps or _filtered(r.df)}
        for k, step in enumerate(steps):
            last = all(s.source != step.target for s in steps[k + 1 :])
            if step.source in less and not (last and self.relations[step.target].rows < LEAST_TARGET):
                now[step.target] = semi_reduce(now[step.target], step.edge.keys(step.target), now[step.source], step.edge.keys(step.source), self.relations[step.source].rows)
                less.add(step.target)
        return now

    # Joins

    def order(self, how: JoinOrder, seed: int = 0) -> list[str] | tuple:
        """Names in a left-deep order, or a nested pair for a bushy one. Orders never hold a cross join
        within a connected graph."""
        if how is JoinOrder.LEFT_DEEP:
            return self._left_deep()
        rng = random.Random(seed)
        near = self._near()
        if how is JoinOrder.RANDOM_BUSHY:
            parts: list[tuple[set, object]] = [({n}, n) for n in sorted(self.relations)]
            while len(parts) > 1:
                pairs = [(i, j) for i in range(len(parts)) for j in range(len(parts)) if i != j and any(near[a] & parts[j][0] for a in parts[i][0])]
                i, j = rng.choice(pairs or [(0, 1)])
                joined = (parts[i][0] | parts[j][0], (parts[i][1], parts[j][1]))
                parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [joined]
            return parts[0][1]
        names = sorted(self.relations, key=self._size)
        out = [rng.choice(names)]
        while len(out) < len(names):
            left = [n for n in names if n not in out]
            out.append(rng.choice([n for n in left if near[n] & set(out)] or left))
        return out

    def _near(self) -> dict[str, set[str]]:
        return {n: {e.other(n) for e in self.edges if n in (e.left, e.right)} for n in self.relations}

    def _left_deep(self) -> list[str]:
        """The order whose joins give the fewest rows in all, the larger relation first. A join gives the product of
        both sides over the greater distinct count of each edge between them: keys that few values share, as
        a nation's, meet last or together with others. By dynamic programming over sets of relations."""
        names, near = sorted(self.relations, key=self._size, reverse=True), self._near()
        values = self._distinct()
        level = {frozenset([n]): (0.0, k, self.relations[n].rows, [n]) for k, n in enumerate(names)}
        for _ in names[1:]:
            more: dict[frozenset, tuple] = {}
            for done, (cost, first, rows, order) in sorted(level.items(), key=lambda x: x[1])[:MOST_SETS]:
                rest = [n for n in names if n not in done]
                for n in [n for n in rest if near[n] & done] or rest:
                    share: dict[tuple, float] = {}  # edges on the same keys of n are one condition
                    for e in self.edges:
                        if n in (e.left, e.right) and e.other(n) in done:
                            keys = tuple(e.keys(n))
                            share[keys] = max(share.get(keys, 1.0), self._most_distinct(e, values))
                    out = rows * self.relations[n].rows
                    for x in share.values():
                        out /= x
                    found = (cost + out, first, out, [*order, n])
                    more[done | {n}] = min(found, more.get(done | {n}, found))
            level = more
        return min(level.values())[3] if level else []

    def _most_distinct(self, e: Edge, values: dict[tuple, float | None]) -> float:
        """The greater distinct count of an edge's sides; of uncounted sides, the fewer rows."""
        known = [x for n in (e.left, e.right) if (x := values[n, tuple(e.keys(n))]) is not None]
        return max([1.0, *(known or [min(self.relations[n].rows for n in (e.left, e.right))])])

    def _distinct(self) -> dict[tuple, float | None]:
        """Distinct values, to a few hundredths, of each relation's join keys."""
        keys = {n: sorted({tuple(e.keys(n)) for e in self.edges if n in (e.left, e.right)}) for n in self.relations}
        return {(n, k): x for n, ks in keys.items() for k, x in zip(ks, distinct_keys(self.relations[n].df, ks), strict=True)}

    def execute(self, mode: TransferMode = TransferMode.RPT, order: JoinOrder = JoinOrder.CATALYST, seed: int = 0) -> DataFrame:
        """Joins of the reduced relations; all columns, the right side's equal join columns dropped if
        they share a name. Outer, semi and anti edges are taken in the order they were declared, so
        graphs that have one ignore `order`."""
        now = self.reduce(mode, seed)
        if any(e.how != "inner" for e in self.edges) or order is JoinOrder.CATALYST:
            return self._declared(now)
        plan = self.order(order, seed)
        if isinstance(plan, list):
            tree: object = plan[0]
            for n in plan[1:]:
                tree = (tree, n)
            plan = tree
        return self._join(plan, now)[1]

    def _declared(self, now: dict[str, DataFrame]) -> DataFrame:
        first = self.edges[0].left if self.edges else next(iter(self.relations))
        names, out, left = {first}, now[first], list(self.edges)
        while left:
            e = next((e for e in left if e.left in names or e.right in names), None)
            if e is None:  # a part of the graph that no edge connects with the others
                out = out.crossJoin(now[left[0].left])
                names.add(left[0].left)
                continue
            left.remove(e)
            if e.left in names and e.right in names:
                out = out.filter(_equal(out, out, e.on))
                continue
            new, how = e.other(e.left if e.left in names else e.right), e.how
            if e.left == new:
                how = {"left": "right", "right": "left"}.get(how, how)
            more = [x for x in left if new in (x.left, x.right) and x.other(new) in names and x.how == "inner" == e.how]
            for x in more:
                left.remove(x)
            on = [(a, b) if x.right == new else (b, a) for x in [e, *more] for a, b in x.on]
            out = _join(out, now[new], on, how)
            names.add(new)
        for n in self.relations:
            out = out if n in names else out.crossJoin(now[n])
        return out

    def _join(self, plan, now: dict[str, DataFrame]) -> tuple[set[str], DataFrame]:
        if isinstance(plan, str):
            return {plan}, now[plan]
        (ln, l), (rn, r) = self._join(plan[0], now), self._join(plan[1], now)
        on = [(a, b) if e.left in ln else (b, a) for e in self.edges if (e.left in ln and e.right in rn) or (e.left in rn and e.right in ln) for a, b in e.on]
        return ln | rn, _join(l, r, on, "inner") if on else l.crossJoin(r)


def _equal(a: DataFrame, b: DataFrame, on: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for x, y in on:
        out = out & (a[x] == b[y])
    return out


def _join(a: DataFrame, b: DataFrame, on: list[tuple[str, str]], how: str) -> DataFrame:
    if all(x == y for x, y in on):
        return a.join(b, [x for x, _ in dict.fromkeys(on)], how)
    return a.join(b, _equal(a, b, on), how)


def _filtered(df: DataFrame) -> bool:
    """Whether a plan may hold fewer rows than its tables: it has more than scans and projections."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while True:
        name, below = plan.nodeName(), plan.children()
        if below.size() == 0:
            return name not in ("LogicalRelation", "Relation", "DataSourceV2Relation", "DataSourceV2ScanRelation") and not name.startswith(("Relation", "LogicalRelation"))
        if name not in ("Project", "SubqueryAlias", "ResolvedHint") or below.size() > 1:
            return True
        plan = below.head()


def estimated(df: DataFrame) -> float:
    """The rows of a plan: counted, once for each plan; of more than COUNT_BYTES, its bytes over a row's width."""
    key = df.semanticHash()
    if key not in _ROWS:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        size = float(str(stats.sizeInBytes()))
        _ROWS[key] = float(df.count()) if size <= COUNT_BYTES else 4 * size / max(8, 8 * len(df.columns))
    return _ROWS[key]


def distinct_keys(df: DataFrame, keys: list[tuple[str, ...]]) -> list[float | None]:
    """About how many values each key has, by one scan of the keys for each plan; None where a plan is beyond COUNT_BYTES."""
    plan = df.semanticHash()
    if any((plan, k) not in _DISTINCT for k in keys):
        small = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= COUNT_BYTES
        found = df.agg(*[F.approx_count_distinct(_key([F.col(c) for c in k])) for k in keys]).first() if small else [None] * len(keys)
        _DISTINCT.update({(plan, k): x if x is None else float(x) for k, x in zip(keys, found, strict=True)})
    return [_DISTINCT[plan, k] for k in keys]


def _key(columns: list[Column]) -> Column:
    return F.xxhash64(*columns)


def bloom_filter(df: DataFrame, keys: list[str], rows: float) -> Column:
    """Bits over the hash of the keys, or null for no rows, as a scalar subquery. Merged in partial aggregates."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(BITS_PER_KEY * rows)))
    jvm = df.sparkSession._jvm
    util = jvm.org.apache.spark.sql.classic.ExpressionUtils
    hashed = df.select(_key([F.col(k) for k in keys]).alias("h"))
    agg = jvm.org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate(
        util.expression(F.col("h")._jc),
        util.expression(F.lit(max(1, int(bits / BITS_PER_KEY))).cast("long")._jc),
        util.expression(F.lit(bits).cast("long")._jc),
    )
    return hashed.agg(Column(util.column(agg.toAggregateExpression())).alias("b")).scalar()


def might_contain(bloom: Column, keys: list[str], spark) -> Column:
    jvm = spark._jvm
    util = jvm.org.apache.spark.sql.classic.ExpressionUtils
    expr = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(util.expression(bloom._jc), util.expression(_key([F.col(k) for k in keys])._jc))
    return Column(util.column(expr))


def semi_reduce(target: DataFrame, target_keys: list[str], source: DataFrame, source_keys: list[str], source_rows: float) -> DataFrame:
    """Rows of target whose keys may be among those of source; never drops one that is.

    Null keys join nothing and go. A source of no rows leaves no rows: its filter is null.
    """
    there = target.dropna(subset=target_keys)
    if BITS_PER_KEY * source_rows > 4 * MOST_BITS:  # the filter would be full: let Spark plan a semi-join
        keys = source.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(source_keys)]).distinct()
        return there.join(keys, _equal(there, keys, [(k, f"__k{i}") for i, k in enumerate(target_keys)]), "left_semi")
    bloom = bloom_filter(source.dropna(subset=source_keys), source_keys, source_rows)
    return there.filter(might_contain(bloom, target_keys, target.sparkSession))
