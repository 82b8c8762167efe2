"""Scalar and aggregate functions by the engine's names, as expressions of Spark's own functions.

FUNCTIONS maps every name, aliases included, to a function of Columns; `call` looks names up. Values
follow the engine's rules where Spark's differ: lists keep nulls, indexes count from 1 with negative
ones from the end, x / 0 is null, weeks start on Monday, `concat` skips nulls.
"""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def named(*names: str):
    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return put


def call(name: str, *args, **kwargs) -> Column:
    return FUNCTIONS[name.lower()](*args, **kwargs)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _d(x) -> Column:
    return _c(x).cast("double")


# Aggregates

for _names, _f in {
    ("avg", "mean", "favg"): lambda x: F.avg(_d(x)),
    ("corr",): lambda y, x: F.corr(_d(y), _d(x)),
    ("covar_pop",): lambda y, x: F.covar_pop(_d(y), _d(x)),
    ("covar_samp",): lambda y, x: F.covar_samp(_d(y), _d(x)),
    ("stddev_pop",): lambda x: F.stddev_pop(_d(x)),
    ("stddev_samp", "stddev"): lambda x: F.stddev_samp(_d(x)),
    ("var_pop",): lambda x: F.var_pop(_d(x)),
    ("var_samp", "variance"): lambda x: F.var_samp(_d(x)),
    ("sem",): lambda x: F.stddev_pop(_d(x)) / F.sqrt(F.count(x)),
    ("approx_count_distinct",): lambda x: F.approx_count_distinct(x),
    ("arg_min", "argmin", "min_by"): lambda a, v: F.min_by(a, v),
    ("arg_max", "argmax", "max_by"): lambda a, v: F.max_by(a, v),
    ("bit_and",): F.bit_and,
    ("bit_or",): F.bit_or,
    ("bit_xor",): F.bit_xor,
    ("bool_and",): F.bool_and,
    ("bool_or",): F.bool_or,
    ("min",): F.min,
    ("max",): F.max,
    ("count",): F.count,
    ("any_value",): lambda x: F.any_value(x, F.lit(True)),
    ("skewness",): lambda x: _sample_skewness(x),
    ("kurtosis_pop",): lambda x: F.kurtosis(_d(x)),
    ("kurtosis",): lambda x: _sample_kurtosis(x),
    ("sum_no_overflow", "kahan_sum", "fsum", "sumkahan"): lambda x: F.sum(x),
    ("sum",): lambda x: F.sum(x),
    ("product",): lambda x: F.product(_d(x)),
    ("mode",): lambda x: F.mode(x, True),
    ("median", "quantile_cont_median"): lambda x: F.percentile(_d(x), 0.5),
    ("quantile_cont",): lambda x, q: F.percentile(_d(x), q),
    ("approx_quantile", "reservoir_quantile"): lambda x, q, *_: F.percentile_approx(x, q),
    ("regr_avgx",): F.regr_avgx,
    ("regr_avgy",): F.regr_avgy,
    ("regr_count",): F.regr_count,
    ("regr_intercept",): F.regr_intercept,
    ("regr_r2",): F.regr_r2,
    ("regr_slope",): F.regr_slope,
    ("regr_sxx",): F.regr_sxx,
    ("regr_sxy",): F.regr_sxy,
    ("regr_syy",): F.regr_syy,
    ("geomean",): lambda x: F.exp(F.avg(F.ln(_d(x)))),
}.items():
    named(*_names)(_f)


def _sample_skewness(x) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(_d(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def _sample_kurtosis(x) -> Column:
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(_d(x)) + 6))


@named("list", "array_agg")
def list_(x, *order) -> Column:
    """Keeps nulls; of no rows null. order: columns whose structs sort the rows, ascending."""
    rows = F.collect_list(F.struct(*order, _c(x).alias("__v")))
    rows = F.transform(F.sort_array(rows) if order else rows, lambda r: r["__v"])
    return F.when(F.count(F.lit(1)) > 0, rows)


@named("string_agg", "group_concat", "listagg")
def string_agg(x, separator: str = ",", *order) -> Column:
    rows = F.filter(list_(_c(x).cast("string"), *order), lambda v: v.isNotNull())
    return F.when(F.count(x) > 0, F.array_join(rows, separator))


@named("first", "arbitrary")
def first(x, *order) -> Column:
    """Of the first row in an order, null or not."""
    return F.min(F.struct(*order, _c(x).alias("__v")))["__v"] if order else F.first(x)


@named("last")
def last(x, *order) -> Column:
    return F.max(F.struct(*order, _c(x).alias("__v")))["__v"] if order else F.last(x)


def _counts(x) -> Column:
    """array(struct(key, value)): every value and its count, in the order of the values, from the sorted
    list of the group's values. Lambdas over one element keep the list from being sorted again."""

    def of(l: Column) -> Column:
        firsts = F.filter(F.transform(l, lambda v, i: F.when((i == 0) | (v != F.get(l, i - 1)), i)), lambda i: i.isNotNull())
        return F.get(F.transform(F.array(firsts), lambda f: F.transform(f, lambda p, k: F.struct(F.get(l, p).alias("key"), (F.coalesce(F.get(f, k + 1), F.size(l)) - p).cast("long").alias("value")))), 0)

    return F.get(F.transform(F.array(F.array_sort(F.collect_list(x))), of), 0)


@named("histogram")
def histogram(x) -> Column:
    """map(value -> count) in the order of the values, exact. It holds the values of a group, as list
    does; operators.aggregates.histogram does not."""
    return F.map_from_entries(_counts(x))


@named("entropy")
def entropy(x) -> Column:
    """Log-2 entropy of the values' counts, exact; 0 of no values. It holds the values of a group, as
    histogram does."""
    parts = F.aggregate(F.transform(_counts(x), lambda s: s["value"]), F.lit(0.0), lambda a, n: a + n * F.log2(n.cast("double")))
    total = F.count(x)
    return F.when(total > 0, F.log2(total.cast("double")) - parts / total).otherwise(F.lit(0.0))


@named("mad")
def mad(x) -> Column:
    """The median of distances to the median. It holds the values of a group, as list does;
    operators.aggregates.mad does not."""
    both = F.array(F.struct(F.collect_list(_d(x)).alias("l"), F.percentile(_d(x), 0.5).alias("m")))
    return F.get(F.transform(both, lambda s: _median_of(F.array_sort(F.transform(s["l"], lambda v: F.abs(v - s["m"]))))), 0)


@named("quantile", "quantile_disc")
def quantile_disc(x: str, q: float) -> Column:
    """The smallest value whose cumulative share reaches q. x: a column's name or SQL."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})")


def _median_of(sorted_: Column) -> Column:
    n = F.size(sorted_)
    return (F.try_element_at(sorted_, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(sorted_, F.ceil((n + 1) / 2).cast("int"))) / 2


@named("bitstring_agg")
def bitstring_agg(x, low: int, high: int) -> Column:
    """0s and 1s for low..high; a range of a fixed size."""
    seen = F.collect_set(x)
    return F.array_join(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda v: F.when(F.array_contains(seen, v.cast("long")), "1").otherwise("0")), "")


# Lists


def _index(l: Column, i) -> Column:
    return F.when(_c(i) == 0, None).otherwise(F.try_element_at(l, F.when(_c(i) == 0, 1).otherwise(_c(i)).cast("int")))


def _no_nulls(l: Column) -> Column:
    return F.filter(l, lambda v: v.isNotNull())


def _fold(l: Column, of: Callable[[Column, Column], Column], start) -> Column:
    return F.aggregate(l, _c(start), of)


for _names, _f in {
    ("flatten",): F.flatten,
    ("list_distinct", "array_distinct"): lambda l: F.array_distinct(_no_nulls(l)),
    ("list_unique", "array_unique"): lambda l: F.size(F.array_distinct(_no_nulls(l))).cast("long"),
    ("list_value", "list_pack", "array_value"): lambda *v: F.array(*map(_c, v)),
    ("list_sort", "array_sort"): lambda l: F.sort_array(l),
    ("list_reverse_sort", "array_reverse_sort"): lambda l: F.sort_array(l, False),
    ("list_grade_up", "array_grade_up", "grade_up"): lambda l: F.transform(F.sort_array(F.transform(l, lambda v, i: F.struct(v.alias("v"), (i + 1).cast("long").alias("i")))), lambda s: s["i"]),
    ("list_transform", "array_transform", "list_apply", "array_apply", "apply"): F.transform,
    ("list_filter", "array_filter", "filter"): F.filter,
    ("list_reduce", "array_reduce", "reduce"): lambda l, f: F.aggregate(F.slice(l, 2, F.greatest(F.size(l), F.lit(1))), F.get(l, 0), f),
    ("list_contains", "array_contains", "list_has", "array_has"): F.array_contains,
    ("list_position", "list_indexof", "array_position", "array_indexof"): lambda l, v: F.array_position(l, v).cast("int"),
    ("list_concat", "list_cat", "array_concat", "array_cat"): lambda a, b: F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())),
    ("list_append", "array_append", "array_push_back"): F.array_append,
    ("list_prepend", "array_prepend", "array_push_front"): lambda v, l: F.array_prepend(l, v),
    ("list_extract", "list_element", "array_extract"): _index,
    ("list_has_any", "array_has_any"): F.arrays_overlap,
    ("list_has_all", "array_has_all"): lambda a, b: F.size(F.array_except(b, a)) == 0,
    ("list_intersect", "array_intersect"): F.array_intersect,
    ("list_reverse", "array_reverse"): F.reverse,
    ("list_zip", "array_zip"): F.arrays_zip,
    ("array_to_string", "list_to_string"): lambda l, s: F.array_join(l, s),
    ("list_any_value",): lambda l: F.get(_no_nulls(l), 0),
    ("array_pop_back",): lambda l: F.slice(l, 1, F.greatest(F.size(l) - 1, F.lit(0))),
    ("array_pop_front",): lambda l: F.slice(l, 2, F.greatest(F.size(l) - 1, F.lit(0))),
    ("array_length", "len_list"): lambda l: F.size(l).cast("long"),
    ("generate_series",): lambda a, b, s=1: F.sequence(_c(a).cast("long"), _c(b).cast("long"), _c(s).cast("long")),
    ("list_where",): lambda l, m: F.transform(F.filter(F.arrays_zip(l.alias("v"), m.alias("m")), lambda z: z["m"]), lambda z: z["v"]),
    ("list_select",): lambda l, i: F.transform(i, lambda k: F.try_element_at(l, k.cast("int"))),
    ("generate_subscripts",): lambda l, _=1: F.sequence(F.lit(1), F.size(l)),
}.items():
    named(*_names)(_f)


@named("range")
def range_(a, b=None, step=1) -> Column:
    """Without its end; empty where the step does not lead there."""
    a, b = (_c(0), _c(a)) if b is None else (_c(a), _c(b))
    a, b, step = a.cast("long"), b.cast("long"), _c(step).cast("long")
    empty = F.array().cast("array<bigint>")
    last = b - F.signum(step).cast("long")
    return F.when((step == 0) | ((b - a) * step <= 0), empty).otherwise(F.sequence(a, F.when((step == 0) | ((b - a) * step <= 0), a).otherwise(last), F.when((step == 0) | ((b - a) * step <= 0), 1).otherwise(step)))


@named("list_slice", "array_slice")
def list_slice(l, begin, end, step: int = 1) -> Column:
    """Both bounds are in; negative ones count from the end."""
    n = F.size(l)
    a, b = _c(begin), _c(end)
    a = F.greatest(F.when(a < 0, n + a + 1).otherwise(a), F.lit(1))
    b = F.least(F.when(b < 0, n + b + 1).otherwise(b), n)
    part = F.slice(l, a.cast("int"), F.greatest(b - a + 1, F.lit(0)).cast("int"))
    return part if step == 1 else F.filter(part, lambda _, i: i % step == 0)


@named("list_resize", "array_resize")
def list_resize(l, n, value=None) -> Column:
    fill = F.array_repeat(_c(value), F.greatest(_c(n) - F.size(l), F.lit(0)).cast("int"))
    return F.concat(F.slice(l, 1, F.least(_c(n), F.size(l)).cast("int")), fill)


#: Aggregates of one list, by name.
_LIST_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "count": lambda l: F.size(_no_nulls(l)).cast("long"),
    "sum": lambda l: F.when(F.size(_no_nulls(l)) > 0, _fold(F.transform(_no_nulls(l), _d), lambda a, v: a + v, 0.0)),
    "min": F.array_min,
    "max": F.array_max,
    "avg": lambda l: F.when(F.size(_no_nulls(l)) > 0, _fold(F.transform(_no_nulls(l), _d), lambda a, v: a + v, 0.0) / F.size(_no_nulls(l))),
    "product": lambda l: F.when(F.size(_no_nulls(l)) > 0, _fold(F.transform(_no_nulls(l), _d), lambda a, v: a * v, 1.0)),
    "first": lambda l: F.get(l, 0),
    "last": lambda l: F.try_element_at(l, F.lit(-1)),
    "any_value": lambda l: F.get(_no_nulls(l), 0),
    "median": lambda l: _median_of(F.array_sort(F.transform(_no_nulls(l), _d))),
    "bool_and": lambda l: F.forall(_no_nulls(l), lambda v: v),
    "bool_or": lambda l: F.exists(_no_nulls(l), lambda v: v),
    "string_agg": lambda l: F.array_join(l, ","),
    "var_pop": lambda l: _list_var(l, 0),
    "var_samp": lambda l: _list_var(l, 1),
    "stddev_pop": lambda l: F.sqrt(_list_var(l, 0)),
    "stddev_samp": lambda l: F.sqrt(_list_var(l, 1)),
    "mode": lambda l: _list_mode(l),
    "approx_count_distinct": lambda l: F.size(F.array_distinct(_no_nulls(l))).cast("long"),
}


def _list_var(l: Column, less: int) -> Column:
    v = F.transform(_no_nulls(l), _d)
    mean = _LIST_AGGREGATES["avg"](l)
    return F.when(F.size(v) > less, _fold(F.transform(v, lambda x: (x - mean) * (x - mean)), lambda a, x: a + x, 0.0) / (F.size(v) - less))


def _list_mode(l: Column) -> Column:
    counts = F.transform(F.array_distinct(_no_nulls(l)), lambda v: F.struct(F.size(F.filter(l, lambda w: w == v)).alias("n"), v.alias("v")))
    return F.array_max(counts)["v"]


@named("list_aggregate", "array_aggregate", "list_aggr", "array_aggr", "aggregate")
def list_aggregate(l, name: str) -> Column:
    return _LIST_AGGREGATES[name](l)


def _list_function(name: str) -> None:
    named(f"list_{name}")(lambda l: _LIST_AGGREGATES[name](l))


for _name in _LIST_AGGREGATES:
    if f"list_{_name}" not in FUNCTIONS:
        _list_function(_name)


# Vectors


def _dot(a, b) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), lambda s, v: s + v, 0.0)


named("list_inner_product", "list_dot_product", "array_inner_product", "array_dot_product", "<#>")(_dot)


@named("list_distance", "array_distance", "<->")
def distance(a, b) -> Column:
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))), lambda s, v: s + v, 0.0))


@named("list_cosine_similarity", "array_cosine_similarity", "<=>")
def cosine_similarity(a, b) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


@named("array_cross_product")
def cross_product(a, b) -> Column:
    at = lambda i, j: F.get(a, i) * F.get(b, j) - F.get(a, j) * F.get(b, i)
    return F.array(at(1, 2), at(2, 0), at(0, 1))


# Maps, structs, unions, enums

for _names, _f in {
    ("cardinality",): lambda m: F.size(m).cast("long"),
    ("map",): lambda k, v: F.map_from_arrays(k, v),
    ("map_entries",): F.map_entries,
    ("map_from_entries",): F.map_from_entries,
    ("map_keys",): F.map_keys,
    ("map_values",): F.map_values,
    ("map_extract", "element_at"): lambda m, k: F.when(F.map_contains_key(m, k), F.array(F.try_element_at(m, _c(k)))).otherwise(F.slice(F.map_values(m), 1, 0)),
    ("map_concat",): lambda *m: F.map_from_entries(F.concat(*[_not_later(x, m[i + 1 :]) for i, x in enumerate(m)])),
    ("struct_pack",): lambda **kw: F.struct(*[_c(v).alias(k) for k, v in kw.items()]),
    ("row",): lambda *v: F.struct(*map(_c, v)),
    ("struct_extract",): lambda s, n: s[n],
    ("union_tag",): lambda u: u["tag"],
    ("union_extract",): lambda u, n: F.when(u["tag"] == n, u[n]),
}.items():
    named(*_names)(_f)


def _not_later(m: Column, rest: tuple) -> Column:
    """Entries of a map whose key no later map has."""
    return F.filter(F.map_entries(m), lambda e: ~_in_any(e, rest))


def _in_any(entry: Column, maps: tuple[Column, ...]) -> Column:
    out = F.lit(False)
    for m in maps:
        out = out | F.array_contains(F.map_keys(m), entry["key"])
    return out


@named("struct_insert")
def struct_insert(s: Column, **kw) -> Column:
    for k, v in kw.items():
        s = s.withField(k, _c(v))
    return s


@named("union_value")
def union_value(tags: list[str], kinds: list[str], **kw) -> Column:
    """A struct of its tag and one field per member, null but for the one given."""
    ((tag, value),) = kw.items()
    return F.struct(F.lit(tag).alias("tag"), *[(_c(value) if t == tag else F.lit(None)).cast(k).alias(t) for t, k in zip(tags, kinds, strict=True)])


named("enum_first")(lambda e, values: F.lit(values[0]))
named("enum_last")(lambda e, values: F.lit(values[-1]))
named("enum_range")(lambda e, values: F.array(*map(F.lit, values)))
named("enum_code")(lambda e, values: (F.array_position(F.array(*map(F.lit, values)), e) - 1).cast("int"))
named("enum_range_boundary")(lambda a, b, values: F.array(*map(F.lit, values[values.index(a) if a else 0 : (values.index(b) + 1) if b else None])))


# Math and bits

for _names, _f in {
    ("@", "abs"): F.abs,
    ("**", "pow", "power", "^"): lambda x, y: F.pow(_d(x), _d(y)),
    ("!__postfix", "factorial"): lambda x: F.factorial(_c(x).cast("int")),
    ("acos",): F.acos,
    ("asin",): F.asin,
    ("atan",): F.atan,
    ("atan2",): F.atan2,
    ("bit_count",): lambda x: F.bit_count(x).cast("int"),
    ("cbrt",): F.cbrt,
    ("ceil", "ceiling"): lambda x: F.ceil(x).cast("double"),
    ("floor",): lambda x: F.floor(x).cast("double"),
    ("cos",): F.cos,
    ("sin",): F.sin,
    ("tan",): F.tan,
    ("cot",): F.cot,
    ("degrees",): F.degrees,
    ("radians",): F.radians,
    ("exp",): F.exp,
    ("ln",): lambda x: F.ln(_d(x)),
    ("log2",): lambda x: F.log2(_d(x)),
    ("log10",): lambda x: F.log10(_d(x)),
    ("log",): lambda b, x=None: F.log10(_d(b)) if x is None else F.ln(_d(x)) / F.ln(_d(b)),
    ("sqrt",): lambda x: F.sqrt(_d(x)),
    ("pi",): F.pi,
    ("round",): lambda x, n=0: F.round(x, n),
    ("round_even", "roundbankers"): lambda x, n=0: F.bround(x, n),
    ("sign",): lambda x: F.signum(x).cast("int"),
    ("trunc",): lambda x: F.signum(_d(x)) * F.floor(F.abs(_d(x))),
    ("even",): lambda x: F.signum(_d(x)) * 2 * F.ceil(F.abs(_d(x)) / 2),
    ("isnan",): F.isnan,
    ("isinf",): lambda x: F.abs(_d(x)) == float("inf"),
    ("isfinite",): lambda x: ~F.isnan(_d(x)) & (F.abs(_d(x)) != float("inf")),
    ("signbit",): lambda x: (_d(x) < 0) | (_d(x).cast("string") == "-0.0"),
    ("add", "+"): lambda a, b: _c(a) + _c(b),
    ("subtract", "-"): lambda a, b: _c(a) - _c(b),
    ("multiply", "*"): lambda a, b: _c(a) * _c(b),
    ("divide", "/", "fdiv"): lambda a, b: F.try_divide(_d(a), _d(b)),
    ("//",): lambda a, b: F.call_function("div", _c(a), F.nullif(_c(b), F.lit(0))),
    ("mod", "%", "fmod"): lambda a, b: _c(a) % F.nullif(_c(b), F.lit(0)),
    ("&",): lambda a, b: _c(a).bitwiseAND(_c(b)),
    ("|",): lambda a, b: _c(a).bitwiseOR(_c(b)),
    ("xor",): lambda a, b: _c(a).bitwiseXOR(_c(b)),
    ("~",): lambda a: F.bitwise_not(_c(a)),
    ("<<",): lambda a, n: F.shiftleft(_c(a), n),
    (">>",): lambda a, n: F.shiftright(_c(a), n),
    ("least",): F.least,
    ("greatest",): F.greatest,
    ("uuid", "gen_random_uuid"): F.uuid,
    ("hash",): lambda *x: F.xxhash64(*x),
    ("error",): lambda m: F.raise_error(m),
    ("typeof",): F.typeof,
    ("constant_or_null",): lambda v, *x: F.when(_all_known(x), _c(v)),
}.items():
    named(*_names)(_f)


def _all_known(x) -> Column:
    out = F.lit(True)
    for c in x:
        out = out & c.isNotNull()
    return out


@named("greatest_common_divisor", "gcd")
def gcd(x, y) -> Column:
    """Euclid's steps as a fold; 92 reach the end for any two longs."""
    start = F.struct(F.abs(_c(x)).cast("long").alias("a"), F.abs(_c(y)).cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


@named("least_common_multiple", "lcm")
def lcm(x, y) -> Column:
    """Divides before it multiplies, so that it overflows only where its result does."""
    d = gcd(x, y)
    return F.when((_c(x) == 0) | (_c(y) == 0), F.lit(0).cast("long")).otherwise(F.abs(F.call_function("div", _c(x).cast("long"), F.nullif(d, F.lit(0))) * _c(y).cast("long")))


_SEED: list[int] = []


@named("setseed")
def setseed(seed: float) -> Column:
    """random() that is named after this starts from the seed."""
    _SEED[:] = [int(seed * (1 << 31))]
    return F.lit(None)


@named("random")
def random() -> Column:
    return F.rand(_SEED.pop()) if _SEED else F.rand()


#: Coefficients of a Lanczos approximation with g = 7, fixed values.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


@named("lgamma")
def lgamma(x) -> Column:
    z = _d(x) - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.ln(t) - t + F.ln(total)


@named("gamma")
def gamma(x) -> Column:
    return F.exp(lgamma(x))


# Bit strings, of 0s and 1s

named("get_bit")(lambda b, i: F.substring(b, _c(i) + 1, F.lit(1)).cast("int"))
named("set_bit")(lambda b, i, v: F.concat(F.substring(b, F.lit(1), _c(i)), _c(v).cast("string"), F.substring(b, _c(i) + 2, F.length(b))))
named("bit_position")(lambda part, b: F.instr(b, part) if isinstance(part, str) else F.locate(part, b))
named("bitstring")(lambda b, n: F.lpad(b, n, "0"))


# Null tests, conditions and the session

for _names, _f in {
    ("coalesce", "ifnull"): lambda *x: F.coalesce(*[_c(v) for v in x]),
    ("nullif",): lambda a, b: F.nullif(_c(a), _c(b)),
    ("if",): lambda c, a, b: F.when(c, _c(a)).otherwise(_c(b)),
    ("isnull",): lambda x: _c(x).isNull(),
    ("current_database", "current_catalog"): F.current_catalog,
    ("current_schema",): F.current_database,
    ("current_schemas",): lambda include_implicit=True: F.array(F.current_database()),
    ("in_search_path",): lambda database, schema: (_c(database) == F.current_catalog()) & (_c(schema) == F.current_database()),
    ("current_setting",): lambda name: F.lit(_setting(name)),
    ("version",): F.version,
    ("like_escape",): lambda s, p, e: F.like(_c(s), _c(p), _c(e)),
    ("not_like_escape",): lambda s, p, e: ~F.like(_c(s), _c(p), _c(e)),
    ("ilike_escape",): lambda s, p, e: F.ilike(_c(s), _c(p), _c(e)),
    ("not_ilike_escape",): lambda s, p, e: ~F.ilike(_c(s), _c(p), _c(e)),
    ("url_encode",): lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")),
    ("url_decode",): F.url_decode,
    ("md5_number_upper",): lambda s: _little_endian(F.md5(_c(s).cast("binary")), 1),
    ("md5_number_lower",): lambda s: _little_endian(F.md5(_c(s).cast("binary")), 17),
    ("julian",): lambda d: F.unix_micros(_c(d).cast("timestamp")).cast("double") / 86_400_000_000 + 2440588,
    ("make_time",): lambda h, m, s: F.concat_ws(":", F.lpad(_c(h).cast("string"), 2, "0"), F.lpad(_c(m).cast("string"), 2, "0"), F.regexp_replace(F.lpad(F.format_string("%.6f", _c(s).cast("double")), 9, "0"), r"\.?0+$", "")),
    ("make_timestamptz",): lambda *x: F.make_timestamp(*[_c(v) for v in x]),
    ("current_time", "current_localtime"): lambda: F.date_format(F.current_timestamp(), "HH:mm:ss.SSSSSS"),
    ("current_localtimestamp", "localtimestamp"): F.localtimestamp,
    ("transaction_timestamp",): F.current_timestamp,
    ("timezone_hour",): lambda t: F.lit(0).cast("long"),  # sessions are in UTC
    ("timezone_minute",): lambda t: F.lit(0).cast("long"),
    ("map_contains",): lambda m, k: F.map_contains_key(m, k),
}.items():
    named(*_names)(_f)


def _setting(name: str) -> str | None:
    from pyspark.sql import SparkSession

    return SparkSession.active().conf.get(name, None)


def _little_endian(digest: Column, at: int) -> Column:
    """Eight bytes of a hex digest as an unsigned number, the lowest byte first."""
    turned = F.concat(*[F.substring(digest, at + 2 * k, 2) for k in range(7, -1, -1)])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


@named("format")
def format_(pattern: str, *x) -> Column:
    """{} takes the next argument, {n} that of a number; {{ and }} are brackets."""
    parts, at = [], 0
    for piece in re.split(r"(\{\{|\}\}|\{\d*\})", pattern):
        if re.fullmatch(r"\{\d*\}", piece):
            k = int(piece[1:-1]) if len(piece) > 2 else at
            at += len(piece) == 2
            parts.append(_c(x[k]).cast("string"))
        elif piece:
            parts.append(F.lit({"{{": "{", "}}": "}"}.get(piece, piece)))
    return F.concat(*parts) if parts else F.lit("")


@named("alias")
def alias(x) -> Column:
    """The name of a column."""
    name = x if isinstance(x, str) else re.sub(r"^Column<'(.*)'>$", r"\1", repr(x), flags=re.S)
    return F.lit(name.rsplit(" AS ", 1)[-1])


# Blobs

named("encode")(lambda s: F.encode(s, "UTF-8"))
named("decode")(lambda b: F.decode(b, "UTF-8"))
named("to_base64", "base64")(F.base64)
named("from_base64")(F.unbase64)


# Strings

for _names, _f in {
    ("lower", "lcase"): F.lower,
    ("upper", "ucase"): F.upper,
    ("concat",): lambda *x: F.concat_ws("", *x),
    ("concat_ws",): lambda s, *x: F.concat_ws(s, *x),
    ("||",): lambda *x: F.concat(*x),
    ("contains",): lambda s, x: F.contains(s, _c(x)),
    ("length", "len"): lambda s: F.length(s).cast("long"),
    ("strlen", "octet_length"): lambda s: F.octet_length(s).cast("long"),
    ("bit_length",): lambda s: F.bit_length(s).cast("long"),
    ("prefix", "starts_with", "^@"): lambda s, x: F.startswith(s, _c(x)),
    ("suffix", "ends_with"): lambda s, x: F.endswith(s, _c(x)),
    ("substring", "substr"): lambda s, a, n=None: F.substring(s, _c(a), F.length(s) if n is None else _c(n)),
    ("strip_accents",): lambda s: F.translate(s, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"),
    ("regexp_matches",): lambda s, p: F.rlike(s, _c(p)),
    ("regexp_full_match",): lambda s, p: F.rlike(s, F.lit(f"^(?:{p})$")),
    ("regexp_extract",): lambda s, p, g=0: F.regexp_extract(s, p, g),
    ("regexp_extract_all",): lambda s, p, g=0: F.regexp_extract_all(s, F.lit(p), F.lit(g)),
    ("regexp_escape",): lambda s: F.regexp_replace(s, r"([^A-Za-z0-9_])", r"\\$1"),
    ("regexp_split_to_array", "string_split_regex", "str_split_regex"): lambda s, p: F.split(s, p),
    ("string_split", "str_split", "string_to_array", "split"): lambda s, x: F.split(s, "\\Q" + x + "\\E"),
    ("split_part",): lambda s, x, n: F.coalesce(_index(F.split(s, "\\Q" + x + "\\E"), n), F.lit("")),
    ("trim",): lambda s, chars=None: F.trim(s) if chars is None else F.btrim(s, _c(chars)),
    ("ltrim",): lambda s, chars=None: F.ltrim(s) if chars is None else F.ltrim(s, _c(chars)),
    ("rtrim",): lambda s, chars=None: F.rtrim(s) if chars is None else F.rtrim(s, _c(chars)),
    ("lpad",): F.lpad,
    ("rpad",): F.rpad,
    ("left",): lambda s, n: F.left(s, _c(n)),
    ("right",): lambda s, n: F.right(s, _c(n)),
    ("repeat",): F.repeat,
    ("replace",): lambda s, a, b: F.replace(s, _c(a), _c(b)),
    ("reverse",): F.reverse,
    ("translate",): F.translate,
    ("instr", "strpos", "position"): lambda s, x: F.instr(s, x).cast("long"),
    ("ascii", "ord", "unicode"): lambda s: F.ascii(s),
    ("chr",): F.char,
    ("hex", "to_hex"): F.hex,
    ("unhex", "from_hex"): F.unhex,
    ("bin", "to_binary"): lambda x: F.when(x.cast("string").isNotNull(), F.bin(x)),
    ("unbin", "from_binary"): lambda s: F.unhex(F.conv(s, 2, 16)),
    ("to_base",): lambda n, radix, least=0: F.upper(F.conv(n.cast("string"), 10, radix)) if not least else F.lpad(F.upper(F.conv(n.cast("string"), 10, radix)), least, "0"),
    ("md5",): lambda s: F.md5(s.cast("binary")),
    ("sha256",): lambda s: F.sha2(s.cast("binary"), 256),
    ("levenshtein", "editdist3"): lambda a, b: F.levenshtein(a, b).cast("long"),
    ("printf",): lambda f, *x: F.printf(F.lit(f), *x),
    ("like",): lambda s, p: F.like(s, _c(p)),
    ("ilike",): lambda s, p: F.ilike(s, _c(p)),
    ("glob",): lambda s, p: F.rlike(s, F.lit(_glob(p))),
    ("similar_to",): lambda s, p: F.rlike(s, F.lit(f"^(?:{p})$")),
    ("parse_filename",): lambda s: F.element_at(F.split(s, r"[/\\]"), -1),
    ("parse_dirname",): lambda s: F.element_at(F.split(s, r"[/\\]"), 1),
    ("parse_dirpath",): lambda s: F.regexp_extract(s, r"^(.*)[/\\][^/\\]*$", 1),
    ("parse_path",): lambda s: F.concat(F.when(_c(s).rlike(r"^[/\\]"), F.array(F.substring(_c(s), 1, 1))).otherwise(F.array().cast("array<string>")), F.filter(F.split(_c(s), r"[/\\]"), lambda p: p != "")),
}.items():
    named(*_names)(_f)


def _glob(p: str) -> str:
    import re

    out, i = "", 0
    while i < len(p):
        if p[i] == "[" and (j := p.find("]", i + 1)) > 0:
            out += p[i : j + 1].replace("[!", "[^")
            i = j
        else:
            out += {"*": ".*", "?": "."}.get(p[i]) or re.escape(p[i])
        i += 1
    return f"(?s)^{out}$"


@named("regexp_replace")
def regexp_replace(s, pattern: str, by: str, flags: str = "") -> Column:
    """The first match only, unless flags has g. `by` names groups as \\1."""
    java = by.replace("$", "\\$")
    for k in range(10):
        java = java.replace(f"\\{k}", f"${k}")
    mode = "(?i)" if "i" in flags else ""
    if "g" in flags:
        return F.regexp_replace(s, mode + pattern, java)
    moved = "".join(f"${int(x[0]) + 2}{x[1:]}" if x[:1].isdigit() else "$" + x for x in java.split("$")[1:])
    return F.regexp_replace(s, f"{mode}(?s)^(.*?)({pattern})", "$1" + java.split("$")[0] + moved)


@named("hamming", "mismatches")
def hamming(a, b) -> Column:
    chars = lambda s: F.split(s, "")
    return F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: x != y), lambda d: d)).cast("long")


@named("jaccard")
def jaccard(a, b) -> Column:
    """Of the sets of characters."""
    x, y = (F.array_distinct(F.split(s, "")) for s in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


@named("format_bytes", "formatreadablesize")
def format_bytes(n) -> Column:
    return _readable(n, 1024, ("KiB", "MiB", "GiB", "TiB", "PiB"))


@named("formatreadabledecimalsize")
def format_bytes_decimal(n) -> Column:
    return _readable(n, 1000, ("kB", "MB", "GB", "TB", "PB"))


def _readable(n, base: int, units: tuple[str, ...]) -> Column:
    out = F.when(n == 1, F.lit("1 byte")).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))
    for k, unit in enumerate(units, 1):
        below = F.floor(n / base ** (k - 1))  # whole units of the size below
        tenths = F.floor(below / base) * 10 + F.floor((below % base) * 10 / base)
        out = F.when(n >= base**k, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


@named("bar")
def bar(x, low: float, high: float, width: int = 80) -> Column:
    """Eighths of blocks in proportion to x between low and high."""
    eighths = F.floor(F.greatest(F.least((_d(x) - low) / (high - low), F.lit(1.0)), F.lit(0.0)) * width * 8).cast("int")
    part = F.element_at(F.array(*map(F.lit, ["", "▏", "▎", "▍", "▌", "▋", "▊", "▉"])), eighths % 8 + 1)
    return F.rpad(F.concat(F.repeat(F.lit("█"), F.floor(eighths / 8).cast("int")), part), width, " ")


# Dates

_PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "decade": lambda d: F.floor(F.year(d) / 10),
    "century": lambda d: F.floor((F.year(d) - 1) / 100) + 1,
    "millennium": lambda d: F.floor((F.year(d) - 1) / 1000) + 1,
    "quarter": F.quarter,
    "week": F.weekofyear,
    "isoyear": lambda d: F.extract(F.lit("yearofweek"), d),
    "yearweek": lambda d: F.extract(F.lit("yearofweek"), d) * 100 + F.weekofyear(d),
    "dow": lambda d: F.dayofweek(d) - 1,
    "isodow": lambda d: F.weekday(d) + 1,
    "doy": F.dayofyear,
    "era": lambda d: F.when(F.year(d) > 0, 1).otherwise(0),
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "millisecond": lambda d: F.floor(F.extract(F.lit("second"), d) * 1000),
    "microsecond": lambda d: F.floor(F.extract(F.lit("second"), d) * 1_000_000),
    "epoch": lambda d: F.unix_micros(d.cast("timestamp")) / 1_000_000,
}
_PARTS |= {"dayofweek": _PARTS["dow"], "weekday": _PARTS["dow"], "dayofyear": _PARTS["doy"], "weekofyear": _PARTS["week"], "dayofmonth": _PARTS["day"]}


@named("date_part", "extract")
def date_part(part: str, d) -> Column:
    out = _PARTS[part.lower().rstrip("s") if part.lower().rstrip("s") in _PARTS else part.lower()](d)
    return out.cast("double" if part == "epoch" else "long")


for _p in _PARTS:
    named(_p)(lambda d, p=_p: date_part(p, d))


@named("date_trunc", "datetrunc")
def date_trunc(part: str, d) -> Column:
    years = {"decade": 10, "century": 100, "millennium": 1000}.get(part)
    if years:
        base = F.floor(F.year(d) / years) * years
        return F.make_timestamp_ntz(base.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.date_trunc(part, d.cast("timestamp")).cast("timestamp_ntz")


#: Units that end on a fixed number of microseconds.
_MICROS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}
_MONTHS = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200, "millennium": 12000}


@named("date_diff", "datediff")
def date_diff(part: str, a, b) -> Column:
    """Boundaries crossed between a and b."""
    if part in _MONTHS:
        at = lambda d: F.floor((F.year(d) * 12 + F.month(d) - 1) / _MONTHS[part])
    elif part == "week":  # whole weeks between the dates
        days = F.datediff(b.cast("date"), a.cast("date"))
        return (F.signum(days) * F.floor(F.abs(days) / 7)).cast("long")
    else:
        at = lambda d: F.floor(F.unix_micros(d.cast("timestamp")) / _MICROS[part])
    return (at(b) - at(a)).cast("long")


@named("date_sub", "datesub")
def date_sub(part: str, a, b) -> Column:
    """Complete units between a and b."""
    if part in _MONTHS:
        whole = F.timestamp_diff("MONTH", a.cast("timestamp"), b.cast("timestamp"))
        return (F.signum(whole) * F.floor(F.abs(whole) / _MONTHS[part])).cast("long")
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return (F.signum(micros) * F.floor(F.abs(micros) / _MICROS[part])).cast("long")


@named("time_bucket")
def time_bucket(width_micros: int | None, d, months: int | None = None) -> Column:
    """Widths of days and less count from Monday 2000-01-03, of months from 2000-01-01."""
    if months:
        k = F.floor((F.year(d) * 12 + F.month(d) - 1 - 24000) / months) * months + 24000
        return F.make_timestamp_ntz(F.floor(k / 12).cast("int"), (k % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    origin = 946_857_600 * 10**6
    k = F.floor((F.unix_micros(d.cast("timestamp")) - origin) / width_micros)
    return F.timestamp_micros(k * width_micros + origin).cast("timestamp_ntz")


for _names, _f in {
    ("last_day",): F.last_day,
    ("monthname",): lambda d: F.date_format(d, "MMMM"),
    ("dayname",): lambda d: F.date_format(d, "EEEE"),
    ("make_date",): F.make_date,
    ("make_timestamp",): lambda y, m, d, h, mi, s: F.make_timestamp_ntz(*map(_c, (y, m, d, h, mi, s))),
    ("epoch_ms",): lambda d: F.unix_millis(d.cast("timestamp")),
    ("epoch_us",): lambda d: F.unix_micros(d.cast("timestamp")),
    ("epoch_ns",): lambda d: F.unix_micros(d.cast("timestamp")) * 1000,
    ("to_timestamp",): lambda x: F.timestamp_micros((_d(x) * 1_000_000).cast("long")),
    ("current_date", "today"): F.current_date,
    ("now", "get_current_timestamp", "current_timestamp"): F.current_timestamp,
    ("strftime",): lambda d, f: F.date_format(d, _java_format(f)),
    ("strptime",): lambda s, f: F.to_timestamp_ntz(s, F.lit(_java_format(f))),
    ("try_strptime",): lambda s, f: F.try_to_timestamp(s, F.lit(_java_format(f))).cast("timestamp_ntz"),
    ("date_add",): lambda d, interval: d + F.expr(f"INTERVAL {interval}"),
    ("age",): lambda a, b: F.struct((F.floor(F.timestamp_diff("MONTH", b, a) / 12)).alias("years"), (F.timestamp_diff("MONTH", b, a) % 12).alias("months")),
    ("timezone",): lambda zone, d: F.convert_timezone(F.lit("UTC"), F.lit(zone), d),
}.items():
    named(*_names)(_f)

for _u, _n in {"microseconds": 1, "milliseconds": 1000, "seconds": 10**6, "minutes": 60 * 10**6, "hours": 3600 * 10**6, "days": 86400 * 10**6, "weeks": 7 * 86400 * 10**6}.items():
    named(f"to_{_u}")(lambda x, n=_n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (_c(x) * n / 1_000_000).cast("decimal(18,6)")))
for _u, _n in {"months": 1, "years": 12, "decades": 120, "centuries": 1200, "millennia": 12000}.items():
    named(f"to_{_u}")(lambda x, n=_n: F.make_ym_interval(F.lit(0), (_c(x) * n).cast("int")))

#: C format letters and their Java patterns, fixed values.
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%j": "DDD", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%y": "yy", "%I": "hh", "%p": "a", "%-d": "d", "%-m": "M", "%g": "SSS", "%z": "XX", "%Z": "VV"}


def _java_format(f: str) -> str:
    out, i = "", 0
    while i < len(f):
        for k in (f[i : i + 3], f[i : i + 2]):
            if k in _FORMATS:
                out += _FORMATS[k]
                i += len(k)
                break
        else:
            out += f"\0{f[i]}\0" if f[i].isalpha() else "''" if f[i] == "'" else f[i]
            i += 1
    return out.replace("\0\0", "").replace("\0", "'")


# JSON

def _json_value(x: Column) -> Column:
    """A value of any type as JSON: what a list of it holds between its brackets."""
    listed = F.to_json(F.array(x))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


for _names, _f in {
    ("json_extract", "json_extract_path", "->"): lambda j, p: F.get_json_object(j, _json_path(p)),
    ("json_extract_string", "json_extract_path_text", "->>"): lambda j, p: F.get_json_object(j, _json_path(p)),
    ("json_array_length",): lambda j: F.json_array_length(j).cast("long"),
    ("json_keys",): F.json_object_keys,
    ("json_valid",): lambda j: F.try_parse_json(j).isNotNull() & _balanced(j),
    ("json_type",): lambda j: _json_type(j),
    ("json_object",): lambda *x: F.to_json(_c(x[0])) if len(x) == 1 else F.to_json(F.struct(*[_c(v).alias(k) for k, v in zip(x[::2], x[1::2], strict=True)]), {"ignoreNullFields": "false"}),
    ("to_json", "json_quote", "row_to_json", "array_to_json"): lambda x: F.to_json(x),
    ("json_array",): lambda *x: F.concat(F.lit("["), F.concat_ws(",", *[_json_value(_c(v)) for v in x]), F.lit("]")),
    ("json_transform", "from_json"): lambda j, shape: F.from_json(j, shape),
    ("json_transform_strict", "from_json_strict"): lambda j, shape: F.from_json(j, shape, {"mode": "FAILFAST"}),
    ("json_structure",): lambda j: F.schema_of_json(j),
    ("json_group_array",): lambda x: F.to_json(F.collect_list(x)),
    ("json_group_object",): lambda k, v: F.to_json(F.map_from_entries(F.collect_list(F.struct(k, v)))),
    ("json_contains",): lambda j, needle: F.contains(F.regexp_replace(j, r"\s+", ""), F.lit(needle)),
}.items():
    named(*_names)(_f)


def _balanced(j) -> Column:
    """Whether nothing follows the first value: brackets outside strings close at the end only."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(j), r'"(?:[^"\\\\]|\\\\.)*+"', "s"), r"[^\[\]{}]+", "v")
    depth = F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("d"), F.lit(False).alias("bad")), lambda a, ch: F.struct((a["d"] + F.when(ch.isin("[", "{"), 1).when(ch.isin("]", "}"), -1).otherwise(0)).alias("d"), (a["bad"] | ((a["d"] == 0) & ch.isin("]", "}", "v") & F.startswith(bare, F.lit("{")))).alias("bad")))
    return ~depth["bad"] & (depth["d"] == 0)


def _json_path(p: str) -> str:
    if p.startswith("$"):
        return p
    if p.startswith("/"):
        return "$" + "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in p.split("/")[1:])
    return f"$.{p}"


def _json_type(j) -> Column:
    t = F.trim(j)
    return F.when(t.startswith("{"), "OBJECT").when(t.startswith("["), "ARRAY").when(t.startswith('"'), "VARCHAR").when(t.isin("true", "false"), "BOOLEAN").when(t == "null", "NULL").when(t.rlike("^[0-9]+$"), "UBIGINT").when(t.rlike("^-[0-9]+$"), "BIGINT").otherwise("DOUBLE")
