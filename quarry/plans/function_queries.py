"""Every function family over whole tables: one list of (name, Column, SQL) makes a query and its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import quarry.functions.extra  # noqa: F401  registers what no expression gives
from quarry.functions import call as f
from quarry.session import table

Case = tuple[str, Callable[[], Column], str]
c = F.col  # a function: no Column is made before a session exists

STRINGS: list[Case] = [
    ("lower", lambda: f("lower", c("p_name")), "lower(p_name)"),
    ("upper", lambda: f("ucase", c("p_name")), "upper(p_name)"),
    ("concat", lambda: f("concat", c("p_name"), F.lit(None), c("p_brand")), "concat(p_name, NULL, p_brand)"),
    ("concat_ws", lambda: f("concat_ws", "-", c("p_name"), c("p_brand")), "concat_ws('-', p_name, p_brand)"),
    ("pipes", lambda: f("||", c("p_name"), F.lit("/"), c("p_brand")), "p_name || '/' || p_brand"),
    ("contains", lambda: f("contains", c("p_type"), "A"), "contains(p_type, 'A')"),
    ("length", lambda: f("length", c("p_name")), "length(p_name)"),
    ("strlen", lambda: f("strlen", c("p_name")), "strlen(p_name)"),
    ("bit_length", lambda: f("bit_length", c("p_name")), "bit_length(p_name)"),
    ("starts", lambda: f("^@", c("p_type"), "S"), "starts_with(p_type, 'S')"),
    ("ends", lambda: f("suffix", c("p_type"), "L"), "suffix(p_type, 'L')"),
    ("substring", lambda: f("substring", c("p_name"), 2, 3), "substring(p_name, 2, 3)"),
    ("accents", lambda: f("strip_accents", F.concat(c("p_name"), F.lit("éÀü"))), "strip_accents(p_name || 'éÀü')"),
    ("nfc", lambda: f("nfc_normalize", F.concat(c("p_name"), F.lit("é"))), "nfc_normalize(p_name || 'e' || chr(769))"),
    ("graphemes", lambda: f("length_grapheme", F.concat(c("p_name"), F.lit("é"))), "length_grapheme(p_name || 'e' || chr(769))"),
    ("left_g", lambda: f("left_grapheme", c("p_name"), F.lit(2)), "left_grapheme(p_name, 2)"),
    ("right_g", lambda: f("right_grapheme", c("p_name"), F.lit(2)), "right_grapheme(p_name, 2)"),
    ("sub_g", lambda: f("substring_grapheme", c("p_name"), F.lit(3)), "substring_grapheme(p_name, 3, 1000)"),
    ("like", lambda: f("like", c("p_type"), "%A%"), "p_type LIKE '%A%'"),
    ("ilike", lambda: f("ilike", c("p_type"), "s%"), "p_type ILIKE 's%'"),
    ("glob", lambda: f("glob", c("p_type"), "[A-M]*"), "p_type GLOB '[A-M]*'"),
    ("similar", lambda: f("similar_to", c("p_type"), "[A-M].*"), "p_type SIMILAR TO '[A-M].*'"),
    ("re_matches", lambda: f("regexp_matches", c("p_name"), "[0-9]{2}"), "regexp_matches(p_name, '[0-9]{2}')"),
    ("re_full", lambda: f("regexp_full_match", c("p_name"), "[a-zA-Z# ]+[0-9]+"), "regexp_full_match(p_name, '[a-zA-Z# ]+[0-9]+')"),
    ("re_replace", lambda: f("regexp_replace", c("p_name"), "([0-9])", "<\\1>"), r"regexp_replace(p_name, '([0-9])', '<\1>')"),
    ("re_replace_g", lambda: f("regexp_replace", c("p_name"), "[0-9]", "#", "g"), "regexp_replace(p_name, '[0-9]', '#', 'g')"),
    ("re_extract", lambda: f("regexp_extract", c("p_name"), "([a-z]+)[^0-9]*([0-9]+)", 2), "regexp_extract(p_name, '([a-z]+)[^0-9]*([0-9]+)', 2)"),
    ("re_all", lambda: f("array_to_string", f("regexp_extract_all", c("p_name"), "[0-9]"), ","), "array_to_string(regexp_extract_all(p_name, '[0-9]'), ',')"),
    ("re_escape", lambda: f("regexp_escape", c("p_brand")), "regexp_escape(p_brand)"),
    ("split", lambda: f("array_to_string", f("string_split", c("p_name"), "a"), "|"), "array_to_string(string_split(p_name, 'a'), '|')"),
    ("split_re", lambda: f("array_to_string", f("string_split_regex", c("p_name"), "[aeiou]"), "|"), "array_to_string(string_split_regex(p_name, '[aeiou]'), '|')"),
    ("split_part", lambda: f("split_part", c("p_brand"), "#", 2), "split_part(p_brand, '#', 2)"),
    ("trim", lambda: f("trim", F.concat(F.lit("  "), c("p_name"), F.lit(" "))), "trim('  ' || p_name || ' ')"),
    ("trim_set", lambda: f("trim", c("p_name"), "p0123456789"), "trim(p_name, 'p0123456789')"),
    ("ltrim", lambda: f("ltrim", F.concat(F.lit("  "), c("p_name"))), "ltrim('  ' || p_name)"),
    ("rtrim", lambda: f("rtrim", F.concat(c("p_name"), F.lit("  "))), "rtrim(p_name || '  ')"),
    ("lpad", lambda: f("lpad", c("p_name"), 20, "*"), "lpad(p_name, 20, '*')"),
    ("rpad", lambda: f("rpad", c("p_name"), 20, "*"), "rpad(p_name, 20, '*')"),
    ("left_", lambda: f("left", c("p_name"), 3), "left(p_name, 3)"),
    ("right_", lambda: f("right", c("p_name"), 3), "right(p_name, 3)"),
    ("repeat_", lambda: f("repeat", c("p_brand"), 2), "repeat(p_brand, 2)"),
    ("replace_", lambda: f("replace", c("p_name"), "a", "bb"), "replace(p_name, 'a', 'bb')"),
    ("reverse_", lambda: f("reverse", c("p_name")), "reverse(p_name)"),
    ("translate_", lambda: f("translate", c("p_name"), "abc", "xyz"), "translate(p_name, 'abc', 'xyz')"),
    ("instr", lambda: f("instr", c("p_name"), "a"), "instr(p_name, 'a')"),
    ("ascii_", lambda: f("ascii", c("p_name")), "ascii(p_name)"),
    ("chr_", lambda: f("chr", c("p_size") + 64), "chr(p_size + 64)"),
    ("hex_", lambda: f("hex", c("p_name")), "hex(p_name)"),
    ("hex_num", lambda: f("to_hex", c("p_partkey")), "to_hex(p_partkey)"),
    ("unhex_", lambda: f("decode", f("unhex", f("hex", c("p_name")))), "decode(unhex(hex(p_name)))"),
    ("bin_", lambda: f("bin", c("p_size")), "bin(p_size)"),
    ("base_", lambda: f("to_base", c("p_size"), 7), "to_base(p_size, 7)"),
    ("md5_", lambda: f("md5", c("p_name")), "md5(p_name)"),
    ("sha", lambda: f("sha256", c("p_name")), "sha256(p_name)"),
    ("levenshtein_", lambda: f("levenshtein", c("p_name"), c("p_type")), "levenshtein(p_name, p_type)"),
    ("damerau", lambda: f("damerau_levenshtein", c("p_name"), c("p_type")), "damerau_levenshtein(p_name, p_type)"),
    ("hamming_", lambda: f("hamming", f("left", c("p_name"), 3), f("left", c("p_type"), 3)), "hamming(left(p_name, 3), left(p_type, 3))"),
    ("jaccard_", lambda: F.round(f("jaccard", c("p_name"), c("p_type")), 9), "round(jaccard(p_name, p_type), 9)"),
    ("jaro", lambda: F.round(f("jaro_similarity", c("p_name"), c("p_type")), 9), "round(jaro_similarity(p_name, p_type), 9)"),
    ("jaro_winkler", lambda: F.round(f("jaro_winkler_similarity", c("p_brand"), F.lit("Brand#11")), 9), "round(jaro_winkler_similarity(p_brand, 'Brand#11'), 9)"),
    ("printf_", lambda: f("printf", "%s-%d", c("p_name"), c("p_size")), "printf('%s-%d', p_name, p_size)"),
    ("bytes_", lambda: f("format_bytes", c("p_partkey") * 999), "format_bytes(p_partkey * 999)"),
    ("bar_", lambda: f("bar", c("p_size"), 0, 50, 10), "bar(p_size, 0, 50, 10)"),
    ("base64_", lambda: f("to_base64", f("encode", c("p_name"))), "to_base64(encode(p_name))"),
    ("from64", lambda: f("decode", f("from_base64", f("to_base64", f("encode", c("p_name"))))), "decode(from_base64(to_base64(encode(p_name))))"),
    ("file_name", lambda: f("parse_filename", F.concat(F.lit("a/b/"), c("p_brand"))), "parse_filename('a/b/' || p_brand)"),
    ("dir_path", lambda: f("parse_dirpath", F.concat(F.lit("a/b/"), c("p_brand"))), "parse_dirpath('a/b/' || p_brand)"),
    ("dir_name", lambda: f("parse_dirname", F.concat(F.lit("a/b/"), c("p_brand"))), "parse_dirname('a/b/' || p_brand)"),
]

MATH: list[Case] = [
    ("abs_", lambda: f("@", 25 - c("p_size")), "abs(25 - p_size)"),
    ("pow_", lambda: F.round(f("pow", c("p_size"), 1.5), 6), "round(pow(p_size, 1.5), 6)"),
    ("factorial_", lambda: f("factorial", c("p_size") % 15), "CAST(factorial(CAST(p_size % 15 AS INTEGER)) AS BIGINT)"),
    ("acos_", lambda: F.round(f("acos", c("p_size") / 50), 9), "round(acos(p_size / 50), 9)"),
    ("asin_", lambda: F.round(f("asin", c("p_size") / 50), 9), "round(asin(p_size / 50), 9)"),
    ("atan_", lambda: F.round(f("atan", c("p_size")), 9), "round(atan(p_size), 9)"),
    ("atan2_", lambda: F.round(f("atan2", c("p_size"), F.lit(3.0)), 9), "round(atan2(p_size, 3), 9)"),
    ("bits", lambda: f("bit_count", c("p_size")), "CAST(bit_count(p_size) AS INTEGER)"),
    ("cbrt_", lambda: F.round(f("cbrt", c("p_retailprice")), 6), "round(cbrt(p_retailprice), 6)"),
    ("ceil_", lambda: f("ceil", c("p_retailprice")), "ceil(p_retailprice)"),
    ("floor_", lambda: f("floor", c("p_retailprice")), "floor(p_retailprice)"),
    ("cos_", lambda: F.round(f("cos", c("p_size")), 9), "round(cos(p_size), 9)"),
    ("sin_", lambda: F.round(f("sin", c("p_size")), 9), "round(sin(p_size), 9)"),
    ("tan_", lambda: F.round(f("tan", c("p_size")), 6), "round(tan(p_size), 6)"),
    ("cot_", lambda: F.round(f("cot", c("p_size")), 6), "round(cot(p_size), 6)"),
    ("degrees_", lambda: F.round(f("degrees", c("p_size")), 6), "round(degrees(p_size), 6)"),
    ("radians_", lambda: F.round(f("radians", c("p_size")), 9), "round(radians(p_size), 9)"),
    ("even_", lambda: f("even", c("p_retailprice")), "even(p_retailprice)"),
    ("exp_", lambda: F.round(f("exp", c("p_size") / 10), 6), "round(exp(p_size / 10), 6)"),
    ("finite", lambda: f("isfinite", c("p_retailprice")), "isfinite(p_retailprice)"),
    ("inf_", lambda: f("isinf", c("p_retailprice")), "isinf(p_retailprice)"),
    ("nan_", lambda: f("isnan", c("p_retailprice")), "isnan(p_retailprice)"),
    ("gamma_", lambda: F.round(f("gamma", c("p_size") % 10 + 1.5), 4), "round(gamma(p_size % 10 + 1.5), 4)"),
    ("lgamma_", lambda: F.round(f("lgamma", c("p_size") + 0.5), 6), "round(lgamma(p_size + 0.5), 6)"),
    ("gcd_", lambda: f("gcd", c("p_partkey"), c("p_size")), "CAST(gcd(p_partkey, p_size) AS BIGINT)"),
    ("lcm_", lambda: f("lcm", c("p_partkey"), c("p_size")), "CAST(lcm(p_partkey, p_size) AS BIGINT)"),
    ("ln_", lambda: F.round(f("ln", c("p_size")), 9), "round(ln(p_size), 9)"),
    ("log2_", lambda: F.round(f("log2", c("p_size")), 9), "round(log2(p_size), 9)"),
    ("log10_", lambda: F.round(f("log10", c("p_size")), 9), "round(log10(p_size), 9)"),
    ("log_b", lambda: F.round(f("log", F.lit(3), c("p_size")), 9), "round(log(3, p_size), 9)"),
    ("next_", lambda: f("nextafter", c("p_retailprice"), F.lit(0.0)), "nextafter(p_retailprice, 0.0::DOUBLE)"),
    ("pi_", lambda: f("pi"), "pi()"),
    ("round_", lambda: f("round", c("p_retailprice"), -1), "round(p_retailprice, -1)"),
    ("sign_", lambda: f("sign", 25 - c("p_size")), "CAST(sign(25 - p_size) AS INTEGER)"),
    ("signbit_", lambda: f("signbit", 25.0 - c("p_size")), "signbit(25.0::DOUBLE - p_size)"),
    ("sqrt_", lambda: F.round(f("sqrt", c("p_size")), 9), "round(sqrt(p_size), 9)"),
    ("trunc_", lambda: f("trunc", 25.5 - c("p_size")), "trunc(25.5::DOUBLE - p_size)"),
    ("divide_", lambda: F.round(f("/", c("p_partkey"), c("p_size") % 3), 9), "round(p_partkey / nullif(p_size % 3, 0), 9)"),
    ("int_div", lambda: f("//", c("p_partkey"), c("p_size") % 3), "p_partkey // nullif(p_size % 3, 0)"),
    ("mod_", lambda: f("%", c("p_partkey"), c("p_size") % 3), "p_partkey % nullif(p_size % 3, 0)"),
    ("band", lambda: f("&", c("p_partkey"), 6), "p_partkey & 6"),
    ("bor", lambda: f("|", c("p_partkey"), 6), "p_partkey | 6"),
    ("bxor", lambda: f("xor", c("p_partkey"), 6), "xor(p_partkey, 6)"),
    ("bnot", lambda: f("~", c("p_partkey")), "~p_partkey"),
    ("shl", lambda: f("<<", c("p_partkey"), 3), "p_partkey << 3"),
    ("shr", lambda: f(">>", c("p_partkey"), 3), "p_partkey >> 3"),
    ("least_", lambda: f("least", c("p_size"), F.lit(20)), "least(p_size, 20)"),
    ("greatest_", lambda: f("greatest", c("p_size"), F.lit(20)), "greatest(p_size, 20)"),
    ("const_null", lambda: f("constant_or_null", 1, F.nullif(c("p_size"), F.lit(7))), "CASE WHEN nullif(p_size, 7) IS NOT NULL THEN 1 END"),
    ("get_bit_", lambda: f("get_bit", F.lpad(F.bin(c("p_size")), 8, "0"), 7), "get_bit(CAST(lpad(bin(p_size), 8, '0') AS BIT), 7)"),
    ("set_bit_", lambda: f("set_bit", F.lpad(F.bin(c("p_size")), 8, "0"), 0, 1), "CAST(set_bit(CAST(lpad(bin(p_size), 8, '0') AS BIT), 0, 1) AS VARCHAR)"),
    ("bitstring_", lambda: f("bitstring", F.bin(c("p_size")), 12), "CAST(bitstring(bin(p_size), 12) AS VARCHAR)"),
    ("bit_pos", lambda: f("bit_position", "11", F.bin(c("p_size"))), "CAST(bit_position(CAST('11' AS BIT), CAST(bin(p_size) AS BIT)) AS INTEGER)"),
]

_L, _LS = lambda: F.array(c("p_size"), c("p_size") % 7, F.nullif(c("p_size") % 5, F.lit(0)), F.lit(4)), "[p_size, p_size % 7, nullif(p_size % 5, 0), 4]"
_M, _MS = lambda: F.array(c("p_size") % 3, F.lit(4)), "[p_size % 3, 4]"


def _s(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",")


def _ss(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: coalesce(CAST(v AS VARCHAR), '-')), ',')"


LISTS: list[Case] = [
    ("distinct_", lambda: _s(F.sort_array(f("list_distinct", _L()))), _ss(f"list_sort(list_distinct({_LS}))")),
    ("unique_", lambda: f("list_unique", _L()), f"CAST(list_unique({_LS}) AS BIGINT)"),
    ("sort_", lambda: _s(f("list_sort", _L())), _ss(f"list_sort({_LS}, 'ASC', 'NULLS FIRST')")),
    ("reverse_sort", lambda: _s(f("list_reverse_sort", _L())), _ss(f"list_sort({_LS}, 'DESC', 'NULLS LAST')")),
    ("grade_up_", lambda: _s(f("list_grade_up", _M())), _ss(f"list_grade_up({_MS})")),
    ("transform_", lambda: _s(f("list_transform", _L(), lambda v: v * 2)), _ss(f"list_transform({_LS}, lambda x: x * 2)")),
    ("transform_i", lambda: _s(f("list_transform", _L(), lambda v, i: v + i + 1)), _ss(f"list_transform({_LS}, lambda x, i: x + i)")),
    ("filter_", lambda: _s(f("list_filter", _L(), lambda v: v > 3)), _ss(f"list_filter({_LS}, lambda x: x > 3)")),
    ("reduce_", lambda: f("list_reduce", _M(), lambda a, v: a * 10 + v), f"list_reduce({_MS}, lambda a, v: a * 10 + v)"),
    ("contains_", lambda: F.coalesce(f("list_contains", _L(), 3), F.lit(False)), f"coalesce(list_contains({_LS}, 3), false)"),
    ("position_", lambda: f("list_position", _M(), 4), f"CAST(list_position({_MS}, 4) AS INTEGER)"),
    ("concat_", lambda: _s(f("list_concat", _L(), _M())), _ss(f"list_concat({_LS}, {_MS})")),
    ("append_", lambda: _s(f("list_append", _L(), F.lit(9))), _ss(f"list_append({_LS}, 9)")),
    ("prepend_", lambda: _s(f("list_prepend", F.lit(9), _L())), _ss(f"list_prepend(9, {_LS})")),
    ("extract_", lambda: f("list_extract", _L(), -2), f"list_extract({_LS}, -2)"),
    ("extract_out", lambda: f("list_extract", _L(), 9), f"list_extract({_LS}, 9)"),
    ("slice_", lambda: _s(f("list_slice", _L(), 2, 3)), _ss(f"list_slice({_LS}, 2, 3)")),
    ("slice_neg", lambda: _s(f("list_slice", _L(), -3, -1)), _ss(f"list_slice({_LS}, -3, -1)")),
    ("slice_step", lambda: _s(f("list_slice", _L(), 1, 4, 2)), _ss(f"list_slice({_LS}, 1, 4, 2)")),
    ("resize_", lambda: _s(f("list_resize", _M(), 4, 0)), _ss(f"list_resize({_MS}, 4, 0)")),
    ("any_", lambda: f("list_has_any", _M(), F.array(F.lit(1), F.lit(2))), f"list_has_any({_MS}, [1, 2])"),
    ("all_", lambda: f("list_has_all", _M(), F.array(F.lit(1), F.lit(4))), f"list_has_all({_MS}, [1, 4])"),
    ("intersect_", lambda: _s(F.sort_array(f("list_intersect", _M(), F.array(F.lit(1), F.lit(4))))), _ss(f"list_sort(list_intersect({_MS}, [1, 4]))")),
    ("reverse_", lambda: _s(f("list_reverse", _L())), _ss(f"list_reverse({_LS})")),
    ("any_value_", lambda: f("list_any_value", _L()), f"list_any_value({_LS})"),
    ("pop_back", lambda: _s(f("array_pop_back", _L())), _ss(f"array_pop_back({_LS})")),
    ("pop_front", lambda: _s(f("array_pop_front", _L())), _ss(f"array_pop_front({_LS})")),
    ("where_", lambda: _s(f("list_where", _M(), F.array(F.lit(False), F.lit(True)))), _ss(f"list_where({_MS}, [false, true])")),
    ("select_", lambda: _s(f("list_select", _L(), F.array(F.lit(2), F.lit(1)))), _ss(f"list_select({_LS}, [2, 1])")),
    ("flatten_", lambda: _s(f("flatten", F.array(_L(), _M()))), _ss(f"flatten([{_LS}, {_MS}])")),
    ("range_", lambda: _s(f("range", 2, c("p_size"), 5)), _ss("range(2, p_size, 5)")),
    ("series", lambda: _s(f("generate_series", 0, c("p_size"), 5)), _ss("generate_series(0, p_size, 5)")),
    ("agg_sum", lambda: f("list_aggregate", _L(), "sum"), f"CAST(list_aggregate({_LS}, 'sum') AS DOUBLE)"),
    ("agg_avg", lambda: F.round(f("list_aggregate", _L(), "avg"), 9), f"round(list_aggregate({_LS}, 'avg'), 9)"),
    ("agg_min", lambda: f("list_aggregate", _L(), "min"), f"list_aggregate({_LS}, 'min')"),
    ("agg_max", lambda: f("list_aggregate", _L(), "max"), f"list_aggregate({_LS}, 'max')"),
    ("agg_count", lambda: f("list_aggregate", _L(), "count"), f"list_aggregate({_LS}, 'count')"),
    ("agg_median", lambda: f("list_aggregate", _L(), "median"), f"list_aggregate({_LS}, 'median')"),
    ("agg_var", lambda: F.round(f("list_aggregate", _L(), "var_samp"), 9), f"round(list_aggregate({_LS}, 'var_samp'), 9)"),
    ("agg_product", lambda: f("list_aggregate", _L(), "product"), f"list_aggregate({_LS}, 'product')"),
    ("map_get", lambda: _s(f("map_extract", f("map", F.array(F.lit(1), F.lit(2)), F.array(c("p_size"), F.lit(5))), 1)), _ss("map_extract(MAP([1, 2], [p_size, 5]), 1)")),
    ("map_size", lambda: f("cardinality", f("map", F.array(F.lit(1), F.lit(2)), F.array(c("p_size"), F.lit(5)))), "CAST(cardinality(MAP([1, 2], [p_size, 5])) AS BIGINT)"),
    ("map_keys_", lambda: _s(f("map_keys", f("map", F.array(F.lit(1), F.lit(2)), F.array(c("p_size"), F.lit(5))))), _ss("map_keys(MAP([1, 2], [p_size, 5]))")),
    ("map_values_", lambda: _s(f("map_values", f("map", F.array(F.lit(1), F.lit(2)), F.array(c("p_size"), F.lit(5))))), _ss("map_values(MAP([1, 2], [p_size, 5]))")),
    ("struct_", lambda: f("struct_extract", f("struct_pack", a=c("p_size"), b=c("p_name")), "b"), "struct_extract(struct_pack(a := p_size, b := p_name), 'b')"),
    ("struct_more", lambda: f("struct_extract", f("struct_insert", f("struct_pack", a=c("p_size")), z=c("p_type")), "z"), "struct_extract(struct_insert(struct_pack(a := p_size), z := p_type), 'z')"),
    ("union_", lambda: f("union_tag", f("union_value", ["num", "str"], ["int", "string"], num=c("p_size"))), "CAST(union_tag(union_value(num := p_size)) AS VARCHAR)"),
    ("enum_", lambda: f("enum_code", c("p_type"), ["LARGE", "MEDIUM", "SMALL"]), "CAST(coalesce(list_position(['LARGE', 'MEDIUM', 'SMALL'], p_type), 0) - 1 AS INTEGER)"),
]

DATES: list[Case] = [
    *[(f"p_{p}", lambda p=p: f("date_part", p, c("o_orderdate")), f"CAST(date_part('{p}', o_orderdate) AS BIGINT)") for p in ("year", "month", "day", "decade", "century", "millennium", "quarter", "week", "isoyear", "yearweek", "dow", "isodow", "doy", "era", "hour", "minute", "second", "millisecond", "microsecond")],
    ("p_epoch", lambda: f("epoch", c("o_orderdate")), "epoch(o_orderdate)"),
    *[(f"t_{p}", lambda p=p: f("date_trunc", p, c("o_orderdate")).cast("timestamp_ntz"), f"CAST(date_trunc('{p}', o_orderdate) AS TIMESTAMP)") for p in ("day", "week", "month", "quarter", "year", "decade", "century", "hour")],
    *[(f"d_{p}", lambda p=p: f("date_diff", p, F.lit("1996-02-29").cast("timestamp_ntz"), c("o_orderdate")), f"date_diff('{p}', TIMESTAMP '1996-02-29', o_orderdate)") for p in ("day", "week", "month", "quarter", "year", "decade", "hour", "minute")],
    *[(f"s_{p}", lambda p=p: f("date_sub", p, F.lit("1996-02-15").cast("timestamp_ntz"), c("o_orderdate")), f"date_sub('{p}', TIMESTAMP '1996-02-15', o_orderdate)") for p in ("day", "week", "month", "year", "hour")],
    ("bucket_days", lambda: f("time_bucket", 10 * 86400 * 10**6, c("o_orderdate")), "CAST(time_bucket(INTERVAL '10 days', o_orderdate) AS TIMESTAMP)"),
    ("bucket_months", lambda: f("time_bucket", None, c("o_orderdate"), 5), "CAST(time_bucket(INTERVAL '5 months', o_orderdate) AS TIMESTAMP)"),
    ("last_", lambda: f("last_day", c("o_orderdate")), "last_day(o_orderdate)"),
    ("month_name", lambda: f("monthname", c("o_orderdate")), "monthname(o_orderdate)"),
    ("day_name", lambda: f("dayname", c("o_orderdate")), "dayname(o_orderdate)"),
    ("made", lambda: f("make_date", F.year("o_orderdate"), F.lit(2), F.lit(28)), "make_date(year(o_orderdate), 2, 28)"),
    ("ms", lambda: f("epoch_ms", c("o_orderdate")), "epoch_ms(o_orderdate)"),
    ("us", lambda: f("epoch_us", c("o_orderdate")), "epoch_us(o_orderdate)"),
    ("formatted", lambda: f("strftime", c("o_orderdate"), "%Y-%m-%d %H:%M:%S day %j"), "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S day %j')"),
    ("parsed", lambda: f("strptime", f("strftime", c("o_orderdate"), "%d/%m/%Y"), "%d/%m/%Y"), "strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y')"),
    ("added", lambda: f("date_add", c("o_orderdate"), "3 MONTH").cast("timestamp_ntz"), "o_orderdate + INTERVAL 3 MONTH"),
    ("added_days", lambda: (c("o_orderdate") + f("to_days", 5)).cast("timestamp_ntz"), "o_orderdate + to_days(5)"),
    ("added_years", lambda: (c("o_orderdate") + f("to_decades", 1)).cast("timestamp_ntz"), "o_orderdate + to_decades(1)"),
]

JSON: list[Case] = [
    ("extract_", lambda: f("json_extract", c("props"), "$.k"), "CAST(json_extract(props, '$.k') AS VARCHAR)"),
    ("extract_s", lambda: f("->>", c("props"), "k"), "json_extract_string(props, 'k')"),
    ("pointer", lambda: f("json_extract", c("props"), "/k"), "CAST(json_extract(props, '/k') AS VARCHAR)"),
    ("missing", lambda: f("json_extract_string", c("props"), "$.none"), "json_extract_string(props, '$.none')"),
    ("keys", lambda: f("array_to_string", f("json_keys", c("props")), ","), "array_to_string(json_keys(props), ',')"),
    ("valid", lambda: f("json_valid", c("props")), "json_valid(props)"),
    ("invalid", lambda: f("json_valid", F.concat(c("props"), F.lit("}"))), "json_valid(props || '}')"),
    ("kind", lambda: f("json_type", c("props")), "json_type(props)"),
    ("array_len", lambda: f("json_array_length", F.concat(F.lit("["), c("props"), F.lit(",1]"))), "CAST(json_array_length('[' || props || ',1]') AS BIGINT)"),
    ("cast_k", lambda: f("from_json", c("props"), "k long")["k"], "CAST(json_extract(props, '$.k') AS BIGINT)"),
    ("object_", lambda: f("json_object", F.struct(c("event_type").alias("t"), c("user_id").alias("u"))), "CAST(json_object('t', event_type, 'u', user_id) AS VARCHAR)"),
    ("merged", lambda: f("json_merge_patch", c("props"), F.lit('{"z":1}')), "replace(CAST(json_merge_patch(props, '{\"z\":1}') AS VARCHAR), ' ', '')"),
    ("has", lambda: f("json_contains", c("props"), '"k"'), "contains(props, '\"k\"')"),
]

VECTORS: list[Case] = [
    ("dot", lambda: F.round(f("list_inner_product", c("embedding"), f("list_reverse", c("embedding"))), 5), "round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 5)"),
    ("dist", lambda: F.round(f("list_distance", c("embedding"), f("list_reverse", c("embedding"))), 5), "round(list_distance(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 5)"),
    ("cosine", lambda: F.round(f("list_cosine_similarity", c("embedding"), f("list_reverse", c("embedding"))), 5), "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 5)"),
    ("cross_", lambda: F.round(F.get(f("array_cross_product", *[F.transform(F.slice("embedding", i, 3), lambda v: v.cast("double")) for i in (1, 4)]), 1), 6), "round(array_cross_product(CAST(embedding[1:3] AS DOUBLE[3]), CAST(embedding[4:6] AS DOUBLE[3]))[2], 6)"),
    ("n", lambda: f("array_length", c("embedding")), "CAST(array_length(embedding) AS BIGINT)"),
]

def x() -> Column:
    return c("l_extendedprice")


def y() -> Column:
    return c("l_quantity").cast("double")


def _o() -> tuple[Column, ...]:
    return c("l_orderkey"), c("l_linenumber"), c("l_partkey")


_os = "ORDER BY l_orderkey, l_linenumber, l_partkey"
AGGREGATES: list[Case] = [
    ("n", lambda: F.count("*"), "count(*)"),
    ("n_q", lambda: f("count", c("l_quantity")), "count(l_quantity)"),
    ("sum_q", lambda: f("sum", c("l_linenumber").cast("long")), "CAST(sum(l_linenumber) AS BIGINT)"),
    ("avg_", lambda: F.round(f("mean", x()), 4), "round(avg(l_extendedprice), 4)"),
    ("favg_", lambda: F.round(f("favg", x()), 4), "round(favg(l_extendedprice), 4)"),
    ("corr_", lambda: F.round(f("corr", x(), y()), 6), "round(corr(l_extendedprice, l_quantity), 6)"),
    ("covar_p", lambda: F.round(f("covar_pop", x(), y()), 2), "round(covar_pop(l_extendedprice, l_quantity), 2)"),
    ("covar_s", lambda: F.round(f("covar_samp", x(), y()), 2), "round(covar_samp(l_extendedprice, l_quantity), 2)"),
    ("std_p", lambda: F.round(f("stddev_pop", x()), 4), "round(stddev_pop(l_extendedprice), 4)"),
    ("std_s", lambda: F.round(f("stddev", x()), 4), "round(stddev(l_extendedprice), 4)"),
    ("var_p", lambda: F.round(f("var_pop", y()), 4), "round(var_pop(l_quantity), 4)"),
    ("var_s", lambda: F.round(f("variance", y()), 4), "round(variance(l_quantity), 4)"),
    ("sem_", lambda: F.round(f("sem", x()), 4), "round(sem(l_extendedprice), 4)"),
    ("skew", lambda: F.round(f("skewness", x()), 5), "round(skewness(l_extendedprice), 5)"),
    ("kurt", lambda: F.round(f("kurtosis", x()), 4), "round(kurtosis(l_extendedprice), 4)"),
    ("kurt_p", lambda: F.round(f("kurtosis_pop", x()), 4), "round(kurtosis_pop(l_extendedprice), 4)"),
    ("min_by_", lambda: f("arg_min", c("l_orderkey"), F.struct("l_extendedprice", "l_orderkey")), "arg_min(l_orderkey, row(l_extendedprice, l_orderkey))"),
    ("max_by_", lambda: f("arg_max", c("l_orderkey"), F.struct("l_extendedprice", "l_orderkey")), "arg_max(l_orderkey, row(l_extendedprice, l_orderkey))"),
    ("band_", lambda: f("bit_and", c("l_orderkey")), "bit_and(l_orderkey)"),
    ("bor_", lambda: f("bit_or", c("l_orderkey")), "bit_or(l_orderkey)"),
    ("bxor_", lambda: f("bit_xor", c("l_orderkey")), "bit_xor(l_orderkey)"),
    ("bool_a", lambda: f("bool_and", c("l_tax") < 0.5), "bool_and(l_tax < 0.5)"),
    ("bool_o", lambda: f("bool_or", c("l_tax") > 0.5), "bool_or(l_tax > 0.5)"),
    ("entropy_", lambda: F.round(f("entropy", c("l_linenumber")), 6), "round(entropy(l_linenumber), 6)"),
    ("fsum_", lambda: F.round(f("fsum", x()), 2), "round(fsum(l_extendedprice), 2)"),
    ("product_", lambda: F.round(f("product", F.lit(1) + c("l_tax") / 1e6), 6), "round(product(1 + l_tax / 1e6), 6)"),
    ("min_", lambda: f("min", c("l_shipdate")), "min(l_shipdate)"),
    ("max_", lambda: f("max", c("l_shipdate")), "max(l_shipdate)"),
    ("median_", lambda: F.round(f("median", x()), 4), "round(median(l_extendedprice), 4)"),
    ("mode_", lambda: f("mode", c("l_returnflag")), "mode(l_returnflag)"),
    ("q_disc", lambda: f("quantile_disc", "l_extendedprice", 0.3), "quantile_disc(l_extendedprice, 0.3)"),
    ("q_cont", lambda: F.round(f("quantile_cont", x(), 0.3), 4), "round(quantile_cont(l_extendedprice, 0.3), 4)"),
    ("hist", lambda: F.array_join(F.transform(F.map_entries(f("histogram", c("l_linenumber"))), lambda e: F.concat_ws(":", e["key"], e["value"])), ","), "array_to_string(list_transform(map_entries(histogram(l_linenumber)), lambda e: concat(e.key, ':', e.value)), ',')"),
    ("bits", lambda: f("bitstring_agg", c("l_linenumber"), 0, 9), "CAST(bitstring_agg(l_linenumber, 0, 9) AS VARCHAR)"),
    *[(f"r_{k}", lambda k=k: F.round(f(f"regr_{k}", x(), y()), 3), f"round(regr_{k}(l_extendedprice, l_quantity), 3)") for k in ("avgx", "avgy", "count", "intercept", "r2", "slope")],
    *[(f"r_{k}", lambda k=k: F.round(f(f"regr_{k}", x(), y()) / 1e6, 3), f"round(regr_{k}(l_extendedprice, l_quantity) / 1e6, 3)") for k in ("sxx", "sxy", "syy")],
    ("filtered", lambda: F.count_if(c("l_tax") > 0.04), "count(*) FILTER (l_tax > 0.04)"),
    ("distinct_", lambda: F.count_distinct("l_partkey"), "count(DISTINCT l_partkey)"),
    ("sum_distinct", lambda: F.sum_distinct("l_linenumber"), "CAST(sum(DISTINCT l_linenumber) AS BIGINT)"),
    ("geo", lambda: F.round(f("geomean", x()), 3), "round(geomean(l_extendedprice), 3)"),
]


#: Each result is as long as its group, so these run over many groups.
ORDERED: list[Case] = [
    ("listed", lambda: f("md5", F.array_join(f("list", c("l_linenumber"), *_o()), ",")), f"md5(array_to_string(list(l_linenumber {_os}), ','))"),
    ("joined", lambda: f("md5", f("string_agg", c("l_linenumber"), "-", *_o())), f"md5(string_agg(CAST(l_linenumber AS VARCHAR), '-' {_os}))"),
    ("first_", lambda: f("first", c("l_partkey"), *_o()), f"first(l_partkey {_os})"),
    ("last_", lambda: f("last", c("l_partkey"), *_o()), f"last(l_partkey {_os})"),
]


MORE: list[Case] = [
    ("sum_", lambda: f("list_sum", F.array(c("p_size"), F.lit(2), F.lit(None).cast("int"))).cast("long"), "CAST(list_sum([p_size, 2, NULL]) AS BIGINT)"),
    ("avg_", lambda: F.round(f("list_avg", F.array(c("p_size"), F.lit(2))), 6), "round(list_avg([p_size, 2]), 6)"),
    ("count_", lambda: f("list_count", F.array(c("p_size"), F.lit(None).cast("int"))).cast("long"), "list_count([p_size, NULL])"),
    ("min_", lambda: f("list_min", F.array(c("p_size"), F.lit(7))), "list_min([p_size, 7])"),
    ("max_", lambda: f("list_max", F.array(c("p_size"), F.lit(7))), "list_max([p_size, 7])"),
    ("median_", lambda: f("list_median", F.array(c("p_size"), F.lit(7), F.lit(20))).cast("double"), "list_median([p_size, 7, 20])"),
    ("fmt", lambda: f("format", "{}-{{}}-{}", c("p_name"), c("p_size")), "format('{}-{{}}-{}', p_name, p_size)"),
    ("fmt_n", lambda: f("format", "{1} {0}", c("p_name"), c("p_size")), "format('{1} {0}', p_name, p_size)"),
    ("esc", lambda: f("like_escape", c("p_name"), F.lit("%$%%"), F.lit("$")), "like_escape(p_name, '%$%%', '$')"),
    ("up", lambda: f("md5_number_upper", c("p_name")).cast("string"), "CAST(md5_number_upper(p_name) AS VARCHAR)"),
    ("low", lambda: f("md5_number_lower", c("p_name")).cast("string"), "CAST(md5_number_lower(p_name) AS VARCHAR)"),
    ("time_", lambda: f("make_time", c("p_size") % 24, c("p_partkey") % 60, c("p_size") / 2), "CAST(make_time(p_size % 24, p_partkey % 60, p_size / 2) AS VARCHAR)"),
    ("url", lambda: f("url_decode", f("url_encode", c("p_name"))), "url_decode(url_encode(p_name))"),
    ("null_", lambda: f("nullif", c("p_size"), 7), "nullif(p_size, 7)"),
    ("if_", lambda: f("if", c("p_size") > 25, "big", "small"), "if(p_size > 25, 'big', 'small')"),
    ("lcm_", lambda: f("lcm", c("p_partkey") * 1_000_003, c("p_partkey")), "lcm(p_partkey * 1000003, p_partkey)"),
    ("div_", lambda: f("//", F.lit(9007199254740993), c("p_size")), "9007199254740993 // p_size"),
]


def _l() -> Column:
    return F.array(c("p_size"), F.lit(2), F.lit(2))


def _of_list(name: str) -> Case:
    return f"{name}_", lambda: F.round(f(f"list_{name}", _l()).cast("double"), 6), f"round(CAST(list_{name}([p_size, 2, 2]) AS DOUBLE), 6)"


#: Functions that no other query names.
REST: list[Case] = [
    *[_of_list(n) for n in ("product", "var_pop", "var_samp", "stddev_pop", "stddev_samp")],
    ("first_", lambda: f("list_first", _l()), "list_first([p_size, 2, 2])"),
    ("last_", lambda: f("list_last", _l()), "list_last([p_size, 2, 2])"),
    ("mode_", lambda: f("list_mode", F.array(c("p_size"), F.lit(2), F.lit(2), c("p_size"), F.lit(2))), "list_mode([p_size, 2, 2, p_size, 2])"),
    ("unique_", lambda: f("list_approx_count_distinct", _l()).cast("long"), "CAST(len(list_distinct([p_size, 2, 2])) AS BIGINT)"),
    ("and_", lambda: f("list_bool_and", F.array(c("p_size") > 5, F.lit(True))), "list_bool_and([p_size > 5, true])"),
    ("or_", lambda: f("list_bool_or", F.array(c("p_size") > 5, F.lit(False))), "list_bool_or([p_size > 5, false])"),
    ("joined_", lambda: f("list_string_agg", F.array(c("p_name"), F.lit("x"))), "list_string_agg([p_name, 'x'])"),
    ("value_", lambda: F.array_join(f("list_value", c("p_size"), F.lit(1)), ","), "array_to_string(list_value(p_size, 1), ',')"),
    ("zip_", lambda: F.array_join(F.transform(f("list_zip", F.array(c("p_size"), F.lit(1)), F.array(F.lit(7))), lambda s: F.to_json(F.struct(F.coalesce(s["0"], F.lit(-1)).alias("a"), F.coalesce(s["1"], F.lit(-1)).alias("b")))), ""), "concat('{\"a\":', p_size, ',\"b\":7}{\"a\":1,\"b\":-1}')"),
    ("subs", lambda: F.array_join(f("generate_subscripts", F.array(c("p_size"), c("p_size"))), ","), "array_to_string((SELECT list(i) FROM (SELECT generate_subscripts([p_size, p_size], 1) AS i)), ',')"),
    ("entries", lambda: F.array_join(F.transform(f("map_entries", F.create_map(c("p_name"), c("p_size"))), lambda e: F.concat_ws(":", e["key"], e["value"])), ","), "array_to_string(list_transform(map_entries(MAP {p_name: p_size}), lambda e: concat(e.key, ':', e.value)), ',')"),
    ("from_entries", lambda: f("map_from_entries", F.array(F.struct(F.lit("a"), c("p_size"))))["a"], "map_from_entries([('a', p_size)])['a']"),
    ("concat_", lambda: f("map_concat", F.create_map(F.lit("a"), c("p_size")), F.create_map(F.lit("b"), F.lit(2)))["b"], "map_concat(MAP {'a': p_size}, MAP {'b': 2})['b']"),
    ("has_key", lambda: f("map_contains", F.create_map(F.lit("a"), c("p_size")), "a"), "map_contains(MAP {'a': p_size}, 'a')"),
    ("row_", lambda: f("row", c("p_size"), c("p_name"))["p_name"], "row(p_size, p_name)[2]"),
    ("bank", lambda: f("round_even", c("p_size") / 2, 0), "round_even(p_size / 2, 0)"),
    ("plus", lambda: f("add", c("p_size"), 3), "add(p_size, 3)"),
    ("minus", lambda: f("subtract", c("p_size"), 3), "subtract(p_size, 3)"),
    ("times", lambda: f("multiply", c("p_size"), 3), "multiply(p_size, 3)"),
    ("is_null", lambda: f("isnull", F.nullif(c("p_size"), F.lit(7))), "nullif(p_size, 7) IS NULL"),
    ("either", lambda: f("ifnull", F.nullif(c("p_size"), F.lit(7)), 0), "ifnull(nullif(p_size, 7), 0)"),
    ("not_like", lambda: f("not_like_escape", c("p_name"), F.lit("%a$%%"), F.lit("$")), "not_like_escape(p_name, '%a$%%', '$')"),
    ("ilike_", lambda: f("ilike_escape", c("p_name"), F.lit("%A%"), F.lit("$")), "ilike_escape(p_name, '%A%', '$')"),
    ("not_ilike", lambda: f("not_ilike_escape", c("p_name"), F.lit("%A%"), F.lit("$")), "not_ilike_escape(p_name, '%A%', '$')"),
    ("path", lambda: F.array_join(f("parse_path", F.concat(F.lit("/a/"), c("p_name"))), "|"), "array_to_string(parse_path('/a/' || p_name), '|')"),
    ("unbin_", lambda: F.decode(f("unbin", F.lit("0110000101100010")), "UTF-8"), "CAST(unbin('0110000101100010') AS VARCHAR)"),
    ("size_", lambda: f("formatreadabledecimalsize", c("p_size") * 123456), "formatReadableDecimalSize(p_size * 123456)"),
    ("array_json", lambda: f("json_array", c("p_size"), c("p_name")), "CAST(json_array(p_size, p_name) AS VARCHAR)"),
    ("object_json", lambda: f("json_object", "a", c("p_size"), "b", c("p_name")), "CAST(json_object('a', p_size, 'b', p_name) AS VARCHAR)"),
    ("strict", lambda: f("json_transform_strict", F.concat(F.lit('{"a": '), c("p_size").cast("string"), F.lit("}")), "a int")["a"], "json_transform_strict('{\"a\": ' || p_size || '}', '{\"a\": \"INTEGER\"}').a"),
    ("enum_a", lambda: f("enum_first", c("p_type"), ["S", "M"]), "CAST('S' AS VARCHAR)"),
    ("enum_b", lambda: f("enum_last", c("p_type"), ["S", "M"]), "CAST('M' AS VARCHAR)"),
]


def _part(name: str) -> Case:
    return f"{name}_", lambda: f(name, c("o_orderdate")).cast("long"), f"CAST({name}(o_orderdate) AS BIGINT)"


def _unit(name: str) -> Case:
    return name, lambda: c("o_orderdate").cast("timestamp_ntz") + f(name, (c("o_custkey") % 3).cast("int")), f"o_orderdate + {name}(CAST(o_custkey % 3 AS INTEGER))"


REST_DATES: list[Case] = [
    *[_part(n) for n in ("year", "month", "day", "decade", "century", "millennium", "quarter", "week", "isoyear", "yearweek", "dayofweek", "isodow", "dayofyear", "era", "hour", "minute", "second", "millisecond", "microsecond", "weekday", "weekofyear", "dayofmonth")],
    *[_unit(n) for n in ("to_microseconds", "to_milliseconds", "to_seconds", "to_minutes", "to_hours", "to_weeks", "to_months", "to_years", "to_centuries", "to_millennia")],
    ("ns", lambda: f("epoch_ns", c("o_orderdate")), "epoch_ns(o_orderdate)"),
    ("made", lambda: f("make_timestamp", F.year("o_orderdate"), 2, 3, 4, 5, 6.5).cast("timestamp_ntz"), "make_timestamp(year(o_orderdate), 2, 3, 4, 5, 6.5)"),
    ("parsed", lambda: f("try_strptime", F.concat(c("o_orderkey").cast("string"), F.lit("x")), "%Y-%m-%d"), "try_strptime(o_orderkey || 'x', '%Y-%m-%d')"),
    ("years", lambda: f("age", F.lit("2010-06-15").cast("timestamp_ntz"), c("o_orderdate").cast("timestamp_ntz"))["years"].cast("long"), "date_part('year', age(TIMESTAMP '2010-06-15', o_orderdate))"),
    ("months", lambda: f("age", F.lit("2010-06-15").cast("timestamp_ntz"), c("o_orderdate").cast("timestamp_ntz"))["months"].cast("long"), "date_part('month', age(TIMESTAMP '2010-06-15', o_orderdate))"),
]


def _rows(name: str, keys: list[str], cases: list[Case]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, name).select(*keys, *[of().alias(alias) for alias, of, _ in cases])

    return run, f"SELECT {', '.join(keys)}, " + ", ".join(f"{sql} AS {alias}" for alias, _, sql in cases) + f" FROM {name}"


def _groups(name: str, keys: list[str], cases: list[Case]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """DISTINCT aggregates repeat each row for each of them, so they have a pass of their own columns;
        both results are a row per group."""
        groups = table(spark, sf_dir, name).groupBy(*keys)
        plain = groups.agg(*[of().alias(alias) for alias, of, sql in cases if "(DISTINCT" not in sql])
        if not any("(DISTINCT" in sql for _, _, sql in cases):
            return plain
        return plain.join(groups.agg(*[of().alias(alias) for alias, of, sql in cases if "(DISTINCT" in sql]), keys)

    return run, f"SELECT {', '.join(keys)}, " + ", ".join(f"{sql} AS {alias}" for alias, _, sql in cases) + f" FROM {name} GROUP BY {', '.join(keys)}"


ALL = {
    "fn_strings": _rows("part", ["p_partkey"], STRINGS),
    "fn_math": _rows("part", ["p_partkey"], MATH),
    "fn_lists": _rows("part", ["p_partkey"], LISTS),
    "fn_dates": _rows("orders", ["o_orderkey"], DATES),
    "fn_json": _rows("events", ["event_id"], JSON),
    "fn_vectors": _rows("embeddings", ["vec_id"], VECTORS),
    "fn_rest": _rows("part", ["p_partkey"], REST),
    "fn_rest_dates": _rows("orders", ["o_orderkey"], REST_DATES),
    "fn_more": _rows("part", ["p_partkey"], MORE),
    "fn_ordered_aggregates": _groups("lineitem", ["l_suppkey", "l_returnflag"], ORDERED),
    "fn_mad": _groups("lineitem", ["l_suppkey"], [("mad_", lambda: F.round(f("mad", c("l_quantity")), 4), "round(mad(l_quantity), 4)")]),
    "fn_aggregates": _groups("lineitem", ["l_returnflag", "l_linestatus"], AGGREGATES),
}
QUERIES = {k: run for k, (run, _) in ALL.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in ALL.items()}
