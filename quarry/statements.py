"""Statements around a query of the dialect: COPY to and from files, and CREATE .. AS, INSERT and EXPLAIN
whose query is rewritten as any other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.sql import Group, _join, _low, _split

#: Options of COPY and the reader's or writer's option of each kind; fixed values.
_CSV = {"delim": "sep", "delimiter": "sep", "sep": "sep", "quote": "quote", "escape": "escape", "null": "nullValue", "nullstr": "nullValue", "dateformat": "dateFormat", "timestampformat": "timestampFormat"}
_KINDS = {"parquet": "parquet", "csv": "csv", "json": "json", "ndjson": "json", "orc": "orc"}


def _value(part) -> str:
    return part[1:-1].replace("''", "'") if isinstance(part, str) and part[:1] == "'" else str(part)


def _options(parts: list) -> dict[str, object]:
    """(NAME, NAME value, NAME (a, b)) by lower-case name."""
    if not parts:
        return {}
    if len(parts) != 1 or not isinstance(parts[0], Group):
        raise ValueError(f"cannot read the options of COPY: {parts}")
    out: dict[str, object] = {}
    for item in _split(parts[0].parts):
        if not item:
            continue
        rest = item[1:]
        if rest and isinstance(rest[0], Group):
            out[_low(item[0])] = [_join([x for x in p]).strip('"') for p in _split(rest[0].parts)]
        else:
            out[_low(item[0])] = _value(rest[0]) if rest else "true"
    return out


def _kind(path: str, options: dict[str, object]) -> str:
    name = str(options.pop("format", "")).lower() or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if name not in _KINDS:
        if "." in path.rsplit("/", 1)[-1] or not name:
            raise ValueError(f"COPY has no format {name!r}")
        name = "csv"
    return _KINDS[name]


def _flag(options: dict[str, object], name: str, default: bool) -> bool:
    return str(options.pop(name, default)).lower() in ("true", "1")


def _io(kind: str, options: dict[str, object]) -> dict[str, object]:
    """Spark's options; an error for those that are not known, as silence would change the file."""
    out: dict[str, object] = {}
    if kind == "csv":
        out = {"header": _flag(options, "header", True), "escape": '"'} | {_CSV[k]: options.pop(k) for k in list(options) if k in _CSV}
    if (codec := options.pop("compression", options.pop("codec", None))) is not None:
        out["compression"] = str(codec).lower()
    if options:
        raise ValueError(f"COPY does not know {', '.join(sorted(options))}")
    return out


def copy(spark: SparkSession, parts: list, query: Callable[[list], DataFrame]) -> DataFrame:
    """COPY (query) or table TO 'path' (options); COPY table FROM 'path' (options). One row: Count, of the
    rows that were written. A path is a folder, as each task writes a file of its own; one that is there is
    an error without OVERWRITE. A format that is not named is the path's suffix, else CSV with a header."""
    words = [_low(p) for p in parts]
    way = next((k for k, w in enumerate(words) if w in ("to", "from")), 0)
    if not way or way + 1 >= len(parts):
        raise ValueError("COPY needs TO or FROM and a path")
    path, options = _value(parts[way + 1]), _options([p for p in parts[way + 2 :] if _low(p) != "with"])
    subject, kind, seen = parts[1:way], _kind(path, options), Observation()
    if words[way] == "to":
        if len(subject) == 1 and isinstance(subject[0], Group):
            df = query(subject[0].parts)
        else:
            columns = subject.pop().parts if isinstance(subject[-1], Group) else ["*"]
            df = query(["select", *columns, "from", *subject])
        mode = "overwrite" if _flag(options, "overwrite", False) or _flag(options, "overwrite_or_ignore", False) else "errorifexists"
        by = options.pop("partition_by", [])
        writer = df.observe(seen, F.count(F.lit(1)).alias("Count")).write.mode(mode).options(**_io(kind, options))
        (writer.partitionBy(*([by] if isinstance(by, str) else by)) if by else writer).format(kind).save(path)
    else:
        names = [_join([x for x in p]).strip('"') for p in _split(subject.pop().parts)] if isinstance(subject[-1], Group) else None
        name = _join(subject)
        into = spark.table(name)
        schema = into.select(*names).schema if names else into.schema
        rows = spark.read.options(mode="FAILFAST", **_io(kind, options)).schema(schema).format(kind).load(path)
        lacking = {f.name: F.lit(None).cast(f.dataType) for f in into.schema if f.name not in schema.names}
        rows.withColumns(lacking).select(*into.columns).observe(seen, F.count(F.lit(1)).alias("Count")).write.insertInto(name)
    return spark.createDataFrame([(seen.get["Count"],)], "Count long")


def head_and_query(parts: list) -> tuple[list, list] | None:
    """CREATE .. AS, INSERT and EXPLAIN: what stands before their query, and that; None without one."""
    words = [_low(p) for p in parts]
    if words[0] == "create":
        at = next((k + 1 for k, w in enumerate(words) if w == "as"), None)
    else:
        at = next((k for k, w in enumerate(words) if k and w in ("select", "from", "with")), None)
    if at is None or at >= len(parts):
        return None
    if isinstance(parts[at], Group) and parts[at].open == "(" and at + 1 == len(parts):
        return parts[:at], parts[at].parts
    return (parts[:at], parts[at:]) if words[at] in ("select", "from", "with") else None
