"""Sinks and changes to stored tables.

A stored table is a folder of Parquet files and of versions. A version is a small file that lists the
table's files; a change writes new files for those that it touches and then commits the next version
by a rename that fails if that version is there already. So readers see one version or the other, a
failed write leaves no trace, and of two writers one gets an error and may try again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.joins import positions
from quarry.storage import scratch, shared_folder

__all__ = ["Sequence", "StoredTable", "copy_to", "export_tables", "import_tables", "scratch", "shared_folder"]


def copy_to(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] = (), order: list[str] = (), rows_per_file: int | None = None, mode: str = "errorifexists", **options) -> str:
    """COPY df TO path. order keeps an order across files by a range partition; rows_per_file bounds them."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.write.mode(mode).options(**options)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)
    return path


def export_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """EXPORT DATABASE: a folder for each table, and their schemas as DDL under `schema`."""
    for name, df in tables.items():
        copy_to(df, f"{folder}/{name}", kind)
    if tables:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(n, df.schema.toDDL() if hasattr(df.schema, "toDDL") else df._jdf.schema().toDDL()) for n, df in tables.items()], "name string, ddl string").coalesce(1).write.mode("overwrite").json(f"{folder}/schema")


def import_tables(spark: SparkSession, folder: str, names: list[str] | None = None, kind: str = "parquet") -> dict[str, DataFrame]:
    """IMPORT DATABASE: the tables of an export as temporary views; all of them, if no names are given."""
    if names is None:
        ddl = {r["name"]: r["ddl"] for r in spark.read.json(f"{folder}/schema").collect()}
        out = {name: spark.read.format(kind).schema(text).load(f"{folder}/{name}") for name, text in ddl.items()}
    else:
        out = {name: spark.read.format(kind).load(f"{folder}/{name}") for name in names}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


class Sequence:
    """CREATE SEQUENCE: a counter under a folder, whose blocks of values are taken by the rename that
    commits a table's version, so two writers never get a value twice. Values of a failed statement are
    lost, as usual."""

    def __init__(self, spark: SparkSession, folder: str, start: int = 1, step: int = 1) -> None:
        if step == 0:
            raise ValueError("a sequence's step is not 0")
        self.start, self.step, self._log = start, step, StoredTable(spark, folder)

    def _taken(self) -> int:
        n = self._log.version()
        return 0 if n < 0 else self._log._manifest(n)["files"][0]

    def take(self, n: int) -> int:
        """The first of n values that are this caller's alone."""
        version = self._log.version()
        taken = 0 if version < 0 else self._log._manifest(version)["files"][0]
        self._log._commit(version, StructType([]), [taken + n])
        return self.start + taken * self.step

    def currval(self) -> int:
        """The last value taken by any caller."""
        if not (taken := self._taken()):
            raise ValueError("no value was taken yet")
        return self.start + (taken - 1) * self.step

    def nextval(self, df: DataFrame, order: list[str], name: str) -> DataFrame:
        """df with a value a row, in an order; no task sees all rows."""
        rows = positions(df, order, "__seq")
        first = self.take(rows.count())
        return rows.withColumn(name, F.lit(first).cast("long") + F.col("__seq") * F.lit(self.step)).drop("__seq")


class StoredTable:
    """A table with inserts, updates, deletes and upserts. Constraints given to it are enforced: a change
    that breaks one is an error and leaves the table as it was. `generated` columns are computed from the
    others at every change and cannot be set. `references` are (columns, parent, its columns): a row whose
    columns are not null needs a row there. The parent's own changes do not look for rows that need them."""

    def __init__(self, spark: SparkSession, folder: str, not_null: list[str] = (), unique: list[list[str]] = (), conditions: dict[str, Column] | None = None, defaults: dict[str, Column] | None = None, generated: dict[str, Column] | None = None, references: list[tuple[list[str], StoredTable, list[str]]] = ()) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.not_null, self.unique, self.conditions, self.defaults = list(not_null), [list(u) for u in unique], conditions or {}, defaults or {}
        self.generated, self.references = dict(generated or {}), list(references)
        #: RETURNING: the rows that the last insert, update or upsert wrote, or the last delete took away.
        #: It reads the versions' files, so it holds after later changes; an update's values that are not
        #: deterministic differ from what was written.
        self.returned: DataFrame | None = None

    # Files

    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path, self.spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self):
        _, path, conf = self._hadoop()
        return path(self.folder).getFileSystem(conf)

    def _version_path(self, n: int):
        return self._hadoop()[1](f"{self.folder}/_versions/{n:012d}")

    def version(self) -> int:
        """The last version, -1 before the first."""
        found = self._fs().globStatus(self._hadoop()[1](f"{self.folder}/_versions/[0-9]*"))
        return max((int(x.getPath().getName()) for x in found or []), default=-1)

    def _manifest(self, n: int) -> dict:
        jvm = self._hadoop()[0]
        stream = self._fs().open(self._version_path(n))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, n: int, schema: StructType, files: list[str]) -> StoredTable:
        """Version n + 1, unless another writer made it since n was read."""
        jvm, path, conf = self._hadoop()
        own = path(f"{self.folder}/_versions/.{uuid.uuid4().hex}")
        stream = self._fs().create(own, False)
        stream.write(json.dumps({"schema": schema.jsonValue(), "files": files}).encode())
        stream.close()
        to = self._version_path(n + 1)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else self._fs().getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs().makeQualified(own), self._fs().makeQualified(to), none)
        except Exception as e:
            self._fs().delete(own, False)
            raise RuntimeError(f"version {n + 1} was written by another writer") from e
        return self

    def _add(self, df: DataFrame) -> list[str]:
        """Write files and name them."""
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        found = self._fs().globStatus(self._hadoop()[1](f"{self.folder}/{name}/part-*"))
        return [f"{name}/{x.getPath().getName()}" for x in found or []]

    def _read(self, schema: StructType, files: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in files]) if files else self.spark.createDataFrame([], schema)

    def _now(self) -> tuple[int, StructType, list[str]]:
        n = self.version()
        if n < 0:
            raise ValueError("the table was not created")
        m = self._manifest(n)
        return n, StructType.fromJson(m["schema"]), m["files"]

    def read(self, version: int | None = None) -> DataFrame:
        m = self._manifest(self.version() if version is None else version)
        return self._read(StructType.fromJson(m["schema"]), m["files"])

    def _touched(self, schema: StructType, files: list[str], hit: Column) -> list[str]:
        """The files that hold a row of the condition; the others stay as they are."""
        if not files:
            return []
        rows = self._read(schema, files).filter(F.coalesce(hit, F.lit(False))).select(F.input_file_name().alias("f")).distinct().collect()  # a row per file
        names = {"/".join(r["f"].rsplit("/", 2)[-2:]) for r in rows}
        return [f for f in files if f in names]

    # Changes

    def _computed(self, df: DataFrame) -> DataFrame:
        """Generated columns anew, of the types that they have if they are there."""
        kinds = {f.name: f.dataType for f in df.schema}
        return df.withColumns({c: v.cast(kinds[c]) if c in kinds else v for c, v in self.generated.items()}) if self.generated else df

    def _settable(self, names) -> None:
        if fixed := sorted(set(names) & set(self.generated)):
            raise ValueError(f"generated columns cannot be set: {', '.join(fixed)}")

    def create(self, df: DataFrame) -> StoredTable:
        self._settable(df.columns)
        df = self._computed(df)
        self._enforce(df)
        return self._commit(self.version(), df.schema, self._add(df))

    def insert(self, df: DataFrame) -> StoredTable:
        """New files alone. Columns that df lacks take their defaults, else null."""
        n, schema, files = self._now()
        self._settable(df.columns)
        more = self._computed(df.select(*[F.col(f.name) if f.name in df.columns else self.defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]))
        self._enforce(more, self._read(schema, files))
        return self._inserted(n, schema, files, more)

    def _inserted(self, n: int, schema: StructType, files: list[str], more: DataFrame) -> StoredTable:
        new = self._add(more)
        self._commit(n, schema, files + new)
        self.returned = self._read(schema, new)
        return self

    def delete(self, condition: Column) -> StoredTable:
        """Rows where the condition is null stay."""
        n, schema, files = self._now()
        touched = self._touched(schema, files, condition)
        old, gone = self._read(schema, touched), F.coalesce(condition, F.lit(False))
        self._commit(n, schema, [f for f in files if f not in touched] + (self._add(old.filter(~gone)) if touched else []))
        self.returned = old.filter(gone)
        return self

    def truncate(self) -> StoredTable:
        n, schema, _ = self._now()
        return self._commit(n, schema, [])

    def update(self, values: dict[str, Column], condition: Column | None = None) -> StoredTable:
        self._settable(values)
        n, schema, files = self._now()
        hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        touched = self._touched(schema, files, hit)
        rest = [f for f in files if f not in touched]
        old = self._read(schema, touched)
        set_ = {c: v.cast(schema[c].dataType) for c, v in values.items()}
        new = self._computed(old.select(*[F.when(hit, set_[c]).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in schema.names]))
        self._enforce(new, self._read(schema, rest))
        self._commit(n, schema, rest + (self._add(new) if touched else []))
        self.returned = self._computed(old.filter(hit).select(*[set_.get(c, F.col(c)).alias(c) for c in schema.names]))
        return self

    def upsert(self, df: DataFrame, keys: list[str], action: str = "replace", values: list[str] | None = None) -> StoredTable:
        """INSERT .. ON CONFLICT (keys): action replace (DO UPDATE of `values`, else all) or ignore (DO
        NOTHING). Null keys never conflict. New rows that share a key: of those the least stays with
        ignore, as one must; with replace they are an error, as one row cannot be set twice."""
        n, schema, files = self._now()
        self._settable({*df.columns, *keys, *(values or [])})
        cols, now = schema.names, self._read(schema, files)
        new = self._computed(df.withColumns({c: F.lit(None).cast(schema[c].dataType) for c in self.generated}).select(cols))
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        keyed, free = new.filter(known), new.filter(~known)
        if action == "ignore":
            rest = [c for c in cols if c not in keys]
            one = keyed.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*").select(cols) if rest else keyed.distinct()
            more = one.join(now.select(*keys), keys, "left_anti").unionByName(free)
            self._enforce(more, now)
            return self._inserted(n, schema, files, more)
        if not keyed.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"new rows share a key ({', '.join(keys)})")
        take = set(cols if values is None else values) - set(keys)
        at = now.select(F.input_file_name().alias("__f"), *keys).join(keyed.select(*keys), keys, "left_semi") if files else None
        names = {"/".join(r["__f"].rsplit("/", 2)[-2:]) for r in at.select("__f").distinct().collect()} if files else set()  # a row per file
        touched = [f for f in files if f in names]
        rest = [f for f in files if f not in touched]
        a = self._read(schema, touched).select(F.struct(*cols).alias("o"), *keys)
        b = keyed.select(F.struct(*cols).alias("n"), *keys)
        both = a.join(b, keys, "full")
        pick = [F.when(F.col("n").isNotNull() & (F.col("o").isNull() | F.lit(c in take)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in cols]
        changed = self._computed(both.select(*pick).unionByName(free))
        self._enforce(changed, self._read(schema, rest))
        self._commit(n, schema, rest + self._add(changed))
        self.returned = self._computed(both.filter("n is not null").select(*pick).unionByName(free))
        return self

    def add_column(self, name: str, kind: str) -> StoredTable:
        """ALTER TABLE .. ADD COLUMN: null in the rows that are there; no file is written again."""
        n, schema, files = self._now()
        if name in schema.names:
            raise ValueError(f"there is a column {name}")
        return self._commit(n, StructType([*schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields]), files)

    def drop_column(self, name: str) -> StoredTable:
        """ALTER TABLE .. DROP COLUMN: files are written again without it, so that a later column of its
        name starts empty."""
        n, schema, files = self._now()
        kept = StructType([f for f in schema.fields if f.name != name])
        self.generated.pop(name, None)
        return self._commit(n, kept, self._add(self._read(schema, files).select(*kept.names)) if files else [])

    def rename_column(self, old: str, new: str) -> StoredTable:
        """ALTER TABLE .. RENAME COLUMN."""
        n, schema, files = self._now()
        df = self._read(schema, files).withColumnRenamed(old, new)
        self.generated = {new if c == old else c: v for c, v in self.generated.items()}
        return self._commit(n, df.schema, self._add(df) if files else [])

    # Constraints

    def _enforce(self, new: DataFrame, others: DataFrame | None = None) -> None:
        """An error if the new rows break a constraint, among themselves or with the other rows."""
        broken = _broken(new, self.not_null, [], self.conditions)
        for keys in self.unique:
            rows = new.dropna(subset=keys).select(*keys)
            twice = not rows.groupBy(*keys).count().filter("count > 1").isEmpty()
            if twice or (others is not None and not rows.join(others.select(*keys), keys, "left_semi").isEmpty()):
                broken.append(f"unique({','.join(keys)})")
        for cols, parent, keys in self.references:
            theirs = parent.read().select(*[F.col(k).alias(c) for c, k in zip(cols, keys, strict=True)])
            if not new.dropna(subset=cols).select(*cols).join(theirs, cols, "left_anti").isEmpty():
                broken.append(f"references({','.join(cols)})")
        if broken:
            raise ValueError(f"constraints broken: {', '.join(broken)}")

    def check(self, not_null: list[str] = (), unique: list[list[str]] = (), conditions: dict[str, Column] | None = None) -> list[str]:
        """Names of the constraints that some row breaks."""
        return _broken(self.read(), not_null, unique, conditions)


def _broken(now: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), conditions: dict[str, Column] | None = None) -> list[str]:
    broken = []
    aggs = [F.count_if(F.col(c).isNull()).alias(f"not_null({c})") for c in not_null]
    aggs += [F.count_if(~F.coalesce(v, F.lit(True))).alias(k) for k, v in (conditions or {}).items()]
    if aggs:
        broken += [k for k, v in now.agg(*aggs).first().asDict().items() if v]
    for keys in unique:
        if not now.dropna(subset=keys).groupBy(*keys).count().filter("count > 1").isEmpty():
            broken.append(f"unique({','.join(keys)})")
    return broken
