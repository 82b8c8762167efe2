"""Sources: files of every kind by path or glob, generated rows, and what files say of themselves."""

from __future__ import annotations

import csv as _csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str | list[str], union_by_name: bool = False, filename: bool = False, file_row_number: bool = False, hive_partitioning: bool = True) -> DataFrame:
    reader = spark.read.option("mergeSchema", union_by_name)
    if not hive_partitioning:
        reader = reader.option("recursiveFileLookup", True)
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    extra = []
    if filename:
        extra.append(F.col("_metadata.file_path").alias("filename"))
    if file_row_number:
        extra.append(F.col("_metadata.row_index").alias("file_row_number"))
    return df.select("*", *extra) if extra else df


def read_csv(spark: SparkSession, path: str, columns: str | None = None, header: bool = True, delim: str = ",", quote: str = '"', escape: str = '"', nullstr: str = "", all_varchar: bool = False, ignore_errors: bool = False, rejects: str | None = None, dateformat: str | None = None, timestampformat: str | None = None, compression: str | None = None, **options) -> DataFrame:
    """columns: a DDL schema; without one types are inferred in a pass of its own. ignore_errors drops rows
    that do not fit, rejects keeps them with their text in a column of that name."""
    reader = spark.read.options(header=header, sep=delim, quote=quote, escape=escape, nullValue=nullstr, **options)
    for k, v in (("dateFormat", dateformat), ("timestampFormat", timestampformat), ("compression", compression)):
        if v:
            reader = reader.option(k, v)
    reader = reader.option("mode", "DROPMALFORMED" if ignore_errors else "PERMISSIVE" if rejects else "FAILFAST")
    if rejects:
        reader = reader.option("columnNameOfCorruptRecord", rejects)
        columns = f"{columns}, {rejects} string"
    reader = reader.schema(columns) if columns else reader.option("inferSchema", not all_varchar)
    return reader.csv(path)


def sniff_csv(spark: SparkSession, path: str, sample: int = 200) -> dict:
    """The dialect, header and types of a file, from its first lines."""
    lines = [r.value for r in spark.read.text(path).limit(sample).collect()]
    text = "\n".join(lines)
    dialect = _csv.Sniffer().sniff(text, delimiters=",;|\t")
    header = _csv.Sniffer().has_header(text)
    df = spark.read.options(header=header, sep=dialect.delimiter, quote=dialect.quotechar, inferSchema=True).csv(spark.sparkContext.parallelize(lines, 1))
    return {"delimiter": dialect.delimiter, "quote": dialect.quotechar, "has_header": header, "columns": dict(df.dtypes)}


def read_json(spark: SparkSession, path: str, columns: str | None = None, format: str = "newline_delimited", ignore_errors: bool = False, sample_ratio: float = 1.0) -> DataFrame:  # noqa: A002
    reader = spark.read.options(multiLine=format == "array", mode="DROPMALFORMED" if ignore_errors else "FAILFAST", samplingRatio=sample_ratio)
    return (reader.schema(columns) if columns else reader).json(path)


def read_json_objects(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Objects as text: a line or a file each."""
    return spark.read.text(path, wholetext=whole).select(F.col("value").alias("json"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: filename, content, size."""
    return read_blob(spark, path).withColumn("content", F.decode("content", "UTF-8"))


def read_blob(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("filename"), "content", F.col("length").alias("size"))


def glob(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or [])


def values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def range_(spark: SparkSession, start: int, end: int, step: int = 1, inclusive: bool = False) -> DataFrame:
    """range without its end, generate_series with it."""
    return spark.range(start, end + (1 if step > 0 else -1) * inclusive, step).withColumnRenamed("id", "generate_series" if inclusive else "range")


def range_timestamps(spark: SparkSession, start: str, end: str, step: str, inclusive: bool = False) -> DataFrame:
    df = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}', interval {step})")).alias("range"))
    return df if inclusive else df.filter(F.col("range") < F.expr(f"timestamp_ntz'{end}'"))


def repeat_row(spark: SparkSession, n: int, **columns) -> DataFrame:
    return spark.range(n).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def parquet_schema(spark: SparkSession, path: str) -> DataFrame:
    fields = spark.read.parquet(path).schema.fields
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in fields], "name string, type string, nullable boolean")


def _footers(spark: SparkSession, path: str):
    """(file, footer) of each Parquet file, footers alone being read, one after the other, on the driver."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in sorted(spark.read.parquet(path).inputFiles()):
        at = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
        try:
            yield name, reader.getFooter()
        finally:
            reader.close()


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, row group and column, from the footers."""
    rows = []
    for name, footer in _footers(spark, path):
        for g, block in enumerate(footer.getBlocks()):
            for k, c in enumerate(block.getColumns()):
                s = c.getStatistics()
                known = s is not None and s.hasNonNullValue()
                rows.append((name, g, k, c.getPath().toDotString(), c.getPrimitiveType().getPrimitiveTypeName().name(), block.getRowCount(), c.getValueCount(), s.minAsString() if known else None, s.maxAsString() if known else None, s.getNumNulls() if s is not None and s.isNumNullsSet() else None, c.getCodec().name(), c.getTotalSize(), c.getTotalUncompressedSize()))
    shape = "file_name string, row_group_id int, column_id int, path_in_schema string, type string, row_group_num_rows long, num_values long, stats_min string, stats_max string, stats_null_count long, compression string, total_compressed_size long, total_uncompressed_size long"
    return spark.createDataFrame(rows, shape)


def parquet_file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: who wrote it, its rows and row groups."""
    rows = [(name, f.getFileMetaData().getCreatedBy(), sum(b.getRowCount() for b in f.getBlocks()), len(f.getBlocks())) for name, f in _footers(spark, path)]
    return spark.createDataFrame(rows, "file_name string, created_by string, num_rows long, num_row_groups int")


def parquet_kv_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per file and key of its own metadata."""
    rows = [(name, k, v) for name, f in _footers(spark, path) for k, v in sorted(dict(f.getFileMetaData().getKeyValueMetaData()).items())]
    return spark.createDataFrame(rows, "file_name string, key string, value string")


def all_types(spark: SparkSession) -> DataFrame:
    """Rows of least and greatest values and of nulls, one column per type."""
    kinds = {"bool": ("boolean", "false", "true"), "tinyint": ("tinyint", "-128", "127"), "smallint": ("smallint", "-32768", "32767"), "int": ("int", "-2147483648", "2147483647"), "bigint": ("bigint", "-9223372036854775808", "9223372036854775807"), "hugeint": ("decimal(38,0)", "-" + "9" * 38, "9" * 38), "date": ("date", "0001-01-01", "9999-12-31"), "timestamp": ("timestamp_ntz", "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"), "float": ("float", "-3.4028234663852886e38", "3.4028234663852886e38"), "double": ("double", "-1.7976931348623157e308", "1.7976931348623157e308"), "dec_4_1": ("decimal(4,1)", "-999.9", "999.9"), "dec_18_6": ("decimal(18,6)", "-999999999999.999999", "999999999999.999999"), "varchar": ("string", "🦆", "goo\0se")}
    row = lambda i: [F.lit(v[i] if i else None).cast(v[0]).alias(k) for k, v in kinds.items()]
    one = spark.range(1)
    return one.select(*row(1)).union(one.select(*row(2))).union(one.select(*row(0)))


def catalog_tables(spark: SparkSession) -> DataFrame:
    rows = [(x.catalog, ".".join(x.namespace or []), x.name, x.tableType, x.isTemporary) for x in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "database_name string, schema_name string, table_name string, table_type string, temporary boolean")


def settings(spark: SparkSession) -> DataFrame:
    return spark.sql("SET -v").select(F.col("key").alias("name"), "value", F.col("meaning").alias("description"))


def catalog_columns(spark: SparkSession) -> DataFrame:
    rows = [(x.catalog, ".".join(x.namespace or []), x.name, i, c.name, c.dataType, c.nullable) for x in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(x.name))]
    return spark.createDataFrame(rows, "database_name string, schema_name string, table_name string, column_index int, column_name string, data_type string, is_nullable boolean")


def catalog_views(spark: SparkSession) -> DataFrame:
    return catalog_tables(spark).filter("table_type in ('VIEW', 'TEMPORARY')").withColumnRenamed("table_name", "view_name")


def catalog_functions(spark: SparkSession) -> DataFrame:
    """The engine's names and Spark's."""
    from quarry.functions import FUNCTIONS

    rows = [(n, "quarry") for n in FUNCTIONS] + [(f.name, "spark") for f in spark.catalog.listFunctions()]
    return spark.createDataFrame(sorted(set(rows)), "function_name string, origin string")
