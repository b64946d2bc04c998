"""File and database readers."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT_EXTENSIONS = (".csv", ".txt")


def read_quality_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sep: str = ",",
) -> DataFrame:
    """Comma-separated text with a header.

    Each file is read as UTF-8 if all its bytes are UTF-8, else as ISO-8859-1
    (the reference's latin-1 fallback), so one file of a folder does not decide
    for the others, and a true U+FFFD is just a character.  The bytes are
    checked line by line in one scan, split like any text; only the names of
    files that fail reach the driver.  Give ``schema`` in production: inference is an
    extra full pass over the files.
    """
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext and ext not in _TEXT_EXTENSIONS:
        raise ValueError(f"Unsupported file format: {ext}")

    def _read(paths: list[str], encoding: str, schema=None) -> DataFrame:
        r = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        return r.csv(paths)

    other = files_not_utf8(spark, path)
    if not other:
        return _read([path], "UTF-8", schema)
    files = _file_names(spark, path)
    parts = [([f for f in files if f not in other], "UTF-8"), (sorted(other), "ISO-8859-1")]
    parts = [_read(names, encoding, schema) for names, encoding in parts if names]
    if schema is None and len(parts) == 2:  # types of both kinds together, column by column
        types = _read([path], "UTF-8").schema
        if [len(p.columns) for p in parts] == [len(types)] * 2:
            parts = [p.select(*[F.col(f"`{c}`").cast(t.dataType) for c, t in zip(p.columns, types)]) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _file_names(spark: SparkSession, path: str) -> list[str]:
    return sorted(spark.read.text(path).inputFiles())


def files_not_utf8(spark: SparkSession, path: str) -> set[str]:
    """Names of the files that hold a line whose bytes are not UTF-8 (Spark's
    text source keeps a line's bytes as they are)."""
    lines = spark.read.text(path).select(F.is_valid_utf8("value").alias("ok"), F.input_file_name().alias("file"))
    return {r.file for r in lines.where(~F.col("ok")).select("file").distinct().collect()}


def quote_identifier(identifier: str) -> str:
    """Double-quote an SQL identifier, doubling embedded quotes."""
    if not identifier or not isinstance(identifier, str):
        raise ValueError("Invalid SQL identifier.")
    return '"' + identifier.replace('"', '""') + '"'


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
    properties: dict | None = None,
    check_exists: bool = True,
) -> DataFrame:
    """A whole table from a JDBC database.

    With ``partition_column`` and bounds the read is split into
    ``num_partitions`` range queries that executors run in parallel; without
    them the table arrives through one connection (one task).
    """
    props = dict(properties or {})
    if check_exists and table not in set(list_jdbc_tables(spark, url, props)):
        raise ValueError(f"Table '{table}' does not exist in database.")
    r = spark.read.format("jdbc").option("url", url).option("dbtable", quote_identifier(table))
    for k, v in props.items():
        r = r.option(k, v)
    if partition_column is not None:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        r = (
            r.option("partitionColumn", partition_column)
            .option("lowerBound", str(lower_bound))
            .option("upperBound", str(upper_bound))
            .option("numPartitions", str(num_partitions))
        )
    return r.load()


def read_jdbc_query(spark: SparkSession, url: str, query: str, properties: dict | None = None) -> DataFrame:
    """S3: the result of an arbitrary SELECT; later filters/columns push into it."""
    r = spark.read.format("jdbc").option("url", url).option("query", query)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()


def list_jdbc_tables(
    spark: SparkSession,
    url: str,
    properties: dict | None = None,
    catalog_query: str = "SELECT table_name FROM information_schema.tables",
) -> list[str]:
    """Table names of a database, through its catalog view.

    The default catalog query is the SQL-standard one; pass the database's
    own (e.g. ``SELECT name FROM sqlite_master WHERE type='table'``).
    The list is small (one row per table), so it is returned to the driver.
    """
    df = read_jdbc_query(spark, url, catalog_query, properties)
    return [r[0] for r in df.collect()]
