"""Readers and writers: delimited, fixed-width and typed text, Parquet, JSON lines, JDBC, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lower() for c in df.columns))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited import; names are stripped and lower-cased.  Without a schema, types are inferred."""
    reader = spark.read.options(sep=sep, header=header)
    return normalize_columns((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def read_input(spark: SparkSession, path: str, spec: dict[str, Column | None], sep: str = "|") -> DataFrame:
    """Typed INPUT list over delimited lines; short lines are padded with nulls.

    ``spec`` maps a name to None (text) or to an expression over the column of that name."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in spec])
    raw = spark.read.options(sep=sep, mode="PERMISSIVE").schema(text).csv(path)
    return raw.select(*((F.col(c) if e is None else e).alias(c) for c, e in spec.items()))


def read_fixed(spark: SparkSession, path: str, layout: dict[str, tuple[int, int, str]], skip_types: tuple[str, ...] = (), type_column: str | None = None) -> DataFrame:
    """Fixed-width lines: name -> (1-based start, length, SQL type); records of ``skip_types`` are dropped."""
    lines = spark.read.text(path)
    df = lines.select(*(F.trim(F.substring("value", a, n)).try_cast(t).alias(c) for c, (a, n, t) in layout.items()))
    return df.where(~F.col(type_column).isin(*skip_types)) if type_column and skip_types else df


def from_lines(spark: SparkSession, columns: dict[str, str], lines: list[str]) -> DataFrame:
    """Inline rows, separated by white space: name -> SQL type."""
    parts = F.split(F.trim("line"), r"\s+")
    df = spark.createDataFrame([(x,) for x in lines if x.strip()], "line string")
    return df.select(*(F.try_element_at(parts, F.lit(i + 1)).try_cast(t).alias(c) for i, (c, t) in enumerate(columns.items())))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(sep=sep, header=True).csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_col: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    return spark.read.jdbc(url, table, column=partition_col, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "errorifexists", **options: str) -> None:
    """Write a table of a database; every partition is a connection of its own."""
    df.write.mode(mode).options(**options).jdbc(url, table)


def embedded_url(path: str, create: bool = False) -> str:
    """The URL of a database file that the tasks' own process opens, with the driver that Spark brings along.

    It serves one process, so it is for a local master; on a cluster give the URL of a server."""
    return f"jdbc:derby:{path.removeprefix('file:')}" + (";create=true" if create else "")


def append(base: DataFrame, data: DataFrame, force: bool = True) -> DataFrame:
    """Rows of ``data`` under ``base``, in the columns of ``base``; without ``force`` columns must agree."""
    if not force:
        return base.unionByName(data)
    own = data.select(*(c for c in data.columns if c in base.columns))
    return base.unionByName(own, allowMissingColumns=True).select(*base.columns)


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, size, sha256 and lines of every file below ``root``."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(root)
    body = F.decode("content", "UTF-8")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), (F.regexp_count(body, F.lit("\n")) + F.when(F.col("length") > 0, 1).otherwise(0) - F.when(body.endswith("\n"), 1).otherwise(0)).alias("lines"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def stream_files(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 50, fmt: str = "parquet") -> DataFrame:
    """An incremental read of at most ``max_files`` new files a trigger."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)
