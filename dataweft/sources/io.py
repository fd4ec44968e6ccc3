"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``value``."""
    return spark.read.text(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             dates: Sequence[str] = (), view: str | None = None) -> DataFrame:
    """CSV with a header; types are inferred (one more scan) unless a schema is given.

    Compressed files are read through Hadoop's codecs; zip archives must be converted first.
    ``dates`` are parsed to date columns, ``view`` registers the table for SQL.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    df = df.withColumns({c: F.to_date(c) for c in dates}) if dates else df
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_nested(spark: SparkSession, path: str, format: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """Rows with arrays of structs, from parquet or JSON."""
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Create the table from a query and read it back."""
    df.write.mode(mode).parquet(path)
    return read_table(df.sparkSession, path, df.schema)


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read a parquet table with a declared schema, columns matched by name."""
    return spark.read.schema(schema).parquet(path)


def write_partitioned(df: DataFrame, path: str, cols: Sequence[str], mode: str = "overwrite") -> DataFrame:
    """Write one directory per value of ``cols``, so that filters on them skip directories.

    Rebalancing groups each value's rows to avoid many small files and splits a value that holds most rows.
    """
    df.hint("rebalance", *cols).write.mode(mode).partitionBy(*cols).parquet(path)
    return read_table(df.sparkSession, path, df.schema)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema``, matched by name and cast; a missing column is an error."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def append(base: DataFrame, rows: DataFrame, evolve: bool = False) -> DataFrame:
    """Bag union by column name; with ``evolve`` columns missing on either side become NULL."""
    return base.unionByName(rows, allowMissingColumns=evolve)


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def head_sample(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows; with ``order`` the choice is repeatable."""
    return (df.orderBy(*order) if order else df).limit(n)
