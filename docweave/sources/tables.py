"""Readers of tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zoned(kind: T.DataType) -> T.DataType:
    """A type with its zoneless timestamps as instants in UTC."""
    if isinstance(kind, T.TimestampNTZType):
        return T.TimestampType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(zoned(kind.elementType), kind.containsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, zoned(f.dataType), f.nullable) for f in kind])
    return kind


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. Zoneless timestamps are read as instants by the scan itself, so that filters on them still reach it."""
    schema = spark.read.parquet(path).schema
    return spark.read.schema(zoned(schema)).parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, dynamic: bool = False) -> DataFrame:
    """Lines of JSON: typed by a schema (given or inferred), or as one VARIANT column doc whose fields may be of any type."""
    if dynamic:
        return spark.read.text(path).where("trim(value) <> ''").select(F.parse_json("value").alias("doc"))
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: read_parquet(spark, f"{folder}/{n}.parquet") for n in names}
