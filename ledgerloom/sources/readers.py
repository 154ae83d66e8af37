"""Readers and writers. Raw files are read as text columns; casting is a later, explicit step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.scalars import normalize_query


def read_raw(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header, all columns text; a byte order mark before the first name is taken off."""
    reader = spark.read.option("header", True).option("multiLine", False).option("inferSchema", False)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def _named(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    have = {c.lower(): c for c in df.columns}
    cols = [F.coalesce(*[F.col(f"`{have[a]}`") for a in aliases if a in have]).alias(n) if any(a in have for a in aliases) else F.lit(None).cast("string").alias(n) for n, aliases in names.items()]
    return df.select(*cols)


def points_of_interest(df: DataFrame) -> DataFrame:
    """(name, category, latitude, longitude) under flexible headers; rows without coordinates go."""
    out = _named(df, {"name": ("name", "poi", "title"), "category": ("category", "type", "class"), "latitude": ("latitude", "lat"), "longitude": ("longitude", "lon", "lng")})
    out = out.withColumns({c: F.col(c).cast("string").try_cast("double") for c in ("latitude", "longitude")}).where("latitude is not null and longitude is not null")
    return out.withColumn("category", F.regexp_replace(F.upper(F.trim("category")), r"\s+", "_"))


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    return points_of_interest(read_raw(spark, path))


def geocode_results(df: DataFrame, seq: str | None = None) -> DataFrame:
    """One row for each normalised query, the last one; seq orders repeats (default: file order)."""
    order = F.col(seq) if seq else F.monotonically_increasing_id()
    out = _named(df, {"query": ("query",), "used_query": ("used_query",), "latitude": ("latitude", "lat"), "longitude": ("longitude", "lon", "lng"), "provider": ("provider",)} | ({"_seq": (seq,)} if seq else {}))
    out = out.withColumns({"query": normalize_query(F.col("query")), "latitude": F.col("latitude").cast("string").try_cast("double"), "longitude": F.col("longitude").cast("string").try_cast("double"), "_seq": F.col("_seq") if seq else order})
    last = Window.partitionBy("query").orderBy(F.col("_seq").desc())
    return out.where("query != ''").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_seq")


def read_geocode_results(spark: SparkSession, path: str) -> DataFrame:
    return geocode_results(read_raw(spark, path))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite", fmt: str = "parquet", sort_by: list[str] | None = None) -> None:
    """Write a table; sort_by orders rows inside each file only."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode(mode).partitionBy(*(partition_by or []))
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)
