"""Readers for base relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Text lines ``a b ...``: the first two space-separated integers; anything after them is ignored."""
    parts = F.split(F.trim("value"), " +")
    return spark.read.text(path).filter(F.trim("value") != "").select(parts[0].cast("long").alias("c0"), parts[1].cast("long").alias("c1"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
