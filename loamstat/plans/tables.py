"""The driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as features, return flags as groups, lines as samples."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("feature_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"),
        F.col("l_returnflag").alias("grp"),
        F.col("l_extendedprice").cast("double").alias("value"),
        (F.col("l_discount").cast("double") * 100).cast("int").alias("gap_status"),
    )


def flag_contrasts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A-N", "A", "N"), ("A-R", "A", "R"), ("N-R", "N", "R")], "contrast string, grp_x string, grp_y string")


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as features, event types as groups."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("feature_id"), F.col("event_type").alias("grp"), F.col("value").cast("double").alias("value"))
