"""Partitioned Parquet tables, read with declared schemas."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.contract import CLEAN_PARTITIONS

# Columns the feature builder reads from the hourly fact.
HOURLY_COLUMNS = [
    "device_id", "site_id", "hour_start", "reading_count", "avg_soil_moisture_pct",
    "min_soil_moisture_pct", "max_soil_moisture_pct", "soil_moisture_range_pct",
    "avg_air_temp_c", "avg_air_humidity_pct",
]


def read_lake(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """A table below a root folder; directory values become typed columns and prune the scan.

    A root that does not exist yet is an empty table. Any other failure, such as refused
    credentials, is raised: it must not look like "no data".
    """
    try:
        return spark.read.schema(schema).option("basePath", root).parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_with_backfill(spark: SparkSession, root: str, backfill_root: str,
                       schema: str) -> DataFrame:
    """Streamed and backfilled rows together.

    A streaming sink lists its own files in a log, and a reader of its folder sees only those. So
    backfills live in a folder of their own.
    """
    return (read_lake(spark, root, schema)
            .unionByName(read_lake(spark, backfill_root, schema)))


def load_hourly(facts: DataFrame) -> DataFrame:
    """The fact columns used for features; no sort, the feature windows order what they need."""
    return facts.select(*HOURLY_COLUMNS)


def write_partitioned(df: DataFrame, path: str, partitions: list[str], mode: str = "append") -> None:
    """Write by directory. The rebalance hint gathers each directory's rows into few files, while AQE
    splits a directory that holds far more than others over several tasks."""
    df.hint("rebalance", *partitions).write.mode(mode).partitionBy(*partitions).parquet(path)


def write_backfill(history: DataFrame, path: str, now: dt.datetime | None = None) -> DataFrame:
    """Add history up to last midnight UTC, so that partitions the stream fills today stay untouched."""
    now = now or dt.datetime.now(dt.timezone.utc)
    midnight = dt.datetime(now.year, now.month, now.day, tzinfo=dt.timezone.utc)
    past = history.filter(F.col("ts") < F.lit(midnight)).withColumn("date", F.to_date("ts"))
    write_partitioned(past, path, CLEAN_PARTITIONS)
    return past


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Rebuild a mart in full, since late data lands in past hours, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
