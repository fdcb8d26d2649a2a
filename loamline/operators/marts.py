"""Staging view, hourly fact and device dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions.numbers import carried, exact_sum, mean_of, merged_sum, round_exact
from loamline.functions.times import as_of_column, boundaries_crossed


def staging(clean: DataFrame) -> DataFrame:
    """Clean records renamed and typed, without broker coordinates."""
    return clean.select(
        "device_id", "site_id",
        F.col("ts").cast("timestamp").alias("measured_at"),
        F.col("date").cast("date").alias("measured_date"),
        "soil_moisture_pct", "soil_raw", "air_temp_c", "air_humidity_pct", "battery_v", "fw_version")


_SUMS = {"moisture": "soil_moisture_pct", "temp": "air_temp_c", "humidity": "air_humidity_pct"}


def _states() -> list:
    """Mergeable aggregates of readings; all buffers are numbers of fixed width."""
    return [
        F.count("*").alias("readings"),
        F.min("measured_at").alias("first_at"),
        F.max("measured_at").alias("last_at"),
        F.min("soil_moisture_pct").alias("moisture_low"),
        F.max("soil_moisture_pct").alias("moisture_high"),
        F.min("battery_v").alias("battery"),
        *[exact_sum(column).alias(name) for name, column in _SUMS.items()],
    ]


def _merged() -> list:
    """The same aggregates over states instead of readings."""
    return [
        F.sum("readings").alias("readings"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.min("moisture_low").alias("moisture_low"),
        F.max("moisture_high").alias("moisture_high"),
        F.min("battery").alias("battery"),
        *[merged_sum(name).alias(name) for name in _SUMS],
    ]


def _kept(grouped: DataFrame) -> DataFrame:
    """States as they are stored or merged further: with their sums carried."""
    return grouped.withColumns({name: carried(name) for name in _SUMS})


HOUR_KEYS = ["device_id", "site_id", "fw_version", "hour_start"]
DAY_KEYS = ["device_id", "site_id", "fw_version", "measured_date"]


def hour_states(stg: DataFrame) -> DataFrame:
    """Per device, site, firmware and hour: states from which fact and dimension follow, and which merge
    with those of readings that come later."""
    return _kept(stg.groupBy("device_id", "site_id", "fw_version", F.date_trunc("hour", "measured_at").alias("hour_start"))
                 .agg(*_states()))


def merge_hours(states: DataFrame) -> DataFrame:
    """One state per key, from several."""
    return _kept(states.groupBy(*HOUR_KEYS).agg(*_merged()))


def day_states(hours: DataFrame) -> DataFrame:
    """The states of hours gathered to days, for the dimension."""
    return _kept(hours.groupBy("device_id", "site_id", "fw_version", F.to_date("hour_start").alias("measured_date"))
                 .agg(*_merged()))


def _fact(grouped: DataFrame) -> DataFrame:
    low, high = F.col("moisture_low"), F.col("moisture_high")
    return grouped.select(
        "device_id", "site_id", "hour_start", F.to_date("hour_start").alias("measured_date"),
        F.col("readings").alias("reading_count"),
        mean_of("moisture", 2).alias("avg_soil_moisture_pct"),
        round_exact(low, 2).alias("min_soil_moisture_pct"),
        round_exact(high, 2).alias("max_soil_moisture_pct"),
        round_exact(high - low, 2).alias("soil_moisture_range_pct"),
        mean_of("temp", 2).alias("avg_air_temp_c"),
        mean_of("humidity", 2).alias("avg_air_humidity_pct"),
        round_exact(F.col("battery"), 3).alias("min_battery_v"))


def hourly_facts(stg: DataFrame) -> DataFrame:
    """One row per device, site and hour.

    Spark keeps a hash table per task and shuffles one row per group; a device with a third of all
    readings shrinks to its hours before the exchange.
    """
    return _fact(stg.groupBy("device_id", "site_id", F.date_trunc("hour", "measured_at").alias("hour_start")).agg(*_states()))


def facts_of_hours(hours: DataFrame) -> DataFrame:
    """The fact from kept states."""
    return _fact(hours.groupBy("device_id", "site_id", "hour_start").agg(*_merged()))


def device_days(stg: DataFrame) -> DataFrame:
    """Per device, site, firmware and day: everything the dimension is built from."""
    return _kept(stg.groupBy(*DAY_KEYS).agg(*_states()))


def device_dimension(stg: DataFrame, as_of=None) -> DataFrame:
    """One row per device, built on daily rows."""
    return dimension_of_days(device_days(stg), as_of)


def dimension_of_days(days: DataFrame, as_of=None) -> DataFrame:
    """One row per device. Text maxima and the set of days (no larger than the history is long) see only
    the daily table, never single readings."""
    per_device = days.groupBy("device_id").agg(
        F.max("site_id").alias("site_id"),
        F.max("fw_version").alias("fw_version"),
        F.size(F.collect_set("measured_date")).alias("_days"),
        *_merged())
    return per_device.select(
        "device_id", "site_id", "fw_version",
        F.col("first_at").alias("first_seen_at"), F.col("last_at").alias("last_seen_at"),
        boundaries_crossed("minute", F.col("last_at"), as_of_column(as_of)).alias("minutes_since_last_reading"),
        F.col("readings").alias("total_readings"), F.col("_days").cast("bigint").alias("active_days"),
        round_exact(F.col("battery"), 3).alias("min_battery_v"),
        mean_of("moisture", 2).alias("avg_soil_moisture_pct"),
        round_exact(F.col("moisture_low"), 2).alias("min_soil_moisture_pct"),
        round_exact(F.col("moisture_high"), 2).alias("max_soil_moisture_pct"))
