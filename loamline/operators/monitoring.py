"""Pipeline health as tables: rates per window, freshness, fleet status.

Rates count exact events in tumbling windows, where a scraped counter would extrapolate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.numbers import clamp
from loamline.functions.times import as_of_column, elapsed

# Silence of a device in seconds from which the fleet table warns and alarms.
WARN_AFTER_S = 300
ALARM_AFTER_S = 900


def event_rate(events: DataFrame, time: str, minutes: int, *by: str) -> DataFrame:
    """Events per second in each window, overall or per group."""
    counted = events.groupBy(F.window(time, f"{minutes} minutes"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n",
                          (F.col("n") / F.lit(minutes * 60.0)).alias("per_second"))


def throughput(checked: DataFrame, time: str = "timestamp", minutes: int = 5) -> DataFrame:
    """All messages per second."""
    return event_rate(checked, time, minutes)


def outcome_rate(checked: DataFrame, time: str = "timestamp", minutes: int = 5) -> DataFrame:
    """Forwarded and dead-lettered messages per second."""
    outcome = F.when(F.col("reject_reason").isNull(), "forwarded").otherwise("dead_lettered")
    return event_rate(checked.withColumn("result", outcome), time, minutes, "result")


def rule_rate(quarantine: DataFrame, minutes: int = 5) -> DataFrame:
    """Quarantined records per second and rule."""
    return event_rate(quarantine, "kafka_ts", minutes, "quality_rule")


def quarantine_pct(checked: DataFrame, time: str = "kafka_ts", minutes: int = 10) -> DataFrame:
    """Quarantined share of all judged records in each window, in percent."""
    counted = checked.groupBy(F.window(time, f"{minutes} minutes")).agg(
        F.count("quality_reason").alias("quarantined"),
        F.count_if(F.col("quality_reason").isNull()).alias("clean"))
    seconds = F.lit(minutes * 60.0)
    bad, good = F.col("quarantined") / seconds, F.col("clean") / seconds
    return counted.select(
        F.col("window.start").alias("window_start"), "quarantined", "clean",
        (F.lit(100.0) * bad / clamp(bad + good, low=0.0001)).alias("quarantine_pct"))


def seen_recently(state: DataFrame, as_of=None, seconds: int = 300, time: str = "ts") -> DataFrame:
    """Number of devices heard of within the last few minutes; 0 when there is none."""
    age = elapsed(1, F.col(time), as_of_column(as_of))
    return state.agg(F.count_if(age < seconds).alias("devices"))


def watermark_drops(progress: DataFrame, as_of=None, hours: int = 1) -> DataFrame:
    """Rows lost to the watermark within the last hour; 0 when there is none."""
    age = elapsed(3600, F.col("batch_time"), as_of_column(as_of))
    lost = F.sum(F.when((age >= 0) & (age < hours), F.col("dropped_rows")))
    return progress.agg(F.coalesce(lost, F.lit(0)).alias("dropped_rows"))


def last_batch_duration(progress: DataFrame) -> DataFrame:
    """Duration of the newest micro-batch of each query, in seconds."""
    return progress.groupBy("query").agg(
        (F.max_by("duration_ms", "batch_id") / 1000.0).alias("duration_s"))


def silence_severity(seconds: Column) -> Column:
    return (F.when(seconds >= ALARM_AFTER_S, "alarm").when(seconds >= WARN_AFTER_S, "warn")
            .otherwise("ok"))


def fleet_status(silence: DataFrame, moisture: DataFrame, battery: DataFrame) -> DataFrame:
    """Three per-device frames side by side; a device in any of them is listed.

    Inputs: (device_id, site_id, silence_s), (device_id, soil_moisture_pct), (device_id, battery_v).
    """
    table = (silence.join(moisture, "device_id", "full").join(battery, "device_id", "full"))
    return table.select(
        "device_id", "site_id", "silence_s",
        F.when(F.col("silence_s").isNotNull(), silence_severity(F.col("silence_s"))).alias("severity"),
        "soil_moisture_pct", "battery_v")


def silence_seconds(state: DataFrame, as_of=None, time: str = "ts") -> DataFrame:
    """Whole seconds since each device was last heard of."""
    age = F.floor(elapsed(1, F.col(time), as_of_column(as_of))).cast("bigint")
    return state.select("device_id", "site_id", age.alias("silence_s"))
