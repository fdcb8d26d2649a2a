"""Data checks and lake reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.contract import MAX_MART_LAG_HOURS
from loamline.functions.numbers import outside, round_exact
from loamline.functions.times import as_of_column, boundaries_crossed


# --- column checks -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Check:
    """A rule for one column; ``kind`` is not_null, unique or accepted_range."""

    table: str
    column: str
    kind: str
    low: float | None = None
    high: float | None = None
    inclusive: bool = True

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.table}_{self.column}"


# The checks declared for the three models.
STAGING_CHECKS = [
    Check("stg_telemetry", "device_id", "not_null"),
    Check("stg_telemetry", "measured_at", "not_null"),
    Check("stg_telemetry", "soil_moisture_pct", "not_null"),
    Check("stg_telemetry", "soil_moisture_pct", "accepted_range", 0, 100),
    Check("stg_telemetry", "air_temp_c", "accepted_range", -40, 80),
]
FACT_CHECKS = [
    Check("fct_readings_hourly", "device_id", "not_null"),
    Check("fct_readings_hourly", "hour_start", "not_null"),
    Check("fct_readings_hourly", "reading_count", "not_null"),
    Check("fct_readings_hourly", "reading_count", "accepted_range", 1, 100000),
    Check("fct_readings_hourly", "avg_soil_moisture_pct", "accepted_range", 0, 100),
]
DEVICE_CHECKS = [
    Check("dim_devices", "device_id", "not_null"),
    Check("dim_devices", "device_id", "unique"),
    Check("dim_devices", "total_readings", "not_null"),
    Check("dim_devices", "min_battery_v", "accepted_range", 2.5, 5.0),
]


def null_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows that break a not_null check."""
    return df.filter(F.col(column).isNull())


def repeated_values(df: DataFrame, *columns: str) -> DataFrame:
    """Key values that occur more than once; keys with a NULL are left out."""
    present = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    return (df.filter(present).groupBy(*columns).agg(F.count("*").alias("occurrences"))
            .filter("occurrences > 1"))


def out_of_range(df: DataFrame, column: str, low: float, high: float,
                 inclusive: bool = True) -> DataFrame:
    """Offending values and how often each occurs; no rows means the check passes."""
    return (df.filter(outside(F.col(column), low, high, inclusive))
            .groupBy(F.col(column).alias("offending_value"))
            .agg(F.count("*").alias("occurrences")))


def _failing(check: Check) -> Column:
    if check.kind == "not_null":
        return F.col(check.column).isNull()
    if check.kind == "accepted_range":
        return outside(F.col(check.column), check.low, check.high, check.inclusive)
    raise ValueError(f"unknown check kind {check.kind!r}")


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One row per check with its number of failures (rows, or repeated values).

    All row rules share one scan and one single-row aggregate; each unique rule adds a grouping.
    """
    row_rules = [c for c in checks if c.kind != "unique"]
    parts = []
    if row_rules:
        counted = df.agg(*[F.count_if(_failing(c)).alias(c.name) for c in row_rules])
        pairs = [F.struct(F.lit(c.name).alias("check_name"), F.col(f"`{c.name}`").alias("failures"))
                 for c in row_rules]
        parts.append(counted.select(F.inline(F.array(*pairs))))
    for c in (c for c in checks if c.kind == "unique"):
        parts.append(repeated_values(df, c.column)
                     .agg(F.lit(c.name).alias("check_name"), F.count("*").alias("failures"))
                     .select("check_name", "failures"))
    verdicts = reduce(DataFrame.unionByName, parts)
    return verdicts.withColumn("passed", F.col("failures") == 0)


# --- mart validation -----------------------------------------------------------------------------

class InvalidMarts(RuntimeError):
    """The marts were built but must not be used."""


def mart_validation(facts: DataFrame, devices: DataFrame, as_of=None,
                    max_lag_hours: int = MAX_MART_LAG_HOURS) -> DataFrame:
    """One row: sizes, freshness and the list of problems."""
    fact_side = facts.agg(
        F.count("*").alias("fact_rows"),
        F.count_if(F.col("reading_count") < 1).alias("empty_buckets"),
        F.max("hour_start").alias("newest_hour"),
        F.lit(None).cast("bigint").alias("devices"))
    device_side = devices.agg(
        F.lit(None).cast("bigint").alias("fact_rows"),
        F.lit(None).cast("bigint").alias("empty_buckets"),
        F.lit(None).cast("timestamp").alias("newest_hour"),
        F.count("*").alias("devices"))
    merged = fact_side.unionByName(device_side).agg(
        *[F.max(c).alias(c) for c in ("fact_rows", "devices", "empty_buckets", "newest_hour")])
    timed = merged.withColumn(
        "lag_hours", boundaries_crossed("hour", F.col("newest_hour"), as_of_column(as_of)))
    problems = F.array_compact(F.array(
        F.when(F.col("fact_rows") == 0, "no rows in fct_readings_hourly"),
        F.when(F.col("devices") == 0, "no rows in dim_devices"),
        F.when(F.col("empty_buckets") > 0,
               F.concat(F.col("empty_buckets"), F.lit(" hours hold no reading"))),
        F.when(F.col("lag_hours") > max_lag_hours,
               F.concat(F.lit("newest hour lies "), F.col("lag_hours"),
                        F.lit(f"h back, {max_lag_hours}h are allowed"))),
    ))
    return timed.select("fact_rows", "devices", "empty_buckets", "lag_hours",
                        problems.alias("problems"))


def require_valid_marts(validation: DataFrame) -> dict:
    """The validation row as a dict, or an error that lists the problems."""
    row = validation.first().asDict()
    if row["problems"]:
        raise InvalidMarts("marts not fit for use: " + "; ".join(row["problems"]))
    return row


# --- lake reports --------------------------------------------------------------------------------

def quarantine_by_rule(quarantine: DataFrame) -> DataFrame:
    return (quarantine.groupBy("quality_rule").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "quality_rule"))


def rejection_rate(clean: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row: clean, quarantined, total, and the rejected share (NULL when there is no data)."""
    sides = (clean.agg(F.count("*").alias("clean"), F.lit(0).cast("bigint").alias("quarantined"))
             .unionByName(quarantine.agg(F.lit(0).cast("bigint").alias("clean"),
                                         F.count("*").alias("quarantined"))))
    total = F.col("clean") + F.col("quarantined")
    return (sides.agg(F.sum("clean").alias("clean"), F.sum("quarantined").alias("quarantined"))
            .select("clean", "quarantined", total.alias("total"),
                    F.try_divide(F.col("quarantined").cast("double"), total).alias("rejection_rate")))


def rejection_rate_of(checked: DataFrame, *key: str) -> DataFrame:
    """The same row from judged records, in one pass: a clean record is a distinct key among those that passed.

    Rejected records share one group, which every task reduces to a row before the shuffle.
    """
    good = F.col("quality_reason").isNull()
    keys = [F.when(good, F.col(c)).alias(c) for c in key or ("device_id", "ts")]
    groups = checked.groupBy(good.alias("_good"), *keys).agg(F.count("*").alias("n"))
    total = F.col("clean") + F.col("quarantined")
    return (groups.agg(F.count_if("_good").alias("clean"),
                       F.coalesce(F.sum(F.when(~F.col("_good"), F.col("n"))), F.lit(0)).alias("quarantined"))
            .select("clean", "quarantined", total.alias("total"),
                    F.try_divide(F.col("quarantined").cast("double"), total).alias("rejection_rate")))


def range_violations(clean: DataFrame, column: str = "soil_moisture_pct",
                     low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Number of clean rows whose value is missing or out of range; must be 0."""
    bad = F.col(column).isNull() | outside(F.col(column), low, high)
    return clean.filter(bad).agg(F.count("*").alias("violations"))


def duplicate_keys(clean: DataFrame, *key: str) -> DataFrame:
    """Number of keys that occur more than once; must be 0."""
    return (clean.groupBy(*(key or ("device_id", "ts"))).agg(F.count("*").alias("n"))
            .filter("n > 1").agg(F.count("*").alias("duplicate_keys")))


def device_breakdown(clean: DataFrame) -> DataFrame:
    return (clean.groupBy("device_id")
            .agg(F.count("*").alias("n"),
                 round_exact(F.min("soil_moisture_pct"), 1).alias("lowest"),
                 round_exact(F.max("soil_moisture_pct"), 1).alias("highest"))
            .orderBy("device_id"))


def partition_inventory(clean: DataFrame) -> DataFrame:
    return (clean.groupBy("site_id", "date").agg(F.count("*").alias("n"))
            .orderBy("site_id", "date"))


def history_summary(history: DataFrame) -> DataFrame:
    """One row about a backfill: size, period, devices, days, moisture span.

    Devices and days are counted over their distinct pairs, which the readings are first reduced to.
    """
    day = F.to_date("ts").alias("day")
    pairs = history.groupBy("device_id", day).agg(
        F.count("*").alias("n"), F.min("ts").alias("lo_ts"), F.max("ts").alias("hi_ts"),
        F.min("soil_moisture_pct").alias("lo"), F.max("soil_moisture_pct").alias("hi"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("readings"),
        F.min("lo_ts").alias("first_ts"), F.max("hi_ts").alias("last_ts"),
        F.countDistinct("device_id").alias("devices"), F.countDistinct("day").alias("days"),
        round_exact(F.min("lo"), 1).alias("lowest"), round_exact(F.max("hi"), 1).alias("highest"))


