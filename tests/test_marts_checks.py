import datetime as dt

import pytest
from conftest import utc
from pyspark.sql import functions as F

from loamline.operators import checks, marts
from loamline.operators.recalibration import recalibrate

CLEAN = ("device_id string, site_id string, ts timestamp, date date, soil_moisture_pct double, soil_raw int, "
         "air_temp_c double, air_humidity_pct double, battery_v double, fw_version string, "
         "kafka_partition int, kafka_offset bigint")


def clean(spark, *entries):
    """(device, site, time, moisture[, temp, battery, firmware])"""
    out = []
    for i, e in enumerate(entries):
        device, site, time, wet = e[:4]
        temp, battery, firmware = (e[4:] + (20.0, 4.0, "1.0.0")[len(e) - 4:])
        at = utc(time)
        out.append((device, site, at, at.date(), wet, 2000, temp, 60.0, battery, firmware, 0, i))
    return spark.createDataFrame(out, CLEAN)


def facts_of(spark, *entries):
    return marts.hourly_facts(marts.staging(clean(spark, *entries)))


def test_staging_renames(spark):
    stg = marts.staging(clean(spark, ("a", "s", "2026-01-01T10:00:00", 1.0)))
    assert stg.columns == ["device_id", "site_id", "measured_at", "measured_date", "soil_moisture_pct",
                           "soil_raw", "air_temp_c", "air_humidity_pct", "battery_v", "fw_version"]


def test_hourly_fact(spark):
    row = facts_of(spark, ("a", "s", "2026-01-01T10:00:00", 10.1, 20.0, 4.1234), ("a", "s", "2026-01-01T10:59:59", 10.24, None, 3.9996),
                   ).first().asDict()
    assert row["hour_start"] == dt.datetime(2026, 1, 1, 10)
    assert row["measured_date"] == dt.date(2026, 1, 1)
    assert (row["reading_count"], row["avg_soil_moisture_pct"], row["soil_moisture_range_pct"]) == (2, 10.17, 0.14)
    assert (row["min_soil_moisture_pct"], row["max_soil_moisture_pct"]) == (10.1, 10.24)
    assert (row["avg_air_temp_c"], row["min_battery_v"]) == (20.0, 4.0)


def test_fact_keeps_sites_apart(spark):
    fact = facts_of(spark, ("a", "s1", "2026-01-01T10:00:00", 1.0), ("a", "s2", "2026-01-01T10:10:00", 2.0),
                    ("a", "s1", "2026-01-01T11:00:00", 3.0))
    assert fact.count() == 3
    assert [(r["device_id"], r["occurrences"]) for r in
            checks.repeated_values(fact, "device_id", "hour_start").collect()] == [("a", 2)]


def test_device_dimension(spark):
    stg = marts.staging(clean(
        spark, ("a", "s1", "2026-01-01T10:00:59", 10.0, 1.0, 4.0, "1.9.0"),
        ("a", "s2", "2026-01-02T10:00:00", 20.0, 1.0, 3.5, "1.10.0"),
        ("a", "s2", "2026-01-02T11:00:00", 40.0, 1.0, None, None)))
    row = marts.device_dimension(stg, "2026-01-02T11:01:00").first().asDict()
    assert (row["site_id"], row["fw_version"]) == ("s2", "1.9.0")     # text order
    assert (row["total_readings"], row["active_days"], row["minutes_since_last_reading"]) == (3, 2, 1)
    assert (row["min_battery_v"], row["avg_soil_moisture_pct"]) == (3.5, 23.33)
    assert (row["min_soil_moisture_pct"], row["max_soil_moisture_pct"]) == (10.0, 40.0)
    assert row["first_seen_at"] == dt.datetime(2026, 1, 1, 10, 0, 59)


def test_not_null_unique_and_range(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 100.0), (None, 101.0), (None, None), ("b", -1.0)],
                               "k string, v double")
    assert checks.null_rows(df, "k").count() == 2
    assert [tuple(r) for r in checks.repeated_values(df, "k").collect()] == [("a", 2)]
    assert sorted(tuple(r) for r in checks.out_of_range(df, "v", 0, 100).collect()) == [(-1.0, 1), (101.0, 1)]
    assert checks.out_of_range(df, "v", 1, 100, inclusive=False).count() == 4


def test_run_checks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 500.0), (None, None)], "k string, v double")
    rules = [checks.Check("t", "k", "not_null"), checks.Check("t", "k", "unique"),
             checks.Check("t", "v", "accepted_range", 0, 100)]
    got = {r["check_name"]: (r["failures"], r["passed"]) for r in checks.run_checks(df, rules).collect()}
    assert got == {"not_null_t_k": (1, False), "unique_t_k": (1, False), "accepted_range_t_v": (1, False)}
    fine = checks.run_checks(df.filter("v = 1"), rules)
    assert fine.filter("passed").count() == 3
    with pytest.raises(ValueError, match="unknown check"):
        checks.run_checks(df, [checks.Check("t", "k", "regex")])


def test_mart_validation(spark):
    fact = facts_of(spark, ("a", "s", "2026-01-01T10:00:00", 1.0))
    dim = spark.createDataFrame([("a",)], "device_id string")
    good = checks.require_valid_marts(checks.mart_validation(fact, dim, "2026-01-02T12:59:00"))
    assert (good["fact_rows"], good["devices"], good["lag_hours"]) == (1, 1, 26)
    with pytest.raises(checks.InvalidMarts, match="newest hour lies 27h back"):
        checks.require_valid_marts(checks.mart_validation(fact, dim, "2026-01-02T13:00:00"))
    empty = fact.withColumn("reading_count", F.lit(0).cast("bigint"))
    row = checks.mart_validation(empty, dim.limit(0), "2026-01-01T12:00:00").first()
    assert row["problems"] == ["no rows in dim_devices", "1 hours hold no reading"]
    nothing = checks.mart_validation(fact.limit(0), dim, "2026-01-01T12:00:00").first()
    assert nothing["problems"] == ["no rows in fct_readings_hourly"]      # an unknown lag is no problem
    assert nothing["lag_hours"] is None


def test_lake_reports(spark):
    df = clean(spark, ("a", "s1", "2026-01-01T10:00:00", 10.25), ("a", "s1", "2026-01-01T10:00:00", 20.0),
               ("b", "s2", "2026-01-02T10:00:00", None), ("b", "s2", "2026-01-02T11:00:00", 100.5))
    bad = spark.createDataFrame([("range",), ("range",), ("completeness",)], "quality_rule string")
    assert [tuple(r) for r in checks.quarantine_by_rule(bad).collect()] == [("range", 2), ("completeness", 1)]
    assert tuple(checks.rejection_rate(df, bad).first()) == (4, 3, 7, 3 / 7)
    assert checks.rejection_rate(df.limit(0), bad.limit(0)).first()["rejection_rate"] is None
    assert checks.range_violations(df).first()[0] == 2
    assert checks.duplicate_keys(df).first()[0] == 1
    assert [tuple(r) for r in checks.device_breakdown(df).collect()] == [("a", 2, 10.3, 20.0), ("b", 2, 100.5, 100.5)]
    assert [r["n"] for r in checks.partition_inventory(df).collect()] == [2, 2]
    summary = checks.history_summary(df).first()
    assert (summary["readings"], summary["devices"], summary["days"]) == (4, 2, 2)
    assert (summary["lowest"], summary["highest"]) == (10.3, 100.5)
    assert checks.history_summary(df.limit(0)).first()["readings"] == 0


def test_recalibration(spark):
    readings = spark.createDataFrame([("a", 2200), ("b", 2200), ("c", 2200)], "device_id string, soil_raw int")
    own = spark.createDataFrame([("a", 3000, 1000), ("c", 9, 9)], "device_id string, adc_dry int, adc_wet int")
    got = {r["device_id"]: r["recalibrated_pct"] for r in recalibrate(readings, own).collect()}
    assert got == {"a": 40.0, "b": 50.0, "c": None}


def test_rejection_rate_in_one_pass(spark):
    judged = spark.createDataFrame(
        [("a", utc("2026-01-01T10:00:00"), None)] * 3 + [("a", utc("2026-01-01T11:00:00"), None)]
        + [("a", utc("2026-01-01T10:00:00"), "range:x")] * 2 + [(None, None, "completeness:device_id")],
        "device_id string, ts timestamp, quality_reason string")
    row = checks.rejection_rate_of(judged).first()
    assert tuple(row) == (2, 3, 5, 0.6)
    empty = checks.rejection_rate_of(judged.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, None)
