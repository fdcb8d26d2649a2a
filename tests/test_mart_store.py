"""Marts by day: what a refresh touches, what readers see, and equality with a full build."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loamline.contract import CLEAN_PARTITIONS, CLEAN_SCHEMA
from loamline.operators import marts
from loamline.sources.commits import CommitConflict, CommitLog
from loamline.sources.lake import read_lake, write_partitioned
from loamline.sources.mart_store import MartStore

NOW = dt.datetime(2031, 3, 9, tzinfo=dt.timezone.utc)


def readings(spark, days, seed=1, devices=5, site="no rth"):
    """Readings with nine decimals, every 20 minutes; a site's name has a space and a sign that paths escape."""
    base = F.lit("2031-03-01").cast("timestamp")
    return spark.range(len(days) * devices * 72).select(
        F.concat(F.lit("dev-"), (F.col("id") % devices).cast("string")).alias("device_id"),
        F.timestamp_add("MINUTE", ((F.col("id") / devices).cast("int") % 72) * 20 + seed, F.timestamp_add(
            "DAY", F.element_at(F.array(*map(F.lit, days)), (F.col("id") / (devices * 72)).cast("int") + 1), base)).alias("ts"),
        F.round(F.rand(seed) * 100, 9).alias("soil_moisture_pct"), F.lit(1800).alias("soil_raw"),
        F.when(F.col("id") % 9 > 0, F.round(F.rand(seed + 1) * 30, 9)).alias("air_temp_c"),
        F.round(F.rand(seed + 2) * 100, 9).alias("air_humidity_pct"), F.lit(3.7).alias("battery_v"),
        F.when(F.col("id") % 2 == 0, "1.0").otherwise("1.1").alias("fw_version"),
        F.lit(0).alias("kafka_partition"), F.col("id").alias("kafka_offset"),
        F.lit(f"{site}:1").alias("site_id")).withColumn("date", F.to_date("ts")).select(
        *[c.split()[0] for c in CLEAN_SCHEMA.split(", ")])


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def same_as_full(spark, store, lake, built=None):
    stg = marts.staging(read_lake(spark, lake, CLEAN_SCHEMA))
    built = built or store.read()
    assert rows(built["fct_readings_hourly"]) == rows(marts.hourly_facts(stg))
    assert rows(built["dim_devices"]) == rows(marts.device_dimension(stg, NOW))


def test_one_late_file_changes_one_day(spark, tmp_path):
    lake, store = str(tmp_path / "lake"), MartStore(spark, str(tmp_path / "marts"))
    write_partitioned(readings(spark, [0, 1, 2, 3]), lake, CLEAN_PARTITIONS)
    same_as_full(spark, store, lake, store.refresh([lake], NOW))
    first = store.log.newest()[1]
    write_partitioned(readings(spark, [2], seed=7, devices=3), lake, CLEAN_PARTITIONS)
    store.refresh([lake], NOW)
    same_as_full(spark, store, lake)
    number, second = store.log.newest()
    assert number == 2 and [d for d in first["hours"] if first["hours"][d] != second["hours"][d]] == ["2031-03-03"]
    assert {(r["version"], str(r["day"]), r["removed"]) for r in store.changes().collect()} == {
        *[(1, f"2031-03-0{d}", 0) for d in (1, 2, 3, 4)], (2, "2031-03-03", 0)}
    # Nothing new: a version without touched days; old folders are still those of their runs.
    store.refresh([lake], NOW)
    assert store.log.newest()[1]["changed"] == {} and store.log.newest()[1]["hours"] == second["hours"]
    same_as_full(spark, store, lake)


def test_lost_files_are_taken_out_again(spark, tmp_path):
    lake, other = str(tmp_path / "lake"), str(tmp_path / "other")
    store = MartStore(spark, str(tmp_path / "marts"))
    write_partitioned(readings(spark, [0, 1]), lake, CLEAN_PARTITIONS)
    write_partitioned(readings(spark, [1, 2], seed=5), other, CLEAN_PARTITIONS)
    store.refresh([lake, other], NOW)
    built = store.refresh([lake], NOW)
    same_as_full(spark, store, lake, built)
    assert store.log.newest()[1]["changed"] == {"2031-03-02": [0, 1], "2031-03-03": [0, 1]}


def test_a_failing_check_leaves_the_old_marts(spark, tmp_path):
    lake, store = str(tmp_path / "lake"), MartStore(spark, str(tmp_path / "marts"))
    write_partitioned(readings(spark, [0, 1]), lake, CLEAN_PARTITIONS)
    store.refresh([lake], NOW)
    before = {name: rows(df) for name, df in store.read().items()}
    write_partitioned(readings(spark, [1, 5], seed=9), lake, CLEAN_PARTITIONS)

    def refuse(built, fresh):
        assert fresh["fct_readings_hourly"].select("measured_date").distinct().count() == 2
        assert fresh["stg_telemetry"].count() == 2 * 360 and built["fct_readings_hourly"].count() > len(before["fct_readings_hourly"])
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.refresh([lake], NOW, refuse)
    assert {name: rows(df) for name, df in store.read().items()} == before
    assert len(store.vacuum()) == 1
    store.refresh([lake], NOW)
    same_as_full(spark, store, lake)
    store.vacuum()
    same_as_full(spark, store, lake)


def test_empty_lake(spark, tmp_path):
    store = MartStore(spark, str(tmp_path / "marts"))
    assert store.read()["dim_devices"].count() == 0 and store.vacuum() == []
    built = store.refresh([str(tmp_path / "none")], NOW)
    assert built["fct_readings_hourly"].count() == 0 and built["dim_devices"].count() == 0


def test_one_of_two_writers_gets_through(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.newest() == (0, None)
    log.commit(1, {"a": "ä"})
    with pytest.raises(CommitConflict):
        log.commit(1, {"a": 2})
    log.commit(2, {"a": 3})
    assert log.numbers() == [1, 2] and log.read(1) == {"a": "ä"} and log.newest() == (2, {"a": 3})
