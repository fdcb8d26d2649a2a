import datetime as dt

import pytest
from conftest import messages, payload
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from loamline.contract import CLEAN_PARTITIONS, CLEAN_SCHEMA, QUARANTINE_SCHEMA
from loamline.operators import gates
from loamline.session import ObjectStore, scratch_dir
from loamline.sources import lake
from loamline.sources.messages import read_kafka
from loamline.streaming.job import judged


def test_missing_table_is_empty(spark, tmp_path):
    df = lake.read_lake(spark, str(tmp_path / "none"), CLEAN_SCHEMA)
    assert df.count() == 0 and "site_id" in df.columns
    assert lake.read_lake(spark, str(tmp_path / "none"), QUARANTINE_SCHEMA).count() == 0


def test_other_failures_are_raised(spark):
    with pytest.raises(Exception) as error:
        lake.read_lake(spark, "nosuchscheme://bucket/telemetry", CLEAN_SCHEMA)
    assert not isinstance(error.value, AnalysisException) or error.value.getCondition() != "PATH_NOT_FOUND"


def test_directory_values_stay_text(spark, tmp_path):
    clean = gates.clean_records(judged(messages(spark, [payload(site_id="01")])))
    lake.write_partitioned(clean, str(tmp_path / "t"), CLEAN_PARTITIONS)
    row = lake.read_lake(spark, str(tmp_path / "t"), CLEAN_SCHEMA).first()
    assert (row["site_id"], row["date"]) == ("01", dt.date(2031, 3, 5))


def test_filters_reach_the_scan(spark, tmp_path):
    clean = gates.clean_records(judged(messages(spark, [payload(), payload(site_id="b", ts="2031-03-05T11:00:00Z")])))
    lake.write_partitioned(clean, str(tmp_path / "t"), CLEAN_PARTITIONS)
    df = (lake.read_lake(spark, str(tmp_path / "t"), CLEAN_SCHEMA)
          .filter("site_id = 'b' AND soil_moisture_pct > 10").select("device_id"))
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site_id" in plan
    assert "GreaterThan(soil_moisture_pct,10.0)" in plan
    assert "ReadSchema: struct<device_id:string,soil_moisture_pct:double>" in plan


def test_backfill_ends_at_midnight_and_adds(spark, tmp_path):
    path, now = str(tmp_path / "back"), dt.datetime(2031, 3, 5, 15, tzinfo=dt.timezone.utc)
    clean = gates.clean_records(judged(messages(spark, [
        payload(ts="2031-03-04T23:59:59Z"), payload(ts="2031-03-05T00:00:00Z")])))
    lake.write_backfill(clean, path, now)
    lake.write_backfill(clean, path, now)
    stored = lake.read_lake(spark, path, CLEAN_SCHEMA)
    assert [r["date"].day for r in stored.collect()] == [4, 4]
    both = lake.read_with_backfill(spark, str(tmp_path / "stream"), path, CLEAN_SCHEMA)
    assert both.count() == 2


def test_materialize_rebuilds(spark, tmp_path):
    for n in (5, 3):
        table = lake.materialize(spark.range(n), str(tmp_path / "m"))
    assert table.count() == 3


def test_a_hot_directory_is_split(spark, tmp_path):
    """Nearly all rows in one directory: its rows go to several tasks, the small ones to few files."""
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("s"), F.col("id") % 3)).otherwise("hot").alias("site_id"),
        F.lit("2026-01-01").cast("date").alias("date"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        lake.write_partitioned(rows, str(tmp_path / "t"), ["site_id", "date"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {p.name: len(list(p.rglob("*.parquet"))) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert files["site_id=hot"] > 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_scratch_is_in_the_shared_folder(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_object_store_settings():
    conf = ObjectStore("http://store:9000", "key", "secret").conf()
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000"


def test_kafka_needs_its_connector(spark):
    """The connector jar is not part of this environment; the options are read by it, not by us."""
    with pytest.raises(AnalysisException, match="kafka"):
        read_kafka(spark, "broker:9092", "telemetry")


def test_hourly_projection(spark):
    wide = spark.range(1).select(*[F.lit(1).alias(c) for c in [*lake.HOURLY_COLUMNS, "min_battery_v"]])
    assert lake.load_hourly(wide).columns == lake.HOURLY_COLUMNS
