"""One device holds most rows: nothing may gather them in one task."""

import pytest
from conftest import utc
from pyspark.sql import functions as F

from loamline.operators import checks, marts, state
from loamline.operators.recalibration import recalibrate

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def readings(spark, n=60_000, parts=8):
    """Two thirds of the rows belong to one device."""
    hot = F.col("id") % 3 != 0
    return spark.range(0, n, 1, parts).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 500)).alias("device_id"),
        F.lit("s").alias("site_id"),
        (F.lit(utc("2026-01-01T00:00:00")).cast("timestamp")
         + F.make_dt_interval(secs=F.col("id") * 30)).alias("ts"),
        (F.col("id") % 97).cast("double").alias("soil_moisture_pct"),
        (F.col("id") % 4000).cast("int").alias("soil_raw"),
        F.lit(20.0).alias("air_temp_c"), F.lit(50.0).alias("air_humidity_pct"),
        F.lit(4.0).alias("battery_v"), F.lit("1.0.0").alias("fw_version"),
        F.lit(0).alias("kafka_partition"), F.col("id").alias("kafka_offset"),
    ).withColumn("date", F.to_date("ts"))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_recalibration_splits_the_hot_device(spark, small_limits):
    rows = readings(spark)
    own = rows.select("device_id").distinct().filter("device_id <> 'd3'").select(
        "device_id", F.lit(3000).alias("adc_dry"), F.lit(1000).alias("adc_wet"))
    out = recalibrate(rows.select("device_id", "soil_raw"), own)
    assert "skew=true" in final_plan(out)
    assert out.count() == rows.count()
    plain = out.filter("device_id = 'd3'").filter(
        F.abs(F.col("recalibrated_pct") - (3200 - F.col("soil_raw")) / 20.0) > 0.006)
    assert plain.count() == 0


def shuffled_rows(df):
    """Rows written by each exchange of the executed plan, in plan order."""
    df.collect()
    found = []

    def visit(node):
        name = node.nodeName()
        if name == "Exchange" and node.metrics().contains("shuffleRecordsWritten"):
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        if name in ("AdaptiveSparkPlan",):
            visit(node.executedPlan())
        elif "QueryStage" in name:
            visit(node.plan())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return found


def test_latest_state_shuffles_one_row_per_device_and_task(spark):
    rows = readings(spark)
    out = state.latest_state(rows)
    assert max(shuffled_rows(out)) <= 8 * 501
    newest = out.filter("device_id = 'hot'").first()
    assert newest["kafka_offset"] == 59_999


def test_hourly_fact_shuffles_groups(spark):
    rows = readings(spark)
    fact = marts.hourly_facts(marts.staging(rows))
    groups = fact.count()
    assert max(shuffled_rows(fact)) <= groups + 8 * 501
    assert fact.filter("device_id = 'hot'").agg(F.sum("reading_count")).first()[0] == 40_000


def test_dimension_shuffles_days(spark):
    rows = readings(spark)
    dim = marts.device_dimension(marts.staging(rows), "2026-02-01 00:00:00")
    assert max(shuffled_rows(dim)) <= 8 * 501 * 22
    assert dim.filter("device_id = 'hot'").first()["total_readings"] == 40_000


def test_a_third_of_rows_under_one_key(spark):
    """Copies of one record are counted and reported without being gathered."""
    rows = readings(spark, 30_000).withColumn(
        "ts", F.when(F.col("device_id") == "hot", F.lit(utc("2026-01-01T00:00:00"))).otherwise(F.col("ts")))
    found = checks.repeated_values(rows, "device_id", "ts")
    assert [tuple(r)[0::2] for r in found.collect()] == [("hot", 20_000)]
    assert checks.duplicate_keys(rows).first()[0] == 1
