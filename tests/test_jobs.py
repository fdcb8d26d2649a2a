"""From raw messages to a promoted model, with the tables of one lake."""

import datetime as dt

import pytest
from conftest import payload, utc
from pyspark.sql import functions as F
from test_streaming import Topic

from loamline.operators import gates, state
from loamline.plans import jobs
from loamline.sources.lake import write_backfill
from loamline.sources.messages import read_message_files
from loamline.sources.state_table import DeviceStateTable
from loamline.streaming.job import judged, start_pipeline, start_router

END = utc("2031-03-05T12:00:00")


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Two devices, drying and watered again: 400 hours of backfill and 12 hours streamed."""
    topic = Topic(spark, tmp_path_factory.mktemp("jobs"))

    def reading(device, hours_ago):
        at = END - dt.timedelta(hours=hours_ago, minutes=1)
        wet = 80.0 - ((412 - hours_ago) * 2 + device * 7) % 60
        return payload(device_id=f"dev-{device}", ts=at.isoformat(), soil_moisture_pct=wet), \
            at + dt.timedelta(minutes=1)

    from conftest import messages
    history = messages(spark, [reading(d, h) for h in range(411, 11, -1) for d in (1, 2)])
    write_backfill(gates.clean_records(judged(history)), topic.paths.backfill, END)
    for h in range(11, -1, -1):
        texts = [reading(d, h)[0] for d in (1, 2)] + (["not json"] if h == 5 else [])
        if h in (11, 5, 0):
            topic.send(*texts, ingested=END - dt.timedelta(hours=h))
    for start, source in ((start_router, topic.path), (start_pipeline, topic.paths.accepted)):
        options = {} if start is start_router else {"with_state": False, "with_monitor": False}
        for query in start(read_message_files(spark, source), topic.paths, every=None, **options).values():
            query.awaitTermination()
    accepted = spark.read.parquet(topic.paths.accepted)
    DeviceStateTable(spark, topic.paths.state).apply(gates.passing(judged(accepted)), 0)
    return topic.paths


def test_marts(spark, lake):
    built = jobs.build_marts(spark, lake, END)
    assert built["dim_devices"].count() == 2
    by_sql = spark.sql("SELECT count(*) FROM stg_telemetry s JOIN dim_devices d ON s.device_id = d.device_id")
    assert by_sql.first()[0] == built["stg_telemetry"].count() > 800
    assert built["fct_readings_hourly"].agg(F.sum("reading_count")).first()[0] == jobs.clean_table(spark, lake).count()


def test_stale_marts_fail(spark, lake):
    with pytest.raises(Exception, match="newest hour lies"):
        jobs.build_marts(spark, lake, END + dt.timedelta(days=3))


def test_retraining(spark, lake):
    jobs.build_marts(spark, lake, END)
    options = {"trees": 5, "max_depth": 4, "min_rows": 100}
    first = jobs.retrain(spark, lake, END, **options)
    assert first["candidate_version"] == "20310305T120000Z"
    again = jobs.retrain(spark, lake, END + dt.timedelta(days=1), **options)
    assert not again["promoted"] and again["current_version"] == (first["candidate_version"] if first["promoted"] else None)


def statuses(spark, *entries):
    return spark.createDataFrame(
        [(f"farm/orchard/{d}/status", bytearray(f'{{"device_id":"{d}","status":"{s}"}}'.encode()), i)
         for i, (d, s) in enumerate(entries)], "topic string, value binary, received_order bigint")


def test_freshness(spark, lake):
    report = jobs.check_freshness(spark, lake, statuses(spark, ("dev-1", "online")), END)
    assert {r["class"] for r in report.collect()} == {"healthy"}
    later = END + dt.timedelta(hours=2)
    known = statuses(spark, ("dev-1", "online"), ("dev-1", "offline"))
    report = jobs.check_freshness(spark, lake, known, later)
    assert {r["device_id"]: r["class"] for r in report.collect()} == {"dev-1": "expected_outage", "dev-2": "unknown"}
    with pytest.raises(state.GhostDevices, match="dev-2"):
        jobs.check_freshness(spark, lake, statuses(spark, ("dev-2", "online")), later)


def test_inspection(spark, lake):
    seen = jobs.inspect_lake(spark, lake)
    assert seen["range_violations"].first()[0] == 0
    assert seen["duplicate_keys"].first()[0] == 0
    row = seen["rejection_rate"].first()
    assert row["clean"] == jobs.clean_table(spark, lake).count() and row["quarantined"] == 0
    assert seen["device_breakdown"].count() == 2


def test_failing_checks_are_named(spark, lake, tmp_path, monkeypatch):
    from loamline.operators import checks
    strict = [checks.Check("stg_telemetry", "soil_moisture_pct", "accepted_range", 0, 50)]
    monkeypatch.setattr(checks, "STAGING_CHECKS", strict)
    with pytest.raises(jobs.FailedChecks, match="accepted_range_stg_telemetry_soil_moisture_pct"):
        jobs.build_marts(spark, lake, END)


def test_an_empty_lake_is_reported(spark, tmp_path):
    from loamline.streaming.job import Paths
    with pytest.raises(Exception, match="no rows in fct_readings_hourly; no rows in dim_devices"):
        jobs.build_marts(spark, Paths(str(tmp_path / "l"), str(tmp_path / "c")), END)
