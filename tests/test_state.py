import pytest
from conftest import messages, payload, utc
from pyspark.sql import functions as F

from loamline.contract import TELEMETRY
from loamline.operators import gates, state
from loamline.sources.state_table import DeviceStateTable
from loamline.streaming.job import judged

ROW = ("device_id string, site_id string, ts timestamp, soil_moisture_pct double, soil_raw int, "
       "air_temp_c double, air_humidity_pct double, battery_v double, fw_version string, "
       "kafka_partition int, kafka_offset bigint")


def rows(spark, *entries):
    """(device, time, moisture, offset) as passing records."""
    return spark.createDataFrame(
        [(d, "orchard", utc(t), m, 1, 1.0, 1.0, 4.0, "1.0.0", 0, o) for d, t, m, o in entries], ROW)


def content(df):
    return {r["device_id"]: (r["ts"].strftime("%H:%M"), r["soil_moisture_pct"]) for r in df.collect()}


def test_newest_wins_and_the_first_of_equals(spark):
    df = rows(spark, ("a", "2026-01-01T10:00:00", 1.0, 5), ("a", "2026-01-01T11:00:00", 2.0, 7),
              ("a", "2026-01-01T11:00:00", 3.0, 6), ("b", "2026-01-01T09:00:00", 4.0, 1))
    assert content(state.latest_state(df)) == {"a": ("11:00", 3.0), "b": ("09:00", 4.0)}


def test_more_devices_than_a_task_keeps_in_its_hash_table(spark):
    setting = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(setting)
    df = spark.range(4000).select(
        F.concat(F.lit("d"), F.col("id") % 500).alias("device_id"), F.lit("s").alias("site_id"),
        F.timestamp_seconds(F.col("id") * 7 % 4000).alias("ts"), F.lit(0).alias("kafka_partition"),
        F.col("id").alias("kafka_offset"))
    order = F.struct("ts", -F.col("kafka_offset"))
    want = {r["device_id"]: r["ts"] for r in df.groupBy("device_id").agg(F.max("ts").alias("ts")).collect()}
    try:
        spark.conf.set(setting, "8")
        got = {r["device_id"]: r["ts"] for r in state.keep_newest(df, "device_id", order).collect()}
    finally:
        spark.conf.set(setting, before)
    assert got == want and len(got) == 500


def test_no_devices(spark):
    assert state.latest_state(rows(spark)).count() == 0


def test_merge(spark):
    stored = rows(spark, ("late", "2026-01-01T10:00:00", 1.0, 1), ("tie", "2026-01-01T10:00:00", 1.0, 9),
                  ("newer", "2026-01-01T10:00:00", 1.0, 2), ("kept", "2026-01-01T10:00:00", 1.0, 3))
    batch = rows(spark, ("late", "2026-01-01T09:00:00", 2.0, 10), ("tie", "2026-01-01T10:00:00", 2.0, 4),
                 ("newer", "2026-01-01T11:00:00", 2.0, 11), ("new", "2026-01-01T08:00:00", 2.0, 12))
    merged = state.merge_latest(stored, batch)
    want = {"late": ("10:00", 1.0), "tie": ("10:00", 1.0), "newer": ("11:00", 2.0),
            "kept": ("10:00", 1.0), "new": ("08:00", 2.0)}
    assert content(merged) == want
    assert content(state.merge_latest(merged, batch)) == want


@pytest.fixture
def table(spark, tmp_path):
    return DeviceStateTable(spark, str(tmp_path / "state"))


def test_table_starts_empty(table):
    assert table.read().count() == 0
    assert table.compact() is None


def test_table_merges_batches_and_survives_replay(spark, table):
    first = rows(spark, ("a", "2026-01-01T10:00:00", 1.0, 1), ("b", "2026-01-01T10:00:00", 1.0, 2))
    late = rows(spark, ("a", "2026-01-01T09:00:00", 9.0, 3), ("b", "2026-01-01T10:00:00", 9.0, 4))
    fresh = rows(spark, ("a", "2026-01-01T12:00:00", 3.0, 5), ("c", "2026-01-01T12:00:00", 3.0, 6))
    for number, batch in enumerate([first, late, fresh]):
        table.apply(batch, number)
        table.apply(batch, number)      # a batch that is delivered twice
    want = {"a": ("12:00", 3.0), "b": ("10:00", 1.0), "c": ("12:00", 3.0)}
    assert content(table.read()) == want
    assert table.compact() == 2
    assert content(table.read()) == want
    assert table.compact() == 2         # nothing new


def test_vacuum_leaves_what_two_bases_need(spark, table, tmp_path):
    assert table.vacuum() == []
    held = None
    for number in range(4):
        table.apply(rows(spark, ("a", f"2026-01-01T1{number}:00:00", float(number), number)), number)
        held = table.read() if number == 3 else held    # lists base 2 and the delta behind it
        table.compact()
    assert table.vacuum() == ["through=0", "through=1", "after=0", "after=1", "after=start"]
    assert content(table.read()) == {"a": ("13:00", 3.0)} == content(held)
    assert table.vacuum() == []
    table.apply(rows(spark, ("a", "2026-01-01T15:00:00", 5.0, 9)), 4)
    assert content(table.read()) == {"a": ("15:00", 5.0)}
    with pytest.raises(ValueError, match="must stay"):
        table.vacuum(keep=0)


def test_table_goes_on_after_compaction(spark, table):
    table.apply(rows(spark, ("a", "2026-01-01T10:00:00", 1.0, 1)), 0)
    table.compact()
    table.apply(rows(spark, ("a", "2026-01-01T10:00:00", 2.0, 2), ("b", "2026-01-01T07:00:00", 2.0, 3)), 1)
    table.apply(rows(spark, ("b", "2026-01-01T08:00:00", 5.0, 4)), 2)
    want = {"a": ("10:00", 1.0), "b": ("08:00", 5.0)}
    assert content(table.read()) == want
    assert table.compact() == 2
    assert content(table.read()) == want


def test_a_batch_replayed_after_compaction_changes_nothing(spark, tmp_path):
    table = DeviceStateTable(spark, str(tmp_path / "s"), compact_every=2)
    batches = [rows(spark, ("a", f"2026-01-01T1{i}:00:00", float(i), i)) for i in range(5)]
    for number, batch in enumerate(batches):
        table.apply(batch, number)
        table.apply(batch, number)
    assert content(table.read()) == {"a": ("14:00", 4.0)}
    assert (tmp_path / "s" / "base" / "through=3").is_dir()


def test_table_equals_one_batch_however_it_is_cut(spark, table):
    df = rows(spark, *[(f"d{i % 3}", f"2026-01-01T{10 + i * 7 % 5}:00:00", float(i), i) for i in range(20)])
    for number in range(5):
        table.apply(df.filter(F.floor(F.col("kafka_offset") / 4) == number), number)
    assert content(table.read()) == content(state.latest_state(df))


def test_table_columns(spark, table):
    table.apply(rows(spark, ("a", "2026-01-01T10:00:00", 1.0, 1)), 0, now=utc("2026-01-02T00:00:00"))
    row = table.read().first()
    assert row["updated_at"] == utc("2026-01-02T00:00:00").replace(tzinfo=None)
    assert set(TELEMETRY.columns) <= set(table.read().columns)


def test_late_records_reach_the_state_but_rejected_ones_do_not(spark, table):
    frame = messages(spark, [payload(ts="2031-03-04T13:00:00Z"), payload(soil_moisture_pct=148.0)])
    table.apply(gates.passing(judged(frame)), 0)
    assert [r["ts"].hour for r in table.read().collect()] == [13]


def statuses(spark, *entries):
    frame = spark.createDataFrame([(t, bytearray(v.encode()), o) for t, v, o in entries],
                                  "topic string, value binary, received_order bigint")
    found = state.latest_status(state.status_events(frame)).collect()
    return {r["device_id"]: (r["status"], r["reason"]) for r in found}


def test_status_messages(spark):
    got = statuses(
        spark,
        ("farm/s/dev-1/status", '{"device_id":"dev-1","status":"online"}', 1),
        ("farm/s/dev-1/status", '{"device_id":"dev-1","status":"offline","reason":"last_will"}', 2),
        ("farm/s/dev-2/status", '{"status":"online"}', 3),
        ("farm/s/dev-3/status", '{"device_id":"","status":"online"}', 4),
        ("farm/s/dev-4/status", '{"device_id":"dev-4"}', 5),
        ("farm/s/dev-5/status", "not readable", 6),
        ("farm/s/dev-1/status", "not readable", 7))
    assert got == {"dev-1": ("offline", "last_will"), "dev-2": ("online", None),
                   "dev-3": ("online", None), "dev-4": ("unknown", None)}


def test_silence_classes(spark):
    now = "2026-01-01T12:00:00"
    seen = rows(spark, ("fresh", "2026-01-01T11:45:00", 1.0, 1), ("edge", "2026-01-01T11:44:54", 1.0, 2),
                ("rounded", "2026-01-01T11:44:58", 1.0, 3), ("gone", "2026-01-01T10:00:00", 1.0, 4),
                ("ghost", "2026-01-01T10:00:00", 1.0, 5), ("none", "2026-01-01T10:00:00", 1.0, 6),
                ("odd", "2026-01-01T10:00:00", 1.0, 7))
    known = spark.createDataFrame(
        [("gone", "offline"), ("ghost", "online"), ("odd", "sleeping"), ("fresh", "offline"),
         ("edge", "offline"), ("only-status", "online")], "device_id string, status string")
    report = state.silence_report(state.last_seen(seen, now), known)
    assert {r["device_id"]: r["class"] for r in report.collect()} == {
        "fresh": "healthy", "rounded": "healthy", "edge": "expected_outage", "gone": "expected_outage",
        "ghost": "ghost", "none": "unknown", "odd": "unknown"}
    with pytest.raises(state.GhostDevices, match="1 devices online without data, longest ghost") as raised:
        state.require_no_ghosts(report)
    assert raised.value.report is report
    calm = report.filter(F.col("class") != "ghost")
    assert state.require_no_ghosts(calm) is calm
