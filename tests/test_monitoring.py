import datetime as dt

from conftest import messages, payload, utc
from pyspark.sql import functions as F

from loamline.operators import gates, monitoring, structure
from loamline.streaming.job import judged


def at(minute, second=0):
    return utc(f"2031-03-05T12:{minute:02d}:{second:02d}")


def test_rates(spark):
    frame = messages(spark, [("x", at(0)), (payload(), at(1)), (payload(), at(4, 59)), (payload(), at(5))])
    got = monitoring.throughput(frame).orderBy("window_start").collect()
    assert [(r["window_start"].minute, r["n"], r["per_second"]) for r in got] == [(0, 3, 0.01), (5, 1, 1 / 300)]
    split = monitoring.outcome_rate(structure.check_structure(frame)).collect()
    assert {(r["window_start"].minute, r["result"]): r["n"] for r in split} == {
        (0, "dead_lettered"): 1, (0, "forwarded"): 2, (5, "forwarded"): 1}


def test_quarantine_share(spark):
    good = payload(ts="2031-03-05T12:00:00Z")
    checked = judged(messages(spark, [("x", at(0)), (good, at(1)), (good, at(2)), (good, at(9)), (good, at(10))]))
    got = monitoring.quarantine_pct(checked).orderBy("window_start").collect()
    assert [(r["quarantined"], r["clean"], round(r["quarantine_pct"], 6)) for r in got] == [(1, 3, 25.0), (0, 1, 0.0)]
    rule = monitoring.rule_rate(gates.quarantined_records(checked)).collect()
    assert [(r["quality_rule"], r["n"]) for r in rule] == [("unparseable_payload", 1)]


def test_seen_recently(spark):
    state = spark.createDataFrame([("a", at(0)), ("b", at(4)), ("c", at(30))], "device_id string, ts timestamp")
    assert monitoring.seen_recently(state, at(5)).first()[0] == 2       # 300 s is not below 300 s
    assert monitoring.seen_recently(state.limit(0), at(5)).first()[0] == 0


def test_watermark_drops(spark):
    log = spark.createDataFrame([(at(0) - dt.timedelta(hours=1), 5), (at(0), 3), (at(20), 4)],
                                "batch_time timestamp, dropped_rows bigint")
    assert monitoring.watermark_drops(log, at(30)).first()[0] == 7
    assert monitoring.watermark_drops(log.limit(0), at(30)).first()[0] == 0


def test_last_duration(spark):
    log = spark.createDataFrame([("q", 1, 500), ("q", 2, 1500), ("p", 0, 250)],
                                "query string, batch_id bigint, duration_ms bigint")
    assert {r["query"]: r["duration_s"] for r in monitoring.last_batch_duration(log).collect()} == {"q": 1.5, "p": 0.25}


def test_fleet(spark):
    silence = monitoring.silence_seconds(spark.createDataFrame(
        [("a", "s", at(0)), ("b", "s", at(10)), ("c", "s", at(14))],
        "device_id string, site_id string, ts timestamp"), at(15))
    moisture = spark.createDataFrame([("a", 10.0), ("d", 20.0)], "device_id string, soil_moisture_pct double")
    battery = spark.createDataFrame([("b", 3.9), ("e", 4.0)], "device_id string, battery_v double")
    got = {r["device_id"]: tuple(r)[2:] for r in monitoring.fleet_status(silence, moisture, battery).collect()}
    assert got == {"a": (900, "alarm", 10.0, None), "b": (300, "warn", None, 3.9), "c": (60, "ok", None, None),
                   "d": (None, None, 20.0, None), "e": (None, None, None, 4.0)}


def test_moisture_series(spark):
    from loamline.operators.state import last_known, latest_state
    rows = spark.createDataFrame([("a", at(0), 1.0, 0, 1), ("a", at(1), None, 0, 2)],
                                 "device_id string, ts timestamp, soil_moisture_pct double, kafka_partition int, kafka_offset bigint")
    assert [tuple(r) for r in last_known(rows, "soil_moisture_pct").collect()] == [("a", 1.0)]
    full = judged(messages(spark, [payload(), payload(ts="2031-03-05T11:30:00Z", soil_moisture_pct=1.0)]))
    assert latest_state(gates.passing(full)).select(F.col("soil_moisture_pct")).first()[0] == 41.25
