import datetime as dt

import pytest
from conftest import NOON, messages, payload, utc, values
from pyspark.sql import functions as F

from loamline.contract import TELEMETRY
from loamline.operators import gates
from loamline.operators.parsing import parse_messages
from loamline.streaming.job import judged

HOUR, MINUTE = dt.timedelta(hours=1), dt.timedelta(minutes=1)


def iso(at):
    return at.isoformat()


CASES = [
    (payload(), None),
    (payload(soil_moisture_pct=None), "completeness:soil_moisture_pct"),
    (payload(drop=["ts"]), "completeness:ts"),
    (payload(soil_moisture_pct=148.0), "range:soil_moisture_pct"),
    (payload(soil_moisture_pct=-12.4), "range:soil_moisture_pct"),
    (payload(air_temp_c=-273.0), "range:air_temp_c"),
    (payload(air_humidity_pct=120.0), "range:air_humidity_pct"),
    (payload(soil_raw=5000), "range:soil_raw"),
    (payload(battery_v=9.9), "range:battery_v"),
    (payload(ts=iso(NOON - 26 * HOUR)), "plausibility:stale_ts"),
    (payload(ts=iso(NOON + 2 * HOUR)), "plausibility:future_ts"),
    ("this is not json at all", "unparseable_payload"),
    (payload(soil_moisture_pct=None, air_temp_c=999.0), "completeness:soil_moisture_pct"),
    # Bounds belong to the allowed range, in values and in time.
    (payload(soil_moisture_pct=0.0, soil_raw=4095, air_temp_c=-40.0, battery_v=2.5), None),
    (payload(soil_moisture_pct=100.0, soil_raw=0, air_temp_c=80.0, battery_v=5.0), None),
    (payload(ts=iso(NOON + 5 * MINUTE)), None),
    (payload(ts=iso(NOON - 24 * HOUR)), None),
    (payload(ts=iso(NOON + 5 * MINUTE + dt.timedelta(microseconds=1))), "plausibility:future_ts"),
    (payload(ts=iso(NOON - 24 * HOUR - dt.timedelta(microseconds=1))), "plausibility:stale_ts"),
    # Every offending column is named, in contract order.
    (payload(battery_v=9.9, soil_moisture_pct=101.0), "range:soil_moisture_pct,battery_v"),
    (payload(soil_raw=-1, air_humidity_pct=-1.0), "range:air_humidity_pct,soil_raw"),
    (payload(device_id=None, soil_moisture_pct=None), "completeness:device_id,soil_moisture_pct"),
    # Optional fields may be missing; fields of a wrong type count as missing.
    (payload(drop=["battery_v"], air_temp_c=None, soil_raw="x"), None),
    (payload(soil_moisture_pct="oops"), "completeness:soil_moisture_pct"),
    (payload(soil_moisture_pct=float("nan")), "range:soil_moisture_pct"),
    (payload(device_id=""), None),
    (payload(device_id=17), None),
    # A time without a date would be completed with today's; it must count as unreadable.
    (payload(ts="12:30"), "completeness:ts"),
    (payload(ts="yesterday"), "completeness:ts"),
    (payload(ts="T12:30:00Z"), "completeness:ts"),
    ("{}", "unparseable_payload"),
    ("[1, 2, 3]", "unparseable_payload"),
    ("null", "unparseable_payload"),
    ("", "unparseable_payload"),
    ('{"soil_moisture_pct": 5}', "unparseable_payload"),
]


def test_verdicts(spark):
    got = values(judged(messages(spark, [text for text, _ in CASES])))
    assert got == [reason for _, reason in CASES]


def test_replay_gives_the_same_verdict(spark):
    long_ago = utc("2024-01-01T08:00:00")
    frame = messages(spark, [payload(ts=iso(long_ago))], ingested=long_ago + MINUTE)
    assert values(judged(frame)) == [None]


def test_missing_value_bytes_stay_in_the_stream(spark):
    frame = messages(spark, [payload()]).withColumn("value", F.lit(None).cast("binary"))
    assert values(judged(frame)) == ["unparseable_payload"]


def test_contract_is_declared(spark):
    parsed = parse_messages(messages(spark, [payload()]))
    kinds = dict(parsed.dtypes)
    assert len(TELEMETRY.columns) == 9
    assert (kinds["soil_moisture_pct"], kinds["soil_raw"], kinds["ts"]) == ("double", "int", "timestamp")


def test_clean_keeps_the_first_copy(spark):
    frame = messages(spark, [payload(), payload(soil_moisture_pct=60.0), payload(ts="2031-03-05T11:58:00Z"),
                             payload(soil_moisture_pct=148.0)])
    rows = gates.clean_records(judged(frame)).orderBy("kafka_offset").collect()
    assert [(r["kafka_offset"], r["soil_moisture_pct"]) for r in rows] == [(0, 41.25), (2, 41.25)]
    assert rows[0]["date"] == dt.date(2031, 3, 5)


def test_clean_columns(spark):
    clean = gates.clean_records(judged(messages(spark, [payload()])))
    assert clean.columns == [
        "device_id", "site_id", "ts", "date", "soil_moisture_pct", "soil_raw", "air_temp_c",
        "air_humidity_pct", "battery_v", "fw_version", "kafka_partition", "kafka_offset"]


def test_quarantine_keeps_text_and_dates_by_ingestion(spark):
    text = payload(ts=iso(NOON - 50 * HOUR))
    row = gates.quarantined_records(judged(messages(spark, [text, payload()]))).collect()
    assert len(row) == 1
    assert row[0]["quality_rule"] == "plausibility"
    assert row[0]["raw_value"] == text
    assert row[0]["date"] == NOON.date()


def test_state_branch_keeps_copies(spark):
    frame = messages(spark, [payload(), payload(), payload(soil_moisture_pct=148.0)])
    assert gates.passing(judged(frame)).count() == 2


def test_one_hot_key_is_reduced_before_the_shuffle(spark):
    """Many copies of one record: the rank filter runs on both sides of the exchange."""
    frame = messages(spark, [payload()] * 50)
    clean = gates.clean_records(judged(frame))
    assert clean.count() == 1
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "Final" in plan and "WindowGroupLimit" in plan


@pytest.mark.parametrize("zone", ["+02:00", "-05:30"])
def test_zones_are_honoured(spark, zone):
    row = parse_messages(messages(spark, [payload(ts=f"2031-03-05T11:59:00{zone}")])).first()
    want = dt.datetime.fromisoformat(f"2031-03-05T11:59:00{zone}").astimezone(dt.timezone.utc)
    assert row["ts"].replace(tzinfo=dt.timezone.utc) == want
