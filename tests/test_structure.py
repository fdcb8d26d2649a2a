import json
from datetime import datetime

from conftest import messages, payload, values
from pyspark.sql import functions as F

from loamline.functions.times import is_iso_timestamp
from loamline.operators import structure

CASES = [
    (payload(), None),
    ("this is not json at all", "invalid_json"),
    ("{", "invalid_json"),
    ("", "invalid_json"),
    ("   ", "invalid_json"),
    ("1,2", "invalid_json"),
    ("1,3", "invalid_json"),
    (payload() + " tail", "invalid_json"),
    ("{},6]x", "invalid_json"),
    ('{"device_id":"a","site_id":"b","ts":"2031-03-05T11:59:00Z"},70]garbage', "invalid_json"),
    (payload() + "] tail", "invalid_json"),
    (payload() + payload(), "invalid_json"),
    ("[1, 2, 3]", "not_an_object"),
    ("null", "not_an_object"),
    ("17", "not_an_object"),
    ('"text"', "not_an_object"),
    ("{}", "missing_fields:device_id,site_id,ts"),
    (payload(drop=["device_id"]), "missing_fields:device_id"),
    (payload(site_id=None), "missing_fields:site_id"),
    (payload(ts=""), "missing_fields:ts"),
    (payload(drop=["device_id", "site_id"]), "missing_fields:device_id,site_id"),
    (payload(ts="yesterday evening"), "unparseable_ts"),
    (payload(ts="12:30"), "unparseable_ts"),
    (payload(ts=20310305), None),
    (payload(device_id=0), None),
    (payload(soil_moisture_pct=148.0), None),
    (payload(soil_moisture_pct=float("nan")), None),
    (payload(soil_moisture_pct=float("-inf")), None),
    (payload(note="NaN, Infinity"), None),
    ("NaN", "not_an_object"),
    ('{"device_id":NaN,"site_id":"b","ts":"2026-01-01"}', None),
    ('{"device_id":"a","site_id":"b","ts":"2026-01-01","x":[NaN, -Infinity ]}', None),
    ('{"device_id":"a","device_id":"","site_id":"s","ts":"2031-03-05"}', "missing_fields:device_id"),
    (b"\xff\xfe{}", "invalid_json"),
]


def test_verdicts(spark):
    got = structure.check_structure(messages(spark, [t for t, _ in CASES])).orderBy("offset").collect()
    short = [r["reject_reason"] and (r["reject_reason"].split(":")[0]
             if r["reject_reason"].startswith("invalid_json") else r["reject_reason"]) for r in got]
    assert short == [want for _, want in CASES]


def by_standard_library(text: str):
    """The same judgement with Python's own parsers."""
    try:
        record = json.loads(text)
    except json.JSONDecodeError:
        return "invalid_json"
    if type(record) is not dict:
        return "not_an_object"
    gone = ",".join(n for n in ("device_id", "site_id", "ts") if record.get(n) is None or record[n] == "")
    if gone:
        return "missing_fields:" + gone
    return None if standard_time(str(record["ts"])) else "unparseable_ts"


def standard_time(text: str) -> bool:
    try:
        datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return False
    return True


def test_agrees_with_the_standard_library(spark):
    texts = [t for t, _ in CASES if isinstance(t, str)]
    got = structure.check_structure(messages(spark, texts)).orderBy("offset").collect()
    assert [(r["reject_reason"] or "").replace(":not one JSON value", "") or None for r in got] == \
        [by_standard_library(t) for t in texts]


TIMES = [
    "2031-03-05", "2031-03-05T11:59:00.000Z", "2031-03-05 11:59", "2031-03-05T11:59:00+02:00",
    "20310305T115900Z", "2031-03-05T11", "2031-03-05T25:00:00Z", "2026-02-30", "2024-02-29",
    "2031-03-05T11:59:00.1234567Z", "2026-W33-1", "2026-W33", "2026W331", "2026-W331", "2026-W54-1",
    "2026-W53-1", "2025-W53-1", "2031-03-05T115900", "2026-8-1", "2031-03-05T", "2026", " 2031-03-05",
    "2031-03-05x11:59", "20310305", "20261301", "2031-03-05T11:60", "2031-03-05T11:59:61",
    "2031-03-05T11:59:00,5", "2031-03-05T1159:00", "12:30", "now", "2031-03-05T11:59:00+0230",
    "2031-03-05T11:59:00+02", "2026-W00-1", "2026-W10-0", "2031-03-05Z11:59",
]


def test_iso_forms_agree_with_the_standard_library(spark):
    frame = spark.createDataFrame([(t,) for t in TIMES], "t string")
    got = {r["t"]: r["ok"] for r in frame.select("t", is_iso_timestamp(F.col("t")).alias("ok")).collect()}
    assert got == {t: standard_time(t) for t in TIMES}


def test_router_and_envelope(spark):
    texts = [payload(), payload(drop=["ts"]), "nope", payload(drop=["ts"], device_id="")]
    checked = structure.check_structure(messages(spark, texts))
    good = structure.accepted(checked).collect()
    assert [(r["offset"], r["record_key"]) for r in good] == [(0, "probe-7")]
    bad = structure.dead_letters(checked).collect()
    assert [(r["key"], r["family"]) for r in bad] == [
        ("probe-7", "missing_fields"), (None, "invalid_json"), (None, "missing_fields")]
    body = json.loads(bad[0]["value"])
    assert body["reason"] == "missing_fields:ts"
    assert body["mqtt_topic"] == "farm/orchard/probe-7/telemetry"
    assert body["payload"] == texts[1]
    assert datetime.fromisoformat(body["received_at"]).hour == 12


def test_undecodable_bytes_are_kept_readable(spark):
    letter = structure.dead_letters(structure.check_structure(messages(spark, [b"\xff{}"]))).first()
    assert json.loads(letter["value"])["payload"] == "�{}"


def test_counts(spark):
    checked = structure.check_structure(messages(spark, [payload(), payload(), "x", "{}"]))
    got = {(r["result"], r["family"]): r["messages"] for r in structure.routing_counts(checked).collect()}
    assert got == {("forwarded", "none"): 2, ("dead_lettered", "invalid_json"): 1,
                   ("dead_lettered", "missing_fields"): 1}


def test_no_text_can_close_the_array_itself(spark):
    """A tail that names any length, its own among them, is not JSON."""
    texts = [f"{payload()},{n}]{'x' * pad}" for n in range(150, 260) for pad in (0, 3)]
    got = values(structure.check_structure(messages(spark, texts)), "offset", "reject_reason")
    assert all(reason.startswith("invalid_json") for reason in got)
