"""Sensor messages and status announcements made from the ``events`` table.

Every event becomes one message (two where it is sent twice). The value is the soil moisture, so
values above 100 are out of range by themselves. The number k in ``props`` (0 to 99) decides which
fault a message carries, if any; nothing is left out. Moisture, temperature and humidity have nine decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Faults by k; every other k gives a sound message.
NOT_JSON, NO_TS, STALE, AHEAD, BAD_TS, NO_MOISTURE, SENT_TWICE = 1, 2, 3, 4, 5, 6, 7
TOO_HOT, NO_DEVICE, NO_SITE_NO_MOISTURE, MOVED, JSON_ARRAY = 8, 9, 10, 11, 12
CUT_OFF, BLANK_DEVICE, NO_HUMIDITY, EMPTY_OBJECT, TWO_RANGES, TEXT_MOISTURE = 14, 15, 16, 17, 18, 20


def _numbered(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("at"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def _text(number: Column, kind: str) -> Column:
    return number.cast(kind).cast("string")


def _more_digits(text: Column, factor: int, digits: int) -> Column:
    """Further decimals behind a number, made from the event's id."""
    tail = (F.col("event_id") * factor) % (10 ** digits)
    return F.concat(text, F.lpad(tail.cast("string"), digits, "0"))


def _field(name: str, value: Column, *, quoted: bool = False, absent: Column | None = None) -> Column:
    """``"name":value``, or NULL where the field is absent."""
    body = F.concat(F.lit('"'), value, F.lit('"')) if quoted else value
    pair = F.concat(F.lit(f'"{name}":'), body)
    return pair if absent is None else F.when(~absent, pair)


def _device() -> Column:
    return F.concat(F.lit("dev-"), F.col("user_id").cast("string"))


def _site() -> Column:
    moved = F.when(F.col("k") == MOVED, 1).otherwise(0)
    return F.concat(F.lit("site-"), ((F.col("user_id") + moved) % 5).cast("string"))


def payload() -> Column:
    """The JSON text of one message."""
    k = F.col("k")
    sent = (F.when(k == STALE, F.col("at") - F.expr("INTERVAL 30 HOURS"))
            .when(k == AHEAD, F.col("at") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("at")))
    stamp = F.when(k == BAD_TS, "yesterday").otherwise(
        F.date_format(sent, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    moisture = (F.when(k.isin(NO_MOISTURE, NO_SITE_NO_MOISTURE), "null")
                .when(k == TEXT_MOISTURE, '"oops"').otherwise(_more_digits(_text(F.col("value"), "decimal(10,2)"), 7919, 7)))
    raw = F.when(k == TWO_RANGES, "5000").otherwise(_text(3200 - F.col("value") * 20, "int"))
    temp = F.when(k == TOO_HOT, "999.9").otherwise(
        _more_digits(_text((k * 9 - 200) / 10, "decimal(5,1)"), 104729, 8))
    humidity = F.when(k == NO_HUMIDITY, "null").otherwise(
        _more_digits(_text(40 + k * 6 / 10, "decimal(5,1)"), 15485863, 8))
    battery = F.when(k == TWO_RANGES, "9.9").otherwise(_text(3 + k / 100, "decimal(4,2)"))
    firmware = F.concat(F.lit("1."), (F.col("user_id") % 12).cast("string"), F.lit(".0"))
    device = F.when(k == BLANK_DEVICE, "").otherwise(_device())
    body = F.concat_ws(
        ",",
        _field("device_id", device, quoted=True, absent=k == NO_DEVICE),
        _field("site_id", _site(), quoted=True, absent=k == NO_SITE_NO_MOISTURE),
        _field("ts", stamp, quoted=True, absent=k == NO_TS),
        _field("soil_moisture_pct", moisture),
        _field("soil_raw", raw),
        _field("air_temp_c", temp),
        _field("air_humidity_pct", humidity),
        _field("battery_v", battery),
        _field("fw_version", firmware, quoted=True),
    )
    return (F.when(k == NOT_JSON, "this is not json").when(k == JSON_ARRAY, "[1, 2, 3]")
            .when(k == CUT_OFF, "{").when(k == EMPTY_OBJECT, "{}")
            .otherwise(F.concat(F.lit("{"), body, F.lit("}"))))


def messages(events: DataFrame) -> DataFrame:
    """Broker messages; ingested one minute after the event."""
    copies = F.when(F.col("k") == SENT_TWICE, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = _numbered(events).select("*", F.explode(copies).alias("copy"))
    return sent.select(
        _device().cast("binary").alias("key"),
        payload().cast("binary").alias("value"),
        F.concat(F.lit("farm/"), _site(), F.lit("/"), _device(), F.lit("/telemetry")).alias("topic"),
        (F.col("user_id") % 3).cast("int").alias("partition"),
        (F.col("event_id") * 2 + F.col("copy")).alias("offset"),
        (F.col("at") + F.expr("INTERVAL 1 MINUTE")).alias("timestamp"))


def status_messages(events: DataFrame) -> DataFrame:
    """Status announcements; purchase events give unreadable ones, views name no device."""
    kind = F.col("event_type")
    body = (
        F.when(kind == "purchase", "not readable")
        .when(kind == "view", '{"status":"online"}')
        .when(kind == "click", F.concat(F.lit('{"device_id":"'), _device(), F.lit('"}')))
        .when(kind == "error", F.concat(F.lit('{"device_id":"'), _device(),
                                        F.lit('","status":"offline","reason":"last_will"}')))
        .otherwise(F.concat(F.lit('{"device_id":"'), _device(), F.lit('","status":"online"}')))
    )
    return _numbered(events).select(
        F.concat(F.lit("farm/"), _site(), F.lit("/"), _device(), F.lit("/status")).alias("topic"),
        body.cast("binary").alias("value"),
        F.col("event_id").alias("received_order"))
