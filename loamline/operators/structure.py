"""Is a message readable at all? The check in front of the broker.

Only structure is judged here: readable JSON object, identity fields present, a real timestamp.
Whether the values make sense is the business of ``gates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.contract import TELEMETRY, Contract
from loamline.functions.texts import any_of, flagged, is_blank, reason_family
from loamline.functions.times import is_iso_timestamp
from loamline.operators.parsing import once


# Number words that are not JSON but that common producers write and common parsers read.
_NON_FINITE = r"(?<=^|[:\[,\s])(NaN|-?Infinity)(?=[,\]}\s]|$)"


def _sole_json_value(text: Column) -> Column:
    """The text as an array ``[value, seal]``, NULL if it is not JSON.

    The parser stops after the first value, so trailing garbage would go unseen. Closing the array
    with a hash of the whole text, which no text can contain, makes anything but exactly one value show up.
    """
    def parse(body: Column) -> Column:
        return F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), F.sha2(text, 256), F.lit('"]')))

    lenient = F.when(text.rlike("NaN|Infinity"), parse(F.regexp_replace(text, _NON_FINITE, "0")))
    return F.coalesce(parse(text), lenient)


def check_structure(messages: DataFrame, contract: Contract = TELEMETRY,
                    value: str = "value") -> DataFrame:
    """Add ``record_key`` (device, where readable) and ``reject_reason`` (NULL = accepted)."""
    text = F.col(value).cast("string")
    sound = F.when(F.is_valid_utf8(text), text)
    read = messages.withColumn("_text", sound).withColumns(
        {"_json": _sole_json_value(F.col("_text")), "_seal": F.sha2("_text", 256)})

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get("_json", path, kind)

    # Only an object can be read as a struct, so a NULL record is some other JSON value.
    record = ", ".join(f"{name}: string" for name in contract.structural)
    fields = read.withColumns({
        "_readable": F.coalesce(at("$[1]", "string") == F.col("_seal"), F.lit(False))
                     & at("$[2]", "variant").isNull(),
        "_record": at("$[0]", f"struct<{record}>"),
    })
    missing = {n: is_blank(F.col("_record")[n]) for n in contract.structural}
    reason = (
        F.when(~F.col("_readable"), F.lit("invalid_json:not one JSON value"))
        .when(F.col("_record").isNull(), F.lit("not_an_object"))
        .when(any_of(missing), F.concat(F.lit("missing_fields:"), flagged(missing)))
        .when(~is_iso_timestamp(F.col("_record")[contract.event_time]), F.lit("unparseable_ts"))
    )
    device = F.col("_record")[contract.entity]
    key = F.when(F.col("_readable") & ~is_blank(device), device)
    return once(fields, record_key=key, reject_reason=reason).select(
        *messages.columns, "record_key", "reject_reason")


def accepted(checked: DataFrame) -> DataFrame:
    """Messages for the main stream, keyed by device."""
    return checked.filter(F.col("reject_reason").isNull())


def dead_letters(checked: DataFrame, topic: str = "topic", received: str = "timestamp",
                 value: str = "value") -> DataFrame:
    """Rejected messages in a JSON envelope, with the reason family to group and partition by."""
    return checked.filter(F.col("reject_reason").isNotNull()).select(
        F.col("record_key").alias("key"),
        reason_family(F.col("reject_reason")).alias("family"),
        F.to_json(F.struct(
            F.col("reject_reason").alias("reason"),
            F.col(topic).alias("mqtt_topic"),
            F.date_format(received, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("received_at"),
            F.make_valid_utf8(F.col(value).cast("string")).alias("payload"),
        )).alias("value"),
    )


def routing_counts(checked: DataFrame) -> DataFrame:
    """Messages per outcome and reason family."""
    return checked.groupBy(
        F.when(F.col("reject_reason").isNull(), "forwarded").otherwise("dead_lettered").alias("result"),
        F.coalesce(reason_family(F.col("reject_reason")), F.lit("none")).alias("family"),
    ).agg(F.count("*").alias("messages"))
