"""Do the values make sense? Ordered gates with one verdict per record.

A verdict depends on the record and its ingestion time only, never on the clock, so replaying a
stream gives the same verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.contract import TELEMETRY, Contract
from loamline.functions.numbers import outside
from loamline.functions.texts import any_of, flagged, reason_family
from loamline.operators.parsing import once


def quality_verdict(contract: Contract = TELEMETRY, ingest_time: str = "kafka_ts") -> Column:
    """The first gate a record fails, NULL if it passes all."""
    event, ingest = F.col(contract.event_time), F.col(ingest_time)
    unreadable = F.coalesce(*[F.col(c).cast("string") for c in contract.identity]).isNull()
    absent = {c: F.col(c).isNull() for c in contract.required}
    beyond = {c: outside(F.col(c), lo, hi) for c, (lo, hi) in contract.ranges.items()}
    ahead = event > ingest + F.expr(f"INTERVAL {contract.max_ahead}")
    stale = event < ingest - F.expr(f"INTERVAL {contract.max_age}")
    return (
        F.when(unreadable, F.lit("unparseable_payload"))
        .when(any_of(absent), F.concat(F.lit("completeness:"), flagged(absent)))
        .when(any_of(beyond), F.concat(F.lit("range:"), flagged(beyond)))
        .when(ahead, F.lit("plausibility:future_ts"))
        .when(stale, F.lit("plausibility:stale_ts"))
    )


def apply_gates(parsed: DataFrame, contract: Contract = TELEMETRY) -> DataFrame:
    """Add ``quality_reason``."""
    return once(parsed, quality_reason=quality_verdict(contract))


def passing(checked: DataFrame) -> DataFrame:
    """Records that passed; no watermark and no deduplication, as the device state needs them."""
    return checked.filter(F.col("quality_reason").isNull())


def deduplicate(records: DataFrame, contract: Contract = TELEMETRY, salts: int = 1) -> DataFrame:
    """One record per device and event time.

    A stream keeps the first to arrive, within the watermark. A batch keeps the one with the lowest
    offset; the rank filter is also applied before the shuffle, so many copies of one key do not
    travel. Streams have no such step: with ``salts`` above 1 they drop copies among as many shares
    of a key first, at the price of a second state, so that a device that repeats itself endlessly
    does not keep one task busy.
    """
    if records.isStreaming:
        timed = records.withWatermark(contract.event_time, contract.watermark)
        if salts > 1:
            timed = (timed.withColumn("_salt", F.pmod("kafka_offset", F.lit(salts)))
                     .dropDuplicates([*contract.key, "_salt"]).drop("_salt"))
        return timed.dropDuplicates(list(contract.key))
    order = Window.partitionBy(*contract.key).orderBy("kafka_offset", "kafka_partition")
    return records.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def clean_records(checked: DataFrame, contract: Contract = TELEMETRY, salts: int = 1) -> DataFrame:
    """The clean table: passing, deduplicated, dated by event time."""
    narrow = passing(checked).select(*contract.columns, "kafka_partition", "kafka_offset")
    return deduplicate(narrow, contract, salts).select(
        contract.entity, contract.site, contract.event_time,
        F.to_date(contract.event_time).alias("date"),
        *contract.measures, "kafka_partition", "kafka_offset")


def quarantined_records(checked: DataFrame, contract: Contract = TELEMETRY) -> DataFrame:
    """The quarantine table: rejected records with reason and original text, dated by ingestion."""
    return checked.filter(F.col("quality_reason").isNotNull()).select(
        reason_family(F.col("quality_reason")).alias("quality_rule"),
        "quality_reason", contract.entity, contract.site, contract.event_time,
        F.to_date("kafka_ts").alias("date"),
        "kafka_ts", "kafka_partition", "kafka_offset", "raw_value")
