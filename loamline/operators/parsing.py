"""From broker messages to typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.contract import TELEMETRY, Contract
from loamline.functions.times import parse_event_time


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    Catalyst copies a projected expression into every later filter that uses it, and a JSON parse
    or a long rule chain is then run again for each use. A one-element ``inline`` is a boundary it
    does not copy across; it is narrow and keeps every row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def envelope(raw: DataFrame) -> DataFrame:
    """Broker columns under the names used downstream, key and value as text."""
    return raw.select(
        F.col("key").cast("string").alias("kafka_key"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_ts"),
        F.col("value").cast("string").alias("raw_value"),
    )


def parse_messages(raw: DataFrame, contract: Contract = TELEMETRY) -> DataFrame:
    """Flatten the JSON value into the contract's columns; unreadable text gives NULL columns."""
    payload = F.from_json("raw_value", contract.payload_schema)
    flat = envelope(raw).select("*", F.inline(F.array(payload)))
    typed = once(flat.withColumnRenamed(contract.event_time, "event_text"),
                 **{contract.event_time: parse_event_time(F.col("event_text"))})
    return typed.select("kafka_key", "kafka_partition", "kafka_offset", "kafka_ts", "raw_value",
                        *contract.columns)
