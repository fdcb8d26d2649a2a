"""Latest state per device, and why a device is silent.

The newest event time wins. Among equal event times the record that came first stays, so the result
does not depend on how a stream was cut into batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.contract import SILENCE_MINUTES, TELEMETRY, Contract
from loamline.functions.times import age_minutes, as_of_column
from loamline.functions.texts import topic_segment


def keep_newest(df: DataFrame, key: str | list[str], order: Column) -> DataFrame:
    """One row per key, the one with the highest order; reduced before the shuffle.

    A row with texts in it is no fixed-width buffer, and by itself would make Spark sort all rows first. Beside an
    aggregate whose buffer is an object it is kept in a hash table; ``collect_list`` of nothing is the smallest
    one. A task that meets more keys than the fallback threshold of the session goes on by sorting.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"),
                                 F.collect_list(F.lit(None).cast("int")).alias("_nothing"))
    # Looking at the empty list keeps the optimizer from dropping it, and hash tables with it.
    return best.filter(F.size("_nothing") == 0).select(*keys, "_best.*")


def latest_state(records: DataFrame, contract: Contract = TELEMETRY) -> DataFrame:
    """The newest record of each device."""
    return keep_newest(state_rows(records, contract), contract.entity, newest_first(contract))


def newest_first(contract: Contract = TELEMETRY) -> Column:
    """The order of records of a device: newest event time, then the first received."""
    return F.struct(contract.event_time, -F.col("kafka_offset"), -F.col("kafka_partition"))


def state_rows(records: DataFrame, contract: Contract = TELEMETRY, *further: str) -> DataFrame:
    """The columns that a device state holds."""
    return records.select(contract.entity, contract.site, contract.event_time, *contract.measures,
                          "kafka_partition", "kafka_offset", *further)


def merge_latest(stored: DataFrame, batch: DataFrame, contract: Contract = TELEMETRY) -> DataFrame:
    """Fold newer rows into a stored state: insert new devices, replace strictly older rows."""
    return merge_ages(stored.withColumn("_age", F.lit(1)).unionByName(batch.withColumn("_age", F.lit(0))),
                      contract)


def merge_ages(tagged: DataFrame, contract: Contract = TELEMETRY) -> DataFrame:
    """The same for rows that say by ``_age`` which side they are from, 1 for stored ones and 0 for newer ones."""
    order = F.struct(contract.event_time, "_age", -F.col("kafka_offset"), -F.col("kafka_partition"))
    return keep_newest(tagged, contract.entity, order).drop("_age")


def last_known(records: DataFrame, measure: str, contract: Contract = TELEMETRY) -> DataFrame:
    """The newest non-NULL value of one measure per device."""
    rows = records.filter(F.col(measure).isNotNull()).select(
        contract.entity, measure, newest_first(contract).alias("_order"))
    return keep_newest(rows, contract.entity, F.col("_order")).drop("_order")


def status_events(messages: DataFrame, value: str = "value", topic: str = "topic") -> DataFrame:
    """Status announcements; unreadable ones are skipped, a missing device is taken from the topic."""
    body = F.from_json(F.col(value).cast("string"), "device_id string, status string, reason string, "
                       "_broken string", {"columnNameOfCorruptRecord": "_broken"})
    read = messages.select(F.col(topic).alias("_topic"), "received_order", F.inline(F.array(body)))
    device = F.when(F.col("device_id") != "", F.col("device_id"))
    return read.filter(F.col("_broken").isNull()).select(
        F.coalesce(device, topic_segment(F.col("_topic"), -2)).alias("device_id"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        "reason", "received_order")


def latest_status(events: DataFrame) -> DataFrame:
    """The last announcement of each device."""
    return keep_newest(events, "device_id", F.col("received_order"))


def last_seen(state: DataFrame, as_of=None, contract: Contract = TELEMETRY) -> DataFrame:
    """Age of each device's newest record in minutes."""
    return state.select(contract.entity, contract.site,
                        age_minutes(F.col(contract.event_time), as_of_column(as_of)).alias("age_minutes"))


def silence_report(seen: DataFrame, status: DataFrame,
                   threshold_minutes: float = SILENCE_MINUTES) -> DataFrame:
    """Class of each device with state: healthy, expected_outage, ghost or unknown.

    Both sides hold one row per device, so the join is left to the optimizer.
    """
    joined = seen.join(status.select("device_id", "status"), "device_id", "left")
    kind = (
        F.when(F.col("age_minutes") <= threshold_minutes, "healthy")
        .when(F.col("status") == "offline", "expected_outage")
        .when(F.col("status") == "online", "ghost")
        .otherwise("unknown")
    )
    return joined.select("device_id", "site_id", "age_minutes", "status", kind.alias("class"))


class GhostDevices(RuntimeError):
    """Devices that claim to be online but send nothing. ``report`` is the whole report, ghosts included."""

    def __init__(self, message: str, report: DataFrame):
        super().__init__(message)
        self.report = report


def require_no_ghosts(report: DataFrame) -> DataFrame:
    """Pass the report on, or raise with the report; the message counts the ghosts and names the worst."""
    ghosts = report.filter(F.col("class") == "ghost")
    total = ghosts.count()
    if total:
        worst = ghosts.orderBy(F.desc("age_minutes"), "device_id").first()
        raise GhostDevices(f"{total} devices online without data, longest {worst['device_id']} "
                           f"({worst['age_minutes']} min); all are in the report", report)
    return report
