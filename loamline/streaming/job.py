"""The streaming job: one judged stream, up to four independent queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loamline.contract import (
    CLEAN_PARTITIONS, DEAD_LETTER_PARTITIONS, QUARANTINE_PARTITIONS, TELEMETRY, Contract,
)
from loamline.operators.gates import apply_gates, clean_records, passing, quarantined_records
from loamline.operators.parsing import parse_messages
from loamline.operators.structure import accepted, check_structure, dead_letters
from loamline.sources.state_table import DeviceStateTable
from loamline.streaming.progress import ProgressLog, with_gate_counts

# Fixed processing-time triggers.
FILE_TRIGGER = "30 seconds"
STATE_TRIGGER = "15 seconds"
# Files a micro-batch may add to one directory.
FILES_PER_DIRECTORY = 4
# State deltas are folded once per hour of such batches.
COMPACT_EVERY = 240


@dataclass(frozen=True)
class Paths:
    """Folders of the job. Sink files, checkpoint and state of a query belong together: reset all or none."""

    lake: str
    checkpoints: str

    @property
    def clean(self) -> str:
        return f"{self.lake}/telemetry"

    @property
    def quarantine(self) -> str:
        return f"{self.lake}/quarantine"

    @property
    def backfill(self) -> str:
        return f"{self.lake}/telemetry_backfill"

    @property
    def late(self) -> str:
        return f"{self.lake}/telemetry_late"

    @property
    def progress(self) -> str:
        return f"{self.lake}/progress"

    @property
    def models(self) -> str:
        return f"{self.lake}/models"

    @property
    def marts(self) -> str:
        return f"{self.lake}/marts"

    @property
    def accepted(self) -> str:
        return f"{self.lake}/accepted"

    @property
    def judged(self) -> str:
        return f"{self.lake}/judged"

    @property
    def dead_letter(self) -> str:
        return f"{self.lake}/dead_letter"

    @property
    def state(self) -> str:
        return f"{self.lake}/device_state"

    @property
    def rule_counts(self) -> str:
        return f"{self.lake}/rule_counts"


def judged(messages: DataFrame, contract: Contract = TELEMETRY) -> DataFrame:
    """Messages parsed and judged; narrow, so each query repeats it without a shuffle."""
    return apply_gates(parse_messages(messages, contract), contract)


def _writer(df: DataFrame, name: str, checkpoints: str, every: str | None):
    """An append writer with its own checkpoint; without an interval it drains what is there and stops."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (df.writeStream.queryName(name).outputMode("append")
            .option("checkpointLocation", f"{checkpoints}/{name}").trigger(**trigger))


def gathered(df: DataFrame, partitions: list[str], files: int = FILES_PER_DIRECTORY) -> DataFrame:
    """Bring the rows of a directory into a few tasks, so that a micro-batch writes few files.

    Without it every task writes a file into every directory. A hash of the row spreads a directory
    that gets most of the rows; being made from data, it is the same when a batch is tried again.
    """
    if not partitions:
        return df
    rest = [c for c in df.columns if c not in partitions]
    return df.repartition(*partitions, F.pmod(F.xxhash64(*rest), F.lit(files)))


def start_file_sink(df: DataFrame, name: str, path: str, partitions: list[str], checkpoints: str,
                    every: str | None = FILE_TRIGGER, files: int = FILES_PER_DIRECTORY) -> StreamingQuery:
    """Append to partitioned Parquet; more files per directory for larger micro-batches."""
    return (_writer(gathered(df, partitions, files), name, checkpoints, every).format("parquet")
            .option("path", path).partitionBy(*partitions).start())


def start_router(raw: DataFrame, paths: Paths, contract: Contract = TELEMETRY, *,
                 every: str | None = FILE_TRIGGER,
                 files: int = FILES_PER_DIRECTORY) -> dict[str, StreamingQuery]:
    """Structural check in front of the pipeline: sound messages on, keyed by device, others to the
    dead-letter table by reason family."""
    checked = check_structure(raw, contract)
    onward = accepted(checked).withColumn("key", F.col("record_key").cast("binary"))
    return {
        "accepted": start_file_sink(onward.select(*raw.columns), "accepted", paths.accepted, [],
                                    paths.checkpoints, every),
        "dead-letter": start_file_sink(dead_letters(checked), "dead-letter", paths.dead_letter,
                                       DEAD_LETTER_PARTITIONS, paths.checkpoints, every, files),
    }


def start_judging(messages: DataFrame, paths: Paths, contract: Contract = TELEMETRY, *,
                  every: str | None = FILE_TRIGGER) -> StreamingQuery:
    """Parse and judge each message once, into a table that other queries and jobs read.

    The sink's log names the files of every micro-batch, so a batch that is tried again adds nothing, and
    readers see whole batches only. A directory per outcome lets a branch read its own rows. Tasks write where
    they are, without a shuffle.
    """
    rows = judged(messages, contract).withColumn("passed", F.col("quality_reason").isNull())
    return (_writer(rows, "judged", paths.checkpoints, every).format("parquet")
            .option("path", paths.judged).partitionBy("passed").start())


def judged_schema(messages: DataFrame, contract: Contract = TELEMETRY) -> StructType:
    """Columns of the table ``start_judging`` fills."""
    return judged(messages, contract).schema.add("passed", "boolean")


def start_state_sink(df: DataFrame, table: DeviceStateTable, checkpoints: str,
                     every: str | None = STATE_TRIGGER) -> StreamingQuery:
    """Passing records into the device state; no watermark, so late records still arrive."""
    return _writer(df, "device-state", checkpoints, every).foreachBatch(table.apply).start()


def write_rule_counts(path: str):
    """Per-batch rejections by rule, in a folder named after the batch: a retry overwrites, never adds."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy("quality_rule").agg(F.count("*").alias("n"))
         .write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))
    return write


def start_rule_monitor(quarantine: DataFrame, path: str, checkpoints: str,
                       every: str | None = FILE_TRIGGER) -> StreamingQuery:
    return (_writer(quarantine, "quality-monitor", checkpoints, every)
            .foreachBatch(write_rule_counts(path)).start())


class Running(dict[str, StreamingQuery]):
    """The queries by name, and the log of their micro-batches."""

    progress: ProgressLog

    def finish(self) -> None:
        """Wait for all queries and for the last row of their log."""
        for query in self.values():
            query.awaitTermination()
        self.progress.finish()


def start_pipeline(messages: DataFrame, paths: Paths, contract: Contract = TELEMETRY, *,
                   with_state: bool = True, with_monitor: bool = True,
                   every: str | None = FILE_TRIGGER, files: int = FILES_PER_DIRECTORY, salts: int = 1,
                   staged: bool = False) -> Running:
    """Start the queries; ``every=None`` processes what is available and stops. What each micro-batch did goes
    to the progress table.

    Clean and quarantine are plain file sinks. State and monitor are optional and use foreachBatch.
    The clean query counts the verdicts of each micro-batch on its way; ``salts`` above 1 spreads the
    copies of a record it meets (see ``deduplicate``). With ``staged`` one query more parses the messages
    for all others, which read its table: one read of the broker and one parse instead of four, for a
    trigger's delay; what is there is then judged before the others start.
    """
    queries = Running()
    if staged:
        queries["judged"] = start_judging(messages, paths, contract, every=every)
        if every is None:
            queries["judged"].awaitTermination()
        checked = messages.sparkSession.readStream.schema(judged_schema(messages, contract)).parquet(paths.judged)
        good, failed = checked.filter("passed"), checked.filter("NOT passed")
    else:
        checked = good = failed = judged(messages, contract)
    bad = quarantined_records(failed, contract)
    counted = with_gate_counts(checked.drop("kafka_key", "raw_value"))
    queries["clean"] = start_file_sink(clean_records(counted, contract, salts), "clean", paths.clean,
                                       CLEAN_PARTITIONS, paths.checkpoints, every, files)
    queries["quarantine"] = start_file_sink(bad, "quarantine", paths.quarantine, QUARANTINE_PARTITIONS,
                                            paths.checkpoints, every, files)
    if with_state:
        table = DeviceStateTable(messages.sparkSession, paths.state, contract, COMPACT_EVERY)
        queries["device-state"] = start_state_sink(
            passing(good), table, paths.checkpoints, every and STATE_TRIGGER)
    if with_monitor:
        queries["quality-monitor"] = start_rule_monitor(bad, paths.rule_counts, paths.checkpoints, every)
    queries.progress = ProgressLog(messages.sparkSession, queries.values(), paths.progress)
    queries.progress.start()
    return queries
