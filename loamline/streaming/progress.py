"""What each micro-batch did, as table rows; above all the rows the watermark threw away."""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import StreamingQueryProgress

from loamline.functions.texts import reason_family
from loamline.sources.lake import read_lake

# The rules a verdict can name.
RULES = ("unparseable_payload", "completeness", "range", "plausibility")
_COUNTED = ("passing_rows", *(f"{rule}_rows" for rule in RULES))
_OBSERVATION = "gates"

PROGRESS_SCHEMA = (
    "query string, run_id string, batch_id bigint, batch_time timestamp, input_rows bigint, "
    "output_rows bigint, dropped_rows bigint, watermark string, duration_ms bigint, "
    + ", ".join(f"{name} bigint" for name in _COUNTED)
)


def with_gate_counts(checked: DataFrame) -> DataFrame:
    """Count verdicts while a micro-batch runs, passing rows with their copies and rejections by rule.

    The counts arrive with the progress of the batch, so a batch that is tried again is not counted
    twice, and no second pass over the data is made.
    """
    rule = reason_family(F.col("quality_reason"))
    counts = [F.count_if(F.col("quality_reason").isNull()), *[F.count_if(rule == r) for r in RULES]]
    return checked.observe(_OBSERVATION, *[c.alias(n) for c, n in zip(counts, _COUNTED)])


def progress_row(progress: StreamingQueryProgress) -> tuple:
    """One micro-batch; output rows are NULL where the sink does not report them."""
    written = progress.sink.numOutputRows
    observed = progress.observedMetrics.get(_OBSERVATION)
    return (
        progress.name, str(progress.runId), progress.batchId,
        dt.datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00")),
        progress.numInputRows,
        written if written is not None and written >= 0 else None,
        sum(op.numRowsDroppedByWatermark for op in progress.stateOperators),
        (progress.eventTime or {}).get("watermark"),
        progress.batchDuration,
        *[observed[name] if observed else None for name in _COUNTED],
    )


def progress_table(spark: SparkSession, queries: Iterable[StreamingQuery]) -> DataFrame:
    """The micro-batches the queries still remember (Spark keeps the last hundred of each); ``log_progress``
    keeps all."""
    rows = [progress_row(p) for q in queries for p in q.recentProgress]
    return spark.createDataFrame(rows, PROGRESS_SCHEMA)


def append_progress(table: DataFrame, path: str) -> None:
    """Add the micro-batches that the log does not hold yet, so overlapping reads do no harm."""
    logged = read_lake(table.sparkSession, path, PROGRESS_SCHEMA).groupBy("query", "run_id").agg(
        F.max("batch_id").alias("_last"))
    new = table.join(logged, ["query", "run_id"], "left").filter(
        F.col("_last").isNull() | (F.col("batch_id") > F.col("_last")))
    new.select(*table.columns).coalesce(1).write.mode("append").parquet(path)


def log_progress(query: StreamingQuery, path: str, every: float = 1.0, rows: int = 25) -> None:
    """Wait until a query ends, and write all its micro-batches to a table, ``rows`` or more at a time.

    What the query remembers is read every so many seconds, far more often than it forgets, and without
    the callback port of a listener. Batches are numbered without gaps: if one was missed all the same,
    this raises, since sums over the table would be too small.
    """
    spark = SparkSession.active()
    kept = int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100"))
    last, ended = None, False
    while not ended:
        try:
            ended = query.awaitTermination(every)
        except Exception:
            _log_new(spark, query, path, last, kept, 1)
            raise
        last = _log_new(spark, query, path, last, kept, 1 if ended else rows)


def _log_new(spark: SparkSession, query: StreamingQuery, path: str, last: int | None, kept: int, least: int) -> int | None:
    """Write the micro-batches after ``last`` if there are ``least`` or more; the last one written."""
    known = query.recentProgress
    new = [progress_row(p) for p in known if last is None or p.batchId > last]
    if not new:
        return last
    first = new[0][2]
    if len(known) >= kept and (last is None or first > last + 1) and first > 0:
        raise RuntimeError(f"micro-batches before {first} of {query.name} ended unseen")
    if len(new) < least:
        return last
    append_progress(spark.createDataFrame(new, PROGRESS_SCHEMA), path)
    return new[-1][2]


class ProgressLog(threading.Thread):
    """Writes the micro-batches of running queries to one table, keyed by (query, run, batch), until all end.

    It reads what the queries remember, far more often than they forget, and opens no port. A batch that
    ended unseen is an error, which ``finish`` raises; the queries themselves go on.
    """

    def __init__(self, spark: SparkSession, queries: Iterable[StreamingQuery], path: str, every: float = 1.0,
                 rows: int = 25):
        super().__init__(name="progress-log", daemon=True)
        self._spark, self._queries, self._path = spark, list(queries), path
        self._every, self._rows = every, rows
        self._kept = int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100"))
        self._last: dict[str, int | None] = {}
        self.error: Exception | None = None

    def run(self) -> None:
        try:
            waiting = list(self._queries)
            while waiting:
                time.sleep(self._every)
                for query in list(waiting):
                    ended = not query.isActive
                    self._last[query.name] = _log_new(self._spark, query, self._path, self._last.get(query.name),
                                                      self._kept, 1 if ended else self._rows)
                    if ended:
                        waiting.remove(query)
        except Exception as error:
            self.error = error

    def finish(self) -> None:
        """Wait until all is written."""
        self.join()
        if self.error:
            raise self.error


class ProgressListener(StreamingQueryListener):
    """Hands one row per micro-batch to a callback, for jobs that run for long."""

    def __init__(self, emit: Callable[[tuple], None]):
        self._emit = emit

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._emit(progress_row(event.progress))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
