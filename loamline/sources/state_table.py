"""Device state on plain Parquet: small deltas per micro-batch, folded into a base now and then.

Parquet has no conditional update, and rewriting the state of a whole fleet for each micro-batch
would cost as much as the fleet is large. A batch therefore writes only its own devices, into a
folder named after the batch, so a replayed batch overwrites itself. Readers merge the newest base
with the deltas written after it; ``compact`` folds them into the next base, and readers no longer
list the folded ones, which ``vacuum`` removes. The merge keeps the strictly newest row per device, and among equal times the
one of the earlier batch, so its result does not depend on when it is done. There is one writer, the
streaming query; readers in other sessions see either the old or the new base, both complete.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamline.contract import TELEMETRY, Contract
from loamline.operators.state import keep_newest, latest_state
from loamline.sources.commits import CommitLog
from loamline.sources.lake import read_lake


class DeviceStateTable:
    """Latest record per device below a root folder."""

    def __init__(self, spark: SparkSession, root: str, contract: Contract = TELEMETRY,
                 compact_every: int | None = None):
        self.spark, self.root, self.contract = spark, root.rstrip("/"), contract
        self.compact_every = compact_every
        kinds = {**contract.columns, contract.event_time: "timestamp"}
        names = [contract.entity, contract.site, contract.event_time, *contract.measures]
        ddl = ", ".join(f"{n} {kinds[n]}" for n in names)
        self._columns = f"{ddl}, kafka_partition int, kafka_offset bigint, updated_at timestamp, batch_id bigint"

    def apply(self, batch: DataFrame, batch_id: int, now: dt.datetime | None = None) -> None:
        """Store one micro-batch of passing records; the signature ``foreachBatch`` calls."""
        stamp = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        newest = latest_state(batch, self.contract).withColumn("updated_at", stamp)
        newest.write.mode("overwrite").parquet(
            f"{self._delta_root(self._base_batch())}/batch_id={batch_id}")
        if self.compact_every and (batch_id + 1) % self.compact_every == 0:
            self.compact()
            self.vacuum()

    def follow(self, log: str, schema: StructType | str,
               pick: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int | None:
        """Take in what a stream has appended to the table ``log`` since the last call, as the next batch; its
        number, or None where nothing is new. ``pick`` chooses the records.

        Which files a batch took is committed after its delta. A call that dies in between is made good by
        the next, which writes the same folder again; of two callers at once the slower one fails. A table
        that follows a log gets no other batches.
        """
        taken = CommitLog(self.spark, f"{self.root}/taken")
        number = len(taken.numbers())
        known = set()
        if number:
            documents = self.spark.read.schema("files array<string>").json(f"{self.root}/taken")
            known = {r[0] for r in documents.select(F.explode("files")).collect()}
        fresh = [f for f in read_lake(self.spark, log, schema).inputFiles() if f not in known]
        if not fresh:
            return None
        rows = self.spark.read.schema(schema).option("basePath", log).parquet(*map(unquote, fresh))
        self.apply(pick(rows), number)
        taken.commit(number + 1, {"files": fresh})
        return number

    def read(self) -> DataFrame:
        """The state now, one row per device."""
        return self._merged(self._base_batch()).drop("batch_id")

    def compact(self) -> int | None:
        """Fold the deltas into a new base and publish it with one appended row."""
        base = self._base_batch()
        through = read_lake(self.spark, self._delta_root(base), self._columns).agg(F.max("batch_id")).first()[0]
        if through is None or through == base:
            return base
        self._merged(base).write.mode("overwrite").parquet(f"{self.root}/base/through={through}")
        (self.spark.createDataFrame([(through,)], "through bigint").coalesce(1)
         .write.mode("append").parquet(f"{self.root}/published"))
        return through

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove what the newest ``keep`` bases do not need: older bases, and deltas folded into them.

        For the writer to call. A reader that listed one of the bases kept goes on undisturbed, so ``keep`` says how
        many compactions a read may last. The published numbers stay.
        """
        if keep < 1:
            raise ValueError("the newest base must stay")
        published = read_lake(self.spark, f"{self.root}/published", "through bigint").distinct()
        newest = [r["through"] for r in published.orderBy(F.desc("through")).limit(keep).collect()]
        if not newest:
            return []
        after = [f"after={n}" for n in newest] + (["after=start"] if len(newest) < keep else [])
        files = CommitLog(self.spark, self.root)
        return (files.remove_all_but(f"{self.root}/base", [f"through={n}" for n in newest])
                + files.remove_all_but(f"{self.root}/deltas", after))

    def _base_batch(self) -> int | None:
        published = read_lake(self.spark, f"{self.root}/published", "through bigint")
        return published.agg(F.max("through")).first()[0]

    def _delta_root(self, base: int | None) -> str:
        return f"{self.root}/deltas/after={'start' if base is None else base}"

    def _merged(self, base: int | None) -> DataFrame:
        rows = read_lake(self.spark, self._delta_root(base), self._columns)
        if base is not None:
            stored = self.spark.read.schema(self._columns).parquet(f"{self.root}/base/through={base}")
            rows = stored.unionByName(rows)
        order = F.struct(self.contract.event_time, -F.col("batch_id"))
        return keep_newest(rows, self.contract.entity, order)
