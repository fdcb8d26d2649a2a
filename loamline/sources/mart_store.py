"""Marts kept up to date day by day.

The store holds, for every day of the lake, mergeable states per device, site, firmware and hour, and the
fact and daily states that follow from them. A refresh compares the files of the lake with those it has
taken in. Days that only got new files have the states of these files merged into their own; days that lost
files (a compaction, a corrected backfill) are computed again from all of theirs. Everything else stays as
it is. New folders become visible by one commit after the checks have passed: until then, and if a check
fails, readers see the marts as they were.

The names of the lake's files pass through the driver, where Spark keeps them for every scan anyway; so
does one path per day.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.contract import CLEAN_SCHEMA
from loamline.operators import marts
from loamline.sources.commits import CommitLog
from loamline.sources.lake import read_lake

_DAY = re.compile(r"/date=([^/]+)/")
_DAILY = ("hours", "facts", "days")
_CHANGES = "version bigint, day date, added bigint, removed bigint"


class MartStore:
    """``log`` numbers the versions, ``data/<run>`` holds what a refresh wrote."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/log")

    def refresh(self, lake: list[str], as_of=None,
                check: Callable[[dict[str, DataFrame], dict[str, DataFrame]], None] | None = None,
                rules: str = "") -> dict[str, DataFrame]:
        """Take in what changed below the ``lake`` folders and publish fact and dimension.

        ``check`` gets the marts to be, and the part of them that was not checked yet: what is new, or
        everything where ``rules``, a name of the rules it applies, differ from those of the last version.
        What it raises stops the refresh before anything becomes visible.
        """
        number, old = self.log.newest()
        files = {f: (root, _day_of(f)) for root in lake for f in read_lake(self.spark, root, CLEAN_SCHEMA).inputFiles()}
        known = {r["path"]: r["day"] for r in self._files(old).collect()}
        added = {f: at for f, at in files.items() if f not in known}
        lost = {f: day for f, day in known.items() if f not in files}
        again = set(lost.values())
        touched = sorted({day for _, day in added.values()} | again)

        run = uuid.uuid4().hex
        base = f"{self.root}/data/{run}"
        tables = {name: dict(old[name]) if old else {} for name in _DAILY}
        wanted = {f: root for f, (root, day) in files.items() if day in again or f in added}
        fresh = self._read(wanted, whole=not known)
        if touched:
            hours = marts.hour_states(marts.staging(fresh))
            kept = [tables["hours"][d] for d in touched if d not in again and d in tables["hours"]]
            if kept:
                hours = marts.merge_hours(hours.unionByName(self.spark.read.schema(hours.schema).parquet(*kept)))
            hours = self._write(hours, F.to_date("hour_start"), f"{base}/hours")
            self._write(marts.facts_of_hours(hours), F.col("measured_date"), f"{base}/facts")
            self._write(marts.day_states(hours), F.col("measured_date"), f"{base}/days")
            present = {r[0].isoformat() for r in hours.select(F.to_date("hour_start")).distinct().collect()}
            for name in _DAILY:
                for day in touched:
                    tables[name].pop(day, None)
                tables[name] |= {day: f"{base}/{name}/day={day}" for day in present}
        dims = marts.dimension_of_days(self._days(tables["days"]), as_of)
        dims.write.parquet(f"{base}/dims")
        (self.spark.createDataFrame([(f, day) for f, (_, day) in files.items()], "path string, day string")
         .write.parquet(f"{base}/files"))

        changed = {d: [sum(day == d for _, day in added.values()), sum(day == d for day in lost.values())] for d in touched}
        new = {**tables, "dims": f"{base}/dims", "files": f"{base}/files", "changed": changed, "rules": rules}
        built = self._frames(new)
        if check:
            same = old is not None and old["rules"] == rules
            checked = fresh if same else self._read({f: root for f, (root, _) in files.items()}, whole=True)
            days = tables["facts"].keys() & touched if same else tables["facts"].keys()
            check(built, {"stg_telemetry": marts.staging(checked),
                          "fct_readings_hourly": self._facts({d: tables["facts"][d] for d in days}),
                          "dim_devices": built["dim_devices"]})
        self.log.commit(number + 1, new)
        return built

    def read(self) -> dict[str, DataFrame]:
        """The published fact and dimension."""
        return self._frames(self.log.newest()[1])

    def changes(self) -> DataFrame:
        """Every day a version touched, with the number of files that came and went."""
        rows = [(n, day, *counts) for n in self.log.numbers() for day, counts in self.log.read(n)["changed"].items()]
        return self.spark.createDataFrame(rows, _CHANGES.replace("date", "string")).withColumn("day", F.to_date("day"))

    def vacuum(self) -> list[str]:
        """Delete folders that the newest version does not use, such as those of refreshes that failed. Readers
        of older versions must be done."""
        document = self.log.newest()[1]
        used = [p for name in _DAILY for p in document[name].values()] + [document["dims"], document["files"]] if document else []
        return self.log.remove_all_but(f"{self.root}/data", {p[len(self.root) + 6:].split("/")[0] for p in used})

    def _files(self, document: dict | None) -> DataFrame:
        if document is None:
            return self.spark.createDataFrame([], "path string, day string")
        return self.spark.read.schema("path string, day string").parquet(document["files"])

    def _read(self, wanted: dict[str, str], whole: bool) -> DataFrame:
        """Rows of some files, with the columns of their folders; all files of a folder go by its name."""
        out = self.spark.createDataFrame([], CLEAN_SCHEMA)
        for root in dict.fromkeys(wanted.values()):
            paths = [root] if whole else [unquote(f) for f, at in wanted.items() if at == root]
            out = out.unionByName(self.spark.read.schema(CLEAN_SCHEMA).option("basePath", root).parquet(*paths))
        return out

    def _write(self, df: DataFrame, day, path: str) -> DataFrame:
        dated = df.withColumn("day", day)
        dated.hint("rebalance", "day").write.partitionBy("day").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _facts(self, paths: dict[str, str]) -> DataFrame:
        return self._table(paths, marts.facts_of_hours(self._hours({})))

    def _hours(self, paths: dict[str, str]) -> DataFrame:
        return self._table(paths, marts.hour_states(marts.staging(self.spark.createDataFrame([], CLEAN_SCHEMA))))

    def _days(self, paths: dict[str, str]) -> DataFrame:
        return self._table(paths, marts.day_states(self._hours({})))

    def _table(self, paths: dict[str, str], like: DataFrame) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], like.schema)
        return self.spark.read.schema(like.schema).parquet(*paths.values())

    def _frames(self, document: dict | None) -> dict[str, DataFrame]:
        days = document or {"days": {}, "facts": {}}
        empty = marts.dimension_of_days(self._days({}))
        dims = self.spark.read.schema(empty.schema).parquet(document["dims"]) if document else \
            self.spark.createDataFrame([], empty.schema)
        return {"fct_readings_hourly": self._facts(days["facts"]), "dim_devices": dims}


def _day_of(path: str) -> str:
    found = _DAY.search(path)
    if not found:
        raise ValueError(f"{path} lies in no date folder")
    return found.group(1)
