"""The scheduled jobs on the lake: marts, freshness, retraining, inspection.

Each is one function over the tables the stream writes; a scheduler calls it and treats an error as a
failed run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.contract import CLEAN_SCHEMA, QUARANTINE_SCHEMA
from loamline.operators import checks, features, marts, models, state
from loamline.operators.gates import passing
from loamline.sources.lake import load_hourly, read_lake, read_with_backfill
from loamline.sources.mart_store import MartStore
from loamline.sources.messages import MESSAGE_SCHEMA
from loamline.sources.model_store import ModelStore
from loamline.sources.state_table import DeviceStateTable
from loamline.streaming.job import COMPACT_EVERY, Paths, judged_schema
from loamline.streaming.late import recover_late


class FailedChecks(RuntimeError):
    """A declared check found offending rows."""


def clean_table(spark: SparkSession, paths: Paths) -> DataFrame:
    """Streamed and backfilled readings, and those that came too late for the stream."""
    return (read_with_backfill(spark, paths.clean, paths.backfill, CLEAN_SCHEMA)
            .unionByName(read_lake(spark, paths.late, CLEAN_SCHEMA)))


def close_days(spark: SparkSession, paths: Paths, first: dt.date, last: dt.date | None = None) -> DataFrame:
    """Recover what the stream dropped of the messages ingested on days it has left behind."""
    return recover_late(spark, spark.read.parquet(paths.accepted), paths, first, last)


def build_marts(spark: SparkSession, paths: Paths, as_of: dt.datetime | None = None) -> dict[str, DataFrame]:
    """Bring fact and dimension up to date: days that got or lost files since the last run are worked on, all
    others stay. Declared checks run on what is new (on
    everything when the declarations changed), size and freshness are validated on the whole, and
    only then do readers see the new marts; an error leaves the old ones in place.

    Staging stays a view over the lake; all three can be queried in SQL by name afterwards.
    """
    def check(built: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> None:
        verdicts = (checks.run_checks(fresh["stg_telemetry"], checks.STAGING_CHECKS)
                    .unionByName(checks.run_checks(fresh["fct_readings_hourly"], checks.FACT_CHECKS))
                    .unionByName(checks.run_checks(fresh["dim_devices"], checks.DEVICE_CHECKS)))
        failed = [f"{r['check_name']} ({r['failures']})" for r in verdicts.filter(~F.col("passed")).collect()]
        if failed:
            raise FailedChecks(", ".join(sorted(failed)))
        checks.require_valid_marts(checks.mart_validation(built["fct_readings_hourly"], built["dim_devices"], as_of))

    rules = repr([checks.STAGING_CHECKS, checks.FACT_CHECKS, checks.DEVICE_CHECKS])
    built = {"stg_telemetry": marts.staging(clean_table(spark, paths)),
             **MartStore(spark, paths.marts).refresh([paths.clean, paths.backfill, paths.late], as_of, check, rules)}
    for name, model in built.items():
        model.createOrReplaceTempView(name)
    return built


def update_state(spark: SparkSession, paths: Paths, compact_every: int = COMPACT_EVERY) -> int | None:
    """Bring the device state up to date with the table of a staged job, without a parse of its own."""
    schema = judged_schema(spark.createDataFrame([], MESSAGE_SCHEMA))
    return DeviceStateTable(spark, paths.state, compact_every=compact_every).follow(paths.judged, schema, passing)


def check_freshness(spark: SparkSession, paths: Paths, status_messages: DataFrame,
                    as_of: dt.datetime | None = None) -> DataFrame:
    """Classify silent devices; fails when one claims to be online."""
    known = DeviceStateTable(spark, paths.state).read()
    status = state.latest_status(state.status_events(status_messages))
    return state.require_no_ghosts(state.silence_report(state.last_seen(known, as_of), status))


def retrain(spark: SparkSession, paths: Paths, as_of: dt.datetime | None = None, **options) -> dict:
    """Train a candidate on the fact table, store it, and promote it only if it is better."""
    fact = MartStore(spark, paths.marts).read()["fct_readings_hourly"]
    run = models.train(features.build_features(load_hourly(fact)), as_of=as_of, **options)
    store = ModelStore(spark, paths.models)
    store.save(run)
    return store.promote_if_better(now=as_of)


def inspect_lake(spark: SparkSession, paths: Paths) -> dict[str, DataFrame]:
    """The reports one looks at first; both violation counts must be 0."""
    clean = clean_table(spark, paths)
    bad = read_lake(spark, paths.quarantine, QUARANTINE_SCHEMA)
    return {
        "rejection_rate": checks.rejection_rate(clean, bad),
        "quarantine_by_rule": checks.quarantine_by_rule(bad),
        "range_violations": checks.range_violations(clean),
        "duplicate_keys": checks.duplicate_keys(clean),
        "device_breakdown": checks.device_breakdown(clean),
        "partition_inventory": checks.partition_inventory(clean),
    }
