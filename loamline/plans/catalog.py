"""One query per operator, all over the whole ``events`` table.

Reports that compare with "now" take the fixed instant ``AS_OF``, so both engines agree.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.contract import (
    CLEAN_PARTITIONS, CLEAN_SCHEMA, DEAD_LETTER_PARTITIONS, DEAD_LETTER_SCHEMA, QUARANTINE_PARTITIONS,
    QUARANTINE_SCHEMA, TELEMETRY,
)
from loamline.operators import (
    checks, features, gates, marts, models, monitoring, parsing, recalibration, scoring, state, structure,
)
from loamline.plans import event_feed, jobs
from loamline.session import prepare, scratch_dir
from loamline.sources.lake import load_hourly, materialize, read_lake, write_backfill, write_partitioned
from loamline.sources.mart_store import MartStore
from loamline.sources.model_store import ModelStore
from loamline.sources.state_table import DeviceStateTable
from loamline.streaming.job import Paths, judged, start_file_sink, start_pipeline
from loamline.streaming.progress import PROGRESS_SCHEMA, RULES, log_progress, with_gate_counts

AS_OF = "2024-01-30 18:00:00"
# An instant a few minutes before the newest records end, for reports on the last minutes.
LAST_MINUTES = "2024-01-30 23:58:00"
# Files in a micro-batch of the stream queries.
STREAM_FILES = 64
SF_COLUMNS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


# --- inputs --------------------------------------------------------------------------------------

def events(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spark).read.schema(SF_COLUMNS).parquet(f"{sf}/events.parquet")


def events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same table as a stream, be it one file or a folder of part files; a missing table raises.

    A stream reads folders, so a single file needs a pattern: the star makes it one, and a folder that
    matches is read as a table would be.
    """
    events(spark, sf)
    return (prepare(spark).readStream.schema(SF_COLUMNS)
            .option("maxFilesPerTrigger", STREAM_FILES).parquet(f"{sf}/events.parquet*"))


def messages(spark, sf):
    return event_feed.messages(events(spark, sf))


def structured(spark, sf):
    return structure.check_structure(messages(spark, sf))


def checked(spark, sf):
    return judged(messages(spark, sf))


def clean(spark, sf):
    return gates.clean_records(checked(spark, sf))


def quarantine(spark, sf):
    return gates.quarantined_records(checked(spark, sf))


def stg(spark, sf):
    return marts.staging(clean(spark, sf))


def facts(spark, sf):
    return marts.hourly_facts(stg(spark, sf))


def dims(spark, sf):
    return marts.device_dimension(stg(spark, sf), AS_OF)


def written(spark, df, label):
    """A stage several branches of a query read; written once, so that none starts from JSON again."""
    return materialize(df, scratch_dir(prepare(spark), label))


def written_marts(spark, sf):
    """Fact and dimension of one written staging view, which holds the columns they use."""
    view = written(spark, stg(spark, sf), "staging")
    return marts.hourly_facts(view), marts.device_dimension(view, AS_OF)


def newest(spark, sf):
    return state.latest_state(gates.passing(checked(spark, sf)))


def feature_table(spark, sf):
    return features.build_features(load_hourly(facts(spark, sf)))


# --- ingest and gates ----------------------------------------------------------------------------

def parse_flatten(spark, sf):
    return parsing.parse_messages(messages(spark, sf))


def structural_verdicts(spark, sf):
    df = structured(spark, sf)
    # The detail of an unreadable text is the parser's own wording; only its family is compared.
    return df.select(
        F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"),
        "record_key",
        F.when(F.col("reject_reason").startswith("invalid_json"), "invalid_json")
        .otherwise(F.col("reject_reason")).alias("verdict"))


def _opened(letters):
    """Dead letters with the envelope opened; the reason's detail is left out as above."""
    body = F.from_json("value", "reason string, mqtt_topic string, received_at string, payload string")
    return letters.select("key", "family", F.inline(F.array(body))).select(
        "key", "family", "mqtt_topic", "received_at", "payload")


def dead_letters(spark, sf):
    return _opened(structure.dead_letters(structured(spark, sf)))


def dead_letters_by_family(spark, sf):
    return structure.routing_counts(structured(spark, sf))


def gate_verdicts(spark, sf):
    return checked(spark, sf).select("kafka_partition", "kafka_offset", "quality_reason")


def state_candidates(spark, sf):
    return gates.passing(checked(spark, sf)).select(
        "device_id", "site_id", "ts", "soil_moisture_pct", "battery_v", "fw_version",
        "kafka_partition", "kafka_offset")


# --- lake reports and checks ---------------------------------------------------------------------

def quarantine_by_rule(spark, sf):
    return checks.quarantine_by_rule(quarantine(spark, sf))


def rejection_rate(spark, sf):
    return checks.rejection_rate_of(checked(spark, sf))


def clean_range_violations(spark, sf):
    """Counted on all parsed records, where there is something to find, and on the clean ones."""
    rows = written(spark, checked(spark, sf).drop("raw_value"), "judged")
    parsed = checks.range_violations(rows).withColumn("stage", F.lit("parsed"))
    kept = checks.range_violations(gates.clean_records(rows)).withColumn("stage", F.lit("clean"))
    return parsed.unionByName(kept)


def duplicate_keys(spark, sf):
    """Before and after deduplication."""
    rows = written(spark, gates.passing(checked(spark, sf)).select(
        *TELEMETRY.key, "kafka_partition", "kafka_offset"), "passing-keys")
    passed = checks.duplicate_keys(rows).withColumn("stage", F.lit("passing"))
    kept = checks.duplicate_keys(gates.deduplicate(rows)).withColumn("stage", F.lit("clean"))
    return passed.unionByName(kept)


def mart_validation(spark, sf):
    df = checks.mart_validation(*written_marts(spark, sf), "2024-02-05 00:00:00")
    return df.withColumn("problems", F.concat_ws("; ", "problems"))


def _refreshed_marts(spark, sf):
    """A mart store that sees the lake grow: days up to the 20th without some readings of the 15th, then the
    later days, then those readings, late."""
    root = scratch_dir(prepare(spark), "arrivals")
    rows = materialize(clean(spark, sf), f"{root}/rows")
    late = (F.col("date") == "2024-01-15") & (F.col("kafka_partition") == 2)
    store = MartStore(spark, f"{root}/marts")
    for part in ((F.col("date") <= "2024-01-20") & ~late, F.col("date") > "2024-01-20", late):
        write_partitioned(rows.filter(part), f"{root}/lake", CLEAN_PARTITIONS)
        store.refresh([f"{root}/lake"], AS_OF)
    return store


def mart_refreshes(spark, sf):
    """The fact after three refreshes; it equals one that is built whole."""
    return _refreshed_marts(spark, sf).read()["fct_readings_hourly"]


def dimension_refreshes(spark, sf):
    return _refreshed_marts(spark, sf).read()["dim_devices"]


def mart_changes(spark, sf):
    """The days that each refresh worked on."""
    return _refreshed_marts(spark, sf).changes().select("version", "day", (F.col("added") > 0).alias("grown"),
                                                 F.col("removed").alias("lost_files"))


def check_not_null(spark, sf):
    """Failing rows per declared column, on parsed records as well as on the staging view."""
    rows = written(spark, checked(spark, sf).drop("raw_value"), "judged")
    view = marts.staging(gates.clean_records(rows))
    rules = [c for c in checks.STAGING_CHECKS if c.kind == "not_null"]
    return (checks.run_checks(rows.withColumnRenamed("ts", "measured_at"), rules).withColumn("stage", F.lit("parsed"))
            .unionByName(checks.run_checks(view, rules).withColumn("stage", F.lit("staging"))))


def check_unique(spark, sf):
    """The dimension is unique by device; the fact's declared grain breaks where a device moved."""
    all_facts, all_devices = written_marts(spark, sf)
    dim = checks.repeated_values(all_devices, "device_id").select(
        F.lit("dim_devices").alias("model"), "device_id",
        F.lit(None).cast("timestamp").alias("hour_start"), "occurrences")
    fact = checks.repeated_values(all_facts, "device_id", "hour_start").select(
        F.lit("fct_readings_hourly").alias("model"), "device_id", "hour_start", "occurrences")
    return dim.unionByName(fact)


def check_accepted_range(spark, sf):
    """Offending values of the raw air temperature and of moisture, bounds excluded for the latter."""
    raw = written(spark, parse_flatten(spark, sf).select("air_temp_c", "soil_moisture_pct"), "measures")
    temp = checks.out_of_range(raw, "air_temp_c", -40, 80).withColumn("column", F.lit("air_temp_c"))
    wet = (checks.out_of_range(raw, "soil_moisture_pct", 0, 100, inclusive=False)
           .withColumn("column", F.lit("soil_moisture_pct")))
    return temp.unionByName(wet)


def check_summary(spark, sf):
    """All declared checks, on tables written in order as a nightly run does: four scans follow, and
    none of them starts from JSON again."""
    root = scratch_dir(prepare(spark), "marts")
    view = marts.staging(materialize(clean(spark, sf), f"{root}/telemetry"))
    fact = materialize(marts.hourly_facts(view), f"{root}/fct_readings_hourly")
    dim = materialize(marts.device_dimension(view, AS_OF), f"{root}/dim_devices")
    return (checks.run_checks(view, checks.STAGING_CHECKS)
            .unionByName(checks.run_checks(fact, checks.FACT_CHECKS))
            .unionByName(checks.run_checks(dim, checks.DEVICE_CHECKS)))


def history_summary(spark, sf):
    return checks.history_summary(clean(spark, sf))


# --- state ---------------------------------------------------------------------------------------

_STATE_OUT = ["device_id", "site_id", "ts", "soil_moisture_pct", "battery_v", "fw_version",
              "kafka_partition", "kafka_offset"]


def latest_state(spark, sf):
    return newest(spark, sf).select(*_STATE_OUT)


def state_merge(spark, sf):
    """A state of the messages before a cut, merged with that of those after it; both from one pass."""
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    passed = gates.passing(checked(spark, sf)).withColumn("_age", (F.col("kafka_ts") < cut).cast("int"))
    rows = state.state_rows(passed, TELEMETRY, "_age")
    sides = state.keep_newest(rows, [TELEMETRY.entity, "_age"], state.newest_first())
    return state.merge_ages(sides).select(*_STATE_OUT)


def device_status(spark, sf):
    found = state.status_events(event_feed.status_messages(events(spark, sf)))
    return state.latest_status(found)


def silent_devices(spark, sf):
    return state.silence_report(state.last_seen(newest(spark, sf), AS_OF), device_status(spark, sf))


def fleet_status(spark, sf):
    """Three frames from one state, over all devices."""
    now = newest(spark, sf)
    return monitoring.fleet_status(
        monitoring.silence_seconds(now, AS_OF),
        now.filter(F.col("soil_moisture_pct").isNotNull()).select("device_id", "soil_moisture_pct"),
        now.filter(F.col("battery_v").isNotNull()).select("device_id", "battery_v"))


def moisture_series(spark, sf):
    """Last known moisture per device."""
    return state.last_known(gates.passing(checked(spark, sf)), "soil_moisture_pct")


def state_table(spark, sf):
    """The state kept in three batches with a fold in between, as the stream keeps it."""
    table = DeviceStateTable(spark, scratch_dir(prepare(spark), "state-table"))
    passed = gates.passing(checked(spark, sf))
    day = F.dayofmonth("kafka_ts")
    for number, part in enumerate((day <= 10, (day > 10) & (day <= 20), day > 20)):
        table.apply(passed.filter(part), number)
        if number == 1:
            table.compact()
    return table.read().select(*_STATE_OUT)


# --- features, split, scores ---------------------------------------------------------------------

def next_hour_match(spark, sf):
    hourly = load_hourly(written(spark, facts(spark, sf), "facts"))
    return features.next_hour_match(features.build_features(hourly), hourly)


def time_split_summary(spark, sf):
    """Cutoff and summary in one lazy plan; the cutoff is a scalar subquery."""
    table = feature_table(spark, sf)
    at = features.split_cutoff(table)
    return scoring.dataset_summary(table, at.select("cutoff").scalar())


def rule_baseline_scores(spark, sf):
    return scoring.score(features.rule_baseline(feature_table(spark, sf)), "baseline_prediction")


def class_weights(spark, sf):
    return features.class_weights(feature_table(spark, sf))


def version_metrics(spark, sf):
    """Scores of three rules per day, in the shape of stored model metrics (a version per day)."""
    low = F.col("min_soil_moisture_pct")
    table = features.rule_baseline(feature_table(spark, sf)).withColumns({
        "logistic_regression": (low < 30.0).cast("int"),
        "random_forest": ((low < 36.0) & (F.col("min_soil_lag1") < 60.0)).cast("int"),
        "version": F.date_format("hour_start", "yyyyMMdd'T'000000'Z'"),
    })
    table = table.withColumnRenamed("baseline_prediction", "baseline_rule")
    names = ("baseline_rule", *scoring.MODELS)
    scored = table.groupBy("version").agg(*[
        F.struct(*[c.alias(n) for n, c in scoring.score_columns(features.LABEL, name).items()]).alias(name)
        for name in names])
    results = F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))])
    return scored.select("version", scoring.best_model(results).alias("selected_model"),
                         results.alias("results"))


def model_selection(spark, sf):
    return version_metrics(spark, sf).select(
        "version", "selected_model", F.col("results")[F.col("selected_model")]["f1"].alias("f1"),
        F.col("results")["baseline_rule"]["f1"].alias("baseline_f1"))


def promotion_decision(spark, sf):
    return scoring.promotion_decision(version_metrics(spark, sf), "20240110T000000Z")


def recalibrated(spark, sf):
    """Endpoints of each probe drift with its site; every second device has own endpoints."""
    readings = stg(spark, sf).select("device_id", "measured_at", "soil_raw", "soil_moisture_pct")
    probes = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    endpoints = probes.filter("n > 60").select(
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"),
        (F.lit(3200) - F.pmod("n", F.lit(1000))).cast("int").alias("adc_dry"),
        (F.lit(1200) + F.pmod("n", F.lit(1000))).cast("int").alias("adc_wet"))
    return recalibration.recalibrate(readings, endpoints)


# --- monitoring ----------------------------------------------------------------------------------

def seen_recently(spark, sf):
    return monitoring.seen_recently(newest(spark, sf), LAST_MINUTES, seconds=300)


# --- streams -------------------------------------------------------------------------------------

def stream_clean(spark, sf):
    """The clean table written by the stream. Copies of a message differ in offset only, and which
    one a stream keeps is open, so the broker coordinates are left out."""
    records = gates.clean_records(judged(event_feed.messages(events_stream(spark, sf))))
    table = _drain(records, "clean", CLEAN_SCHEMA, CLEAN_PARTITIONS, spark)
    return table.drop("kafka_partition", "kafka_offset")


def stream_state(spark, sf):
    """Four arrivals judged once each; the state follows the judged table and folds every second batch."""
    paths = _new_paths(spark, "stream-state")
    for onward in _arrivals(spark, sf, paths):
        start_pipeline(onward, paths, with_state=False, with_monitor=False, every=None, staged=True).finish()
        jobs.update_state(spark, paths, compact_every=2)
    return DeviceStateTable(spark, paths.state).read().select(*_STATE_OUT)


def _staged(spark, sf):
    """The job with one parse for all its queries; its paths."""
    paths = _new_paths(spark, "staged")
    start_pipeline(event_feed.messages(events_stream(spark, sf)), paths, with_state=False, with_monitor=False,
                   every=None, staged=True).finish()
    return paths


def staged_clean(spark, sf):
    """The clean table of the staged job; the coordinates are left out as above."""
    table = read_lake(spark, _staged(spark, sf).clean, CLEAN_SCHEMA)
    return table.drop("kafka_partition", "kafka_offset")


def staged_quarantine(spark, sf):
    return read_lake(spark, _staged(spark, sf).quarantine, QUARANTINE_SCHEMA)


def _new_paths(spark, label):
    root = scratch_dir(prepare(spark), label)
    return Paths(f"{root}/lake", f"{root}/ckpt")


def _drain(df, name, schema, partitions, spark):
    """Stream a frame into a partitioned table until nothing is left, and read the table."""
    root = scratch_dir(spark, name)
    start_file_sink(df, name, f"{root}/table", partitions, f"{root}/ckpt", every=None).awaitTermination()
    return read_lake(spark, f"{root}/table", schema)


def stream_quarantine(spark, sf):
    rejected = gates.quarantined_records(judged(event_feed.messages(events_stream(spark, sf))))
    return _drain(rejected, "quarantine", QUARANTINE_SCHEMA, QUARANTINE_PARTITIONS, spark)


def stream_dead_letters(spark, sf):
    checked_stream = structure.check_structure(event_feed.messages(events_stream(spark, sf)))
    table = _drain(structure.dead_letters(checked_stream), "dead-letters", DEAD_LETTER_SCHEMA,
                   DEAD_LETTER_PARTITIONS, spark)
    return _opened(table)


def backfill_rows(spark, sf):
    """A backfill written by site and date up to the last midnight, read back."""
    path = scratch_dir(prepare(spark), "backfill")
    write_backfill(clean(spark, sf), path, dt.datetime(2024, 1, 20, 15, tzinfo=dt.timezone.utc))
    return read_lake(spark, path, CLEAN_SCHEMA)


def progress_log(spark, sf):
    """What the clean stream reported about itself, summed over its micro-batches."""
    root = scratch_dir(prepare(spark), "progress")
    checked_stream = with_gate_counts(judged(event_feed.messages(events_stream(spark, sf))))
    query = start_file_sink(gates.clean_records(checked_stream), "clean", f"{root}/telemetry",
                            CLEAN_PARTITIONS, f"{root}/ckpt", every=None)
    log_progress(query, f"{root}/log")
    counted = ["input_rows", "dropped_rows", "passing_rows", *[f"{r}_rows" for r in RULES]]
    return read_lake(spark, f"{root}/log", PROGRESS_SCHEMA).groupBy("query").agg(*[F.sum(c).alias(c) for c in counted])


def _part(day: Column, k: Column) -> Column:
    """The arrival a message comes with: eight days each, some messages one arrival late."""
    return F.least(F.floor((day - 1) / 8) + F.when(k.between(40, 49), 1).otherwise(0), F.lit(3))


def _arrivals(spark, sf, paths):
    """The accepted messages as a stream, after each of four arrivals."""
    rows = events(spark, sf)
    number = _part(F.dayofmonth("ts"), F.get_json_object("props", "$.k").cast("int"))
    for part in range(4):
        event_feed.messages(rows.filter(number == part)).write.mode("append").parquet(paths.accepted)
        yield spark.readStream.schema(spark.read.parquet(paths.accepted).schema).parquet(paths.accepted)


def _arriving_stream(spark, sf):
    """The job over four arrivals, each of which moves the watermark; its paths."""
    paths = _new_paths(spark, "arriving")
    for onward in _arrivals(spark, sf, paths):
        start_pipeline(onward, paths, with_state=False, with_monitor=False, every=None).finish()
    return paths


def _recovered(spark, sf):
    paths = _arriving_stream(spark, sf)
    return paths, jobs.close_days(spark, paths, dt.date(2024, 1, 1), dt.date(2024, 12, 31))


def late_records(spark, sf):
    """What the watermark dropped, found again."""
    return _recovered(spark, sf)[1]


def stream_recovered(spark, sf):
    """Clean and late records together: all that a batch run keeps."""
    paths, _ = _recovered(spark, sf)
    return jobs.clean_table(spark, paths).drop("kafka_partition", "kafka_offset")


def watermark_drops(spark, sf):
    """Rows that the micro-batches of the last hour dropped, by the job's own log."""
    log = read_lake(spark, _arriving_stream(spark, sf).progress, PROGRESS_SCHEMA)
    return monitoring.watermark_drops(log)


def last_batch_duration(spark, sf):
    """The queries whose newest micro-batch the log has timed; the time itself differs from run to run."""
    log = read_lake(spark, _arriving_stream(spark, sf).progress, PROGRESS_SCHEMA)
    return monitoring.last_batch_duration(log).select("query", (F.col("duration_s") >= 0).alias("timed"))


# --- models --------------------------------------------------------------------------------------

def _scores(spark, sf, model):
    return models.train(feature_table(spark, sf), models=(model,)).scored[model]


def lr_scores(spark, sf):
    return _scores(spark, sf, "logistic_regression")


def rf_scores(spark, sf):
    return _scores(spark, sf, "random_forest")


def lr_optimality(spark, sf):
    """The fitted regression is the optimum: no derivative of its loss exceeds a millionth."""
    run = models.train(feature_table(spark, sf), models=("logistic_regression",))
    return models.logistic_gradient(run.models["logistic_regression"], run.learned).select(
        "coefficient", (F.abs("gradient") < 1e-6).alias("optimal"))


def roc_auc(spark, sf):
    """Exact area under the curve when dryness itself is the score; many rows share a score."""
    scored = feature_table(spark, sf).select(features.LABEL, (-F.col("min_soil_moisture_pct")).alias("score"))
    return models.area_under_roc(scored).select(F.round("roc_auc", 6).alias("roc_auc"))


def model_results(spark, sf):
    """Scores of the rule and of both models on the later part, and which model was selected."""
    run = models.train(feature_table(spark, sf))
    return run.metrics.select(F.explode("results").alias("model", "scores"), "selected_model").select(
        "model", "scores.*", (F.col("model") == F.col("selected_model")).alias("selected"))


def _trained_store(spark, sf):
    """A store after two runs, on the history up to the 25th and on all of it, with the decision after each."""
    store = ModelStore(spark, scratch_dir(prepare(spark), "model-store"))
    table = written(spark, feature_table(spark, sf), "features")
    decisions = []
    for day in (dt.datetime(2024, 1, 26, tzinfo=dt.timezone.utc), dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)):
        store.save(models.train(table.filter(F.col("hour_start") < F.lit(day)), as_of=day))
        decisions.append(store.promote_if_better(now=day))
    return store, decisions


def stored_versions(spark, sf):
    """Every stored version: what it was trained on, and the scores of the rule it had to beat."""
    store, _ = _trained_store(spark, sf)
    rule = F.col("results")[scoring.BASELINE]
    return store.metrics().select(
        "version", *[F.col("dataset")[c].alias(c) for c in ("rows_total", "rows_train", "rows_test", "devices",
                                                            "positive_rate_train", "positive_rate_test")],
        *[rule[c].alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def stored_promotions(spark, sf):
    """The decision about the newest stored version, and which version is in use after it."""
    store, decisions = _trained_store(spark, sf)
    before = decisions[-1]["current_version"]
    return scoring.promotion_decision(store.metrics(), before).withColumn("in_use", F.lit(store.current_version()))


def feature_importances(spark, sf):
    """Shares of the forest's newest stored version by feature, largest first."""
    store, _ = _trained_store(spark, sf)
    newest_run = store.metrics().agg(F.max_by("feature_importances", "version").alias("shares"))
    return newest_run.select(F.posexplode("shares").alias("place", "share")).select("place", "share.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_flatten": parse_flatten,
    "structural_verdicts": structural_verdicts,
    "dead_letters": dead_letters,
    "dead_letters_by_family": dead_letters_by_family,
    "gate_verdicts": gate_verdicts,
    "clean_rows": clean,
    "state_candidates": state_candidates,
    "quarantine_rows": quarantine,
    "quarantine_by_rule": quarantine_by_rule,
    "rejection_rate": rejection_rate,
    "clean_range_violations": clean_range_violations,
    "duplicate_keys": duplicate_keys,
    "device_breakdown": lambda spark, sf: checks.device_breakdown(clean(spark, sf)),
    "partition_inventory": lambda spark, sf: checks.partition_inventory(clean(spark, sf)),
    "staging": stg,
    "fct_readings_hourly": facts,
    "dim_devices": dims,
    "mart_validation": mart_validation,
    "mart_refreshes": mart_refreshes,
    "dimension_refreshes": dimension_refreshes,
    "mart_changes": mart_changes,
    "check_not_null": check_not_null,
    "check_unique": check_unique,
    "check_accepted_range": check_accepted_range,
    "check_summary": check_summary,
    "history_summary": history_summary,
    "latest_state": latest_state,
    "state_merge": state_merge,
    "device_status": device_status,
    "silent_devices": silent_devices,
    "fleet_status": fleet_status,
    "features": feature_table,
    "next_hour_match": next_hour_match,
    "time_split_summary": time_split_summary,
    "rule_baseline_scores": rule_baseline_scores,
    "class_weights": class_weights,
    "model_selection": model_selection,
    "promotion_decision": promotion_decision,
    "recalibrated": recalibrated,
    "throughput_5m": lambda spark, sf: monitoring.throughput(messages(spark, sf)),
    "outcome_rate_5m": lambda spark, sf: monitoring.outcome_rate(structured(spark, sf)),
    "quarantine_pct_10m": lambda spark, sf: monitoring.quarantine_pct(checked(spark, sf)),
    "rule_rate_5m": lambda spark, sf: monitoring.rule_rate(quarantine(spark, sf)),
    "seen_recently": seen_recently,
    "moisture_series": moisture_series,
    "state_table": state_table,
    "backfill_rows": backfill_rows,
    "stream_clean": stream_clean,
    "stream_quarantine": stream_quarantine,
    "stream_dead_letters": stream_dead_letters,
    "stream_state": stream_state,
    "staged_clean": staged_clean,
    "staged_quarantine": staged_quarantine,
    "progress_log": progress_log,
    "late_records": late_records,
    "stream_recovered": stream_recovered,
    "watermark_drops": watermark_drops,
    "last_batch_duration": last_batch_duration,
    "roc_auc": roc_auc,
    "lr_scores": lr_scores,
    "rf_scores": rf_scores,
    "lr_optimality": lr_optimality,
    "model_results": model_results,
    "stored_versions": stored_versions,
    "stored_promotions": stored_promotions,
    "feature_importances": feature_importances,
}
