"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

import ast
import math
import re
from pathlib import Path

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry_point
from loamline.plans import catalog
from loamline.plans.catalog import QUERIES
from loamline.plans.oracle import ORACLE
from loamline.sources.lake import materialize

ROWS_ONLY = {"lr_scores", "rf_scores", "model_results", "stored_promotions", "feature_importances"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_all_but_the_inexpressible_have_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)
    assert entry_point.queries().keys() >= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_to_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(normal(r[c]) for c in columns) for r in df.collect()]
    cursor = duck.execute(ORACLE[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    want = [tuple(normal(r[i]) for i in at) for r in cursor.fetchall()]
    assert ordered(got) == ordered(want)


def test_model_results_hold_the_rule(spark, duck):
    """The models' scores have no SQL; the rule's scores on the later rows do."""
    got = {r["model"]: r for r in QUERIES["model_results"](spark, SF).collect()}
    assert set(got) == {"baseline_rule", "logistic_regression", "random_forest"}
    assert sum(r["selected"] for r in got.values()) == 1
    late = ORACLE["rule_baseline_scores"].rsplit(" FROM feat", 1)[0] + (
        " FROM feat WHERE hour_start > (SELECT make_timestamp(cast(floor(quantile_cont("
        "epoch_us(hour_start), 0.7)) AS bigint)) FROM feat)")
    want = duck.execute(late).fetchone()
    assert tuple(got["baseline_rule"][c] for c in ("accuracy", "precision", "recall", "f1")) == want


def test_promotion_reads_stored_versions(spark):
    row = QUERIES["stored_promotions"](spark, SF).first()
    assert row["candidate_version"] == "20240201T000000Z"
    assert row["in_use"] == ("20240201T000000Z" if row["promoted"] else row["current_version"])


def test_no_function_of_the_catalog_hides_another():
    names = [n.name for n in ast.parse(Path(catalog.__file__).read_text()).body if isinstance(n, ast.FunctionDef)]
    assert sorted(names) == sorted(set(names))


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Queries that write tables or run a stream before they return a plan.
WRITING = {"stream_clean", "stream_quarantine", "stream_dead_letters", "stream_state", "progress_log", "staged_clean", "staged_quarantine",
           "state_table", "backfill_rows", "check_summary", "roc_auc", "mart_refreshes", "dimension_refreshes",
           "mart_changes", "late_records", "stream_recovered", "watermark_drops", "last_batch_duration",
           "stored_versions", "lr_optimality"}
LAZY = sorted(set(ORACLE) - WRITING)


@pytest.mark.parametrize("name", LAZY)
def test_plans_stay_in_the_jvm_and_free_of_cross_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython",
                     "MapInPandas", "Exchange SinglePartition, REPARTITION"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", ["gate_verdicts", "clean_rows", "quarantine_rows", "fct_readings_hourly"])
def test_json_is_parsed_once(spark, name):
    assert plan_of(QUERIES[name](spark, SF)).count("from_json(") == 1


@pytest.mark.parametrize("name, parses", [
    ("next_hour_match", 1), ("mart_validation", 1), ("check_unique", 1), ("rejection_rate", 1), ("duplicate_keys", 1),
    ("clean_range_violations", 1), ("check_not_null", 1), ("check_accepted_range", 1), ("state_merge", 1),
    ("fleet_status", 1), ("silent_devices", 2)])
def test_shared_inputs_run_once(spark, monkeypatch, name, parses):
    """Written stages included; silent devices read readings and announcements, which are two texts."""
    stages = []

    def recorded(df, path):
        stages.append(plan_of(df))
        return materialize(df, path)

    monkeypatch.setattr(catalog, "materialize", recorded)
    df = QUERIES[name](spark, SF)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert sum(p.count("from_json(") for p in [*stages, final]) == parses


@pytest.mark.parametrize("name", ["latest_state", "state_merge", "silent_devices", "fleet_status", "moisture_series"])
def test_latest_rows_are_found_without_sorting(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" in plan


def test_features_run_their_input_once(spark):
    df = QUERIES["features"](spark, SF)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1, final
    assert "ReusedExchange" in final


def test_fact_aggregates_with_hash_tables(spark):
    plan = plan_of(QUERIES["fct_readings_hourly"](spark, SF))
    assert "SortAggregate" not in plan and len(re.findall("HashAggregate", plan)) >= 2


def test_unused_columns_are_not_read(spark):
    plan = plan_of(QUERIES["throughput_5m"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,props:string>" in plan


@pytest.mark.parametrize("name", ["stream_clean", "progress_log"])
def test_streams_read_a_folder_of_parts(spark, tmp_path, name):
    """The same rows whether the table is one file or a folder; a missing table raises."""
    from loamline.plans.catalog import events_stream
    spark.read.parquet(f"{SF}/events.parquet").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES[name](spark, str(tmp_path))
    want = QUERIES[name](spark, SF)
    assert ordered(map(tuple, got.collect())) == ordered(map(tuple, want.collect()))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        events_stream(spark, str(tmp_path / "absent"))


def test_progress_log_counts_all_batches(spark, tmp_path, monkeypatch):
    """More micro-batches than a query remembers."""
    from loamline.plans import catalog
    monkeypatch.setattr(catalog, "STREAM_FILES", 1)
    source = spark.read.parquet(f"{SF}/events.parquet")
    source.limit(130).repartitionByRange(130, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["progress_log"](spark, str(tmp_path)).first()
    want = source.limit(130).count()
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) > 110
    assert got["input_rows"] == want
    assert got["passing_rows"] == catalog.gates.passing(catalog.checked(spark, str(tmp_path))).count()
