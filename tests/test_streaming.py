import datetime as dt
import os
import time
from types import SimpleNamespace

import pytest
from conftest import NOON, messages, payload
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loamline.contract import CLEAN_SCHEMA, DEAD_LETTER_SCHEMA, QUARANTINE_SCHEMA
from loamline.operators import gates, monitoring
from loamline.sources.lake import read_lake
from loamline.sources.messages import read_message_files
from loamline.sources.state_table import DeviceStateTable
from loamline.streaming.job import (
    Paths, judged, start_file_sink, start_pipeline, start_router, write_rule_counts,
)
from loamline.streaming.late import recover_late
from loamline.streaming.progress import (
    PROGRESS_SCHEMA, ProgressListener, append_progress, progress_row, progress_table,
)

MINUTE = dt.timedelta(minutes=1)


class Topic:
    """A folder of message files, read one file per micro-batch in the order of writing."""

    def __init__(self, spark, path):
        self.spark, self.path, self.sent, self.files = spark, str(path / "topic"), 0, 0
        self.paths = Paths(str(path / "lake"), str(path / "ckpt"))

    def send(self, *texts, ingested=NOON):
        frame = messages(self.spark, list(texts), ingested, self.sent)
        self.sent += len(texts)
        frame.coalesce(1).write.mode("append").parquet(self.path)
        self.files += 1
        newest = max((os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".parquet")),
                     key=os.path.getctime)
        stamp = time.time() - 1000 + self.files
        os.utime(newest, (stamp, stamp))

    def drain(self, **options):
        source = read_message_files(self.spark, self.path, files_per_trigger=1)
        queries = start_pipeline(source, self.paths, with_state=False, with_monitor=False, every=None, **options)
        for q in queries.values():
            q.awaitTermination()
        return queries

    def clean(self):
        return read_lake(self.spark, self.paths.clean, CLEAN_SCHEMA)

    def quarantine(self):
        return read_lake(self.spark, self.paths.quarantine, QUARANTINE_SCHEMA)


@pytest.fixture
def topic(spark, tmp_path):
    return Topic(spark, tmp_path)


def at(minutes, **changes):
    return payload(ts=(NOON + minutes * MINUTE).isoformat(), **changes)


def test_messages_land_where_they_belong(topic):
    topic.send(at(0), at(0), at(1), at(2, soil_moisture_pct=148.0), "not json")
    topic.drain()
    assert topic.clean().count() == 2
    rules = {r["quality_rule"]: r["raw_value"] for r in topic.quarantine().collect()}
    assert set(rules) == {"range", "unparseable_payload"} and rules["unparseable_payload"] == "not json"


def test_copies_in_different_batches_are_dropped(topic):
    topic.send(at(0), at(1))
    topic.send(at(1), at(2))
    topic.drain()
    topic.send(at(2), at(3))
    topic.drain()                      # a restart goes on from the checkpoint
    assert [r["ts"].minute for r in topic.clean().orderBy("ts").collect()] == [0, 1, 2, 3]


def test_a_record_repeated_endlessly(spark, topic):
    """With salts the copies are dropped in shares first; within a batch, across batches, and late."""
    topic.send(*[at(0)] * 300, at(1))
    topic.send(*[at(0)] * 200, at(60), ingested=NOON + 60 * MINUTE)
    topic.send(at(61), ingested=NOON + 61 * MINUTE)
    topic.send(at(2), at(62), at(62), ingested=NOON + 62 * MINUTE)
    clean = topic.drain(salts=4)["clean"]
    assert [r["ts"].minute for r in topic.clean().orderBy("ts").collect()] == [0, 1, 0, 1, 2]
    batch = max(clean.recentProgress, key=lambda p: p.numInputRows)
    copies = [op.numRowsUpdated for op in batch.stateOperators]
    assert len(copies) == 2 and min(copies) == 2 and max(copies) <= 5


def test_stream_equals_batch_on_ordered_data(spark, topic):
    texts = [at(i // 2, device_id=f"d{i % 3}", soil_moisture_pct=float(i)) for i in range(0, 8)]
    for part in (texts[:3], texts[3:6], texts[6:]):
        topic.send(*part)
    topic.drain()
    batch = gates.clean_records(judged(messages(spark, texts)))
    columns = batch.columns
    assert sorted(topic.clean().select(columns).collect()) == sorted(batch.collect())


def test_late_rows_leave_the_clean_stream_but_are_counted(spark, topic):
    """Ten minutes of watermark, applied one batch later than it is known."""
    hour = 60
    late = at(-30, device_id="late")
    topic.send(at(-20), ingested=NOON)
    topic.send(at(hour), ingested=NOON + hour * MINUTE)
    topic.send(at(hour + 1), ingested=NOON + (hour + 1) * MINUTE)
    topic.send(late, ingested=NOON + (hour + 2) * MINUTE)
    queries = topic.drain()
    assert "late" not in {r["device_id"] for r in topic.clean().collect()}
    log = progress_table(spark, queries.values())
    dropped = {r["query"]: r["sum(dropped_rows)"] for r in log.groupBy("query").sum("dropped_rows").collect()}
    assert dropped == {"clean": 1, "quarantine": 0}
    # The same record is good for the device state, which knows no watermark.
    frame = messages(spark, [late], NOON + (hour + 2) * MINUTE)
    assert gates.passing(judged(frame)).count() == 1


def test_lateness_is_judged_by_the_watermark_of_the_batch_before(spark, topic):
    """A row behind the new watermark still passes in the next batch and is dropped one batch later."""
    topic.send(at(0))
    topic.send(at(60), ingested=NOON + 60 * MINUTE)
    topic.send(at(5), ingested=NOON + 62 * MINUTE)
    topic.send(at(6), ingested=NOON + 63 * MINUTE)
    topic.drain()
    assert [r["ts"].minute + 60 * (r["ts"].hour - 12) for r in topic.clean().orderBy("ts").collect()] == [0, 5, 60]


def test_progress_table(spark, topic, tmp_path):
    topic.send(at(0), at(1))
    topic.send(at(2))
    log = progress_table(spark, topic.drain().values())
    rows = log.filter("query = 'clean' AND input_rows > 0").orderBy("batch_id").collect()
    assert [r["input_rows"] for r in rows] == [2, 1]
    assert rows[1]["watermark"].startswith("2031-03-05T11:51")
    path = str(tmp_path / "progress")
    append_progress(log, path)
    append_progress(log, path)
    assert spark.read.parquet(path).count() == log.count()
    assert {r["query"] for r in monitoring.last_batch_duration(log).collect()} == {"clean", "quarantine"}
    late_clock = dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=3)
    assert monitoring.watermark_drops(log, late_clock).first()[0] == 0


def test_verdicts_are_counted_per_batch(spark, topic):
    """Passing rows with their copies, rejections by rule, for each micro-batch."""
    topic.send(at(0), at(0), at(1, soil_moisture_pct=148.0), "x")
    topic.send(at(0), at(3), at(2, site_id=None))
    log = progress_table(spark, [topic.drain()["clean"]]).filter("input_rows > 0").orderBy("batch_id")
    got = [(r["passing_rows"], r["unparseable_payload_rows"], r["completeness_rows"], r["range_rows"],
            r["plausibility_rows"]) for r in log.collect()]
    assert got == [(2, 1, 0, 1, 0), (2, 0, 1, 0, 0)]


def test_a_batch_adds_few_files_to_a_directory(spark, topic):
    topic.send(*[at(0, device_id=f"d{i}") for i in range(400)])
    topic.drain()
    folder = f"{topic.paths.clean}/site_id=orchard/date=2031-03-05"
    files = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    assert 1 <= len(files) <= 4 and topic.clean().count() == 400


def test_from_raw_messages_to_the_lake(spark, topic):
    """A sound message ends in clean, one without a time is stopped in front, an impossible value is
    let through by the structural check and ends in quarantine."""
    topic.send(at(0), payload(drop=["ts"], device_id="no-time"), at(1, soil_moisture_pct=148.0), "not json")
    for query in start_router(read_message_files(spark, topic.path), topic.paths, every=None).values():
        query.awaitTermination()
    onward = read_message_files(spark, topic.paths.accepted)
    for query in start_pipeline(onward, topic.paths, with_state=False, with_monitor=False, every=None).values():
        query.awaitTermination()
    assert [r["device_id"] for r in topic.clean().collect()] == ["probe-7"]
    assert [r["quality_rule"] for r in topic.quarantine().collect()] == ["range"]
    letters = read_lake(spark, topic.paths.dead_letter, DEAD_LETTER_SCHEMA).collect()
    assert {(r["key"], r["family"]) for r in letters} == {("no-time", "missing_fields"), (None, "invalid_json")}


def test_rates_on_a_stream(spark, topic, tmp_path):
    """The batch report as a stream: windows are emitted once the watermark has passed them."""
    for minute in (0, 1, 30, 60):
        topic.send(at(minute, soil_moisture_pct=148.0), at(minute), ingested=NOON + minute * MINUTE)
    source = read_message_files(spark, topic.path, files_per_trigger=1)
    bad = gates.quarantined_records(judged(source)).withWatermark("kafka_ts", "10 minutes")
    out = str(tmp_path / "rates")
    start_file_sink(monitoring.rule_rate(bad), "rates", out, [], str(tmp_path / "ckpt"),
                    every=None).awaitTermination()
    rows = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r["window_start"].minute, r["quality_rule"], r["n"]) for r in rows] == [(0, "range", 2), (30, "range", 1)]


def test_all_four_queries(spark, topic, monkeypatch):
    """The job with all branches. foreachBatch itself would open a callback port, so a stand-in takes
    the function it is given and the query writes to nowhere; the functions are then called by hand."""
    given = []

    def stand_in(writer, function):
        given.append(function)
        return writer.format("noop")

    monkeypatch.setattr(DataStreamWriter, "foreachBatch", stand_in)
    topic.send(at(0), at(0), at(1, soil_moisture_pct=148.0))
    source = read_message_files(spark, topic.path)
    queries = start_pipeline(source, topic.paths, every=None)
    for query in queries.values():
        query.awaitTermination()
    assert list(queries) == [q.name for q in queries.values()] == [
        "clean", "quarantine", "device-state", "quality-monitor"]
    assert sorted(os.listdir(topic.paths.checkpoints)) == sorted(queries)
    write_state, write_counts = given
    checked = judged(spark.read.parquet(topic.path))
    write_state(gates.passing(checked), 0)
    write_counts(gates.quarantined_records(checked), 0)
    assert DeviceStateTable(spark, topic.paths.state).read().count() == 1
    assert spark.read.parquet(topic.paths.rule_counts).first()["n"] == 1


def plan_of(query, capsys):
    query.explain()
    return capsys.readouterr().out


def test_one_parse_for_all_branches(spark, topic, capsys, monkeypatch):
    """With a staged table only the judging query parses; tables equal those of the job without it."""
    monkeypatch.setattr(DataStreamWriter, "foreachBatch", lambda writer, function: writer.format("noop"))
    topic.send(at(0), at(0), at(1, soil_moisture_pct=148.0), "not json", at(2))
    options = dict(with_monitor=False, every=None)
    source = read_message_files(spark, topic.path)
    staged = start_pipeline(source, topic.paths, staged=True, **options)
    staged.finish()
    assert list(staged) == ["judged", "clean", "quarantine", "device-state"]
    plans = {name: plan_of(query, capsys) for name, query in staged.items()}
    assert {name: plan.count("from_json(") for name, plan in plans.items()} == {
        "judged": 1, "clean": 0, "quarantine": 0, "device-state": 0}
    assert "Exchange" not in plans["judged"] and "raw_value" not in plans["clean"]
    got = [sorted(topic.clean().collect()), sorted(topic.quarantine().collect(), key=str)]
    topic.paths = Paths(topic.paths.lake + "2", topic.paths.checkpoints + "2")
    start_pipeline(source, topic.paths, **options).finish()
    assert got == [sorted(topic.clean().collect()), sorted(topic.quarantine().collect(), key=str)]
    assert len(got[0]) == 2 and len(got[1]) == 2


def test_a_replayed_batch_changes_nothing(spark, topic):
    """A sink that stopped after its files and before its checkpoint is given the same batch again."""
    topic.send(at(0), at(1, soil_moisture_pct=148.0))
    topic.drain(staged=True)
    topic.send(at(2), "x")
    topic.drain(staged=True)
    before = [sorted(topic.clean().collect()), sorted(topic.quarantine().collect(), key=str)]
    for name in ("judged", "clean", "quarantine"):
        commits = f"{topic.paths.checkpoints}/{name}/commits"
        last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
        for file in (last, f".{last}.crc"):
            if os.path.exists(f"{commits}/{file}"):
                os.remove(f"{commits}/{file}")
    topic.drain(staged=True)
    assert before == [sorted(topic.clean().collect()), sorted(topic.quarantine().collect(), key=str)]
    assert [len(rows) for rows in before] == [2, 2]


def test_state_follows_the_judged_table(spark, topic, monkeypatch):
    """Every arrival is one batch; a call without news, and one after a call that died, change nothing."""
    from loamline.plans import jobs
    from loamline.sources.commits import CommitConflict, CommitLog

    def state():
        return {r["device_id"]: r["ts"].minute for r in DeviceStateTable(spark, topic.paths.state).read().collect()}

    topic.send(at(3), at(1, device_id="d2"), at(5, soil_moisture_pct=148.0))
    topic.drain(staged=True)
    assert jobs.update_state(spark, topic.paths, compact_every=2) == 0
    assert jobs.update_state(spark, topic.paths, compact_every=2) is None
    assert state() == {"probe-7": 3, "d2": 1}

    def die(*_):
        raise CommitConflict("died")

    topic.send(at(2), at(4, device_id="d2"))
    topic.drain(staged=True)
    with monkeypatch.context() as patch:
        patch.setattr(CommitLog, "commit", die)
        with pytest.raises(CommitConflict):
            jobs.update_state(spark, topic.paths, compact_every=2)
    topic.send(at(9), ingested=NOON + 9 * MINUTE)
    topic.drain(staged=True)
    assert jobs.update_state(spark, topic.paths, compact_every=2) == 1
    assert state() == {"probe-7": 9, "d2": 4}
    for minute in (10, 11):
        topic.send(at(minute, device_id="d3"), ingested=NOON + 9 * MINUTE)
        topic.drain(staged=True)
        jobs.update_state(spark, topic.paths, compact_every=2)
    assert state() == {"probe-7": 9, "d2": 4, "d3": 11}


def test_branches_are_optional(spark, topic):
    topic.send(at(0))
    assert set(topic.drain()) == {"clean", "quarantine"}


def test_listener_hands_on_one_row_per_batch(spark, topic):
    topic.send(at(0), at(1))
    query = topic.drain()["clean"]
    rows = []
    listener = ProgressListener(rows.append)
    listener.onQueryStarted(None)
    for progress in query.recentProgress:
        listener.onQueryProgress(SimpleNamespace(progress=progress))
    listener.onQueryIdle(None)
    listener.onQueryTerminated(None)
    assert rows == [progress_row(p) for p in query.recentProgress]
    assert spark.createDataFrame(rows, PROGRESS_SCHEMA).agg({"input_rows": "sum"}).first()[0] == 2


def test_a_hand_made_file_is_hidden_from_the_sink_folder(spark, topic):
    """Why backfills go to a folder of their own."""
    topic.send(at(0))
    topic.drain()
    stray = f"{topic.paths.clean}/site_id=orchard/date=2031-03-05"
    spark.range(1).selectExpr("'x' AS device_id").write.mode("append").parquet(stray)
    assert topic.clean().count() == 1


def test_rule_counts_are_not_added_twice(spark, tmp_path):
    """The function foreachBatch calls, with a batch that is delivered again."""
    path = str(tmp_path / "counts")
    bad = gates.quarantined_records(judged(messages(spark, ["x", "y", at(0, soil_moisture_pct=148.0)])))
    write = write_rule_counts(path)
    write(bad, 0)
    write(bad, 0)
    write(bad, 1)
    counted = {(r["batch_id"], r["quality_rule"]): r["n"] for r in spark.read.parquet(path).collect()}
    assert counted == {(b, k): n for b in ("0", "1") for k, n in (("range", 1), ("unparseable_payload", 2))}


def test_passing_rows_are_counted_with_their_copies(spark):
    frame = judged(messages(spark, [at(0), at(0), at(1, soil_moisture_pct=148.0)]))
    assert gates.passing(frame).count() == 2
    assert gates.clean_records(frame).count() == 1


def test_every_branch_has_its_own_checkpoint(topic):
    topic.send(at(0))
    queries = topic.drain()
    assert set(queries) == {"clean", "quarantine"}
    assert sorted(os.listdir(topic.paths.checkpoints)) == ["clean", "quarantine"]


def test_state_table_takes_batches_of_a_stream(spark, tmp_path):
    table = DeviceStateTable(spark, str(tmp_path / "s"))
    for number, minute in enumerate((5, 1, 9)):
        table.apply(gates.passing(judged(messages(spark, [at(minute)], NOON + 10 * MINUTE, number))), number)
    assert table.read().first()["ts"] == (NOON + 9 * MINUTE).replace(tzinfo=None)


def test_late_records_are_recovered(spark, topic):
    """Six arrivals; what the watermark drops is found again, once, and the job's log counted it. A batch
    drops by the watermark of the batch before it, so the third still takes its old records."""
    sent = [[at(0), at(5)], [at(90), at(60)], [at(1), at(1)], [at(200), at(0)], [at(30)],
            [at(6, device_id="late-too"), at(31)]]
    for number, texts in enumerate(sent):
        topic.send(*texts, ingested=NOON + (number * 90 + 95) * MINUTE)
    topic.drain().finish()
    log = read_lake(spark, topic.paths.progress, PROGRESS_SCHEMA)
    assert monitoring.watermark_drops(log).first()["dropped_rows"] == 4
    assert {r["query"]: r["n"] for r in log.groupBy("query").agg(F.sum("input_rows").alias("n")).collect()} == {
        "clean": 11, "quarantine": 11}
    accepted = spark.read.parquet(topic.path)
    day = NOON.date()
    for _ in range(2):
        late = recover_late(spark, accepted, topic.paths, day, day + dt.timedelta(days=1))
        assert sorted((r["device_id"], r["ts"].minute) for r in late.collect()) == [
            ("late-too", 6), ("probe-7", 30), ("probe-7", 31)]
    both = topic.clean().unionByName(late).select("device_id", "ts")
    whole = gates.clean_records(judged(accepted)).select("device_id", "ts")
    assert sorted(both.collect()) == sorted(whole.collect())
    assert recover_late(spark, accepted, topic.paths, day - dt.timedelta(days=9)).count() == 3


def test_a_failing_log_says_so(spark, topic, monkeypatch):
    from loamline.streaming import progress

    def refuse(*_):
        raise OSError("disk")

    monkeypatch.setattr(progress, "append_progress", refuse)
    topic.send(at(0))
    with pytest.raises(OSError, match="disk"):
        topic.drain().finish()
    assert topic.clean().count() == 1
