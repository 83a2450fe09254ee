"""Streams batch by batch: what is emitted when, what is held, and what a lost driver leaves behind."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetward.streaming import log_table, streams
from fleetward.streaming.log_table import LogTable

START = datetime(2024, 1, 1)
FINDING = "target_id long, ident string, ts timestamp, event_id long, severity string"


class Source:
    """A folder of files, one a batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        self.n = 0

    def add(self, rows):
        path = f"{self.folder}/source/part={self.n}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(path)
        self.n += 1

    def stream(self):
        schema = self.spark.createDataFrame([], self.schema).schema
        return streams.open_stream(self.spark, f"{self.folder}/source/*", "*.parquet", schema, files_per_trigger=1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def finish(*queries):
    streams._run(*queries)


# ---- emitted once -----------------------------------------------------------


def test_findings_are_emitted_once_and_never_replaced(spark, tmp_path):
    source = Source(spark, tmp_path, FINDING)
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    batches = [
        [(1, "a", at(5), 5, "low"), (1, "a", at(4), 4, "high"), (2, "a", at(9), 9, "low")],
        [(1, "a", at(1), 1, "critical"), (1, "b", at(7), 7, "low"), (1, "b", at(7), 6, "info")],  # an earlier event that arrives late
        [(1, "a", at(20), 20, "low"), (1, "b", at(0), 0, "low")],
    ]
    for rows in batches[:2]:
        source.add(rows)
        finish(streams.write_batches(streams.emit_once(source.stream(), ["target_id", "ident"]), out, checkpoint))
    source.add(batches[2])  # goes on from its checkpoint
    finish(streams.write_batches(streams.emit_once(source.stream(), ["target_id", "ident"]), out, checkpoint))
    got = sorted((r.batch, r.target_id, r.ident, r.event_id, r.severity) for r in streams.read_batches(spark, out).collect())
    assert got == [(0, 1, "a", 4, "high"), (0, 2, "a", 9, "low"), (1, 1, "b", 6, "info")]


# ---- progress ---------------------------------------------------------------


def test_progress_is_emitted_after_every_batch(spark, tmp_path):
    source = Source(spark, tmp_path, "target_id long, rule_id string, category string, ts timestamp, event_id long")
    out = f"{tmp_path}/out"
    source.add([(1, "A", "auth", at(1), 1), (1, "A", "auth", at(2), 2), (2, "B", "xss", at(3), 3)])
    source.add([(1, "B", "xss", at(4), 4)])
    source.add([(1, "A", "auth", at(5), 5), (1, "unknown", "other", at(9), 9), (1, "C", "csrf", at(24 * 60), 10)])
    finish(streams.write_batches(streams.progress(source.stream(), ["A", "B", "C"]), out, f"{tmp_path}/checkpoint"))
    rows = streams.read_batches(spark, out)
    got = sorted((r.batch, r.target_id, r.scan, r.done, r.total, r.phase) for r in rows.collect())
    assert got == [
        (0, 1, 1, 1, 3, "auth"), (0, 2, 1, 1, 3, "xss"),
        (1, 1, 1, 2, 3, "xss"),
        (2, 1, 1, 2, 3, "xss"), (2, 1, 2, 1, 3, "csrf"),
    ]
    last = sorted(tuple(r) for r in streams.last_progress(rows).collect())
    assert last == [(1, 1, 2, 3, "xss"), (1, 2, 1, 3, "csrf"), (2, 1, 1, 3, "xss")]


# ---- held dependencies ------------------------------------------------------

HELD = "target_id long, kind string, event_id long, pkg string"


def test_rows_leave_when_their_scan_ends(spark, tmp_path):
    source = Source(spark, tmp_path, HELD)
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def run():
        released = streams.release_dependencies(source.stream())
        finish(streams.with_state_on_disk(spark, lambda: streams.write_append(released, out, checkpoint)))
        return sorted((r.target_id, r.event_id, r.pkg) for r in spark.read.schema(released.schema).parquet(out).collect())

    source.add([(1, "native", 1, "a"), (1, "native", 2, "b"), (2, "native", 3, "a"), (3, "native", 4, "z")])
    assert run() == []  # all scans are open
    source.add([(1, "engine", None, "a"), (1, "native", 5, "c"), (1, "ended", None, None)])
    assert run() == [(1, 2, "b"), (1, 5, "c")]  # while the scans of 2 and 3 go on
    source.add([(2, "engine", None, "q"), (3, "ended", None, None), (1, "native", 6, "a")])
    assert run() == [(1, 2, "b"), (1, 5, "c"), (3, 4, "z")]
    source.add([(2, "native", 7, "q"), (2, "ended", None, None), (1, "ended", None, None)])
    # the next scan of 1 knows nothing of the engine's findings of the first
    assert run() == [(1, 2, "b"), (1, 5, "c"), (1, 6, "a"), (2, 3, "a"), (3, 4, "z")]


def test_held_rows_equal_the_batch_version(spark, tmp_path):
    rnd = random.Random(2)
    source = Source(spark, tmp_path, HELD)
    rows = [(rnd.choice([1, 1, 1, rnd.randint(2, 9)]), rnd.choice(["native", "engine"]), i, f"p{rnd.randint(0, 60)}") for i in range(300)]
    for k in range(3):
        source.add(rows[k::3])
    source.add([(t, "ended", None, None) for t in range(1, 10)])
    released = streams.release_dependencies(source.stream())
    finish(streams.with_state_on_disk(spark, lambda: streams.write_append(released, f"{tmp_path}/out", f"{tmp_path}/checkpoint")))
    engine = {(t, p) for t, kind, _, p in rows if kind == "engine"}
    want = sorted((t, i, p) for t, kind, i, p in rows if kind == "native" and (t, p) not in engine)
    got = spark.read.schema(released.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.target_id, r.event_id, r.pkg) for r in got) == want


# ---- the log of runs --------------------------------------------------------

ROW = "target_id long, finding_id string, ts timestamp, event_id long, severity string"


def made(spark, tmp_path, latest=True):
    return LogTable(spark, f"{tmp_path}/table", spark.createDataFrame([], ROW), ["target_id", "finding_id"], latest)


def batch(spark, k, n=40):
    rnd = random.Random(k)
    rows = [(rnd.randint(0, 9), f"f{rnd.randint(0, 5)}", at(rnd.randint(0, 999)), 1000 * k + i, rnd.choice("abc")) for i in range(n)]
    return spark.createDataFrame(rows, ROW), rows


def kept(rows, latest=True):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3]), reverse=not latest):
        out[r[:2]] = r
    return sorted(out.values())


def content(table):
    return sorted(tuple(r) for r in table.read().collect())


@pytest.mark.parametrize("latest", [True, False])
def test_one_row_per_key_over_many_batches(spark, tmp_path, latest):
    table, rows = made(spark, tmp_path, latest), []
    assert content(table) == []
    for k in range(11):
        df, more = batch(spark, k)
        rows += more
        table.merge(df, k)
        tiers = [r["tier"] for r in table.manifest()["runs"]]
        assert max(tiers.count(t) for t in tiers) < log_table.FAN  # compacted
    assert content(table) == kept(rows, latest)
    table.merge(df, 10)  # repeated
    table.merge(df, 3)
    assert content(table) == kept(rows, latest) and table.manifest()["batch"] == 10


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    table = made(spark, tmp_path)
    table.merge(batch(spark, 0, 2000)[0], 0)
    before = {r["path"] for r in table.manifest()["runs"]}
    table.merge(batch(spark, 1, 3)[0], 1)
    new = [r for r in table.manifest()["runs"] if r["path"] not in before]
    assert before < {r["path"] for r in table.manifest()["runs"]} and len(new) == 1 and new[0]["rows"] <= 3


class Lost(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "rename", "delete"])
@pytest.mark.parametrize("nth", [0, 1])
def test_a_driver_lost_in_mid_commit_loses_nothing(spark, tmp_path, step, nth):
    """The driver is lost in the ``nth`` such step of a batch that also compacts; the batch is repeated."""
    table, rows = made(spark, tmp_path), []
    for k in range(log_table.FAN - 1):
        df, more = batch(spark, k)
        rows += more
        table.merge(df, k)
    old = kept(rows)
    df, more = batch(spark, 77)
    real, calls = getattr(table.files, step), []

    def lost(*args):
        calls.append(args)
        if len(calls) == nth + 1:
            raise Lost
        return real(*args)

    setattr(table.files, step, lost)
    try:
        table.merge(df, log_table.FAN - 1)
    except Lost:
        pass
    fresh = made(spark, tmp_path)
    assert content(fresh) in (old, kept(rows + more))  # whole or not at all
    fresh.merge(df, log_table.FAN - 1)
    assert content(fresh) == kept(rows + more)
    df, last = batch(spark, 78)
    fresh.merge(df, log_table.FAN)
    assert content(fresh) == kept(rows + more + last)


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = made(spark, tmp_path), made(spark, tmp_path)
    df, rows = batch(spark, 1)
    seen = b.manifest()
    a.merge(df, 0)
    with pytest.raises(Exception, match="exist"):
        b._commit(seen, [], 0)
    assert content(b) == kept(rows)


def test_readers_of_the_version_before_find_their_runs(spark, tmp_path):
    table, rows = made(spark, tmp_path), []
    for k in range(log_table.FAN - 1):
        df, more = batch(spark, k)
        rows += more
        table.merge(df, k)
    reader = table.read()  # planned before the compaction
    table.merge(batch(spark, 9)[0], log_table.FAN - 1)
    assert sorted(tuple(r) for r in reader.collect()) == kept(rows)


def test_files_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_table, "FILE_ROWS", 10)
    table = made(spark, tmp_path)
    rows = [(i, "f", at(i), i, "a") for i in range(900)]
    for k in range(log_table.FAN):
        table.merge(spark.createDataFrame(rows[k :: log_table.FAN], ROW), k)
    assert len(table.manifest()["runs"]) == 1 and len(table.read().inputFiles()) > 32
    assert content(table) == rows


def test_stream_into_the_log(spark, tmp_path):
    source, rows = Source(spark, tmp_path, ROW), []
    table = made(spark, tmp_path)
    for k in range(3):
        more = batch(spark, k)[1]
        rows += more
        source.add(more)
    finish(streams.merge_stream(source.stream(), table, f"{tmp_path}/checkpoint"))
    assert content(table) == kept(rows)
    assert table.read().where(F.col("target_id") == 3).count() == len([r for r in kept(rows) if r[0] == 3])


class ListOnDisk:
    def __init__(self):
        self.rows, self.calls = [], []

    def appendList(self, rows):
        self.calls.append("append")
        self.rows += rows

    def get(self):
        self.calls.append("get")
        return iter(list(self.rows))

    def clear(self):
        self.calls.append("clear")
        self.rows = []


@pytest.mark.parametrize("chunk", [2, 10_000])
def test_a_key_costs_one_write_a_batch(monkeypatch, chunk):
    monkeypatch.setattr(streams, "_CHUNK", chunk)
    state = ListOnDisk()
    holder = streams.HoldDependencies()
    holder.held = state

    def batch(*rows):
        made = [Row(target_id=1, kind=k, event_id=e, pkg=p) for k, e, p in rows]
        return sorted((r.event_id, r.pkg) for r in holder.handleInputRows((1, 0), iter(made), None))

    assert batch(("native", 1, "a"), ("engine", 2, "b"), ("native", 3, "b"), ("native", 4, "c"), ("engine", 5, "b")) == []
    assert state.calls == ["append"] * (1 if chunk > 5 else len(state.calls))
    assert batch(("native", 6, None), ("ended", None, None), ("engine", 7, "c")) == [(1, "a"), (6, None)]
    assert state.rows == [] and state.calls.count("get") <= 2
    state.calls.clear()
    assert batch(("ended", None, None), ("native", 8, "b")) == [(8, "b")] and state.calls == ["get"]


def test_rows_without_a_target_leave_the_others_alone(spark, tmp_path):
    source = Source(spark, tmp_path, HELD)
    rows = [(t, kind, 10 * (t or 0) + i, f"p{i}") for t in (None, 1, 2, 3, 4, 5) for i, kind in enumerate(["native", "native", "engine", "native"])]
    source.add(rows)
    source.add([(t, "ended", None, None) for t in range(1, 6)])
    released = streams.release_dependencies(source.stream())
    finish(streams.with_state_on_disk(spark, lambda: streams.write_append(released, f"{tmp_path}/out", f"{tmp_path}/checkpoint")))
    got = spark.read.schema(released.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.target_id, r.event_id, r.pkg) for r in got) == [(t, 10 * t + i, f"p{i}") for t in range(1, 6) for i in (0, 1, 3)]
