"""Finding streams with Structured Streaming.

Streams read files, so a run over stored events uses ``availableNow`` and ends by itself.  What a stream has seen is in
its state, or in a log of runs (``log_table``); nothing is forgotten after a time.  Batches are written under their
number, so a lost executor or a restart repeats a batch instead of losing or doubling rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.identity import dedupe_key, finding_id
from ..operators.pipeline import contextualize, downrank_public_cors, drop_static_rate_limits, identity
from ..plans.staging import Run, staging_path
from ..sources import corpus
from .log_table import LogTable


def open_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; ``files_per_trigger`` bounds a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


# ---- sinks ------------------------------------------------------------------


def merge_stream(stream: DataFrame, table: LogTable, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(table.merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_batches(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What a query in update mode emits after each batch, in a folder of the batch's number, which a repetition replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches' rows, with ``batch``."""
    return spark.read.option("basePath", path).parquet(path).withColumn("batch", F.col("batch").cast("long"))


def write_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a file table; the sink's log makes each batch land exactly once."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


# ---- what streams carry -----------------------------------------------------


def emit_findings(rows: DataFrame) -> DataFrame:
    """Findings after suppression and path context, with the identity that equal ones share."""
    shaped = rows.withColumn("evidence", F.lit(None).cast("string"))
    settled = contextualize(downrank_public_cors(drop_static_rate_limits(shaped)))
    return settled.withColumn("ident", identity())


def emit_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of every key the row that arrives first, when it arrives, and no other afterwards; of one batch the first by (ts, event_id).

    For a query in update mode.  The state holds, per key, the least (batch time, ts, event_id) with its row, and partial
    minima combine before the shuffle, so copies of one hot finding cost one row per task.  A batch touches the state of
    every key it holds; only those that it has set itself are emitted.
    """
    rest = [c for c in rows.columns if c not in (*keys, "ts", "event_id")]
    # the time of the batch is kept in its offsets, so a repeated batch has the same
    timed = rows.withColumn("seen", F.current_timestamp())
    first = F.min(F.struct("seen", "ts", "event_id", *rest)).alias("first")
    return timed.groupBy(*keys).agg(first).where(F.col("first.seen") == F.current_timestamp()).select(*keys, "first.*").drop("seen")


def progress(rows: DataFrame, rules: list[str]) -> DataFrame:
    """Rules of ``rules`` done per scan of a target and day, of how many, and the category of the last one.

    A rule is done with its first finding event.  In update mode a stream emits the sums so far of every scan that a
    batch touches; the state of a scan is one value per registered rule.
    """
    at = F.struct("ts", "event_id", "category")
    done = [F.min(F.when(F.col("rule_id") == rule, at)).alias(f"rule{i}") for i, rule in enumerate(rules)]
    scans = rows.groupBy("target_id", F.dayofyear("ts").alias("scan")).agg(*done)
    finished = F.filter(F.array(*[F.col(f"rule{i}") for i in range(len(rules))]), lambda r: r.isNotNull())
    return scans.select(
        "target_id",
        "scan",
        F.size(finished).alias("done"),
        F.lit(len(rules)).alias("total"),
        F.array_max(finished)["category"].alias("phase"),
    )


def with_finding_id(df: DataFrame) -> DataFrame:
    key = dedupe_key(F.col("rule_id"), F.col("file"), F.col("line"), F.col("url"))
    return df.withColumn("finding_id", finding_id(key))


#: Parts of a target's held rows; its packages are dealt over them.
PARTS = 4
#: Rows of a key that a task holds in memory at a time.
_CHUNK = 10_000


class HoldDependencies(StatefulProcessor):
    """Holds a target's native rows until its scan has ended; then those leave that no engine finding supersedes.

    Native rows and the engine's packages are appended to one list in the state store, so a batch costs a key one write,
    and none rewrites or reads what is held.  It is read at the end, up to ``_CHUNK`` rows at a time.  Most keys have few
    rows, hence plain rows: a data frame for each would cost more than the work.
    """

    def init(self, handle) -> None:
        self.held = handle.getListState("held", "native boolean, event_id long, pkg string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ended, new, reported = False, [], set()
        for row in rows:
            if row.kind == "ended":
                ended = True
            elif row.kind == "native":
                new.append((True, row.event_id, row.pkg))
            elif row.kind == "engine" and row.pkg not in reported:
                reported.add(row.pkg)
                new.append((False, None, row.pkg))
            if len(new) >= _CHUNK:
                self.held.appendList(new)
                new, reported = [], set()
        if not ended:
            if new:
                self.held.appendList(new)
            return
        stored = self.held.get()
        head = list(islice(stored, _CHUNK))
        superseded = {pkg for native, _, pkg in chain(new, head, stored) if not native}
        again = head if len(head) < _CHUNK else self.held.get()
        for native, event_id, pkg in chain(again, new):
            if native and pkg not in superseded:
                yield Row(event_id=event_id, target_id=key[0], pkg=pkg)
        if head:
            self.held.clear()

    def close(self) -> None:
        pass


def release_dependencies(rows: DataFrame) -> DataFrame:
    """Stream of ``target_id, kind, event_id, pkg`` to the native rows that are released, each when its target's scan ends.

    ``kind`` is ``native``, ``engine`` or ``ended``.  A target's packages are dealt over ``PARTS`` keys, each of which
    hears of the end, so that a target with a third of all rows is held by several tasks.
    """
    everywhere = F.sequence(F.lit(0), F.lit(PARTS - 1))
    own = F.array(F.pmod(F.xxhash64("pkg"), F.lit(PARTS)).cast("int"))
    dealt = rows.withColumn("part", F.explode(F.when(F.col("kind") == "ended", everywhere).otherwise(own)))
    return dealt.groupBy("target_id", "part").transformWithState(
        statefulProcessor=HoldDependencies(), outputStructType="event_id long, target_id long, pkg string", outputMode="Append", timeMode="None"
    )


def with_state_on_disk(spark: SparkSession, start) -> StreamingQuery:
    """Start a query whose state is larger than memory; the setting counts for this query only."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start()
    finally:
        spark.conf.set(name, before)


# ---- runs over the stored events --------------------------------------------


def _raw_events(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return open_stream(spark, sf_dir, "events.parquet", schema, files_per_trigger)


def _run(*queries: StreamingQuery) -> None:
    for query in queries:
        query.awaitTermination()
        if query.exception():
            raise query.exception()


def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding once, as it first arrived, when it arrived."""
    out = staging_path(spark, "stream-findings")
    columns = ["target_id", "ident", "event_id", "rule_id", "category", "severity", "confidence", "file", "line", "url", "source"]
    found = emit_findings(corpus.finding_events(_raw_events(spark, sf_dir)))
    _run(write_batches(emit_once(found, ["target_id", "ident"]).select(*columns), f"{out}/table", f"{out}/checkpoint"))
    return read_batches(spark, f"{out}/table").select(*columns)


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every scan at the end; the table also holds what was emitted before."""
    out = staging_path(spark, "stream-progress")
    events = corpus.finding_events(_raw_events(spark, sf_dir))
    _run(write_batches(progress(events, [r[1] for r in corpus.EVENT_RULES]), f"{out}/table", f"{out}/checkpoint"))
    return last_progress(read_batches(spark, f"{out}/table"))


def last_progress(batches: DataFrame) -> DataFrame:
    """The latest row of every scan."""
    last = batches.groupBy("target_id", "scan").agg(F.max(F.struct("batch", "done", "total", "phase")).alias("r"))
    return last.select("target_id", "scan", "r.done", "r.total", "r.phase")


def run_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of every finding."""
    out = staging_path(spark, "stream-upsert")
    stream = with_finding_id(corpus.finding_events(_raw_events(spark, sf_dir)))
    table = LogTable(spark, f"{out}/table", stream, ["target_id", "finding_id"], True)
    _run(merge_stream(stream, table, f"{out}/checkpoint"))
    return table.read().select("target_id", "finding_id", "event_id", "rule_id", "severity", "file", "line")


#: Files of the paced source.
SLICES = 4


def run_backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number of rows of their batch, when a trigger may take one file: the sink sets the pace."""
    out = staging_path(spark, "stream-paced")
    parts = f"{out}/source"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("slice", F.col("event_id") % SLICES).repartition("slice").write.partitionBy("slice").parquet(parts)
    schema = spark.read.parquet(parts).schema
    rows = corpus.finding_events(open_stream(spark, parts, "*.parquet", schema, files_per_trigger=1))

    def write(batch: DataFrame, batch_id: int) -> None:
        run = Run(spark, "paced")
        staged = run.stage(batch.select("event_id", "target_id", "rule_id"), "batch")
        counted = staged.withColumn("batch_rows", F.lit(staged.count()).cast("long"))
        counted.write.mode("overwrite").parquet(f"{out}/table/batch={batch_id}")
        run.drop()

    _run(
        rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    return spark.read.option("basePath", f"{out}/table").parquet(f"{out}/table").drop("batch")


def dependency_events(events: DataFrame) -> DataFrame:
    """Purchases as native findings and errors as engine findings of a package, each target's last event followed by its scan's end.

    ``slice`` numbers the quarters of the month, in which the stream hears of them.
    """
    quarter = F.floor((F.dayofmonth("ts") - 1) * SLICES / 31).cast("int")
    kind = F.when(F.col("event_type") == "purchase", "native").when(F.col("event_type") == "error", "engine")
    pkg = F.concat(F.lit("pkg"), (F.col("event_id") % 11).cast("string"))
    target = F.col("user_id").alias("target_id")
    found = events.select(target, kind.alias("kind"), "event_id", pkg.alias("pkg"), quarter.alias("slice")).where("kind is not null")
    ended = events.groupBy(target).agg(F.max(quarter).alias("slice")).select(
        "target_id", F.lit("ended").alias("kind"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("pkg"), "slice"
    )
    return found.unionByName(ended)


def run_deps_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native findings held per target and released when its scan ends, one quarter of the month a batch."""
    out = staging_path(spark, "stream-deps")
    rows = dependency_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    rows.repartition("slice").sortWithinPartitions("slice").write.partitionBy("slice").parquet(f"{out}/source")
    stream = open_stream(spark, f"{out}/source", "*.parquet", rows.schema, files_per_trigger=1).drop("slice")
    released = release_dependencies(stream)
    _run(with_state_on_disk(spark, lambda: write_append(released, f"{out}/table", f"{out}/checkpoint")))
    return spark.read.schema(released.schema).parquet(f"{out}/table").select("event_id", "target_id", "pkg")
