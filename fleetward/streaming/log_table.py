"""A table with one row per key, kept as a log of runs.

Every batch writes its own rows as a new run and nothing else.  Which runs make up the table stands in a manifest; a new
version of it is written beside and renamed to its place, which fails if that version exists, so a commit happens whole
or not at all.  Readers take the newest manifest and keep the first or latest row of every key over its runs.  As soon as
a tier has ``FAN`` runs they are merged into one run of the next, so a row is rewritten once per tier, and tiers grow
with the logarithm of the table.  A run has as many files as its rows ask for, without a limit.

Runs that a manifest no longer names are deleted one commit later, so a reader of the version before still finds them.
What a lost driver leaves behind without a manifest is never read; a batch that is repeated after its commit is skipped.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a tier that are merged, and rows of a file.
FAN, FILE_ROWS = 4, 1_000_000


def one_per_key(rows: DataFrame, keys: list[str], latest: bool) -> DataFrame:
    """The first or the latest row per key by (ts, event_id); combined map-side."""
    rest = [c for c in rows.columns if c not in (*keys, "ts", "event_id")]
    pick = F.max if latest else F.min
    return rows.groupBy(*keys).agg(pick(F.struct("ts", "event_id", *rest)).alias("r")).select(*keys, "r.*")


class Files:
    """The few file operations that a commit needs, in whatever file system the path names."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        fs, path = self._fs(folder), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self._fs(path).create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        """Fails if there is a file at the new place."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.NONE
        uri = self._fs(new).makeQualified(self._path(new)).toUri()
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.conf).rename(self._path(old), self._path(new), options)

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)


class LogTable:
    """One row per key of ``rows``' shape, the first or the latest by (ts, event_id)."""

    def __init__(self, spark: SparkSession, path: str, rows: DataFrame, keys: list[str], latest: bool) -> None:
        self.spark, self.path, self.keys, self.latest = spark, path, keys, latest
        self.columns = [*keys, "ts", "event_id", *[c for c in rows.columns if c not in (*keys, "ts", "event_id")]]
        self.schema = rows.select(*self.columns).schema
        self.files = Files(spark)

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        names = self.files.names(f"{self.path}/manifests")
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self) -> dict:
        newest = self.version()
        if not newest:
            return {"version": 0, "batch": -1, "runs": [], "gone": []}
        return json.loads(self.files.read(f"{self.path}/manifests/{newest:012d}.json"))

    def read(self) -> DataFrame:
        runs = [r["path"] for r in self.manifest()["runs"]]
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        rows = self._rows(runs)
        return rows if len(runs) == 1 else one_per_key(rows, self.keys, self.latest)

    def merge(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Add a batch; one that has been committed is skipped, so a repeated batch leaves the table as it is."""
        at = self.manifest()
        if batch_id is not None and batch_id <= at["batch"]:
            return
        run = self._write(one_per_key(batch.select(*self.columns), self.keys, self.latest), 0)
        runs = [*at["runs"], run] if run["rows"] else at["runs"]
        at = self._commit(at, runs, at["batch"] if batch_id is None else batch_id)
        while full := self._full(at["runs"]):
            merged = one_per_key(self._rows([r["path"] for r in full]), self.keys, self.latest)
            files = 1 + sum(r["rows"] for r in full) // FILE_ROWS
            new = self._write(merged.repartition(files, *self.keys), full[0]["tier"] + 1)
            at = self._commit(at, [new, *(r for r in at["runs"] if r not in full)], at["batch"])

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _full(self, runs: list[dict]) -> list[dict]:
        """The runs of the lowest tier that has ``FAN`` of them."""
        for tier in sorted({r["tier"] for r in runs}):
            if len(of := [r for r in runs if r["tier"] == tier]) >= FAN:
                return of
        return []

    def _write(self, rows: DataFrame, tier: int) -> dict:
        path = f"{self.path}/runs/{uuid.uuid4().hex}"
        rows.select(*self.columns).write.parquet(path)
        return {"path": path, "tier": tier, "rows": self._rows([path]).count()}  # from the files' footers

    def _commit(self, at: dict, runs: list[dict], batch: int) -> dict:
        kept = {r["path"] for r in runs}
        new = {"version": at["version"] + 1, "batch": batch, "runs": runs, "gone": [r["path"] for r in at["runs"] if r["path"] not in kept]}
        place = f"{self.path}/manifests/{new['version']:012d}"
        beside = f"{place}.{uuid.uuid4().hex}.tmp"
        self.files.write(beside, json.dumps(new))
        self.files.rename(beside, f"{place}.json")
        for path in at["gone"]:  # named by neither this version nor the one before
            self.files.delete(path)
        if at["version"] > 1:
            self.files.delete(f"{self.path}/manifests/{at['version'] - 1:012d}.json")
        return new
