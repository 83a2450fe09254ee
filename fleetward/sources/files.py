"""Source files of many repositories as one table ``files(target_id, path, content)``."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import lists
from ..functions import paths
from ..plans.staging import materialize

_MANIFEST_SCHEMA = "struct<dependencies:map<string,string>,devDependencies:map<string,string>,_broken:string>"


def size_cap(content: Column) -> Column:
    """Content of files below the size limit, else NULL."""
    return F.when(F.octet_length(content) < lists.MAX_FILE_BYTES, content)


_LISTED = "target_id bigint, root string, path string, n_bytes bigint, folder boolean"
_READ = "target_id bigint, path string, n_bytes bigint, content string"
_BATCH_BYTES = 16 * 1024 * 1024
_BATCH_NAMES = 10_000
#: Names below a folder that a task lists before it hands the folders that are left to other tasks.
_FRONTIER_NAMES = 10_000


def _tasks(batch_names: int, batch_bytes: int, frontier_names: int):
    """(list, read) functions for tasks.

    They are closures over plain values, so workers need Arrow and pandas but not
    this package.
    """

    def opened(root: str):
        if "://" in root:
            return fs.FileSystem.from_uri(root)
        return fs.LocalFileSystem(), root.rstrip("/")

    def list_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Names and sizes only, dotfiles included, no links.  Folders that are left are rows, too.
        columns = ["target_id", "root", "path", "n_bytes", "folder"]
        for batch in batches:
            for target_id, root, start in zip(batch["target_id"], batch["root"], batch["path"]):
                store, base = opened(root)
                folders, rows, listed = deque([start]), [], 0
                local = isinstance(store, fs.LocalFileSystem)
                while folders and listed < frontier_names:
                    folder = folders.popleft()
                    for info in store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
                        path = info.path[len(base) :].lstrip("/")
                        listed += 1
                        if local and os.path.islink(info.path):
                            continue
                        if info.type == fs.FileType.Directory:
                            folders.append(path)
                        elif info.type == fs.FileType.File:
                            rows.append((target_id, root, path, info.size, False))
                        if len(rows) >= batch_names:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                rows += [(target_id, root, path, 0, True) for path in folders]
                yield pd.DataFrame(rows, columns=columns)

    def read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A bounded number of bytes at a time.
        columns = ["target_id", "path", "n_bytes", "content"]
        rows, held = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                store, base = opened(r.root)
                with store.open_input_stream(f"{base}/{r.path}") as stream:
                    text = stream.read().decode("utf-8", errors="replace")
                held += r.n_bytes
                rows.append((r.target_id, r.path, r.n_bytes, text))
                if held >= batch_bytes:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return list_files, read_files


def list_repositories(roots: DataFrame, partitions: int | None = None) -> DataFrame:
    """``target_id, root, path, n_bytes`` of all regular files below ``roots(target_id, root)``.

    Folders are listed round by round: a task lists what is below a folder up to ``_FRONTIER_NAMES`` names, and the
    folders that are left are dealt to all tasks of the next round.  A small repository takes one round, a large one is
    spread over the cluster, and a lost executor repeats its part of a round.
    """
    spark = roots.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    list_files, _ = _tasks(_BATCH_NAMES, _BATCH_BYTES, _FRONTIER_NAMES)
    frontier = roots.select("target_id", "root", F.lit("").alias("path"))
    found = None
    while found is None or not frontier.isEmpty():
        listed = materialize(frontier.repartition(n).mapInPandas(list_files, _LISTED), "listed")
        files = listed.where(~F.col("folder")).drop("folder")
        found = files if found is None else found.unionByName(files)
        frontier = listed.where("folder").select("target_id", "root", "path")
    return found


def read_repositories(roots: DataFrame, partitions: int | None = None) -> DataFrame:
    """All regular files below ``roots(target_id, root)`` in storage every executor sees.

    Spark's own file sources leave out names that start with a dot, which matter
    here, so tasks list and read through Arrow.  Listing moves names only; the names
    are then spread over all tasks, so one huge repository is listed and read by many of them.
    Bytes that are not valid UTF-8 become replacement characters.
    """
    n = partitions or int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _, read_files = _tasks(_BATCH_NAMES, _BATCH_BYTES, _FRONTIER_NAMES)
    return list_repositories(roots, n).repartition(n, "target_id", "path").mapInPandas(read_files, _READ)


def read_directory(spark: SparkSession, root: str, target_id: int = 0) -> DataFrame:
    """The files of one repository."""
    roots = spark.createDataFrame([(target_id, root)], "target_id bigint, root string")
    return read_repositories(roots)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored ``files`` table in any columnar layout Spark reads by default."""
    return spark.read.load(path).select("target_id", "path", "content")


def scannable(files: DataFrame) -> DataFrame:
    """Drop ignored paths; files of every size are scanned."""
    return files.where(~paths.is_ignored(F.col("path")))


def with_kinds(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return files.select(
        "*",
        paths.is_sql(p).alias("is_sql"),
        paths.is_env(p).alias("is_env"),
        paths.is_lockfile(p).alias("is_lockfile"),
        paths.is_source(p).alias("is_source"),
        paths.is_code_or_config(p).alias("is_code_or_config"),
    )


def pick_manifest(files: DataFrame) -> DataFrame:
    """One manifest per target: the root one, else the first by path."""
    p = F.col("path")
    return (
        files.where(paths.is_manifest(p))
        .groupBy("target_id")
        .agg(F.min_by(F.struct("path", "content"), F.struct(p != "package.json", p)).alias("m"))
        .select("target_id", "m.path", "m.content")
    )


def manifests(files: DataFrame) -> DataFrame:
    """``target_id, path, deps`` of the picked manifests that parse; dev entries win."""
    parsed = F.from_json(
        "content", _MANIFEST_SCHEMA, {"columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false"}
    )
    empty = F.create_map().cast("map<string,string>")
    return (
        pick_manifest(files)
        .select("target_id", "path", parsed.alias("m"))
        .where(F.col("m").isNotNull() & F.col("m._broken").isNull())
        .select(
            "target_id",
            "path",
            F.map_zip_with(
                F.coalesce("m.dependencies", empty),
                F.coalesce("m.devDependencies", empty),
                lambda _, run, dev: F.coalesce(dev, run),
            ).alias("deps"),
        )
    )


def manifest_deps(manifests: DataFrame) -> DataFrame:
    """One row per declared dependency."""
    return manifests.select(
        "target_id", F.col("path").alias("manifest_path"), F.explode("deps").alias("pkg", "declared")
    )
