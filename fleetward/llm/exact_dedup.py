"""Exact deduplication of texts by a heavy-hitter split.

Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by one space.  Every text is read once,
for its digest; all later steps work on a narrow table of (id, digest).

1. A Misra-Gries summary (``freqItems``) of ``counters`` counters names every digest that more than one in ``counters``
   rows has.  It may name others too, so the candidates are counted exactly.
2. The verified heavy digests, at most ``counters`` rows by construction, are broadcast: their rows get their winner
   where they are, without a shuffle.
3. The other digests are shuffled: minima and counts of a group combine before the shuffle, and groups of more than one
   row are joined back to their rows.  Both sides of that join are plain exchanges of written tables, so the engine can
   split a group among tasks; no group is ever sorted or held as a whole.

Defined results: a null text counts as empty; a null id never wins against another id, and a group of null ids only has
a null ``keep_id`` and keeps its rows.  A text of any length is read whole and only its digest travels.  The id names a document: rows that repeat both id and text share one fate, so a
winner that is repeated stays repeated (they all count in ``group_size``).  An empty table gives an empty result.  Other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetward.llm.lost import bounded, unused
from fleetward.plans.staging import materialize

#: A digest with more than one in so many rows is handled without a shuffle; also the bound of the broadcast rows.
COUNTERS = 200


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with its white space normalised."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``."""
    digests = materialize(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    rows = digests.count()
    candidates = digests.stat.freqItems(["digest"], 1 / counters).select(F.explode("digest_freqItems").alias("digest"))
    heavy = (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") * counters > rows)
    )
    heavy = materialize(heavy, "heavy-digests")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("size")).where("size > 1")
    light = rest.join(materialize(groups, "light-groups"), "digest", "left").select(
        "id",
        "digest",
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("least")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
    )
    hot = digests.join(F.broadcast(heavy), "digest").select("id", "digest", "keep_id", "group_size")
    return hot.unionByName(light).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    The rows that go are few and narrow: they are broadcast below a count, so that texts need no shuffle.
    """
    key, digest = unused("id"), unused("digest")
    gone = exact_dedup(docs, id_col, text_col).where(~F.col("kept"))
    lost = bounded(gone.select(F.col(id_col).alias(key), F.col("text_sha256").alias(digest)).distinct())
    same = docs[id_col].eqNullSafe(F.col(key)) & (text_digest(docs[text_col]) == F.col(digest))
    return docs.join(lost, same, "left_anti")
