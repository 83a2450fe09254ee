"""One query per operator, with production parameters, over its whole table; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetward.llm.bpe import round_trip
from fleetward.llm.embedding_dedup import embedding_dedup
from fleetward.llm.exact_dedup import exact_dedup
from fleetward.llm.html_extract import extract_text
from fleetward.llm.language import identify
from fleetward.llm.language import learn as learn_languages
from fleetward.llm.packing import pack_documents
from fleetward.llm.periodic import periodic_runs
from fleetward.llm.pii import find_personal_data
from fleetward.llm.pii import learn as learn_labelers
from fleetward.llm.simhash import simhash_dedup
from fleetward.llm.spelling import spelling_variants
from fleetward.llm.suffix_dedup import remove_repeats
from fleetward.llm.toxicity import learn, score_toxicity
from fleetward.llm.url_filter import filter_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_dedup")
def _(spark: SparkSession, d: str) -> DataFrame:
    return simhash_dedup(table(spark, d, "documents"))


@query("op2_embedding_dedup")
def _(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup(table(spark, d, "embeddings"))


@query("op3_best_fit_packing")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


@query("op4_byte_bpe")
def _(spark: SparkSession, d: str) -> DataFrame:
    return round_trip(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_language_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return identify(docs, learn_languages(docs))


@query("op6_url_filter")
def _(spark: SparkSession, d: str) -> DataFrame:
    return filter_urls(table(spark, d, "pages"))


@query("op7_toxicity")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return score_toxicity(docs, learn(docs, table(spark, d, "labels")))


@query(
    "op8_exact_dedup",
    r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup(table(spark, d, "documents"))


@query("op9_pii")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return find_personal_data(docs, learn_labelers(docs))


@query("op10_suffix_dedup")
def _(spark: SparkSession, d: str) -> DataFrame:
    return remove_repeats(table(spark, d, "documents"))


#: CRC-32 bit by bit: every step shifts, and adds the polynomial if the lowest bit and the text's differ.
SPELLING_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT id, run, count(*) AS c FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents)
  GROUP BY id, run
), bits AS (
  SELECT id, run, c, flatten(list_transform(
    flatten(list_transform(list_transform(string_split(id || ':' || run, ''), lambda x: unicode(x)),
      lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END)),
    lambda x: list_transform(range(8), lambda k: CAST((x >> k) & 1 AS BIGINT)))) AS b
  FROM runs
), digests AS (
  SELECT run, c, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b),
    lambda h, x: xor(h >> 1, CAST(3988292384 AS BIGINT) * (xor(h, x) & 1))), CAST(4294967295 AS BIGINT)) AS h
  FROM bits
), cut AS (
  SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word
  FROM digests
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), deleted AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT DISTINCT d.word, w.word AS other FROM deleted d JOIN words w ON w.word = d.rest
  UNION ALL SELECT DISTINCT w.word, d.word FROM deleted d JOIN words w ON w.word = d.rest
  UNION ALL SELECT a.word, b.word FROM deleted a JOIN deleted b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
), near AS (
  SELECT p.word, count(*) AS n_near, max(o.n) AS most FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word
), best AS (
  SELECT p.word, min(p.other) AS form FROM pairs p JOIN words o ON o.word = p.other JOIN near x ON x.word = p.word AND o.n = x.most GROUP BY p.word
), forms AS (
  SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near,
    CASE WHEN x.most >= 2 * w.n THEN b.form END AS form, CASE WHEN x.most >= 2 * w.n THEN x.most END AS form_n
  FROM words w LEFT JOIN near x ON x.word = w.word LEFT JOIN best b ON b.word = w.word
), chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""


@query("op11_spelling_variants", SPELLING_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    return spelling_variants(table(spark, d, "documents"))


@query("op12_html_extract")
def _(spark: SparkSession, d: str) -> DataFrame:
    return extract_text(table(spark, d, "pages"))


@query("op13_periodic_runs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return periodic_runs(table(spark, d, "documents"), rewrite=True)
