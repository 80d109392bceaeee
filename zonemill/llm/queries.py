"""The thin queries over whole tables, one for each corpus operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_replay, divergence, lexical, packing, pii, secret_scan, simhash, substrings, token_count, topk, toxicity
from .common import documents
from .quality import judge
from .sharding import shard_documents


def _tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 ids; see packing.pack_documents for nulls, long texts, repeated rows and empty tables."""
    return packing.pack_documents(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component; see simhash.near_duplicates for nulls, long texts, repeated rows and empty tables."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that 13-word windows of earlier documents cover; see substrings.removal_digests for nulls and the other cases."""
    return substrings.removal_digests(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests; see bpe_replay.round_trip_digests for nulls and the other cases."""
    return bpe_replay.round_trip_digests(documents(spark, sf_dir), _tokenizer("byte_bpe_multi_50k.tiktoken"), _pattern())


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text; see token_count.count_tokens for nulls and the other cases."""
    return token_count.count_tokens(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), _pattern())


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of each whose id is divisible by 20; see topk.top_k for nulls, ties and the other cases."""
    vectors = topk.whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text; the tagger is fitted on a bounded sample. See pii.find for nulls and the other cases."""
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text; fitted on labelled rows that are not held out. See toxicity.score for nulls and the other cases."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every text; see quality.judge for nulls, missing labels and the other cases."""
    out = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by law ``rows``; see sharding.shard_documents for nulls and the other cases."""
    return shard_documents(documents(spark, sf_dir)).drop("group_rows")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources; see divergence.audit for nulls and the other cases."""
    return divergence.audit(documents(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item; see lexical.search for nulls, ties and the other cases."""
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text; see secret_scan.scan for nulls and the other cases."""
    return secret_scan.scan(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_packing, op2_simhash, op3_substring_dedup, op4_byte_bpe, op5_token_counts, op6_top_k, op7_pii, op8_toxicity, op9_quality_rules, op10_sharding)
    return {f.__name__: f for f in (*first, op11_source_divergence, op12_lexical_search, op13_secret_scan)}


_OP6 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN generate_series(1, len(q.v))]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (SELECT row_id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row_id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
ln AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
lp AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM ln JOIN v USING (lang)),
gn AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gp AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM gn),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p)) AS value FROM gp x JOIN gp y USING (lang, term) GROUP BY ALL) s
    ON s.lang = a.lang AND s.s1 = a.source AND s.s2 = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q
), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 50
"""

_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms)) AS n_all FROM d),
p AS (SELECT row_id, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
f AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, n_docs),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), r AS (
  SELECT item_id, row_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY ALL
), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_top_k": _OP6, "op11_source_divergence": _OP11, "op12_lexical_search": _OP12}
