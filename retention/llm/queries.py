"""Registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, divergence, htmltext, kdshard, langid, minhash, mixing, packing, quality, simhash, tokencount,
               toxicity, whitening)
from .common import fold_remainder, read

THRESHOLD = 0.3


def _scored(found: DataFrame, k: int, held: int) -> DataFrame:
    return found.select("doc_id", (fold_remainder("doc_id", k) == held).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, marks.where(fold_remainder("doc_id", 4) != 2))
    return _scored(toxicity.score(docs, model), 4, 2)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_pairs(read(spark, sf_dir, "documents"))


def op3_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), tokencount.Tokenizer())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), whole=True)


def op5_kdshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = {"size": F.log2(F.octet_length("text") + 1), "lang": F.crc32("lang"), "source": F.crc32("source")}
    found = kdshard.shard(read(spark, sf_dir, "documents"), dims, 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, marks.where(fold_remainder("doc_id", 5) != 0))
    return _scored(quality.score(docs, model), 5, 0)


def op7_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold_remainder("doc_id", 4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text", words=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return whitening.transform(vectors, whitening.fit(vectors, scale=64, offset=1_000_000, components=16))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), least_docs=10, most_terms=10)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_minhash, op3_tokencount, op4_decontaminate, op5_kdshard, op6_quality,
                                   op7_htmltext, op8_langid, op9_packing, op10_simhash, op11_whitening, op12_divergence,
                                   op13_mixing)}

ORACLE_SQL: dict[str, str] = {"op12_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
vl AS (SELECT lang, count(*) AS kept, sum(n) AS total FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY w.lang, w.source, w.term),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
             1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(gn.total, 0) + 2 * vl.kept) AS p,
             1 + 1000000000::HUGEINT * (v.n + 2) // (vl.total + 2 * vl.kept) AS q
      FROM g JOIN v USING (lang) JOIN vl USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN gn USING (lang, source)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
k AS (SELECT lang, source, part, item, value,
             row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM k WHERE part = 'pair' OR rank <= 10
"""}
