"""Registered queries over the training-data tables, and their DuckDB SQL where SQL can express them.

Every query applies its operator to whole tables; the columns are those its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.llm import (bpe_automaton, hard_negatives, line_dedup, lm_score, mixing, quality_rules, simhash, token_align, token_counts,
                          topk_search, toxicity, warc, word_shuffle)
from equilens.llm.common import bucket_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector with all other vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), topk_search.quantize(F.col("embedding")).alias("v"))
    return topk_search.search(vectors, F.col("id") % 20 == 0, 20)


ORACLE["op1_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@register
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier three-line passage."""
    return _line_counts(line_dedup.dedup_lines(table(spark, sf_dir, "documents"), removed_lines="removed"))


def _line_counts(out: DataFrame) -> DataFrame:
    lines = F.when(F.col("text").isNull(), 0).when((F.col("text") == "") & (F.size("removed") > 0), 0) \
        .otherwise(F.size(F.split("text", "\n")))
    return out.select("doc_id", "text", lines.cast("long").alias("n_lines"),
                      F.size("removed").cast("long").alias("n_removed"))


ORACLE["op2_line_dedup"] = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
win AS (SELECT doc_id, i, a[i] AS x, a[i+1] AS y, a[i+2] AS z
        FROM docs, unnest(generate_series(1, len(a) - 2)) AS t(i) WHERE len(a) >= 3),
later AS (SELECT doc_id, i FROM (
            SELECT doc_id, i, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) AS k FROM win
            WHERE regexp_matches(x || y || z, '[^\\x20\\x09-\\x0D]')) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM later, (VALUES (0), (1), (2)) AS s(d)),
kept AS (SELECT docs.doc_id, string_agg(a[j], chr(10) ORDER BY j) AS text, count(*) AS n
         FROM docs, unnest(generate_series(1, len(a))) AS t(j)
         WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = docs.doc_id AND gone.i = j) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT docs.doc_id, CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(kept.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


@register
def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2_line_dedup, and without passages of over 50 words that repeat as one or two lines."""
    return _line_counts(line_dedup.dedup_lines(table(spark, sf_dir, "documents"), removed_lines="removed",
                                               long_words=line_dedup.LONG_WORDS))


ORACLE["op2_passage_dedup"] = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
win AS (SELECT doc_id, i, n, array_to_string(a[i:i+n-1], chr(10)) AS w
        FROM docs, (VALUES (1), (2), (3)) AS s(n), unnest(generate_series(1, len(a))) AS t(i) WHERE i + n - 1 <= len(a)),
later AS (SELECT doc_id, i, n FROM (
            SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, w ORDER BY doc_id, i) AS k FROM win
            WHERE len(regexp_extract_all(w, '[^\\x20\\x09-\\x0D]+')) > CASE n WHEN 3 THEN 0 ELSE 50 END) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM later, (VALUES (0), (1), (2)) AS s(d) WHERE d < n),
kept AS (SELECT docs.doc_id, string_agg(a[j], chr(10) ORDER BY j) AS text, count(*) AS n
         FROM docs, unnest(generate_series(1, len(a))) AS t(j)
         WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = docs.doc_id AND gone.i = j) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT docs.doc_id, CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(kept.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


@register
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the word-level BPE vocabulary."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                       token_counts.token_count(F.col("text"), path).alias("n_tokens")) \
        .withColumn("over_limit", F.col("n_tokens") > 2048)


@register
def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the text they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_automaton.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of the learned decision list."""
    judged, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


@register
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and automaton score of every document; every seventh id is held out."""
    held_out = bucket_of(F.col("doc_id"), 7) == 2
    return lm_score.score(table(spark, sf_dir, "documents"), ~held_out) \
        .select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return near.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@register
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and where its first copy stands in training."""
    plan = mixing.assign(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken",
                       F.round(F.get("positions", F.lit(0)), 6).alias("first_position"))


ORACLE["op8_mixing"] = """
WITH d AS (SELECT doc_id, source, md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))) AS k,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS w
      FROM d GROUP BY source),
-- a source is capped where its cap is not above its weight's share of what the sources with smaller cap / weight leave
r AS (SELECT source, source_size, w, 3 * source_size AS cap,
             ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * o.source_size) FROM s o
                WHERE (3.0 * o.source_size / o.w, o.source) < (3.0 * s.source_size / s.w, s.source)), 0))
             / ((SELECT sum(w) FROM s) - coalesce((SELECT sum(o.w) FROM s o
                WHERE (3.0 * o.source_size / o.w, o.source) < (3.0 * s.source_size / s.w, s.source)), 0)) AS share FROM s),
t AS (SELECT *, least(cap::DOUBLE, w * (SELECT min_by(share, cap * 1.0 / w) FROM r WHERE share * w < cap)) AS target FROM r),
b AS (SELECT *, (w - 2) / 2.0 - (SELECT sum(target * (w - 2) / 2.0) / sum(target) FROM t) AS slope FROM t),
c AS (SELECT d.*, b.source_size, b.target, b.slope, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle,
        floor(target / b.source_size) AS passes FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
e AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE passes + (middle <= target - passes * source_size)::INT END AS copies FROM c)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (size * copies)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN round(least(1.0, 2 * (middle / target)
         / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (middle / target)))), 6) END AS first_position FROM e
"""


@register
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as looked up in the archives by its URL (null included) through the capture index."""
    pages = table(spark, sf_dir, "pages")
    folder, directory = warc.build(pages, min_bytes=0)
    return warc.lookup(directory, folder, pages) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels of four fifths of the ids."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), bucket_of(F.col("id"), 5) != 0)
    return docs.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"),
                       toxicity.score(F.col("text"), model).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, in the score windows of its five best vectors of its own label."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), shifted.alias("label"),
                                                     topk_search.quantize(F.col("embedding"), 256.0).alias("v"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0, n_positives=5, n_negatives=10, low=30, high=90)


ORACLE["op11_hard_negatives"] = """
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.u, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
      FROM r a JOIN r c ON a.u <> c.u WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.u, p.k ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.u = s.u WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@register
def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and corpus-wide link counts of every document's tokens under two tokenizers."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return token_align.align_links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                   public_tokenizers.path("piece_bpe_32k.model"), derived={"groups_sha256": digest})


@register
def op13_word_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = word_shuffle.encode(table(spark, sf_dir, "documents"), path, packed=True)
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_u32", 256).alias("ids_sha256"), "ids")
    back = word_shuffle.decode(coded, path, keep=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
