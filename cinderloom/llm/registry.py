"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.llm import bestfit, bpe, changepoints, curve_packing, fim, jaccard_join, line_dedup, lm_score, maxscore, mpeg_audio, pipeline, quality, token_packing, toxicity
from cinderloom.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE)
    return bpe.decode(ids, BYTE_BPE).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = line_dedup.decisions(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.concat_ws(",", "removed").alias("removed_lines"), F.concat_ws(",", "groups").alias("removed_groups"))


def op3_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.packed(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), WORD_BPE)


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.sampled(docs, model) if model else docs.select("doc_id", F.lit(0.0).alias("log_ratio"), F.lit(0.0).alias("gumbel_key"))


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.probe(mpeg_audio.store(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "n_frames",
        "duration_samples",
        "sample_rate",
        F.sha2("frame_offsets", 256).alias("frame_offsets_sha256"),
    )


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_id", "n_links", "n_class_links")


def held_out(doc_id: Column) -> Column:
    """The rows whose labels toxicity may not learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn_from=~held_out(F.col("doc_id")))
    return toxicity.scores(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("segments").alias("n_segments"),
    )


def op10_bounded_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoints.segments(table(spark, sf_dir, "sale_lines"), "vendor_id", "quantity", "shipped_at").withColumnRenamed("key", "vendor_id")


#: One step a day over all series: lists hold the best cost, segments and last start of every prefix. The least struct wins, field by field.
OP11_SQL = """
WITH RECURSIVE sums AS (
  SELECT vendor_id, CAST(CAST(shipped_at AS DATE) - DATE '1970-01-01' AS BIGINT) AS day, sum(quantity) AS x
  FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL
), spans AS (
  SELECT row_number() OVER () AS series, vendor_id, min(day) AS d0, max(day) - min(day) + 1 AS n FROM sums GROUP BY vendor_id
), days AS (
  SELECT series, vendor_id, d0, n, unnest(range(n)) AS i FROM spans
), filled AS (
  SELECT d.series, d.i, coalesce(s.x, 0) AS x
  FROM days d LEFT JOIN sums s ON d.vendor_id IS NOT DISTINCT FROM s.vendor_id AND d.d0 + d.i = s.day
), running AS (
  SELECT series, i, CAST(sum(x) OVER w AS BIGINT) AS s, CAST(sum(x * x) OVER w AS BIGINT) AS q
  FROM filled WINDOW w AS (PARTITION BY series ORDER BY i ROWS UNBOUNDED PRECEDING)
), prefix AS (
  SELECT series, list_prepend(0, list(s ORDER BY i)) AS s, list_prepend(0, list(q ORDER BY i)) AS q, count(*) AS n FROM running GROUP BY series
), best AS (
  SELECT series, 0::BIGINT AS t, [{'c': 0::BIGINT, 'k': 0::BIGINT, 's': 0::BIGINT}] AS f FROM prefix
  UNION ALL
  SELECT b.series, b.t + 1, list_append(b.f, list_min(list_transform(
    list_filter(range(b.t + 2), lambda a: a = 0 OR (a >= 14 AND b.t + 1 - a >= 14)),
    lambda a: {
      'c': CAST(CASE WHEN a = 0 AND b.t + 1 < 14 AND b.t + 1 < p.n THEN 1000000000000 ELSE b.f[a + 1].c + CASE WHEN a > 0 THEN 40000 ELSE 0 END
        + (b.t + 1 - a) * floor(1000 * ln(1 + ((b.t + 1 - a) * (p.q[b.t + 2] - p.q[a + 1]) - (p.s[b.t + 2] - p.s[a + 1]) * (p.s[b.t + 2] - p.s[a + 1])) // ((b.t + 1 - a) * (b.t + 1 - a)))) END AS BIGINT),
      'k': b.f[a + 1].k + 1,
      's': CAST(a AS BIGINT)})))
  FROM best b JOIN prefix p USING (series) WHERE b.t < p.n
), cut AS (
  SELECT b.series, b.f, p.s, p.q, p.n AS t, b.f[p.n + 1].s AS a, b.f[p.n + 1].k AS k FROM best b JOIN prefix p ON b.series = p.series AND b.t = p.n
  UNION ALL
  SELECT series, f, s, q, a, f[a + 1].s, f[a + 1].k FROM cut WHERE a > 0
), told AS (
  SELECT v.vendor_id, CAST(c.k AS INTEGER) AS segment_no, v.d0 + c.a AS first_day, c.t - c.a AS n_days,
    c.s[c.t + 1] - c.s[c.a + 1] AS total, c.q[c.t + 1] - c.q[c.a + 1] AS squares, v.n, c.f
  FROM cut c JOIN spans v USING (series)
)
SELECT vendor_id, segment_no, first_day, n_days, total, 1 + (n_days * squares - total * total) // (n_days * n_days) AS spread,
  CAST(n_days * floor(1000 * ln(1 + (n_days * squares - total * total) // (n_days * n_days))) AS BIGINT) AS cost,
  f[n + 1].k AS n_segments, f[n + 1].c AS best_cost
FROM told
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restored(fim.transform(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), cuts AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || d[9:16] AS BIGINT) % (len(u) + 1) AS b,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 100 AS plain, CAST('0x' || d[25:32] AS BIGINT) % 100 < 50 AS spm FROM lines
), parts AS (
  SELECT doc_id, t, n, plain, spm, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM cuts
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN concat('<S>', s, '<P>', p, '<M>', m) ELSE concat('<P>', p, '<S>', s, '<M>', m) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def queries() -> dict:
    return {"pipeline": pipeline.run} | {f.__name__: f for f in (op1_byte_bpe, op2_fuzzy_lines, op3_packed_ids, op4_cross_entropy_difference, op5_quality_resampling, op6_mpeg_audio, op7_maxscore, op8_chosen_path_join, op9_toxic_segments, op10_bounded_best_fit, op11_change_points, op12_fill_in_middle, op13_curve_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op7_maxscore": OP7_SQL, "op11_change_points": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
