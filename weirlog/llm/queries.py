"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, common, decontamination, html_text, jaccard_join, language_id, ngram_lm, packing, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), added=True)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.hit_words().cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_lm.scored(docs.select("doc_id", "text", (common.fold(F.col("doc_id")) == 1).alias("held_out")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = common.fold(F.col("doc_id")) == 0
    learned = language_id.learn(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = common.fold(F.col("doc_id")) == 0
    learned = toxicity.learn(docs, labels.where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), learned)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents"), added=True))


QUERIES = {f.__name__: f for f in (op1_packing, op2_ann, op3_decontamination, op4_lm_scoring, op5_language_id, op6_chat_formatting, op7_jaccard_join, op8_html_extraction, op9_toxicity, op10_token_counts)}

SQL: dict[str, str] = {
    "op3_decontamination": r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, l, array_to_string(w[i + 1 : i + l], ' ') AS t
  FROM (SELECT item, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM (SELECT item, w, least(len(w), 10) AS l FROM item WHERE len(w) > 0))),
hit AS (
  SELECT DISTINCT d.r, d.i, d.l, win.item
  FROM (SELECT r, l, i, array_to_string(w[i + 1 : i + l], ' ') AS t
        FROM (SELECT r, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM doc, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)) AS d
  JOIN win ON win.l = d.l AND win.t = d.t),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""",
    "op6_chat_formatting": r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn ASC NULLS LAST, role, text) AS t FROM turns GROUP BY conv_id),
whole AS (SELECT t, min(conv_id) AS conv_id, count(*) AS n_copies FROM conv GROUP BY t),
proper AS (SELECT DISTINCT t[1:i] AS t FROM (SELECT t, unnest(range(1, len(t))) AS i FROM conv))
SELECT conv_id, CAST(len(t) AS BIGINT) AS n_turns, n_copies,
       list_reduce(list_transform(t, lambda x: '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10) || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)), lambda a, b: a || b) AS text
FROM whole WHERE t NOT IN (SELECT t FROM proper)
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
gram AS (
  SELECT DISTINCT r, array_to_string(w[i + 1 : i + l], ' ') AS g
  FROM (SELECT r, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM (SELECT r, w, least(len(w), 5) AS l FROM doc WHERE len(w) > 0))),
told AS (SELECT r, sha256(string_agg(g, chr(10) ORDER BY g)) AS k, count(*) AS n FROM gram GROUP BY r),
sets AS (SELECT k, n, min(r) AS r, count(*) AS copies FROM told GROUP BY k, n),
one AS (SELECT k, g FROM sets JOIN gram USING (r)),
pair AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM one a JOIN one b USING (g) WHERE a.k <> b.k GROUP BY a.k, b.k),
link AS (SELECT x, y, b.copies FROM pair JOIN sets a ON a.k = x JOIN sets b ON b.k = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
class(k, root) USING KEY (k) AS (
  SELECT k, k FROM sets
  UNION SELECT had.k, min(class.root) FROM class JOIN link ON link.x = class.k JOIN recurring.class AS had ON had.k = link.y GROUP BY had.k, had.root HAVING min(class.root) < had.root),
name AS (SELECT root, min(doc_id) AS class_id FROM class JOIN told USING (k) JOIN doc USING (r) GROUP BY root),
links AS (SELECT x AS k, sum(copies) AS n_links FROM link GROUP BY x)
SELECT doc_id, CASE WHEN k IS NULL THEN doc_id ELSE class_id END AS class_id, CAST(coalesce(sets.copies - 1 + coalesce(n_links, 0), 0) AS BIGINT) AS n_links,
       CAST(coalesce(sets.copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles
FROM doc LEFT JOIN told USING (r) LEFT JOIN sets USING (k) LEFT JOIN class USING (k) LEFT JOIN name USING (root) LEFT JOIN links USING (k)
""",
}
