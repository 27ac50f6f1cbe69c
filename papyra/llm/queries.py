"""The queries of this package and their SQL: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyra.llm.audio import clips, grouped_matches, match_recordings
from papyra.llm.common import load
from papyra.llm.decontaminate import leak_report
from papyra.llm.language import identify_languages
from papyra.llm.lines import line_bitmaps
from papyra.llm.lm import score_texts
from papyra.llm.mixing import mix
from papyra.llm.neardup import duplicate_classes
from papyra.llm.quality import quality_scores
from papyra.llm.toxicity import grade_toxicity
from papyra.llm.urls import judge_urls


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(load(spark, sf_dir, "documents"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"))


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_matches(match_recordings(clips(load(spark, sf_dir, "embeddings"))))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(load(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_bitmaps(load(spark, sf_dir, "documents"), plain=True).drop("keep_bitmap")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_urls": op2_urls,
    "op3_audio": op3_audio,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_near_duplicates": op10_near_duplicates,
}

ORACLES: dict[str, str] = {
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
f AS (
  SELECT *, (sum(total) OVER () - coalesce(sum(3 * total) OVER (ORDER BY total / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft,
         (sum(weight) OVER (ORDER BY total / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rem FROM w),
g AS (SELECT *, 3 * total * rem <= lft * weight AS clamped, row_number() OVER (ORDER BY total / weight, source NULLS FIRST) AS k FROM f),
lv AS (SELECT lft AS l_left, rem AS l_of, k AS l_k FROM g WHERE NOT clamped ORDER BY k LIMIT 1),
t AS (
  SELECT source, total, CASE WHEN l_k IS NULL OR k < l_k THEN (3 * total)::DOUBLE ELSE (l_left * weight)::DOUBLE / l_of::DOUBLE END AS target
  FROM g LEFT JOIN lv ON true),
p AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target + 0.5)::BIGINT // total ELSE 0 END AS whole FROM t),
q AS (SELECT *, floor(target + 0.5)::BIGINT - whole * total AS rest FROM p),
a AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM d)
SELECT a.doc_id, a.size, q.total AS source_size, q.target, (q.whole * a.size + least(greatest(q.rest - a.ahead, 0), a.size))::BIGINT AS taken
FROM a JOIN q ON a.source IS NOT DISTINCT FROM q.source""",
    "op8_decontamination": r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bg AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bg),
dg AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw CROSS JOIN ks WHERE len(w) >= k)),
hit AS (SELECT dg.r, dg.k, dg.i, bg.item_id FROM dg JOIN bg ON dg.k = bg.k AND dg.gram = bg.gram),
pos AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY r),
it AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN it USING (r)""",
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, r, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, r, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line
        FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
b AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, b.keeper IS NOT NULL AND coalesce(doc_id < b.keeper, false) AS lost FROM l LEFT JOIN b USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (lost))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256,
       string_agg(CASE WHEN lost THEN '0' ELSE '1' END, '' ORDER BY i) AS keep_bits
FROM m GROUP BY doc_id, r""",
}
