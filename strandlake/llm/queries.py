"""Thin queries over the corpus operators, by the contracts of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, filter_audit, importance, language_model, line_dedup, packing, piecewise, quality, revisits, simhash, token_counts, toxicity, url_filter
from strandlake.llm.common import fold
from strandlake.session import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH line AS (
  SELECT doc_id, i, x, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS x, unnest(range(len(parts))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
),
shared AS (
  SELECT k, min(doc_id) AS owner FROM line WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)
),
marked AS (
  SELECT l.doc_id, l.i, l.x, s.k IS NOT NULL AND l.doc_id <> s.owner AS gone FROM line l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 7, 2)
    out = language_model.score(docs, language_model.train(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), *language_model.RESULT)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = revisits.captures_of_pages(read_table(spark, sf_dir, "pages"))
    found = revisits.resolve(records)
    names = ["cache-control", "content-type", "date", "etag", "last-modified"]
    merged = F.concat_ws("; ", *[F.concat(F.lit(n + "="), F.coalesce(F.col("headers")[n], F.lit("-"))) for n in names])
    return found.select("record_id", "canonical", "response_id", "status", merged.alias("merged"))


OP7_SQL = r"""
WITH rec AS (
  SELECT 2 * page_id AS record_id, 'response' AS kind, url, 2 * page_id AS ts, page_id AS p, page_id AS v FROM pages
  UNION ALL
  SELECT 2 * page_id + 1, 'revisit', regexp_replace(url, '[?#].*$', ''), CASE WHEN page_id % 11 = 0 THEN 2 * page_id - 1 ELSE 2 * page_id + 1001 END, page_id,
         CASE WHEN page_id % 4 = 0 THEN page_id + 1 ELSE page_id END
  FROM pages WHERE page_id % 3 = 0
),
clean AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''),
      '#.*$', ''), '^[A-Za-z]+://', ''),
      '(\?|&)(utm_source|utm_medium|utm_campaign|ref|fbclid|gclid)=[^&]*', '\1', 'g'),
      '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&/]+$', '') AS u
  FROM rec
),
keyed AS (
  SELECT record_id, kind, ts,
         regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.', '') || substr(u, length(regexp_extract(u, '^[^/?]*')) + 1) AS canonical,
         CASE WHEN p % 5 <> 0 THEN '"' || CAST(v % 97 AS VARCHAR) || '"' END AS etag,
         CASE WHEN p % 7 <> 0 THEN 'day ' || CAST(v % 31 AS VARCHAR) END AS modified
  FROM clean
),
joined AS (
  SELECT a.*, b.record_id AS response_id, b.etag AS b_etag, b.modified AS b_modified, b.ts  AS b_ts
  FROM (SELECT * FROM keyed WHERE kind = 'revisit') a
  ASOF LEFT JOIN (SELECT * FROM keyed WHERE kind = 'response') b ON a.canonical = b.canonical AND a.ts > b.ts
),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing'
                 WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN CASE WHEN etag = b_etag THEN 'resolved' ELSE 'changed' END
                 WHEN modified IS NOT NULL AND b_modified IS NOT NULL THEN CASE WHEN modified = b_modified THEN 'resolved' ELSE 'changed' END
                 ELSE 'unchecked' END AS status
  FROM joined
)
SELECT record_id, canonical, response_id, status,
       'cache-control=no-cache; content-type=' || CASE WHEN status IN ('resolved', 'unchecked') THEN 'text/html' ELSE 'text/plain' END
       || '; date=second ' || CAST(record_id AS VARCHAR)
       || '; etag=' || coalesce(etag, CASE WHEN status IN ('resolved', 'unchecked') THEN b_etag END, '-')
       || '; last-modified=' || coalesce(modified, CASE WHEN status IN ('resolved', 'unchecked') THEN b_modified END, '-') AS merged
FROM judged
"""


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 5, 0)
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality").alias("score"), F.col("accepted").cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 3, 1)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.TOXIC).cast("int").alias("predicted"), "offending")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.compare_with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, read_table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM d),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m
  FROM w
),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
c AS (
  SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m
),
x AS (SELECT chr(CAST(65 + i AS INTEGER)) AS a, CAST(1 << i AS INTEGER) AS b FROM range(5) r(i)),
o AS (
  SELECT x1.a || x2.a || x3.a || x4.a || x5.a AS filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] AS bits
  FROM x x1 JOIN x x2 ON x2.a <> x1.a JOIN x x3 ON x3.a NOT IN (x1.a, x2.a)
  JOIN x x4 ON x4.a NOT IN (x1.a, x2.a, x3.a) JOIN x x5 ON x5.a NOT IN (x1.a, x2.a, x3.a, x4.a)
),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, (SELECT CAST(i + 1 AS INTEGER) AS step FROM range(5) r(i)))
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (m & (own | before) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (m & own <> 0 AND m & before = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (m & own <> 0 AND m & before <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (m = own), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (m & own <> 0 AND m & before = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(bad) FILTER (m & own <> 0 AND m & before = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(m), 1)) FILTER (m & own <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, read_table(spark, sf_dir, "benchmark").select("text"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": op4_decontamination,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op12_token_counts": op12_token_counts,
    "op13_importance_resampling": op13_importance_resampling,
}
SQL = {"op1_line_dedup": OP1_SQL, "op7_warc_revisits": OP7_SQL, "op11_filter_interaction_audit": OP11_SQL}
