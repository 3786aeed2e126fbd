"""The corpus operators as queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, class_lm, exact_dedup, line_dedup, mixing, packing, quality, revisits, shingle_join, spots
from .common import held_out, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources flattened until the smallest is read three times; every document is read at least once."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), repeats=3.0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), threshold=10)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), 4, 2)
    got = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held))
    return got.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = class_lm.score_corpus(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["end"].cast("string"))), ",")
    return got.select("conv_id", "speaker", "chunk", "n_turns", "n_loss_turns", "start", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), spans.alias("mask_spans"))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = revisits.resolve_revisits(revisits.records_of(table(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return got.withColumn("headers", F.array_join(pairs, ";"))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(table(spark, sf_dir, "documents"), rule=shingle_join.Rule(3, 90, 100))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix_sources, op2_line_dedup, op3_best_fit_packing, op4_quality_ranking, op5_spotsigs, op6_class_lm, op7_exact_dedup, op8_chat_rotation, op9_revisits, op10_shingle_join)}


_LINES = """
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM parts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM hot)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM hot)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""

_COPIES = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_CHAT = """
WITH rows AS (SELECT conv_id, coalesce(turn, 0) AS turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) - 1 AS pos FROM rows),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM rows WHERE role <> 'system'),
parts AS (SELECT conv_id, speaker, pos, pos // 256 AS chunk, role = speaker AS loss,
                 '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
                 text || '<|im_end|>' AS said FROM numbered JOIN speakers USING (conv_id)),
placed AS (SELECT *, (sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY pos))::BIGINT - length(said) - 1 AS said_at FROM parts)
SELECT conv_id, speaker, chunk, count(*) AS n_turns, count(*) FILTER (WHERE loss) AS n_loss_turns, min(said_at - length(head)) AS start, sum(length(head) + length(said) + 1)::BIGINT AS n_chars,
       sha256(string_agg(head || said || chr(10), '' ORDER BY pos)) AS text_sha256,
       coalesce(string_agg(said_at || ':' || (said_at + length(said)), ',' ORDER BY pos) FILTER (WHERE loss), '') AS mask_spans
FROM placed GROUP BY conv_id, speaker, chunk
"""

_REVISITS = """
WITH hashed AS (SELECT page_id, url, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size,
                       regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
split AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^www[.]', ''), ':(80|443)$', '') AS host,
                 regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                 list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'),
                           lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid)(=|$)'))) AS params FROM hashed),
pages_of AS (SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM split),
records AS (SELECT canonical_url, page_id * 4 + step AS record_id, page_id * 100 + CASE step WHEN 0 THEN 0 WHEN 1 THEN 40 WHEN 2 THEN 60 ELSE -20 END AS captured_at,
                   step, page_id, digest, size, CASE WHEN step = 2 THEN '"other"' ELSE '"' || substr(digest, 1, 16) || '"' END AS etag
            FROM pages_of, (VALUES (0), (1), (2), (3)) AS s(step)),
found AS (SELECT r.canonical_url, r.record_id, r.captured_at, r.etag, r.page_id, r.step, b.record_id AS base_id, b.etag AS base_etag, b.digest AS base_digest, b.size AS base_size
          FROM records r LEFT JOIN records b ON r.canonical_url = b.canonical_url AND b.step = 0 AND (b.captured_at, b.record_id) < (r.captured_at, r.record_id)
          WHERE r.step <> 0 QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY b.captured_at DESC NULLS LAST, b.record_id DESC) = 1),
judged AS (SELECT *, CASE WHEN base_id IS NULL THEN 'no earlier response' WHEN base_etag = etag THEN 'resolved' ELSE 'validators differ' END AS outcome FROM found)
SELECT record_id, canonical_url, captured_at, outcome, CASE WHEN outcome = 'resolved' THEN base_id END AS target_id, CASE WHEN outcome = 'resolved' THEN base_digest END AS payload_digest,
       CASE WHEN outcome = 'resolved' THEN 'content-length=' || base_size || ';date=' || (page_id * 100 + step) || ';x-step=' || step END AS headers
FROM judged
"""


_SHINGLES = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r(doc_id, root) AS (SELECT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(r.root), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _LINES, "op7_exact_dedup": _COPIES, "op8_chat_rotation": _CHAT, "op9_revisits": _REVISITS, "op10_shingle_join": _SHINGLES}
