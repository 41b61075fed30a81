"""The operators' registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import chat, contamination, jaccard, packing, quality, substrings, toxicity, url_filter, vectors, warc
from kerbline.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return back.select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"),
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "text", F.size("removed_spans").alias("n_removed"), removed.alias("removed_chars"), "removed_spans")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return packing.pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = chat.conversations(table(spark, sf_dir, "conversations"))
    return chat.format_pairs(chat.pair_up(talks)).withColumnRenamed("pair_id", "chosen_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.measured(table(spark, sf_dir, "documents"))
    return quality.score(stats, quality.fit(stats, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(url_filter.labelled_urls(), "url string, label int")
    return url_filter.judge(table(spark, sf_dir, "pages"), labelled).select("page_id", "host", "path", "rule", "verdict", "score")


#: Components of link(a, b) in SQL, as reach(id, least): a recursive closure over both directions.
_REACH = """both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
closure(id, other) AS (SELECT a, b FROM both_ways UNION SELECT c.id, l.b FROM closure c JOIN both_ways l ON c.other = l.a),
reach AS (SELECT id, least(id, min(other)) AS least FROM closure GROUP BY id)"""

#: DuckDB SQL of the queries that it can express; models, packing and approximate search are beyond it.
SQL = {
    "op1_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n >= 1000) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM q""",
    "op4_vectors": f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
WHERE list_cosine_similarity(x.e, y.e) >= 0.93), {_REACH}, n AS (SELECT a, count(*) AS k FROM both_ways GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON vec_id = a LEFT JOIN reach ON vec_id = id""",
    "op5_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
'[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
met AS (SELECT l.doc_id AS a, r.doc_id AS b, l.n AS m, r.n AS n, count(*) AS k FROM e l JOIN e r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met WHERE 100 * k >= 80 * (m + n - k)), {_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id FROM s LEFT JOIN reach ON doc_id = id""",
    "op8_decontamination": """WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
have AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM have JOIN win USING (n, t)),
cover AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(k, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN listed USING (doc_id)""",
}


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_substrings, op3_toxicity, op4_vectors, op5_jaccard, op6_packing, op7_preferences, op8_decontamination, op9_quality, op10_urls)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
