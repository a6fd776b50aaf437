"""The queries of this package over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import ann, decontaminate, langid, mixing, sharding, simhash, suffix_dedup, tokencount, toxicity, warc
from tilewright.llm.common import crc32_of_id, table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    model = toxicity.learn(docs, labels)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.scorer(spark, model)("text").alias("score"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.overlap(docs, table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id",
        "overlap.n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("overlap.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("overlap.items"), ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    folder = written.select("folder").limit(1).collect()
    if not folder:  # no pages, no archive
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    archive = folder[0].folder
    responses = warc.read_archives(spark, archive, ["page_id", "record_type", "payload"]).where("record_type = 'response'")
    revisits = warc.read_archives(spark, archive, ["page_id", "record_type", "payload_length", "payload_digest", "refers_to_page_id"]).where("record_type = 'revisit'")
    full = responses.select("page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    return full.union(revisits.select("page_id", "payload_length", warc.bare_digest(), "record_type", "refers_to_page_id"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])
    return found.select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken", "shards", "places")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % 3 == 1, F.lit(False))
    profiles = langid.learn(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.identify(docs, profiles).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and of its lines; a token over a line's end goes to the line with most of its bytes."""
    count = tokencount.counter(spark, rule="most")
    found = table(spark, sf_dir, "documents").select("doc_id", count(tokencount.lines_of(F.col("text"))).alias("found"))
    return found.select("doc_id", "found.n_tokens", F.size("found.counts").cast("bigint").alias("n_sections"), F.col("found.crossing").alias("n_crossing"), F.transform("found.counts", lambda x: x.cast("bigint")).alias("section_tokens"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x.stop - x.start)
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


QUERIES = {
    "op1_ann": op1_ann,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_langid": op8_langid,
    "op9_tokencount": op9_tokencount,
    "op10_suffix_dedup": op10_suffix_dedup,
}

OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
cut AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM cut) WHERE len(w) >= n)),
found AS (SELECT r, p.n, i, item FROM places p JOIN cut c ON p.n = c.n AND p.win = c.win),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""

OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT r, doc_id, h, unnest(range(0, CAST(length(h) // 2 AS BIGINT) - 49)) AS i FROM d WHERE length(h) >= 100 AND doc_id IS NOT NULL)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT r, i FROM w JOIN m USING (s) WHERE least < doc_id),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM marked) GROUP BY r, g),
pieces AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS p FROM runs),
sums AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS z FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) AS k FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, '') || substr(h, CAST(2 * coalesce(z, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""

SQL = {"op10_suffix_dedup": OP10_SQL, "op3_decontaminate": OP3_SQL, "op4_warc": OP4_SQL}
