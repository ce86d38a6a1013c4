"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import benchmark, interactions, katz, licenses, lines, media, mixing, pii, quality, ranked, simhash, substrings, warc
from sievework.session import table


def op1_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex16("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.unpack(media.pack(table(spark, sf_dir, "documents"), "doc_id", "text"), with_payload=False)
    return read.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_substring_countmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), quality.held_out("id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_pii_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii")
    counts = [pii.count_of(spans, k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(pii.base_only(spans)), 256).alias("base_sha256"), pii.listed(spans).alias("spans"), pii.scores(spans).alias("scores"))


def op3_decontaminate_myers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op7_line_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_deleted").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_mixing_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.decide(table(spark, sf_dir, "documents"))
    rows = found.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    return rows.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_license_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("found", lambda x: x["confirmed"])
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("paragraphs").alias("n_paragraphs"),
        F.size(sure).cast("bigint").alias("n_confirmed"),
        (F.size("found") - F.size(sure)).cast("bigint").alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_max(F.transform(sure, lambda x: x["probability"])).alias("best_probability"),
    )


def op11_ranked_rmq(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    learns = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    found = katz.score(table(spark, sf_dir, "documents"), learns)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_simhash_golay": op1_simhash_golay,
    "op2_media_png": op2_media_png,
    "op3_decontaminate_myers": op3_decontaminate_myers,
    "op4_substring_countmin": op4_substring_countmin,
    "op5_quality_nbsvm": op5_quality_nbsvm,
    "op6_pii_checksums": op6_pii_checksums,
    "op7_line_patience": op7_line_patience,
    "op8_warc_transactions": op8_warc_transactions,
    "op9_mixing_pivotal": op9_mixing_pivotal,
    "op10_license_regression": op10_license_regression,
    "op11_ranked_rmq": op11_ranked_rmq,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_katz_backoff": op13_katz_backoff,
}
OP4_SQL = r"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM l),
x AS (SELECT doc_id, i, md5(array_to_string(list(w) OVER f, ' ')) AS h, count(*) OVER f AS n FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM x WHERE n = 20) WHERE rn > 1),
c AS (SELECT u.doc_id, u.w, u.i, max(CASE WHEN late.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM u LEFT JOIN late ON late.doc_id = u.doc_id AND late.i = u.i),
g AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
b AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, array_to_string(list_transform(string_split(sha1(body), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda k: CAST(substr(bits, CAST(5 * i + k + 1 AS INT), 1) AS INT) * CAST(power(2, 4 - k) AS INT)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM b
"""

OP11_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, n_docs),
p AS (SELECT t.doc_id, t.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS share FROM t JOIN d USING (doc_id) JOIN f USING (term), c),
s AS (SELECT item_id, doc_id, sum(share)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x (letter, bit)),
p AS (SELECT '' AS prefix, 0 AS before, 0 AS bit UNION ALL SELECT prefix || letter, before | p.bit, letters.bit FROM p JOIN letters ON ((before | p.bit) & letters.bit) = 0),
s AS (SELECT part, prefix,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM p, c WHERE prefix <> '' GROUP BY part, prefix),
o AS (SELECT prefix AS filter_order, unnest(range(1, 6))::INT AS step FROM p WHERE length(prefix) = 5)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley
FROM o JOIN s ON prefix = filter_order[1:step]
"""

#: XXH64 fingerprints, PNG features, edit distances, fitted models, alignments, backoff weights in floating point and seeded rounding have no SQL; tests hold them against brute force.
ORACLES = {"op4_substring_countmin": OP4_SQL, "op8_warc_transactions": OP8_SQL, "op11_ranked_rmq": OP11_SQL, "op12_filter_interactions": OP12_SQL}
