"""Queries over the column functions: normalisers, keys, hashes, filters and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import keys, text
from sievework.operators import tagging
from sievework.plans.registry import query
from sievework.session import table

STOP = ["the", "and", "of", "with", "for"]
BROAD = ["ring", "bolt"]
_MATCH = "trim(regexp_replace(regexp_replace(lower({0}), '[''\"’“”]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
_PLURAL = "CASE WHEN length({0})>4 AND {0} LIKE '%ies' THEN {0}[:-4]||'y' WHEN length({0})>4 AND regexp_matches({0},'(ch|sh|x|z|ss)es$') THEN {0}[:-3] WHEN length({0})>3 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN {0}[:-2] ELSE {0} END"
_SHORT = "CASE WHEN length({0})>3 AND {0} LIKE '%s' AND NOT regexp_matches({0},'(ss|us|is)$') THEN {0}[:-2] ELSE {0} END"


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[''’‘`´]', '', 'g'), '[-‐‑‒–—―]', ' ', 'g'), '[^a-z0-9+]+', ' ', 'g')) AS search_key FROM documents""")
def n01_search_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.search_key(F.col("text")).alias("search_key"))


@query(r"""SELECT doc_id, k AS title_key, trim(regexp_replace(k, '[^\p{L}\p{N}]+', ' ', 'g')) AS loose_key FROM (
  SELECT doc_id, regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[''’‘`´]', '''', 'g'), '[-‐‑‒–—―]', '-', 'g') AS k FROM documents)""")
def n02_title_keys(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.title_key(F.col("text")).alias("title_key"), text.loose_title_key(F.col("text")).alias("loose_key"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(replace(p_name || ' & ' || p_type, '&', ' and ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '-'), lambda w: w <> '')), '-') AS sorted_slug FROM part""")
def n04_slugs(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select("p_partkey", text.slug(F.concat("p_name", F.lit(" & "), "p_type")).alias("slug"), text.sorted_slug(F.col("p_type")).alias("sorted_slug"))


@query(rf"""SELECT p_partkey, {_MATCH.format("regexp_replace(lower(p_name || ' ' || p_type), '\\bring\\b', 'hoop', 'g')")} AS match_text FROM part""")
def n05_match_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.match_text(F.concat_ws(" ", "p_name", "p_type"), {"ring": "hoop"}).alias("match_text"))


@query(rf"""WITH t AS (SELECT doc_id, unnest({_WORDS.format(_MATCH.format('text'))}) AS w FROM documents)
SELECT r AS token, count(*) AS n FROM (SELECT CASE WHEN length(w) > 1 AND w NOT IN ('the','and','of','with','for') THEN CASE WHEN w = 'that' THEN 'which' ELSE {_SHORT.format('w').replace('CASE WHEN', "CASE WHEN w IN ('ones','thes') AND", 1)} END END AS r FROM t) WHERE r IS NOT NULL GROUP BY r""")
def n06_tokens(spark: SparkSession, sf: str) -> DataFrame:
    exploded = table(spark, sf, "documents").select(F.explode(text.words(text.match_text(F.col("text")))).alias("w"))
    return exploded.select(text.token(F.col("w"), STOP, {"that": "which"}, ["one", "the"]).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("n"))


@query(rf"""WITH t AS (SELECT DISTINCT unnest({_WORDS.format(_MATCH.format('text'))}) AS w FROM documents)
SELECT w AS word, {_PLURAL.format('w')} AS plain, {_SHORT.format('w')} AS short FROM t""")
def n07_singulars(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select(F.explode(text.words(text.match_text(F.col("text")))).alias("word")).distinct()
    return w.select("word", text.singular_plain(F.col("word")).alias("plain"), text.singular_short(F.col("word")).alias("short"))


@query(rf"""WITH t AS (SELECT p_partkey, list_transform(list_filter({_WORDS.format(_MATCH.format("(p_name || ' ' || p_type)"))}, lambda w: length(w) > 2 AND w NOT IN ('the','and','of','with','for') AND NOT regexp_matches(w, '^[0-9]+$')), lambda w: {_PLURAL.format('w')}) AS l FROM part),
u AS (SELECT p_partkey, list_filter(l, lambda w, i: list_position(l, w) = i) AS l FROM t)
SELECT p_partkey, array_to_string(list_filter(l, lambda w: w NOT IN ('ring','bolt')), ' ') AS strong, array_to_string(list_filter(l, lambda w: w IN ('ring','bolt')), ' ') AS broad FROM u""")
def n08_token_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", text.token_profile(F.concat_ws(" ", "p_name", "p_type"), BROAD, STOP).alias("p"))
    return p.select("p_partkey", F.array_join("p.strong", " ").alias("strong"), F.array_join("p.broad", " ").alias("broad"))


@query(rf"""WITH t AS (SELECT doc_id, list_transform(list_filter({_WORDS.format(_MATCH.format("replace(lower(text), 'in the', ' ')"))}, lambda w: length(w) >= 4), lambda w: {_SHORT.format('w')}) AS l FROM documents)
SELECT doc_id, len(list_distinct(l)) AS n_significant FROM t""")
def n09_significant_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(text.significant_tokens(F.col("text"), ["in the"])).alias("n_significant"))


@query(rf"""WITH t AS (SELECT p_partkey, list_filter({_WORDS.format(_MATCH.format('p_name'))}, lambda w: length(w) > 2) AS l FROM part)
SELECT p_partkey, CASE WHEN len(l) = 0 THEN 'other' ELSE array_to_string(list_transform(l, lambda w: {_SHORT.format('w')})[1:2], ' ') END AS present_group, array_to_string(l[1:4], ' ') AS near_key FROM t""")
def n10_presentation_groups(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", text.presentation_group(name).alias("present_group"), text.near_title_key(name).alias("near_key"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '\.[a-z0-9]{2,4}$', ''), '[^a-z0-9]+', ' ', 'g'), '\b(http|https|www)\b', ' ', 'g'), '\b[0-9]+\b', ' ', 'g'), '\s+', ' ', 'g')) AS terms FROM pages""")
def n13_file_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.file_terms(F.col("url"), ["http", "https", "www"]).alias("terms"))


@query(r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS l FROM documents),
k AS (SELECT doc_id, list_filter(l, lambda x, i: x <> '' AND (i = 1 OR lower(x) <> lower(l[i-1]))) AS l FROM w)
SELECT doc_id, len(l) AS n_words, md5(array_to_string(l, ' ')) AS kept FROM k""")
def n15_doubled_words(spark: SparkSession, sf: str) -> DataFrame:
    kept = table(spark, sf, "documents").select("doc_id", text.unrepeat(F.col("text")).alias("t"))
    return kept.select("doc_id", F.size(text.words(F.col("t"))).alias("n_words"), F.md5("t").alias("kept"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 118 THEN t ELSE CASE WHEN regexp_extract(t[:119], '^(.*) ', 1) <> '' THEN rtrim(regexp_extract(t[:119], '^(.*) ', 1)) ELSE t[:118] END END || ' | Library' AS title FROM t""")
def n16_bounded_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.bounded_title(text.squeeze(F.col("text")), " | Library").alias("title"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '__' || regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '__' || sha256(p_type || '/' || p_name || '/' || p_partkey)[:10] AS asset_id,
  CASE WHEN p_size <= 1 THEN '/parts' ELSE '/parts/page/' || p_size END AS route FROM part""")
def n17_asset_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", "p_type", "p_name", F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", keys.asset_id(F.col("p_type"), F.col("p_name"), path).alias("asset_id"), keys.page_route(F.lit("/parts"), F.col("p_size")).alias("route"))


@query(r"""SELECT p_partkey, CAST(list_reduce(list_concat([CAST(2166136261 AS HUGEINT)], list_transform(string_split(p_type, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: (xor(CAST(h AS BIGINT), CAST(c AS BIGINT))::HUGEINT * 16777619) % 4294967296) AS BIGINT) AS fnv FROM part""")
def n18_fnv1a(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", keys.fnv1a(F.col("p_type")).alias("fnv"))


@query(r"""SELECT p_brand, sha256(string_agg(p_name || '|' || p_partkey, chr(10) ORDER BY p_name || '|' || p_partkey)) AS digest FROM part GROUP BY p_brand""")
def n19_digests(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws("|", "p_name", F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").groupBy("p_brand").agg(keys.digest_of(line).alias("digest"))


@query(r"""SELECT page_id, CASE WHEN trim(u) = '' THEN 'empty' WHEN u LIKE '/%' OR regexp_matches(u, '^[A-Za-z]:') THEN 'absolute' WHEN regexp_matches(u, '(^|/)\.\.(/|$)') THEN 'parent' WHEN u LIKE '%//%' THEN 'empty-part' WHEN regexp_matches(u, '[^A-Za-z0-9/._-]') THEN 'character' END AS problem
FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url ELSE regexp_replace(url, '^https?://[^/]*/', '') END AS u FROM pages)""")
def n21_path_problems(spark: SparkSession, sf: str) -> DataFrame:
    u = F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://[^/]*/", ""))
    return table(spark, sf, "pages").select("page_id", keys.path_problem(u).alias("problem"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS readable FROM pages""")
def n22_readable_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(text.readable(F.col("html"))).alias("readable"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 0 OR p_partkey % 50 <= 0 THEN NULL WHEN p_size = p_partkey % 50 THEN 'square' WHEN p_size > p_partkey % 50 THEN 'landscape' ELSE 'portrait' END AS orientation,
  greatest(1, least(coalesce(try_cast(CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END AS INT), 1), p_size)) AS page FROM part""")
def n23_orientation_and_pages(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", keys.orientation(F.col("p_size"), F.col("p_partkey") % 50).alias("orientation"), keys.page_number(raw, F.col("p_size")).alias("page"))


@query("""SELECT CAST(year(ts) AS VARCHAR) || '-' || lpad(CAST((dayofyear(ts) - 1) // 3 AS VARCHAR), 3, '0') AS window_key, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2""")
def n24_three_day_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("window_key", keys.three_day_key(F.col("ts")))
    return e.groupBy("window_key", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(r"""SELECT p_partkey, regexp_replace(p_name || CASE WHEN p_partkey % 2 = 0 THEN '  PAGES' ELSE '' END, '\s+pages$', '', 'i') AS label FROM part""")
def n26_collection_labels(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "  PAGES").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", text.collection_label(title).alias("label"))


# filters, predicates and tags ------------------------------------------------------------------------

def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").withColumn("label", F.concat_ws(" ", "p_name", "p_type"))


RISKS = ["idiot", "trash", "disgusting"]
RULES = [("shiny", "finish", ["promo", "economy"]), ("metal", "material", ["ring", "bolt", "copper", "tin", "nickel"]), ("small", "size", ["small", "economy"])]


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars > 3000 THEN 'long' END, CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'trash') OR contains(lower(text), 'disgusting') THEN 'risk' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'digits' END], lambda x: x IS NOT NULL), ',') AS signals FROM documents""")
def f01_signals(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"long": F.col("n_chars") > 3000, "short": F.col("n_chars") < 200, "risk": tagging.any_term(F.col("text"), RISKS), "digits": F.col("text").rlike("[0-9]{4}")}
    return table(spark, sf, "documents").select("doc_id", F.array_join(tagging.codes(rules), ",").alias("signals"))


@query("""WITH tags(id, terms) AS (VALUES ('metal', ['ring','bolt','copper','tin','nickel']), ('shiny', ['promo','economy']), ('small', ['small','economy']))
SELECT p_partkey, coalesce(string_agg(id, ',' ORDER BY id), '') AS tags FROM (SELECT p.p_partkey, t.id FROM part p LEFT JOIN tags t ON len(list_filter(t.terms, lambda x: contains(lower(p.p_name || ' ' || p.p_type), x))) > 0) GROUP BY p_partkey""")
def f03_rule_tags(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "id string, tag_group string, terms array<string>")
    tagged = tagging.rule_tags(labelled(spark, sf), rules, "p_partkey", "label")
    return tagged.select("p_partkey", F.array_join("tags", ",").alias("tags"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name || ' ' || p_type), 'ring') THEN 'Ring part' WHEN contains(lower(p_name || ' ' || p_type), 'bolt') THEN 'Bolt part' ELSE p_brand END AS title, CASE WHEN contains(lower(p_name || ' ' || p_type), 'ring') THEN 0.9 WHEN contains(lower(p_name || ' ' || p_type), 'bolt') THEN 0.8 ELSE 0.4 END AS confidence FROM part""")
def f04_fallback_titles(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    rules = [(low.contains("ring"), F.lit("Ring part"), 0.9), (low.contains("bolt"), F.lit("Bolt part"), 0.8)]
    return table(spark, sf, "part").select("p_partkey", *tagging.first_rule(rules, F.col("p_brand"), 0.4, ("title", "confidence")))


@query(r"""WITH i AS (SELECT page_id, list_filter([CASE WHEN contains(url, '?') THEN 'query' END, CASE WHEN contains(url, '#') THEN 'fragment' END, CASE WHEN url LIKE 'http:%' THEN 'insecure' END, CASE WHEN regexp_matches(url, '[0-9]{3,}') THEN 'numeric' END], lambda x: x IS NOT NULL) AS issues FROM pages)
SELECT page_id, array_to_string(issues, ',') AS issues, CASE WHEN list_contains(issues, 'insecure') AND len(issues) > 1 THEN 'low' WHEN len(issues) > 0 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN list_contains(issues, 'insecure') THEN 'review' WHEN len(issues) > 0 THEN 'rewrite' ELSE 'keep' END AS action FROM i""")
def f05_name_issues(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    rules = {"query": url.contains("?"), "fragment": url.contains("#"), "insecure": url.startswith("http:"), "numeric": url.rlike("[0-9]{3,}")}
    p = table(spark, sf, "pages").select("page_id", tagging.codes(rules).alias("i"))
    bad = F.array_contains("i", "insecure")
    confidence = F.when(bad & (F.size("i") > 1), "low").when(F.size("i") > 0, "medium").otherwise("high")
    action = F.when(bad, "review").when(F.size("i") > 0, "rewrite").otherwise("keep")
    return p.select("page_id", F.array_join("i", ",").alias("issues"), confidence.alias("confidence"), action.alias("action"))


@query("""SELECT CASE WHEN toxic = 1 THEN 'review:toxic' WHEN quality = 0 THEN 'review:quality' ELSE 'auto' END AS route, count(*) AS n FROM labels GROUP BY 1""")
def f07_review_routes(spark: SparkSession, sf: str) -> DataFrame:
    route = F.when(F.col("toxic") == 1, "review:toxic").when(F.col("quality") == 0, "review:quality").otherwise("auto")
    return table(spark, sf, "labels").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@query(r"""WITH p(id, phrase) AS (VALUES ('licence', 'licensed under'), ('rights', 'all rights reserved'), ('insult', 'idiot'))
SELECT d.doc_id, p.id AS finding, (length(lower(d.text)) - length(replace(lower(d.text), p.phrase, ''))) // length(p.phrase) AS times FROM documents d JOIN p ON contains(lower(d.text), p.phrase)""")
def f09_phrase_findings(spark: SparkSession, sf: str) -> DataFrame:
    phrases = spark.createDataFrame([("licence", "licensed under"), ("rights", "all rights reserved"), ("insult", "idiot")], "id string, phrase string")
    return tagging.phrase_findings(table(spark, sf, "documents"), phrases, "doc_id", "text")


@query(rf"""WITH t AS (SELECT doc_id, unnest({_WORDS.format(_MATCH.format('text'))}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t WHERE length(w) >= 4 GROUP BY 1, 2)
SELECT doc_id, max(n) AS most, CAST(count(*) FILTER (n > 12) AS BIGINT) AS stuffed FROM c GROUP BY doc_id""")
def f11_keyword_stuffing(spark: SparkSession, sf: str) -> DataFrame:
    return tagging.stuffing(table(spark, sf, "documents"), "doc_id", "text", least=4, times=12)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
h AS (SELECT doc_id, line_no, line, strpos(lower(line), 'licen') AS col FROM l)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(col AS INT) AS col, substr(line, greatest(1, col - 20), 45) AS context FROM h WHERE col > 0""")
def f12_positional_hits(spark: SparkSession, sf: str) -> DataFrame:
    return tagging.first_hits(table(spark, sf, "documents"), "doc_id", "text", "licen", before=20, width=45)


@query(r"""WITH v AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'gs') AS visible FROM pages)
SELECT 'raw:track' AS check_id, page_id FROM v WHERE regexp_matches(html, 'track\(') UNION ALL SELECT 'raw:comment', page_id FROM v WHERE regexp_matches(html, '<!--') UNION ALL SELECT 'visible:track', page_id FROM v WHERE regexp_matches(visible, 'track\(') UNION ALL SELECT 'visible:digits', page_id FROM v WHERE regexp_matches(visible, '[0-9]{6}')""")
def f13_leak_scan(spark: SparkSession, sf: str) -> DataFrame:
    checks = [("raw:track", r"track\(", False), ("raw:comment", "<!--", False), ("visible:track", r"track\(", True), ("visible:digits", "[0-9]{6}", True)]
    return tagging.leaks(table(spark, sf, "pages"), "page_id", "html", checks)


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring') AND (contains(lower(p_name || ' ' || p_type), 'promo') OR contains(lower(p_name || ' ' || p_type), 'economy'))""")
def f14_facets_and(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("shiny", "finish", ["promo", "economy"]), ("ring", "material", ["ring"])], "id string, tag_group string, terms array<string>")
    tagged = tagging.rule_tags(labelled(spark, sf), rules, "p_partkey", "label")
    return tagged.where(tagging.has_all(F.col("tags"), ["shiny", "ring"])).select("p_partkey")


@query("""SELECT DISTINCT p_type AS hub, CASE WHEN regexp_matches(p_type, '^STANDARD') THEN 'base' WHEN regexp_matches(p_type, 'O$|M') THEN 'metal' ELSE 'other' END AS kind FROM part""")
def f16_hub_kinds(spark: SparkSession, sf: str) -> DataFrame:
    kinds = tagging.first_match(F.col("hub"), [("^STANDARD", "base"), ("O$|M", "metal")], "other")
    return table(spark, sf, "part").select(F.col("p_type").alias("hub")).distinct().select("hub", kinds.alias("kind"))


@query("""WITH k AS (SELECT p_type AS hub, count(*) AS n, CASE WHEN regexp_matches(p_type, '^STANDARD') THEN 'base' ELSE 'other' END AS section FROM part GROUP BY 1)
SELECT section, hub, n, row_number() OVER (PARTITION BY section ORDER BY n DESC, hub) AS rank FROM k""")
def f19_sections(spark: SparkSession, sf: str) -> DataFrame:
    hubs = table(spark, sf, "part").groupBy(F.col("p_type").alias("hub")).agg(F.count("*").alias("n"))
    return tagging.sections(hubs, F.col("hub"), [("^STANDARD", "base")], "other", [F.desc("n"), F.asc("hub")])


@query(r"""WITH p(id, pattern) AS (VALUES ('shout', '!!'), ('symbols', '[#$%&*]{3}'), ('digits', '[0-9]{5,}')) SELECT p.id AS defect, count(*) AS n, min(d.doc_id) AS example FROM documents d JOIN p ON regexp_matches(d.text, p.pattern) GROUP BY 1""")
def f20_defect_counts(spark: SparkSession, sf: str) -> DataFrame:
    patterns = [("shout", "!!"), ("symbols", "[#$%&*]{3}"), ("digits", "[0-9]{5,}")]
    return tagging.defect_counts(table(spark, sf, "documents"), "doc_id", "text", patterns)
