"""Queries on names: classes that give an answer away, by the formation of words, and what facts are worth by their names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fact_quality as Q
from ..operators import word_formation as W
from ..sources import tables as T
from .catalogue import query

SUFFIXES = ", ".join(f"('{s}')" for s in W.EXTENDED.suffixes)
NAMES = ", ".join(f"('{s}')" for s in W.EPONYMIC)
STEM = "CASE WHEN {0} LIKE '%es' AND len({0}) >= 6 THEN left({0}, -2) WHEN {0} LIKE '%s' AND len({0}) >= 5 THEN left({0}, -1) ELSE {0} END"
WORDS = r"""answers AS (SELECT page_id AS answer, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '[^ -.0-~]', '', 'g') AS name FROM pages),
classes AS (SELECT item_id AS class, regexp_replace(text, '[^ -.0-~]', '', 'g') AS name FROM benchmark),
brief AS (SELECT DISTINCT answer, w FROM (SELECT answer, unnest(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')) AS w FROM answers) WHERE len(w) >= 3),
other AS (SELECT DISTINCT class, w FROM (SELECT class, unnest(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')) AS w FROM classes) WHERE len(w) >= 4),
mine AS (SELECT DISTINCT w FROM brief WHERE len(w) >= 4), theirs AS (SELECT DISTINCT w FROM other)"""


def derived(name: str, source: str) -> str:
    return f"""{name}1 AS (SELECT w, left(w, -len(s)) AS stem, s AS path FROM {source}, (VALUES {SUFFIXES}) v(s) WHERE suffix(w, s) AND len(w) - len(s) >= 6),
{name} AS (SELECT * FROM {name}1 UNION SELECT w, left(stem, -len(s)), path || '_' || s FROM {name}1, (VALUES {SUFFIXES}) v(s) WHERE suffix(stem, s) AND len(stem) - len(s) >= 6)"""


def within(source: str, cut: str, side: str, columns: str) -> str:
    x = STEM.format("w")
    return f"""SELECT {columns}, '{side}_DERIVATIONAL_' || upper(path) || '_D' || damerau_levenshtein(p.x, c.stem) AS kind FROM (SELECT w, {x} AS x FROM {source} WHERE len({x}) >= 6) p
JOIN {cut} c ON abs(len(p.x) - len(c.stem)) <= 1 AND damerau_levenshtein(p.x, c.stem) <= 1"""


LEAKS = (
    WORDS + ", " + derived("cuttheirs", "theirs") + ", " + derived("cutmine", "mine") + f""",
found AS ({within('mine', 'cuttheirs', 'CLASS', 'p.w AS a, c.w AS b')} UNION {within('theirs', 'cutmine', 'ANSWER', 'c.w AS a, p.w AS b')}
  UNION SELECT a.w, t.w, 'CLASS_EPONYMIC_EXACT_' || upper(s) || '_D0' FROM theirs t, (VALUES {NAMES}) v(s) JOIN (SELECT DISTINCT w, {STEM.format('w')} AS st FROM brief) a ON suffix(t.w, s) AND len(t.w) - len(s) >= 3 AND (left(t.w, -len(s)) = a.w OR left(t.w, -len(s)) = a.st))"""
)


@query("WITH " + LEAKS + " SELECT answer, class, list_aggregate(list_sort(list(DISTINCT a || '~' || b || ':' || kind)), 'string_agg', ';') AS evidence FROM brief JOIN found ON brief.w = found.a JOIN other ON other.w = found.b GROUP BY answer, class")
def word_formation_leaks(spark, d):
    """Pages whose title has a word that is derived from one of a benchmark item, or the other way round."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    plain = lambda c: F.regexp_replace(c, "[^ -.0-~]", "").alias("name")  # noqa: E731  SQL counts edits in bytes
    answers = T.read(spark, d, "pages").select(F.col("page_id").alias("answer"), plain(title))
    classes = T.read(spark, d, "benchmark").select(F.col("item_id").alias("class"), plain(F.col("text")))
    return W.class_leaks(answers, classes, ascii_only=True).withColumn("evidence", F.array_join("evidence", ";"))


NEAR = r"""t AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[a-z]+')) AS w FROM pages)),
b AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark))"""


@query("WITH " + NEAR + " SELECT t.w AS x, b.w AS y, damerau_levenshtein(t.w, b.w)::INT AS edits FROM t JOIN b ON abs(len(t.w) - len(b.w)) <= 1 AND damerau_levenshtein(t.w, b.w) <= 1")
def near_spellings(spark, d):
    """Words of page titles and of benchmark items that are at most one edit apart."""
    words = lambda df, c: df.select(F.explode(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)).alias("word"))
    return W.near_words(words(T.read(spark, d, "pages"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), words(T.read(spark, d, "benchmark"), F.col("text")))


# -- fact quality ----------------------------------------------------------------------------------------------------

RESOURCE = "http://kg.example.org/resource/"
POLICY = Q.QualityPolicy(rejected={"size": "PREDICATE_RAW_LAYOUT_SLOT"}, tiers={"type": 1, "brand": 2, "page": 2}, tiers_by_direction={("brand", "OUT"): 1, ("brand", "IN"): 3}, templates={("type", "OUT"): "OUT_TYPE", ("brand", "OUT"): "OUT_BRAND"},
                         namespaces=(RESOURCE,), archives=("example.net",), media=(".png",), longest=6)
QUALITY = r"""f AS (SELECT 'http://kg.example.org/resource/' || replace(p_name, ' ', '_') AS answer, predicate, 'OUT' AS direction, object, p_partkey FROM (
  SELECT p_partkey, p_name, 'type' AS predicate, 'http://kg.example.org/resource/' || p_type AS object FROM part UNION ALL SELECT p_partkey, p_name, 'brand', 'http://kg.example.org/resource/' || replace(p_brand, '#', '_') FROM part
  UNION ALL SELECT p_partkey, p_name, 'size', 'http://kg.example.org/resource/' || p_size FROM part UNION ALL SELECT p_partkey, p_name, 'page', url FROM part JOIN pages ON page_id = p_partkey)),
u AS (SELECT *, lower(regexp_extract(object, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS host, regexp_extract(regexp_extract(object, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)', 2), '([^/]*)$', 1) AS tail FROM f),
n AS (SELECT *, CASE WHEN tail <> '' THEN tail ELSE regexp_extract(object, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?', 1) END AS local FROM u),
l AS (SELECT *, trim(replace(local, '_', ' ')) AS label, regexp_replace(replace(local, '_', ' '), '[^A-Za-z0-9]', '', 'g') AS alnum, list_filter(regexp_extract_all(lower(local), '[a-z0-9]+'), lambda x: len(x) >= 4) AS other, list_filter(regexp_extract_all(lower(regexp_extract(answer, '([^/]*)$', 1)), '[a-z0-9]+'), lambda x: len(x) >= 4) AS own FROM n),
p AS (SELECT p_partkey, predicate, a, b, """ + STEM.format("a") + " AS sa, " + STEM.format("b") + r""" AS sb FROM (SELECT p_partkey, predicate, unnest(own) AS a, other FROM l) x, unnest(x.other) t(b)),
k AS (SELECT p_partkey, predicate, bool_or(a = b OR sa = sb OR (starts_with(a, b) AND len(b) >= 5) OR (starts_with(b, a) AND len(a) >= 5)) AS hard, bool_or(left(a, 4) = left(b, 4)) AS soft FROM p GROUP BY 1, 2),
q AS (SELECT l.*, coalesce(hard, false) AS hard, coalesce(soft, false) AND NOT coalesce(hard, false) AS soft, CASE WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'OBJECT_WEB_ARCHIVE_URL' WHEN NOT starts_with(object, 'http://kg.example.org/resource/') THEN 'OBJECT_EXTERNAL_URL' WHEN lower(local) LIKE '%.png' THEN 'OBJECT_MEDIA_FILE'
  WHEN len(label) < 1 THEN 'OBJECT_EMPTY_LABEL' WHEN len(label) > 6 THEN 'OBJECT_LABEL_TOO_LONG' WHEN alnum <> '' AND len(regexp_replace(alnum, '[^0-9]', '', 'g')) / len(alnum)::DOUBLE >= 0.6 THEN 'OBJECT_MACHINE_IDENTIFIER' END AS why FROM l LEFT JOIN k ON k.p_partkey = l.p_partkey AND k.predicate = l.predicate)"""


@query("WITH " + QUALITY + """ SELECT answer, predicate, direction, object, p_partkey, label, CASE predicate WHEN 'type' THEN 1 WHEN 'brand' THEN 1 WHEN 'page' THEN 2 ELSE 3 END AS tier, CASE predicate WHEN 'type' THEN 'OUT_TYPE' WHEN 'brand' THEN 'OUT_BRAND' ELSE 'UNKNOWN' END AS template, predicate IN ('type', 'brand') AS verbal, soft,
len(label)::INT AS label_length, len(regexp_extract_all(lower(local), '[a-z0-9]+'))::INT AS words, array_to_string(list_filter([CASE WHEN predicate = 'size' THEN 'PREDICATE_RAW_LAYOUT_SLOT' END, why, CASE WHEN hard THEN 'ANSWER_LEXICAL_LEAK' END], lambda x: x IS NOT NULL), ',') AS reasons,
NOT (predicate = 'size' OR why IS NOT NULL OR hard) AS eligible FROM q""")
def fact_quality(spark, d):
    """Facts of parts and the pages of their number: eligibility with reasons, tier, template, soft leaks."""
    part, pages = T.read(spark, d, "part"), T.read(spark, d, "pages")
    answer = F.concat(F.lit(RESOURCE), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("answer")
    fact = lambda df, predicate, value: df.select("p_partkey", answer, F.lit(predicate).alias("predicate"), F.lit("OUT").alias("direction"), value.alias("object"))
    here = lambda c: F.concat(F.lit(RESOURCE), c)
    facts = fact(part, "type", here(F.col("p_type"))).unionByName(fact(part, "brand", here(F.replace("p_brand", F.lit("#"), F.lit("_"))))).unionByName(fact(part, "size", here(F.col("p_size").cast("string"))))
    facts = facts.unionByName(fact(part.join(pages, F.col("page_id") == F.col("p_partkey")), "page", F.col("url")))
    return Q.assess(facts, POLICY, ascii_only=True).withColumn("reasons", F.array_join("reasons", ","))
