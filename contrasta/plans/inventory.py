"""Further queries: names and texts, contracts, evidence and rationales, lookups over triples, run metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import contracts as C
from ..operators import evidence as E
from ..operators import lookups as U
from ..operators import ranking as R
from ..operators import rationale as P
from ..sources import tables as T
from .catalogue import EVIDENCE, MASKS, POLICY, RATIONALES, SETS, SQL, TIERS, TRIPLES, VECTORS, cands, evidence, facts, matrix, period_edges, query, rationales, searched, select_distractors

RESOURCE = "http://kg.example.org/resource/"

# -- names and texts -------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, CASE WHEN w LIKE '%es' AND len(w) >= 6 THEN w[:-3] WHEN w LIKE '%s' AND len(w) >= 5 THEN w[:-2] ELSE w END AS stem,
(SELECT count(*) FROM range(1, least(len(w), len(b)) + 1) t(i) WHERE substr(w, 1, i) = substr(b, 1, i)) AS prefix FROM (SELECT p_partkey, split_part(p_name, ' ', 2) || CASE p_partkey % 3 WHEN 0 THEN 's' WHEN 1 THEN 'es' ELSE '' END AS w, split_part(p_name, ' ', 2) || 'x' AS b FROM part)""")
def plural_stem_and_prefix(spark, d):
    t = T.read(spark, d, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("x"))
    t = t.select("p_partkey", F.concat("x", F.when(F.col("p_partkey") % 3 == 0, "s").when(F.col("p_partkey") % 3 == 1, "es").otherwise("")).alias("w"), F.concat("x", F.lit("x")).alias("b"))
    return t.select("p_partkey", X.plural_stem(F.col("w")).alias("stem"), X.shared_prefix(F.col("w"), F.col("b")).cast("long").alias("prefix"))


NOTES = "notes AS (SELECT p_partkey, replace(p_name, ' ', '_') || ' (' || p_type || '), a ' || p_brand || ' part!' AS note, p_name FROM part)"


def notes(spark, d):
    return T.read(spark, d, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" ("), "p_type", F.lit("), a "), "p_brand", F.lit(" part!")).alias("note"), "p_name")


@query("WITH " + NOTES + r""", m AS (SELECT p_partkey, p_name, note, lower(trim(regexp_replace(regexp_replace(regexp_replace(replace(note, '_', ' '), '\([^)]*\)', ' ', 'g'), '[^a-zA-Z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS form FROM notes)
SELECT p_partkey, form, list_aggregate(list_sort(list_distinct(list_filter(string_split(form, ' '), lambda t: len(t) >= 4 AND t NOT IN ('part', 'brand')))), 'string_agg', ' ') AS content, contains(' ' || form || ' ', ' ' || p_name || ' ') AS has_name, trim(regexp_replace(note, '\s*\([^)]*\)', '', 'g')) AS bare FROM m""")
def matching_forms(spark, d):
    form = X.for_matching(F.col("note"), ascii_only=True)
    m = notes(spark, d).withColumn("form", form)
    content = F.array_join(X.content_words(F.col("form"), 4, ("part", "brand")), " ")
    return m.select("p_partkey", "form", F.when(content != "", content).alias("content"), X.contains_phrase(F.col("form"), F.col("p_name")).alias("has_name"), X.without_parenthetical(F.col("note")).alias("bare"))


@query(r"""WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type) || ' ' || p_name || ' kit', ' ') AS b FROM part)
SELECT p_partkey, CASE WHEN b[2:3] = a THEN 1 END AS place FROM t""")
def answer_name_containment(spark, d):
    t = T.read(spark, d, "part")
    return t.select("p_partkey", X.name_inside(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name", F.lit("kit")), ascii_only=True).alias("place"))


@query("SELECT a.p_partkey, least(damerau_levenshtein(a.p_name, b.p_name), 2)::INT AS edits FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def bounded_edit_distance(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", "p_name")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(b, "p_partkey").select("p_partkey", X.edit_distance(1)(F.col("p_name"), F.col("other")).alias("edits"))


@query(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS words, greatest(1, round_even(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) * 1.3, 0))::INT AS tokens,
len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]'), lambda s: regexp_matches(s, '[^ \t-\r]'))) AS sentences FROM documents""")
def text_sizes(spark, d):
    t = T.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return t.select("doc_id", X.n_words(F.col("text")).cast("long").alias("words"), X.estimated_tokens(F.col("text")).alias("tokens"), X.n_sentences(F.col("text")).cast("long").alias("sentences"))


CATEGORIES = "forms AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Category:' || c_mktsegment WHEN 1 THEN 'dbc:' || c_mktsegment || ' x' WHEN 2 THEN c_mktsegment WHEN 3 THEN 'http://kg.example.org/resource/Category:' || c_mktsegment WHEN 4 THEN 'http://other.example.org/Category:' || c_mktsegment WHEN 5 THEN c_mktsegment || '/x' ELSE '<' || c_mktsegment || '>' END AS f FROM customer)"


@query("WITH " + CATEGORIES + """, n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 IN (4, 5) THEN NULL ELSE replace(regexp_replace(regexp_replace(f, '^<|>$', '', 'g'), '^(http://kg.example.org/resource/Category:|Category:|dbc:)', ''), ' ', '_') END AS x FROM forms)
SELECT c_custkey, 'http://kg.example.org/resource/Category:' || x AS category, 'http://kg.example.org/resource/' || x AS resource FROM n""")
def category_names(spark, d):
    s, k = F.col("c_mktsegment"), F.col("c_custkey") % 7
    form = F.when(k == 0, F.concat(F.lit("Category:"), s)).when(k == 1, F.concat(F.lit("dbc:"), s, F.lit(" x"))).when(k == 2, s).when(k == 3, F.concat(F.lit(RESOURCE + "Category:"), s)).when(k == 4, F.concat(F.lit("http://other.example.org/Category:"), s)).when(k == 5, F.concat(s, F.lit("/x"))).otherwise(F.concat(F.lit("<"), s, F.lit(">")))
    t = T.read(spark, d, "customer").select("c_custkey", form.alias("f"))
    return t.select("c_custkey", X.category_name(F.col("f"), RESOURCE + "Category:").alias("category"), X.category_resource(F.col("f"), RESOURCE + "Category:").alias("resource"))


@query(r"""SELECT page_id, left(CASE WHEN x = '' THEN 'answer' ELSE x END, 72) AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS x FROM pages)""")
def url_slugs(spark, d):
    return T.read(spark, d, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@query("SELECT p_partkey, p_name AS title FROM part")
def page_titles(spark, d):
    uri = F.concat(F.lit("<" + RESOURCE), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(">"))
    return T.read(spark, d, "part").select("p_partkey", X.page_title(uri, RESOURCE).alias("title"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS at FROM events")
def iso_times(spark, d):
    return T.read(spark, d, "events").select("event_id", X.iso_utc(F.col("ts")).alias("at"))


@query("""SELECT event_id, CASE WHEN s BETWEEN 200 AND 299 THEN NULL WHEN s IN (408, 425, 429, 500, 502, 503, 504) THEN 'RETRYABLE_FAILURE' WHEN s BETWEEN 400 AND 499 THEN 'PERMANENT_QUERY_REJECTED' ELSE 'RETRYABLE_FAILURE' END AS kind,
least(60.0::DOUBLE, 0.5 * pow(2.0, greatest(0, event_id % 12 - 1))) AS wait FROM (SELECT event_id, 200 + event_id % 310 AS s FROM events)""")
def retry_plan(spark, d):
    e = T.read(spark, d, "events")
    return e.select("event_id", X.http_class(200 + F.col("event_id") % 310).alias("kind"), X.backoff(F.col("event_id") % 12, 0.5, 60.0).alias("wait"))


@query("SELECT page_id, sha256('https://q.example.org' || chr(10) || html) AS fingerprint FROM pages")
def query_fingerprints(spark, d):
    return T.read(spark, d, "pages").select("page_id", X.query_fingerprint(F.lit("https://q.example.org"), F.col("html")).alias("fingerprint"))


@query(r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 2 THEN false END AS flag, CASE WHEN event_id % 3 < 2 THEN value END AS number, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END::INT AS first FROM events""")
def strict_parsing(spark, d):
    e, i = T.read(spark, d, "events"), F.col("event_id")
    flag = F.when(i % 4 == 0, "true").when(i % 4 == 1, "False").when(i % 4 == 2, "false").otherwise("")
    number = F.when(i % 3 == 0, F.col("value").cast("string")).when(i % 3 == 1, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise("nan")
    lines = F.concat((i % 5).cast("string"), F.lit("-9"))
    return e.select("event_id", X.strict_bool(flag).alias("flag"), X.strict_float(number).alias("number"), X.line_range(lines)["first"].alias("first"))


# -- evidence and rationales -----------------------------------------------------------------------------------------


@query("WITH " + EVIDENCE + " SELECT key, value AS claim, obj, relation FROM rel")
def semantic_relations(spark, d):
    return E.classify(E.observed(cands(spark, d), facts(spark, d)).where("obj is not null"), period_edges(spark, d), POLICY)


@query("WITH " + EVIDENCE + " SELECT answer, cand, pos, key, value, level, reason, basis, risk FROM evidence")
def evidence_levels(spark, d):
    return evidence(spark, d).drop("score")


@query("WITH " + EVIDENCE + " SELECT basis, risk, level, count(*) AS n FROM evidence GROUP BY 1, 2, 3")
def exclusion_basis_counts(spark, d):
    return evidence(spark, d).groupBy("basis", "risk", "level").agg(F.count("*").alias("n"))


@query("WITH " + EVIDENCE + """, b AS (SELECT answer, cand, max(level) AS best FROM evidence GROUP BY 1, 2)
SELECT answer, CASE min(best) WHEN 0 THEN 'NOT_COVERED' WHEN 1 THEN 'L0' WHEN 2 THEN 'L1' ELSE 'L2' END AS weakest, CASE count(*) FILTER (WHERE best >= 2) WHEN 8 THEN 'FULL' WHEN 0 THEN 'ZERO' ELSE 'PARTIAL_' || count(*) FILTER (WHERE best >= 2) || '_OF_8' END AS coverage FROM b GROUP BY 1""")
def answer_evidence_level(spark, d):
    best = matrix(spark, d).groupBy("answer", "cand").agg(F.max("level").alias("best"))
    per = best.groupBy("answer").agg(F.collect_list("best").alias("ls"), F.count_if(F.col("best") >= 2).alias("n"))
    return per.select("answer", E.weakest(F.col("ls")).alias("weakest"), E.coverage_status(F.col("n"), 8).alias("coverage"))


@query("WITH " + MASKS + """, a AS (SELECT * FROM sizes WHERE lv = 1 AND size <= 3), b AS (SELECT * FROM sizes WHERE lv = 2), c AS (SELECT * FROM sizes WHERE lv = 3)
SELECT a.answer, a.i, a.j, a.k, a.size, CASE WHEN c.size = a.size THEN 3 WHEN b.size = a.size THEN 2 ELSE 1 END AS level FROM a LEFT JOIN b ON b.answer = a.answer AND b.i = a.i AND b.j = a.j AND b.k = a.k LEFT JOIN c ON c.answer = a.answer AND c.i = a.i AND c.j = a.j AND c.k = a.k""")
def strongest_level_of_minimum(spark, d):
    return P.strongest_level(cands(spark, d), matrix(spark, d))


FIELDS = ["min_level", "l2", "l1", "l0", "scoped", "risk", "conflicts", "soft", "tier", "unverbal", "label_length", "tokens", "repeats", "anonymity", "direct"]


def built(spark, d):
    """The rationales of each answer's chosen combination."""
    return P.of_chosen(rationales(spark, d)).select(*P.TRIPLE, "size", "facts", *FIELDS)


#: The rationales of the chosen combination alone.
CHOSEN = RATIONALES + """, bb AS (SELECT b.*, p.sum_rank FROM built b JOIN p ON p.answer = b.answer AND p.i = b.i AND p.j = b.j AND p.k = b.k),
win AS (SELECT answer, i, j, k FROM bb QUALIFY row_number() OVER (PARTITION BY answer ORDER BY -min_level, -l2, -l1, l0, -scoped, risk, soft, tier, unverbal, label_length, tokens, repeats, direct, facts, sum_rank, i, j, k) = 1),
mine AS (SELECT b.* FROM built b JOIN win w ON w.answer = b.answer AND w.i = b.i AND w.j = b.j AND w.k = b.k)"""


@query("WITH " + CHOSEN + " SELECT answer, i, j, k, size, list_aggregate(facts, 'string_agg', ';') AS facts, " + ", ".join(FIELDS) + " FROM mine")
def minimum_rationales(spark, d):
    return built(spark, d).withColumn("facts", F.array_join("facts", ";"))


ORDERS = {1: "-min_level, -l2, -l1, l0, -scoped, risk, ", 2: "-min_level, -l2, -l1, l0, -scoped, risk, conflicts, ", 3: "-min_level, -l2, -l1, l0, risk, conflicts, -scoped, "}


@query("WITH " + CHOSEN + ", v AS (" + " UNION ALL ".join(f"SELECT {n} AS version, answer, facts, row_number() OVER (PARTITION BY answer ORDER BY {o} soft, tier, unverbal, label_length, tokens, repeats, direct, facts) AS place FROM mine" for n, o in ORDERS.items()) + ") SELECT version, answer, place, list_aggregate(facts, 'string_agg', ';') AS facts FROM v")
def rationale_ranking(spark, d):
    """Every least rationale of the chosen combination in the order of each version of the key."""
    by = lambda version: F.row_number().over(Window.partitionBy("answer").orderBy(P.ranking_key(version)))
    places = F.array(*[F.struct(F.lit(v).alias("version"), by(v).alias("place")) for v in (1, 2, 3)])
    rows = built(spark, d).select("answer", "facts", places.alias("places")).select("answer", "facts", F.explode("places").alias("x"))
    return rows.select("x.version", "answer", "x.place", F.array_join("facts", ";").alias("facts"))


@query("WITH " + EVIDENCE + """, s AS (SELECT c.answer, c.cand, c.pos, coalesce(max(level), 0) AS best, count(*) FILTER (WHERE level = 3) AS l2, count(*) FILTER (WHERE level = 2) AS l1,
  coalesce(min(CASE WHEN level >= 2 THEN CASE key WHEN 'priority' THEN 1 WHEN 'year' THEN 3 ELSE 2 END END), 4) AS tier, count(*) FILTER (WHERE risk <> 'NONE') AS risk FROM cands c LEFT JOIN evidence e ON e.answer = c.answer AND e.cand = c.cand GROUP BY 1, 2, 3)
SELECT answer, cand, row_number() OVER (PARTITION BY answer ORDER BY -best, -l2, -l1, tier, risk, pos, cand) AS turn FROM s""")
def candidate_rescue_order(spark, d):
    tier = F.create_map(*[F.lit(x) for p in sorted(TIERS.items()) for x in p])[F.col("key")]
    e = evidence(spark, d).groupBy("answer", "cand").agg(F.max("level").alias("best"), F.count_if(F.col("level") == 3).alias("l2"), F.count_if(F.col("level") == 2).alias("l1"), F.min(F.when(F.col("level") >= 2, tier)).alias("tier"), F.count_if(F.col("risk") != "NONE").alias("risk"))
    rows = cands(spark, d).join(e, ["answer", "cand"], "left").na.fill({"best": 0, "l2": 0, "l1": 0, "tier": 4, "risk": 0})
    order = Window.partitionBy("answer").orderBy(F.desc("best"), F.desc("l2"), F.desc("l1"), "tier", "risk", "pos", "cand")
    return rows.select("answer", "cand", F.row_number().over(order).alias("turn"))


# -- contracts -------------------------------------------------------------------------------------------------------


@query("WITH " + EVIDENCE + ", w AS (SELECT answer, cand, key, value, level, CASE WHEN answer % 97 = 0 THEN 'FORMAL_PROOF' ELSE basis END AS basis FROM evidence) SELECT answer, cand, key, value, level, basis FROM w WHERE (level <= 1 AND basis <> 'NONE') OR (level = 2 AND basis NOT IN ('NONE', 'SCOPED_EMPIRICAL')) OR (level = 3 AND basis <> 'FORMAL_PROOF')")
def exclusion_basis_violations(spark, d):
    rows = evidence(spark, d).withColumn("basis", F.when(F.col("answer") % 97 == 0, "FORMAL_PROOF").otherwise(F.col("basis")))
    return E.basis_violations(rows.select("answer", "cand", "key", "value", "level", "basis"))


BROKEN = """broken AS (SELECT answer, CASE WHEN answer % 11 = 0 AND pos = 2 THEN answer ELSE cand END AS cand, CASE WHEN answer % 13 = 0 AND pos = 3 THEN 9 ELSE pos END AS rank, CASE WHEN answer % 17 = 0 AND pos = 4 THEN 'nan'::DOUBLE WHEN answer % 19 = 0 AND pos = 5 THEN 2.0 ELSE score END AS score FROM cands)"""


def broken(spark, d):
    a, pos = F.col("answer"), F.col("pos")
    return cands(spark, d).select("answer", F.when((a % 11 == 0) & (pos == 2), a).otherwise(F.col("cand")).alias("cand"), F.when((a % 13 == 0) & (pos == 3), 9).otherwise(pos).alias("rank"), F.when((a % 17 == 0) & (pos == 4), float("nan")).when((a % 19 == 0) & (pos == 5), 2.0).otherwise(F.col("score")).alias("score"))


@query("WITH " + SETS + ", " + BROKEN + """ SELECT answer, min(rank) <> 1 OR max(rank) <> count(*) OR count(DISTINCT rank) <> count(*) AS ranks, count(DISTINCT cand) <> count(*) AS repeats, bool_or(cand = answer) AS own, bool_or(isnan(score) OR isinf(score)) AS scores FROM broken GROUP BY answer""")
def roster_violations(spark, d):
    return C.roster(broken(spark, d))


@query("WITH " + SETS + ", " + BROKEN + """, o AS (SELECT *, lag(score) OVER w AS s, lag(cand) OVER w AS c, row_number() OVER w AS place FROM broken WHERE NOT isnan(score) WINDOW w AS (PARTITION BY answer ORDER BY rank))
SELECT answer, bool_or(rank <> place) AS gaps, coalesce(bool_or(score > s), false) AS rises, coalesce(bool_or(score = s AND cand < c), false) AS ties FROM o GROUP BY answer""")
def ranking_order_violations(spark, d):
    return C.ranking_order(broken(spark, d).where(~F.isnan("score")))


@query("WITH p AS (SELECT n_nationkey % 9 AS slot, n_name AS answer FROM nation) SELECT slot, count(*) AS n, count(DISTINCT answer) AS answers FROM p GROUP BY slot HAVING count(*) > 1")
def policy_slot_duplicates(spark, d):
    return C.repeated(T.read(spark, d, "nation").select((F.col("n_nationkey") % 9).alias("slot"), F.col("n_name").alias("answer")), "slot", "answer")


@query("SELECT doc_id, 'the claim is false' AS text FROM documents WHERE doc_id % 10 = 0")
def negative_claims(spark, d):
    t = T.read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "the claim is false").otherwise("another value is observed").alias("text"))
    return t.where(F.size(X.negative_claims(F.col("text"))) > 0)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'o_orderpriority' END AS missing FROM orders")
def missing_fields(spark, d):
    o = T.read(spark, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    return o.select("o_orderkey", F.array_join(C.missing(["o_orderkey", "o_custkey", "o_orderpriority"]), ",").alias("m")).select("o_orderkey", F.when(F.col("m") != "", F.col("m")).alias("missing"))


# -- lookups over triples --------------------------------------------------------------------------------------------


@query("WITH " + TRIPLES + " SELECT s AS entity, p, o FROM (SELECT DISTINCT s, p, o, row_number() OVER (PARTITION BY s ORDER BY p, o) AS k FROM (SELECT DISTINCT s, p, o FROM triples WHERE starts_with(s, 'p') AND starts_with(o, 'brand:') OR starts_with(s, 'p') AND starts_with(o, 'type:'))) WHERE k <= 2")
def entity_categories(spark, d):
    t = T.triples(spark, d).where("s like 'p%' and (o like 'brand:%' or o like 'type:%')")
    return U.per_entity(t.select(F.col("s").alias("entity"), "p", "o").distinct(), "entity", ["p", "o"], 2)


@query("WITH " + TRIPLES + " SELECT o AS category, count(DISTINCT s) AS members, count(*) AS rows_ FROM triples WHERE p IN ('brand', 'type', 'segment') GROUP BY 1")
def category_member_counts(spark, d):
    t = T.triples(spark, d).where(F.col("p").isin("brand", "type", "segment"))
    return t.groupBy(F.col("o").alias("category")).agg(F.countDistinct("s").alias("members"), F.count("*").alias("rows_"))


@query("WITH " + TRIPLES + ", m AS (SELECT DISTINCT o AS category, s AS member FROM triples WHERE p = 'type') SELECT category, member FROM m ORDER BY category, member LIMIT 500")
def class_members_batch(spark, d):
    """One ordered answer for many classes, with a budget of rows for all."""
    return T.triples(spark, d).where("p = 'type'").select(F.col("o").alias("category"), F.col("s").alias("member")).distinct().orderBy("category", "member").limit(500)


HOPS = "hops AS (SELECT c_custkey AS src, c_custkey + 3 AS dst FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT c_custkey, c_custkey - 3 FROM customer WHERE c_custkey % 44 = 0), ends AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey % 3 <> 0)"


def hops(spark, d):
    c = T.read(spark, d, "customer")
    h = c.where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 3).alias("dst")).union(c.where("c_custkey % 44 = 0").select("c_custkey", F.col("c_custkey") - 3))
    return h, T.read(spark, d, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("id")).distinct()


@query("WITH " + HOPS + """, a AS (SELECT c_custkey AS member, h1.dst AS d1, h2.dst AS d2, h3.dst AS d3 FROM customer LEFT JOIN hops h1 ON h1.src = c_custkey LEFT JOIN hops h2 ON h2.src = h1.dst LEFT JOIN hops h3 ON h3.src = h2.dst)
SELECT member, CASE WHEN e0.id IS NOT NULL THEN 'EXACT' WHEN d1 IS NULL THEN 'NO_REDIRECT' WHEN e1.id IS NOT NULL THEN 'RESOLVED' WHEN d1 = member THEN 'CYCLE' WHEN d2 IS NULL THEN 'NOT_LOCAL' WHEN d2 IN (member, d1) THEN 'CYCLE' WHEN e2.id IS NOT NULL THEN 'RESOLVED' WHEN d3 IS NULL THEN 'NOT_LOCAL' WHEN d3 IN (member, d1, d2) THEN 'CYCLE' WHEN e3.id IS NOT NULL THEN 'RESOLVED' ELSE 'HOP_BUDGET' END AS status,
CASE WHEN e0.id IS NOT NULL THEN e0.id WHEN e1.id IS NOT NULL THEN e1.id WHEN d1 IS NULL OR d1 = member OR d2 IS NULL OR d2 IN (member, d1) THEN NULL WHEN e2.id IS NOT NULL THEN e2.id WHEN d3 IS NULL OR d3 IN (member, d1, d2) THEN NULL ELSE e3.id END AS node
FROM a LEFT JOIN ends e0 ON e0.id = member LEFT JOIN ends e1 ON e1.id = d1 LEFT JOIN ends e2 ON e2.id = d2 LEFT JOIN ends e3 ON e3.id = d3""")
def redirect_resolution(spark, d):
    h, ends = hops(spark, d)
    return U.resolve(T.read(spark, d, "customer").select(F.col("c_custkey").alias("member")), h, ends, 3)


@query("WITH " + HOPS + " SELECT dst AS target, min(src) AS first, count(*) AS aliases FROM hops GROUP BY dst")
def reverse_redirects(spark, d):
    return hops(spark, d)[0].groupBy(F.col("dst").alias("target")).agg(F.min("src").alias("first"), F.count("*").alias("aliases"))


@query("WITH " + HOPS + """, a AS (SELECT c_custkey AS answer, coalesce(min(h.dst), c_custkey) AS target FROM customer LEFT JOIN hops h ON h.src = c_custkey GROUP BY c_custkey),
x AS (SELECT answer, answer AS node, 0 AS step FROM a UNION SELECT answer, target, 1 FROM a UNION SELECT a.answer, h.src, 2 FROM a JOIN hops h ON h.dst = a.target),
g AS (SELECT answer, step, count(DISTINCT node) AS n, min(node) AS node FROM x JOIN ends e ON e.id = x.node GROUP BY 1, 2), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY answer ORDER BY step) = 1)
SELECT a.answer, CASE WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status, CASE WHEN n = 1 THEN node END AS node, CASE WHEN n = 1 THEN step END AS step FROM a LEFT JOIN f ON f.answer = a.answer""")
def answer_identity(spark, d):
    h, ends = hops(spark, d)
    return U.identity(T.read(spark, d, "customer").select(F.col("c_custkey").alias("answer")), h, ends)


@query("SELECT c_custkey AS uri, c_custkey - 1 AS turn, CASE WHEN o.id IS NOT NULL THEN 'FOUND' ELSE 'MISSING' END AS status FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS id FROM orders) o ON o.id = c_custkey")
def batched_lookup(spark, d):
    wanted = T.read(spark, d, "customer").select(F.col("c_custkey").alias("uri"), (F.col("c_custkey") - 1).alias("turn"))
    return U.found_or_missing(wanted, T.read(spark, d, "orders").select(F.col("o_custkey").alias("uri")))


@query("WITH " + TRIPLES + ", e AS (SELECT s, count(*) AS n FROM (SELECT DISTINCT s, p FROM triples WHERE p IN ('brand', 'suppliedBy')) GROUP BY 1) SELECT p_partkey, CASE WHEN e.n IS NULL THEN 'UNKNOWN' WHEN x.s IS NOT NULL THEN 'SUPPLIED' ELSE 'NOT_SUPPLIED' END AS kind FROM part LEFT JOIN e ON e.s = 'p' || p_partkey LEFT JOIN (SELECT DISTINCT s FROM triples WHERE p = 'suppliedBy') x ON x.s = 'p' || p_partkey")
def entity_type_by_keys(spark, d):
    keys = T.triples(spark, d).select(F.col("s").alias("entity"), F.col("p").alias("key"))
    return U.entity_kind(T.read(spark, d, "part").select("p_partkey", F.concat(F.lit("p"), "p_partkey").alias("entity")), keys, ("suppliedBy",), ("brand",), ("SUPPLIED", "NOT_SUPPLIED", "UNKNOWN")).select("p_partkey", "kind")


@query("SELECT count(*) AS entries, count(DISTINCT p_type) AS kinds, count(*) FILTER (WHERE p_size <> 0) AS nonzero, count(*) FILTER (WHERE p_size <> 0) > 0 AS usable FROM part")
def type_map_verdict(spark, d):
    return C.type_map(T.read(spark, d, "part").select(F.col("p_type").alias("kind"), F.col("p_size").alias("value")))


# -- metrics ---------------------------------------------------------------------------------------------------------


@query("WITH " + VECTORS + ", g AS (SELECT query, sum(CASE WHEN hit = 1 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(hit) AS n FROM ranked GROUP BY query) SELECT count(*) AS queries, round(avg(dcg / list_sum(list_transform(range(1, least(n, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1)))), 9) AS ndcg FROM g WHERE n > 0")
def mean_ndcg(spark, d):
    return R.mean_ndcg(R.nearest(*searched(spark, d), 10), 10, R.relevant(*searched(spark, d))).select("queries", F.round("ndcg", 9).alias("ndcg"))


@query("SELECT c_mktsegment AS class, CASE WHEN n < 1 THEN 0 ELSE round(ln(t / n) / ln(t), 9) END AS specificity FROM (SELECT c_mktsegment, count(*)::DOUBLE AS n, (SELECT greatest(count(*), 2)::DOUBLE FROM orders) AS t FROM customer GROUP BY 1)")
def category_specificity(spark, d):
    total = T.read(spark, d, "orders").agg(F.greatest(F.count("*"), F.lit(2)).cast("double").alias("t"))
    n = T.read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("class")).agg(F.count("*").cast("double").alias("n"))
    return n.crossJoin(total).select("class", F.round(R.specificity(F.col("n"), F.col("t")), 9).alias("specificity"))


REJECTS = "rej AS (SELECT c_nationkey AS class, CASE WHEN n < 5 THEN 'TOO_SMALL' END AS r1, CASE WHEN n > 60 THEN 'TOO_GENERIC' END AS r2, CASE WHEN low > 0.5 * n THEN 'LOW_BALANCE' END AS r3 FROM (SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 4500) AS low FROM customer GROUP BY 1))"


@query("WITH " + REJECTS + " SELECT reason, sum(first)::BIGINT AS primary_n, count(*) AS any_n FROM (SELECT unnest([r1, r2, r3]) AS reason, unnest([1, (r1 IS NULL)::INT, (r1 IS NULL AND r2 IS NULL)::INT]) AS first FROM rej) WHERE reason IS NOT NULL GROUP BY 1")
def class_rejection_metrics(spark, d):
    c = T.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 4500).alias("low"))
    reasons = F.array_compact(F.array(F.when(F.col("n") < 5, "TOO_SMALL"), F.when(F.col("n") > 60, "TOO_GENERIC"), F.when(F.col("low") > 0.5 * F.col("n"), "LOW_BALANCE")))
    return C.rejections(c.select("class", reasons.alias("reasons")))


@query("WITH chosen AS (" + SQL["select_distractors"] + """), b AS (SELECT 'any' AS block, * FROM chosen UNION ALL SELECT 'shown', * FROM chosen WHERE policy <> 'diagnostic-l0'),
r AS (SELECT block, unnest([i, j, k]) AS rank FROM b), m AS (SELECT block, round(avg(rank), 4) AS mean_rank, median(rank)::DOUBLE AS median_rank, min(rank) AS least_rank, max(rank) AS most_rank FROM r GROUP BY block)
SELECT b.block, count(*) AS answers, count(*) FILTER (WHERE i = 1 AND j = 2 AND k = 3) AS first_three, round(100.0 * count(*) FILTER (WHERE i = 1 AND j = 2 AND k = 3) / count(*), 2) AS first_three_pct, round(avg(i), 4) AS mean_first, round(avg(j), 4) AS mean_second, round(avg(k), 4) AS mean_third, any_value(mean_rank) AS mean_rank, any_value(median_rank) AS median_rank, any_value(least_rank) AS least_rank, any_value(most_rank) AS most_rank FROM b JOIN m ON m.block = b.block GROUP BY b.block""")
def rank_retention(spark, d):
    return C.retention(select_distractors(spark, d))


@query("SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS k FROM (SELECT event_type AS key, CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k <= 5")
def stratified_top_k(spark, d):
    e = T.read(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return R.top_k(e, "key", [F.desc("n"), "value"], 5).select("key", "value")
