"""All queries over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import kernel as K
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import rationale as P
from ..operators import relations as L
from ..sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL where there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TRIPLES = """triples AS (
  SELECT 'c' || c_custkey AS s, 'inNation' AS p, 'n' || c_nationkey AS o FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'segment', 'seg:' || c_mktsegment FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'inNation', 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'inRegion', 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'p' || p_partkey, 'brand', 'brand:' || p_brand FROM part
  UNION ALL SELECT 'p' || p_partkey, 'type', 'type:' || p_type FROM part
  UNION ALL SELECT 'o' || o_orderkey, 'placedBy', 'c' || o_custkey FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 'priority', 'prio:' || o_orderpriority FROM orders
  UNION ALL SELECT 'p' || l_partkey, 'suppliedBy', 's' || l_suppkey FROM lineitem)"""
FACTS = """facts AS (
  SELECT DISTINCT o_custkey AS entity, 'priority' AS key, o_orderpriority AS value FROM orders
  UNION SELECT o_custkey, 'status', o_orderstatus FROM orders
  UNION SELECT o_custkey, 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders
  UNION SELECT o_custkey, 'period', CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) || 'Q' || quarter(o_orderdate) WHEN 1 THEN year(o_orderdate) || 'H' || CAST(ceil(quarter(o_orderdate) / 2.0) AS INT) ELSE CAST(year(o_orderdate) AS VARCHAR) END FROM orders)"""
CANDS = """cands AS (
  SELECT answer, cand, pos, 1 - pos / 100.0::DOUBLE AS score FROM (
    SELECT a.c_custkey AS answer, c.c_custkey AS cand, row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(c.c_acctbal - a.c_acctbal), c.c_custkey) AS pos
    FROM customer a JOIN customer c ON a.c_nationkey = c.c_nationkey AND a.c_custkey <> c.c_custkey) WHERE pos <= 8)"""
SETS = FACTS + ", " + CANDS + """, sets AS (SELECT entity, key, list_sort(list(value)) AS vs FROM facts GROUP BY entity, key),
grid AS (SELECT c.answer, c.cand, c.pos, c.score, a.key, a.vs AS aset, coalesce(b.vs, []) AS cset
  FROM cands c JOIN sets a ON a.entity = c.answer LEFT JOIN sets b ON b.entity = c.cand AND b.key = a.key)"""
EVIDENCE = SETS + """, parents AS (SELECT DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS child, year(o_orderdate) || 'H' || CAST(ceil(quarter(o_orderdate) / 2.0) AS INT) AS parent FROM orders
  UNION SELECT DISTINCT year(o_orderdate) || 'H' || CAST(ceil(quarter(o_orderdate) / 2.0) AS INT), CAST(year(o_orderdate) AS VARCHAR) FROM orders),
up AS (SELECT child AS node, parent AS ancestor FROM parents UNION SELECT a.child, b.parent FROM parents a JOIN parents b ON a.parent = b.child),
inside AS (SELECT child AS node FROM parents UNION SELECT parent FROM parents),
objs AS (SELECT c.answer, c.cand, c.pos, c.score, f.key, f.value, o.value AS obj, CASE f.value WHEN '5-LOW' THEN '4-NOT SPECIFIED' ELSE f.value END AS a, CASE o.value WHEN '5-LOW' THEN '4-NOT SPECIFIED' ELSE o.value END AS b
  FROM cands c JOIN facts f ON f.entity = c.answer LEFT JOIN facts o ON o.entity = c.cand AND o.key = f.key),
rel AS (SELECT *, CASE WHEN value = obj THEN 'EXACT_EQUAL' WHEN a = b THEN 'CANONICALLY_EQUIVALENT' WHEN key = 'priority' AND ((a = '1-URGENT' AND b = '2-HIGH') OR (a = '2-HIGH' AND b = '1-URGENT')) THEN 'SCOPED_VALUE_EQUIVALENT'
  WHEN key = 'period' AND (b, a) IN (SELECT (node, ancestor) FROM up) THEN 'CANDIDATE_UNDER_CLAIM' WHEN key = 'period' AND (a, b) IN (SELECT (node, ancestor) FROM up) THEN 'CLAIM_UNDER_CANDIDATE'
  WHEN (a = 'F' AND b = 'P') OR (a = 'P' AND b = 'F') THEN 'PROVEN_DISJOINT' WHEN key IN ('period', 'year') AND (a NOT IN (SELECT node FROM inside) OR b NOT IN (SELECT node FROM inside)) THEN 'HIERARCHY_NOT_MODELLED'
  ELSE 'UNRELATED_OR_UNKNOWN' END AS relation FROM (SELECT DISTINCT key, value, obj, a, b FROM objs WHERE obj IS NOT NULL)),
agg AS (SELECT answer, cand, pos, score, o.key, o.value, count(o.obj) AS n, coalesce(bool_or(relation IN ('EXACT_EQUAL', 'CANONICALLY_EQUIVALENT', 'SCOPED_VALUE_EQUIVALENT', 'CANDIDATE_UNDER_CLAIM')), false) AS supported,
  coalesce(bool_or(relation = 'CLAIM_UNDER_CANDIDATE'), false) AS over_, coalesce(bool_or(relation = 'HIERARCHY_NOT_MODELLED'), false) AS unmodelled,
  coalesce(bool_or(o.key = 'status' AND o.value IN ('F', 'O') AND o.obj IN ('F', 'O') AND o.value <> o.obj), false) AS excluded
  FROM objs o LEFT JOIN rel r ON r.key = o.key AND r.value = o.value AND r.obj = o.obj GROUP BY ALL),
lev AS (SELECT *, CASE WHEN n = 0 THEN 1 WHEN supported THEN 0 WHEN excluded THEN 3 ELSE 2 END AS level FROM agg),
card AS (SELECT c_nationkey AS scope, key, count(*) AS support, max(n) AS most, count(*) FILTER (WHERE n > 1) AS violations FROM (SELECT entity, key, count(DISTINCT value) AS n FROM facts GROUP BY 1, 2) JOIN customer ON c_custkey = entity GROUP BY 1, 2),
evidence AS (SELECT l.answer, l.cand, l.pos, l.score, l.key, l.value, level, CASE level WHEN 1 THEN 'ABSENCE_ONLY' WHEN 0 THEN 'SUPPORTED' WHEN 3 THEN 'FORMAL_CONFLICT' ELSE 'POSITIVE_VALUE_CONTRAST' END AS reason,
  CASE WHEN level = 3 THEN 'FORMAL_PROOF' WHEN level = 2 AND card.most IS NOT NULL AND n <= card.most THEN 'SCOPED_EMPIRICAL' ELSE 'NONE' END AS basis,
  CASE WHEN level <= 1 THEN 'NONE' WHEN over_ THEN 'PRESENT' WHEN unmodelled THEN 'HIERARCHY_UNMODELLED' ELSE 'NONE' END AS risk
  FROM lev l JOIN customer ON c_custkey = l.answer LEFT JOIN card ON card.scope = c_nationkey AND card.key = l.key AND violations = 0 AND support >= 5)"""
MATRIX = EVIDENCE + ", matrix AS (SELECT answer, cand, pos, score, key, value, level FROM evidence)"
COMBOS = MATRIX + """, combos AS (SELECT a.answer, a.pos AS i, b.pos AS j, c.pos AS k, a.score + b.score + c.score AS sum_score,
  least(a.score, b.score, c.score) AS min_score, a.pos + b.pos + c.pos AS sum_rank
  FROM cands a JOIN cands b ON a.answer = b.answer AND a.pos < b.pos JOIN cands c ON b.answer = c.answer AND b.pos < c.pos)"""
MASKS = COMBOS + """, masks AS (SELECT * FROM (
  SELECT t.answer, i, j, k, x.key, x.value, sum(CASE WHEN x.level >= lv THEN CASE x.pos WHEN i THEN 1 WHEN j THEN 2 WHEN k THEN 4 ELSE 0 END ELSE 0 END)::INT AS mask, lv
  FROM combos t JOIN matrix x ON x.answer = t.answer CROSS JOIN (VALUES (3), (2), (1)) v(lv) GROUP BY t.answer, i, j, k, x.key, x.value, lv) WHERE mask > 0),
sig AS (SELECT answer, i, j, k, lv, bit_or(1 << mask) AS signature FROM masks GROUP BY answer, i, j, k, lv),
sizes AS (SELECT *, CASE WHEN signature & 128 > 0 THEN 1
  WHEN (signature & 66 = 66) OR (signature & 36 = 36) OR (signature & 24 = 24) OR (signature & 40 = 40) OR (signature & 72 = 72) OR (signature & 96 = 96) THEN 2
  WHEN signature & 22 = 22 THEN 3 ELSE 4 END AS size FROM sig)"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    return T.object_sets(spark, d)


def cands(spark: SparkSession, d: str) -> DataFrame:
    return T.candidates(spark, d)


#: What is declared of the values: periods nest, some priorities mean the same, an order status excludes another.
POLICY = E.Policy(hierarchical=("period",), covered=("period", "year"), equivalent=(("5-LOW", "4-NOT SPECIFIED"),), scoped=(("priority", "1-URGENT", "2-HIGH"),), disjoint=(("F", "P"),), exclusive=(("status", ("F", "O")),))


def period_edges(spark, d):
    return E.index_edges(T.periods(spark, d), POLICY)


def scope_rules(spark, d):
    """(answer, key, support, most, violations, status): the rules of the scope of each answer, its nation."""
    scope = T.read(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("scope"))
    rules = L.single_valued_rules(L.scope_cardinalities(facts(spark, d), scope))
    return scope.withColumnRenamed("entity", "answer").join(rules, "scope").drop("scope")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return E.evidence(cands(spark, d), facts(spark, d), period_edges(spark, d), POLICY, scope_rules(spark, d))


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).select("answer", "cand", "pos", "score", "key", "value", "level")


def region_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of a small subgraph: nations, regions and suppliers."""
    n = T.read(spark, d, "nation")
    s = T.read(spark, d, "supplier")
    return n.select(F.concat(F.lit("n"), "n_nationkey").alias("node")).union(n.select(F.concat(F.lit("r"), "n_regionkey"))).union(s.select(F.concat(F.lit("s"), "s_suppkey"))).distinct()


NODES = """nodes AS (SELECT 'n' || n_nationkey AS node FROM nation UNION SELECT 'r' || n_regionkey FROM nation UNION SELECT 's' || s_suppkey FROM supplier)"""


# -- knowledge graph -------------------------------------------------------------------------------------------------


@query("WITH " + TRIPLES + " SELECT p, count(*) AS edges, count(DISTINCT s) AS subjects FROM triples GROUP BY p")
def kg_triples(spark, d):
    return T.triples(spark, d).groupBy("p").agg(F.count("*").alias("edges"), F.countDistinct("s").alias("subjects"))


@query("WITH " + TRIPLES + """, f AS (SELECT s AS owner, p, 'OUT' AS dir, o AS other FROM triples UNION SELECT o, p, 'IN', s FROM triples)
SELECT owner, p, dir, other FROM f WHERE owner IN ('n3', 'n7', 'r1', 's5', 'c9')""")
def kg_facts_directed(spark, d):
    return G.directed_facts(T.triples(spark, d)).where(F.col("owner").isin("n3", "n7", "r1", "s5", "c9"))


@query("WITH " + TRIPLES + ", " + NODES + """, e AS (SELECT s AS node, o AS other, 1 AS x FROM triples UNION ALL SELECT o, s, 0 FROM triples)
SELECT n.node, coalesce(sum(x), 0)::BIGINT AS out_degree, coalesce(sum(1 - x), 0)::BIGINT AS in_degree, count(DISTINCT CASE WHEN other <> n.node THEN other END) AS neighbours
FROM nodes n LEFT JOIN e ON e.node = n.node GROUP BY n.node""")
def one_hop_profile(spark, d):
    return G.one_hop_profile(T.triples(spark, d), region_nodes(spark, d))


@query("WITH " + TRIPLES + ", " + NODES + " SELECT s, p, o FROM triples WHERE s IN (SELECT node FROM nodes) AND o IN (SELECT node FROM nodes)")
def induced_subgraph_edges(spark, d):
    return G.induced_edges(T.triples(spark, d), region_nodes(spark, d))


@query("WITH " + TRIPLES + ", " + NODES + """, e AS (SELECT DISTINCT node, other FROM (SELECT s AS node, o AS other FROM triples UNION ALL SELECT o, s FROM triples) WHERE node <> other),
seeds AS (SELECT node FROM nodes WHERE node LIKE 'n%')
SELECT node, "full", retained, CASE WHEN "full" = 0 THEN 1.0 ELSE retained::DOUBLE / "full" END AS ratio FROM (
  SELECT s.node, count(e.other) AS "full", count(n.node) AS retained FROM seeds s LEFT JOIN e ON e.node = s.node LEFT JOIN nodes n ON n.node = e.other GROUP BY s.node)""")
def neighborhood_coverage_ratio(spark, d):
    nodes = region_nodes(spark, d)
    return G.coverage_ratio(T.triples(spark, d), nodes.where("node like 'n%'"), nodes)


@query("WITH " + TRIPLES + """, c AS (SELECT p, o, count(*) AS n, row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, o) AS rank FROM triples GROUP BY p, o),
w AS (SELECT p, count(*) AS edges, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM triples GROUP BY p)
SELECT w.p, edges, subjects, objects, rank, o, n FROM c JOIN w ON c.p = w.p WHERE rank <= 3""")
def predicate_census_topn(spark, d):
    return G.predicate_census(T.triples(spark, d))


@query("WITH " + TRIPLES + """, f AS (SELECT s, p, o FROM triples WHERE p IN ('inNation', 'segment')),
h AS (SELECT p, o, count(DISTINCT s) AS n FROM triples GROUP BY p, o) SELECT f.s, f.p, f.o, h.n - 1 AS others FROM f JOIN h ON f.p = h.p AND f.o = h.o""")
def edge_rarity(spark, d):
    t = T.triples(spark, d)
    return G.edge_rarity(t, t.where("p in ('inNation', 'segment')"))


@query("""WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
c AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION SELECT c.child, e.parent, depth + 1 FROM c JOIN e ON c.ancestor = e.child WHERE depth < 4)
SELECT child, ancestor, min(depth) AS depth FROM c WHERE child <> ancestor GROUP BY child, ancestor""")
def ancestor_closure_depth4(spark, d):
    t = T.triples(spark, d)
    return G.ancestors(t.where("p = 'inRegion' or p = 'inNation' and s like 's%'").select(F.col("s").alias("child"), F.col("o").alias("parent")))


@query("WITH " + CANDS + """ SELECT answer, cand, row_number() OVER (PARTITION BY answer ORDER BY sha256('seed' || chr(0) || answer || chr(0) || cand), cand) AS position FROM cands""")
def seeded_admission_order(spark, d):
    return G.admission_order(cands(spark, d), "seed")


# -- set relations and evidence --------------------------------------------------------------------------------------


@query("WITH " + FACTS + ", " + CANDS + """ SELECT c.answer, c.cand, count(b.value) AS n FROM cands c LEFT JOIN facts a ON a.entity = c.answer
LEFT JOIN facts b ON b.entity = c.cand AND b.key = a.key AND b.value = a.value GROUP BY c.answer, c.cand""")
def overlap_strict(spark, d):
    return L.overlap(cands(spark, d), facts(spark, d))


@query("WITH " + FACTS + ", " + CANDS + """ SELECT c.answer, c.cand, a.key, a.value FROM cands c JOIN facts a ON a.entity = c.answer
WHERE NOT EXISTS (SELECT 1 FROM facts b WHERE b.entity = c.cand AND b.key = a.key AND b.value = a.value)""")
def distinguishing_facts_anti(spark, d):
    return L.distinguishing(cands(spark, d), facts(spark, d))


@query("WITH " + FACTS + ", " + CANDS + """ SELECT a.entity AS answer, a.key, a.value FROM facts a WHERE a.entity IN (SELECT answer FROM cands)
AND NOT EXISTS (SELECT 1 FROM facts b JOIN cands c ON b.entity = c.cand WHERE c.answer = a.entity AND b.key = a.key AND b.value = a.value)""")
def single_fact_common_filter(spark, d):
    return L.common_to_none(cands(spark, d), facts(spark, d))


@query("WITH " + SETS + """ SELECT answer, cand, key, CASE WHEN len(cset) = 0 THEN 'KEY_ABSENT' WHEN both_n = len(aset) AND both_n = len(cset) THEN 'EQUAL' WHEN both_n = len(aset) THEN 'ANSWER_STRICT_SUBSET'
WHEN both_n = len(cset) THEN 'CANDIDATE_STRICT_SUBSET' WHEN both_n > 0 THEN 'PARTIAL_OVERLAP' ELSE 'DISJOINT' END AS relation, both_n::DOUBLE / (len(aset) + len(cset) - both_n) AS jaccard
FROM (SELECT *, len(list_intersect(aset, cset)) AS both_n FROM grid)""")
def object_set_relation(spark, d):
    return L.set_relation(L.grid(cands(spark, d), facts(spark, d)))


@query("WITH " + MATRIX + " SELECT answer, cand, pos, score, key, value, level FROM matrix")
def evidence_level_matrix(spark, d):
    return matrix(spark, d)


@query("WITH " + MATRIX + " SELECT answer, cand, key, value, CASE level WHEN 0 THEN 'SHARED' WHEN 1 THEN 'ABSENCE_ONLY' ELSE 'POSITIVE_ALTERNATIVE' END AS status FROM matrix")
def evidence_status_v1(spark, d):
    return L.evidence_status(matrix(spark, d))


@query("WITH " + FACTS + """, n AS (SELECT entity, key, count(*) AS n FROM facts GROUP BY entity, key)
SELECT c_mktsegment AS scope, key, count(*) AS support, max(n) AS most, count(*) FILTER (WHERE n > 1) AS violations FROM n JOIN customer ON entity = c_custkey GROUP BY 1, 2""")
def scope_cardinalities(spark, d):
    scope = T.read(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("scope"))
    return L.scope_cardinalities(facts(spark, d), scope)


@query("WITH " + FACTS + """, n AS (SELECT entity, key, count(*) AS n FROM facts GROUP BY entity, key),
g AS (SELECT 'k' || c_nationkey AS scope, key, count(*) AS support, max(n) AS most, count(*) FILTER (WHERE n > 1) AS violations FROM n JOIN customer ON entity = c_custkey GROUP BY 1, 2)
SELECT *, CASE WHEN violations > 0 THEN 'INACTIVE_MULTI_VALUED' WHEN support < 5 THEN 'INACTIVE_LOW_SUPPORT' ELSE 'ACTIVE' END AS status FROM g""")
def empirical_single_valued_rules(spark, d):
    scope = T.read(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.concat(F.lit("k"), "c_nationkey").alias("scope"))
    return L.single_valued_rules(L.scope_cardinalities(facts(spark, d), scope))


# -- scalars ---------------------------------------------------------------------------------------------------------


URL = r"""u AS (SELECT page_id, trim(url) AS url, regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)', 1) AS host, regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)', 2) AS path FROM pages),
n AS (SELECT page_id, url, host, path, CASE WHEN regexp_extract(path, '([^/]*)$', 1) <> '' THEN regexp_extract(path, '([^/]*)$', 1) WHEN host <> '' THEN host ELSE url END AS name FROM u)"""


@query("WITH " + URL + r""" SELECT page_id, url_decode(name) AS name, trim(replace(url_decode(name), '_', ' ')) AS label, regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '[\s<>"{}|\\^`]') AS safe FROM n""")
def local_name_display_label(spark, d):
    return T.read(spark, d, "pages").select("page_id", X.local_name(F.col("url")).alias("name"), X.display_label(F.col("url")).alias("label"), X.is_safe_uri(F.col("url")).alias("safe"))


@query(r"""WITH f AS (SELECT page_id, list_distinct(['<' || trim(url) || '>', trim(url), '<' || url_decode(trim(url)) || '>', url_decode(trim(url))]) AS x FROM pages) SELECT page_id, unnest(x) AS spelling FROM f""")
def uri_spelling_ladder(spark, d):
    return T.read(spark, d, "pages").select("page_id", F.explode(X.spelling_ladder(F.col("url"), ascii_only=True)).alias("spelling"))


@query(r"""SELECT item_id, len(ts) AS n, list_aggregate(ts, 'string_agg', ' ') AS tokens FROM (SELECT item_id, list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+'), lambda t: len(t) >= 4) AS ts FROM benchmark)""")
def leakage_tokens(spark, d):
    t = T.read(spark, d, "benchmark").select("item_id", X.tokens(F.replace("text", F.lit("/"), F.lit(" ")), 4).alias("ts"))
    return t.select("item_id", F.size("ts").cast("long").alias("n"), F.array_join("ts", " ").alias("tokens"))


LEAKS = r"""w AS (SELECT p_partkey, unnest(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: len(x) >= 4)) AS a, p_type, p_name, p_partkey AS k FROM part),
o AS (SELECT p_partkey, unnest(list_filter(regexp_extract_all(lower(p_type || 's ' || replace(p_name, 'ring', 'rings')), '[a-z0-9]+'), lambda x: len(x) >= 4)) AS b FROM part),
st AS (SELECT w.p_partkey, a, b, CASE WHEN a LIKE '%es' AND len(a) >= 6 THEN a[:-3] WHEN a LIKE '%s' AND len(a) >= 5 THEN a[:-2] ELSE a END AS sa, CASE WHEN b LIKE '%es' AND len(b) >= 6 THEN b[:-3] WHEN b LIKE '%s' AND len(b) >= 5 THEN b[:-2] ELSE b END AS sb FROM w JOIN o ON w.p_partkey = o.p_partkey),
r AS (SELECT *, CASE WHEN a = b THEN 'WHOLE_TOKEN' WHEN sa = sb THEN 'PLURAL_STEM' WHEN (starts_with(a, b) AND len(b) >= 5) OR (starts_with(b, a) AND len(a) >= 5) THEN 'LONG_PREFIX' WHEN substr(a, 1, 4) = substr(b, 1, 4) THEN 'SHORT_PREFIX' END AS rule FROM st)"""


@query("WITH " + LEAKS + """ SELECT p.p_partkey, CASE WHEN count(*) FILTER (WHERE rule <> 'SHORT_PREFIX') > 0 THEN 'HARD' WHEN count(rule) > 0 THEN 'SOFT' ELSE 'NONE' END AS verdict,
CASE WHEN count(*) FILTER (WHERE rule <> 'SHORT_PREFIX') > 0 THEN count(*) FILTER (WHERE rule <> 'SHORT_PREFIX') ELSE count(rule) END AS n FROM part p LEFT JOIN r ON r.p_partkey = p.p_partkey GROUP BY 1""")
def leakage_verdict(spark, d):
    other = F.concat(F.col("p_type"), F.lit("s "), F.replace("p_name", F.lit("ring"), F.lit("rings")))
    x = T.read(spark, d, "part").select("p_partkey", X.leakage(F.col("p_name"), other, ascii_only=True).alias("x"))
    return x.select("p_partkey", "x.verdict", F.size("x.evidence").cast("long").alias("n"))


@query(r"""WITH s AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM benchmark)
SELECT item_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM s""")
def sentence_split(spark, d):
    return T.read(spark, d, "benchmark").select("item_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@query()
def chunk_text(spark, d):
    """(doc_id, chunk_no, chunk): sentences packed into a budget of tokens; tests hold it against a plain loop."""
    return T.read(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk_no", "chunk"))


@query("""SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, d):
    e = T.read(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("x"), F.col("vec_id").alias("y"), F.col("embedding").alias("v"))
    return e.select(F.col("vec_id").alias("x"), F.col("embedding").alias("u")).join(b, "x").select("x", "y", F.round(R.cosine("u", "v"), 6).alias("sim"))


@query("""SELECT label, pos, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos""")
def mean_vector(spark, d):
    e = T.read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return e.groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


# -- classes and ranking ---------------------------------------------------------------------------------------------


@query("""SELECT c_mktsegment AS class, count(DISTINCT c_custkey) AS members, round(ln((SELECT count(DISTINCT c_custkey) FROM customer)::DOUBLE / count(DISTINCT c_custkey)), 9) AS idf FROM customer GROUP BY 1""")
def category_counts_idf(spark, d):
    return M.class_idf(T.read(spark, d, "customer").select(F.col("c_mktsegment").alias("class"), F.col("c_custkey").alias("member")))


@query("SELECT count(DISTINCT c_custkey) AS universe, count(DISTINCT c_custkey) FILTER (WHERE c_mktsegment LIKE 'B%') AS filtered FROM customer")
def idf_universe(spark, d):
    c = T.read(spark, d, "customer")
    return c.agg(F.countDistinct("c_custkey").alias("universe"), F.countDistinct(F.when(F.col("c_mktsegment").like("B%"), F.col("c_custkey"))).alias("filtered"))


RANKED = """b AS (SELECT n_regionkey AS region, n_nationkey AS nation, count(DISTINCT c_custkey) AS members, coalesce(sum(c_acctbal), 0)::DECIMAL(18,2)::DOUBLE AS balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY region) = 1 THEN 1.0 ELSE (rank() OVER (PARTITION BY region ORDER BY members) - 1 + (count(*) OVER (PARTITION BY region, members) - 1) / 2.0) / (count(*) OVER (PARTITION BY region) - 1) END::DOUBLE AS na,
CASE WHEN count(*) OVER (PARTITION BY region) = 1 THEN 1.0 ELSE (rank() OVER (PARTITION BY region ORDER BY balance) - 1 + (count(*) OVER (PARTITION BY region, balance) - 1) / 2.0) / (count(*) OVER (PARTITION BY region) - 1) END::DOUBLE AS nb FROM b)"""


def nation_scores(spark, d):
    n = T.read(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    c = T.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.countDistinct("c_custkey").alias("members"), F.sum("c_acctbal").cast("decimal(18,2)").cast("double").alias("balance"))
    return n.join(c, "nation", "left").na.fill({"members": 0, "balance": 0.0})


@query("WITH " + RANKED + " SELECT region, nation, members, na FROM r")
def rank_normalize_avg_ties(spark, d):
    return nation_scores(spark, d).select("region", "nation", "members", R.rank_normalize("members", ["region"]).alias("na"))


@query("WITH " + RANKED + ", f AS (SELECT *, 0.7::DOUBLE * na + (1 - 0.7)::DOUBLE * nb AS fused FROM r) SELECT region, nation, round(fused, 9) AS fused, row_number() OVER (PARTITION BY region ORDER BY round(fused, 9) DESC, nation) AS place FROM f")
def alpha_fusion_ranking(spark, d):
    f = R.fuse(nation_scores(spark, d), "members", "balance", ["region"], "nation", 0.7)
    f = f.withColumn("fused", F.round("fused", 9))
    return f.select("region", "nation", "fused", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("fused"), "nation")).alias("place"))


@query("WITH " + RANKED + """, a AS (SELECT x.alpha, region, nation, row_number() OVER (PARTITION BY x.alpha, region ORDER BY round(x.alpha * na + (1 - x.alpha) * nb, 9) DESC, nation) AS place FROM r CROSS JOIN (VALUES (0.0::DOUBLE), (0.5), (1.0)) x(alpha))
SELECT p.alpha AS alpha_a, q.alpha AS alpha_b, p.region, round(corr(p.place, q.place), 9) AS rho FROM a p JOIN a q ON p.region = q.region AND p.nation = q.nation AND p.alpha < q.alpha GROUP BY 1, 2, 3""")
def alpha_sweep_spearman(spark, d):
    base = nation_scores(spark, d).withColumns({"na": R.rank_normalize("members", ["region"]), "nb": R.rank_normalize("balance", ["region"])})
    a = base.withColumn("alpha", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    fused = F.round(F.col("alpha") * F.col("na") + (1 - F.col("alpha")) * F.col("nb"), 9)
    a = a.select("alpha", "region", "nation", F.row_number().over(Window.partitionBy("alpha", "region").orderBy(fused.desc(), "nation")).alias("place"))
    b = a.select(F.col("alpha").alias("alpha_b"), "region", "nation", F.col("place").alias("other"))
    pairs = a.withColumnRenamed("alpha", "alpha_a").join(b, ["region", "nation"]).where("alpha_a < alpha_b")
    return pairs.groupBy("alpha_a", "alpha_b", "region").agg(F.round(F.corr("place", "other"), 9).alias("rho"))


GATE = """g AS (SELECT c_nationkey AS class, count(*) AS members, count(*) FILTER (WHERE c_acctbal > 0) AS mapped FROM customer GROUP BY 1),
w AS (SELECT *, CASE WHEN members < 50 THEN 'TOO_FEW' WHEN members > 70 THEN 'TOO_MANY' WHEN mapped < 0.9 * members THEN 'LOW_MAPPING' END AS code, row_number() OVER (ORDER BY members DESC, class) AS position FROM g)"""


def gated(spark, d):
    g = T.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("class")).agg(F.count("*").alias("members"), F.count_if(F.col("c_acctbal") > 0).alias("mapped"))
    code = F.when(F.col("members") < 50, "TOO_FEW").when(F.col("members") > 70, "TOO_MANY").when(F.col("mapped") < 0.9 * F.col("members"), "LOW_MAPPING")
    return g.withColumns({"code": code, "position": F.row_number().over(Window.orderBy(F.desc("members"), "class"))})


@query("WITH " + GATE + " SELECT class, members, mapped, code, position FROM w")
def class_gate_reject_codes(spark, d):
    return gated(spark, d).select("class", "members", "mapped", "code", "position")


@query("WITH " + GATE + """, f AS (SELECT min(position) FILTER (WHERE code IS NULL) AS first FROM w)
SELECT class, position, CASE WHEN first IS NULL OR position < first THEN 'REJECTED' WHEN position = first THEN 'SELECTED' ELSE 'NOT_ATTEMPTED' END AS outcome FROM w CROSS JOIN f""")
def first_feasible_class(spark, d):
    g = gated(spark, d)
    first = F.min(F.when(F.col("code").isNull(), F.col("position"))).over(Window.partitionBy())
    return g.withColumn("first", first).select("class", "position", F.when(F.col("first").isNull() | (F.col("position") < F.col("first")), "REJECTED").when(F.col("position") == F.col("first"), "SELECTED").otherwise("NOT_ATTEMPTED").alias("outcome"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))")
def reject_histogram_grouping_sets(spark, d):
    return M.grouping_sets(T.read(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice"), ["status", "priority"], [F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean")])


@query("""SELECT o_custkey AS customer, o_orderkey AS k, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3""")
def topk_per_group(spark, d):
    o = T.read(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return R.top_k(o, "customer", [F.desc("price"), "k"], 3)


@query("""SELECT p_brand AS brand, p_partkey AS k, p_size AS score, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS tie_group, count(*) OVER (PARTITION BY p_brand, p_size) AS tie_size FROM part""")
def tie_groups(spark, d):
    return R.tie_groups(T.read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("k"), F.col("p_size").alias("score")), "brand", "score")


VECTORS = """q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0),
v AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS sim, (q.label = e.label)::INT AS hit FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM v)"""


def searched(spark, d):
    """All vectors, and those that are queries."""
    e = T.read(spark, d, "embeddings")
    return e, e.where("vec_id % 50 = 0")


@query("WITH " + VECTORS + " SELECT count(*) AS queries, round(avg(coalesce(1.0 / f, 0)), 9) AS mrr FROM (SELECT query, min(rank) FILTER (WHERE hit = 1) AS f FROM ranked GROUP BY query)")
def mrr(spark, d):
    return R.mrr(R.first_hits(*searched(spark, d))).select("queries", F.round("mrr", 9).alias("mrr"))


@query("WITH " + VECTORS + """, g AS (SELECT query, sum(CASE WHEN hit = 1 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(hit) AS n FROM ranked GROUP BY query)
SELECT query, round(dcg / list_sum(list_transform(range(1, least(n, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))), 9) AS ndcg FROM g WHERE n > 0""")
def ndcg_at_k(spark, d):
    return R.ndcg(R.nearest(*searched(spark, d), 10), 10, R.relevant(*searched(spark, d))).select("query", F.round("ndcg", 9).alias("ndcg"))


@query("WITH " + VECTORS + ", h AS (SELECT rank AS k, sum(hit) OVER (PARTITION BY query ORDER BY rank) AS n FROM ranked) SELECT k, round(sum(n) / k / (SELECT count(DISTINCT query) FROM ranked), 9) AS p_at_k FROM h WHERE k <= 10 GROUP BY k")
def precision_at_k(spark, d):
    return R.precision_at(R.nearest(*searched(spark, d), 10), 10).select("k", F.round("precision", 9).alias("p_at_k"))


@query()
def mmr_select(spark, d):
    e = T.read(spark, d, "embeddings")
    best = R.nearest(*searched(spark, d), 20).select(F.col("query").alias("answer"), "id", F.col("sim").alias("relevance"))
    return R.mmr(best.join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id"))


# -- mapping and identity --------------------------------------------------------------------------------------------

#: Redirects by a rule on keys: every seventh customer points to the next one.
REDIRECTS = "redirects AS (SELECT c_custkey AS src, c_custkey + 1 AS dst FROM customer WHERE c_custkey % 7 = 0)"


def redirects(spark, d):
    return T.read(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"))


@query("WITH " + REDIRECTS + """, local AS (SELECT o_custkey AS id FROM orders GROUP BY 1)
SELECT c_custkey AS member, CASE WHEN a.id IS NOT NULL THEN 'EXACT' WHEN b.id IS NOT NULL THEN 'REDIRECT' ELSE 'UNRESOLVED' END AS way, coalesce(a.id, b.id) AS node
FROM customer LEFT JOIN local a ON a.id = c_custkey LEFT JOIN redirects r ON r.src = c_custkey LEFT JOIN local b ON b.id = r.dst""")
def member_mapping_exact_redirect(spark, d):
    local = T.read(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return M.map_members(T.read(spark, d, "customer").select(F.col("c_custkey").alias("member")), redirects(spark, d), local)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation WHERE n_nationkey % 3 <> 0),
c AS (SELECT src, dst, 1 AS hops FROM e UNION ALL SELECT c.src, e.dst, hops + 1 FROM c JOIN e ON c.dst = e.src WHERE hops < 5) SELECT src, dst, hops FROM c""")
def redirect_chain_recursive(spark, d):
    e = T.read(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return M.chain(e, 5)


@query("SELECT c_custkey AS member FROM customer WHERE c_custkey > 100 ORDER BY 1 LIMIT 50")
def keyset_page(spark, d):
    return M.page(T.read(spark, d, "customer").select(F.col("c_custkey").alias("member")), "member", 100, 50)


@query("SELECT l_partkey AS node, min(l_orderkey * 10 + l_linenumber) AS first, count(*) AS n FROM lineitem GROUP BY 1")
def dedup_local_index(spark, d):
    return T.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"), F.count("*").alias("n"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cohort FROM events""")
def cohort_fill_forward(spark, d):
    e = T.read(spark, d, "events")
    first = e.agg(F.min("event_type").alias("t"))
    e = e.crossJoin(F.broadcast(first))  # one row
    return M.fill_forward(e.withColumn("mark", F.when(F.col("event_type") == F.col("t"), F.col("event_id"))), "user_id", "event_id", "mark").select("event_id", "user_id", F.col("mark").alias("cohort"))


# -- kernel ----------------------------------------------------------------------------------------------------------


@query("WITH " + MASKS + " SELECT answer, i, j, k, key, value, mask FROM masks WHERE lv = 2")
def coverage_masks(spark, d):
    return K.masks(K.triples_of(cands(spark, d)), matrix(spark, d), 2)


@query("WITH " + MASKS + " SELECT answer, i, j, k, signature, size FROM sizes WHERE lv = 2")
def min_cover_signature(spark, d):
    return K.cover_size(K.masks(K.triples_of(cands(spark, d)), matrix(spark, d), 2))


@query("WITH " + MASKS + " SELECT c.answer, c.i, c.j, c.k, round(sum_score, 9) AS sum_score, sum_rank, size FROM combos c JOIN sizes s ON c.answer = s.answer AND c.i = s.i AND c.j = s.j AND c.k = s.k WHERE lv = 2 AND size <= 3")
def feasible_triples(spark, d):
    t = K.triples_of(cands(spark, d))
    return t.join(K.cover_size(K.masks(t, matrix(spark, d), 2)).where("size <= 3"), ["answer", "i", "j", "k"]).select("answer", "i", "j", "k", F.round("sum_score", 9).alias("sum_score"), "sum_rank", "size")


TIERS = {"priority": 1, "status": 2, "year": 3, "period": 2}
#: The best prefix of each answer under its first policy, the least rationales of the combinations that tie on it, and all fields of their keys.
RATIONALES = MASKS + """, f AS (SELECT c.answer, c.i, c.j, c.k, round(sum_score, 9) AS sum_score, round(min_score, 9) AS min_score, sum_rank, s.size, s.lv FROM combos c JOIN sizes s ON c.answer = s.answer AND c.i = s.i AND c.j = s.j AND c.k = s.k WHERE size <= 3),
p AS (SELECT * FROM f QUALIFY rank() OVER (PARTITION BY answer ORDER BY lv DESC, sum_score DESC, min_score DESC, size) = 1),
cov AS (SELECT p.answer, p.i, p.j, p.k, p.size, p.lv, m.key || '|' || m.value AS fact, m.mask FROM p JOIN masks m ON m.answer = p.answer AND m.i = p.i AND m.j = p.j AND m.k = p.k AND m.lv = p.lv),
rat AS (SELECT answer, i, j, k, size, lv, [fact] AS facts FROM cov WHERE size = 1 AND mask = 7
  UNION ALL SELECT x.answer, x.i, x.j, x.k, x.size, x.lv, [x.fact, y.fact] FROM cov x JOIN cov y USING (answer, i, j, k) WHERE x.size = 2 AND x.fact < y.fact AND x.mask | y.mask = 7
  UNION ALL SELECT x.answer, x.i, x.j, x.k, x.size, x.lv, [x.fact, y.fact, z.fact] FROM cov x JOIN cov y USING (answer, i, j, k) JOIN cov z USING (answer, i, j, k) WHERE x.size = 3 AND x.fact < y.fact AND y.fact < z.fact AND x.mask | y.mask | z.mask = 7),
mem AS (SELECT *, unnest(facts) AS fact FROM rat),
cell AS (SELECT r.answer, r.i, r.j, r.k, r.size, r.lv, r.facts, e.cand, e.pos IN (r.i, r.j, r.k) AS chosen, e.level, e.basis, e.risk FROM mem r JOIN (SELECT *, key || '|' || value AS fact FROM evidence) e ON e.answer = r.answer AND e.fact = r.fact),
per AS (SELECT answer, i, j, k, size, lv, facts, cand, any_value(chosen) AS chosen, max(level) AS best, count(*) FILTER (WHERE chosen AND level = 1 AND level >= lv) AS l0, count(*) FILTER (WHERE chosen AND level = 2 AND level >= lv) AS l1, count(*) FILTER (WHERE chosen AND level = 3) AS l2,
  count(*) FILTER (WHERE chosen AND level >= lv AND basis = 'SCOPED_EMPIRICAL') AS scoped, count(*) FILTER (WHERE chosen AND level >= lv AND risk <> 'NONE') AS risk FROM cell GROUP BY ALL),
sums AS (SELECT answer, i, j, k, size, lv, facts, min(best) FILTER (WHERE chosen) AS min_level, sum(l2)::BIGINT AS l2, sum(l1)::BIGINT AS l1, sum(l0)::BIGINT AS l0, sum(scoped)::BIGINT AS scoped, sum(risk)::BIGINT AS risk, 1 + count(*) FILTER (WHERE best = 0) AS anonymity FROM per GROUP BY ALL),
qual AS (SELECT answer, i, j, k, facts, sum(CASE split_part(fact, '|', 1) WHEN 'priority' THEN 1 WHEN 'year' THEN 3 ELSE 2 END)::BIGINT AS tier, count(*) FILTER (WHERE split_part(fact, '|', 1) = 'status') AS unverbal,
  sum(len(split_part(fact, '|', 2)))::BIGINT AS label_length, sum(len(regexp_extract_all(lower(split_part(fact, '|', 2)), '[a-z0-9]+')))::BIGINT AS tokens, count(*) - count(DISTINCT split_part(fact, '|', 1)) AS extra, max(c) AS top
  FROM (SELECT *, count(*) OVER (PARTITION BY answer, i, j, k, facts, split_part(fact, '|', 1)) AS c FROM mem) GROUP BY ALL),
built AS (SELECT s.*, 0 AS conflicts, 0 AS soft, tier, unverbal, label_length, tokens, CASE top WHEN 3 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS repeats, (anonymity = 1)::INT AS direct FROM sums s JOIN qual q ON q.answer = s.answer AND q.i = s.i AND q.j = s.j AND q.k = s.k AND q.facts = s.facts)"""


def rationales(spark, d):
    return P.rationales(cands(spark, d), evidence(spark, d), TIERS, ("status",))


@query("WITH " + RATIONALES + """, b AS (SELECT b.*, p.sum_score, p.sum_rank FROM built b JOIN p ON p.answer = b.answer AND p.i = b.i AND p.j = b.j AND p.k = b.k)
SELECT answer, CASE lv WHEN 3 THEN 'strict-l2' WHEN 2 THEN 'main-l1' ELSE 'diagnostic-l0' END AS policy, i, j, k, size, sum_score, list_aggregate(facts, 'string_agg', ';') AS facts FROM b
QUALIFY row_number() OVER (PARTITION BY answer ORDER BY -min_level, -l2, -l1, l0, -scoped, risk, soft, tier, unverbal, label_length, tokens, repeats, direct, facts, sum_rank, i, j, k) = 1""")
def select_distractors(spark, d):
    """The whole objective: score sum, least score, cover size, rationale key, rank sum, positions."""
    return P.select(rationales(spark, d)).select("answer", "policy", "i", "j", "k", "size", "sum_score", F.array_join("facts", ";").alias("facts"))


@query("WITH " + MASKS + """, n AS (SELECT answer, i, j, k, count(*) FILTER (WHERE mask = 1) AS a, count(*) FILTER (WHERE mask = 2) AS b, count(*) FILTER (WHERE mask = 3) AS c, count(*) FILTER (WHERE mask = 4) AS d,
count(*) FILTER (WHERE mask = 5) AS e, count(*) FILTER (WHERE mask = 6) AS f, count(*) FILTER (WHERE mask = 7) AS g FROM masks WHERE lv = 2 GROUP BY 1, 2, 3, 4)
SELECT n.answer, n.i, n.j, n.k, size, CASE size WHEN 1 THEN g WHEN 2 THEN a * f + b * e + d * c + c * e + c * f + e * f ELSE a * b * d END AS n
FROM n JOIN sizes s ON n.answer = s.answer AND n.i = s.i AND n.j = s.j AND n.k = s.k AND s.lv = 2 WHERE size <= 3""")
def count_minimum_rationales(spark, d):
    m = K.masks(K.triples_of(cands(spark, d)), matrix(spark, d), 2)
    return K.count_minimum(m, K.cover_size(m))


@query("WITH " + MATRIX + """, s AS (SELECT c.answer, c.cand, c.pos, c.score, count(*) FILTER (WHERE level = 3) AS l3, count(*) FILTER (WHERE level = 2) AS l2, count(*) FILTER (WHERE level = 1) AS l1
  FROM cands c LEFT JOIN matrix m ON m.answer = c.answer AND m.cand = c.cand GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY l3 DESC, l2 DESC, l1 DESC, pos, cand) AS turn FROM s WHERE pos > 3)
SELECT answer, cand, pos, score, 'RANK' AS way FROM s WHERE pos <= 3 UNION ALL SELECT answer, cand, pos, score, 'RESCUE' FROM r WHERE turn <= 1""")
def pool_exact_rescue(spark, d):
    return K.pool(cands(spark, d), matrix(spark, d), 4)


@query("WITH " + MATRIX + """, ch AS (SELECT answer, key, value FROM (SELECT DISTINCT answer, key, value FROM matrix) QUALIFY row_number() OVER (PARTITION BY answer ORDER BY key, value) <= 2),
b AS (SELECT m.answer, m.cand, max(level) AS best FROM matrix m JOIN ch ON ch.answer = m.answer AND ch.key = m.key AND ch.value = m.value GROUP BY 1, 2)
SELECT answer, 1 + count(*) FILTER (WHERE best = 0) AS group_size, (1 + count(*) FILTER (WHERE best = 0))::DOUBLE / (count(*) + 1) AS ratio, count(*) FILTER (WHERE best = 0) = 0 AS identifies FROM b GROUP BY answer""")
def local_pool_anonymity(spark, d):
    m = matrix(spark, d)
    chosen = R.top_k(m.select("answer", "key", "value").distinct(), "answer", ["key", "value"], 2).drop("place")
    return K.local_anonymity(chosen, m)


# -- metrics ---------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderstatus AS grp, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1""")
def describe_stats(spark, d):
    return M.describe(T.read(spark, d, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_totalprice").alias("x")))


@query("SELECT l_returnflag AS grp, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def percentile_rollup(spark, d):
    return M.percentiles(T.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("x")), (0.5, 0.9, 0.95))


@query("WITH " + MATRIX + " SELECT key, level, count(*) AS n, count(DISTINCT answer) AS answers FROM matrix GROUP BY GROUPING SETS ((), (key), (level), (key, level))")
def level_by_cohort_grouping_sets(spark, d):
    return M.grouping_sets(matrix(spark, d).select("key", "level", "answer"), ["key", "level"], [F.count("*").alias("n"), F.countDistinct("answer").alias("answers")])


@query("WITH " + MATRIX + """, m AS (SELECT count(DISTINCT answer) AS answers, count(DISTINCT CASE WHEN level >= 2 THEN answer END) AS covered, count(*) AS cells, count(*) FILTER (WHERE level >= 2) AS covered_cells FROM matrix)
SELECT 'answers' AS metric, answers::DOUBLE AS value, NULL::BIGINT AS denominator FROM m UNION ALL SELECT 'covered_answers_pct', round(100.0 * covered / answers, 2), answers FROM m UNION ALL SELECT 'covered_cells_pct', round(100.0 * covered_cells / cells, 2), cells FROM m""")
def batch_coverage_metrics(spark, d):
    return M.coverage(matrix(spark, d))


@query("WITH " + MATRIX + " SELECT level, count(*) AS n FROM matrix GROUP BY level")
def evidence_level_histogram(spark, d):
    return matrix(spark, d).groupBy("level").agg(F.count("*").alias("n"))


@query("WITH " + MATRIX + """ SELECT answer, cand, max(level) AS best, count(*) FILTER (WHERE level = 3) AS n3, count(*) FILTER (WHERE level = 2) AS n2,
count(*) FILTER (WHERE level = 1) AS n1, count(*) FILTER (WHERE level = 0) AS n0 FROM matrix GROUP BY answer, cand""")
def candidate_evidence_summary(spark, d):
    counts = [F.count_if(F.col("level") == k).alias(f"n{k}") for k in (3, 2, 1, 0)]
    return matrix(spark, d).groupBy("answer", "cand").agg(F.max("level").alias("best"), *counts)


@query("""WITH m AS (SELECT o_orderstatus AS grp, count(*)::DOUBLE AS orders, round(avg(o_totalprice), 4)::DOUBLE AS mean_price, count(DISTINCT o_custkey)::DOUBLE AS customers FROM orders GROUP BY 1)
SELECT grp, metric, value FROM m UNPIVOT (value FOR metric IN (orders, mean_price, customers))""")
def metrics_unpivot(spark, d):
    o = T.read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("grp"))
    m = o.agg(F.count("*").cast("double").alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.countDistinct("o_custkey").cast("double").alias("customers"))
    return m.unpivot("grp", ["orders", "mean_price", "customers"], "metric", "value")


from . import choices, files, inventory, names  # noqa: E402, F401  registers further queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_distractors(spark, sf_dir)
