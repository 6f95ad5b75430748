"""Relations between values, and the evidence level of each answer fact against each candidate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stash import looked_up

#: Relations by which a candidate's value supports the claim.
SUPPORTS = ("EXACT_EQUAL", "CANONICALLY_EQUIVALENT", "SCOPED_VALUE_EQUIVALENT", "CANDIDATE_UNDER_CLAIM")
#: Levels in order of strength, as the numbers 0 to 3.
LEVELS = ("NOT_COVERED", "L0", "L1", "L2")
DEPTH = 4


@dataclass(frozen=True)
class Policy:
    """What is declared of values: small tables that come with the code, not with the data.

    hierarchical: keys whose values stand in a hierarchy. covered: those of them for which a value outside of it is reported.
    equivalent: pairs that denote the same; scoped: (key, a, b) that do for one key. disjoint: pairs that exclude each other.
    exclusive: (key, values) of a rule by which one value of an entity excludes the others. available: whether there is an index.
    """

    hierarchical: tuple[str, ...] = ()
    covered: tuple[str, ...] = ()
    equivalent: tuple[tuple[str, str], ...] = ()
    scoped: tuple[tuple[str, str, str], ...] = ()
    disjoint: tuple[tuple[str, str], ...] = ()
    exclusive: tuple[tuple[str, tuple[str, ...]], ...] = ()
    functional: tuple[str, ...] = ()
    available: bool = True
    representatives: dict[str, str] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.representatives.update(flatten(self.equivalent))


def flatten(pairs: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """Each source with the end of its chain; a cycle's smallest member stands for it."""
    step = dict(pairs)
    out = {}
    for x in step:
        seen = [x]
        while seen[-1] in step and step[seen[-1]] not in seen:
            seen.append(step[seen[-1]])
        end = seen[-1]
        out[x] = min(seen[seen.index(step[end]) :]) if end in step else end
    return out


def canonical(value: Column, policy: Policy) -> Column:
    """The representative of a value, or itself."""
    if not policy.representatives:
        return value
    return F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(policy.representatives.items()) for x in pair])[value], value)


def index_edges(edges: DataFrame, policy: Policy) -> DataFrame:
    """(child, parent): canonical, distinct, without loops on a node."""
    return edges.select(canonical(F.col("child"), policy).alias("child"), canonical(F.col("parent"), policy).alias("parent")).where("child <> parent").distinct()


def ancestors(edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node, ancestor, depth): every ancestor up to `depth` steps, with the fewest; a cycle ends where it began."""
    step = edges.select(F.col("child").alias("via"), F.col("parent").alias("next"))
    frontier = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    found = frontier
    for k in range(2, depth + 1):
        frontier = frontier.join(step, F.col("ancestor") == F.col("via")).where("node <> next").select("node", F.col("next").alias("ancestor"), F.lit(k).alias("depth")).distinct()
        found = found.union(frontier)
    return found.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def _any(pairs: tuple, *columns: Column) -> Column:
    """Whether the columns are one of some tuples of values."""
    out = F.lit(False)
    for p in pairs:
        hit = F.lit(True)
        for c, x in zip(columns, p, strict=True):
            hit = hit & (c == x)
        out = out | hit
    return out


def classify(pairs: DataFrame, edges: DataFrame, policy: Policy, depth: int = DEPTH) -> DataFrame:
    """(key, claim, obj, relation): one of nine relations of each distinct pair of values, by a fixed precedence."""
    rows = pairs.select("key", "claim", "obj").distinct()
    rows = rows.withColumns({"a": canonical(F.col("claim"), policy), "b": canonical(F.col("obj"), policy)})
    up = ancestors(edges, depth).select("node", "ancestor")
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    mark = F.lit(True)
    rows = rows.join(up.select(F.col("node").alias("b"), F.col("ancestor").alias("a"), mark.alias("under")), ["a", "b"], "left")
    rows = rows.join(up.select(F.col("node").alias("a"), F.col("ancestor").alias("b"), mark.alias("over")), ["a", "b"], "left")
    rows = rows.join(nodes.select(F.col("node").alias("a"), mark.alias("has_a")), "a", "left").join(nodes.select(F.col("node").alias("b"), mark.alias("has_b")), "b", "left")
    key, a, b = F.col("key"), F.col("a"), F.col("b")
    swapped = lambda ps: tuple(ps) + tuple((*p[:-2], p[-1], p[-2]) for p in ps)
    tree = key.isin(*policy.hierarchical) if policy.hierarchical else F.lit(False)
    told = key.isin(*policy.covered) if policy.covered else F.lit(False)
    relation = (
        F.when(F.col("claim") == F.col("obj"), "EXACT_EQUAL").when(a == b, "CANONICALLY_EQUIVALENT").when(F.lit(not policy.available), "UNAVAILABLE")
        .when(_any(swapped(policy.scoped), key, a, b), "SCOPED_VALUE_EQUIVALENT").when(tree & F.col("under").isNotNull(), "CANDIDATE_UNDER_CLAIM").when(tree & F.col("over").isNotNull(), "CLAIM_UNDER_CANDIDATE")
        .when(_any(swapped(policy.disjoint), a, b), "PROVEN_DISJOINT").when(told & (F.col("has_a").isNull() | F.col("has_b").isNull()), "HIERARCHY_NOT_MODELLED").otherwise("UNRELATED_OR_UNKNOWN")
    )
    return rows.select("key", "claim", "obj", relation.alias("relation"))


def observed(cands: DataFrame, facts: DataFrame) -> DataFrame:
    """(answer, cand, pos, score, key, claim, obj): each answer fact against each value of the candidate for its key; obj is null where it has none."""
    claims = cands.select("answer", "cand", "pos", "score").join(facts.select(F.col("entity").alias("answer"), "key", F.col("value").alias("claim")), "answer")
    return claims.join(facts.select(F.col("entity").alias("cand"), "key", F.col("value").alias("obj")), ["cand", "key"], "left").select("answer", "cand", "pos", "score", "key", "claim", "obj")


def profiles(facts: DataFrame, edges: DataFrame, policy: Policy, depth: int = DEPTH) -> DataFrame:
    """(entity, sets): per key the facts with what is known of each value, and the sets that a claim is held against.

    sets: array of (key, facts: array of (value, canon, up, inside), values, canons, ups, odd). up: the ancestors, of keys in a
    hierarchy; inside: whether the hierarchy has it; ups: of all values; odd: the canonical values outside of the hierarchy.
    """
    # one small table: each broadcast of a table keyed by text takes a page of 64 MB on the driver. Its size is known before the
    # join is planned: else all facts would be shuffled by their values, of which there are few
    edges = looked_up(edges)
    nothing = F.lit(None).cast("string")
    nodes = ancestors(edges, depth).select("node", "ancestor").union(edges.select("child", nothing)).union(edges.select("parent", nothing))
    nodes = nodes.groupBy(F.col("node").alias("canon")).agg(F.collect_set("ancestor").alias("up"), F.lit(True).alias("inside"))
    nodes = looked_up(nodes)
    rows = facts.select("entity", "key", "value", canonical(F.col("value"), policy).alias("canon")).join(nodes, "canon", "left")
    tree = F.col("key").isin(*policy.hierarchical) if policy.hierarchical else F.lit(False)
    one = F.struct("value", "canon", F.coalesce(F.when(tree, F.col("up")), F.array().cast("array<string>")).alias("up"), F.coalesce("inside", F.lit(False)).alias("inside"))
    per = rows.groupBy("entity", "key").agg(F.collect_set(one).alias("facts"))
    of = lambda name: F.transform("facts", lambda x: x[name])
    odd = F.transform(F.filter("facts", lambda x: ~x.inside), lambda x: x.canon)
    per = per.select("entity", F.struct("key", "facts", of("value").alias("values"), of("canon").alias("canons"), F.array_distinct(F.flatten(of("up"))).alias("ups"), odd.alias("odd")).alias("set"))
    return per.groupBy("entity").agg(F.collect_list("set").alias("sets"))


def _flags(policy: Policy, t: str = "t") -> dict[str, Column]:
    """What classify() says of the claim `c` against any value of the candidate's sets `t`, without pairs as rows.

    supported holds first; over and unmodelled are read only where a claim is not supported, unmodelled only where it isn't over,
    so that values which a relation of higher precedence takes need no second look. Equal values have one representative.
    """
    key, a = F.col("key"), F.col("c.canon")
    none, yes = F.array().cast("array<string>"), F.lit(policy.available)

    def partners(rules: list[tuple[Column, str]]) -> Column:
        return F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in rules])).cast("array<string>") if rules else none

    in_ = lambda keys: key.isin(*keys) if keys else F.lit(False)
    scoped = partners([(((key == k) & (a == x)), y) for k, p, q in policy.scoped for x, y in ((p, q), (q, p))])
    apart = partners([(a == x, y) for p, q in policy.disjoint for x, y in ((p, q), (q, p))])
    excluded = partners([((key == k) & (F.col("c.value") == x), y) for k, values in policy.exclusive for x in values for y in values if x != y])
    meets = lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False))
    has = lambda x, y: F.coalesce(F.array_contains(x, y), F.lit(False))
    left = lambda x: F.coalesce(F.size(F.array_except(x, apart)) > 0, F.lit(False))
    supported = has(f"{t}.canons", a) | (yes & (meets(f"{t}.canons", scoped) | (in_(policy.hierarchical) & has(f"{t}.ups", a))))
    over = yes & in_(policy.hierarchical) & meets(f"{t}.canons", F.col("c.up"))
    unmodelled = yes & in_(policy.covered) & ((~F.col("c.inside") & left(f"{t}.canons")) | left(f"{t}.odd"))
    n = F.coalesce(F.col(f"{t}.n"), F.lit(0)).cast("long")
    return {"n": n, "supported": supported, "over": over, "unmodelled": unmodelled, "unavailable": ~yes & (n > 0), "excluded": meets(f"{t}.ruled", excluded)}


def _level(policy: Policy, of: dict[str, Column]) -> Column:
    """The level that flags give."""
    single = F.col("key").isin(*policy.functional) if policy.functional else F.lit(False)
    proof = of["excluded"] | (single & ~of["over"] & ~of["unmodelled"] & ~of["unavailable"])
    return F.when(of["n"] == 0, 1).when(of["supported"], 0).when(proof, 3).otherwise(2)


def _moved(policy: Policy) -> Column:
    """A candidate's sets by key, as they move to the answer: how many values, their canonical forms, ancestors, those outside of the hierarchy, and the values that a rule names."""
    named: dict[str, list[str]] = {}
    for k, values in policy.exclusive:
        named.setdefault(k, []).extend(values)

    def ruled(x: Column) -> Column:
        out = F.array().cast("array<string>")
        for k, values in named.items():
            out = F.when(x.key == k, F.array_intersect(x["values"], F.array(*map(F.lit, values)))).otherwise(out)
        return out

    one = lambda x: F.struct(F.size(x["values"]).alias("n"), F.array_distinct(x.canons).alias("canons"), x.ups.alias("ups"), x.odd.alias("odd"), ruled(x).alias("ruled"))
    return F.map_from_entries(F.transform("sets", lambda x: F.struct(x.key, one(x))))


def _beside(cands: DataFrame, facts: DataFrame, edges: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """The candidates with their sets (theirs), and (answer, own) to be joined with them by answer."""
    known = profiles(facts, edges, policy)
    # the candidate's sets first: only they move on to the answer, whose own sets and rules then stay in place
    rows = cands.join(known.select(F.col("entity").alias("cand"), _moved(policy).alias("theirs")).hint("merge"), "cand", "left")
    return rows, known.select(F.col("entity").alias("answer"), F.col("sets").alias("own")).hint("merge")


def evidence(cands: DataFrame, facts: DataFrame, edges: DataFrame, policy: Policy, rules: DataFrame | None = None) -> DataFrame:
    """(answer, cand, pos, score, key, value, level, reason, basis, risk): the one place where a level is decided.

    No value for the key: L0. A value that supports the claim: NOT_COVERED. A rule with all its premises: L2 with a formal
    proof; rules are mutually exclusive values, and keys of one value only where every value of the candidate is apart from the
    claim. Else L1, annotated where the key is single-valued in the answer's scope (rules: answer, key, status ACTIVE,
    most) and the candidate keeps to it.
    """
    rows, own = _beside(cands.select("answer", "cand", "pos", "score"), facts, edges, policy)
    rows = rows.join(own, "answer")
    if rules is not None:
        active = rules.where("status = 'ACTIVE'").groupBy("answer").agg(F.map_from_entries(F.collect_list(F.struct("key", "most"))).alias("most"))
        rows = rows.join(active.hint("merge"), "answer", "left")
    else:
        rows = rows.withColumn("most", F.lit(None).cast("map<string,bigint>"))
    base = ["answer", "cand", "pos", "score"]
    rows = rows.select(*base, "theirs", "most", F.explode("own").alias("o")).select(*base, F.col("o.key").alias("key"), F.col("theirs")[F.col("o.key")].alias("t"), F.col("most")[F.col("o.key")].alias("rule_most"), F.explode("o.facts").alias("c"))
    flags = _flags(policy)
    rows = rows.select(*base, "key", F.col("c.value").alias("value"), *[c.alias(k) for k, c in flags.items()], "rule_most")
    rows = rows.withColumn("level", _level(policy, {k: F.col(k) for k in flags}))
    risk = F.when(F.col("level") <= 1, "NONE").when(F.col("over"), "PRESENT").when(F.col("unavailable"), "UNRESOLVED").when(F.col("unmodelled"), "HIERARCHY_UNMODELLED").otherwise("NONE")
    reason = F.when(F.col("level") == 1, "ABSENCE_ONLY").when(F.col("level") == 0, "SUPPORTED").when(F.col("level") == 3, "FORMAL_CONFLICT").otherwise("POSITIVE_VALUE_CONTRAST")
    scoped = F.col("rule_most").isNotNull() & (F.col("n") <= F.col("rule_most")) & ~F.col("unavailable")
    basis = F.when(F.col("level") == 3, "FORMAL_PROOF").when((F.col("level") == 2) & scoped, "SCOPED_EMPIRICAL").otherwise("NONE")
    return rows.select("answer", "cand", "pos", "score", "key", "value", "level", reason.alias("reason"), basis.alias("basis"), risk.alias("risk"))


def fact_masks(cands: DataFrame, facts: DataFrame, edges: DataFrame, policy: Policy, k: int, least: int) -> DataFrame:
    """(answer, key, value, mask): the facts of the answers with a bit for each of the first k candidates, 2^(pos - 1), against which the fact has at least that level.

    As evidence() says, but an answer's candidates are one row before its facts are: no row per fact and candidate is made, grouped or held.
    """
    rows, own = _beside(cands.where(F.col("pos").between(1, k)).select("answer", "cand", "pos"), facts, edges, policy)
    # one candidate per position; after the join rows lie sorted by answer, so that one answer is held at a time
    at = [F.first(F.when(F.col("pos") == p, F.col("theirs")), ignorenulls=True).alias(f"at{p}") for p in range(1, k + 1)]
    rows = rows.join(own, "answer").groupBy("answer").agg(*at, F.bit_or(F.expr("shiftleft(1, pos - 1)")).alias("there"), F.first("own").alias("own"))
    rows = rows.select("answer", "there", *[f"at{p}" for p in range(1, k + 1)], F.explode("own").alias("o"))
    rows = rows.select("answer", "there", F.col("o.key").alias("key"), *[F.col(f"at{p}")[F.col("o.key")].alias(f"t{p}") for p in range(1, k + 1)], F.explode("o.facts").alias("c"))
    mask = F.lit(0)
    for p in range(1, k + 1):
        told = F.getbit("there", F.lit(p - 1)) == 1
        mask = mask + F.when(told & (_level(policy, _flags(policy, f"t{p}")) >= least), 1 << p - 1).otherwise(0)
    return rows.select("answer", "key", F.col("c.value").alias("value"), mask.alias("mask"))


def weakest(levels: Column) -> Column:
    """The name of the weakest of an array of levels; that of an empty one is NOT_COVERED."""
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.coalesce(F.array_min(levels), F.lit(0)) + 1)


def coverage_status(n: Column, k: int) -> Column:
    return F.when(n == k, "FULL").when(n == 0, "ZERO").otherwise(F.concat(F.lit("PARTIAL_"), n.cast("string"), F.lit(f"_OF_{k}")))


def basis_violations(rows: DataFrame) -> DataFrame:
    """Rows whose basis doesn't go with their level: L0 and less carry none, only L2 carries a formal proof, and always."""
    allowed = F.when(F.col("level") <= 1, F.col("basis") == "NONE").when(F.col("level") == 2, F.col("basis").isin("NONE", "SCOPED_EMPIRICAL")).otherwise(F.col("basis") == "FORMAL_PROOF")
    return rows.where(~F.coalesce(allowed, F.lit(False)))
