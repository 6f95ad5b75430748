from contrasta.operators import evidence as E

POLICY = E.Policy(hierarchical=("at",), covered=("at", "year"), equivalent=(("five", "four"),), scoped=(("rank", "one", "two"),), disjoint=(("F", "P"),), exclusive=(("status", ("F", "O")),), functional=("only",))
FACTS = [(e, k, v) for e, kvs in {
    1: {"at": ["h", "x", "q"], "rank": ["one", "four"], "status": ["F"], "year": ["y", "z"], "only": ["m"]},
    2: {"at": ["q", "y"], "rank": ["two", "five"], "status": ["O", "P"], "year": ["z"], "only": ["n"]},
    3: {"at": ["z", "h"], "rank": ["six"], "status": ["P"], "year": ["q", "h"]},
    4: {"year": ["w"], "only": ["m", "n"]},
}.items() for k, vs in kvs.items() for v in vs]


def by_pairs(spark, cands, facts, edges, policy, rules):
    """The flags from classify(), a row per pair of values."""
    rel = {(r.key, r.claim, r.obj): r.relation for r in E.classify(E.observed(cands, facts).where("obj is not null"), edges, policy).collect()}
    most, sets, out = {(r.answer, r.key): r.most for r in rules.collect() if r.status == "ACTIVE"}, {}, set()
    for e, k, v in FACTS:
        sets.setdefault((e, k), []).append(v)
    for c in cands.collect():
        for e, k, v in FACTS:
            if e != c.answer:
                continue
            objs = sets.get((c.cand, k), [])
            found = {rel[(k, v, o)] for o in objs}
            over, odd, gone = "CLAIM_UNDER_CANDIDATE" in found, "HIERARCHY_NOT_MODELLED" in found, "UNAVAILABLE" in found
            excluded = any(k == key and v in vs and o in vs and o != v for key, vs in policy.exclusive for o in objs)
            proof = excluded or (k in policy.functional and not (over or odd or gone))
            level = 1 if not objs else 0 if found & set(E.SUPPORTS) else 3 if proof else 2
            risk = "NONE" if level <= 1 else "PRESENT" if over else "UNRESOLVED" if gone else "HIERARCHY_UNMODELLED" if odd else "NONE"
            basis = "FORMAL_PROOF" if level == 3 else "SCOPED_EMPIRICAL" if level == 2 and (c.answer, k) in most and len(objs) <= most[(c.answer, k)] and not gone else "NONE"
            out.add((c.answer, c.cand, k, v, level, basis, risk))
    return out


def test_sets_say_what_pairs_say_without_pairs_as_rows(spark):
    cands = spark.createDataFrame([(a, b, p, 1.0) for a in (1, 2, 3, 4) for p, b in enumerate(x for x in (1, 2, 3, 4, 5) if x != a)], "answer long, cand long, pos int, score double")
    facts = spark.createDataFrame(FACTS, "entity long, key string, value string")
    edges = spark.createDataFrame([("q", "h"), ("h", "y"), ("y", "top")], "child string, parent string")
    rules = spark.createDataFrame([(a, k, 1, s) for a in (1, 2, 3) for k, s in (("rank", "ACTIVE"), ("at", "ACTIVE"), ("year", "INACTIVE"))], "answer long, key string, most long, status string")
    for policy in (POLICY, E.Policy(hierarchical=("at",), available=False), E.Policy()):
        rows = E.evidence(cands, facts, edges, policy, rules)
        assert {(r.answer, r.cand, r.key, r.value, r.level, r.basis, r.risk) for r in rows.collect()} == by_pairs(spark, cands, facts, edges, policy, rules)
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("obj") == 0
