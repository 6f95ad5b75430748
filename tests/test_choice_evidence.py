import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from contrasta.operators import choice_evidence as H


def instance(seed, n):
    r = random.Random(seed)
    given = H.Given(r.choice([0, 1, 3]), frozenset(r.sample("xyz", r.randint(0, 2))), frozenset(r.sample("pqrs", r.randint(0, 2))))
    groups = []
    for i in range(n):
        own = r.randint(1, 15)
        kind = r.random()
        groups.append(H.Group(i, r.choice("vwxyz"), r.choice("pqrstu"), own, own.bit_count(), r.choice([0, 0, 1, 2]), r.choice([0, 0, 1]), r.randint(1, 3), r.randint(1, 4), (own & ~1) if kind < 0.25 else 0, kind > 0.25 and own == 1, False))
    return r, given, groups


def enumerated(groups, key, order, feasible):
    """Every subset; of equal keys the one whose earliest groups are taken."""
    best = None
    for size in range(len(groups) + 1):
        for some in combinations(groups, size):
            if feasible(some):
                k = key(some)
                vector = [int(g in some) for g in groups]
                cand = (tuple(k[i] for i in order), [-x for x in vector], [g.place for g in some])
                if best is None or cand < best:
                    best = cand
    return best


@pytest.mark.parametrize("seed", range(40))
def test_before_equals_enumeration(seed):
    r, given, groups = instance(seed, 11)
    order = r.sample(range(6), 6) if seed % 2 else list(range(6))
    budget = r.randint(0, 5)
    want = enumerated(groups, lambda s: H.before_key(given, s), order, lambda s: len(s) <= budget)
    status, chosen, nodes = H.solve_before(groups, given, budget, order, 10**6)
    assert status == "OPTIMAL" and [g.place for g in chosen] == want[2] and nodes <= 2 ** (len(groups) + 1)


@pytest.mark.parametrize("seed", range(40))
def test_after_equals_enumeration(seed):
    r, given, groups = instance(100 + seed, 11)
    order = r.sample(range(7), 7) if seed % 2 else list(range(7))
    budget, lone = r.randint(1, 6), r.randint(0, 2)
    groups = [H.Group(**{**g.__dict__, "fixed": r.random() < 0.1 and not g.answer_only}) for g in groups]
    wanted = 0
    for g in groups:
        wanted |= g.alt

    def feasible(some):
        have = 0
        for g in some:
            have |= g.alt
        return have == wanted and len({g.node for g in some} | given.nodes) <= budget and sum(g.answer_only for g in some) <= lone and all(g in some for g in groups if g.fixed)

    want = enumerated(groups, lambda s: H.after_key(given, s), order, feasible)
    status, chosen, _ = H.solve_after(groups, given, budget, lone, order, 10**6)
    if len(given.nodes) > budget:
        assert status == "MANDATORY_EXCEEDS_BUDGET"
    elif want is None:
        assert status == "INFEASIBLE" and chosen is None
    else:
        assert status == "OPTIMAL" and [g.place for g in chosen] == want[2]


def test_sixteen_groups():
    r, given, groups = instance(7, 16)
    want = enumerated(groups, lambda s: H.before_key(given, s), range(6), lambda s: len(s) <= 4)
    assert [g.place for g in H.solve_before(groups, given, 4, range(6), 10**6)[1]] == want[2]


def test_bounds_prune():
    """Many groups that tie in what they share: floors on tiers and words leave few branches."""
    groups = [H.Group(i, i % 7, i, 7, 3, 0, 0, 1 + i % 3, 1 + i % 5) for i in range(200)]
    status, chosen, nodes = H.solve_before(groups, H.Given(0, frozenset(), frozenset()), 4, range(6), 10**6)
    assert status == "OPTIMAL" and len(chosen) == 4 and nodes < 20_000
    assert H.solve_before(groups, H.Given(0, frozenset(), frozenset()), 4, range(6), 10)[0] == "LIMIT"


EDGES = "item int, letter int, family string, node string, tier int, verbal boolean, soft boolean, eligible boolean"


def test_groundings(spark):
    e = lambda letter, family, node, **k: (1, letter, family, node, k.get("tier", 1), k.get("verbal", True), k.get("soft", False), k.get("eligible", True))
    edges = spark.createDataFrame([e(0, "date", "1995"), e(1, "date", "1995Q1"), e(2, "date", "odd"), e(0, "kind", "x", soft=True), e(0, "kind", "x"), e(1, "kind", "x", verbal=False), e(2, "kind", "y", eligible=False), e(0, None, "z"), e(0, "kind", None)], EDGES)
    up = spark.createDataFrame([("1995Q1", "1995"), ("1995Q1", "1995H1"), ("1995H1", "1995")], "node string, ancestor string")
    known = spark.createDataFrame([("1995",), ("1995Q1",), ("1995H1",)], "node string")
    got = {(r.family, r.node): r for r in H.universe(edges, up, known, ["date"]).collect()}
    assert set(got) == {("date", "1995"), ("date", "1995Q1"), ("date", "odd"), ("kind", "x"), ("kind", "y")}
    year, quarter, odd, x = got["date", "1995"], got["date", "1995Q1"], got["date", "odd"], got["kind", "x"]
    assert (year.own, year.absent, year.contained, year.alternative, year.risk_present, year.risk_unmodelled) == (1, 8, 2, 4, 0, 4)
    assert (quarter.own, quarter.contained, quarter.alternative, quarter.risk_present, quarter.risk_unmodelled) == (2, 0, 5, 1, 4)
    assert (odd.own, odd.alternative, odd.risk_present, odd.risk_unmodelled) == (4, 3, 0, 3)
    assert (x.own, x.absent, x.alternative, x.soft, x.verbal, x.eligible) == (3, 8, 4, True, False, True)
    assert not got["kind", "y"].eligible
    rationale = spark.createDataFrame([(1, "date", "1995", 4)], "item int, family string, node string, covers int")
    roles = {(r.family, r.node): (r.role, r.alt_for, r.place) for r in H.tiers(H.universe(edges, up, known, ["date"]), rationale).collect()}
    assert roles["date", "1995"][0] == "MANDATORY" and roles["date", "1995"][2] == 0
    assert roles["date", "odd"][:2] == ("ALTERNATIVE", 4) and roles["date", "1995Q1"][0] == "OPTIONAL" and roles["kind", "y"][0] == "EXCLUDED"
    assert sorted(r[2] for r in roles.values()) == [0, 1, 2, 3, 4]


def test_arms_and_bounds(spark):
    rows = [(1, f"f{i % 3}", f"n{i}", own, absent, 0, 4 - absent, 0, odd, 1 + i % 2, verbal, False, True, 0, "OPTIONAL", i) for i, (own, absent, odd, verbal) in enumerate([(3, 0, 0, True), (1, 0, 0, True), (14, 0, 0, True), (6, 8, 0, False), (7, 0, 8, True), (15, 0, 0, True)])]
    groups = spark.createDataFrame(rows, "item int, family string, node string, own int, absent int, contained int, alternative int, risk_present int, risk_unmodelled int, tier int, verbal boolean, soft boolean, eligible boolean, alt_for int, role string, place int")
    why = lambda arm: {r.place: r.w for r in groups.select("place", H.failed(arm).alias("w")).collect()}
    assert why("penalty") == {0: [], 1: ["ANSWER_ONLY"], 2: [], 3: ["UNVERBALIZABLE"], 4: [], 5: []}
    assert why("hard") == {0: [], 1: ["ANSWER_ONLY", "SUPPORT_BELOW_2"], 2: [], 3: ["UNVERBALIZABLE", "ABSENCE_ONLY"], 4: ["RISK_UNMODELLED"], 5: []}
    assert why("tolerate_unmodelled")[4] == [] and why("no_support_3_without_answer")[2] == ["SUPPORT_3_WITHOUT_ANSWER"] and why("none_without_answer")[3][-1] == "WITHOUT_ANSWER"
    with pytest.raises(ValueError):
        H.failed("other")
    kept = lambda **k: sorted(r.place for r in H.bound_optional(groups, **k).collect())
    assert kept(most=None) == [0, 1, 2, 3, 4, 5] and kept(most=2) == [4, 5]
    assert kept(most=0, per_family=1) == [0, 4, 5] and kept(most=4, per_family=1) == [0, 2, 4, 5]
    before = H.select_before(groups, "hard", 1).first()
    assert before.status == "OPTIMAL" and before.chosen == [5]
    after = H.select_after(groups.withColumn("item", F.lit(2)), H.select_before(groups, "hard", 1), 9, 0).first()
    assert after.status == "OPTIMAL" and 1 not in after.chosen
