from itertools import combinations

from contrasta.operators import rationale as P

LEVELS = {(1, "k", "a"): [2, 0, 0, 1], (1, "k", "b"): [0, 3, 2, 1], (1, "m", "c"): [2, 2, 0, 1], (1, "m", "d"): [0, 1, 3, 0], (2, "k", "a"): [1, 1, 0, 0], (2, "m", "z"): [0, 0, 1, 1], (3, "k", "a"): [0, 0, 0, 0]}


def frames(spark):
    cands = spark.createDataFrame([(a, 10 * a + p, p, 1 - p / 100) for a in (1, 2, 3) for p in range(1, 5)], "answer long, cand long, pos int, score double")
    rows = [(a, 10 * a + p, p, 1 - p / 100, k, v, n, "FORMAL_PROOF" if n == 3 else "NONE", "NONE") for (a, k, v), levels in LEVELS.items() for p, n in enumerate(levels, 1)]
    return cands, spark.createDataFrame(rows, "answer long, cand long, pos int, score double, key string, value string, level int, basis string, risk string")


def least(a, combo, level):
    """Size of the least cover and all covers of that size."""
    facts = {f"{k}|{v}": {p for p in combo if ls[p - 1] >= level} for (x, k, v), ls in LEVELS.items() if x == a}
    for size in (1, 2, 3):
        found = [c for c in combinations(sorted(facts), size) if set().union(*(facts[f] for f in c)) == set(combo)]
        if found:
            return size, found
    return 4, []


def test_rationales_and_levels_come_from_one_row_per_answer(spark):
    cands, matrix = frames(spark)
    rows = P.rationales(cands, matrix, {"k": 1}, ("m",))
    want = set()
    for a in (1, 2, 3):
        for level in (3, 2, 1):
            sized = [(-round(3 - sum(c) / 100, 9), max(c), least(a, c, level)[0], c) for c in combinations(range(1, 5), 3) if least(a, c, level)[0] <= 3]
            if sized:
                want |= {(a, *c, n, f) for s, m, n, c in sized if (s, m, n) == min(sized)[:3] for f in least(a, c, level)[1]}
                break
    assert {(r.answer, r.i, r.j, r.k, r.size, tuple(r.facts)) for r in rows.collect()} == want
    levels = P.strongest_level(cands, matrix)
    sizes = {(a, *c): [least(a, c, n)[0] for n in (1, 2, 3)] for a in (1, 2, 3) for c in combinations(range(1, 5), 3)}
    assert {(r.answer, r.i, r.j, r.k): (r.size, r.level) for r in levels.collect()} == {c: (s[0], max(n + 1 for n in range(3) if s[n] == s[0])) for c, s in sizes.items() if s[0] <= 3}
    for df in (rows, levels):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
