from itertools import combinations

from contrasta.operators import kernel as K


def test_combinations_and_masks_need_no_join_of_candidates(spark):
    cands = spark.createDataFrame([(a, p, 1 - p / 100) for a in (1, 2) for p in range(1, 7 - a)], "answer long, pos int, score double")
    triples = K.triples_of(cands)
    assert {(r.answer, r.i, r.j, r.k) for r in triples.collect()} == {(a, *c) for a in (1, 2) for c in combinations(range(1, 7 - a), 3)}
    assert "Join" not in triples._jdf.queryExecution().optimizedPlan().toString()
    levels = {(1, "x", 1): 2, (1, "x", 2): 1, (1, "x", 4): 3, (1, "y", 5): 2, (2, "x", 2): 0, (2, "y", 3): 2}
    matrix = spark.createDataFrame([(a, "k", v, p, n) for (a, v, p), n in levels.items()], "answer long, key string, value string, pos int, level int")
    want = {}
    for a in (1, 2):
        for c in combinations(range(1, 7 - a), 3):
            for v in "xy":
                m = sum(1 << b for b, p in enumerate(c) if levels.get((a, v, p), 0) >= 2)
                if m:
                    want[(a, *c, v)] = m
    assert {(r.answer, r.i, r.j, r.k, r.value): r["mask"] for r in K.masks(triples, matrix, 2).collect()} == want
