import random
from collections import Counter
from itertools import combinations

import pytest

from contrasta.operators.covers import least_covers, minimum_covers


def search(facts, k):
    """(covered, size, n, weight, chosen) by looking at every subset of facts up to k."""
    facts = [f for f in facts if f[1]]
    goal = 0
    for f in facts:
        goal |= f[1]
    for size in range(1, k + 1):
        found = []
        for some in combinations(sorted(facts), size):
            union = 0
            for f in some:
                union |= f[1]
            if union == goal:
                found.append((sum(f[2] for f in some), tuple(f[0] for f in some)))
        if found:
            return goal, size, len(found), *min(found), {x[1] for x in found}
    return None


@pytest.mark.parametrize("k", range(1, 7))
def test_equals_search(spark, k):
    r = random.Random(k)
    cases = {c: [(f"f{i:02d}", r.choice([0, *[r.randrange(1 << k) for _ in range(3)]]), r.randint(1, 3)) for i in range(r.choice([1, 2, 6, 9]))] for c in range(25)}
    rows = [(c, name, mask, w) for c, fs in cases.items() for name, mask, w in fs]
    facts = spark.createDataFrame(rows, "c int, name string, mask int, weight int")
    covers = least_covers(facts, ["c"], ["name"], k, 2)
    got = {x.c: x for x in covers.collect()}
    every = Counter()
    sets = {}
    for x in minimum_covers(facts, covers, ["c"], ["name"]).collect():
        every[x.c] += 1
        sets.setdefault(x.c, set()).add(tuple(f.name for f in x.chosen))
    for c, fs in cases.items():
        want = search(fs, k)
        if want is None:
            assert c not in got
            continue
        x = got[c]
        assert (x.covered, x.size, x.n, x.weight, tuple(f.name for f in x.chosen)) == want[:5]
        assert x.full == (want[0] == (1 << k) - 1) and x.feasible == (x.full and x.size <= 2) and x.coverage == want[0].bit_count()
        assert every[c] == want[2] and sets[c] == want[5]


def test_bounds(spark):
    facts = spark.createDataFrame([(1, "a", 0, 1)], "c int, name string, mask int, weight int")
    assert least_covers(facts, ["c"], ["name"], 3, 3).count() == 0
    for k, rho in ((0, 1), (9, 1), (3, 0)):
        with pytest.raises(ValueError):
            least_covers(facts, ["c"], ["name"], k, rho)
