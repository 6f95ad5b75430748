import itertools
import random

import pytest

from contrasta.operators import overlap as O


def plain(cands, facts, theta=0.6):
    def similar(x, y):
        rows = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, rows[0] = rows[0], i
            for j, b in enumerate(y, 1):
                last, rows[j] = rows[j], min(rows[j] + 1, rows[j - 1] + 1, last + (a != b))
        return 1 - rows[-1] / max(len(x), len(y), 1)

    out = {}
    for answer, cs in cands.items():
        mine, ranked = facts.get(answer, set()), []
        for c in cs:
            theirs = facts.get(c, set())
            total = 0.0
            for key in {k for k, _ in mine - theirs} & {k for k, _ in theirs - mine}:
                xs, ys = ([v for k, v in sorted(s) if k == key] for s in (mine - theirs, theirs - mine))
                xs, ys = sorted((xs, ys), key=len)
                total += max(sum(s for x, y in zip(xs, some, strict=True) if (s := similar(x, y)) >= theta) for some in itertools.permutations(ys, len(xs)))
            strict = len(mine & theirs)
            ranked.append((not theirs, -(strict + 0.5 * total), c, strict, total, len(mine - theirs)))
        ranked.sort()
        pool = [(c, -s) for rejected, s, c, _, _, d in ranked if not rejected and d > 0]
        best, chosen = max((s for _, s in pool), default=0) or 1.0, []
        while pool and len(chosen) < 3:
            found = []
            for c, s in pool:
                red = max((len(facts[c] & facts[x]) / max(len(facts[c]), len(facts[x])) for x in chosen), default=0.0)
                if red < 0.9:
                    found.append((-(0.75 * (s / best) - 0.25 * red), c))
            if not found:
                break
            chosen.append(min(found)[1])
            pool = [x for x in pool if x[0] != chosen[-1]]
        if not mine - set().union(*[facts[c] for c in chosen]) if chosen else True:
            chosen = []
        out[answer] = ranked, chosen
    return out


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_lists(spark, seed):
    r = random.Random(seed)
    names = [f"e{i:02d}" for i in range(24)]
    words = ["1995Q1", "1995Q2", "1996Q1", "1995", "abcdef", "abcdeg", "xbcdeg", "zz"]
    facts = {n: {(r.choice("kpq"), r.choice(words)) for _ in range(r.choice([0, 3, 6, 9]))} for n in names}
    cands = {a: r.sample([n for n in names if n != a], 7) for a in names[:10]}
    f = spark.createDataFrame([(n, k, v) for n, s in facts.items() for k, v in s], "entity string, key string, value string")
    c = spark.createDataFrame([(a, x) for a, xs in cands.items() for x in xs], "answer string, cand string")
    ranked = O.ranking(c, f)
    got, chosen = {}, {}
    for x in ranked.orderBy("answer", "rank").collect():
        got.setdefault(x.answer, []).append(x)
    for x in O.diverse(ranked, f).orderBy("turn").collect():
        chosen.setdefault(x.answer, []).append(x.cand)
    for a, (want, picks) in plain(cands, facts).items():
        assert [(x.rejected, x.cand, x.strict, x.distinguishing) for x in got[a]] == [(w[0], w[2], w[3], w[5]) for w in want]
        assert [(x.score, x.loose) for x in got[a]] == [(pytest.approx(-w[1]), pytest.approx(w[4])) for w in want]
        assert chosen.get(a, []) == picks


def test_a_pair_is_one_row(spark):
    """Facts move as sets: no join by key or value, and turns of the choice need no shuffle of their own."""
    f = spark.createDataFrame([(e, k, v) for e in "abcd" for k in "kp" for v in ("1995Q1", "1996Q2", e)] + [("a", "k", None)], "entity string, key string, value string")
    c = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "none"), ("none", "b")], "answer string, cand string")
    ranked = O.ranking(c, f, near=0.0)
    got = {(r.answer, r.cand): (r.strict, r.distinguishing, r.rejected) for r in ranked.collect()}
    assert got == {("a", "b"): (4, 3, False), ("a", "c"): (4, 3, False), ("a", "d"): (4, 3, False), ("a", "none"): (0, 7, True), ("none", "b"): (0, 0, False)}
    plan = O.diverse(ranked, f)._jdf.queryExecution().optimizedPlan().toString()
    assert [j for j in plan.split("\n") if "Join" in j and "value" in j and "LeftOuter" not in j] == []
    assert sorted((r.cand, r.turn) for r in O.diverse(ranked, f).collect()) == [("b", 1), ("c", 2), ("d", 3)]
    assert all(r.strict == 4 and abs(r.loose) < 1e-9 for r in O.ranking(c, f).where("answer = 'a' and cand <> 'none'").collect())
