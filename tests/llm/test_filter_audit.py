import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from contrasta.llm.filter_audit import NAMES, audit, mask_cells, text_failures

WORDS = "alpha beta Gamma DELTA eps# zeta".split()


def brute(docs, labels):
    """Applies every order to every part, document by document."""
    flags = []
    for doc_id, text, source in docs:
        t = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        capitals = len(re.findall("[A-Z]", t))
        again = doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in docs)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": again}
        said = [(q, x) for i, q, x in labels if i is not None and i == doc_id]
        flags.append((source or "", {f for f in NAMES if fails[f]}, any(q == 1 for q, _ in said), any(x == 1 for _, x in said)))
    out, shapley = {}, {}
    for part in {p for p, *_ in flags}:
        for order in permutations(NAMES):
            left = [x for x in flags if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                failing = [x for x in left if f in x[1]]
                row = [len(left) - len(failing), len(failing), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in left + gone), sum(x[2] for x in failing), sum(x[3] for x in failing)]
                left = [x for x in left if f not in x[1]]
                gone += failing
                out[part, "".join(order), step] = row
                shapley[part, f] = shapley.get((part, f), 0) + len(failing)
    return {(k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    clash = d.select("doc_id", "text", "source", F.lit("x").alias("part"), F.lit(9).alias("mask"), F.lit(9).alias("n"), F.lit(9).alias("slot"), F.lit("z").alias("digest"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = audit(mask_cells(clash, lab, text_failures(F.col("text"))), NAMES).collect()
    return {((r.part, r.filter_order, r.step), r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}, len(rows)


@pytest.mark.parametrize("seed", range(2))
def test_brute_force(spark, seed):
    r = random.Random(seed)
    texts = [" ".join(r.choices(WORDS[: r.randint(1, 6)], k=r.choice([0, 3, 150, 220]))) for _ in range(12)] + [" ".join(f"w{i}" for i in range(n)) for n in (199, 200, 300)] + [None, "", "\t \n"]
    docs = [(r.choice([None, *range(40)]), r.choice(texts), r.choice([None, "", "a", "b"])) for _ in range(60)]
    labels = [(r.choice([None, *range(45)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(40)]
    want = brute(docs, labels)
    got, n = found(spark, docs, labels)
    assert got == want and n == len(want)


def test_odd_rows(spark):
    same = "capital X"
    docs = [(5, same, "a"), (5, same, "a"), (5, same, "b"), (7, same, None), (None, same, "a"), (None, same, "a"), (8, None, "a"), (9, "", "c")]
    want = brute(docs, [(5, 1, 0), (5, 0, 1), (9, 1, 1)])
    assert found(spark, docs, [(5, 1, 0), (5, 0, 1), (9, 1, 1)])[0] == want
    assert found(spark, [], [])[0] == set()
    long = "w " * 300_000
    assert found(spark, [(1, long, "a")], [])[0] == brute([(1, long, "a")], [])
    with pytest.raises(ValueError):
        audit(spark.range(1), "AAB")


def test_edges(spark):
    """At the bound itself no filter fails."""
    docs = [(1, " ".join(["a", "b"] * 100), "a"), (2, " ".join(f"w{i}" for i in range(200)), "a"), (3, "A" + "b" * 49, "a"), (4, "AA" + "b" * 49, "a"), (5, " ".join(["x", "x", "y", "y", "x"] * 40), "a")]
    assert found(spark, docs, [])[0] == brute(docs, [])
