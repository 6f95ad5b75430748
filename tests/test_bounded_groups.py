import random

from pyspark.sql import functions as F

from contrasta.operators import metrics as M
from contrasta.operators import relations as L


def test_percentiles_are_exact_without_a_group_in_one_task(spark):
    r = random.Random(3)
    rows = [(g, r.choice([None, float(r.randint(0, 40)), r.random() * 40])) for g in ("a", "a", "b", None) for _ in range(300)] + [("one", 7.5), ("none", None)]
    df = spark.createDataFrame(rows, "grp string, x double").repartition(4)
    at = (0.0, 0.5, 0.9, 0.95, 1.0)
    want = df.groupBy("grp").agg(*[F.round(F.percentile("x", F.lit(q)), 4).alias(f"p{round(q * 100)}") for q in at])
    got = M.percentiles(df, at)
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()}
    assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_facts_that_no_candidate_has_come_from_sets(spark):
    facts = spark.createDataFrame([(1, "k", "a"), (1, "k", "b"), (1, "m", None), (1, "m", "c"), (2, "k", "a"), (2, "m", None), (3, "m", "b"), (3, "k", "c")], "entity long, key string, value string")
    cands = spark.createDataFrame([(1, 2), (1, 3), (2, 9), (3, 1), (8, 1)], "answer long, cand long")
    got = L.common_to_none(cands, facts)
    assert {tuple(x) for x in got.collect()} == {(1, "k", "b"), (1, "m", None), (1, "m", "c"), (2, "k", "a"), (2, "m", None), (3, "m", "b"), (3, "k", "c")}
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
