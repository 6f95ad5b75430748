import duckdb
from oracle import assert_same, duck
from pyspark.sql import functions as F

from contrasta.operators import evidence as E
from contrasta.plans import catalogue as C
from contrasta.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_masks_are_the_evidence(spark):
    """Against any level; candidates without facts, and positions that an answer hasn't."""
    cands, facts = C.cands(spark, SF).where("not (answer % 3 = 0 and pos = 2)"), C.facts(spark, SF).where("entity % 7 <> 0")
    policy = E.Policy(hierarchical=("period",), covered=("period", "year"), equivalent=(("5-LOW", "4-NOT SPECIFIED"),), scoped=(("priority", "1-URGENT", "2-HIGH"),), disjoint=(("F", "P"),), exclusive=(("status", ("F", "O")), ("status", ("P", "F"))), functional=("year",))
    edges = C.period_edges(spark, SF)
    rows = E.evidence(cands, facts, edges, policy).select("answer", "pos", "key", "value", "level").toPandas()
    con = duckdb.connect()
    con.register("rows", rows)
    for least in (1, 2, 3):
        got = E.fact_masks(cands, facts, edges, policy, 5, least).where("mask > 0")
        assert_same(got, con, f"select answer, key, value, sum(1 << (pos - 1)) as mask from rows where pos <= 5 and level >= {least} group by all")


def test_no_group_per_fact(spark):
    """The masks of a fact are made in its answer's row: what is grouped is the answer, in the order of the join."""
    plan = E.fact_masks(C.cands(spark, SF), C.facts(spark, SF), C.period_edges(spark, SF), C.POLICY, 5, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [answer" in x and "value" in x.split("], [")[0] for x in plan.splitlines())


def test_tasks_grow_with_the_orders(spark, monkeypatch):
    monkeypatch.setattr(T, "TASK_ORDERS", 100)
    n = T.read(spark, SF, "orders").count()
    facts = T.object_sets(spark, SF)
    assert facts.rdd.getNumPartitions() == -(-n // 100) > 4
    assert_same(facts, duck(SF), "WITH " + C.FACTS + " SELECT * FROM facts")
    assert facts.groupBy("entity").agg(F.count("*")).rdd.getNumPartitions() == -(-n // 100)
