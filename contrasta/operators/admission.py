"""Admission of candidates to a graph of bounded size, in their order, whole neighbourhoods only.

The answer's own neighbourhood is the base. A candidate that doesn't fit is skipped and the walk goes on. What doesn't fit
once never fits later: the room shrinks by all that others add, what the candidate would add by no more than that. So
each round settles, for all answers at once, every candidate that doesn't fit now and the longest run of others that fits
together, found by the first appearance of each node; no list of nodes is ever held in one place. Nodes that only one
neighbourhood has are counted: rows are made of the others alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stash import stash, written

#: Why a candidate isn't admitted, and whether enough are.
SAME, DUPLICATE, BASE, CAP, SIZE = "SAME_AS_ANSWER", "DUPLICATE_CANDIDATE", "NOT_CONSIDERED_ANSWER_BASE_EXCEEDS_BUDGET", "NOT_CONSIDERED_CANDIDATE_CAP_REACHED", "WOULD_EXCEED_MAX_NODES"
OK, FEW = "OK", "INSUFFICIENT_CANDIDATES"


def whole_neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node): each of `nodes` (id) and its distinct neighbours in `edges` (s, o)."""
    ids = nodes.select("id").distinct()
    ends = edges.select(F.col("s").alias("id"), F.col("o").alias("node")).unionByName(edges.select(F.col("o").alias("id"), F.col("s").alias("node")))
    return ends.join(ids, "id", "left_semi").unionByName(ids.select("id", F.col("id").alias("node"))).distinct()


def admit(candidates: DataFrame, edges: DataFrame, max_nodes: int, max_candidates: int) -> DataFrame:
    """(answer, position, cand, accepted, code): the outcome for every row of `candidates` (answer, position, cand).

    The order is that of `position`, then of cand. An answer whose base alone exceeds the budget admits none. A row that repeats an
    earlier candidate or is the answer itself is refused whatever the room; once `max_candidates` are in, all later
    ones are not considered. code is null for the accepted.
    """
    if max_nodes < 1 or max_candidates < 1:
        raise ValueError("a budget is at least 1")
    place = F.row_number().over(Window.partitionBy("answer").orderBy("position", "cand"))
    rows = candidates.select("answer", "position", "cand").withColumn("place", place)
    again = F.row_number().over(Window.partitionBy("answer", "cand").orderBy("place")) > 1
    rows = rows.withColumn("code", F.when(F.col("cand") == F.col("answer"), SAME).when(again, DUPLICATE))
    ids = rows.select(F.col("answer").alias("id")).union(rows.select("cand"))
    near = stash(whole_neighbourhood(edges, ids))
    answers = rows.select("answer").distinct()
    # what a single neighbourhood holds is in no other's way, so its number is enough
    holders = near.groupBy("node").agg(F.count("*").alias("holders"), F.min("id").alias("id"))
    lone = holders.where("holders = 1").groupBy("id").agg(F.count("*").alias("own"))
    common = stash(near.join(written(holders.where("holders > 1").select("node")), "node", "left_semi").select("id", "node"))
    base = answers.join(common.select(F.col("id").alias("answer"), "node"), "answer")
    size = near.groupBy(F.col("id").alias("answer")).agg(F.count("*").alias("base"))
    rows = stash(rows.join(size, "answer").withColumn("code", F.when(F.col("code").isNotNull(), F.col("code")).when(F.col("base") > max_nodes, BASE)))
    room = rows.select("answer", (max_nodes - F.col("base")).alias("room"), F.lit(max_candidates).alias("more")).distinct().where("room >= 0")
    todo = rows.where("code is null").select("answer", "place", "cand")
    # what each candidate would bring, less what is there
    adds = stash(todo.join(common.select(F.col("id").alias("cand"), "node"), "cand").join(base, ["answer", "node"], "left_anti").select("answer", "place", "node"))
    todo = todo.join(lone.withColumnRenamed("id", "cand"), "cand", "left").select("answer", "place", F.coalesce("own", F.lit(0)).alias("own"))
    todo, settled = stash(todo.join(room, "answer")), []
    while not todo.isEmpty():
        bring = adds.groupBy("answer", "place").agg(F.count("*").alias("n"))
        now = todo.join(bring, ["answer", "place"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.col("own"))
        now = stash(now.withColumn("fits", F.col("n") <= F.col("room")))
        first = adds.join(now.where("fits").select("answer", "place"), ["answer", "place"], "left_semi").groupBy("answer", "node").agg(F.min("place").alias("place"))
        news = first.groupBy("answer", "place").agg(F.count("*").alias("new"))
        along = Window.partitionBy("answer").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        run = now.where("fits").join(news, ["answer", "place"], "left").withColumn("new", F.coalesce("new", F.lit(0)) + F.col("own"))
        run = run.select("answer", "place", "own", "room", "more", F.sum("new").over(along).alias("used"), F.count("*").over(along).alias("k"))
        run = stash(run.withColumn("accepted", (F.col("used") <= F.col("room")) & (F.col("k") <= F.col("more"))))
        taken = run.where("accepted")
        settled += [now.where("not fits").select("answer", "place", F.lit(False).alias("accepted")), taken.select("answer", "place", F.lit(True).alias("accepted"))]
        left = taken.groupBy("answer").agg(F.max("used").alias("used"), F.max("k").alias("k"))
        # where the cap is reached the rest isn't considered, and stays without an outcome here
        todo = run.where("not accepted").select("answer", "place", "own", "room", "more").join(left, "answer")
        todo = stash(todo.select("answer", "place", "own", (F.col("room") - F.col("used")).alias("room"), (F.col("more") - F.col("k")).alias("more")).where("more > 0"))
        there = adds.join(taken.select("answer", "place"), ["answer", "place"], "left_semi").select("answer", "node").distinct()
        adds = stash(adds.join(todo.select("answer", "place"), ["answer", "place"], "left_semi").join(there, ["answer", "node"], "left_anti"))
    found = settled[0] if settled else rows.select("answer", "place", F.lit(False).alias("accepted")).limit(0)
    for x in settled[1:]:
        found = found.unionByName(x)
    out = rows.join(found, ["answer", "place"], "left")
    taken_so_far = F.count_if(F.coalesce("accepted", F.lit(False))).over(Window.partitionBy("answer").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    code = F.when(F.col("code").isNotNull(), F.col("code")).when(F.coalesce("accepted", F.lit(False)), None).when(taken_so_far >= max_candidates, CAP).otherwise(SIZE)
    return out.select("answer", "position", "cand", F.coalesce("accepted", F.lit(False)).alias("accepted"), code.alias("code"))


def admitted_graphs(outcome: DataFrame, edges: DataFrame, min_candidates: int) -> DataFrame:
    """(answer, status, accepted, nodes): how many candidates and distinct nodes each answer's graph has.

    An answer whose base exceeds the budget keeps itself alone.
    """
    ids = outcome.select(F.col("answer").alias("id")).union(outcome.where("accepted").select("cand"))
    near = whole_neighbourhood(edges, ids)
    over = outcome.groupBy("answer").agg(F.bool_or(F.coalesce(F.col("code") == BASE, F.lit(False))).alias("over"), F.count_if("accepted").alias("accepted"))
    seeds = outcome.where("accepted").select("answer", F.col("cand").alias("id")).union(over.where("not over").select("answer", F.col("answer").alias("id")))
    held = seeds.join(near, "id").select("answer", "node").distinct().groupBy("answer").agg(F.count("*").alias("nodes"))
    return over.join(held, "answer", "left").select("answer", F.when(F.col("accepted") >= min_candidates, OK).otherwise(FEW).alias("status"), "accepted", F.coalesce("nodes", F.lit(1)).alias("nodes"))
