"""Least covers for any number of candidates: which fewest facts tell an answer from all of them.

A fact covers a set of candidates, its mask. A least cover has no two facts of one mask, so only the classes of equal masks
matter, at most 2^k - 1 for k candidates: they are counted before anything moves. Covers then grow by one class a round, in
the order of the masks, so that every set of classes is met once; a case leaves the rounds once it is covered, which is told
where its rows lie: only classes of cases that are left move in a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stash import stash

#: Candidates of one case at most: 2^k states a case are held in rows.
MOST = 8


def mask_classes(facts: DataFrame, case: list[str], fact: list[str], weight: str = "weight", mask: str = "mask") -> DataFrame:
    """(case.., mask, n, weight, fact): per case and mask how many facts have it, and the one of least weight, then least `fact`.

    Facts that cover nothing, or have no mask, are in no class.
    """
    best = F.min(F.struct(F.col(weight).alias("weight"), F.struct(*fact).alias("fact")))
    return facts.where(F.col(mask) > 0).groupBy(*case, F.col(mask).cast("long").alias("mask")).agg(F.count("*").alias("n"), best.alias("best")).select(*case, "mask", "n", "best.weight", "best.fact")


def least_covers(facts: DataFrame, case: list[str], fact: list[str], k: int, rho: int, weight: str = "weight", mask: str = "mask") -> DataFrame:
    """(case.., covered, coverage, full, size, n, weight, chosen, feasible): the least set of facts that covers all that facts can cover.

    covered: union of all masks; coverage: how many of the k candidates that is; size: fewest facts with that union;
    n: how many sets of that size have it; chosen: of those the one of least weight and then of least sorted facts.
    feasible: full coverage by at most rho facts; rho doesn't change what is found. Cases all of whose facts cover
    nothing are not in the result.
    """
    if not 1 <= k <= MOST:
        raise ValueError(f"k = {k}: 1 to {MOST} candidates")
    if rho < 1:
        raise ValueError(f"rho = {rho}: at least 1")
    own = Window.partitionBy(*case)
    covered = F.max(F.col("covered") == F.col("goal")).over(own)
    classes = mask_classes(facts, case, fact, weight, mask).dropna(subset=case).withColumns({"goal": F.bit_or("mask").over(own), "covered": F.col("mask")})
    classes = stash(classes.withColumn("left", ~covered))
    state = classes.select(*case, "goal", "covered", F.col("mask").alias("last"), "n", "weight", F.array("fact").alias("chosen"), "left")
    step = classes.where("left").select(*case, F.col("mask").alias("next"), F.col("n").alias("more"), F.col("weight").alias("w"), F.col("fact").alias("f"))
    done = []
    for size in range(1, k + 1):
        if size > 1:
            state = stash(state)
        # of a case that is covered, one row
        done.append(state.where("covered = goal").select(*case, "covered", F.lit(size).alias("size"), "n", "weight", "chosen"))
        open_ = state.where("left")
        if size == k or open_.isEmpty():
            break
        grown = open_.join(step, case).where("next > last and (covered | next) <> covered")
        grown = grown.select(*case, "goal", F.expr("covered | next").alias("covered"), F.expr("if((covered | next) = goal, 0, next)").alias("last"), (F.col("n") * F.col("more")).alias("n"), (F.col("weight") + F.col("w")).alias("weight"), F.array_sort(F.concat("chosen", F.array("f"))).alias("chosen"))
        state = grown.groupBy(*case, "goal", "covered", "last").agg(F.sum("n").alias("n"), F.min(F.struct("weight", "chosen")).alias("best"))
        state = state.select(*case, "goal", "covered", "last", "n", "best.weight", "best.chosen", (~covered).alias("left"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    coverage = F.bit_count("covered")
    full = F.col("covered") == (1 << k) - 1
    return out.select(*case, "covered", coverage.alias("coverage"), full.alias("full"), "size", "n", "weight", "chosen", (full & (F.col("size") <= rho)).alias("feasible"))


def minimum_covers(facts: DataFrame, covers: DataFrame, case: list[str], fact: list[str], weight: str = "weight", mask: str = "mask") -> DataFrame:
    """(case.., chosen, weight): every set of facts of the least size, one row each, in no order.

    Only facts of masks that can be in a least cover are joined. The number of rows is the sum of `n` in least_covers().
    """
    rows = facts.where(F.col(mask) > 0).select(*case, F.col(mask).cast("long").alias("mask"), F.col(weight).alias("w"), F.struct(*fact).alias("f"))
    goal = covers.select(*case, F.col("covered").alias("goal"), "size")
    sets = rows.join(goal, case).select(*case, "goal", "size", F.col("mask").alias("covered"), F.col("mask").alias("last"), F.lit(1).alias("k"), F.array("f").alias("chosen"), F.col("w").alias("weight"))
    done = []
    for _ in range(MOST):
        sets = stash(sets)
        done.append(sets.where("k = size and covered = goal").select(*case, F.array_sort("chosen").alias("chosen"), "weight"))
        going = sets.where("k < size")
        if going.isEmpty():
            break
        grown = going.join(rows, case).where("mask > last and (covered | mask) <> covered")
        sets = grown.select(*case, "goal", "size", F.expr("covered | mask").alias("covered"), F.col("mask").alias("last"), (F.col("k") + 1).alias("k"), F.concat("chosen", F.array("f")).alias("chosen"), (F.col("weight") + F.col("w")).alias("weight"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out
