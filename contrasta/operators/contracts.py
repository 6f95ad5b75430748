"""Invariants of rosters, rankings and policies, as rows that say what is broken, and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stash import stash


def roster(rows: DataFrame) -> DataFrame:
    """(answer, ranks, repeats, own, scores): whether the ranks of an answer's candidates aren't 1..n, one repeats, one is the answer, a score isn't finite. A short roster is no fault."""
    n = F.count("*")
    finite = ~(F.isnan("score") | F.abs("score").eqNullSafe(F.lit(float("inf"))) | F.col("score").isNull())
    return rows.groupBy("answer").agg(
        ((F.min("rank") != 1) | (F.max("rank") != n) | (F.countDistinct("rank") != n)).alias("ranks"), (F.countDistinct("cand") != n).alias("repeats"),
        F.bool_or(F.col("cand") == F.col("answer")).alias("own"), F.bool_or(~finite).alias("scores"))


def ranking_order(rows: DataFrame) -> DataFrame:
    """(answer, gaps, rises, ties): whether ranks skip a place, a later score is higher, equal scores don't ascend by name."""
    w = Window.partitionBy("answer").orderBy("rank")
    rows = rows.select("answer", "rank", "cand", "score", F.lag("score").over(w).alias("s"), F.lag("cand").over(w).alias("c"), F.row_number().over(w).alias("place"))
    no = F.lit(False)
    return rows.groupBy("answer").agg(F.bool_or(F.col("rank") != F.col("place")).alias("gaps"), F.coalesce(F.bool_or(F.col("score") > F.col("s")), no).alias("rises"), F.coalesce(F.bool_or((F.col("score") == F.col("s")) & (F.col("cand") < F.col("c"))), no).alias("ties"))


def repeated(rows: DataFrame, slot: str, answer: str) -> DataFrame:
    """(slot, n, answers): slots that several rows have."""
    return rows.groupBy(slot).agg(F.count("*").alias("n"), F.countDistinct(answer).alias("answers")).where("n > 1")


def missing(fields: list[str]) -> Column:
    """The names of the fields that a row lacks."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in fields]))


def type_map(rows: DataFrame) -> DataFrame:
    """(entries, kinds, nonzero, usable): a map of types is usable if any value isn't zero."""
    nonzero = F.count_if(F.col("value") != 0)
    return rows.agg(F.count("*").alias("entries"), F.countDistinct("kind").alias("kinds"), nonzero.alias("nonzero"), (nonzero > 0).alias("usable"))


def rejections(rows: DataFrame) -> DataFrame:
    """(reason, primary_n, any_n): how often a reason came first, and how often it held at all."""
    each = rows.select(F.posexplode("reasons").alias("at", "reason"))
    return each.groupBy("reason").agg(F.count_if(F.col("at") == 0).alias("primary_n"), F.count("*").alias("any_n"))


def retention(chosen: DataFrame, hidden: tuple[str, ...] = ("diagnostic-l0",)) -> DataFrame:
    """(block, answers, first_three, first_three_pct, mean_first, mean_second, mean_third, mean_rank, median_rank, least_rank, most_rank): how many answers keep the ranker's first three.

    chosen: (answer, policy, i, j, k), the combination of each answer. Two blocks: `any` selection, and those `shown`, whose
    policy isn't one of `hidden`; a block without answers has no row.
    """
    # combinations of ranks are few: they are counted in one pass over the answers, and all else is taken from the counts
    shown = F.count_if(~F.col("policy").isin(*hidden)).alias("shown")
    counts = stash(chosen.groupBy("i", "j", "k").agg(F.count("*").alias("any"), shown))
    blocks = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).alias("n")) for b in ("any", "shown")])).alias("b")
    rows = counts.select("i", "j", "k", blocks).select("i", "j", "k", "b.*").where("n > 0")
    n = F.sum("n")
    first = F.sum(F.when((F.col("i") == 1) & (F.col("j") == 2) & (F.col("k") == 3), F.col("n")).otherwise(0))
    mean = lambda c, name: F.round(F.sum(F.col(c) * F.col("n")) / n, 4).alias(name)
    slots = rows.groupBy("block").agg(n.alias("answers"), first.alias("first_three"), F.round(100 * first / n, 2).alias("first_three_pct"), mean("i", "mean_first"), mean("j", "mean_second"), mean("k", "mean_third"))
    # ranks are few and small, so the middle is found among their counts
    ranks = rows.select("block", "n", F.explode(F.array("i", "j", "k")).alias("rank")).groupBy("block", "rank").agg(F.sum("n").alias("n"))
    whole = ranks.groupBy("block").agg(F.round(F.sum(F.col("rank") * F.col("n")) / F.sum("n"), 4).alias("mean_rank"), F.expr("percentile(rank, 0.5, n)").alias("median_rank"), F.min("rank").alias("least_rank"), F.max("rank").alias("most_rank"))
    return slots.join(whole, "block")
