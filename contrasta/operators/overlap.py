"""The overlap baseline: candidates ranked by the facts that they share with an answer, exactly or nearly, and a diverse choice of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stash import stash, written
from .role_similarity import assignment

#: Weights of exact and near overlap, the least similarity of near values, the weight of relevance, the largest redundancy, the longest list.
EXACT, NEAR, THETA = 1.0, 0.5, 0.60
RELEVANCE, REDUNDANT, LONGEST = 0.75, 0.90, 300


def spelling(x: Column, y: Column) -> Column:
    """1 less the share of letters that differ: a similarity of names that needs no model."""
    return 1 - F.levenshtein(x, y) / F.greatest(F.char_length(x), F.char_length(y), F.lit(1))


def value_sets(facts: DataFrame) -> DataFrame:
    """(entity, n, sets): the number of facts, and by key the sorted values."""
    per = facts.groupBy("entity", "key").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("value")).alias("values"))
    return per.groupBy("entity").agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "values"))))).alias("sets"))


def id_sets(facts: DataFrame) -> DataFrame:
    """(entity, n, ids): the number of facts, and a number of each distinct one. Where these are few, they are looked up where the facts lie."""
    known = written(facts.select("key", "value").where("key is not null and value is not null").distinct().select("key", "value", F.monotonically_increasing_id().alias("id")))
    return facts.join(known, ["key", "value"], "left").groupBy("entity").agg(F.count("*").alias("n"), F.collect_list("id").alias("ids"))


def beside(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """pairs with each one's own and their `name` of sets (null without facts): a pair is one row, only the candidate's moves to the answer."""
    their = sets.select(F.col("entity").alias("cand"), F.col("n").alias("cand_n"), F.col(name).alias("theirs"))
    mine = sets.select(F.col("entity").alias("answer"), F.col("n").alias("answer_n"), F.col(name).alias("own"))
    return pairs.join(their.hint("merge"), "cand", "left").join(mine.hint("merge"), "answer", "left").na.fill(0, ["answer_n", "cand_n"])


def matched(sizes: Column, w: Column) -> Column:
    """The sum of assignment() over matrices that lie one after another in w; sizes: their n and m in turn. Equal ones are solved once a task."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        @lru_cache(100_000)
        def solve(n: int, m: int, cells: bytes) -> float:
            return assignment(np.frombuffer(cells).tolist(), n, m)

        @lru_cache(10_000)
        def total(sizes: bytes, w: bytes) -> float:
            at, out = 0, 0.0
            for n, m in np.frombuffer(sizes, "int32").reshape(-1, 2).tolist():
                out, at = out + solve(n, m, w[at : at + 8 * n * m]), at + 8 * n * m
            return out

        for sizes, w in parts:
            yield pd.Series([total(np.asarray(a, "int32").tobytes(), np.asarray(b, "float64").tobytes()) for a, b in zip(sizes, w, strict=True)], dtype="float64")

    return run(sizes, w)


def matrices(own: Column, theirs: Column, similarity: Callable[[Column, Column], Column], theta: float) -> Column:
    """Array of (n, m, w) by key: similarities of at least theta, else 0, of the values that only one of the two has; w row by row, with a value above 0."""
    per = F.transform(F.map_keys(own), lambda k: F.struct(F.array_except(own[k], theirs[k]).alias("xs"), F.array_except(theirs[k], own[k]).alias("ys")))
    per = F.filter(per, lambda x: (F.size(x.xs) > 0) & (F.size(x.ys) > 0))
    near = lambda x, ys: F.transform(F.transform(ys, lambda y: similarity(x, y).cast("double")), lambda s: F.when(s >= theta, s).otherwise(F.lit(0.0)))
    cells = F.transform(per, lambda p: F.struct(F.size(p.xs).alias("n"), F.size(p.ys).alias("m"), F.flatten(F.transform(p.xs, lambda x: near(x, p.ys))).alias("w")))
    return F.filter(cells, lambda x: F.array_max(x.w) > 0)


def ranking(cands: DataFrame, facts: DataFrame, exact: float = EXACT, near: float = NEAR, similarity: Callable[[Column, Column], Column] = spelling, theta: float = THETA) -> DataFrame:
    """(answer, cand, strict, loose, score, normalised, distinguishing, rejected, rank): candidates by score and then name, those without facts last.

    strict: shared facts; normalised: the score over the larger number of facts; distinguishing: the answer's facts that the candidate lacks.
    """
    pairs = cands.select("answer", "cand").where("answer <> cand").distinct()
    if near:
        rows = beside(pairs, value_sets(facts), "sets")
        own, theirs = F.col("own"), F.col("theirs")
        strict = F.aggregate(F.map_keys(own), F.lit(0), lambda n, k: n + F.coalesce(F.size(F.array_intersect(own[k], theirs[k])), F.lit(0)))
        found = F.when(own.isNotNull() & theirs.isNotNull(), matrices(own, theirs, similarity, theta))
        rows = rows.select("answer", "cand", "answer_n", "cand_n", F.coalesce(strict, F.lit(0)).cast("long").alias("strict"), found.alias("found"))
        single = lambda x: (x.n == 1) | (x.m == 1)
        won = F.aggregate(F.filter("found", single), F.lit(0.0), lambda t, x: t + F.array_max(x.w))
        base = ["answer", "cand", "answer_n", "cand_n", "strict"]
        rows = rows.select(*base, F.coalesce(won, F.lit(0.0)).alias("won"), F.filter("found", lambda x: ~single(x)).alias("many"))
        # written first: it's read twice, and a function of Python can't take an expression with lambdas
        flat = lambda f: F.coalesce(F.flatten(F.transform("many", f)), F.array())
        rows = stash(rows.select(*base, "won", flat(lambda x: F.array(x.n, x.m)).cast("array<int>").alias("sizes"), flat(lambda x: x.w).cast("array<double>").alias("w")))
        few = rows.where("size(sizes) = 0").select(*base, F.col("won").alias("loose"))
        rows = few.unionByName(rows.where("size(sizes) > 0").select(*base, (F.col("won") + matched(F.col("sizes"), F.col("w"))).alias("loose")))
    else:
        rows = beside(pairs, id_sets(facts), "ids")
        strict = F.when(F.col("own").isNotNull() & F.col("theirs").isNotNull(), F.size(F.array_intersect("own", "theirs"))).otherwise(0)
        rows = rows.select("answer", "cand", "answer_n", "cand_n", strict.cast("long").alias("strict"), F.lit(0.0).alias("loose"))
    score = F.lit(exact) * F.col("strict") + F.lit(near) * F.col("loose")
    rows = rows.select("answer", "cand", "strict", "loose", score.alias("score"), (score / F.greatest("answer_n", "cand_n", F.lit(1))).alias("normalised"), (F.col("answer_n") - F.col("strict")).alias("distinguishing"), (F.col("cand_n") == 0).alias("rejected"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("answer").orderBy("rejected", F.desc("score"), "cand")))


def diverse(ranked: DataFrame, facts: DataFrame, k: int = 3, weight: float = RELEVANCE, limit: float = REDUNDANT, longest: int = LONGEST) -> DataFrame:
    """(answer, cand, turn): greedily the best by weight * relevance - (1 - weight) * redundancy, ties by name.

    relevance: the score over the list's best; redundancy: facts shared with a chosen candidate over the larger number of facts,
    the largest over those chosen, which has to be under `limit`. Candidates without facts, or that lack none of the
    answer's, are out. Answers of which no single fact tells all chosen apart have no result. A turn is a
    window over the answer's list, whose rows hold the numbers of their facts and stay in place.
    """
    pool = ranked.where("not rejected and distinguishing > 0")
    pool = pool.withColumn("turn", F.row_number().over(Window.partitionBy("answer").orderBy("rank"))).where(F.col("turn") <= longest)
    best = F.max("score").over(Window.partitionBy("answer"))
    sets = id_sets(facts)
    sizes = sets.select(F.col("entity").alias("cand"), "n", "ids")
    pool = pool.select("answer", "cand", (F.col("score") / F.when(best == 0, 1.0).otherwise(best)).alias("relevance")).join(sizes.hint("merge"), "cand")
    here = Window.partitionBy("answer")
    pool = pool.select("answer", "cand", "relevance", "n", "ids", F.lit(0.0).alias("red"), F.lit(None).cast("int").alias("turn"))
    for turn in range(1, k + 1):
        value = F.lit(weight) * F.col("relevance") - F.lit(1 - weight) * F.col("red")
        one = F.when(F.col("turn").isNull() & (F.col("red") < limit), F.struct((-value).alias("v"), "cand", "n", "ids"))
        pool = pool.withColumn("b", F.min(one).over(here))
        shared = F.when(F.col("b").isNotNull(), F.size(F.array_intersect("ids", "b.ids")) / F.greatest("n", "b.n"))
        pool = pool.select("answer", "cand", "relevance", "n", "ids", F.greatest("red", shared).alias("red"), F.when(F.col("cand") == F.col("b.cand"), turn).otherwise(F.col("turn")).alias("turn"))
    chosen = pool.where("turn is not null").groupBy("answer").agg(F.collect_list(F.struct("cand", "turn")).alias("chosen"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("covered"))
    # facts without a value are in no other's
    mine = sets.select(F.col("entity").alias("answer"), F.col("n").alias("own_n"), F.col("ids").alias("own"))
    told = chosen.join(mine.hint("merge"), "answer").where("own_n > size(own) or size(array_except(own, covered)) > 0")
    return told.select("answer", F.explode("chosen").alias("x")).select("answer", "x.cand", "x.turn")
