"""The selection kernel: three candidates and a least set of facts that tells the answer from each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Policies in order, with the evidence level that covers.
POLICIES = (("strict-l2", 3), ("main-l1", 2), ("diagnostic-l0", 1))


def pool(cands: DataFrame, matrix: DataFrame, most: int) -> DataFrame:
    """(answer, cand, pos, score, way): a bounded pool: the first 3/4 by rank, the rest by rescue of the best evidence.

    Rescue order: most facts at level 3, at level 2, at level 1, then rank.
    """
    head = -(-3 * most // 4)
    strength = matrix.groupBy("answer", "cand").agg(*[F.count_if(F.col("level") == k).alias(f"l{k}") for k in (3, 2, 1)])
    rows = cands.select("answer", "cand", "pos", "score").join(strength.hint("merge"), ["answer", "cand"], "left").na.fill(0, ["l3", "l2", "l1"])
    first = F.col("pos") <= head
    # both parts in one pass over the evidence
    order = Window.partitionBy("answer", first).orderBy(F.desc("l3"), F.desc("l2"), F.desc("l1"), "pos", "cand")
    rows = rows.withColumn("turn", F.row_number().over(order)).where(first | (F.col("turn") <= most - head))
    return rows.select("answer", "cand", "pos", "score", F.when(first, "RANK").otherwise("RESCUE").alias("way"))


def triples_of(cands: DataFrame) -> DataFrame:
    """(answer, i, j, k, sum_score, min_score, sum_rank): all combinations of three, by position."""
    rows = cands.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("pos", "score"))).alias("all"))
    after = lambda x: F.filter("all", lambda y: y.pos > F.col(f"{x}.pos"))
    rows = rows.select("answer", "all", F.explode("all").alias("a")).select("answer", "all", "a", F.explode(after("a")).alias("b")).select("answer", "a", "b", F.explode(after("b")).alias("c"))
    t = rows.select("answer", *[F.col(f"{x}.{f}").alias(n) for x, p in zip("abc", "ijk", strict=True) for f, n in (("pos", p), ("score", f"s{p}"))])
    return t.select("answer", "i", "j", "k", (F.col("si") + F.col("sj") + F.col("sk")).alias("sum_score"), F.least("si", "sj", "sk").alias("min_score"), (F.col("i") + F.col("j") + F.col("k")).alias("sum_rank"))


def by_position(matrix: DataFrame, least: int) -> DataFrame:
    """(answer, facts): one row per answer; array of (key, value, at), `at` having bit p if the fact reaches level `least` at position p, 0 to 62."""
    at = F.bit_or(F.expr(f"case when level < {least} then 0L when pos between 0 and 62 then shiftleft(1L, pos) else raise_error('positions go from 0 to 62') end"))
    per = matrix.groupBy("answer", "key", "value").agg(at.alias("at")).where("at > 0")
    return per.groupBy("answer").agg(F.collect_list(F.struct("key", "value", "at")).alias("facts"))


def masks(combos: DataFrame, matrix: DataFrame, least: int) -> DataFrame:
    """(answer, i, j, k, key, value, mask): which of the three candidates each fact covers, as bits; facts that cover any."""
    rows = combos.select("answer", "i", "j", "k").join(by_position(matrix, least).hint("merge"), "answer")
    rows = rows.select("answer", "i", "j", "k", F.explode("facts").alias("f"))
    bit = lambda c, b: F.when(F.getbit(F.col("f.at"), F.col(c)) == 1, b).otherwise(0)
    rows = rows.select("answer", "i", "j", "k", "f.key", "f.value", (bit("i", 1) + bit("j", 2) + bit("k", 4)).alias("mask"))
    return rows.where("mask > 0")


def cover_size(masks: DataFrame) -> DataFrame:
    """(answer, i, j, k, signature, size): the masks that occur, and how few of them cover all three (4: they don't).

    For three candidates the least cover has a closed form over the set of masks that occur.
    """
    sig = masks.groupBy("answer", "i", "j", "k").agg(F.bit_or(F.expr("shiftleft(1, mask)")).alias("signature"))
    return sig.withColumn("size", size_of(F.col("signature")))


def size_of(signature: Column) -> Column:
    """How few of the masks whose bits `signature` has cover all three candidates; 4: they don't."""
    has = lambda *m: signature.bitwiseAND(F.lit(sum(1 << x for x in m))) == sum(1 << x for x in m)
    pair = has(1, 6) | has(2, 5) | has(4, 3) | has(3, 5) | has(3, 6) | has(5, 6)
    return F.when(has(7), 1).when(pair, 2).when(has(1, 2, 4), 3).otherwise(4)


def combinations(places: Column) -> Column:
    """All (i, j, k, sum_score, min_score, sum_rank) of an array of (pos, score) that is sorted by pos."""
    after = lambda x: F.filter(places, lambda y: y.pos > x.pos)
    one = lambda a, b, c: F.struct(a.pos.alias("i"), b.pos.alias("j"), c.pos.alias("k"), F.round(a.score + b.score + c.score, 9).alias("sum_score"), F.round(F.least(a.score, b.score, c.score), 9).alias("min_score"), (a.pos + b.pos + c.pos).alias("sum_rank"))
    return F.flatten(F.transform(places, lambda a: F.flatten(F.transform(after(a), lambda b: F.transform(after(b), lambda c: one(a, b, c))))))


def mask_of(at: Column, combo: Column) -> Column:
    """Which of a combination's three candidates have their bit in `at`."""
    bit = lambda c, b: F.getbit(at, combo[c]).cast("int") * b
    return bit("i", 1) + bit("j", 2) + bit("k", 4)


def size_at(ats: Column, combo: Column) -> Column:
    """size_of() of a combination from an array of facts' bits by position, without a row per fact."""
    return F.aggregate(ats, F.lit(0), lambda s, at: s.bitwiseOR(F.call_function("shiftleft", F.lit(1), mask_of(at, combo))), size_of)


def count_minimum(masks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(answer, i, j, k, size, n): how many least covers there are, from the populations of the masks."""
    key = ["answer", "i", "j", "k"]
    count = masks.groupBy(*key).pivot("mask", [1, 2, 3, 4, 5, 6, 7]).count().na.fill(0)
    n = {m: F.col(str(m)) for m in range(1, 8)}
    one, three = n[7], n[1] * n[2] * n[4]
    two = n[1] * n[6] + n[2] * n[5] + n[4] * n[3] + n[3] * n[5] + n[3] * n[6] + n[5] * n[6]
    return sizes.where("size <= 3").join(count, key).select(*key, "size", F.when(F.col("size") == 1, one).when(F.col("size") == 2, two).otherwise(three).alias("n"))


def local_anonymity(chosen: DataFrame, matrix: DataFrame) -> DataFrame:
    """(answer, group_size, ratio, identifies): candidates that no chosen fact tells from the answer, and the answer itself.

    chosen: answer, key, value.
    """
    seen = matrix.join(chosen, ["answer", "key", "value"]).groupBy("answer", "cand").agg(F.max("level").alias("best"))
    return seen.groupBy("answer").agg((1 + F.count_if(F.col("best") == 0)).alias("group_size"), F.count("*").alias("n")).select("answer", "group_size", (F.col("group_size") / (F.col("n") + 1)).alias("ratio"), (F.col("group_size") == 1).alias("identifies"))
