"""Least rationales of a combination of candidates, their ranking keys, and selection by the whole objective.

A rationale is a set of facts that tells the answer from all three candidates. An answer is one row: its candidates, and its facts with a
bit per position for each thing that is known of them there, so that combinations, covers and keys need no row per cell and no
joins. Only the combinations that tie on the cheap fields of the objective are given rationales.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import POLICIES, combinations, mask_of, size_at

TRIPLE = ("answer", "i", "j", "k")


def by_answer(cands: DataFrame, matrix: DataFrame) -> DataFrame:
    """(answer, places, every, facts): one row per answer with facts.

    places: array of (pos, score), in order; every: the bits of the positions. facts: array of (fact, key, value, at1, at2, at3,
    scoped, risk, same), in the order of their names: the positions at which a fact reaches level 1, 2, 3, has a scoped
    basis, a risk, or is the candidate's own name.
    """
    bits = lambda c, name: F.bit_or(F.when(~c, F.lit(0).cast("long")).otherwise(F.expr("case when pos between 0 and 62 then shiftleft(1L, pos) else raise_error('positions go from 0 to 62') end"))).alias(name)
    level = F.col("level")
    known = [bits(level >= n, f"at{n}") for n in (1, 2, 3)]
    known += [bits(F.col("basis") == "SCOPED_EMPIRICAL", "scoped"), bits(F.col("risk") != "NONE", "risk")] if "basis" in matrix.columns else []
    per = matrix.groupBy("answer", "key", "value").agg(*known, bits(F.coalesce(F.col("value") == F.col("cand").cast("string"), F.lit(False)), "same"))
    names = [c for c in per.columns if c != "answer"]
    facts = per.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct(F.concat_ws("|", "key", "value").alias("fact"), *names))).alias("facts"))
    places = cands.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("pos", "score"))).alias("places"), bits(F.lit(True), "every"))
    return places.join(facts.hint("merge"), "answer")


def _ats(least: int) -> Column:
    """The distinct position bits of an answer's facts at a level: all that sizes of covers depend on."""
    return F.array_distinct(F.transform("facts", lambda f: f[f"at{least}"]))


def strongest_level(cands: DataFrame, matrix: DataFrame, least: int = 1) -> DataFrame:
    """(answer, i, j, k, size, level): the strongest level from `least` on whose least cover is no larger than that of `least`."""
    rows = by_answer(cands, matrix).select("answer", "places", *[_ats(n).alias(f"ats{n}") for n in range(least, 4)])
    sized = F.transform(combinations(F.col("places")), lambda c: F.struct(c.i.alias("i"), c.j.alias("j"), c.k.alias("k"), *[size_at(F.col(f"ats{n}"), c).alias(f"s{n}") for n in range(least, 4)]))
    rows = rows.select("answer", F.explode(sized).alias("c")).select("answer", "c.*").where(f"s{least} <= 3")
    level = F.lit(least)
    for n in range(least + 1, 4):
        level = F.when(F.col(f"s{n}") == F.col(f"s{least}"), n).otherwise(level)
    return rows.select(*TRIPLE, F.col(f"s{least}").alias("size"), level.alias("level"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once and not for each element of the arrays that `then` goes through."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def prefix_best(rows: DataFrame) -> DataFrame:
    """(.., policy, least, i, j, k, size, sum_score, sum_rank): by_answer() with, under an answer's first feasible policy, all combinations that are best by score sum, least score and cover size."""
    # three facts at most cover a triple if and only if each position has a fact: policies and what is feasible need no sizes
    unions = {f"u{n}": F.aggregate("facts", F.lit(0).cast("long"), lambda s, f: s.bitwiseOR(f[f"at{n}"])).bitwiseAND(F.col("every")) for _, n in POLICIES}  # noqa: B023  called at once
    rows = rows.withColumns(unions)
    case = lambda of: F.coalesce(*[F.when(F.bit_count(f"u{n}") >= 3, of(name, n)) for name, n in POLICIES])
    rows = rows.select("answer", "every", "facts", "places", case(lambda name, n: F.lit(name)).alias("policy"), case(lambda name, n: F.lit(n)).alias("least"), case(lambda name, n: F.col(f"u{n}")).alias("union")).where("policy is not null")
    # sizes are found for those alone that tie on both scores
    ats = F.array_distinct(F.transform("facts", lambda f: F.when(F.col("least") == 3, f.at3).when(F.col("least") == 2, f.at2).otherwise(f.at1)))
    scores = lambda c: F.struct((-c.sum_score).alias("a"), (-c.min_score).alias("b"))
    least_of = lambda xs, of: _let(xs, lambda all_: _let(F.array_min(F.transform(all_, of)), lambda low: F.filter(all_, lambda x: of(x) == low)))
    told = _let(F.col("union"), lambda u: F.filter("places", lambda x: F.getbit(u, x.pos) == 1))
    tied = least_of(_let(told, combinations), scores)
    sized = _let(ats, lambda a: F.transform(tied, lambda c: F.struct(size_at(a, c).alias("size"), c.alias("c"))))
    rows = rows.select("answer", "every", "facts", "policy", "least", F.explode(least_of(sized, lambda x: x["size"])).alias("x"))
    return rows.select("answer", "every", "facts", "policy", "least", "x.c.i", "x.c.j", "x.c.k", "x.size", "x.c.sum_score", "x.c.sum_rank")


def minimum_rationales(rows: DataFrame) -> DataFrame:
    """prefix_best() with `some`, a row for every set of facts of least size whose masks cover the triple."""
    at = lambda f: F.when(F.col("least") == 3, f.at3).when(F.col("least") == 2, f.at2).otherwise(f.at1)
    combo = F.struct("i", "j", "k")
    rows = rows.withColumn("facts", F.transform("facts", lambda f: f.withField("at", at(f)).withField("mask", mask_of(at(f), combo))))
    rows = rows.withColumn("facts", F.filter("facts", lambda f: f["mask"] > 0))
    more = lambda then, f, g: (g.fact > f.fact) & (~then | (f["mask"].bitwiseOR(g["mask"]) == 7))
    one = F.transform(F.filter("facts", lambda f: f["mask"] == 7), lambda f: F.array(f))
    two = F.flatten(F.transform("facts", lambda f: F.transform(F.filter("facts", lambda g: more(F.lit(True), f, g)), lambda g: F.array(f, g))))
    third = lambda f, g: F.filter("facts", lambda h: (h.fact > g.fact) & (f["mask"].bitwiseOR(g["mask"]).bitwiseOR(h["mask"]) == 7))
    three = F.flatten(F.transform("facts", lambda f: F.flatten(F.transform(F.filter("facts", lambda g: more(F.lit(False), f, g)), lambda g: F.transform(third(f, g), lambda h: F.array(f, g, h))))))
    return rows.withColumn("some", F.explode(F.when(F.col("size") == 1, one).when(F.col("size") == 2, two).otherwise(three))).drop("facts")


def build(rows: DataFrame, tiers: dict[str, int], unspoken: tuple[str, ...] = (), soft: Callable[[Column], Column] | None = None) -> DataFrame:
    """minimum_rationales() with the names of the facts and every component of their ranking keys; incidences count from the answer's level `least` on."""
    chosen = F.expr("shiftleft(1L, i) | shiftleft(1L, j) | shiftleft(1L, k)")
    rows = rows.withColumn("chosen", chosen)
    zero, least = F.lit(0).cast("long"), F.col("least")
    total = lambda of: F.aggregate("some", zero, lambda s, f: s + of(f).cast("long"))
    count = lambda of: total(lambda f: F.bit_count(of(f).bitwiseAND(F.col("chosen"))))
    union = lambda c: F.aggregate("some", zero, lambda s, f: s.bitwiseOR(f[c]))
    without = lambda x, y: x.bitwiseAND(F.bitwise_not(y))
    rows = rows.withColumns({f"u{n}": union(f"at{n}") for n in (1, 2, 3)})
    told = lambda n: F.col(f"u{n}").bitwiseAND(F.col("chosen")) == F.col("chosen")
    known = F.create_map(*[F.lit(x) for p in sorted(tiers.items()) for x in p])
    tier = lambda f: F.coalesce(known[f.key], F.lit(3))
    words = lambda f: F.size(F.regexp_extract_all(F.lower(f.value), F.lit("([a-z0-9]+)"), F.lit(1)))
    keys = F.transform("some", lambda f: f.key)
    fields = {
        "min_level": F.when(told(3), 3).when(told(2), 2).when(told(1), 1).otherwise(0),
        "l2": count(lambda f: f.at3),
        "l1": F.when(least <= 2, count(lambda f: without(f.at2, f.at3))).otherwise(zero),
        "l0": F.when(least <= 1, count(lambda f: without(f.at1, f.at2))).otherwise(zero),
        "scoped": count(lambda f: f["at"].bitwiseAND(f.scoped)),
        "risk": count(lambda f: f["at"].bitwiseAND(f.risk)),
        "conflicts": F.size(F.filter("some", lambda f: f.same.bitwiseAND(F.col("chosen")) != 0)).cast("long"),
        "soft": total(soft) if soft else zero,
        "tier": total(tier),
        "unverbal": total(lambda f: f.key.isin(*unspoken)) if unspoken else zero,
        "label_length": total(lambda f: F.char_length(f.value)),
        "tokens": total(words),
        "repeats": F.when(F.size(keys) == 1, 0).when(F.size(keys) == 2, F.when(keys[0] == keys[1], 1).otherwise(0)).otherwise(F.element_at(F.array(F.lit(3), F.lit(1), F.lit(0)), F.size(F.array_distinct(keys)))),
        "anonymity": 1 + F.bit_count(without(F.col("every"), F.col("u1"))).cast("long"),
    }
    own = ["policy", "size", "sum_score", "sum_rank"]
    out = rows.select(*TRIPLE, *own, F.transform("some", lambda f: f.fact).alias("facts"), *[c.alias(n) for n, c in fields.items()])
    return out.withColumn("direct", (F.col("anonymity") == 1).cast("int"))


def ranking_key(version: int = 1) -> Column:
    """Objective key 4 as a struct; the smallest wins. Version 2 puts option conflicts at place 7, version 3 puts risk and conflicts before the annotation."""
    down = lambda c: (-F.col(c)).alias(f"down_{c}")
    head = [down("min_level"), down("l2"), down("l1"), F.col("l0")]
    middle = {1: [down("scoped"), F.col("risk")], 2: [down("scoped"), F.col("risk"), F.col("conflicts")], 3: [F.col("risk"), F.col("conflicts"), down("scoped")]}[version]
    return F.struct(*head, *middle, *[F.col(c) for c in ("soft", "tier", "unverbal", "label_length", "tokens", "repeats", "direct", "facts")])


def rationales(cands: DataFrame, matrix: DataFrame, tiers: dict[str, int], unspoken: tuple[str, ...] = ()) -> DataFrame:
    """(answer, i, j, k, policy, size, sum_score, sum_rank, facts, fields of ranking_key()..): all least rationales of the combinations that tie on the cheap fields."""
    return build(minimum_rationales(prefix_best(by_answer(cands, matrix))), tiers, unspoken)


def of_chosen(rationales: DataFrame, version: int = 1) -> DataFrame:
    """`rationales` of each answer's chosen combination alone: by rationale key, smallest rank sum, positions."""
    best = F.min(F.struct(ranking_key(version).alias("key4"), "sum_rank", "i", "j", "k")).over(Window.partitionBy("answer"))
    return rationales.withColumn("best", best).where("i = best.i and j = best.j and k = best.k").drop("best")


def select(rationales: DataFrame, version: int = 1) -> DataFrame:
    """(answer, policy, i, j, k, size, sum_score, facts, ties): per answer the best combination under the first policy that has one.

    Order: largest score sum, largest least score, smallest cover, rationale key, smallest rank sum, positions. ties: how many
    combinations tie up to the rationale key.
    """
    per = rationales.groupBy(*TRIPLE).agg(F.min_by(F.struct("size", "sum_score", "sum_rank", "policy", "facts"), ranking_key(version)).alias("x"), F.min(ranking_key(version)).alias("key4"))
    one = per.groupBy("answer").agg(F.min_by(F.struct("i", "j", "k", "x"), F.struct("key4", "x.sum_rank", "i", "j", "k")).alias("w"), F.min("key4").alias("least_key"), F.collect_list("key4").alias("all_keys"))
    return one.select("answer", "w.x.policy", "w.i", "w.j", "w.k", "w.x.size", "w.x.sum_score", "w.x.facts", F.size(F.filter("all_keys", lambda x: x == F.col("least_key"))).alias("ties"))
