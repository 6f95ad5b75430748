"""Set relations between an answer's facts and its candidates', evidence levels and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap(cands: DataFrame, facts: DataFrame) -> DataFrame:
    """(answer, cand, n): shared (key, value) facts; 0 where nothing is shared."""
    a = facts.select(F.col("entity").alias("answer"), "key", "value")
    b = facts.select(F.col("entity").alias("cand"), "key", "value")
    n = cands.select("answer", "cand").join(a, "answer").join(b, ["cand", "key", "value"]).groupBy("answer", "cand").agg(F.count("*").alias("n"))
    return cands.select("answer", "cand").join(n, ["answer", "cand"], "left").select("answer", "cand", F.coalesce("n", F.lit(0)).alias("n"))


def distinguishing(cands: DataFrame, facts: DataFrame) -> DataFrame:
    """(answer, cand, key, value): the answer's facts that the candidate doesn't have."""
    a = cands.select("answer", "cand").join(facts.withColumnRenamed("entity", "answer"), "answer")
    return a.join(facts.withColumnRenamed("entity", "cand"), ["cand", "key", "value"], "left_anti").select("answer", "cand", "key", "value")


def common_to_none(cands: DataFrame, facts: DataFrame) -> DataFrame:
    """(answer, key, value): the answer's facts that no candidate has."""
    own = facts.groupBy("entity").agg(F.collect_set(F.struct("key", "value")).alias("own"))
    held = cands.select("answer", "cand").join(own.select(F.col("entity").alias("cand"), F.col("own").alias("theirs")).hint("merge"), "cand", "left")
    held = held.groupBy("answer").agg(F.array_distinct(F.flatten(F.collect_list("theirs"))).alias("held"))
    rows = held.join(own.withColumnRenamed("entity", "answer").hint("merge"), "answer")
    # a value that isn't known is held by none
    left = F.array_except("own", F.filter("held", lambda x: x.value.isNotNull()))
    return rows.select("answer", F.explode(left).alias("x")).select("answer", "x.key", "x.value")


def objects(facts: DataFrame, name: str) -> DataFrame:
    """(name, key, name_set): the sorted set of values of each entity and key."""
    return facts.groupBy(F.col("entity").alias(name), "key").agg(F.array_sort(F.collect_set("value")).alias(f"{name}_set"))


def grid(cands: DataFrame, facts: DataFrame) -> DataFrame:
    """Every fact key of an answer against each of its candidates, with both sets; absence is an empty set, never a loss."""
    a = cands.select("answer", "cand", "pos", "score").join(objects(facts, "answer"), "answer")
    return a.join(objects(facts, "cand"), ["cand", "key"], "left").withColumn("cand_set", F.coalesce("cand_set", F.array().cast("array<string>")))


def set_relation(pairs: DataFrame) -> DataFrame:
    """grid() with the 6-way relation of the two sets and their Jaccard similarity."""
    a, b = F.col("answer_set"), F.col("cand_set")
    both = F.size(F.array_intersect(a, b))
    kind = (
        F.when(F.size(b) == 0, "KEY_ABSENT").when((both == F.size(a)) & (both == F.size(b)), "EQUAL").when(both == F.size(a), "ANSWER_STRICT_SUBSET")
        .when(both == F.size(b), "CANDIDATE_STRICT_SUBSET").when(both > 0, "PARTIAL_OVERLAP").otherwise("DISJOINT")
    )
    return pairs.select("answer", "cand", "key", kind.alias("relation"), (both / F.size(F.array_union(a, b))).alias("jaccard"))


def evidence_status(matrix: DataFrame) -> DataFrame:
    """The three-status form: SHARED, ABSENCE_ONLY, POSITIVE_ALTERNATIVE."""
    return matrix.select("answer", "cand", "key", "value", F.when(F.col("level") == 0, "SHARED").when(F.col("level") == 1, "ABSENCE_ONLY").otherwise("POSITIVE_ALTERNATIVE").alias("status"))


def scope_cardinalities(facts: DataFrame, scope: DataFrame) -> DataFrame:
    """(scope, key, support, most, violations): entities with a value, the largest number of values, entities with several."""
    per = facts.groupBy("entity", "key").agg(F.countDistinct("value").alias("n")).join(scope.hint("merge"), "entity")
    return per.groupBy("scope", "key").agg(F.count("*").alias("support"), F.max("n").alias("most"), F.count_if(F.col("n") > 1).alias("violations"))


def single_valued_rules(cardinalities: DataFrame, support: int = 5) -> DataFrame:
    """A rule per scope and key, active where enough entities have a value and none has several."""
    status = F.when(F.col("violations") > 0, "INACTIVE_MULTI_VALUED").when(F.col("support") < support, "INACTIVE_LOW_SUPPORT").otherwise("ACTIVE")
    return cardinalities.select("scope", "key", "support", "most", "violations", status.alias("status"))
