"""Lookups of entities: batches, redirects, identities and kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def found_or_missing(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(uri, turn, status): each wanted key in its place, FOUND or MISSING."""
    return wanted.join(known.select("uri").distinct().withColumn("hit", F.lit(True)), "uri", "left").select("uri", "turn", F.when(F.col("hit"), "FOUND").otherwise("MISSING").alias("status"))


def per_entity(rows: DataFrame, entity: str, order: list[str], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(entity).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def resolve(members: DataFrame, hops: DataFrame, local: DataFrame, most: int) -> DataFrame:
    """(member, status, node): a member's own node, or the first local one along its redirects.

    EXACT, RESOLVED, NO_REDIRECT, CYCLE, NOT_LOCAL where the chain ends elsewhere, HOP_BUDGET beyond `most` hops. Each hop is a
    join of all members that are still on their way.
    """
    home = local.select(F.col("id").alias("at"), F.lit(True).alias("here"))
    rows = members.select("member", F.col("member").alias("at"), F.array("member").alias("seen"), F.lit(None).cast("string").alias("status"))
    rows = rows.join(home, "at", "left").select("member", "at", "seen", F.when(F.col("here"), "EXACT").alias("status"))
    step = hops.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    for k in range(1, most + 1):
        rows = rows.join(step, "at", "left")
        going = F.col("status").isNull()
        ended = F.when(F.col("next").isNull(), "NO_REDIRECT" if k == 1 else "NOT_LOCAL")
        rows = rows.select("member", F.when(going & F.col("next").isNotNull(), F.col("next")).otherwise(F.col("at")).alias("at"), "seen", F.when(going, ended).otherwise(F.col("status")).alias("status"))
        rows = rows.join(home, "at", "left")
        going = F.col("status").isNull()
        cycle = F.array_contains("seen", F.col("at"))
        status = F.when(going & cycle, "CYCLE").when(going & F.col("here"), "RESOLVED").otherwise(F.col("status"))
        rows = rows.select("member", "at", F.concat("seen", F.array("at")).alias("seen"), status.alias("status"))
    return rows.select("member", F.coalesce("status", F.lit("HOP_BUDGET")).alias("status"), F.when(F.col("status").isin("EXACT", "RESOLVED"), F.col("at")).alias("node"))


def identity(answers: DataFrame, hops: DataFrame, local: DataFrame) -> DataFrame:
    """(answer, status, node, step): the local node that an answer is: its own name (0), else what it redirects to (1), else the one name that redirects there (2).

    The first step with a local node decides. AMBIGUOUS only where several names of the last step are local. An answer without a
    redirect is what it redirects to. Of several redirects of one name the smallest target counts.
    """
    target = hops.groupBy(F.col("src").alias("answer")).agg(F.min("dst").alias("target"))
    a = answers.select("answer").join(target, "answer", "left").withColumn("target", F.coalesce("target", "answer"))
    back = a.join(hops.select(F.col("dst").alias("target"), F.col("src").alias("node")), "target")
    found = a.select("answer", F.col("answer").alias("node"), F.lit(0).alias("step")).union(a.select("answer", "target", F.lit(1))).union(back.select("answer", "node", F.lit(2)))
    found = found.join(local.select(F.col("id").alias("node")).distinct(), "node").groupBy("answer", "step").agg(F.countDistinct("node").alias("n"), F.min("node").alias("node"))
    first = found.groupBy("answer").agg(F.min(F.struct("step", "n", "node")).alias("f")).select("answer", "f.*")
    out = a.join(first, "answer", "left")
    one = F.col("n") == 1
    return out.select("answer", F.when(F.col("n").isNull(), "NOT_FOUND").when(one, "RESOLVED").otherwise("AMBIGUOUS").alias("status"), F.when(one, F.col("node")).alias("node"), F.when(one, F.col("step")).alias("step"))


def entity_kind(entities: DataFrame, keys: DataFrame, yes: tuple[str, ...], no: tuple[str, ...], names: tuple[str, str, str]) -> DataFrame:
    """`entities` with kind: names[0] if one of the keys `yes` is observed, else names[1] if one of `no` is, else names[2]."""
    seen = keys.where(F.col("key").isin(*yes, *no)).groupBy("entity").agg(F.bool_or(F.col("key").isin(*yes)).alias("y"))
    return entities.join(seen, "entity", "left").withColumn("kind", F.when(F.col("y"), names[0]).when(F.col("y").isNotNull(), names[1]).otherwise(names[2])).drop("y")
