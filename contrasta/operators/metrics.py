"""Mapping, chains, roll-ups and metrics with their denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stash import stash


def class_idf(members: DataFrame) -> DataFrame:
    """(class, members, idf): ln(N / n) over distinct members."""
    per = members.groupBy("class").agg(F.countDistinct("member").alias("members"))
    whole = members.agg(F.countDistinct("member").alias("whole"))
    return per.crossJoin(F.broadcast(whole)).select("class", "members", F.round(F.log(F.col("whole") / F.col("members")), 9).alias("idf"))  # one row


def map_members(members: DataFrame, redirects: DataFrame, local: DataFrame) -> DataFrame:
    """(member, way, node): the member's own node, else that of its redirect, else unresolved."""
    rows = members.join(local.select(F.col("id").alias("member"), F.col("id").alias("own")), "member", "left")
    rows = rows.join(redirects.withColumnRenamed("src", "member"), "member", "left").join(local.select(F.col("id").alias("dst"), F.col("id").alias("other")), "dst", "left")
    way = F.when(F.col("own").isNotNull(), "EXACT").when(F.col("other").isNotNull(), "REDIRECT").otherwise("UNRESOLVED")
    return rows.select("member", way.alias("way"), F.coalesce("own", "other").alias("node"))


def chain(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, hops): where a chain of single hops leads, for each number of hops up to a limit; cycles end there."""
    level = edges.select("src", "dst", F.lit(1).alias("hops"))
    found = level
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    for h in range(2, hops + 1):
        level = level.join(step, "dst").select("src", F.col("next").alias("dst"), F.lit(h).alias("hops"))
        found = found.union(level)
    return found


def page(rows: DataFrame, key: str, after: object, size: int) -> DataFrame:
    """A page of rows by key, after a cursor."""
    return rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def fill_forward(rows: DataFrame, by: str, order: str, mark: str) -> DataFrame:
    """rows with the last mark that was set so far."""
    return rows.withColumn(mark, F.last(mark, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def grouping_sets(rows: DataFrame, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates over every subset of the columns."""
    return rows.cube(*by).agg(*aggregates)


def describe(rows: DataFrame) -> DataFrame:
    """(grp, n, mean, median, least, most) of x."""
    return rows.groupBy("grp").agg(F.count("x").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.percentile("x", F.lit(0.5)), 4).alias("median"), F.min("x").alias("least"), F.max("x").alias("most"))


def percentiles(rows: DataFrame, at: tuple[float, ...]) -> DataFrame:
    """Linearly interpolated percentiles of x by group, exact, without a group in one task.

    Distinct values are ranged over partitions in their order; a row per partition and group says how many lie before it.
    """
    counts = rows.groupBy("grp", "x").agg(F.count("x").alias("n"))
    placed = stash(counts.repartitionByRange("grp", "x").select("grp", "x", "n", F.spark_partition_id().alias("part")))
    ranges = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part", "grp").agg(F.sum("n").alias("here"))
    sizes = sizes.select(F.col("part").alias("p"), F.col("grp").alias("g"), F.coalesce(F.sum("here").over(ranges), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("grp")).alias("total"))
    along = Window.partitionBy("part", "grp").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("upto", F.sum("n").over(along)).join(sizes, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    ranked = ranked.withColumn("upto", F.col("before") + F.col("upto"))
    value = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("x")))
    ends, out = [], []
    for q in at:
        place, name = (F.col("total") - 1) * F.lit(q), f"p{round(q * 100)}"
        ends += [value(F.floor(place)).alias(f"{name}_lo"), value(F.ceil(place)).alias(f"{name}_hi"), F.max(place).alias(f"{name}_at")]
        lo, hi, share = F.col(f"{name}_lo"), F.col(f"{name}_hi"), F.col(f"{name}_at") - F.floor(f"{name}_at")
        out.append(F.round(F.when(lo == hi, lo).otherwise((1 - share) * lo + share * hi), 4).alias(name))
    return ranked.groupBy("grp").agg(*ends).select("grp", *out)


def percent(n: Column, of: Column) -> Column:
    """100 n / of with two decimals; null where there is nothing to divide by."""
    return F.round(100 * n / F.when(of != 0, of), 2)


def coverage(matrix: DataFrame) -> DataFrame:
    """(metric, value, denominator): how much of the evidence matrix is covered."""
    m = matrix.agg(F.countDistinct("answer").alias("answers"), F.countDistinct(F.when(F.col("level") >= 2, F.col("answer"))).alias("covered"), F.count("*").alias("cells"), F.count_if(F.col("level") >= 2).alias("covered_cells"))
    rows = F.array(
        F.struct(F.lit("answers").alias("metric"), F.col("answers").cast("double").alias("value"), F.lit(None).cast("long").alias("denominator")),
        F.struct(F.lit("covered_answers_pct").alias("metric"), percent(F.col("covered"), F.col("answers")).alias("value"), F.col("answers").alias("denominator")),
        F.struct(F.lit("covered_cells_pct").alias("metric"), percent(F.col("covered_cells"), F.col("cells")).alias("value"), F.col("cells").alias("denominator")),
    )
    return m.select(F.inline(rows))
