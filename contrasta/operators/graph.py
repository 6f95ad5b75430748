"""Graph operators: directed facts, degrees, induced subgraphs, budgets, closure."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def directed_facts(triples: DataFrame) -> DataFrame:
    """(owner, p, dir, other): distinct one-hop facts; OUT and IN never merge."""
    out = triples.select(F.col("s").alias("owner"), "p", F.lit("OUT").alias("dir"), F.col("o").alias("other"))
    into = triples.select(F.col("o").alias("owner"), "p", F.lit("IN").alias("dir"), F.col("s").alias("other"))
    return out.union(into).distinct()


def one_hop_profile(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, neighbours): degrees count repeated edges, neighbours are distinct and not the node."""
    ends = triples.select(F.col("s").alias("node"), F.col("o").alias("other"), F.lit(1).alias("out")).union(triples.select("o", "s", F.lit(0)))
    ends = ends.join(nodes, "node")
    agg = ends.groupBy("node").agg(F.sum("out").alias("out_degree"), F.sum(1 - F.col("out")).alias("in_degree"), F.countDistinct(F.when(F.col("other") != F.col("node"), F.col("other"))).alias("neighbours"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.join(agg, "node", "left").select("node", zero("out_degree"), zero("in_degree"), zero("neighbours"))


def induced_edges(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among `nodes`, as often as they are there."""
    keep = nodes
    return triples.join(keep.select(F.col("node").alias("s")), "s", "left_semi").join(keep.select(F.col("node").alias("o")), "o", "left_semi").select("s", "p", "o")


def coverage_ratio(triples: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, full, retained, ratio): the share of a seed's distinct neighbours that `nodes` retain; 1.0 without neighbours."""
    n = triples.select(F.col("s").alias("node"), F.col("o").alias("other")).union(triples.select("o", "s")).where("node <> other")
    n = n.join(seeds, "node").distinct().join(nodes.select(F.col("node").alias("other"), F.lit(1).alias("kept")), "other", "left")
    agg = n.groupBy("node").agg(F.count("*").alias("full"), F.count("kept").alias("retained"))
    out = seeds.join(agg, "node", "left").select("node", F.coalesce("full", F.lit(0)).alias("full"), F.coalesce("retained", F.lit(0)).alias("retained"))
    return out.withColumn("ratio", F.when(F.col("full") == 0, 1.0).otherwise(F.col("retained") / F.col("full")))


def predicate_census(triples: DataFrame, top: int = 3) -> DataFrame:
    """(p, edges, subjects, objects, rank, o, n): counts per predicate with its `top` objects, ties by name."""
    per = triples.groupBy("p", "o").agg(F.count("*").alias("n"))
    best = per.withColumn("rank", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("n"), "o"))).where(F.col("rank") <= top)
    whole = triples.groupBy("p").agg(F.count("*").alias("edges"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))
    return best.join(whole, "p").select("p", "edges", "subjects", "objects", "rank", "o", "n")


def edge_rarity(triples: DataFrame, facts: DataFrame) -> DataFrame:
    """facts with the number of other distinct subjects of the same (p, o)."""
    near = triples.join(facts.select("p", "o").distinct(), ["p", "o"], "left_semi")
    count = near.groupBy("p", "o").agg(F.countDistinct("s").alias("holders"))
    return facts.join(count, ["p", "o"], "left").select("s", "p", "o", (F.coalesce("holders", F.lit(0)) - 1).alias("others"))


def ancestors(edges: DataFrame, depth: int = 4) -> DataFrame:
    """(child, ancestor, depth): transitive closure of (child, parent) to `depth`, at the least depth of each pair."""
    level = edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    found = level
    up = edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"))
    for d in range(2, depth + 1):
        level = level.join(up, "ancestor").select("child", F.col("next").alias("ancestor"), F.lit(d).alias("depth")).distinct()
        found = found.union(level)
    return found.where("child <> ancestor").groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))


def admission_order(rows: DataFrame, seed: str) -> DataFrame:
    """(answer, cand, position): candidates in the order of SHA-256(seed NUL answer NUL cand), then by name."""
    digest = F.sha2(F.concat_ws("\0", F.lit(seed), F.col("answer").cast("string"), F.col("cand").cast("string")), 256)
    return rows.select("answer", "cand", F.row_number().over(Window.partitionBy("answer").orderBy(digest, "cand")).alias("position"))
