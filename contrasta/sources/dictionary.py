"""Dictionary encoding of a graph: dense ids in the order of names, and an adjacency by id from which few owners are read cheaply."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stash import folder, stash, written

#: Owners of one range of ids lie together in a file, so a filter on owners skips the others by the ranges in file footers.
ROWS_PER_FILE = 2_000_000
_LOW = (1 << 33) - 1


def encode(triples: DataFrame) -> DataFrame:
    """(term, id): every distinct subject, predicate and object, numbered 0, 1, .. in the order of names.

    Names are ranged over partitions and numbered there; the driver adds up one count per partition. Null is no term.
    """
    terms = triples.select(F.explode(F.array("s", "p", "o")).alias("term")).where("term is not null").distinct()
    placed = stash(terms.repartitionByRange("term").sortWithinPartitions("term").select("term", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    starts, n = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        starts.append((r.part, n))
        n += r["count"]
    begins = F.broadcast(triples.sparkSession.createDataFrame(starts, "part long, start long"))  # a row per partition
    return placed.withColumn("part", part).join(begins, "part").select("term", (F.col("start") + F.col("at").bitwiseAND(F.lit(_LOW))).alias("id"))


def encoded(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """`triples` as ids (s, p, o), each as often as it is there. Few predicates are looked up where their rows lie; hot objects are split by adaptive execution."""
    few = written(terms.join(triples.select(F.col("p").alias("term")).distinct(), "term").select(F.col("term").alias("p"), F.col("id").alias("p_id")))
    out = triples.join(few, "p").drop("p")
    for c in ("o", "s"):
        out = out.join(terms.select(F.col("term").alias(c), F.col("id").alias(f"{c}_id")), c).drop(c)
    return out.select(F.col("s_id").alias("s"), F.col("p_id").alias("p"), F.col("o_id").alias("o"))


class Adjacency:
    """Edges from both ends, sorted by owner, in files by ranges of owners: (owner, p, out, other)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, triples: DataFrame, path: str | None = None) -> Adjacency:
        """triples: (s, p, o) as ids. Repeated edges stay repeated. A node with very many edges may fill several files."""
        spark = triples.sparkSession
        path = path or f"{folder(spark)}/adjacency-{uuid.uuid4().hex}"
        # written first: ranges are sampled before rows move, which would look every id up again
        end = lambda owner, out, other: F.struct(F.col(owner).alias("owner"), "p", F.lit(out).alias("out"), F.col(other).alias("other"))
        ends = written(triples).select(F.explode(F.array(end("s", True, "o"), end("o", False, "s"))).alias("e")).select("e.*")
        ends.repartitionByRange("owner", "p", "other").sortWithinPartitions("owner", "p", "out", "other").write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
        return cls(spark, path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def of(self, owners: list[int]) -> DataFrame:
        """The edges of a few owners: the filter reaches the scan, which skips row groups of other owners."""
        return self.read().where(F.col("owner").isin(owners))


def batched(terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """(turn, term, id) for each wanted (turn, term), in its place; null where the graph lacks the term."""
    return wanted.join(terms, "term", "left").select("turn", "term", "id")
