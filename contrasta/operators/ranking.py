"""Ranking: normalised ranks, fusion, ties, top-k, retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.stash import stash


def rank_normalize(value: str, by: list[str]) -> Column:
    """Ranks from 0 (least) to 1 (largest); ties share their mean rank; a single row is 1.0. Sums in position order."""
    group = Window.partitionBy(*by)
    n = F.count("*").over(group)
    mean = F.rank().over(group.orderBy(value)) - 1 + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0
    return F.when(n == 1, 1.0).otherwise(mean / (n - 1))


def fuse(rows: DataFrame, a: str, b: str, by: list[str], name: str, alpha: float) -> DataFrame:
    """rows with `fused` = alpha * a + (1 - alpha) * b over normalised ranks, and `place` by (fused descending, name)."""
    rows = rows.withColumns({"na": rank_normalize(a, by), "nb": rank_normalize(b, by)})
    rows = rows.withColumn("fused", F.lit(alpha) * F.col("na") + F.lit(1 - alpha) * F.col("nb"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("fused"), name)))


def tie_groups(rows: DataFrame, by: str, score: str) -> DataFrame:
    """rows with the number and the size of the group of equal scores, compared exactly."""
    return rows.withColumns({"tie_group": F.dense_rank().over(Window.partitionBy(by).orderBy(F.desc(score))), "tie_size": F.count("*").over(Window.partitionBy(by, score))})


def top_k(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def cosine(a: str, b: str) -> Column:
    """Cosine similarity of two arrays, summed from left to right; null if one is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm != 0, dot(a, b) / norm)


#: Vectors and queries of a cell of nearest() and places(), and queries whose similarities are held at once.
VECTORS, QUERIES, AT_ONCE = 4096, 2048, 256


def _cells(vectors: DataFrame, queries: DataFrame, found: Callable[[dict, np.ndarray, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """Each block of queries meets each block of vectors in a cell: what a task holds is bounded, and blocks are dealt by id.

    found: gets the columns of some queries, the vectors' ids in ascending order, the negated similarities, rounded to 9 places
    (2 where there is none, 3 for the query itself), and the hits.
    """
    across, down = (max(1, -(-df.count() // n)) for df, n in ((queries, QUERIES), (vectors, VECTORS)))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select(F.col("vec_id").alias("id"), "embedding", "label", dealt("vec_id", down).alias("row")).withColumn("column", every(across))
    q = queries.withColumn("to", dealt("vec_id", across)).withColumn("at", every(down)).select([F.col(c).alias(f"q_{c}") for c in [*queries.columns, "to", "at"]])  # new columns: both sides may come from one table

    def unit(embedding: pa.ChunkedArray) -> np.ndarray:
        lists = embedding.to_numpy()
        x = np.zeros((len(lists), width))
        for i, e in enumerate(lists):
            if e is not None:
                x[i] = e
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm != 0)

    def run(v: pa.Table, q: pa.Table) -> pa.Table:
        out: list[dict] = []
        if v.num_rows and q.num_rows:
            v = v.sort_by("id")
            ids, x, y = v["id"].to_numpy(), unit(v["embedding"]), unit(q["q_embedding"])
            names = pa.chunked_array([*v["label"].chunks, *q["q_label"].chunks]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            mine, theirs = names[: len(ids)], names[len(ids) :]
            columns = {c[2:]: q[c].to_numpy() for c in q.column_names if c not in ("q_embedding", "q_label")}
            for i in range(0, q.num_rows, AT_ONCE):
                some = {c: a[i : i + AT_ONCE] for c, a in columns.items()}
                down = np.nan_to_num(-np.round(y[i : i + AT_ONCE] @ x.T, 9), nan=2.0)
                down[some["vec_id"][:, None] == ids[None, :]] = 3.0
                other = theirs[i : i + AT_ONCE, None]
                out.append(found(some, ids, down, (other == mine[None, :]) & (other >= 0) & (down < 3)))
        empty = pa.Table.from_pylist([], schema=to_arrow_schema(kind))
        return pa.concat_tables([empty, *[pa.table(o).cast(empty.schema) for o in out]])

    kind, width = StructType.fromDDL(schema), vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    return v.groupBy("row", "column").cogroup(q.groupBy("q_at", "q_to")).applyInArrow(run, kind)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, hits: bool = False) -> DataFrame:
    """(query, id, sim, rank, hit): of each query the k nearest vectors, itself left out, ties by id; a hit has the query's label. hits: of hits alone."""

    def found(some: dict, ids: np.ndarray, down: np.ndarray, hit: np.ndarray) -> dict:
        value = np.where(hit, down, 3.0) if hits else down
        n = min(k, len(ids))
        row, at = np.nonzero((value <= np.partition(value, n - 1, axis=1)[:, n - 1 : n]) & (value < 3))
        order = np.lexsort((at, value[row, at], row))
        row, at = row[order], at[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, at = row[keep], at[keep]
        sim = -value[row, at]
        return {"query": some["vec_id"][row], "id": ids[at], "sim": pa.array(sim, mask=sim == -2.0), "hit": hit[row, at].astype("int32")}

    rows = _cells(vectors, queries.select("vec_id", "embedding", "label"), found, "query long, id long, sim double, hit int")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query", "id", "sim", "rank", "hit")


def first_hits(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, rank, hit): the place of each query's first hit among all vectors; a query without one has a row with hit 0 and no rank.

    The nearest hit is found first, then the vectors before it are counted: no list is sorted.
    """

    def found(some: dict, ids: np.ndarray, down: np.ndarray, hit: np.ndarray) -> dict:
        best = some["best"][:, None]
        return {"query": some["vec_id"], "before": ((down < best) | ((down == best) & (ids[None, :] < some["best_id"][:, None]))).sum(axis=1)}

    first = nearest(vectors, queries, 1, hits=True).select(F.col("query").alias("vec_id"), (-F.coalesce("sim", F.lit(-2.0))).alias("best"), F.col("id").alias("best_id"))
    with_hit = queries.select("vec_id", "embedding", "label").join(stash(first), "vec_id")
    places = _cells(vectors, with_hit, found, "query long, before long").groupBy("query").agg((1 + F.sum("before")).alias("rank"))
    ends = vectors.agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))
    listed = queries.select(F.col("vec_id").alias("query")).crossJoin(ends).where("query <> low or query <> high").select("query")
    return listed.join(places, "query", "left").select("query", "rank", F.col("rank").isNotNull().cast("int").alias("hit"))


def relevant(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, relevant): how many other vectors have the query's label."""
    per = vectors.groupBy("label").agg(F.count("*").alias("n"))
    own = vectors.groupBy("label", F.col("vec_id").alias("query")).agg(F.count("*").alias("own"))
    rows = queries.select(F.col("vec_id").alias("query"), "label").join(per, "label").join(own.hint("merge"), ["label", "query"], "left")
    return rows.select("query", (F.col("n") - F.coalesce("own", F.lit(0))).alias("relevant"))


def specificity(n: Column, total: Column) -> Column:
    """1 for a class of one member, 0 for one of all, by logarithms; an unknown count gives 0."""
    most = F.greatest(total, n, F.lit(2.0))
    return F.when(n.isNull(), 0.0).otherwise(F.log(most / F.greatest(n, F.lit(1.0))) / F.log(most))


def mrr(ranked: DataFrame) -> DataFrame:
    """(queries, mrr): the mean over all queries of the inverse rank of the first hit, 0 where there is none."""
    first = ranked.groupBy("query").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    return first.agg(F.count("*").alias("queries"), F.coalesce(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def ndcg(ranked: DataFrame, k: int, relevant: DataFrame) -> DataFrame:
    """(query, ndcg): of each query with a relevant item; where there is none it is undefined and left out. ranked: the first k places at least."""
    gain = F.when((F.col("hit") == 1) & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = ranked.groupBy("query").agg(F.sum(gain).alias("dcg")).join(relevant.where("relevant > 0"), "query")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.select("query", (F.col("dcg") / ideal).alias("ndcg"))


def mean_ndcg(ranked: DataFrame, k: int, relevant: DataFrame) -> DataFrame:
    return ndcg(ranked, k, relevant).agg(F.count("*").alias("queries"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"))


def precision_at(ranked: DataFrame, k: int) -> DataFrame:
    """(k, precision) for 1 to k: over all queries the mean share of hits up to there; a query whose list has ended adds nothing."""
    n = ranked.agg(F.countDistinct("query").alias("queries"))
    so_far = F.sum("hit").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    per = ranked.where(F.col("rank") <= k).select("rank", so_far.alias("hits")).groupBy("rank").agg(F.sum("hits").alias("hits"))
    return per.crossJoin(n).select(F.col("rank").alias("k"), (F.col("hits") / F.col("rank") / F.col("queries")).alias("precision"))


def mmr(rows: DataFrame, k: int = 3, weight: float = 0.7, limit: float = 0.9) -> DataFrame:
    """(answer, id, turn): greedy choice by weight * relevance - (1 - weight) * largest redundancy, which must be below `limit`.

    rows: answer, id, relevance, vector; each answer's candidates are a bounded list, so an answer is one group.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {r.id: (r.relevance, r.vector) for r in pdf.itertuples()}
        same = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / ((sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5 or 1)
        taken: list = []
        while left and len(taken) < k:
            scored = []
            for i, (rel, v) in left.items():
                red = max((same(v, w) for _, w in taken), default=0.0)
                if red < limit:
                    scored.append((-(weight * rel - (1 - weight) * red), i))
            if not scored:
                break
            i = min(scored)[1]
            taken.append((i, left.pop(i)[1]))
        return pd.DataFrame([(pdf["answer"].iloc[0], i, n + 1) for n, (i, _) in enumerate(taken)], columns=["answer", "id", "turn"])

    return rows.groupBy("answer").applyInPandas(choose, "answer long, id long, turn int")
