"""Exact dedup by progressive refinement: group by length, then by a prefix hash, then by the full hash.

Each step looks only at rows that the last one left in a group of two or more, and only lengths and hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, bounded, lower_az, row_key, stash, without_rows

#: Characters that the prefix hash reads.
PREFIX = 96


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False, rows: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept[, text_sha256][, row, stays, repeated]): one row per input row.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as empty, and all empty texts are one
    group. keep_id is the largest doc_id of the group (null only if all are null) and group_size counts its rows, so
    repeated rows count. Rows that repeat the doc_id that stays are all marked kept: they are the same document. Texts of
    any length are read whole once their length and prefix agree with another row's. Other columns, whatever their
    names, are not read. An empty table gives an empty result. digest: with the SHA-256 of the normalised text of every
    row, for which every text has to be read. rows: with a digest of id and text as it is, whether that row is the one
    that stays - the largest id and then digest of its group - and how many rows have it.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), row_key(F.col(doc_id).cast("long"), F.col(text)).alias("row"))
    read = read.select("*", F.char_length("text").alias("length"))
    lengths = read.groupBy("length").count().where("count > 1").select("length")
    prefixed = read.select("doc_id", "row", "text", "length", F.xxhash64(lower_az(F.substring("text", 1, PREFIX)), "length").alias("prefix"))
    # the surviving (length, prefix) groups: 16 bytes each
    pairs = stash(prefixed.groupBy("length", "prefix").count().where("count > 1").join(lengths, "length", "left_semi").select("prefix"))
    full = F.sha2(lower_az(F.col("text")).cast("binary"), 256)
    few = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        hashed = prefixed.join(F.broadcast(pairs), "prefix", "left_semi").select("doc_id", "row", full.alias("full"))
    else:
        # to find the survivors' texts would shuffle all texts; hashing where they lie and shuffling 48 bytes costs less
        hashed = prefixed.select("prefix", "doc_id", "row", full.alias("full")).join(pairs, "prefix", "left_semi").select("doc_id", "row", "full")
    same = hashed.groupBy("full", "doc_id", "row").agg(F.count("*").alias("n"))
    groups = same.groupBy("full").agg(F.max(F.struct("doc_id", "row", "n")).alias("top"), F.sum("n").alias("size")).where("size > 1")
    groups = stash(groups.select("full", F.col("top.doc_id").alias("top"), F.col("top.row").alias("top_row"), F.col("top.n").alias("top_n"), "size"))
    hint = F.broadcast(groups) if groups.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4 else groups
    if digest:
        marked = read.select("doc_id", "row", full.alias("full")).join(hint, "full", "left")
    elif few:
        marked = prefixed.join(F.broadcast(pairs.withColumn("twice", F.lit(True))), "prefix", "left").select("doc_id", "row", F.when(F.col("twice"), full).alias("full")).join(hint, "full", "left")
    else:
        marked = prefixed.select("doc_id", "row", full.alias("full")).join(hint, "full", "left")
    found = F.col("size").isNotNull()
    keep = F.when(found, F.col("top")).otherwise(F.col("doc_id"))
    more = [F.col("full").alias("text_sha256")] if digest else []
    if rows:
        more += ["row", (~found | (F.col("row") == F.col("top_row"))).alias("stays"), F.when(F.col("row") == F.col("top_row"), F.col("top_n")).otherwise(F.lit(1)).cast("long").alias("repeated")]
    return marked.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), *more)


def keep_last(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of the rows of `docs` with equal texts the one with the largest doc_id, null ids being smallest; one row where a row is repeated.

    Null and empty texts are equal, so one of them stays. All columns stay as they are, whatever their names; rows that
    repeat id and text but differ in other columns count as repeated. An empty table gives an empty result.
    """
    marks = stash(exact_groups(docs, doc_id, text, rows=True).where("not stays or repeated > 1").select("row", "stays").distinct())
    left = without_rows(docs, marks.select("row"), doc_id, text)
    again = marks.where("stays").select("row")
    if again.isEmpty():
        return left
    key = row_key(F.col(doc_id).cast("long"), F.col(text))
    rec = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"), key.alias("row")).join(bounded(again), "row", "left_semi")
    one = rec.dropDuplicates(["row"])
    return left.union(one.select(*[F.col(f"rec.`{c}`").alias(c) for c in docs.columns]))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP9_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""
