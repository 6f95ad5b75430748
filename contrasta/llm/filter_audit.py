"""Audit of how document filters interact, over every order in which they may be applied.

Each document fails some of k filters, so the corpus is counted once into mask cells: one row per part and set of failed
filters, at most 2^k per part. The cells are unpivoted against the steps of all k! orders. Within one cell and order a
running bit-or over the earlier steps tells what has removed the cell's documents already; conditional sums of the cells
give each step's counts, and totals over the windows of a filter give its Shapley sum. Only the counting sees documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

#: Words are maximal runs of other characters than these.
BLANKS = r"[\x20\x09-\x0D]+"
#: The filters of the query, in the order of their bits.
NAMES = "ABCDE"
#: Orders are k! in number and constant in the data; beyond this many filters there would be more orders than cells are worth.
MOST_FILTERS = 7
SLOTS = 1 << 16


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 200 words), B (under half of its words distinct), C (over 2 % capitals A-Z), D (holds a sign of #$%&*|)."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 2 * F.char_length(text), text.rlike("[#$%&*|]")]


def mask_of(failures: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failures)])


def mask_cells(docs: DataFrame, labels: DataFrame, failures: Sequence[Column], part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail, one bit per filter.

    failures: conditions on columns of `docs`; after them comes one more filter, failed by a document whose whole text is
    that of a document with a smaller id, whichever part it is in. Null texts count as empty, a null part as the empty
    string. A null id is neither smaller nor larger than another, so rows without id never fail the last filter and have
    no label; rows that repeat an id are counted each and don't make each other fail. A document is good or toxic if
    any of its label rows says 1; labels of other documents, and null labels, count for nothing. Texts of any length are
    read whole, in one pass; equal texts are known by their SHA-256. Other columns, whatever their names, are not read.
    Without documents there are no cells.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    known = F.col(doc_id).cast("long")
    # rows without an id meet no label; slots keep them from meeting in one task
    slot = F.when(known.isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SLOTS))).otherwise(F.lit(0))
    read = docs.withColumn(text, whole).select(
        F.coalesce(known, F.lit(0)).alias("doc_id"), slot.alias("slot"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask_of(failures).cast("int").alias("mask"), F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("digest"),
    )
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    said = said.where("doc_id is not null and (good = 1 or toxic = 1)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = read.join(said.withColumn("slot", F.lit(0).cast("long")), ["doc_id", "slot"], "left").withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    # one row per document, however often it is repeated: where rows lie by doc_id already, this moves none
    once = rows.groupBy("doc_id", "slot", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("n")).withColumn("doc_id", F.when(F.col("slot") == 0, F.col("doc_id")))
    # copies of a text are added up before they meet, so a text that many share is a few rows per task
    alike = once.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("lone"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    least = F.min("first").over(Window.partitionBy("digest"))
    stay = F.col("lone") + F.when(F.col("first") == least, F.col("n_first")).otherwise(F.lit(0))
    counted = alike.withColumn("stay", stay)
    bit = F.lit(1 << len(failures))
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("stay").alias("n")), F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), (F.col("n") - F.col("stay")).alias("n"))))
    cells = counted.select("part", "good", "toxic", both.alias("cell")).where("cell.n > 0")
    return cells.groupBy("part", F.col("cell.mask").alias("mask")).agg(F.sum("cell.n").alias("n"), F.sum(F.col("cell.n") * F.col("good")).alias("good"), F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic"))


def audit(cells: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from mask_cells().

    One row per part, order of the filters and step, zeros included. names: one character per filter, in the order of
    the bits of `mask`. shapley is the number of documents that the step's filter removes, summed over all orders.
    Without cells there are no rows.
    """
    if len(set(names)) != len(names) or len(names) > MOST_FILTERS:
        raise ValueError(f"{names!r}: at most {MOST_FILTERS} filters, each with a character of its own")
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(names)]))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    bit = F.coalesce(*[F.when(letter == name, F.lit(1 << i)) for i, name in enumerate(names)])
    long = cells.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step")).withColumn("bit", bit)
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    total = lambda value, when: F.sum(F.when(when, F.col(value)).otherwise(F.lit(0)))
    out = long.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~fails & ~gone).alias("kept"), total("n", fails & ~gone).alias("removed"), total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"), total("good", fails & ~gone).alias("good_lost"), total("toxic", fails & ~gone).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(mask_cells(docs, table(spark, sf_dir, "labels"), text_failures(F.col("text"))), NAMES)


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
w AS (SELECT t.*, coalesce(t.doc_id > f.first, false) AS again, list_filter(regexp_split_to_array(t.text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t JOIN f ON t.text = f.text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN again THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
s AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o AS (SELECT p.x || q.x || r.x || u.x || v.x AS filter_order, [p.b, q.b, r.b, u.b, v.b] AS bits FROM s p, s q, s r, s u, s v WHERE p.b | q.b | r.b | u.b | v.b = 31),
st AS (SELECT filter_order, i AS step, bits[i] AS bit, list_sum(bits[1:i - 1]) AS earlier FROM o, range(1, 6) g(i)),
a AS (
  SELECT c.part, filter_order, step, bit, coalesce(c.mask & bit, 0) > 0 AS fails, (c.mask & CAST(coalesce(earlier, 0) AS INT)) > 0 AS gone, c.mask = bit AS lone, n, good, toxic FROM c, st),
g AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE lone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost
  FROM a GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM g
"""
