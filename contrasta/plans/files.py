"""Queries through files: tables written as JSON lines and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import jsonl as J
from ..sources import tables as T
from ..sources.stash import folder
from .catalogue import query


def place(spark) -> str:
    return f"{folder(spark)}/jsonl-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def jsonl_round_trip(spark, d):
    """All orders, written as canonical JSON lines, checked against the manifest and read back."""
    path = place(spark)
    J.write_jsonl(T.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path)
    return J.load_jsonl(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("SELECT 'row' AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 AS k, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT 'NOT_JSON', NULL, count(*) FROM pages")
def jsonl_faults(spark, d):
    """The properties of events and the addresses of pages as lines of one file set: objects are rows, other lines are faults with their places."""
    path = place(spark)
    lines = T.read(spark, d, "events").select(F.col("props").alias("value")).unionByName(T.read(spark, d, "pages").select(F.col("url").alias("value")))
    lines.write.text(path)
    found = J.read_jsonl(spark, path, "k long", ("k",))
    rows = found.rows.groupBy((F.col("k") % 2).alias("k")).agg(F.count("*").alias("n")).select(F.lit("row").alias("kind"), "k", "n")
    return rows.unionByName(found.faults.groupBy("reason").agg(F.count("*").alias("n")).select(F.col("reason").alias("kind"), F.lit(None).cast("long").alias("k"), "n"))
