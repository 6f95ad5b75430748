"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only in local mode, which has one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="contrasta-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Written as Parquet and read back: what uses it several times has a short plan, and a lost executor repeats no more than this.

    Joins with it are by sorting: its size on disk says little of its rows, and such a guess would send it through the driver.
    """
    return written(df).hint("merge")


def looked_up(df: DataFrame) -> DataFrame:
    """As stash(), for a table of few rows that are looked up: where its files are small they are sent to the rows, which then stay in place."""
    return written(df.coalesce(1))


def written(df: DataFrame) -> DataFrame:
    """Written and read back; joins with it go by the size of its files."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
