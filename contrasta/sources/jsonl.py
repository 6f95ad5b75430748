"""JSON lines: read with the place of every row and of every fault, written in one canonical form with a manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stash import stash

#: Why a line is refused.
BAD_JSON, MISSING = "NOT_JSON", "MISSING_FIELD"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of all text files under `path`, lines from 1 on.

    Large files are read in several blocks at once. A line's number is its place in its block and what the blocks before have; the
    table of blocks has a row per block of the input. Written first, as the place in a block is known only where it's read.
    """
    rows = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = stash(rows)
    blocks = rows.groupBy("file_path", "file_block_start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = {}
    starts = []
    for b in sorted(blocks.collect(), key=lambda b: (b.file_path, b.file_block_start)):  # a row per block
        starts.append((b.file_path, b.file_block_start, b.first, before.get(b.file_path, 0)))
        before[b.file_path] = before.get(b.file_path, 0) + b.n
    known = F.broadcast(spark.createDataFrame(starts, "file_path string, file_block_start long, first long, lines long"))
    return rows.join(known, ["file_path", "file_block_start"]).select(F.col("file_path").alias("file"), (F.col("at") - F.col("first") + F.col("lines") + 1).alias("line"), "text")


@dataclass(frozen=True)
class Lines:
    """rows: file, line and the fields. faults: (file, line, reason, field), a row per fault."""

    rows: DataFrame
    faults: DataFrame

    def strict(self) -> DataFrame:
        """The rows if there is no fault, else an error that names the first ones."""
        some = self.faults.orderBy("file", "line", "field").limit(5).collect()
        if some:
            raise ValueError("; ".join(f"{r.file}:{r.line} {r.reason} {r.field or ''}".strip() for r in some))
        return self.rows


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, required: tuple[str, ...] = ()) -> Lines:
    """The objects of all lines; blank lines are skipped. A line that is no JSON object of this schema, or lacks a required field or has it null or blank, is a fault and no row."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    unknown = set(required) - set(fields.names)
    if unknown:
        raise ValueError(f"required but not in the schema: {sorted(unknown)}")
    kept = "_refused"
    whole = T.StructType([*fields.fields, T.StructField(kept, T.StringType())])
    lines = numbered_lines(spark, path).where(F.trim("text") != "")
    read = lines.select("file", "line", F.from_json("text", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": kept}).alias("r"), F.trim("text").startswith("{").alias("object"))
    broken = F.col("r").isNull() | F.col(f"r.{kept}").isNotNull() | ~F.col("object")
    blank = lambda c: F.col(f"r.`{c}`").isNull() | (F.trim(F.col(f"r.`{c}`").cast("string")) == "")
    lacks = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in required])) if required else F.array().cast("array<string>")
    read = read.withColumns({"broken": broken, "lacks": lacks})
    faults = read.where("broken").select("file", "line", F.lit(BAD_JSON).alias("reason"), F.lit(None).cast("string").alias("field"))
    faults = faults.unionByName(read.where("not broken").select("file", "line", F.lit(MISSING).alias("reason"), F.explode("lacks").alias("field")))
    rows = read.where("not broken and size(lacks) = 0").select("file", "line", *[F.col(f"r.`{c}`").alias(c) for c in fields.names])
    return Lines(rows, faults)


def canonical(df: DataFrame) -> DataFrame:
    """(value): each row as JSON with its fields in the order of names and nulls written out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def _digest(lines: DataFrame) -> dict:
    """Rows, and a digest that doesn't depend on their order: sums of two 64-bit hashes, as decimals that don't overflow."""
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), F.col("value")).cast("decimal(20,0)")), F.lit(0)).cast("string")
    r = lines.agg(F.count("*").alias("rows"), total("a").alias("a"), total("b").alias("b")).first()
    return {"rows": r.rows, "digest": f"{r.a}:{r.b}"}


def write_jsonl(df: DataFrame, path: str, per_file: int = 1_000_000) -> dict:
    """Canonical JSON lines under path/data and a manifest beside them: fields with their types, rows, digest. Returns the manifest."""
    lines = canonical(df)
    lines.write.option("maxRecordsPerFile", per_file).text(f"{path}/data")
    manifest = {"fields": {f.name: f.dataType.simpleString() for f in sorted(df.schema.fields, key=lambda f: f.name)}} | _digest(df.sparkSession.read.text(f"{path}/data"))
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """What write_jsonl() wrote. An error if lines were changed, added or lost since, or if there is no one manifest."""
    found = [r.value for r in spark.read.text(f"{path}/manifest").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{path} has {len(found)} manifests")
    manifest = json.loads(found[0])
    lines = spark.read.text(f"{path}/data")
    now = _digest(lines)
    wrong = [k for k, v in now.items() if manifest.get(k) != v]
    if wrong:
        raise ValueError(f"{path} isn't what its manifest says: {', '.join(f'{k} {now[k]} for {manifest.get(k)}' for k in wrong)}")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in manifest["fields"].items())
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
