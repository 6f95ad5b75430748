"""Helpers that the text operators share: the shared folder, size-checked joins, text in numpy."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most 32 bytes that a broadcast may hold; larger sides are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Bytes of an Arrow batch, but for one longer row.
BATCH_BYTES = 2 << 20
#: Bytes of text that numpy works on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 18

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the Arrow batches of this session, in rows and in bytes, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it. Where none is named, a temporary one in local mode, which has one machine; elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="contrasta-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Cuts the lineage: written as Parquet in the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes stashes that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stash_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files and broadcasts of plans that have run: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(task: Callable) -> Callable:
    """`task`, after which an idle Python worker gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def row_key(*columns: str | Column) -> Column:
    """A 64-bit digest by which a row is found again, also one without an id; rows that repeat all of `columns` share it."""
    return F.xxhash64(*columns)


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`small` with a broadcast hint if a count shows that it's small enough, else with a hint for a shuffled join.

    `small` should be cheap to count: a stash or an aggregate of one.
    """
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small.hint("merge")


def without_rows(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows of which `gone` has the row_key() of id and text; all columns stay as they are, whatever their names."""
    key = row_key(F.col(doc_id).cast("long"), F.col(text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"), key.alias("row"))
    return rows.join(bounded(gone), "row", "left_anti").select(*[F.col(f"rec.`{c}`").alias(c) for c in docs.columns])


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty. All-ASCII texts take the faster path."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


# -- text in numpy ---------------------------------------------------------------------------------------------------

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mix_in_place(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The same over `x` itself; `spare` is as long, and is overwritten."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.right_shift(x, np.uint64(shift), out=spare)
            x ^= spare
            x *= np.uint64(factor)
        np.right_shift(x, np.uint64(31), out=spare)
        x ^= spare
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE_BYTES * 2)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() has the hash of any span of bytes."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start])


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batches in slices of about `limit` bytes of text, with the texts as bytes; null counts as empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        texts = [b"" if x is None else x.encode() for x in column.to_pylist()]
        at = size = 0
        for k, x in enumerate(texts):
            if size and size + len(x) > limit:
                yield batch.slice(at, k - at), texts[at:k]
                at, size = k, 0
            size += len(x) + 1
        if at < len(texts):
            yield batch.slice(at, len(texts) - at), texts[at:]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a line feed after each, as bytes, and where each begins."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.zeros(len(texts), np.int64)
    if len(texts) > 1:
        np.cumsum(np.fromiter((len(x) + 1 for x in texts[:-1]), np.int64, len(texts) - 1), out=starts[1:])
    return data, starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, with A-Z lower-cased, and the bounds of each text's words."""
    data, starts = joined(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = span_hash(prefix_hash(data), begin, end)
    return words, np.append(np.searchsorted(begin, starts), len(begin))


SHINGLE = 5
_ORDER = mix(np.arange(1, SHINGLE + 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text, as hashes; a shorter text is one shingle, one without words has none."""
    words, bounds = word_hashes(texts)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k):
            grams += words[i : i + len(grams)] * _ORDER[i]
        grams = mix(grams)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                out.append(mix(np.array([(words[a:b] * _ORDER[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
