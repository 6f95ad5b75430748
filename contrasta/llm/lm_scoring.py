"""Cross-entropy difference: how much likelier a text is under a target model than under a background model.

Both models are interpolated bigram models over all words of the corpus, and one class for words it doesn't have. Target
counts come from the documents labelled as good, background counts from every document, scaled to the same number of tokens
(matched). The counts of words and bigrams grow with the corpus and stay distributed: texts are encoded once, in blocks of
numbered words; each block gives its distinct grams and their counts, as packed arrays, to the parts of the key space; a
part adds the counts of all blocks and sends each block those of its grams. A document's score is the mean over its tokens
of the background loss minus the target loss, in nats: higher means more like the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, bounded, lean, mix, pieces, stash, tidy, word_hashes

#: Tokens of a block; a longer text is a block of its own.
BLOCK = 1_000_000
#: Bytes of text whose grams share a part of the key space: at most a million or two of them, which a task holds.
PART_BYTES = 8 << 20
#: Shuffle partitions of the parts at most; a task then takes several parts, one after the other.
TASKS = 20_000
#: Bits of a key beyond those that number all bytes of text: two grams share a key with a probability of 2^-24.
SPARE_BITS = 24
#: What is before the first word of a text; as a hash it is no word's.
START = np.uint64(0x5851F42D4C957F2D)
#: Weight of the unigram model in the bigram model.
BACKOFF = 8.0
SMOOTHING = 0.5
_PACK = "zstd"


def _pack(x: np.ndarray) -> bytes:
    """Integers from 0 on: their number, then the bytes of all by significance, compressed."""
    planes = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    used = int(np.flatnonzero(planes.any(axis=1)).max(initial=-1)) + 1
    return np.int64([len(x), used]).tobytes() + (pa.compress(planes[:used].tobytes(), _PACK, asbytes=True) if used else b"")


def _unpack(data: bytes) -> np.ndarray:
    n, used = np.frombuffer(data, np.int64, 2).tolist()
    planes = np.zeros((8, n), np.uint8)
    if used:
        planes[:used] = np.frombuffer(pa.decompress(data[16:], n * used, _PACK, asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts: ids, marks and lengths of the texts, the block's words, and each token's number among them."""
    ids, good, words, lengths = [], [], [], []
    size = 0

    def block() -> pa.RecordBatch:
        known, number = np.unique(np.concatenate(words), return_inverse=True)
        lists = [pa.array([ids], pa.list_(pa.int64())), pa.array([good], pa.list_(pa.bool_())), pa.array([np.concatenate(lengths)], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*lists, pa.array([_pack_sorted(known)]), pa.array([_pack(number)])], names=["ids", "good", "lengths", "words", "tokens"])

    for rows, texts in pieces(batches):
        its, bounds = word_hashes(texts)
        ids += rows.column(0).to_pylist()
        good += rows.column(2).to_pylist()
        words.append(its)
        lengths.append(np.diff(bounds))
        size += len(its)
        if size >= BLOCK:
            yield block()
            ids, good, words, lengths, size = [], [], [], [], 0
    if ids:
        yield block()


def _blocks(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, text, good) as a written table of blocks."""
    arrow_rows(rows.sparkSession)
    blocks = rows.mapInArrow(lean(_encode), "ids array<bigint>, good array<boolean>, lengths array<bigint>, words binary, tokens binary")
    return stash(blocks.withColumn("block", F.monotonically_increasing_id()))


def _grams(words: bytes, tokens: bytes, lengths: np.ndarray, shift: int) -> tuple:
    """Sorted keys of a block's words (and START) and bigrams, and for each token the places of its word, the one before and its bigram."""
    drop = np.uint64(shift)
    with_start = np.append(_unpack_sorted(words), START)
    now = _unpack(tokens).astype(np.int64)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = len(with_start) - 1
    with np.errstate(over="ignore"):
        pairs = mix(mix(with_start)[before] + with_start[now]) >> drop
    single, place = np.unique(with_start >> drop, return_inverse=True)
    double, pair = np.unique(pairs, return_inverse=True)
    return single, double, place[now], place[before], pair


def _parts(keys: np.ndarray, shift: int, parts: int) -> np.ndarray:
    """Where in the sorted keys each part begins, and the end. Parts are ranges of the key space."""
    top = (keys << np.uint64(shift)) >> np.uint64(32)
    return np.searchsorted((top * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


_GRAMS = "part bigint, block bigint, keys binary, n binary, good binary"


def _given(shift: int, parts: int):
    """A task that gives each block's grams by part, with their counts. Parts of words are numbered from `parts` on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                single, double, now, before, pair = _grams(row["words"], row["tokens"], lengths, shift)
                marked = np.repeat(np.array(row["good"], bool), lengths)
                first = np.zeros(len(now), bool)
                first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True  # START is counted where it is before a word
                out: list[list] = [[], [], [], [], []]
                for base, keys, at in ((0, double, [pair]), (parts, single, [now, before[first]])):
                    n = sum(np.bincount(x, minlength=len(keys)) for x in at)
                    good = sum(np.bincount(x, m, minlength=len(keys)) for x, m in zip(at, (marked, marked[first]), strict=False))
                    ends = _parts(keys, shift, parts)
                    for p in np.flatnonzero(np.diff(ends)).tolist():
                        s = slice(ends[p], ends[p + 1])
                        for column, value in zip(out, (base + p, row["block"], _pack_sorted(keys[s]), _pack(n[s]), _pack(good[s])), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(x, pa.binary()) for x in out[2:])], names=["part", "block", "keys", "n", "good"])

    return lean(task)


def _answered(parts: int):
    """For one part: the sums of all counts, given to each block that asks in the order of its keys; a row without a block tells how many words there are."""

    def task(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        counted = [r for r in rows if r["counts"]]
        none = [np.zeros(0, np.uint64)]
        keys, back = np.unique(np.concatenate(none + [_unpack_sorted(r["keys"]) for r in counted]), return_inverse=True)
        sums = [np.append(np.bincount(back, np.concatenate(none + [_unpack(r[c]) for r in counted]), len(keys)), 0.0) for c in ("n", "good")]
        part = rows[0]["part"]
        out = [(part, None, len(keys), None, None)] if part >= parts else []
        for r in rows:
            if r["asks"]:
                own = _unpack_sorted(r["keys"])
                at = np.searchsorted(keys, own)
                if len(keys):
                    at[keys[np.minimum(at, len(keys) - 1)] != own] = len(keys)
                out.append((part, r["block"], 0, *(_pack(x[at]) for x in sums)))
        part, block, words, n, good = zip(*out, strict=True) if out else ((),) * 5
        return pa.table({"part": pa.array(part, pa.int64()), "block": pa.array(block, pa.int64()), "distinct": pa.array(words, pa.int64()), "n": pa.array(n, pa.binary()), "good": pa.array(good, pa.binary())})

    return task


def _scored(shift: int, parts: int, totals: tuple):
    """The losses of one block's texts, from its row and the answers of the parts."""
    n, good, distinct = totals
    matched = good / n if n and good else 1.0

    def task(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        row = rows[0]  # the block's own, as part -1
        lengths = np.array(row["lengths"], np.int64)
        _, _, now, before, pair = _grams(row["words"], row["tokens"], lengths, shift)
        none = [np.zeros(0, np.uint64)]
        losses = []
        for name, scale, total in (("good", 1.0, good), ("n", matched, n)):
            two = np.concatenate(none + [_unpack(r[name]) for r in rows[1:] if r["part"] < parts])[pair] * scale
            one = np.concatenate(none + [_unpack(r[name]) for r in rows[1:] if r["part"] >= parts]) * scale
            share = (one[now] + SMOOTHING) / (total * scale + SMOOTHING * (distinct + 1))
            loss = np.append(0.0, np.cumsum(-np.log((two + BACKOFF * share) / (np.maximum(one[before], two) + BACKOFF))))
            ends = np.cumsum(lengths)
            losses.append(np.where(lengths > 0, (loss[ends] - loss[ends - lengths]) / np.maximum(lengths, 1), 0.0))
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": lengths, "target_loss": losses[0], "background_loss": losses[1]})

    return task


def fit(docs: DataFrame, good: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict:
    """The two models. good: a table with the doc_id of the target's documents; all of `docs` are the background.

    The model is the encoded corpus; its counts are added where score() asks for them.
    """
    marks = bounded(stash(good.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().withColumn("good", F.lit(True))), 2_000_000)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = _blocks(rows.join(marks, "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good")))
    each = blocks.select(F.explode(F.arrays_zip("lengths", "good")).alias("x"))
    totals = each.agg(F.coalesce(F.sum("x.lengths"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("x.good"), F.col("x.lengths"))), F.lit(0))).first()
    return {"docs": docs, "columns": (doc_id, text), "blocks": blocks, "totals": tuple(totals), "shift": max(0, 64 - SPARE_BITS - int(size).bit_length()), "parts": 1 + size // PART_BYTES}


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score): one row per input row, losses per token.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A null or empty text, or one without words, has 0 throughout.
    Repeated rows and null ids each give a row; other columns are not read. Without any target document the target model
    is uniform. An empty table gives an empty result. Where `docs` is what the model was fitted on, it is not encoded again.
    """
    spark, shift, parts = docs.sparkSession, model["shift"], model["parts"]
    arrow_rows(spark, 8)  # rows are blocks
    grams = lambda blocks: blocks.select("block", "good", "lengths", "words", "tokens").mapInArrow(_given(shift, parts), _GRAMS)
    own = docs is model["docs"] and (doc_id, text) == model["columns"]
    if own:
        blocks = model["blocks"]
    else:
        blocks = _blocks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(False).alias("good")))
        arrow_rows(spark, 8)
    rows = grams(model["blocks"]).withColumns({"counts": F.lit(True), "asks": F.lit(own)})
    if not own:
        rows = rows.union(grams(blocks).withColumns({"counts": F.lit(False), "asks": F.lit(True)}))
    # one part has the grams of PART_BYTES of text, each from a block once, however frequent it is
    answers = stash(rows.repartition(min(2 * parts, TASKS), "part").groupBy("part").applyInArrow(_answered(parts), "part bigint, block bigint, distinct bigint, n binary, good binary"))
    distinct = answers.where("block is null").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    tidy(spark)
    start = 1 if model["totals"][0] else 0  # START is counted among the words and is none
    empty = F.lit(None).cast("binary")
    rows = blocks.select("block", F.lit(-1).cast("bigint").alias("part"), "ids", "lengths", "words", "tokens", empty.alias("n"), empty.alias("good"))
    lists = F.lit(None).cast("array<bigint>")
    rows = rows.union(answers.where("block is not null").select("block", "part", lists, lists, empty, empty, "n", "good"))
    out = rows.groupBy("block").applyInArrow(_scored(shift, parts, (*model["totals"], distinct - start)), "doc_id bigint, n_tokens bigint, target_loss double, background_loss double")
    return out.withColumn("score", F.col("background_loss") - F.col("target_loss"))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return score(docs, fit(docs, good))
