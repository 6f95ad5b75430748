"""N-gram Jaccard join: documents that share most of their word shingles, joined on the rare ends of their shingle sets.

Each document is the set of its distinct 5-word shingles. Sets are ordered rare first: shingles that a counting pass over
all documents found frequent come last, by their counts, and the others before them by hash. Any total order is lossless
for prefix filtering, so the counting may leave out low counts. Two sets with Jaccard 0.75 share a shingle among the
first n - ceil(0.75 n) + 1 of each; candidates are joined on those, with filters on length, on the position of the shared
shingle, and, in place of a suffix filter, on how much the whole sets differ at least: a sketch of a set has the parities of
its counts in hash cells, twice as many as it has shingles or more, and each shingle in only one of two sets changes one
parity. Only pairs that pass move their sets; each is verified once on the whole sets.

Documents with equal sets are one node throughout (a 64-bit digest of the set: two different sets among n get the same one
with probability n^2 / 2^65). See linkage.py for how large groups are linked without all of their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linkage import compare, linked
from .shared import arrow_rows, bounded, discard, lean, mix, pieces, row_key, shingle_sets, stash, without_rows

#: Similarity in percent: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Frequent shingles of which counts are kept, in a task and altogether.
TASK_COUNTS, ALL_COUNTS = 1 << 16, 100_000
#: Documents in a slot of a hot shingle, about.
SLOT = 4096
#: Longs of 64 parities that each sketch can be folded to.
PARITIES = 16


def _digest(shingles: np.ndarray) -> int:
    """A 63-bit digest of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles).sum() + np.uint64(len(shingles))], np.uint64))[0] >> np.uint64(1))


def sketch(shingles: np.ndarray) -> bytes:
    """The parities of the counts in 2^k hash cells, at least twice as many as shingles."""
    cells = 64 * PARITIES
    while cells < 2 * len(shingles):
        cells *= 2
    counts = np.bincount((mix(shingles) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(cells: bytes, size: int) -> np.ndarray:
    """A sketch as longs, with `size` bytes: cells of which the numbers agree in their low bits count together."""
    return np.bitwise_xor.reduce(np.frombuffer(cells, np.uint64).reshape(-1, size // 8), axis=0)


def _may_link(load: bytes):
    """A lossless test of other sketches, each after the eight bytes of its set's size, against this one."""
    n, own = int.from_bytes(load[:8], "big"), load[8:]

    def test(other: bytes) -> bool:
        m, its = int.from_bytes(other[:8], "big"), other[8:]
        size = min(len(own), len(its))
        apart = int(np.bitwise_count(folded(own, size) ^ folded(its, size)).sum())
        return apart <= n + m - 2 * -(-(n + m) * PERCENT // (100 + PERCENT))

    return test


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows of the task's frequent shingles, counted once for each distinct set."""
    seen: set[int] = set()
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []
    held = 0

    def settle() -> None:
        nonlocal keys, counts, waiting, held
        u, c = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (keys[:0], counts[:0])
        both, back = np.unique(np.concatenate([keys, u[c > 1]]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, back, np.concatenate([counts, c[c > 1]]))
        if len(both) > TASK_COUNTS:
            top = np.argpartition(total, -TASK_COUNTS)[-TASK_COUNTS:]
            both, total = both[top], total[top]
        keys, counts, waiting, held = both, total, [], 0

    def batch(rows: dict) -> pa.RecordBatch:
        n = len(next(iter(rows.values())))
        return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in _SIZES], schema=_SIZES)

    for rows, texts in pieces(batches):
        sets = shingle_sets(texts)
        nodes = [_digest(s) if len(s) else None for s in sets]
        yield batch({"doc_id": rows.column(0), "row": rows.column(2), "node": nodes, "n": [len(s) for s in sets], "sketch": [sketch(s) for s in sets]})
        for node, s in zip(nodes, sets, strict=True):
            if node is not None and node not in seen:
                seen.add(node)
                waiting.append(s)
                held += len(s)
        if held > 1_000_000:
            settle()
    settle()
    often = counts > 2
    if often.any():
        yield batch({"shingle": keys[often].view(np.int64), "count": counts[often]})


_SIZES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("shingle", pa.int64()), ("count", pa.int64())])
_SIZES_SQL = ", ".join(f"`{f.name}` {'binary' if f.name == 'sketch' else 'bigint'}" for f in _SIZES)


def _prefixes(keys: np.ndarray, counts: np.ndarray):
    """A task that gives the prefix shingles of each distinct set, rare first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names = ["key", "slot", "node", "info"]
        for _, texts in pieces(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for s in shingle_sets(texts):
                n = len(s)
                if not n or (node := _digest(s)) in seen:
                    continue
                seen.add(node)
                p = n - (PERCENT * n + 99) // 100 + 1
                often = np.zeros(n, np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    often = np.where(keys[at] == s, counts[at], 0)
                    order = np.argsort(often, kind="stable")[:p]
                    s, often = s[order], often[order]
                first = s[:p]
                salts = (often[:p] // SLOT).astype(np.uint64) + np.uint64(1)
                salt = mix(np.array([node], np.uint64))[0] % salts
                with np.errstate(over="ignore"):
                    # no slot of a hot key has the key's own value: that means that the key has one slot
                    slot = np.where(salts == 1, first, mix(first + (salt + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
                for k, x in enumerate((first.view(np.int64), slot.view(np.int64), np.full(p, node, np.int64), np.arange(p, dtype=np.int64) | n << 32)):
                    out[k].append(x)
            if out[0]:
                key, *rest = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(key, mask=key == rest[0]), *map(pa.array, rest)], names=names)

    return task


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in pieces(batches):
        sets = [s for s in shingle_sets(texts) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "load"])


def _linked_to(members: bytes):
    """A test of other sets against this one."""
    own = np.frombuffer(members, np.uint64)

    def test(other: bytes) -> bool:
        its = np.frombuffer(other, np.uint64)
        at = np.minimum(np.searchsorted(own, its), len(own) - 1)
        both = int((own[at] == its).sum())
        return 100 * both >= PERCENT * (len(own) + len(its) - both)

    return test


def _needed(n: Column, m: Column) -> Column:
    """The least intersection of linked sets of these sizes."""
    return F.ceil((n + m) * F.lit(PERCENT) / F.lit(100 + PERCENT) - F.lit(1e-9))


def _admits(a: Column, b: Column) -> Column:
    """Length and positional filter."""
    n, m = F.shiftright(a, 32), F.shiftright(b, 32)
    i, j = a.bitwiseAND(F.lit(0xFFFFFFFF)), b.bitwiseAND(F.lit(0xFFFFFFFF))
    return (F.lit(100) * F.least(n, m) >= F.lit(PERCENT) * F.greatest(n, m)) & (F.least(n - i, m - j) >= _needed(n, m))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same in numpy."""
    n, m, low = a >> 32, b >> 32, np.int64(0xFFFFFFFF)
    need = -(-(n + m) * PERCENT // (100 + PERCENT))
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (np.minimum(n - (a & low), m - (b & low)) >= need)


def _close(group: pa.Table) -> pa.Table:
    """Pairs of one cell of a large group, of different components, that pass all filters."""
    side, node, info, comp = (group.column(c).to_numpy() for c in ("side", "node", "info", "comp"))
    cells = np.stack([folded(x, 8 * PARITIES) for x in group.column("sketch").to_pylist()])
    n, at = info >> 32, info & 0xFFFFFFFF
    left = np.flatnonzero(side == 0)
    split = (side == 1).any()
    right = np.flatnonzero(side == 1) if split else left
    found = [np.zeros((2, 0), np.int64)]
    for k in range(0, len(left), 64):
        x, y = left[k : k + 64, None], right[None, :]
        least, both = np.minimum(n[x], n[y]), n[x] + n[y]
        need = -(-both * PERCENT // (100 + PERCENT))
        ok = (comp[x] != comp[y]) & (100 * least >= PERCENT * (both - least)) & (np.minimum(n[x] - at[x], n[y] - at[y]) >= need)
        i, j = np.nonzero(ok if split else ok & (node[x] < node[y]))
        i, j = left[k + i], right[j]
        for m in range(0, len(i), 1 << 15):
            p, q = i[m : m + (1 << 15)], j[m : m + (1 << 15)]
            apart = np.bitwise_count(cells[p] ^ cells[q]).sum(axis=1, dtype=np.int64)
            near = apart <= n[p] + n[q] - 2 * (-(-(n[p] + n[q]) * PERCENT // (100 + PERCENT)))
            p, q = node[p[near]], node[q[near]]
            found.append(np.stack([np.minimum(p, q), np.maximum(p, q)]))
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id[, row, stays]): one row per input row.

    A null or empty text, or one without words, has no shingles and is linked with nothing. With fewer than five words the
    whole sequence is the one shingle. Repeated rows and ties are rows of the same set. component_id is the smallest
    doc_id of the component; a row with a null doc_id links like any other, but a component of such rows only has null. Other
    columns, whatever their names, are not read. An empty table gives an empty result. rows: with a digest of id and text,
    and whether the row is the one that stays of its component: the one with the smallest id and then digest.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.select("doc_id", "text", row_key("doc_id", "text").alias("row"))
    sizes = stash(docs.mapInArrow(lean(_sizes), _SIZES_SQL))
    known = sizes.where("shingle is null").select("doc_id", "row", "node", "n")
    # bounded: at most ALL_COUNTS pairs of numbers
    often = sizes.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "shingle").limit(ALL_COUNTS).toPandas()
    keys, counts = often["shingle"].to_numpy(np.int64).view(np.uint64), often["count"].to_numpy(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]

    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = stash(sizes.where("node is not null").groupBy("node").agg(F.min(place).alias("place"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("node", "place.doc_id", "place.row", "n", "sketch"))

    def content(wanted: DataFrame) -> DataFrame:
        """The sets of some nodes, from the row that stands for each."""
        found = stash(nodes.select("node", "row").join(bounded(wanted), "node", "left_semi"))
        texts = docs.join(bounded(found.select("row")), "row", "left_semi").dropDuplicates(["row"]).select("doc_id", "text")
        return texts.mapInArrow(lean(_sets), "node bigint, load binary")

    def sketches(wanted: DataFrame) -> DataFrame:
        size = F.unhex(F.lpad(F.hex("n"), 16, "0"))
        return nodes.join(bounded(wanted), "node", "left_semi").select("node", F.concat(size, "sketch").alias("load"))

    def verify(pairs: DataFrame) -> DataFrame:
        close = compare(pairs, sketches, _may_link)
        links = compare(close, content, _linked_to)
        discard(close)
        return links

    def inside(members: DataFrame) -> DataFrame:
        members = members.join(nodes.select("node", "sketch"), "node").select("key", "cell", "side", "node", "info", "comp", "sketch")
        return verify(stash(members.groupBy("key", "cell").applyInArrow(_close, "a bigint, b bigint").distinct()))

    entries = docs.mapInArrow(lean(_prefixes(keys, counts)), "key bigint, slot bigint, node bigint, info bigint")
    comp = linked(entries, _admits, _near, verify, inside=inside)
    own = nodes.select("node", "doc_id", "row").join(bounded(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = stash(own.where("comp is not null").groupBy("comp").agg(F.min(place).alias("first"), F.count("*").alias("size")).where("size > 1").select("comp", "first"))
    own = own.join(bounded(first), "comp", "left").select("node", F.coalesce("first", place).alias("first"))
    out = known.join(own, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), "row", (F.col("node").isNull() | (F.col("row") == F.col("first.row"))).alias("stays"))
    return out if rows else out.select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` of which jaccard_components() says that they stay: of each component that with the smallest doc_id.

    Null ids come last, so a row without an id stays only where its component has no row with one. Rows equal in id and text
    stay together. Texts without words stay. All columns stay as they are. An empty table gives an empty result.
    """
    gone = stash(jaccard_components(docs, doc_id, text, rows=True).where("not stays").select("row").distinct())
    return without_rows(docs, gone, doc_id, text)


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
