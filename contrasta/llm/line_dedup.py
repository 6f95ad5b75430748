"""Fuzzy line dedup by MinHash: one line stays of each component of similar lines.

A line is the set of its 5-character shingles (after trimming and lower-casing). Signatures of BANDS x ROWS minima are
banded; lines that share a band (at a similarity of 0.8 with probability 0.996 in one at least, at 0.85 with 0.9997) and of
whose minima enough have equal low bits (0.999) are candidates; candidates are verified by their exact Jaccard similarity and joined to components by distributed union-find. Large groups
are linked without rows of all of their pairs, see linkage.py; there shingles are known by 64-bit hashes. Equal lines are one node throughout.
A band key that many lines of a task have is salted, so no task gets all lines of a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linkage import SLOTTED, compare, linked
from .shared import PIECE_BYTES, arrow_rows, bounded, discard, lean, mix, mix_in_place, row_key, stash, tidy

SHINGLE = 5
BANDS, ROWS = 14, 5
#: Lines are linked at this Jaccard similarity of their shingle sets or more.
SIMILAR = 0.8
#: Of the first BITS minima of two lines so many must agree in their last bit: at a similarity of 0.8 56.7 do on average.
BITS, AGREE = 63, 49
#: Shingles in a matrix at once.
COLUMNS = 2048
#: A key that so many of the lines have which a task works on at once is dealt to SALTS slots.
HOT, SALTS = 12, 64
# A hash times an odd number is a permutation; the least of the products is one minimum.
_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """An array of lines x BANDS keys, and the last bits of the first BITS minima of each line in a long. A line of fewer than five characters has one shingle, itself. No line is empty."""
    pad = "\n" * SHINGLE
    codes = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    count = np.maximum(size - SHINGLE + 1, 1)
    first = np.cumsum(count) - count
    end = np.cumsum(size + SHINGLE)
    inside = np.ones(len(codes), bool)
    for k in range(2 * SHINGLE - 1):  # places between a line's last shingle and the next line
        at = end - size - SHINGLE + count + k
        inside[at[at < end]] = False
    with np.errstate(over="ignore"):
        # in place: the arrays are as long as the text, and new ones cost more than what is computed
        wide = codes.astype(np.uint64)
        places = len(wide) - SHINGLE + 1
        h = wide[:places].copy()
        for k in range(1, SHINGLE):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += wide[k : places + k]
        h = h[inside[:places]]
        h = (mix_in_place(h, wide[: len(h)]) >> np.uint64(32)).astype(np.uint32)
        least = np.empty((BANDS * ROWS, len(lines)), np.uint32)
        other = np.empty_like(h)
        for k in range(BANDS * ROWS):
            np.multiply(h, _A[k], out=other)
            np.minimum.reduceat(other, first, out=least[k])
        least = mix(least.astype(np.uint64))
        bits = np.zeros(len(lines), np.uint64)
        for k in range(BITS):
            bits = bits << np.uint64(1) | least[k] & np.uint64(1)
        least = least.reshape(BANDS, ROWS, len(lines))
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], (BANDS, len(lines)))
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0xD1342543DE82EF95) + least[:, r])
    return np.ascontiguousarray(keys.T).view(np.int64), bits.view(np.int64)


def _agree(a: Column, b: Column) -> Column:
    """A filter of candidates: enough minima with equal low bits."""
    return F.bit_count(a.bitwiseXOR(b)) <= BITS - AGREE


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same in numpy."""
    return np.bitwise_count(a ^ b) <= BITS - AGREE


def slots(keys: np.ndarray, nodes: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    """Rows (key, slot, node, info) of lines x BANDS keys; a hot key's rows are dealt out by node, and one of them is in the key's own slot too."""
    key, node, info = keys.ravel(), np.repeat(nodes, BANDS), np.repeat(bits, BANDS)
    ordered = np.sort(key)
    if not (ordered[HOT - 1 :] == ordered[: max(0, len(key) - HOT + 1)]).any():
        return [key, key, node, info]
    _, first, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    hot = count[back] >= HOT
    with np.errstate(over="ignore"):
        salted = mix(key.view(np.uint64) + (mix(node.view(np.uint64)) % np.uint64(SALTS) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    more = first[count >= HOT]
    rows = [key, np.where(hot, salted, key), node, info]
    return [np.append(x, y[more]) for x, y in zip(rows, (key, key, node, info | SLOTTED), strict=True)]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        nodes, lines, size = [], [], 0

        def done() -> pa.RecordBatch:
            keys, bits = band_keys(lines)
            key, *rest = slots(keys, np.array(nodes, np.int64), bits)
            return pa.RecordBatch.from_arrays([pa.array(key, mask=key == rest[0]), *map(pa.array, rest)], names=["key", "slot", "node", "info"])

        for node, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node in seen:
                continue
            if len(seen) >= 500_000:  # it only saves work: a line that is given twice is one node
                seen.clear()
            seen.add(node)
            nodes.append(node)
            lines.append(line)
            size += len(line)
            if size > PIECE_BYTES:
                yield done()
                nodes, lines, size = [], [], 0
        if lines:
            yield done()


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(x: str, y: str) -> float:
    a, b = shingles(x), shingles(y)
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _linked_to(line: str):
    """A test of other lines against this one."""
    own = shingles(line)

    def test(other: str) -> bool:
        if min(len(line), len(other)) + SHINGLE < SIMILAR * len(own):  # a set has no more shingles than its line has places
            return False
        its = shingles(other)
        both = len(own & its)
        return both / (len(own) + len(its) - both) >= SIMILAR

    return test


def _inside(group: pa.Table) -> pa.Table:
    """Links between different components of one cell: intersections of all shingle sets by products of 0/1 matrices."""
    side, node, comp = (group.column(c).to_numpy() for c in ("side", "node", "comp"))
    sets = [np.unique(_shingle_hashes(x)) for x in group.column("line").to_pylist()]
    size = np.array([len(s) for s in sets], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = times > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    both = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[row[a:b], column[a:b] - at] = 1
        both += x[left] @ x[right].T
    union = size[left][:, None] + size[right][None, :] - both
    i, j = np.nonzero((both >= SIMILAR * union) & (comp[left][:, None] != comp[right][None, :]))
    i, j = left[i], right[j]
    low, high = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
    # one link of two components does
    first = np.unique(np.column_stack([low, high]), axis=0, return_index=True)[1] if len(i) else i
    return pa.table({"a": node[i[first]], "b": node[j[first]]})


def _shingle_hashes(line: str) -> np.ndarray:
    codes = np.frombuffer((line if len(line) >= SHINGLE else line.ljust(SHINGLE, "\n")).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = codes[: len(codes) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - SHINGLE + 1 + k]
        return mix(h)


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, line_no, line, node): the lines of each text, trimmed and lower-cased; node is null for a blank line. row is known by id and text."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = docs.select("doc_id", row_key("doc_id", "text").alias("row"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "row", "line_no", F.lower(F.trim("line")).alias("line"))
    return lines.withColumn("node", F.when(F.col("line") != "", F.xxhash64("line")))


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, line_no, first_doc_id, first_line_no): the lines that go, and the line of the same component that stays.

    The line with the smallest (doc_id, row, line_no) of a component stays; row is a digest of id and text, so rows with
    a null id, which come first, are told apart by their texts. Rows equal in id and text are one document: the same lines go
    from each. Blank lines, null and empty texts have nothing to drop. Lines of any length are whole. Other columns are not
    read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    lines = lines_of(docs, doc_id, text).where("node is not null")

    def content(nodes: DataFrame) -> DataFrame:
        return lines.join(bounded(nodes), "node", "left_semi").select("node", F.col("line").alias("load")).dropDuplicates(["node"])

    def verify(pairs: DataFrame) -> DataFrame:
        return compare(pairs, kept, _linked_to)

    known = None

    def kept(nodes: DataFrame) -> DataFrame:
        return known.join(bounded(nodes), "node", "left_semi")

    def prepare(nodes: DataFrame) -> None:
        nonlocal known
        known = stash(content(stash(nodes)))
        tidy(spark)

    def inside(rows: DataFrame) -> DataFrame:
        rows = rows.join(known, "node").select("key", "cell", "side", "node", "comp", F.col("load").alias("line"))
        return stash(rows.groupBy("key", "cell").applyInArrow(_inside, "a bigint, b bigint"))

    entries = lines.select("node", "line").mapInArrow(lean(_entries), "key bigint, slot bigint, node bigint, info bigint")
    comp = linked(entries, _agree, near, verify, prepare, inside)
    discard(known)
    lines = stash(lines.select("doc_id", "row", "line_no", "node"))
    place = F.struct("doc_id", "row", "line_no")
    each = lines.groupBy("node").agg(F.min(place).alias("first"), F.max(place).alias("last")).join(bounded(comp), "node", "left").where(~F.col("first").eqNullSafe(F.col("last")) | F.col("comp").isNotNull())
    each = stash(each.select("node", F.coalesce("comp", "node").alias("comp"), "first"))
    stays = each.groupBy("comp").agg(F.min("first").alias("stays"))
    stays = stash(each.join(bounded(stash(stays)), "comp").select("node", "stays"))
    gone = lines.join(bounded(stays), "node").where(~place.eqNullSafe(F.col("stays")))
    return gone.select("doc_id", "row", "line_no", F.col("stays.doc_id").alias("first_doc_id"), F.col("stays.line_no").alias("first_line_no"))


def _per_row(gone: DataFrame) -> DataFrame:
    """(row, dropped): the numbers of the lines that go, in order."""
    return gone.groupBy("row").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the lines that dropped_lines() names; documents stay, if with an empty text, as null texts do.

    All columns stay as they are, whatever their names. An empty table gives an empty result.
    """
    gone = stash(_per_row(dropped_lines(docs, doc_id, text)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"))
    own = F.struct(F.col(f"rec.`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"rec.`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("own", own).select("rec", F.xxhash64("own.doc_id", "own.text").alias("row")).join(gone, "row", "left")
    parts = F.split(F.col(f"rec.`{text}`"), "\n")
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped")))
    new = F.when(F.col("dropped").isNull(), F.col(f"rec.`{text}`")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    return rows.select(*[new.alias(c) if c == text else F.col(f"rec.`{c}`").alias(c) for c in docs.columns])


def _n_lines(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: its lines, and the numbers of those that go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gone = _per_row(dropped_lines(docs))
    sizes = docs.select("doc_id", row_key("doc_id", "text").alias("row"), _n_lines(F.col("text")).alias("n_lines"))
    out = sizes.join(gone, "row", "left").select("doc_id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped_lines"))
    return out.withColumn("n_kept", F.col("n_lines") - F.size("dropped_lines"))
