"""Packing of documents into sequences: best fit first, then a swap-based local search that empties bins.

Token ids become pieces of at most `capacity`; full pieces are sequences of their own. The others are dealt by hash into
blocks of some thousand pieces that are packed side by side. A block places its pieces by best fit, longest first, and then
exchanges pieces between underfull bins - a move, one for one, two for one or one for two - always such that the sum
of the squared fills grows, so that full bins get fuller and the emptiest run empty. What a block can't fill, its emptiest
bins, goes with those of other blocks into the next round; an eighth or so is left from round to round, down to one block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, lean, stash, table

#: Pieces of a block: the working set of a task. A row takes some 56 bytes.
BLOCK = 8192
#: The share of a block's pieces, in its emptiest bins, that goes to the next round.
CARRIED = 8
#: Sweeps of exchanges over all bins of a block at most; in practice two or three find nothing more.
SWEEPS = 8
#: Chunks and words whose ids a task keeps; beyond, the table is begun anew. It changes no result.
TABLE_ENTRIES = 400_000
TABLE_CHARS = 48
#: Characters of a text that are split at once.
SLICE_CHARS = 1 << 20

PIECES = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
COLUMNS = [x.split()[0] for x in PIECES.split(", ")]

# -- token ids -------------------------------------------------------------------------------------------------------

_SIGNS = re.escape('!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')
#: A word of composed Latin letters between signs: letters and signs are separate words to the tokenizer, which composes and lower-cases such letters one by one. Apostrophes, and the dotted capital I, have rules of their own.
_PLAIN = re.compile(f"([{_SIGNS}]*)([A-Za-zÀ-ÖØ-öø-ÿĀ-įı-ňŊ-ž]+)([{_SIGNS}]*)")
#: What Python takes for blanks, but the tokenizer doesn't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_ASCII_BLANKS = re.compile("[ \t\n\r\x0b\x0c]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)}


class WordIds(dict):
    """Chunk without blanks -> its ids as little-endian bytes, segmented once while it's kept."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        self.words: dict[str, bytes] = {}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        # the shortcut for plain words holds for a byte-level vocabulary that lower-cases and drops blanks; it's compared once
        probe = ["plain", "Größe", "ÉCOLE", "šedý,", "(word).", "Ōsaka"]
        self.plain = True
        self.plain = all(self[w] == self._library(w) for w in probe)
        self.clear()

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            got = np.array([t.id for t in self.whole.model.tokenize(shown)], "<u4").tobytes()
            if len(self.words) >= TABLE_ENTRIES:
                self.words.clear()
            if len(word) <= TABLE_CHARS:
                self.words[word] = got
        return got

    def __missing__(self, chunk: str) -> bytes:
        parts = _PLAIN.fullmatch(chunk) if self.plain else None
        if parts:
            before, word, after = parts.groups()
            got = (self[before] if before else b"") + self._word(word.lower()) + (self[after] if after else b"")
        else:
            got = self._library(chunk)
        if len(self) >= TABLE_ENTRIES:
            self.clear()
        if len(chunk) <= TABLE_CHARS:
            self[chunk] = got
        return got

    def of(self, text: str) -> bytes:
        """The ids of a whole text. The tokenizer drops blanks and no token crosses one, so chunks are segmented alone."""
        if any(x in text for x in self.special):  # what is between such strings has rules of its own
            return self._library(text)
        return b"".join(b"".join(map(self.__getitem__, _chunks(part))) for part in _slices(text))


@lru_cache(maxsize=1)
def word_ids(file: str) -> WordIds:
    """One table per Python worker, which serves several tasks."""
    return WordIds(file)


def _chunks(text: str) -> list[str]:
    if any(c in text for c in _SEPARATORS):
        return [x for x in _ASCII_BLANKS.split(text) if x]
    return text.split()


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE_CHARS:
        blank = _ASCII_BLANKS.search(text, at + SLICE_CHARS)
        if not blank:
            break
        yield text[at : blank.start()]
        at = blank.end()
    yield text[at:] if at else text


def _cutter(file: str, shipped: str, capacity: int, end_id: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(SparkFiles.get(shipped) if shipped else file)
        uid, end = TaskContext.get().partitionId() << 33, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids.of(text or "") + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((uid, doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    uid += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)], names=COLUMNS)

    return task


_SHIPPED: dict[str, set[str]] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text", ship: bool = True) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): the ids of each text and `end_id` after them, cut after every `capacity` ids.

    tokenizer: path on the driver of a file of the tokenizers library whose vocabulary drops blanks; ship: send it to the
    executors (else the path must exist there). A null text counts as empty and is one piece, the end id. Every row is
    a document, also one that repeats another or has a null id. Texts of any length are whole. uid names a piece.
    """
    spark, name = docs.sparkSession, ""
    arrow_rows(spark)
    if ship:
        name = tokenizer.rpartition("/")[2]
        sent = _SHIPPED.setdefault(spark.sparkContext.applicationId, set())
        if tokenizer not in sent:
            spark.sparkContext.addFile(tokenizer)
            sent.add(tokenizer)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(_cutter(tokenizer, name, capacity, end_id)), PIECES)


# -- bins ------------------------------------------------------------------------------------------------------------


class Bin:
    """Pieces by length. `single` has a bit for every length in the bin, pairs() one for every sum of two of its pieces."""

    __slots__ = ("_pairs", "fill", "items", "single")

    def __init__(self) -> None:
        self.items: dict[int, list[int]] = {}
        self.fill = self.single = 0
        self._pairs: int | None = None

    def add(self, length: int, item: int) -> None:
        self.items.setdefault(length, []).append(item)
        self.fill += length
        self.single |= 1 << length
        self._pairs = None

    def take(self, length: int) -> int:
        there = self.items[length]
        item = there.pop()
        if not there:
            del self.items[length]
            self.single ^= 1 << length
        self.fill -= length
        self._pairs = None
        return item

    def pairs(self) -> int:
        if self._pairs is None:
            got = 0
            for x, there in self.items.items():
                got |= (self.single >> x + 1) << 2 * x + 1  # partners longer than x
                if len(there) > 1:
                    got |= 1 << 2 * x
            self._pairs = got
        return self._pairs

    def pair(self, total: int) -> tuple[int, int] | None:
        for x, there in self.items.items():
            y = total - x
            if y in self.items and (y != x or len(there) > 1):
                return x, y
        return None

    def held(self) -> list[int]:
        return [item for x in sorted(self.items, reverse=True) for item in self.items[x]]


def best_fit(lengths: list[int], capacity: int) -> list[Bin]:
    """Longest first, each into the fullest bin that it fits in. Bins are found by their free space, one bit each."""
    spaces: list[list[Bin]] = [[] for _ in range(capacity + 1)]
    bins, free = [], 0
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        x = lengths[item]
        room = free >> x
        if room:
            space = x + (room & -room).bit_length() - 1
            b = spaces[space].pop()
            if not spaces[space]:
                free ^= 1 << space
        else:
            space, b = capacity, Bin()
            bins.append(b)
        b.add(x, item)
        if space > x:
            spaces[space - x].append(b)
            free |= 1 << space - x
    return bins


def _exchange(b: Bin, singles: int, pairs: int, gap: int) -> tuple[int, tuple[int, ...], int, int]:
    """The exchange that fills most of the gap of `b`: (gain, what leaves b, length that comes, pieces that it's made of)."""
    mask, best = (1 << gap + 1) - 2, (0, (), 0, 0)

    def offer(leaves: tuple[int, ...], comes: int, of: int) -> bool:
        nonlocal best
        out = sum(leaves)
        gain = ((comes >> out) & mask).bit_length() - 1
        if gain > best[0]:
            best = gain, leaves, out + gain, of
        return best[0] == gap

    if offer((), singles, 1) or offer((), pairs, 2):
        return best
    for x in b.items:
        if offer((x,), singles, 1) or offer((x,), pairs, 2):
            return best
    lengths = sorted(b.items)
    for i, x in enumerate(lengths):
        for y in lengths[i if len(b.items[x]) > 1 else i + 1 :]:
            if offer((x, y), singles, 1):
                return best
    return best


def local_search(bins: list[Bin], capacity: int, fewest: int, sweeps: int = SWEEPS) -> list[Bin]:
    """Exchanges between underfull bins while the sum of squared fills grows, until `fewest` bins are left or no exchange helps.

    A bin takes from those that are not fuller, so each exchange makes the fuller bin fuller; bins that run empty go.
    """
    for _ in range(sweeps):
        if len(bins) <= fewest:
            break
        changed = False
        todo = sorted((b for b in bins if b.fill < capacity), key=lambda b: b.fill)

        def unions() -> list[tuple[int, int]]:
            singles = pairs = 0
            out = [(0, 0)]
            for b in todo:
                singles |= b.single
                pairs |= b.pairs()
                out.append((singles, pairs))
            return out

        known = unions()
        for i in range(len(todo) - 1, 0, -1):
            b, renewed = todo[i], False
            while b.fill < capacity:
                gain, leaves, comes, of = _exchange(b, *known[i], capacity - b.fill)
                if not gain:
                    break
                donor = next((a for a in todo[:i] if a.fill <= b.fill and ((a.single if of == 1 else a.pairs()) >> comes) & 1), None)
                if donor is None:  # what is known of the donors is out of date
                    if renewed:
                        break
                    known, renewed = unions(), True
                    continue
                for x in (comes,) if of == 1 else donor.pair(comes):
                    b.add(x, donor.take(x))
                for x in leaves:
                    donor.add(x, b.take(x))
                changed = True
        bins = [b for b in bins if b.fill]
        if not changed:
            break
    return bins


def pack(lengths: list[int], capacity: int) -> list[Bin]:
    """Bins of pieces, each of 1 to `capacity`, by best fit and local search."""
    fewest = max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths))
    bins = best_fit(lengths, capacity)
    return local_search(bins, capacity, fewest) if len(bins) > fewest else bins


def _pack_block(capacity: int, last: bool) -> Callable:
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("uid")
        lengths, uids = block.column("length").to_pylist(), block.column("uid").to_numpy()
        bins = pack(lengths, capacity)
        n = len(lengths)
        sequence, offset, carried = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        goes, room = set(), n // CARRIED
        if not last:
            for k in sorted((k for k, b in enumerate(bins) if b.fill < capacity), key=lambda k: bins[k].fill):
                size = sum(map(len, bins[k].items.values()))
                if goes and size > room:
                    break
                goes.add(k)
                room -= size
        for k, b in enumerate(bins):
            at, held = 0, b.held()
            name = uids[held].min()
            for item in held:
                sequence[item], offset[item], carried[item] = name, at, k in goes
                at += lengths[item]
        return pa.table({**{c: block.column(c) for c in COLUMNS}, "sequence_id": sequence, "offset": offset, "carried": carried})

    return run


def pack_pieces(pieces: DataFrame, capacity: int, block: int = BLOCK) -> DataFrame:
    """The rows of token_pieces() with sequence_id (the smallest uid in the sequence) and offset (its place there, without gaps).

    pieces: read more than once, so best a table. No sequence is longer than `capacity`. Pieces are dealt by a hash of
    their uid, so that no group grows with a document or its copies. Without pieces the result is empty. block: pieces of
    a block; at least two bins' worth, so that what is carried from round to round shrinks.
    """
    block = max(block, 2 * capacity)
    full = pieces.where(F.col("length") == capacity).select(*COLUMNS, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, todo = [full], pieces.where(F.col("length") < capacity)
    left = todo.count()
    while True:
        blocks = max(1, -(-left // block))
        dealt = todo.select(*COLUMNS, F.pmod(F.xxhash64("uid", F.lit(blocks)), F.lit(blocks)).alias("block"))
        out = stash(dealt.groupBy("block").applyInArrow(_pack_block(capacity, blocks == 1), PIECES + ", sequence_id bigint, offset bigint, carried boolean"))
        done.append(out.where("not carried").drop("carried"))
        todo = out.where("carried").select(*COLUMNS)
        left = todo.count()
        if not left:
            break
    result = done[0]
    for x in done[1:]:
        result = result.unionByName(x)
    return result


def fill_report(packed: DataFrame, capacity: int) -> Counter:
    """Sequences, tokens and the least number of sequences that could hold them."""
    got = packed.agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    return Counter(sequences=got[0], tokens=got[1] or 0, least=-(-(got[1] or 0) // capacity))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = stash(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1))
    return pack_pieces(pieces, 4096).drop("uid")
