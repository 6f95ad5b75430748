"""SentencePiece encoding and decoding over a table of distinct chunks.

In the given vocabulary no piece crosses a whitespace marker, so the text falls into chunks - a run of markers and the word
after it - that are segmented alone. Each task segments each distinct chunk once with the library, keeps its ids and its
decoded text in a bounded table, and joins them back by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, lean

MARK = "▁"
#: Distinct chunks that a task keeps; when there are more, the table is built anew. It changes no result.
TABLE_ENTRIES = 150_000
#: Longer chunks are segmented each time.
TABLE_CHARS = 64
#: Characters of text that are worked on at once.
PIECE_CHARS = 1 << 20


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without its first marker, with spaces for further markers.

    The library puts a marker before the text and reads a literal marker as a space.
    """
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, markers = [], 0
    for x in parts:
        markers += 1
        if x:
            out.append(" " * (markers - 1) + x)
            markers = 0
    if markers:
        out.append(" " * (markers - 1))
    return out


class ChunkTable:
    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        if any(MARK in self.library.id_to_piece(i).lstrip(MARK) for i in range(self.library.get_piece_size())):
            raise ValueError("pieces of this vocabulary cross whitespace markers; chunks can't be segmented alone")
        self.lone = np.array([self.library.piece_to_id(MARK)], np.int32).tobytes()
        self.end = np.array([self.library.eos_id()], np.int32).tobytes()
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks - self.ids.keys())
        if len(new) + len(self.ids) > TABLE_ENTRIES:
            self.ids.clear()
            self.decoded.clear()
            new = list(chunks)
        ids = self.library.encode(new, num_threads=1)
        for chunk, x, text in zip(new, ids, self.library.decode(ids, num_threads=1) if ids else [], strict=True):
            self.ids[chunk] = np.array(x, np.int32).tobytes() if chunk else self.lone
            self.decoded[chunk] = chunk if text == chunk else text

    def forget_long(self, chunks: set[str]) -> None:
        for chunk in chunks:
            if len(chunk) > TABLE_CHARS:
                del self.ids[chunk], self.decoded[chunk]


def _codec(model: str, model_file: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(SparkFiles.get(model_file) if model_file else model, "rb") as file:
            table = ChunkTable(file.read())

        def done(doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            parts = [chunks_of(x) for x in texts]
            distinct = set().union(*parts)
            table.learn(distinct)
            ids, decoded = table.ids.__getitem__, table.decoded.__getitem__
            rows = [b"".join(map(ids, p)) + table.end for p in parts]
            back = [" ".join(map(decoded, p)) for p in parts]
            table.forget_long(distinct)
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(rows), np.int32))
            return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            at = size = 0
            for k, x in enumerate(texts):
                if size and size + len(x) > PIECE_CHARS:
                    yield done(b.column(0).slice(at, k - at), texts[at:k])
                    at, size = k, 0
                size += len(x)
            if at < len(texts):
                yield done(b.column(0).slice(at), texts[at:])

    return task


def encode_decode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", ship: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded): the library's ids of each whole text with an end id only, and its decode(ids).

    A null or empty text gives the end id alone and decodes to the empty text. Repeated rows, null ids and ties each give
    a row; other columns are not read. An empty table gives an empty result. Texts of any length are whole; memory is
    bounded by the longest text. model: path of the vocabulary on the driver; ship: send the file to the executors
    (else the path must exist there).
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    name = ""
    if ship:
        name = model.rpartition("/")[2]
        if model not in _SHIPPED.setdefault(spark.sparkContext.applicationId, set()):
            spark.sparkContext.addFile(model)
            _SHIPPED[spark.sparkContext.applicationId].add(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(_codec(model, name)), "doc_id bigint, ids array<int>, decoded string")


_SHIPPED: dict[str, set[str]] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
