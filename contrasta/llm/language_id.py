"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of 1- to 3-grams of the lower-cased characters are gathered from every training text by language and hash bucket; the
matrix of log probabilities (languages x BUCKETS, bounded) goes to all tasks, which score texts in numpy: a gather of rows
and a sum per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, held_out, lean

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Additive smoothing of the counts.
SMOOTHING = 0.5
PIECE_CHARS = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The buckets of the n-grams at each position (the last positions reach over the end and are cut by the caller)."""
    with np.errstate(over="ignore"):
        h = codes[: len(codes) - order + 1] * np.uint32(0x9E3779B1) + np.uint32(order)
        for k in range(1, order):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[k : len(codes) - order + 1 + k] * np.uint32(0xC2B2AE3D)
        return ((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(17)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each lower-cased and between spaces, and the bounds."""
    texts = [f" {x.lower()} " for x in texts]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def _chunks(columns: list[list], texts: int) -> Iterator[list[list]]:
    at = size = 0
    for k, x in enumerate(columns[texts]):
        size += len(x or "")
        if size > PIECE_CHARS:
            yield [c[at : k + 1] for c in columns]
            at, size = k + 1, 0
    if at < len(columns[texts]):
        yield [c[at:] for c in columns]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for langs, texts in _chunks([c.to_pylist() for c in batch.columns], 1):
            for lang in set(langs):
                mine = [x or "" for x, y in zip(texts, langs, strict=True) if y == lang]
                codes, bounds = _codes(mine)
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                docs[lang] = docs.get(lang, 0) + len(mine)
                for order in ORDERS:
                    if len(codes) >= order:
                        within = np.ones(len(codes) - order + 1, bool)
                        for back in range(1, order):  # n-grams that reach into the next text
                            within[bounds[1:-1] - back] = False
                        own += np.bincount(_grams(codes, order)[within], minlength=BUCKETS)
    for lang, own in total.items():
        bucket = np.append(np.flatnonzero(own), -1)
        counts = np.append(own[own > 0], docs[lang])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket)), pa.array(bucket.astype(np.int32)), pa.array(counts)], names=["lang", "bucket", "count"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, BUCKETS x languages log probabilities) from every row with a language.

    Languages x BUCKETS counts come to the driver: bounded by the number of languages, whatever the input.
    """
    arrow_rows(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(lean(_counts), "lang string, bucket int, count bigint").groupBy("lang", "bucket").agg(F.sum("count").alias("count")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS, len(langs)))
    prior = np.zeros(len(langs))
    for k, name in enumerate(langs):
        own = counts[counts["lang"] == name]
        prior[k] = own.loc[own["bucket"] < 0, "count"].sum()
        own = own[own["bucket"] >= 0]
        table[own["bucket"].to_numpy(), k] = own["count"].to_numpy()
    logs = np.log((table + SMOOTHING) / (table.sum(0) + SMOOTHING * BUCKETS))
    return langs, np.log(prior / max(prior.sum(), 1)) if langs else prior, logs.astype(np.float32)


def _scored(langs: list[str], prior: np.ndarray, logs: np.ndarray):
    def some(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        has = [bool(x and _LETTER.search(x)) for x in texts]
        codes, bounds = _codes([x or "" for x in texts])
        total = np.tile(prior, (len(texts), 1))
        for order in ORDERS:
            rows = logs[_grams(codes, order)]
            if order > 1:
                rows = np.concatenate([rows, np.zeros((order - 1, rows.shape[1]), np.float32)])
                for back in range(1, order):  # n-grams that reach into the next text
                    rows[bounds[1:] - back] = 0
            for k in range(len(langs)):
                total[:, k] += np.add.reduceat(rows[:, k], bounds[:-1], dtype=np.float64)
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [langs[k] if h else "und" for k, h in zip(best, has, strict=True)], np.where(has, share, 0.0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for (texts,) in _chunks([batch.column(1).to_pylist()], 0):
                if langs:
                    a, b = some(texts)
                else:
                    a, b = ["und"] * len(texts), np.zeros(len(texts))
                names += a
                scores.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "lang_pred", "score"])

    return task


def predict(docs: DataFrame, model: tuple, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row per input row.

    lang_pred is `und`, with score 0, for a null text or one without a letter, and for all texts if no language was
    learned; else the likeliest language (the first by name where two tie) and its posterior probability. Whole texts are
    read, of any length. Repeated rows and null ids each give a row; other columns are not read.
    """
    arrow_rows(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(_scored(*model)), "doc_id bigint, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
