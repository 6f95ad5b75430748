"""Quality classifier by co-training: one classifier sees a text's content, the other the page's metadata.

Both are logistic regressions. Content is the shares of kinds of words, marks and lines, and hashed word counts; metadata is
language, source and length, which the content view doesn't see. Over some rounds each labels the unlabelled rows that it
is most confident of, in the proportion of the known labels, and these join the training rows of the other. All unlabelled
rows take part: a pass over the features counts each view's scores, from which the thresholds follow, and further passes sum
what a Newton step needs, so that no row leaves its task. Each view is then calibrated on labelled rows kept back from
training, a last regression weighs the calibrated views, and all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PIECE_BYTES, arrow_rows, held_out, lean, mix, row_key, stash, word_hashes
from .toxicity import logistic

#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
TRAINING_ROWS = 20_000
#: Rounds, the part of the unlabelled rows that a view labels in each, and Newton steps in each.
ROUNDS, CONFIDENT, STEPS = 3, 0.05, 3
#: By so much, in log odds, a view must be surer than the base rate is.
MARGIN = 1.0
#: The least curvature of a row, so that a label that a view holds for impossible doesn't throw it far.
CURVE = 0.02
#: Scores are counted in so many bins from -30 to 30.
BINS = 1200
SHAPE = ("mean_word", "distinct_words", "repeats", "upper", "digit", "symbol", "stop", "comma", "letters", "distinct_lines", "marked_ends", "exclaim")
WORDS, SLOTS = 96, 32
VIEWS = (len(SHAPE) + WORDS, 2 + SLOTS)
RIDGE = 1.0


def shape(text: str) -> list[float]:
    """Shares and means that describe a text, of any length; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(SHAPE)
    lines = [x for x in text.split("\n") if x]
    chars = len(text)
    return [
        chars / n / 10, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(map(str.isupper, words)) / n, sum(text.count(c) for c in "0123456789") / chars, sum(text.count(c) for c in "#$%&*|<>{}[]=_~^@+") / chars, text.count(".") / n, text.count(",") / n, sum(map(str.isalpha, words)) / n,
        len(set(lines)) / max(1, len(lines)), sum(w[-1] in "#$%&*!|" for w in words) / n, text.count("!") / n,
    ]


def hashed_words(texts: list[str]) -> np.ndarray:
    """Of each text the roots of its words' shares in WORDS buckets."""
    words, bounds = word_hashes([x.encode() for x in texts])
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    counts = np.bincount(row * WORDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=len(texts) * WORDS).reshape(-1, WORDS)
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}

    def slot(kind: str, name: str | None) -> int:
        key = f"{kind}:{name}"
        if len(names) > 100_000:
            names.clear()
        if key not in names:
            names[key] = int(mix(np.array([sum(b * 257**i for i, b in enumerate(key.encode())) % (1 << 64)], np.uint64))[0] % np.uint64(SLOTS))
        return names[key]

    for b in batches:
        texts, langs, sources, chars = (c.to_pylist() for c in b.columns[2:])
        texts = [x or "" for x in texts]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < PIECE_BYTES):
                size += len(texts[end])
                end += 1
            one = np.column_stack([np.array([shape(x) for x in texts[at:end]]), hashed_words(texts[at:end])]).astype(np.float32)
            two = np.zeros((end - at, VIEWS[1]), np.float32)
            for k in range(at, end):
                long = np.log1p(max(0, chars[k] or 0))
                two[k - at, :2] = long / 10, long * long / 100
                two[k - at, 2 + slot("lang", langs[k])] += 1
                two[k - at, 2 + slot("source", sources[k])] += 1
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), b.column(1).slice(at, end - at), *(pa.array([r.tobytes() for r in v], pa.binary()) for v in (one, two))], names=["doc_id", "row", "content", "metadata"])
            at = end


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """(doc_id, row, content, metadata): the two views of each row as float32, from whole texts; null texts count as empty, and null languages and sources are values of their own."""
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(n_chars).cast("long").alias("n_chars"))
    rows = rows.select("doc_id", row_key("doc_id", "text").alias("row"), "text", "lang", "source", "n_chars")
    return rows.mapInArrow(lean(_features), "doc_id bigint, row bigint, content binary, metadata binary")


def _views(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(b.column(b.schema.get_field_index(c)).to_pylist()), np.float32).reshape(-1, n).astype(float) for c, n in zip(("content", "metadata"), VIEWS, strict=True)]


def _logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


Round = tuple[list[np.ndarray], list[tuple[float, float]]]


def given(views: list[np.ndarray], rounds: list[Round]) -> list[np.ndarray]:
    """For each view the labels (0, 1 or -1) that the other one has given to these rows; a row is labelled once."""
    labels = [np.full(len(views[0]), -1, np.int8) for _ in views]
    free = np.ones(len(views[0]), bool)
    for weights, bounds in rounds:
        for k, (low, high) in enumerate(bounds):
            score = _logits(views[k], weights[k])
            for value, hit in ((0, score < low), (1, score > high)):
                labels[1 - k][hit & free] = value
                free &= ~hit
    return labels


def _sums(kind: str, weights: list[np.ndarray], rounds: list[Round]):
    """A task that sums over its rows: counts of each view's scores of rows without a label, or gradients and Hessians over the labelled ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(BINS if kind == "counts" else (n + 1) * (n + 2)) for n in VIEWS]
        for b in batches:
            if not len(b):
                continue
            views = _views(b)
            labels = given(views, rounds)
            free = (labels[0] < 0) & (labels[1] < 0)
            for k, x in enumerate(views):
                if kind == "counts":
                    total[k] += np.bincount(((_logits(x[free], weights[k]) + 30) * (BINS / 60.0001)).astype(int), minlength=BINS)
                    continue
                own = labels[k] >= 0
                total[k] += _newton(x[own], labels[k][own], weights[k])
        flat = np.concatenate(total)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["at", "value"])

    return task


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the log likelihood, flat."""
    x = np.column_stack([x, np.ones(len(x))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.concatenate([x.T @ (y - p), ((x * np.maximum(p * (1 - p), CURVE)[:, None]).T @ x).ravel()])


def _gathered(rows: DataFrame, kind: str, weights: list[np.ndarray], rounds: list[Round]) -> list[np.ndarray]:
    """The sums over all rows: some thousand numbers, whatever the input."""
    sizes = [BINS if kind == "counts" else (n + 1) * (n + 2) for n in VIEWS]
    got = rows.mapInArrow(lean(_sums(kind, weights, rounds)), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    flat = np.zeros(sum(sizes))
    flat[got["at"].to_numpy()] = got["value"].to_numpy()
    return np.split(flat, [sizes[0]])


def _bounds(counts: np.ndarray, share: float) -> tuple[float, float]:
    """Scores below and above which a view labels CONFIDENT of the rows, in the proportion of the classes, and only where it is surer than the base rate by MARGIN."""
    edges = np.linspace(-30, 30, BINS + 1)
    most = CONFIDENT * counts.sum()
    low = edges[np.searchsorted(np.cumsum(counts), most * (1 - share), side="right")]
    high = edges[BINS - np.searchsorted(np.cumsum(counts[::-1]), most * share, side="right")]
    base = float(np.log(share / (1 - share)))
    return min(low, min(base, 0.0) - MARGIN), max(high, max(base, 0.0) + MARGIN)


def fit(rows: DataFrame, labels: DataFrame) -> dict | None:
    """The model from features() and labels (doc_id, quality 0 or 1); None without labelled rows of both kinds.

    At most TRAINING_ROWS labels, those with the smallest hash of their id, are read, and every fifth of their rows is
    kept for calibration; of an id with several labels the largest holds, and all rows of an id have its label. All other rows
    are unlabelled. The result doesn't depend on the order of the rows but for the rounding of sums.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = stash(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS))
    got = rows.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "row", "content", "metadata").toArrow()
    y = got.column("quality").to_numpy().astype(float)
    if not (y == 0).any() or not (y == 1).any():
        return None
    views = [np.concatenate(v) for v in zip(*map(_views, got.to_batches()), strict=True)]
    free = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    back = np.arange(len(y)) % 5 == 4
    known_views, share = [v[~back] for v in views], float(y.mean())
    weights = [logistic(v, y[~back], RIDGE) for v in known_views]
    rounds: list[Round] = []
    for _ in range(ROUNDS):
        counts = _gathered(free, "counts", weights, rounds)
        if not counts[0].sum():
            break
        rounds.append(([w.copy() for w in weights], [_bounds(c, share) for c in counts]))
        for _ in range(STEPS):
            more = _gathered(free, "sums", weights, rounds)
            for k, v in enumerate(known_views):
                weights[k] = _step(weights[k], _newton(v, y[~back], weights[k]) + more[k])
    spare = y[back]
    raw = [_logits(v[back], w) for v, w in zip(views, weights, strict=True)]
    scale = [logistic(r[:, None], spare, 0.1) for r in raw]
    both = np.column_stack([_logits(r[:, None], s) for r, s in zip(raw, scale, strict=True)])
    return {"weights": weights, "scale": scale, "mix": logistic(both, spare, 0.1), "rounds": rounds}


def _step(w: np.ndarray, sums: np.ndarray) -> np.ndarray:
    penalty = np.append(np.full(len(w) - 1, RIDGE), 1e-3)
    change = np.linalg.solve(sums[len(w) :].reshape(len(w), -1) + np.diag(penalty), sums[: len(w)] - penalty * w)
    return w + np.clip(change, -5, 5)


def _combined(model: dict, views: list[np.ndarray]) -> list[np.ndarray]:
    own = [_logits(_logits(v, w)[:, None], s) for v, w, s in zip(views, model["weights"], model["scale"], strict=True)]
    return [1 / (1 + np.exp(-x)) for x in (*own, _logits(np.column_stack(own), model["mix"]))]


def _scored(model: dict | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _combined(model, _views(b)) if model else [np.full(len(b), 0.5)] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found)], names=["doc_id", "content_score", "metadata_score", "score"])

    return task


def score(rows: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, content_score, metadata_score, score): calibrated probabilities of good quality, one row per row of features().

    Null and empty texts are scored as such; repeated rows and null ids each give a row. Without a model all scores are
    0.5. An empty table gives an empty result.
    """
    return rows.mapInArrow(lean(_scored(model and {k: model[k] for k in ("weights", "scale", "mix")})), "doc_id bigint, content_score double, metadata_score double, score double")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    rows = stash(features(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    out = score(rows, fit(rows, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "content_score", "metadata_score", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
