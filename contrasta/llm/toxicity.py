"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, doubtful insult, violent verb, target, negation, report, mention, exclamation, speaker,
intent, or other. Letter-to-letter transducers - negation, reported speech, mention, target, exclamation, intent and
threat - are composed to one machine that reads a clause and marks each insult as plain, aimed at somebody, or negated or
reported, and threats. A violent verb is a threat if a speaker intends it and it has a target, and it's neither negated
nor reported: "I will hurt you", but not "the team will beat him" or "burn them".
Only these marks of matched clauses make a document's score. Insults are a short fixed list and words and stems learned
from labelled rows; stems that are only somewhat likelier in toxic rows are doubtful insults, a weaker symbol that goes
through the same transducers. The weights are learned from the same rows under an order: a threat weighs more than an aimed
insult, that more than a plain one, and a negated or reported one a fixed part of a plain one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, held_out, lean, mix, pieces, row_key, shingle_sets, stash, without_rows

# Word lists in English, German, French and Spanish.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool imbecile bastard jerk".split()
THREATS = "kill hurt destroy burn attack beat shoot stab crush töten verletzen schlagen tuer frapper brûler matar herir quemar".split()
TARGETS = "you your yours yourself he she they them him her du dich ihr euch sie ihn tu te toi vous lui eux tú ti usted ustedes ellos él ella".split()
NEGATIONS = "not no never none without isn't aren't nicht kein keine nie niemals ne pas jamais sans nunca jamás sin".split()
REPORTS = "said says say told tells quote quoted wrote writes claimed called sagte sagt schrieb dit écrit disait dijo dice escribió".split()
MENTIONS = "word words term terms wort wörter begriff mot mots terme palabra palabras término".split()
EXCLAMATIONS = "what such was'n quel quelle qué".split()
SPEAKERS = "i we ich wir je j nous yo nosotros".split()
INTENTS = "will gonna going shall want wanna werde werden will wollen vais allons voy vamos quiero".split()
INTENDED = "i'll we'll".split()
MARKS = "IJQAKDE"  # plain, negated, reported, aimed insult; threat with a target; doubtful insult, the same negated or reported

#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
TRAINING_ROWS = 20_000
PREFIXES = range(4, 9)
#: A form is in at least so many toxic documents, and in so large a part of them.
SUPPORT, PART = 8, 0.002
#: A form is an insult if it is so many times likelier in toxic documents than in others, and a doubtful one from DOUBTFUL on.
RATIO, DOUBTFUL = 20.0, 4.0
#: A stem of which one word makes up so large a part is no stem: the word alone counts, not others that begin like it.
ONE_WORD = 0.7
#: What a negated or reported insult counts of a plain one.
DISCOUNT = 0.3
#: How fast evidence saturates: one insult counts about half as much as ten.
SHARP = 8.0
#: The least by which an aimed insult weighs more than a plain one, and a threat more than that.
STEPS = (0.4, 0.2)
MEMORY = 200_000

_WORD = re.compile(r"[\w']+")
_CLAUSE = re.compile(r"[.!?;\n]+")
Delta = dict[tuple[object, str], tuple[object, str]]


class Transducer:
    """A deterministic letter-to-letter transducer; a symbol without a transition is copied."""

    def __init__(self, start: object, delta: Delta) -> None:
        self.start, self.delta = start, delta

    def step(self, state: object, symbol: str) -> tuple[object, str]:
        return self.delta.get((state, symbol), (state, symbol))

    def then(self, other: Transducer, alphabet: Iterable[str]) -> Transducer:
        """The composition: what this writes, `other` reads."""
        start, delta = (self.start, other.start), {}
        todo = [start]
        seen = {start}
        while todo:
            p, q = todo.pop()
            for a in alphabet:
                p2, b = self.step(p, a)
                q2, c = other.step(q, b)
                delta[(p, q), a] = ((p2, q2), c)
                if (p2, q2) not in seen:
                    seen.add((p2, q2))
                    todo.append((p2, q2))
        return Transducer(start, delta)

    def read(self, symbols: Iterable[str]) -> str:
        state, out = self.start, []
        for a in symbols:
            state, b = self.step(state, a)
            out.append(b)
        return "".join(out)


def _near(trigger: str, marks: dict[str, str], reach: int, symbols: str) -> Transducer:
    """Rewrites a symbol to its mark within `reach` symbols after `trigger`."""
    delta: Delta = {}
    for k in range(reach + 1):
        for a in symbols:
            delta[k, a] = (reach if a == trigger else max(0, k - 1), marks.get(a, a) if k else a)
    return Transducer(0, delta)


def grammar() -> Transducer:
    read = ".ITNRHDMWSFG"
    every = read + "JQAKEL"
    negation = _near("N", {"I": "J", "D": "E", "H": "."}, 3, every)
    report = Transducer(0, {(0, "R"): (1, "R"), (1, "I"): (1, "Q"), (1, "D"): (1, "E"), (1, "H"): (1, ".")})
    mention = _near("M", {"I": "Q", "D": "E", "H": "."}, 2, every)
    before = _near("T", {"I": "A"}, 4, every)
    exclaimed = _near("W", {"I": "A"}, 2, every)
    intent = _near("S", {"F": "G"}, 2, every).then(_near("G", {"H": "L"}, 4, every), every)
    threat = _near("L", {"T": "K"}, 4, every).then(_near("T", {"L": "K"}, 2, every), every)
    out = negation
    for other in (report, mention, before, exclaimed, intent, threat):
        out = out.then(other, read)
    return out


class Reader(dict):
    """Words to symbols, kept as they come."""

    def __init__(self, stems: Iterable[str], words: Iterable[str], doubtful: Iterable[str]) -> None:
        super().__init__()
        self.stems, self.words, self.doubtful = frozenset(stems), frozenset(words), frozenset(doubtful)
        self.fixed = {w: s for s, own in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("M", MENTIONS), ("W", EXCLAMATIONS), ("S", SPEAKERS), ("F", INTENTS), ("G", INTENDED), ("H", THREATS), ("I", INSULTS)) for w in own}

    def __missing__(self, word: str) -> str:
        if len(self) > MEMORY:
            self.clear()
        begins = {word[:n] for n in PREFIXES}
        found = self.fixed.get(word) or ("I" if word in self.words or begins & self.stems else "D" if begins & self.doubtful else ".")
        self[word] = found
        return found


def marks(text: str, reader: Reader, machine: Transducer) -> list[int]:
    """How often each mark stands in the text's matched clauses: those with an insult, a doubtful one or a threat."""
    text = text.lower()
    count: Counter = Counter()
    if not {"I", "D", "H"}.isdisjoint(map(reader.__getitem__, _WORD.findall(text))):
        for clause in _CLAUSE.split(text):
            read = list(map(reader.__getitem__, _WORD.findall(clause)))
            if "I" in read or "D" in read or "H" in read:
                count.update(machine.read(read))
    return [count[m] for m in MARKS]


def _forms(text: str) -> set[str]:
    """The distinct words of a text, ended by $, and their prefixes."""
    words = set(_WORD.findall(text.lower()))
    return {w[:n] for w in words for n in PREFIXES if len(w) >= n} | {w + "$" for w in words if len(w) > 2}


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in pieces(batches):
        low = [[int(mix(s ^ np.uint64(k * 0x9E3779B9)).min() >> np.uint64(1)) if len(s) else None for s in shingle_sets(texts)] for k in range(3)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *[pa.array(x, pa.int64()) for x in low]], names=["doc_id", "toxic", "x", "y", "z"])


def _form_counts(ids: frozenset, toxic: int, only: frozenset | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            for i, text, label in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if label == toxic and i in ids:
                    own = _forms(text or "")
                    count.update(own if only is None else own & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["form", "n"])

    return task


def _marked(reader: tuple):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, machine = Reader(*reader), grammar()
        for b in batches:
            found = [marks(x or "", read, machine) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([f[k] for f in found], pa.int32()) for k in range(len(MARKS))]], names=["doc_id", *MARKS])

    return task


def count_marks(docs: DataFrame, reader: tuple, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, I, J, Q, A, K, D, E): how often each mark of the grammar stands in each whole text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(_marked(reader)), "doc_id bigint, " + ", ".join(f"`{m}` int" for m in MARKS))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights, the intercept last, of a ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-6:
            break
    return w


def evidence(counts: np.ndarray) -> np.ndarray:
    """Of counts of MARKS: insults and threats of any kind, those that are aimed or threats, threats, doubtful insults."""
    plain, negated, reported, aimed, threats, doubtful, weak = np.asarray(counts, float).T
    return np.log1p(SHARP * np.column_stack([plain + aimed + threats + DISCOUNT * (negated + reported), aimed + threats, threats, doubtful + DISCOUNT * weak]))


def ordered_logistic(x: np.ndarray, y: np.ndarray, least: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights, the intercept last, of a ridge logistic regression whose weights are not below `least`, by Newton steps on those that aren't at their bound."""
    x = np.column_stack([x, np.ones(len(x))])
    low = np.append(least, -np.inf)
    w = np.append(least, 0.0)
    penalty = np.append(np.full(len(least), ridge), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        down = x.T @ (y - p) - penalty * w
        free = (w > low) | (down > 0)
        own = x[:, free]
        change = np.zeros(len(w))
        change[free] = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + np.diag(penalty[free]), down[free])
        new = np.maximum(w + np.clip(change, -2, 2), low)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


#: Weights where there is nothing to learn from.
DEFAULT = {"reader": ((), (), ()), "weights": [2.0, 0.4, 0.2, 0.3, -4.0]}


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Stems and weights from at most TRAINING_ROWS labelled rows, of which near copies count once.

    labels: doc_id, toxic (0 or 1, null: not labelled). The driver gets ids, labels, three minima of shingle hashes and
    mark counts of those rows, and at most CANDIDATES forms: bounded, whatever the input.
    """
    arrow_rows(docs.sparkSession)
    chosen = stash(labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS))
    rows = stash(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"))
    seen: set[tuple] = set()
    label: dict[int, int] = {}
    for i, toxic, *low in sorted(map(tuple, rows.mapInArrow(lean(_sketches), "doc_id bigint, toxic int, x bigint, y bigint, z bigint").collect())):
        own = {(k, x) for k, x in enumerate(low) if x is not None}
        if not own & seen:
            label[i] = toxic
        seen |= own
    ids = frozenset(label)
    bad, fine = sum(label.values()), len(label) - sum(label.values())
    if not bad or not fine:
        return DEFAULT
    tally = lambda toxic, only: rows.mapInArrow(lean(_form_counts(ids, toxic, only)), "form string, n bigint").groupBy("form").agg(F.sum("n").alias("n"))
    least = max(SUPPORT, int(PART * bad))
    common = {r.form: r.n for r in tally(1, None).where(F.col("n") >= least).collect()}  # bounded by the forms of TRAINING_ROWS rows over `least`
    clean = {r.form: r.n for r in tally(0, frozenset(common)).collect()}
    odds = {f: (n + 0.5) / (bad + 1) / ((clean.get(f, 0) + 0.5) / (fine + 1)) for f, n in common.items()}
    top: dict[str, int] = {}
    for form, n in common.items():
        for k in PREFIXES if form[-1] == "$" else ():
            if k < len(form):
                top[form[:k]] = max(top.get(form[:k], 0), n)
    stems = _shortest(f for f in common if f[-1] != "$" and odds[f] >= RATIO and top.get(f, 0) < ONE_WORD * common[f])
    doubtful = _shortest(f for f in common if f[-1] != "$" and odds[f] >= DOUBTFUL and top.get(f, 0) < ONE_WORD * common[f])
    words = {f[:-1] for f in common if f[-1] == "$" and odds[f] >= RATIO and not any(f[:n] in stems for n in PREFIXES)}
    reader = (tuple(sorted(stems)), tuple(sorted(words)), tuple(sorted(doubtful)))
    known = [r for r in count_marks(rows, reader).collect() if r.doc_id in label]
    x = evidence([[r[m] for m in MARKS] for r in known])
    return {"reader": reader, "weights": ordered_logistic(x, np.array([label[r.doc_id] for r in known], float), np.array([0.0, *STEPS, 0.0])).tolist()}


def _shortest(forms: Iterable[str]) -> set[str]:
    """Of forms those of which no shorter one is a prefix."""
    found: set[str] = set()
    for form in sorted(forms, key=lambda f: (len(f), f)):
        if not any(form[:n] in found for n in range(1, len(form))):
            found.add(form)
    return found


def _scores(model: dict):
    weights = np.array(model["weights"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, machine = Reader(*model["reader"]), grammar()
        for b in batches:
            found = [marks(x or "", read, machine) for x in b.column(1).to_pylist()]
            logit = evidence(np.array(found).reshape(-1, len(MARKS))) @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], names=[b.schema.names[0], "score"])

    return task


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted): one row per input row; score is the model's probability of toxicity.

    Null and empty texts have no marks and get the score of clean texts. Whole texts are read, of any length. Repeated rows
    and null ids each give a row; other columns are not read. An empty table gives an empty result. Without labelled rows
    of both kinds the fixed list and fixed weights hold.
    """
    arrow_rows(docs.sparkSession)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(_scores(model)), "doc_id bigint, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def fitted(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from the labelled rows that aren't held out."""
    return fit(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that aren't predicted to be toxic, by the model that is fitted on them and `labels`.

    Each row is judged by its own text, also one with a null or repeated id; null and empty texts stay. All columns stay as they
    are, whatever their names. An empty table gives an empty result.
    """
    arrow_rows(docs.sparkSession)
    model = fitted(docs, labels)
    rows = docs.select(row_key(F.col(doc_id).cast("long"), F.col(text)).alias("row"), F.col(text).alias("text"))
    gone = stash(rows.mapInArrow(lean(_scores(model)), "row bigint, score double").where("score >= 0.5").select("row").distinct())
    return without_rows(docs, gone, doc_id, text)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
