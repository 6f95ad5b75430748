import re

from pyspark.sql import functions as F

from contrasta.functions import text as X


def packed(text, budget):
    """Sentences in order into chunks, by a plain loop."""
    out, now, size = [], [], 0
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text.strip())):
        words = s.split()
        n = max(1, round(len(words) * 1.3))
        if not s:
            continue
        if n > budget or size + n > budget:
            out += [" ".join(now)] if now else []
            now, size = [], 0
        if n > budget:
            per = max(1, int(budget * len(words) / n))
            out += [" ".join(words[i : i + per]) for i in range(0, len(words), per)]
        else:
            now, size = [*now, s], size + n
    return out + ([" ".join(now)] if now else [])


def test_chunks_are_packed_sentences(spark):
    texts = ["One two. Three 3.5 four! Five?", "", " ", "w " * 30 + ". a b c. d", "a. b. c. d. e. f. g. h. i. j.", "no mark at all"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for most in (5, 8, 20):
        got = {r.i: r.c for r in rows.select("i", X.chunks(F.col("t"), most).alias("c")).collect()}
        assert [got[i] for i in range(len(texts))] == [packed(t, max(1, int(most * 0.8))) for t in texts]


def test_sentences_keep_marks_and_numbers(spark):
    row = spark.range(1).select(X.sentences(F.lit("It is 3.5 m. Is it? Yes!\nNo")).alias("s")).first()
    assert row.s == ["It is 3.5 m.", "Is it?", "Yes!", "No"]


def test_leakage_rules(spark):
    pairs = [("Carbon", "Carbonado", "HARD"), ("Carbon", "Boron_carbide", "SOFT"), ("Adam_Smith", "Smiths", "HARD"), ("Gold", "Iron", "NONE"), ("Straße", "STRASSE", "HARD")]
    rows = spark.createDataFrame(pairs, "a string, b string, want string")
    assert all(r.want == r.verdict for r in rows.select("want", X.leakage(F.col("a"), F.col("b")).verdict.alias("verdict")).collect())
