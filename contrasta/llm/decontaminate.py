"""Benchmark decontamination by spaced-seed hashing.

A seed is a window of token positions of which one of two fixed masks reads some and ignores others, so a substituted token at an
ignored position doesn't hide a match. The hashes of all windows of the benchmark, which is the small side, are joined with
those of all windows of the training texts. Around each hit the item is laid on the document at that offset, and the best
stretch - matches count 1, substitutions -2 - decides. Every stretch that is accepted holds a hit of a mask. Items that are
shorter than the masks are found by windows of their own length, which must be equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, row_key, stash, without_rows

#: The positions that each mask reads. However substitutions lie, a stretch that LEAST and PART accept has a
#: window in which those of one mask are equal (tests/llm has the enumeration); no one mask of four positions has this property.
MASKS = ((0, 1, 2, 4), (0, 3, 4, 5))
#: Items with fewer tokens than the first mask spans are found by windows of their own length.
SPAN = 5
#: An item leaks with so many matched tokens, or with half of its own, but at least 8 (or all, if it has fewer), where
#: at least so large a part of the stretch matches.
ENOUGH, LEAST, PART = 13, 8, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits; one empty word for a text without any."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.split(words, " ")


def _windows(size: int, offsets: tuple[int, ...], *kind: Column) -> Column:
    """The hashes of the tokens at `offsets` of each window of so many tokens of column `toks`."""
    last = F.size("toks") - size
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(*kind, *[F.get("toks", i + j) for j in offsets]).alias("seed")))


def _hashed(rows: DataFrame, key: str, short: tuple[int, ...], own: bool = False) -> DataFrame:
    """(key, pos, seed): a row for each mask and window of column `toks`. short: lengths below SPAN of which windows are read too; own: only the token list itself is such a window."""
    seeds = [_windows(m[-1] + 1, m, *[F.lit(-k)] * (k > 0)) for k, m in enumerate(MASKS)]
    for n in short:
        windows = _windows(n, tuple(range(n)), F.lit(n))
        seeds.append(F.when(F.size("toks") == n, windows).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>")) if own else windows)
    rows = rows.select(key, F.concat(*seeds).alias("seeds"))
    # outer: else a filter on the array's size, with all of its expression, is pushed below and evaluated besides
    return rows.select(key, F.explode_outer("seeds").alias("s")).where("s is not null").select(key, "s.pos", "s.seed")


def _best(same: Column) -> Column:
    """(score, matched, length) of the best stretch of an array of 0 and 1, and of those with the best score the longest."""
    zero = F.lit(0)
    state = lambda s, m, n: F.struct(s.alias("score"), m.alias("matched"), n.alias("length"))
    start = F.struct(state(zero, zero, zero).alias("now"), state(zero, zero, zero).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        score = acc.now.score + x * 3 - 2
        now = F.when(score >= 0, state(score, acc.now.matched + x, acc.now.length + 1)).otherwise(state(zero, zero, zero))
        return F.struct(now.alias("now"), F.when((score > acc.best.score) | ((score == acc.best.score) & (score > 0) & (now.matched > acc.best.matched)), now).otherwise(acc.best).alias("best"))

    return F.aggregate(same, start, step, lambda acc: acc.best)


def _found(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, row, item_id, best, item_tokens): the accepted stretches. Rows and items are known by digests, so null ids are no matter."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select("doc_id", "text", row_key("doc_id", "text").alias("row"))
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("item")).where("item[0] <> ''")
    items = stash(items.select("item_id", "item", F.xxhash64("item_id", "item").alias("own")).dropDuplicates(["own"]))
    short = tuple(sorted(r[0] for r in items.where(F.size("item") < SPAN).select(F.size("item")).distinct().collect()))  # at most SPAN - 1 numbers
    seeds = stash(_hashed(items.select("own", F.col("item").alias("toks")), "own", short, own=True).select("own", F.col("pos").alias("at"), "seed").distinct())
    read = docs.select("row", tokens(F.col("text")).alias("toks"))
    hits = _hashed(read, "row", short).join(bounded(seeds), "seed").select("row", "own", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    hits = stash(hits)
    texts = docs.join(bounded(stash(hits.select("row").distinct())), "row", "left_semi").select("doc_id", "row", tokens(F.col("text")).alias("toks"))
    laid = texts.join(bounded(hits), "row").join(bounded(items), "own")
    low = F.greatest(F.lit(0), -F.col("shift"))
    length = F.greatest(F.lit(0), F.least(F.size("item"), F.size("toks") - F.col("shift")) - low)
    same = F.zip_with(F.slice("item", low + 1, length), F.slice("toks", low + F.col("shift") + 1, length), lambda x, y: F.when(x == y, 1).otherwise(0))
    # written first: the optimizer would put the whole expression into each use of its parts
    found = stash(laid.select("doc_id", "row", "item_id", F.size("item").alias("item_tokens"), _best(same).alias("best")))
    own = F.greatest(F.least(F.lit(LEAST), F.col("item_tokens")), F.ceil(F.col("item_tokens") / 2))
    return found.where((F.col("best.matched") >= F.least(F.lit(ENOUGH), own)) & (F.col("best.matched") >= F.col("best.length") * PART))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, stretch, item_tokens): a row for each document and item that leaks into it.

    Null and empty texts have no tokens and so no leaks; items without a token are left out. An item of fewer than 8 tokens
    leaks where all of them stand in a row. Rows with a null id leak like others and are one document in the result, as are
    items with a null id. Repeated documents and items give one row per pair of ids, with the best stretch and of
    those the longest. Other columns are not read. An empty table on either side gives an empty result.
    """
    best = _found(docs, benchmark, doc_id, text, item_id, item_text).groupBy("doc_id", "item_id").agg(F.max(F.struct("best.score", "best.matched", "best.length", "item_tokens")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.matched").cast("long").alias("matched"), F.col("b.length").cast("long").alias("stretch"), F.col("b.item_tokens").cast("long").alias("item_tokens"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` into which no item leaks, each judged by its own text, also with a null or repeated id; null and empty texts stay.

    All columns stay as they are, whatever their names. An empty table on either side leaves `docs` as it is.
    """
    gone = stash(_found(docs, benchmark, doc_id, text, item_id, item_text).select("row").distinct())
    return without_rows(docs, gone, doc_id, text)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
