"""Classes that give an answer away by word formation: a word of one name is derived from a word of the other.

Words that are at most one edit apart share a word with one letter left out, so all such pairs of two vocabularies are found
by an equal join on those, and no other pairs are formed. Only distinct words are compared, however many names have them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Suffixes by which names of followers, doctrines, peoples and qualities are derived.
DERIVATIONAL = ("esque", "ians", "ists", "isms", "ites", "ian", "ean", "ese", "ist", "ism", "ite", "ish", "oid", "ic", "an")
#: Suffixes by which processes and agents are derived.
DEVERBAL = ("ations", "ating", "ation", "ators", "ated", "ator")
#: Those of proper names, which hold for short names too if the rest is exactly the name.
EPONYMIC = ("esque", "ians", "ists", "isms", "ites", "ian", "ist", "ism", "ite")


@dataclass(frozen=True)
class Rules:
    """suffixes: stripped up to `depth` times while `stem` letters are left. eponymic: stripped once while `name` letters are left, compared exactly. token: letters of a word that is looked at."""

    suffixes: tuple[str, ...] = DERIVATIONAL
    stem: int = 6
    depth: int = 2
    eponymic: tuple[str, ...] = ()
    name: int = 3
    token: int = 4


EXTENDED = Rules(suffixes=tuple(sorted({*DERIVATIONAL, *DEVERBAL}, key=lambda s: (-len(s), s))), eponymic=EPONYMIC)


def _stripped(words: DataFrame, suffixes: tuple[str, ...], least: int, stem: str, path: str) -> DataFrame:
    """`words` with one suffix less in `stem` and the suffix added to `path`, a row for each suffix that `stem` ends with."""
    column, size = F.col(stem), F.char_length(F.col(stem))
    way = lambda s: F.when(F.col(path) == "", F.lit(s)).otherwise(F.concat(F.col(path), F.lit("_" + s)))
    cut = [F.when(column.endswith(s) & (size - len(s) >= least), F.struct(F.substring(column, F.lit(1), size - len(s)).alias("stem"), way(s).alias("path"))) for s in sorted(set(suffixes), key=lambda s: (-len(s), s))]
    rows = words.select(*[c for c in words.columns if c not in (stem, path)], F.explode(F.array_compact(F.array(*cut))).alias("c"))
    return rows.select("*", F.col("c.stem").alias(stem), F.col("c.path").alias(path)).drop("c")


def derived_stems(words: DataFrame, rules: Rules) -> DataFrame:
    """(word, stem, path): every stem of `words` (word) by up to `depth` suffixes, the outermost first in `path`."""
    level = words.select("word", F.col("word").alias("stem"), F.lit("").alias("path"))
    found = None
    for _ in range(rules.depth):
        level = _stripped(level, rules.suffixes, rules.stem, "stem", "path")
        found = level if found is None else found.unionByName(level)
    return found.select("word", "stem", "path").distinct()


def edits(a: Column, b: Column) -> Column:
    """0 for equal words, 1 for one insertion, deletion, substitution or swap of neighbours, else null."""
    swap = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.char_length(a)))
    at = F.sequence(F.lit(1), F.greatest(F.char_length(a) - 1, F.lit(1)))
    return F.when(a == b, 0).when(F.levenshtein(a, b, 1) >= 0, 1).when((F.char_length(a) == F.char_length(b)) & F.exists(at, lambda i: swap(i) == b), 1)


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, y, edits): all pairs of a word of `left` and one of `right` (word) that are at most one edit apart."""

    def keyed(words: DataFrame, name: str) -> DataFrame:
        w = F.col("word")
        shorter = F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))
        words = words.select("word").where("word <> ''").distinct()
        return words.select(w.alias(name), F.explode(F.array_distinct(F.concat(F.array(w), shorter))).alias("key"))

    pairs = keyed(left, "x").join(keyed(right, "y"), "key").select("x", "y").distinct()
    return pairs.select("x", "y", edits(F.col("x"), F.col("y")).alias("edits")).where("edits is not null")


def _matches(plain: DataFrame, derived: DataFrame, rules: Rules, side: str) -> DataFrame:
    """(word, other, kind): words of `plain` whose stem is within one edit of a stem of a word of `derived`."""
    stems = plain.select("word", X.plural_stem(F.col("word")).alias("x")).where(F.char_length("x") >= rules.stem)
    cut = derived_stems(derived, rules)
    near = near_words(stems.select(F.col("x").alias("word")), cut.select(F.col("stem").alias("word")))
    found = near.join(stems, "x").join(cut.select(F.col("word").alias("other"), F.col("stem").alias("y"), "path"), "y")
    return found.select("word", "other", F.concat(F.lit(f"{side}_DERIVATIONAL_"), F.upper("path"), F.lit("_D"), "edits").alias("kind"))


def class_leaks(answers: DataFrame, classes: DataFrame, rules: Rules = EXTENDED, ascii_only: bool = False) -> DataFrame:
    """(answer, class, evidence): every pair in which a word of one name is derived from a word of the other.

    answers: (answer, name); classes: (class, name). evidence: sorted texts, answer's word~class's word:RULE, with the suffixes
    that were taken off and the edits that are left. Names without words, and nulls, leak nowhere.
    """
    words = lambda df, key, least: df.select(key, F.explode(X.tokens(F.col("name"), least, ascii_only)).alias("word")).distinct()
    own, other, brief = words(answers, "answer", rules.token), words(classes, "class", rules.token), words(answers, "answer", rules.name)
    mine, theirs = own.select("word").distinct(), other.select("word").distinct()
    pairs = _matches(mine, theirs, rules, "CLASS").select(F.col("word").alias("a"), F.col("other").alias("b"), "kind")
    pairs = pairs.unionByName(_matches(theirs, mine, rules, "ANSWER").select(F.col("other").alias("a"), F.col("word").alias("b"), "kind"))
    if rules.eponymic:
        cut = _stripped(theirs.select("word", F.col("word").alias("stem"), F.lit("").alias("path")), rules.eponymic, rules.name, "stem", "path")
        names = brief.select("word").distinct().select(F.col("word").alias("a"), F.explode(F.array_distinct(F.array("word", X.plural_stem(F.col("word"))))).alias("stem"))
        exact = cut.join(names, "stem").select("a", F.col("word").alias("b"), F.concat(F.lit("CLASS_EPONYMIC_EXACT_"), F.upper("path"), F.lit("_D0")).alias("kind"))
        pairs = pairs.unionByName(exact)
    # a short word of an answer can take part by the eponymic rule alone, for which such words are in `brief`
    found = brief.withColumnRenamed("word", "a").join(pairs.distinct(), "a").join(other.withColumnRenamed("word", "b"), "b")
    return found.groupBy("answer", "class").agg(F.array_sort(F.collect_set(F.concat("a", F.lit("~"), "b", F.lit(":"), "kind"))).alias("evidence"))


def extended_verdict(pairs: DataFrame, leaks: DataFrame) -> DataFrame:
    """`pairs` (answer, class, verdict, evidence) with final, source and all evidence: word formation only raises a verdict to HARD, and what was HARD before stays by its own rule."""
    rows = pairs.join(leaks.withColumnRenamed("evidence", "formed"), ["answer", "class"], "left")
    raised = F.col("formed").isNotNull() & (F.col("verdict") != "HARD")
    return rows.select("answer", "class", "verdict", F.when(raised, "HARD").otherwise(F.col("verdict")).alias("final"), F.when(raised, "WORD_FORMATION").otherwise("NAME").alias("source"), F.concat("evidence", F.coalesce("formed", F.array().cast("array<string>"))).alias("evidence"))
