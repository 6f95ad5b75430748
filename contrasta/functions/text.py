"""Column functions on names, labels and texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What an IRI must not contain; the namespace markers of categories; suffixes of plurals; phrases that claim an absence.
UNSAFE = r"[\s<>\"{}|\\^`\x00-\x1f\x7f]"
CATEGORY = "Category:"
PLURALS = ("es", "s")
NEGATIVE_CLAIMS = ("does not have", "doesn't have", "is false", "are false", "negative fact", "verified false", "proven false", "proved false", "logically excluded", "known to be false", "false fact", "definitely not", "globally optimal", "human-approved", "human approved")


def _unicode(form: str, fold: bool):
    @F.pandas_udf("string")
    def change(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x).casefold() if fold else unicodedata.normalize(form, x))

    return change


def nfc(c: Column) -> Column:
    """Canonical composition; Spark has no function for it, so Arrow batches go through Python."""
    return _unicode("NFC", False)(c)


def folded(c: Column) -> Column:
    """Compatibility composition and case folding."""
    return _unicode("NFKC", True)(c)


def bare_uri(c: Column) -> Column:
    """Trimmed, without a pair of angle brackets."""
    t = F.trim(c)
    return F.when(t.startswith("<") & t.endswith(">"), F.substring(t, 2, F.length(t) - 2)).otherwise(t)


def percent_decoded(c: Column) -> Column:
    """Percent escapes decoded; what can't be decoded stays as it is, and so does a plus sign."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def local_name(c: Column) -> Column:
    """The last segment of a URI's path, or its host where the path has none, percent-decoded. A text that is no URI is its own last segment."""
    u = bare_uri(c)
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"
    path, host = F.regexp_extract(u, pattern, 2), F.regexp_extract(u, pattern, 1)
    tail = F.regexp_extract(path, "([^/]*)$", 1)
    return percent_decoded(F.when(tail != "", tail).when(host != "", host).otherwise(u))


def display_label(c: Column, ascii_only: bool = False) -> Column:
    """The local name with spaces for underscores, composed; parentheses, hyphens, digits and case stay. ascii_only: skip the composition."""
    label = F.replace(local_name(c), F.lit("_"), F.lit(" "))
    return F.trim(label if ascii_only else nfc(label))


def is_safe_uri(c: Column) -> Column:
    """An http(s) URI that can stand between angle brackets as it is."""
    u = bare_uri(c)
    return F.coalesce(u.rlike("(?i)^https?://") & ~u.rlike(UNSAFE), F.lit(False))


def is_safe_literal(c: Column) -> Column:
    return F.coalesce((c != "") & ~c.rlike(r"[\"\\\x00-\x1f\x7f]"), F.lit(False))


def spelling_ladder(c: Column, ascii_only: bool = False) -> Column:
    """Distinct spellings of a URI, in the order in which they are tried."""
    bare = bare_uri(c)
    decoded = percent_decoded(bare)
    both = [bare, decoded] if ascii_only else [bare, decoded, nfc(bare), _unicode("NFD", False)(bare)]
    wrapped = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    forms = [wrapped(bare), bare, wrapped(decoded), decoded, *[wrapped(x) for x in both[2:]]]
    return F.array_distinct(F.array(*forms))


def slug(c: Column, limit: int = 72) -> Column:
    """A name for files: the local part with one underscore for each run of other characters than letters, digits, dot and hyphen."""
    tail = F.regexp_extract(F.regexp_replace(c, "/+$", ""), "([^/]*)$", 1)
    found = F.regexp_replace(F.regexp_replace(tail, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(found == "", "answer").otherwise(found), 1, limit)


def category_name(c: Column, prefix: str) -> Column:
    """The full URI under `prefix` (which ends with the category marker) of a category given as dbc:X, Category:X, full URI or bare name; null where it can't be one."""
    raw = bare_uri(c)
    full = raw.contains("://") | F.lower(raw).rlike("^(http|https|ftp|file):")
    after = F.when(raw.startswith("dbc:"), F.substring(raw, 5, F.length(raw))).when(raw.startswith(CATEGORY), F.substring(raw, len(CATEGORY) + 1, F.length(raw))).otherwise(raw)
    local = F.when(full, F.when(raw.startswith(prefix) & ~raw.rlike(UNSAFE), F.substring(raw, len(prefix) + 1, F.length(raw)))).otherwise(F.replace(F.trim(after), F.lit(" "), F.lit("_")))
    return F.when((local != "") & ~local.rlike(UNSAFE) & ~local.contains("/"), F.concat(F.lit(prefix), local))


def category_resource(c: Column, prefix: str) -> Column:
    """The URI of a category without the marker, in the spelling of resources."""
    full = category_name(c, prefix)
    return F.concat(F.lit(prefix.removesuffix(CATEGORY)), F.substring(full, len(prefix) + 1, F.length(full)))


def page_title(c: Column, prefix: str) -> Column:
    """The page title that a resource URI under `prefix` asks for; null for others."""
    u = bare_uri(c)
    local = F.substring(u, len(prefix) + 1, F.length(u))
    title = F.trim(F.replace(percent_decoded(local), F.lit("_"), F.lit(" ")))
    return F.when(u.startswith(prefix) & ~local.contains("/") & (title != ""), title)


def tokens(c: Column, least: int = 1, ascii_only: bool = False) -> Column:
    """Runs of letters and digits of at least `least` characters, in order; of a text with a slash those of its local name."""
    name = F.when(c.contains("/"), local_name(c)).otherwise(c)
    name = F.lower(name) if ascii_only else folded(name)
    return F.filter(F.regexp_extract_all(name, F.lit(r"([\p{L}\p{N}]+)"), 1), lambda t: F.char_length(t) >= least)


def plural_stem(t: Column) -> Column:
    """Without one plural suffix, the longest that leaves four characters."""
    out = t
    for s in reversed(PLURALS):
        out = F.when(t.endswith(s) & (F.char_length(t) - len(s) >= 4), F.substring(t, 1, F.char_length(t) - len(s))).otherwise(out)
    return out


def shared_prefix(a: Column, b: Column) -> Column:
    """The length of the common prefix."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(n > 0, F.size(same)).otherwise(0)


def leakage(answer: Column, other: Column, least: int = 4, long: int = 5, short: int = 4, ascii_only: bool = False) -> Column:
    """(verdict, evidence): HARD where a word of the answer's name stands in the other's, is its plural or is one's prefix; SOFT where only a prefix is shared.

    evidence: the sorted (answer word, other word, rule) of the verdict.
    """
    pair = lambda a, b, rule: F.struct(a.alias("a"), b.alias("b"), F.lit(rule).alias("rule"))

    def rule(a: Column, b: Column) -> Column:
        n = shared_prefix(a, b)
        return (
            F.when(a == b, pair(a, b, "WHOLE_TOKEN")).when(plural_stem(a) == plural_stem(b), pair(a, b, "PLURAL_STEM"))
            .when((n >= long) & (a.startswith(b) | b.startswith(a)), pair(a, b, "LONG_PREFIX")).when(n >= short, pair(a, b, "SHORT_PREFIX"))
        )

    # in an array of one, as a function of Python can't stand inside of another's
    both = F.array(F.struct(tokens(answer, least, ascii_only).alias("x"), tokens(other, least, ascii_only).alias("y")))
    found = F.flatten(F.flatten(F.transform(both, lambda p: F.transform(p.x, lambda a: F.transform(p.y, lambda b: rule(a, b))))))
    found = F.filter(found, lambda x: x.isNotNull())
    hard = F.filter(found, lambda x: x.rule != "SHORT_PREFIX")
    verdict = F.when(F.size(hard) > 0, "HARD").when(F.size(found) > 0, "SOFT").otherwise("NONE")
    return F.struct(verdict.alias("verdict"), F.array_sort(F.when(F.size(hard) > 0, hard).otherwise(found)).alias("evidence"))


def for_matching(c: Column, ascii_only: bool = False) -> Column:
    """A form to compare only: no parentheticals, underscores or punctuation, single spaces, folded."""
    t = F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", " "), r"[^\p{L}\p{N}_\s]", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.lower(t) if ascii_only else folded(t)


def contains_phrase(haystack: Column, needle: Column) -> Column:
    """Whether the words of `needle` stand in a row in `haystack`."""
    space = F.lit(" ")
    return (haystack != "") & (needle != "") & F.concat(space, haystack, space).contains(F.concat(space, needle, space))


def content_words(c: Column, least: int, stop: tuple[str, ...]) -> Column:
    """The distinct words of a normalised text with so many characters that aren't stop words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda t: (F.char_length(t) >= least) & ~t.isin(*stop))))


def without_parenthetical(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", ""))


def name_inside(answer: Column, candidate: Column, ascii_only: bool = False) -> Column:
    """Where in the longer name of a candidate the whole name of the answer stands, counted in words from 0; null if nowhere."""
    both = F.array(F.struct(tokens(answer, 1, ascii_only).alias("x"), tokens(candidate, 1, ascii_only).alias("y")))

    def place(p: Column) -> Column:
        last = F.size(p.y) - F.size(p.x)
        at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(p.y, i + 1, F.greatest(F.size(p.x), F.lit(1))) == p.x)
        return F.when((F.size(p.x) > 0) & (last > 0), F.get(at, F.lit(0)))

    return F.get(F.transform(both, place), F.lit(0))


def edit_distance(limit: int):
    """A function of two columns: the edit distance with transpositions of neighbours, or limit + 1 beyond it."""

    def within(a: str, b: str) -> int:
        if abs(len(a) - len(b)) > limit:
            return limit + 1
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a):
            row = [i + 1]
            for j, y in enumerate(b):
                best = min(rows[-1][j] + (x != y), rows[-1][j + 1] + 1, row[j] + 1)
                if i and j and x == b[j - 1] and a[i - 1] == y:
                    best = min(best, rows[-2][j - 1] + 1)
                row.append(best)
            rows.append(row)
        return min(rows[-1][-1], limit + 1)

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else within(x, y) for x, y in zip(a, b, strict=True)])

    return distance


def sentences(c: Column) -> Column:
    """Sentences with their marks: the text is cut at white space after a full stop, question or exclamation mark, so 3.5 stays whole."""
    return F.filter(F.transform(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def n_words(c: Column) -> Column:
    """How many runs of other than white space."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(\S+)"), 1))


def estimated_tokens(c: Column) -> Column:
    """1.3 for each word, rounded half to even, and 1 at least."""
    return F.greatest(F.lit(1), F.bround(n_words(c) * F.lit(1.3)).cast("int"))


def n_sentences(c: Column) -> Column:
    """A cheap count: the parts between marks that aren't blank."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "[.!?]"), lambda s: s.rlike(r"\S")))


def chunks(c: Column, most: int = 256, safety: float = 0.8) -> Column:
    """Sentences packed in order into chunks of an estimated 0.8 * `most` tokens; a sentence over that is split by words, in chunks of its own."""
    budget = max(1, int(max(1, most) * safety))
    state = lambda done, now, size: F.struct(done.alias("done"), now.alias("now"), size.alias("size"))
    none = F.array().cast("array<string>")
    flushed = lambda acc: F.when(acc.size > 0, F.concat(acc.done, F.array(acc.now))).otherwise(acc.done)

    def step(acc: Column, s: Column) -> Column:
        n = estimated_tokens(s)
        words = F.regexp_extract_all(s, F.lit(r"(\S+)"), 1)
        per = F.greatest(F.lit(1), F.floor(F.lit(budget) * F.size(words) / n).cast("int"))
        starts = F.sequence(F.lit(1), F.size(words), per)
        long = F.transform(starts, lambda i: F.array_join(F.slice(words, i, per), " "))
        fits = acc.size + n <= budget
        joined = F.when(acc.size > 0, F.concat(acc.now, F.lit(" "), s)).otherwise(s)
        return F.when(n > budget, state(F.concat(flushed(acc), long), F.lit(""), F.lit(0))).when(fits, state(acc.done, joined, acc.size + n)).otherwise(state(flushed(acc), s, n))

    return F.aggregate(sentences(c), state(none, F.lit(""), F.lit(0)), step, flushed)


def negative_claims(c: Column) -> Column:
    """The phrases in a text that read an absence as a falsity, in their fixed order."""
    low = F.lower(c)
    return F.filter(F.array(*[F.lit(x) for x in NEGATIVE_CLAIMS]), lambda p: F.instr(low, p) > 0)


def strict_bool(c: Column) -> Column:
    """true and false; null for any other spelling."""
    return F.when(c == "true", True).when(c == "false", False)


def strict_float(c: Column) -> Column:
    """A finite number in plain or exponent notation; null for any other text."""
    return F.when(c.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(c).try_cast("double"))


def line_range(c: Column) -> Column:
    """(first, last) of a text like 11-33 with 1 <= first <= last; else null."""
    a, b = (F.regexp_extract(c, r"^\s*(\d+)\s*-\s*(\d+)\s*$", k).try_cast("int") for k in (1, 2))
    return F.when((a >= 1) & (b >= a), F.struct(a.alias("first"), b.alias("last")))


def http_class(status: Column, retryable: tuple[int, ...] = (408, 425, 429, 500, 502, 503, 504)) -> Column:
    """Null for a success; else whether asking again may help."""
    return F.when((status >= 200) & (status < 300), F.lit(None).cast("string")).when(status.isin(*retryable), "RETRYABLE_FAILURE").when((status >= 400) & (status < 500), "PERMANENT_QUERY_REJECTED").otherwise("RETRYABLE_FAILURE")


def backoff(attempt: Column, base: float, cap: float) -> Column:
    """Seconds before the next attempt, without jitter."""
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))


def query_fingerprint(endpoint: Column, query: Column) -> Column:
    return F.sha2(F.concat(endpoint, F.lit("\n"), query).cast("binary"), 256)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with microseconds where there are any, and the offset of UTC."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))
