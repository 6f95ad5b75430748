"""What a fact is worth in a question: whether it may be used at all, how it reads, and in which order facts are preferred."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


@dataclass(frozen=True)
class QualityPolicy:
    """rejected: predicates and why. tiers: by predicate, and by (predicate, direction), which goes first. templates: (predicate, direction) to the template's name.

    The rest are rules on objects: namespaces of entities (none: any), hosts of archives, endings of media files, bounds of a label's length, the
    share of digits from which a label is an identifier, objects that are let in whatever the rules; and the least
    length of a word, of a hard and of a soft prefix for leaks.
    """

    rejected: dict[str, str] = field(default_factory=dict)
    tiers: dict[str, int] = field(default_factory=dict)
    tiers_by_direction: dict[tuple[str, str], int] = field(default_factory=dict)
    tier: int = 3
    templates: dict[tuple[str, str], str] = field(default_factory=dict)
    namespaces: tuple[str, ...] = ()
    archives: tuple[str, ...] = ()
    media: tuple[str, ...] = ()
    shortest: int = 1
    longest: int = 120
    digits: float = 0.6
    allowed: tuple[str, ...] = ()
    word: int = 4
    hard: int = 5
    soft: int = 4

    @classmethod
    def from_json(cls, text: str) -> QualityPolicy:
        """A policy file: hard_reject_predicates, pedagogical_tier with its default and by key, templates, object_policy, leakage_policy. Missing parts have this class's defaults; an unknown version or a tier that isn't 1 to 3 is an error."""
        p = json.loads(text)
        if not str(p.get("version", "")).startswith("predicate_policy/"):
            raise ValueError(f"not a predicate policy: version {p.get('version')!r}")
        o, k = p.get("object_policy", {}), p.get("leakage_policy", {})
        keyed = {(x["predicate_uri"], x["direction"]): x for x in p.get("templates", [])}
        if len(keyed) != len(p.get("templates", [])):
            raise ValueError("a predicate and direction has two templates")
        by = {(x["predicate_uri"], x["direction"]): x["tier"] for x in p.get("pedagogical_tier_by_key", [])}
        if not {*p.get("pedagogical_tier", {}).values(), *by.values()} <= {1, 2, 3}:
            raise ValueError("tiers are 1, 2 and 3")
        return cls(
            rejected=p.get("hard_reject_predicates", {}), tiers=p.get("pedagogical_tier", {}), tiers_by_direction=by, tier=p.get("pedagogical_tier_default", 3), templates={at: x["template_id"] for at, x in keyed.items()},
            namespaces=tuple(o.get("resource_namespace_prefixes", ())), archives=tuple(o.get("web_archive_hosts", ())), media=tuple(o.get("media_file_suffixes", ())), shortest=o.get("minimum_object_label_length", 1),
            longest=o.get("maximum_object_label_length", 120), digits=o.get("machine_identifier_minimum_digit_ratio", 0.6), allowed=tuple(o.get("educational_allowlist", ())),
            word=k.get("minimum_token_length", 4), hard=k.get("minimum_prefix_length", 5), soft=k.get("soft_prefix_length", 4),
        )

    @classmethod
    def read(cls, spark, path: str) -> QualityPolicy:
        """From a file that Spark's readers reach."""
        return cls.from_json("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def object_reason(uri: Column, label: Column, policy: QualityPolicy) -> Column:
    """Why an object of this label can't be used, the first rule that holds; null where it can."""
    host = F.lower(F.regexp_extract(uri, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    name = F.lower(X.local_name(uri))
    any_of = lambda tests: F.coalesce(*[F.when(t, True) for t in tests], F.lit(False)) if tests else F.lit(False)
    known = F.regexp_replace(label, r"[^\p{L}\p{N}]", "")
    digits = F.char_length(F.regexp_replace(known, r"[^\p{Nd}¹²³⁰⁴-⁹₀-₉]", ""))
    rules = [
        (any_of([(host == h) | host.endswith("." + h) for h in policy.archives]), "OBJECT_WEB_ARCHIVE_URL"),
        (~any_of([uri.startswith(n) for n in policy.namespaces]) if policy.namespaces else F.lit(False), "OBJECT_EXTERNAL_URL"),
        (any_of([name.endswith(s) for s in policy.media]), "OBJECT_MEDIA_FILE"),
        (F.char_length(label) < policy.shortest, "OBJECT_EMPTY_LABEL"),
        (F.char_length(label) > policy.longest, "OBJECT_LABEL_TOO_LONG"),
        ((known != "") & (digits / F.char_length(known) >= policy.digits), "OBJECT_MACHINE_IDENTIFIER"),
    ]
    reason = F.coalesce(*[F.when(c, F.lit(name)) for c, name in rules])
    return F.when(uri.isin(*policy.allowed), None).otherwise(reason) if policy.allowed else reason


def assess(facts: DataFrame, policy: QualityPolicy, ascii_only: bool = False) -> DataFrame:
    """`facts` (answer, predicate, direction, object, ..) with label, tier, template, verbal, soft, label_length, words, reasons and eligible.

    reasons: why the fact can't be used, by predicate, by object, and by the answer's name standing in the object's; eligible if there
    are none. Tables of the policy are a file's, so they are broadcast. Rows are judged alone; repeats stay repeats.
    """
    spark = facts.sparkSession
    small = lambda rows, columns: F.broadcast(spark.createDataFrame(rows, columns))
    out = facts.join(small(list(policy.rejected.items()), "predicate string, rejected string"), "predicate", "left")
    out = out.join(small(list(policy.tiers.items()), "predicate string, wide_tier int"), "predicate", "left")
    out = out.join(small([(*k, v) for k, v in policy.tiers_by_direction.items()], "predicate string, direction string, own_tier int"), ["predicate", "direction"], "left")
    out = out.join(small([(*k, v) for k, v in policy.templates.items()], "predicate string, direction string, template string"), ["predicate", "direction"], "left")
    leak = X.leakage(F.col("answer"), F.col("object"), policy.word, policy.hard, policy.soft, ascii_only)
    out = out.withColumns({"leak": leak["verdict"], "label": X.display_label(F.col("object"), ascii_only)})
    reasons = F.array_compact(F.array("rejected", object_reason(F.col("object"), F.col("label"), policy), F.when(F.col("leak") == "HARD", "ANSWER_LEXICAL_LEAK")))
    out = out.select(*facts.columns, "label", F.coalesce("own_tier", "wide_tier", F.lit(policy.tier)).alias("tier"), F.coalesce("template", F.lit("UNKNOWN")).alias("template"), F.col("template").isNotNull().alias("verbal"),
                     (F.col("leak") == "SOFT").alias("soft"), F.char_length("label").alias("label_length"), F.size(X.tokens(F.col("object"), 1, ascii_only)).alias("words"), reasons.alias("reasons"))
    return out.withColumn("eligible", F.size("reasons") == 0)


def preference() -> Column:
    """The order of facts by what they alone are: the smallest is the best."""
    return F.struct(F.col("soft").cast("int").alias("soft"), "tier", (~F.col("verbal")).cast("int").alias("unverbal"), "label_length", "words", "predicate", "direction", "object")
