"""Quality rules: a bitmask ledger with versioned policies and ablations.

``ledger`` evaluates every rule once and stores one bit per failed rule beside the measurements.
Policies are named sets of rules, applied to the stored bits without touching the texts again;
``ablation`` counts, per rule, the documents that this rule alone rejects. All of it is column
expressions: one narrow pass over the texts, no shuffle, so hot sources and groups of copies do not
matter; the ablation groups by the bits, of which there are few.

Defined cases: a null text has no words; an empty text or one of white space has no words, so it
fails ``min_words``; a null id stays null; repeated rows each get their own row; columns of the
input that are called like a result column are not carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_or_empty

#: Rules in bit order; the bit of a rule never changes, new rules are added at the end.
RULES: dict[str, str] = {
    "min_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "shouting": "n_letters > 0 AND 100 * n_upper > 60 * n_letters",
    "exclamations": "100 * n_bangs > 50 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "most_lines_duplicate": "100 * n_dup_lines > 60 * n_lines",
}
BASE_RULES = ("min_words", "repeated_windows")
#: Versioned policies; a version is never edited once published.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE_RULES,
    "v1": (*BASE_RULES, "symbols", "duplicate_lines"),
    "v2": (*BASE_RULES, "symbols", "duplicate_lines", "shouting", "exclamations", "word_length"),
    # as v2, but duplicate lines count only where they are most of a text
    "v3": (*BASE_RULES, "symbols", "most_lines_duplicate", "shouting", "exclamations", "word_length"),
}
LATEST = "v3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bangs")


def mask(policy: str, policies: dict[str, tuple[str, ...]] = POLICIES, rules: dict[str, str] = RULES) -> int:
    """The bits of a policy's rules."""
    names = list(rules)
    return sum(1 << names.index(r) for r in policies[policy])


def _count(text: Column, other: str) -> Column:
    """Characters left once those of the class ``other`` are gone."""
    return F.length(F.regexp_replace(text, other, "")).cast("long")


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and every measurement of the whole text."""
    t = F.col("__t")
    df = docs.select(*keep, text_or_empty(text).alias("__t"))
    df = df.withColumn("__w", F.filter(F.split(t, f"{SPACE}+"), lambda w: w != ""))
    df = df.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    w, n = F.col("__w"), F.size("__w")
    at = lambda i: F.get(w, i)
    window = lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i"))
    df = df.withColumn("__s", F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))))
    s = F.col("__s")
    twice = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
    df = df.withColumn("__r", F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"])))
    r = F.col("__r")
    covered = F.aggregate(F.transform(r, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(r, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.select(
        *keep,
        n.cast("long").alias("n_words"),
        _count(t, f"{SPACE}+").alias("word_chars"),
        _count(t, r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        _count(t, r"[^\p{L}]+").alias("n_letters"),
        _count(t, r"[^\p{Lu}]+").alias("n_upper"),
        _count(t, r"[^!]+").alias("n_bangs"),
    )


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: dict[str, str] = RULES) -> DataFrame:
    """``keep`` columns, the measurements, and ``fail_bits`` with bit k set if rule k rejects the text."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text, keep).withColumn("fail_bits", bits)


def fails(policy: str, policies: dict[str, tuple[str, ...]] = POLICIES, rules: dict[str, str] = RULES) -> Column:
    """True where the stored bits break a rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, policies, rules)).cast("long")) != 0


def apply_policy(book: DataFrame, policy: str = LATEST, policies: dict[str, tuple[str, ...]] = POLICIES, rules: dict[str, str] = RULES) -> DataFrame:
    """``kept`` and ``policy`` beside the ledger's columns."""
    return book.withColumn("kept", ~fails(policy, policies, rules)).withColumn("policy", F.lit(policy))


def ablation(book: DataFrame, policy: str = LATEST, policies: dict[str, tuple[str, ...]] = POLICIES, rules: dict[str, str] = RULES) -> DataFrame:
    """Per rule of the policy: documents that break it, and those that only it rejects.

    The texts' rows meet as one row per distinct bit pattern before anything is exploded."""
    m = mask(policy, policies, rules)
    seen = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = list(rules)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policies[policy]])
    one = seen.select("bits", "n", F.explode(each).alias("r")).select("bits", "n", "r.rule", "r.bit")
    return one.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
