"""Quality rules: per-document rules plus host verdicts with an empirical beta prior.

Every document gets rule figures from built-in functions only.  It fails by too few words,
too many repeated words (the base rules) or too many symbols.  Failures are summed by host
(the ``source`` column), each host's failure rate is shrunk towards the mean of all hosts by
a beta prior fitted with the method of moments, and hosts whose shrunk rate exceeds
``max_host_rate`` are condemned: their other documents are rejected too.

Defined cases: a null or empty text has no words and fails; a null host belongs to no
host and gets no host verdict; repeated rows each count and each get a row; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, join_checked, let, stored, unused, words_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    #: Symbols to words; the method's own rule beside the base rules.
    max_symbol_percent: int = 10
    #: A host is condemned if its shrunk failure rate exceeds this.
    max_host_rate: float = 0.5


def repeat_words(words: Column, window: int) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more.

    Windows are compared by a 64-bit hash within one document.  Texts without any repeated
    window (most) stop after one hash set; others sort (hash, place) once.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.coalesce(F.least(F.lit(window), F.get(places, j + 1) - p), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce((F.get(pairs, j - 1)["h"] == x["h"]) | (F.get(pairs, j + 1)["h"] == x["h"]), F.get(pairs, j - 1)["h"] == x["h"], F.get(pairs, j + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, same), lambda x: x["i"]))

    def of_hashes(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(pairs, lambda s: let(repeated(s), covered)))

    def of_words(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - window)
        return let(F.transform(starts, lambda i: F.xxhash64(*(h[i + k] for k in range(window)))), of_hashes)

    def guarded(h: Column) -> Column:
        return F.when(F.size(h) <= window, 0).otherwise(of_words(h))

    return let(F.transform(words, lambda w: F.xxhash64(w)), guarded).cast("long")


def measures(text: Column, rules: QualityRules = QualityRules()) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
            symbols_of(t).alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w, rules.window).alias("r"))).alias("w"),
        )

    return let(F.coalesce(text, F.lit("")), of_text)


def fails(n_words: Column, n_repeat: Column, rules: QualityRules) -> Column:
    """The base rules."""
    return (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)


def symbols_of(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def noisy(n_words: Column, n_symbols: Column, rules: QualityRules) -> Column:
    return 100 * n_symbols > rules.max_symbol_percent * n_words


def condemned_hosts(digest: DataFrame, rules: QualityRules) -> DataFrame:
    """Hosts (host, host_rate) whose shrunk rate of ``failed`` rows exceeds the limit."""
    hosts = digest.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()  # one row
    m, v = prior["m"] or 0.0, prior["v"] or 0.0
    strength = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6
    shrunk = (F.col("f") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).where(F.col("host_rate") > rules.max_host_rate).select("host", "host_rate")


def quality_verdicts(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document with its figures, ``base_failed`` and ``kept``.

    The figures are computed once and written to the shared folder; the host counts and the
    final join read only that narrow table.
    """
    m = docs.select("doc_id", F.col("source").alias("host"), measures(F.col("text"), rules).alias("m"))
    digest = m.select("doc_id", "host", F.col("m.w.n").alias("n_words"), "m.word_chars", "m.n_symbols", "m.n_dup_lines", F.col("m.w.r").alias("n_repeat_words"))
    digest = digest.withColumn("base_failed", fails(F.col("n_words"), F.col("n_repeat_words"), rules))
    digest = durable(digest.withColumn("failed", F.col("base_failed") | noisy(F.col("n_words"), F.col("n_symbols"), rules)))
    bad = durable(condemned_hosts(digest, rules))
    joined = join_checked(digest, bad, "host", "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("failed") & F.col("host_rate").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass their own rules and whose host is not condemned; columns unchanged.

    Documents are judged once, in one scan that writes them with the verdict to the shared
    folder; host counts read two columns of that table.
    """
    name, flag = unused(docs, "host"), unused(docs, "failed")
    symbols = symbols_of(F.coalesce("text", F.lit("")))
    failed = let(words_of(F.col("text")), lambda w: fails(F.size(w).cast("long"), repeat_words(w, rules.window), rules) | noisy(F.size(w), symbols, rules))
    judged = stored(docs.withColumn(flag, failed))
    bad = durable(condemned_hosts(judged.select(F.col("source").alias("host"), F.col(flag).alias("failed")), rules).select(F.col("host").alias(name)))
    good = judged.where(~F.col(flag)).drop(flag)
    return join_checked(good, bad, good["source"] == bad[name], "left_anti")
