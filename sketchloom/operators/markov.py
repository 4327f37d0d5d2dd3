"""Markov chains of tokens: transitions as an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, LAST = "^", "$"


def pairs(tokens: Column, order: int) -> Column:
    """Array of (current, next): every run of ``order`` tokens and the token after it.

    The array is bound once; an expression in the inner function would be built anew for every place.
    """
    kind = "array<struct<current:array<string>,next:string>>"

    def of_array(t: Column) -> Column:
        one = lambda i: F.struct(F.slice(t, i, F.lit(order)).alias("current"), F.element_at(t, i + order).alias("next"))
        return F.when(F.size(t) > order, F.transform(F.sequence(F.lit(1), F.size(t) - order), one)).otherwise(F.array().cast(kind))

    return F.transform(F.array(tokens), of_array)[0]


def padded(tokens: Column, order: int) -> Column:
    return F.concat(F.array_repeat(F.lit(FIRST), order), tokens, F.array_repeat(F.lit(LAST), order))


def _state(order: int) -> list[str]:
    return [f"_c{j}" for j in range(order)]


def _counted(df: DataFrame, tokens: str, order: int) -> DataFrame:
    """(_c0, ..., next, freq): ``chain`` with a column for each token of the state.

    Only places are exploded and plain columns grouped: an array for each place would be built, hashed and shuffled.
    """
    if order < 1:
        raise ValueError("order must be positive")
    rows = df.where(F.col(tokens).isNotNull()).select(padded(F.col(tokens), order).alias("_t"))
    at = rows.select("_t", F.explode(F.sequence(F.lit(0), F.size("_t") - order - 1)).alias("_i"))
    state = [F.get("_t", F.col("_i") + j).alias(c) for j, c in enumerate(_state(order))]
    return at.select(*state, F.get("_t", F.col("_i") + order).alias("next")).groupBy(*_state(order), "next").agg(F.count("*").alias("freq"))


def chain(df: DataFrame, tokens: str, order: int = 1) -> DataFrame:
    """(current, next, freq): transitions of all token arrays, with start and end padding."""
    return _counted(df, tokens, order).select(F.array(*_state(order)).alias("current"), "next", "freq")


def chain_probabilities(df: DataFrame, tokens: str, order: int = 1) -> DataFrame:
    """``probabilities`` of the ``chain``, without arrays until the end and without sorting the edges."""
    edges = _counted(df, tokens, order)
    names = [f"_t{c}" for c in _state(order)]
    totals = edges.groupBy(*(F.col(c).alias(n) for c, n in zip(_state(order), names, strict=True))).agg(F.sum("freq").alias("total")).hint("shuffle_hash")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(_state(order), names, strict=True)])
    return edges.join(totals, same).select(F.array(*_state(order)).alias("current"), "next", "freq", (F.col("freq") / F.col("total")).alias("p"))


def characters(text: Column) -> Column:
    """The characters of a text as tokens."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def probabilities(edges: DataFrame) -> DataFrame:
    """(current, next, freq, p); totals by an aggregate and a join, so a hot state is no single task's window."""
    totals = edges.groupBy("current").agg(F.sum("freq").alias("total"))
    return edges.join(totals, "current").select("current", "next", "freq", (F.col("freq") / F.col("total")).alias("p"))


def transition_probability(edges: DataFrame, probes: DataFrame, order: int) -> DataFrame:
    """(current, next, p) of probes: 0 for a known state and unseen next, or an unknown state; null if the length is wrong."""
    found = probes.join(probabilities(edges), ["current", "next"], "left")
    return found.select("current", "next", F.when(F.size("current") == order, F.coalesce("p", F.lit(0.0))).alias("p"))


def generate_next(edges: DataFrame, states: DataFrame, seed: int = 0) -> DataFrame:
    """(state_id, current, next): a weighted random successor of each state; unknown states give none.

    Successors are ordered by token and drawn by a hash of ``state_id`` and the seed, so the
    draw is unbiased and can be repeated.
    """
    w = Window.partitionBy("current").orderBy("next")
    cumulative = edges.select("current", "next", F.sum("freq").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("freq").over(Window.partitionBy("current")).alias("total"))
    u = F.xxhash64("state_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    drawn = states.withColumn("u", u).join(cumulative, "current").where(F.col("upto") > F.col("u") * F.col("total"))
    return drawn.groupBy("state_id", "current").agg(F.min_by("next", "upto").alias("next"))


def generate(edges: DataFrame, starts: DataFrame, order: int, steps: int, seed: int = 0) -> DataFrame:
    """(state_id, tokens): ``steps`` draws from each start state, ending at the end mark."""
    text = starts.select("state_id", "current", F.array().cast("array<string>").alias("tokens"), F.lit(False).alias("done"))
    for k in range(steps):
        nxt = generate_next(edges, text.where(~F.col("done")).select("state_id", "current"), seed + k).select("state_id", "next")
        text = text.join(nxt, "state_id", "left").select(
            "state_id",
            F.when(F.col("next").isNotNull(), F.concat(F.slice("current", 2, order), F.array("next"))).otherwise(F.col("current")).alias("current"),
            F.when(F.col("next").isNotNull() & (F.col("next") != LAST), F.array_append("tokens", F.col("next"))).otherwise(F.col("tokens")).alias("tokens"),
            (F.col("done") | F.col("next").isNull() | (F.col("next") == LAST)).alias("done"),
        )
    return text.select("state_id", "tokens")
