"""Benchmark decontamination: size-partitioned MinHash containment search.

A short test item lies in a long document if at least ``percent`` % of the item's
distinct word shingles occur there.  Items are partitioned by their number of shingles
into classes [2^k, 2^(k+1)); an item's sketch is its bottom-m MinHash values, with m set
by its class so large that a document which holds ``percent`` % of the shingles must hold
one of the m: the search has no false negatives, however long the document.  Documents
fetch candidate items by sketch hash; candidates are verified by exact containment over
the shingles themselves.

Words are runs of letters and digits, lower-cased.  Items of fewer words than a shingle
are one shingle of all their words and are searched at that width.

Defined cases: null or empty texts and items have no shingles and match nothing; repeated
rows give one link for each distinct (doc_id, item_id) and text; null ids are carried;
an empty table on either side gives no links; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, join_checked, let, unused, words_of


@dataclass(frozen=True)
class Containment:
    shingle: int = 5
    percent: int = 80
    #: Up to so many sketch hashes the index is part of the plan.
    inline_hashes: int = 4000
    #: Items of more characters in their shingles than this are not broadcast.
    broadcast_chars: int = 20_000_000


def tokens(text: Column) -> Column:
    return words_of(F.lower(text), r"[^\p{L}\p{N}]+")


def shingle_hashes(words: Column, width: int) -> Column:
    """One 64-bit hash for each place where ``width`` words stand."""
    every = lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(F.lit(width), *(h[i + k] for k in range(width)))
    )
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= width, every(h)).otherwise(F.array().cast("array<bigint>")))


def _hash_of(width: int):
    """The hash that ``shingle_hashes`` gives a shingle, from the shingle itself."""
    return lambda s: let(F.transform(F.split(s, " "), lambda w: F.xxhash64(w)), lambda h: F.xxhash64(F.lit(width), *(h[k] for k in range(width))))


def shingles(words: Column, width: Column) -> Column:
    """The distinct shingles themselves."""
    every = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
    return F.array_distinct(F.when(F.size(words) >= width, every(words)).otherwise(F.array().cast("array<string>")))


def sketch_items(items: DataFrame, params: Containment) -> DataFrame:
    """(item_id, item_key, width, parts, n, sketch): distinct shingles and bottom-m MinHash of each item."""
    w = items.select("item_id", F.col("text").alias("t"), tokens(F.col("text")).alias("w")).where("size(w) > 0")
    w = w.withColumn("width", F.least(F.size("w"), F.lit(params.shingle)))
    parts = w.select("item_id", F.xxhash64("item_id", "t").alias("item_key"), "width", shingles(F.col("w"), F.col("width")).alias("parts")).distinct()
    by_width = F.lit(None).cast("array<bigint>")
    for width in range(1, params.shingle + 1):
        by_width = F.when(F.col("width") == width, F.transform("parts", _hash_of(width))).otherwise(by_width)
    n = F.size("parts")
    largest = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1  # of the item's class
    m = F.least(n, F.floor(largest * (100 - params.percent) / 100).cast("int") + 1)
    return parts.select("*", n.alias("n"), F.slice(F.sort_array(F.array_distinct(by_width)), F.lit(1), m).alias("sketch"))


def _fetch_in_scan(base: DataFrame, index: DataFrame, hashes) -> DataFrame:
    """(doc_id, doc_tag, t, item_key) of documents and candidates, where the texts are.

    The index is a constant of the plan: a document's hashes are intersected with the filed
    ones, and what is found is looked up.  No row of a document without candidates goes on.
    """
    filed: dict[int, list[int]] = {}
    for r in index.collect():  # at most params.inline_hashes rows
        filed.setdefault(r["h"], []).append(r["item_key"])
    # as SQL text, which is one step for the planner however many there are
    array = lambda values: f"array({', '.join(f'{v}L' for v in values)})"
    known, items = F.expr(array(filed)), F.expr(f"map({', '.join(f'{h}L, {array(keys)}' for h, keys in filed.items())})")
    found = lambda every: F.array_distinct(F.flatten(F.transform(F.array_intersect(every, known), lambda h: F.element_at(items, h))))
    hits = base.select("*", let(tokens(F.col("t")), lambda w: let(hashes(w), found)).alias("keys")).where(F.size("keys") > 0)
    return hits.select("doc_id", "doc_tag", "t", F.explode_outer("keys").alias("item_key"))


def _fetch_by_join(base: DataFrame, index: DataFrame, hashes) -> DataFrame:
    """The same for any number of sketches: hashes join the index, candidates join the texts."""
    probes = base.select("doc_id", "doc_tag", F.explode(let(tokens(F.col("t")), hashes)).alias("h"))
    candidates = durable(join_checked(probes, index, "h", "inner").select("doc_id", "doc_tag", "item_key").distinct())
    c = candidates.select(F.col("doc_id").alias("c_id"), F.col("doc_tag").alias("c_tag"), "item_key")
    pairs = join_checked(base, c, (F.col("doc_tag") == F.col("c_tag")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "inner")
    return pairs.select("doc_id", "doc_tag", "t", "item_key")


def contained_items(docs: DataFrame, items: DataFrame, params: Containment = Containment()) -> DataFrame:
    """Links (doc_id, doc_tag, item_id, n_shingles, n_found, containment), one for each document and item.

    Up to ``inline_hashes`` sketch hashes documents are scanned once and only links are
    shuffled.  Larger item sets are joined: documents are scanned for their hashes and,
    those with candidates, for the verification.  ``doc_tag`` is the text's hash and tells
    rows of one id apart.
    """
    sketched = durable(sketch_items(items, params))
    widths = [r["width"] for r in sketched.select("width").distinct().collect()]  # at most params.shingle
    index = sketched.select("item_key", F.explode("sketch").alias("h")).distinct()
    base = docs.select("doc_id", F.col("text").alias("t"), F.xxhash64("text").alias("doc_tag"))
    hashes = lambda w: F.flatten(F.array(*(shingle_hashes(w, k) for k in widths))) if widths else F.array().cast("array<bigint>")
    fetch = _fetch_in_scan if 0 < index.count() <= params.inline_hashes else _fetch_by_join
    whole = sketched.select("item_key", "item_id", "width", "parts", "n").dropDuplicates(["item_key"])
    small = (whole.agg(F.sum(F.length(F.array_join("parts", " ")))).first()[0] or 0) <= params.broadcast_chars
    pairs = fetch(base, index, hashes).join(F.broadcast(whole) if small else whole, "item_key")
    found = let(tokens(F.col("t")), lambda w: F.size(F.array_intersect(F.col("parts"), shingles(w, F.col("width")))))
    found = pairs.select("doc_id", "doc_tag", "item_id", F.col("n").cast("long").alias("n_shingles"), found.cast("long").alias("n_found"))
    return found.where(100 * F.col("n_found") >= params.percent * F.col("n_shingles")).withColumn("containment", F.col("n_found") / F.col("n_shingles")).distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, params: Containment = Containment()) -> DataFrame:
    """The documents that hold no item; columns unchanged."""
    a, b = unused(docs, "leak_id"), unused(docs, "leak_tag")
    leaks = durable(contained_items(docs, items, params).select(F.col("doc_id").alias(a), F.col("doc_tag").alias(b)).distinct())
    return join_checked(docs, leaks, (F.xxhash64(docs["text"]) == leaks[b]) & docs["doc_id"].eqNullSafe(leaks[a]), "left_anti")
