"""SimHash near-duplicates: pigeonhole blocks, joined and verified by Hamming distance.

A document's fingerprint has a bit for each of the 64 bit places, set if over half of its
shingle hashes have it set.  The 64 bits are cut into four blocks of 16: fingerprints that
differ in at most two bits agree in at least two whole blocks, so each distinct
fingerprint is filed under its six pairs of blocks.  Small files are self-joined and
verified.  A file of more than ``file_rows`` distinct fingerprints (a huge group of near
copies) is linked exactly without pairs: each fingerprint is sent to itself and its 32
one-bit neighbours outside the file's bits; two fingerprints at distance two or less meet
at one of these, at most 33 meet at one place, and all that meet are within distance two.
Links are closed to components by contraction.

Copies collapse before the join: only distinct fingerprints are compared.

Defined cases: a null or empty text has fingerprint zero, linked like any other; null ids
take part but are never a component's id (null if it has no other); repeated rows each get
a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, join_checked, let, lower_ascii, stored, unused, words_of
from .components import connected_components
from .decontam import shingle_hashes

BLOCK = 16


@dataclass(frozen=True)
class SimHash:
    shingle: int = 3
    #: Files of more fingerprints than this are linked by neighbours instead of pairs.
    file_rows: int = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The six pairs of blocks: mask of the bits that agree, and the bits outside it.
_MASKS = [sum(((1 << BLOCK) - 1) << (BLOCK * b) for b in two) for two in combinations(range(4), 2)]
_FREE = [[0] + [1 << k for k in range(64) if not m >> k & 1] for m in _MASKS]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or b"").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, 42) for p in parts], dtype=">u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, columns: list, params: SimHash = SimHash()) -> DataFrame:
    """``columns`` (other than binary ``text``) and the signed fingerprint ``fp``."""
    source = docs.select(*columns, F.col("text").cast("binary").alias("_text"))
    width = params.shingle

    def run(batches):
        for batch in batches:
            own = [_signed(fingerprint(t.as_py(), width)) for t in batch.column(len(batch.schema) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.int64())], [*batch.schema.names[:-1], "fp"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:-1])
    return source.mapInArrow(run, f"{kinds}, fp bigint")


def links(fps: DataFrame, params: SimHash = SimHash()) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints ``fp`` at two or fewer differing bits."""
    filed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in _MASKS))).alias("k", "key"))
    sizes = filed.groupBy("k", "key").count().where("count > 1")
    shared = durable(filed.join(sizes, ["k", "key"]))
    small = shared.where(F.col("count") <= params.file_rows)
    other = small.select("k", "key", F.col("fp").alias("v"))
    pairs = small.select("k", "key", F.col("fp").alias("u")).join(other, ["k", "key"]).where("u < v and bit_count(u ^ v) <= 2").select("u", "v")
    flips = F.array(*(F.array(*(F.lit(_signed(x)) for x in free)) for free in _FREE))
    near = shared.where(F.col("count") > params.file_rows).select("k", "fp", F.explode(flips[F.col("k")]).alias("flip"))
    meets = near.groupBy("k", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).agg(F.min("fp").alias("u"), F.collect_set("fp").alias("all"))
    stars = meets.where("size(all) > 1").select("u", F.explode("all").alias("v")).where("u != v")
    return pairs.union(stars)


def components(digest: DataFrame, id_column: str, params: SimHash = SimHash()) -> DataFrame:
    """(fp, component_id, first_id): the smallest id of each fingerprint's component and of its own rows."""
    own = durable(digest.groupBy("fp").agg(F.min(id_column).alias("first_id")))
    roots = connected_components(links(own.select("fp"), params)).select(F.col("node").alias("fp"), "root")
    rooted = durable(own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id", "first_id")


def near_duplicates(docs: DataFrame, params: SimHash = SimHash()) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    digest = durable(fingerprints(docs, ["doc_id"], params))
    classes = durable(components(digest, "doc_id", params).select("fp", "component_id"))
    named = join_checked(digest, classes, "fp", "left")
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class Near:
    """Near copies: a five-word similarity (Jaccard) of ``percent`` % or more of distinct shingles.

    A text's wide fingerprint is ``blocks`` x ``rows`` MinHash values, cut into blocks that are
    hashed to 64 bits.  At a similarity of 0.8 a block agrees with a chance of 0.8 ** 5, so two
    near copies share none of 40 blocks once in 8 million pairs; texts of a similarity of 0.3
    share one once in ten, whatever the number of texts.
    """

    shingle: int = 5
    percent: int = 80
    blocks: int = 40
    rows: int = 5
    #: Pairs whose 192 MinHash bits differ in more places go unverified: at a similarity of 0.8
    #: each differs with a chance of 0.1, so more than 44 do once in 10 million pairs.
    apart_bits: int = 44
    #: Within files the ``sample`` least hashes of both texts are compared first: whole sets up
    #: to that size, else a sample that must show ``percent`` less ``doubt`` (5 deviations).
    sample: int = 256
    doubt: int = 13


_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BITS = 192


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``count`` hash functions."""
    times = np.array([((2 * k + 3) * _ODD * _ODD) % (1 << 64) | 1 for k in range(count)], np.uint64)
    return times, np.array([(k * k + 5) * _ODD % (1 << 64) for k in range(count)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The hashes of a text's distinct shingles in ascending order; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    parts = [b" ".join(words)] if len(words) < width else set(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p, 42) for p in parts], np.uint64))


def minhash(own: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The least of the set's hashes by each function, in memory bounded for sets of any size."""
    least = np.full(len(times), (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), 256):
        x = own[at : at + 256, None] * times
        x += plus
        x ^= x >> np.uint64(29)
        x *= _MIX
        least = np.minimum(least, x.min(axis=0))
    return least


def blocks_of(least: np.ndarray, near: Near) -> np.ndarray:
    """One key for each block of ``rows`` values; the block's number is part of it."""
    parts = least[: near.blocks * near.rows].reshape(near.blocks, near.rows)
    key = np.arange(near.blocks, dtype=np.uint64)
    for k in range(near.rows):
        key = _mixed((key ^ parts[:, k]) * np.uint64(_ODD) + np.uint64(k + 1))
    return key.view(np.int64)


def digests(docs: DataFrame, columns: list[str], near: Near, params: SimHash) -> DataFrame:
    """``columns``, the fingerprint ``fp``, and of the set of shingles: its hash ``node``, size ``n``, MinHash bits ``s0`` to ``s2`` and blocks."""
    source = docs.select(*columns, F.col("text").cast("binary").alias("_text"))
    narrow, width = params.shingle, near.shingle

    def run(batches):
        times, plus = _factors(max(_BITS, near.blocks * near.rows))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for whole in batches:
            for start in range(0, max(1, whole.num_rows), 1000):
                batch = whole.slice(start, 1000)
                rows = []
                for t in batch.column(len(batch.schema) - 1):
                    text = t.as_py()
                    own = shingle_set(text, width)
                    least = minhash(own, times, plus)
                    bits = np.packbits((least[:_BITS] >> np.uint64(32)).astype(np.uint8) & 1, bitorder="little").view(np.int64)
                    rows.append((_signed(fingerprint(text, narrow)), _signed(xxhash.xxh64_intdigest(own.tobytes(), 42)), len(own), *bits.tolist(), blocks_of(least, near)))
                arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], "fp", "node", "n", "s0", "s1", "s2", "blocks"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:-1])
    return source.mapInArrow(run, f"{kinds}, fp bigint, node bigint, n int, s0 bigint, s1 bigint, s2 bigint, blocks array<bigint>")


def near_links(docs: DataFrame, digest: DataFrame, near: Near) -> DataFrame:
    """Edges (u, v) that connect all nodes (sets of shingles) whose texts are near copies.

    ``digest`` has doc_id, tag and what ``digests`` adds.  Nodes that share a block are in one
    file.  First a file's nodes are compared with two of them, its hubs, and what is verified
    becomes groups.  Then all nodes outside the group of a file's first hub are compared with
    every node of another group, a pair only in the first block that it shares and inside the
    join, so that only likely links come out; pairs within the hub's group, however large,
    are never made.
    """
    own = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tag")).alias("own")
    nodes = durable(digest.groupBy("node").agg(*(F.first(c).alias(c) for c in (*_MARKS, "blocks")), own))
    filed = nodes.select("node", F.posexplode("blocks").alias("block", "key"))
    rank = F.struct(F.xxhash64("key", "node").alias("h"), "node")  # another hub in every file
    sizes = filed.groupBy("key").agg(F.min(rank)["node"].alias("hub"), F.max(rank)["node"].alias("hub2")).where("hub != hub2")
    shared = durable(filed.join(sizes, "key"))
    mark = lambda end: nodes.select(*(F.col(c).alias(f"{c}_{end}") for c in ("node", *_MARKS)))
    stars = shared.select("node", "hub").union(shared.select("node", "hub2")).where("node != hub").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
    stars = stars.join(mark("u"), F.col("u") == F.col("node_u")).join(mark("v"), F.col("v") == F.col("node_v")).where(_close(near))
    stars = durable(stars.select("u", "v"))
    sets = _sets(docs, nodes, shared.select("node").distinct(), near)
    found = durable(_verified(stars, sets, near))
    roots = durable(connected_components(found))
    root_of = lambda c, name: roots.select(F.col("node").alias(c), F.col("root").alias(name))
    file = shared.join(root_of("node", "root"), "node", "left").join(root_of("hub", "hub_root"), "hub", "left")
    file = file.select("key", "block", "node", F.coalesce("root", "node").alias("root"), F.coalesce("hub_root", "hub").alias("hub_root"))
    file = durable(file.select("key", "block", "node", "root", (F.col("root") != F.col("hub_root")).alias("other")))
    mixed = file.where("other").select("key").distinct()
    low = sets.select("node", F.slice("s", 1, near.sample).alias("low"))
    file = stored(file.join(mixed, "key", "left_semi").join(nodes.select("node", *_MARKS, "blocks"), "node").join(low, "node"))
    end = lambda df, end: df.select("key", *(F.col(c).alias(f"{c}_{end}") for c in ("block", "node", "root", "other", *_MARKS, "blocks", "low")))
    apart = F.expr("root_u != root_v and (not other_v or node_u < node_v)")
    first = F.col("block_u") == F.array_position(F.zip_with("blocks_u", "blocks_v", lambda a, b: a == b), True) - 1
    rest = end(file.where("other"), "u").join(end(file, "v"), "key").where(apart & _close(near) & first & _likely(near))
    rest = durable(rest.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")))
    return found.union(_verified(rest, sets, near))


_MARKS = ("n", "s0", "s1", "s2")


def _close(near: Near) -> Column:
    """Whether the sizes and MinHash bits of u and v leave them a chance."""
    sizes = 100 * F.least("n_u", "n_v") >= near.percent * F.greatest("n_u", "n_v")
    return sizes & (sum((F.bit_count(F.col(f"{c}_u").bitwiseXOR(F.col(f"{c}_v"))) for c in _MARKS[1:]), F.lit(0)) <= near.apart_bits)


def _likely(near: Near) -> Column:
    """Whether the least hashes of u and v show enough in common; exact for small sets."""
    size = near.sample
    end = lambda c: F.when(F.col(f"n_{c}") > size, F.element_at(f"low_{c}", -1)).otherwise(F.lit((1 << 63) - 1))
    seen = lambda c, to: F.size(F.filter(f"low_{c}", lambda x: x <= to))
    enough = lambda c, all_, percent: 100 * c >= percent * (all_ - c)
    common = F.size(F.array_intersect("low_u", "low_v"))
    sampled = let(common, lambda c: let(F.least(end("u"), end("v")), lambda to: enough(c, seen("u", to) + seen("v", to), near.percent - near.doubt)))
    return F.when(F.greatest("n_u", "n_v") <= size, let(common, lambda c: enough(c, F.col("n_u") + F.col("n_v"), near.percent))).otherwise(sampled)


def _sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame, near: Near) -> DataFrame:
    """(node, s): the shingle hashes of the asked nodes' texts in ascending order."""
    owners = durable(nodes.join(asked, "node").select("node", F.col("own.doc_id").alias("own_id"), F.col("own.tag").alias("own_tag")))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    texts = join_checked(texts, owners, (F.col("tag") == F.col("own_tag")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "inner")
    whole = lambda w: F.when(F.size(w) < near.shingle, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(shingle_hashes(w, near.shingle))
    sets = texts.select("node", F.array_sort(F.array_distinct(let(words_of(lower_ascii(F.col("text"))), whole))).alias("s"))
    return stored(sets.dropDuplicates(["node"]))


def _verified(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs that are near copies by the shingles of their texts."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    common = both.select("u", "v", F.size("a").alias("x"), F.size("b").alias("y"), F.size(F.array_intersect("a", "b")).alias("c"))
    return common.where(100 * F.col("c") >= near.percent * (F.col("x") + F.col("y") - F.col("c"))).select("u", "v")


def near_groups(docs: DataFrame, params: SimHash = SimHash(), near: Near = Near()) -> DataFrame:
    """(doc_id, tag, root) for every row: groups of the contract's links and of near copies together.

    ``tag`` is the text's hash.
    """
    tagged = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    digest = durable(digests(tagged, ["doc_id", "tag"], near, params))
    by_fp = digest.select("fp", "node").distinct()
    first = durable(by_fp.groupBy("fp").agg(F.min("node").alias("rep")))
    same = by_fp.join(first, "fp").where("node != rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    tight = links(first.select("fp"), params)
    tight = tight.join(first.select(F.col("fp").alias("u"), F.col("rep").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("rep").alias("b")), "v")
    edges = tight.select(F.col("a").alias("u"), F.col("b").alias("v")).union(same).union(near_links(docs, digest, near))
    roots = durable(connected_components(edges).distinct())
    named = join_checked(digest.select("doc_id", "tag", "node"), roots, "node", "left")
    return durable(named.select("doc_id", "tag", F.coalesce("root", "node").alias("root")))


def keep_one(docs: DataFrame, params: SimHash = SimHash(), near: Near = Near()) -> DataFrame:
    """One document of each group of ``near_groups`` (least id, then least text hash); columns unchanged.

    Only ids and hashes are grouped; texts are shuffled only if the rows to drop are too
    many to broadcast, or for repeated rows.
    """
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tag")
    keys = durable(near_groups(docs, params, near).groupBy("root", "doc_id", "tag").agg(F.count("*").alias("n")))
    best = durable(keys.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("rows")).where("rows > 1").select("root", "best"))
    chosen = F.col("best").isNull() | order.eqNullSafe(F.col("best"))
    marked = durable(join_checked(keys, best, "root", "left").select("doc_id", "tag", "n", chosen.alias("chosen")))
    a, b = unused(docs, "drop_id"), unused(docs, "drop_tag")
    key_of = lambda d: (F.xxhash64(docs["text"]) == d[b]) & docs["doc_id"].eqNullSafe(d[a])
    gone = marked.where(~F.col("chosen")).select(F.col("doc_id").alias(a), F.col("tag").alias(b))
    twice = marked.where(F.col("chosen") & (F.col("n") > 1)).select(F.col("doc_id").alias(a), F.col("tag").alias(b))
    if twice.isEmpty():
        return join_checked(docs, gone, key_of(gone), "left_anti")
    both = gone.union(twice)
    single = join_checked(docs, both, key_of(both), "left_anti")
    return single.unionByName(join_checked(docs, twice, key_of(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
