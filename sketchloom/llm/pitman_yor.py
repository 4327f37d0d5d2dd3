"""Language-model scoring with a hierarchical Pitman-Yor model.

Tokens are the words of a text, A-Z lower-cased, and one end.  Every word before (or the
start of a text) is a context with a restaurant of its own.  That restaurant draws from the
one of its class (the low five bits of the word's last byte, or the start), which all words
of that ending share; the classes draw from the restaurant of all words, and that one from
a uniform distribution over the training vocabulary and one unseen word.  So the whole
table of (word before, word) pairs is counted and seated.  A restaurant's tables are the
customers of the one above.  Seating is sampled by sweeps: each sweep seats every word's
customers anew, restaurant by restaurant, given the probabilities of the word one level up
and all restaurants' tables in the sweep before.  Words are independent within a sweep, so
a sweep is one pass over the table of counts; between sweeps only the totals of the 34
upper restaurants and the contexts with a second table for some word reach the driver.
Predictive probabilities are averaged over the sweeps after the first.

Contexts are numbers: 59 hash bits and the class, so that two contexts of a class are taken
for one only if their hashes agree.  Tokens are told apart by their bytes.

Scoring: texts are cut into blocks, and a block sends each different pair once to the
table of counts, by the bucket of its word.  What a context adds (its customers and
different words) is looked up in a table of the ``table_words`` most frequent contexts
(their number is counted, not assumed); for other contexts the bucket of the context's own
word tells the block, which then scores those pairs.

Defined cases: a null or empty text is one end; with no training document N = 0 and every
token is unseen; repeated rows are scored one by one; an empty table gives an empty
result; extra columns are ignored; a null id counts as the text '' in its fold.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
from contextlib import suppress
from dataclasses import dataclass
from hashlib import blake2b
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, durable, join_checked, stored

END = b"\n"  # no word holds white space
BEFORE = b""  # what stands before the first token
START = 32
CONTEXTS = 33  # classes
START_ID = -1
SEATED_PAIRS = 500_000  # of the words that are seated at once
MULTIPLIER, LONG_WORD = np.uint64(0x9E3779B97F4A7C15), 64
BLOCK_BYTES, BLOCK_DOCS = 32 << 20, 32_000


@dataclass(frozen=True)
class PitmanYor:
    discount: float = 0.7
    strength: float = 20.0
    root_discount: float = 0.6
    root_strength: float = 100.0
    sweeps: int = 4
    burn_in: int = 1
    table_words: int = 150_000
    seed: int = 7
    word_discount: float = 0.75
    word_strength: float = 1.0


def _released(run):
    """``run`` for mapInArrow, after which the worker gives free memory back: idle workers stay alive beside busy ones."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def _bytes_of(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, and where each starts and how many it has."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)


def _hashes(words: pa.BinaryArray) -> np.ndarray:
    """64 hash bits of each word."""
    data, starts, sizes = _bytes_of(words)
    h = sizes.astype(np.uint64) * MULTIPLIER
    live = np.arange(len(words))
    for k in range(LONG_WORD):
        live = live[sizes[live] > k]
        if not len(live):
            break
        x = (h[live] ^ data[starts[live] + k]) * MULTIPLIER
        h[live] = x ^ x >> np.uint64(32)
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[k] = int.from_bytes(blake2b(data[starts[k] : starts[k] + sizes[k]].tobytes(), digest_size=8).digest(), "little")
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ h >> np.uint64(33)


def _context_ids(words: pa.BinaryArray, hashes: np.ndarray) -> np.ndarray:
    """59 bits of a hash and the class of each word; START_ID for BEFORE."""
    data, starts, sizes = _bytes_of(words)
    ids = np.full(len(words), START_ID, np.int64)
    some = np.flatnonzero(sizes)
    ids[some] = hashes.view(np.int64)[some] & ~31 | data[starts[some] + sizes[some] - 1] & 31
    return ids


def context_id(word: bytes) -> int:
    words = pa.array([word], pa.binary())
    return int(_context_ids(words, _hashes(words))[0])


def classes(contexts: np.ndarray) -> np.ndarray:
    return np.where(contexts == START_ID, START, contexts & 31)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a word, by bits that its context id has too."""
    return ((hashes.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class Block(NamedTuple):
    """Texts as arrays.  The words, then BEFORE, are numbered bucket by bucket; occurrences are sorted by pair and text."""

    words: pa.BinaryArray
    ids: np.ndarray  # context ids by number
    pairs: np.ndarray  # distinct (number << bits | number of the context), ascending
    bits: int
    ends: np.ndarray  # by pair, where its occurrences start
    text: np.ndarray  # by occurrence, the number of its text
    sizes: np.ndarray  # tokens of each text
    first: np.ndarray  # by word, its first pair
    of_bucket: np.ndarray  # by bucket, its first word

    def parts(self):
        """(bucket, its words, its pairs) for each bucket with words."""
        for k in np.flatnonzero(np.diff(self.of_bucket)).tolist():
            lo, hi = int(self.of_bucket[k]), int(self.of_bucket[k + 1])
            yield k, slice(lo, hi), slice(int(self.first[lo]), int(self.first[hi]))


def block_of(texts: pa.Array, buckets: int) -> Block:
    """Tokens are the words of a text, A-Z lower-cased, and END; the context of each is the word before, or BEFORE."""
    texts = pc.fill_null(texts, b"")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, ends = split.flatten(), np.asarray(split.offsets).astype(np.int64)
    full = np.asarray(pc.binary_length(words)) > 0  # white space at an end of a text leaves an empty word
    ends = np.concatenate(([0], np.cumsum(full)))[ends - ends[0]]
    coded = words.filter(pa.array(full)).dictionary_encode()
    del texts, split, words, full
    words = pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary.view(pa.binary())])
    hashes = _hashes(words)
    of = _bucket(hashes, buckets)
    order = np.argsort(of, kind="stable")
    words, ids, of = words.take(pa.array(order)), np.append(_context_ids(words, hashes)[order], START_ID), of[order]
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    sizes = np.diff(ends) + 1
    last = np.cumsum(sizes) - 1
    flat = np.full(sizes.sum(), number[0], np.int32)
    inner = np.ones(len(flat), bool)
    inner[last] = False
    flat[inner] = number.astype(np.int32)[1:][np.asarray(coded.indices)]
    del inner, coded
    bits, text_bits = int(len(words)).bit_length(), max(1, int(len(sizes) - 1).bit_length())
    keys = flat.astype(np.int64) << bits
    keys[1:] |= flat[:-1]
    starts = np.concatenate(([0], last[:-1] + 1))
    keys[starts] = flat[starts].astype(np.int64) << bits | len(words)  # what stands before a text is BEFORE
    del flat
    keys <<= text_bits  # at most 24 bits for a word and 15 for a text, or one text
    keys |= np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    keys.sort()
    text = (keys & (1 << text_bits) - 1).astype(np.int32)
    keys >>= text_bits
    at, _ = _runs(keys)
    pairs = keys[at]
    first, _ = _runs(pairs >> bits)
    return Block(words, ids, pairs, bits, np.append(at, len(keys)), text, sizes, np.append(first, len(pairs)), np.searchsorted(of, np.arange(buckets + 1)))


def _blocks(batches):
    """Rows of the batches (the last column holds the texts) in tables of at most BLOCK_BYTES of text, or of one row, and BLOCK_DOCS rows."""
    held, size, rows = [], 0, 0
    for batch in batches:
        ends = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)).astype(np.int64))))
        lo = 0
        while lo < batch.num_rows:
            hi = min(int(np.searchsorted(ends, ends[lo] + BLOCK_BYTES - size, "right")) - 1, lo + BLOCK_DOCS - rows, batch.num_rows)
            if hi <= lo and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, rows = [], 0, 0
                continue
            hi = max(hi, lo + 1)
            held.append(batch.slice(lo, hi - lo))
            size, rows, lo = size + int(ends[hi] - ends[lo]), rows + hi - lo, hi
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, k: int) -> pa.Array:
    return pa.concat_arrays(table.column(k).chunks)


def _longs(column: pa.BinaryArray) -> np.ndarray:
    """The whole numbers of all rows of a column that ``_rows`` has made, one after another."""
    data, starts, sizes = _bytes_of(column)
    return data[starts[0] : starts[-1] + sizes[-1]].view(np.int64) if len(column) else np.zeros(0, np.int64)


def _rows(values: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Rows of so many whole numbers, as bytes: the JVM copies them in one piece."""
    ends = np.concatenate(([0], np.cumsum(sizes) * 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values, np.int64))])


def _larger(batches, pairs: int, column: int):
    """Batches put together until a column that ``_rows`` has made holds so many numbers."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += int(_lengths(batch.column(column)).sum())
        if size >= pairs:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _lengths(column: pa.BinaryArray) -> np.ndarray:
    return _bytes_of(column)[2] // 8


def _lists(values: np.ndarray, sizes: np.ndarray, kind=None) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _sizes(column: pa.ListArray) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    n = len(sorted_values)
    starts = np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), sorted_values[1:] != sorted_values[:-1])))
    return starts, np.diff(np.concatenate((starts, [n])))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def count_pairs(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(token, ctx, n): one row for each distinct token of ``text`` (binary), contexts ascending; ctx and n as bytes.

    Counted in blocks where the texts are; a block sends each bucket one row, and a bucket is merged at once.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for table in _blocks(batches):
            b = block_of(_column(table, 0), buckets)
            n = np.diff(b.ends)
            for k, words, pairs in b.parts():
                ctx = b.ids[b.pairs[pairs] & (1 << b.bits) - 1]
                data = _pack(_thin_words(b.words[words]), _thin(np.diff(b.first[words.start : words.stop + 1])), ctx, _thin(n[pairs]))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["bucket", "data"])

    def merge(batches):
        parts = [_unpack(data.as_py()) for batch in batches for data in batch.column("data")]
        if not parts:
            return
        coded = pa.concat_arrays([_thick_words(p[0]) for p in parts]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        names = coded.dictionary.take(order)
        number = np.empty(len(names), np.int64)
        number[np.asarray(order)] = np.arange(len(names))
        word = np.repeat(number[np.asarray(coded.indices)], np.concatenate([_thick(p[1]) for p in parts]))
        ctx, n = np.concatenate([p[2] for p in parts]), np.concatenate([_thick(p[3]) for p in parts])
        del parts
        order = np.lexsort((ctx, word))
        ctx, n, word = ctx[order], n[order], word[order]
        starts = np.flatnonzero(np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (word[1:] != word[:-1]))))
        ctx, n, word = ctx[starts], np.add.reduceat(n, starts), word[starts]
        ends = np.searchsorted(word, np.arange(len(names) + 1))
        for k in range(0, len(names), 20_000):
            cut = ends[k : k + 20_001]
            yield pa.RecordBatch.from_arrays([names[k : k + 20_000], *(_rows(v[cut[0] : cut[-1]], np.diff(cut)) for v in (ctx, n))], ["token", "ctx", "n"])

    found = docs.select("text").mapInArrow(_released(run), "bucket int, data binary").repartitionById(buckets, "bucket")
    return found.mapInArrow(_released(merge), "token binary, ctx binary, n binary")


def contexts_of(pairs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(ctx, c, types): customers and different words of every context."""
    buckets = buckets or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def summed(ctx, *values):
        order = np.argsort(ctx)
        starts, _ = _runs(ctx[order])
        return ctx[order][starts], *(np.add.reduceat(v[order], starts) for v in values)

    def run(batches):
        for batch in _larger(batches, 4_000_000, 0):
            ctx = _longs(batch.column(0))
            if len(ctx):
                ctx, c, types = summed(ctx, _longs(batch.column(1)), np.ones(len(ctx), np.int64))
                for bucket, rows in _by_bucket(_bucket(ctx, buckets)):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_pack(ctx[rows], _thin(c[rows]), _thin(types[rows]))], pa.binary())], ["bucket", "data"])

    def merge(batches):
        parts = [_unpack(data.as_py()) for batch in batches for data in batch.column("data")]
        if parts:
            ctx, c, types = summed(np.concatenate([p[0] for p in parts]), *(np.concatenate([_thick(p[k]) for p in parts]) for k in (1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(ctx), pa.array(c), pa.array(types)], ["ctx", "c", "types"])

    found = pairs.select("ctx", "n").mapInArrow(_released(run), "bucket int, data binary").repartitionById(buckets, "bucket")
    return found.mapInArrow(_released(merge), "ctx bigint, c bigint, types bigint")


def frequent_contexts(contexts: DataFrame, m: PitmanYor) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ctx ascending, c, types) of at most ``table_words`` contexts and of the start, which is no word, and the least count of those contexts."""
    least = _frequent(contexts, m)
    table = contexts.where((F.col("c") >= least) | (F.col("ctx") == START_ID)).toArrow()
    ctx, c, types = (np.asarray(table.column(k).combine_chunks() if table.num_rows else pa.array([], pa.int64())) for k in ("ctx", "c", "types"))
    order = np.argsort(ctx)
    return ctx[order], c[order], types[order], least


def with_types(pairs: DataFrame, contexts: DataFrame, table, max_rows: int = 2_000_000) -> DataFrame:
    """``pairs`` with ``types``: for each pair that has occurred twice the different words of its context, as bytes.

    Contexts outside ``table`` with such a pair (customers outnumber the different words) are sent to all workers too if
    they are counted to be at most ``max_rows``; beyond that they are joined.
    """
    frequent, _, frequent_types, least = table
    needed = contexts.where((F.col("c") < least) & (F.col("c") > F.col("types")) & (F.col("ctx") != START_ID)).select("ctx", "types")
    sent = needed.count() <= max_rows
    if sent:
        more = needed.toArrow()
        more = [np.asarray(more.column(k).combine_chunks() if more.num_rows else pa.array([], pa.int64())) for k in range(2)]
        frequent, frequent_types = np.concatenate((frequent, more[0])), np.concatenate((frequent_types, more[1]))
        order = np.argsort(frequent)
        frequent, frequent_types = frequent[order], frequent_types[order]
    known = pairs.sparkSession.sparkContext.broadcast((frequent, frequent_types))

    def twice(batch):
        ctx, n = _longs(batch.column(1)), _longs(batch.column(2))
        some = np.flatnonzero(n > 1)
        return ctx[some], np.repeat(np.arange(batch.num_rows), _lengths(batch.column(1)))[some]

    def others(batches):
        for batch in batches:
            ctx, row = twice(batch)
            rare = ~_find(known.value[0], ctx)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[rare])), pa.array(ctx[rare])], ["token", "ctx"])

    def run(batches):
        for batch in batches:
            ctx, row = twice(batch)
            types = np.zeros(len(ctx), np.int64)
            at, there = _find(known.value[0], ctx)
            types[there] = known.value[1][at[there]]
            some = np.flatnonzero(~there)
            if len(some):
                keys, first = np.unique(np.asarray(batch.column(3).flatten()), return_index=True)
                at, there = _find(keys, ctx[some])
                assert there.all()
                types[some] = np.asarray(batch.column(4).flatten())[first[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _rows(types, np.bincount(row, minlength=batch.num_rows))], ["token", "ctx", "n", "types"])

    rows = pairs.select("token", "ctx", "n")
    if not sent:
        rare = pairs.mapInArrow(_released(others), "token binary, ctx bigint").join(needed, "ctx")
        rare = durable(rare.groupBy("token").agg(F.collect_list("ctx").alias("rare"), F.collect_list("types").alias("rare_types")))
        rows = join_checked(rows, rare, "token", "left").select("token", "ctx", "n", "rare", "rare_types")
    return rows.mapInArrow(_released(run), "token binary, ctx binary, n binary, types binary")


def _drop(df: DataFrame) -> None:
    """Delete a table that ``stored`` has made, and the shuffles of queries that are gone."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _free(spark)


def _free(spark) -> None:
    """Spark removes shuffles when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def count_tokens(docs: DataFrame, m: PitmanYor = PitmanYor()) -> DataFrame:
    """(token, ctx, n, types), the last three as bytes: the table of counts that ``sample`` reads."""
    pairs = stored(count_pairs(docs))
    contexts = stored(contexts_of(pairs))
    counts = stored(with_types(pairs, contexts, frequent_contexts(contexts, m)))
    _drop(pairs)
    return counts


def seat(customers: np.ndarray, new: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables after seating each cell's customers one after another.

    ``new`` is the weight of a new table.  The first 32 customers are drawn one by one,
    later ones in blocks of a sixteenth of those seated.
    """
    tables = np.minimum(customers, 1)
    live = np.flatnonzero(customers > 1)
    c, w, t, seated = customers[live], new[live], np.ones(len(live), np.int64), 1
    while len(live):
        block = 1 if seated < 32 else seated // 16
        p = w / (seated - discount * t + w)
        t = t + (rng.random(len(p)) < p if block == 1 else rng.binomial(np.minimum(block, c - seated), np.clip(p, 0, 1)))
        seated += block
        done = c <= seated
        if done.any():
            tables[live[done]] = t[done]
            live, c, w, t = live[~done], c[~done], w[~done], t[~done]
    return tables


class Totals:
    """Customers and tables of the class restaurants and of the root, and the contexts' further tables, after one sweep.

    A context has one table for each of its different words and ``extra`` = (ctx ascending, tables) more.
    """

    def __init__(self, customers: np.ndarray, tables: np.ndarray, root_tables: float, words: int, extra: tuple[np.ndarray, np.ndarray]):
        self.customers, self.tables, self.root_tables, self.words, self.extra = customers, tables, root_tables, words, extra

    def back_off(self, m: PitmanYor) -> np.ndarray:
        """By class: the weight of the parent."""
        return (m.strength + m.discount * self.tables) / (m.strength + self.customers)

    def root(self, m: PitmanYor, customers, tables):
        """The root's probability of words with so many customers and tables."""
        h = 1 / (self.words + 1)
        return (customers - m.root_discount * tables + (m.root_strength + m.root_discount * self.root_tables) * h) / (m.root_strength + self.tables.sum())

    def of_class(self, m: PitmanYor, cls, customers, tables, root):
        """The probability in their classes of words with so many customers and tables there."""
        return (customers - m.discount * tables) / (m.strength + self.customers[cls]) + self.back_off(m)[cls] * root

    def further(self, contexts: np.ndarray) -> np.ndarray:
        at, there = _find(self.extra[0], contexts)
        return np.where(there, self.extra[1][at] if len(self.extra[1]) else 0, 0)


class Seating(NamedTuple):
    """Seating of a batch of words: by pair, by (word, class) and by word."""

    tables: np.ndarray
    word: np.ndarray
    cls: np.ndarray
    cls_customers: np.ndarray
    cls_tables: np.ndarray
    root_customers: np.ndarray
    root_tables: np.ndarray


def _sweeps(batch, totals: list[Totals], m: PitmanYor):
    """Seating of one batch of words at first, one table each, and after each sweep whose totals before are known."""
    words, sizes = batch.num_rows, _lengths(batch.column(1))
    ctx, n, some_types = (_longs(batch.column(k)) for k in (1, 2, 3))
    cell = np.repeat(np.arange(words), sizes) * CONTEXTS + classes(ctx)
    of_cell = np.bincount(cell, minlength=words * CONTEXTS)
    groups = np.flatnonzero(of_cell)
    group = (np.cumsum(of_cell > 0) - 1)[cell]
    word, cls = groups // CONTEXTS, groups % CONTEXTS
    some = np.flatnonzero(n > 1)  # a customer alone has one table
    some_group, some_ctx, some_n = group[some], ctx[some], n[some]
    alone = of_cell[groups] - np.bincount(some_group, minlength=len(groups))
    first = crc32(batch.column(0)[0].as_py()) if words else 0
    tables = np.ones(len(n), np.int64)
    cls_customers, cls_tables = of_cell[groups], np.ones(len(groups), np.int64)
    root_customers, root_tables = np.bincount(word, minlength=words), np.ones(words, np.int64)
    yield Seating(tables, word, cls, cls_customers, cls_tables, root_customers, root_tables)
    for k, before in enumerate(totals):
        rng = np.random.default_rng((m.seed, k, first, len(n)))
        root = before.root(m, root_customers, root_tables)[word]
        own = before.of_class(m, cls, cls_customers, cls_tables, root)
        weight = (m.word_strength + m.word_discount * (some_types + before.further(some_ctx))) * own[some_group]
        found = seat(some_n, weight, m.word_discount, rng)
        tables = np.ones(len(n), np.int64)
        tables[some] = found
        cls_customers = alone + np.bincount(some_group, found, len(groups)).astype(np.int64)
        cls_tables = seat(cls_customers, (m.strength + m.discount * before.tables)[cls] * root, m.discount, rng)
        root_customers = np.bincount(word, cls_tables, words).astype(np.int64)
        h = (m.root_strength + m.root_discount * before.root_tables) / (before.words + 1)
        root_tables = seat(root_customers, np.full(words, h), m.root_discount, rng)
        yield Seating(tables, word, cls, cls_customers, cls_tables, root_customers, root_tables)


def sample(counts: DataFrame, words: int, m: PitmanYor) -> list[Totals]:
    """Totals before each sweep and after the last; each pass replays the sweeps before it."""
    totals: list[Totals] = []
    for _ in range(m.sweeps + 1):
        known = counts.sparkSession.sparkContext.broadcast(list(totals))

        def run(batches, known=known):
            customers, tables, root = np.zeros(CONTEXTS, np.int64), np.zeros(CONTEXTS, np.int64), 0
            ctx, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for batch in _larger(batches, SEATED_PAIRS, 1):
                *_, s = _sweeps(batch, known.value, m)
                customers += np.bincount(s.cls, s.cls_customers, CONTEXTS).astype(np.int64)
                tables += np.bincount(s.cls, s.cls_tables, CONTEXTS).astype(np.int64)
                root += int(s.root_tables.sum())
                further = np.flatnonzero(s.tables > 1)
                ctx.append(_longs(batch.column(1))[further])
                more.append(s.tables[further] - 1)
            keys, at = np.unique(np.concatenate(ctx), return_inverse=True)
            more = np.bincount(at, np.concatenate(more), len(keys)).astype(np.int64)
            what = np.repeat([0, 1, 2, 3], [CONTEXTS, CONTEXTS, 1, len(keys)]).astype(np.int32)
            key = np.concatenate((np.arange(CONTEXTS), np.arange(CONTEXTS), [0], keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(key), pa.array(np.concatenate((customers, tables, [root], more)))], ["what", "key", "t"])

        sums = counts.select("token", "ctx", "n", "types").mapInArrow(_released(run), "what int, key bigint, t bigint").groupBy("what", "key").agg(F.sum("t").alias("t")).toArrow()
        what, key, t = (sums.column(k).to_numpy().astype(np.int64) for k in range(3))
        of_class = [np.zeros(CONTEXTS), np.zeros(CONTEXTS)]
        for k in (0, 1):
            of_class[k][key[what == k]] = t[what == k]
        further = np.flatnonzero(what == 3)
        further = further[np.argsort(key[further])]
        totals.append(Totals(*of_class, float(t[what == 2].sum()), words, (key[further], t[further])))
    return totals


def predictive(counts: DataFrame, totals: list[Totals], m: PitmanYor) -> DataFrame:
    """(token, c, cls, p, each, p0, ctx, own): probabilities in seen classes, averaged and by kept sweep, the root's by
    kept sweep, and for every context the averaged customers less discounts."""
    known = counts.sparkSession.sparkContext.broadcast(totals)

    def run(batches):
        after = known.value[1:]
        for batch in _larger(batches, SEATED_PAIRS, 1):
            ctx, n = _longs(batch.column(1)), _longs(batch.column(2))
            own, each, p0 = 0.0, [], []
            for k, s in enumerate(_sweeps(batch, known.value[:-1], m)):
                if k > m.burn_in:
                    root = after[k - 1].root(m, s.root_customers, s.root_tables)
                    p0.append(root)
                    each.append(after[k - 1].of_class(m, s.cls, s.cls_customers, s.cls_tables, root[s.word]))
                    own = own + n - m.word_discount * s.tables
            sizes, of_word = _lengths(batch.column(1)), np.bincount(s.word, minlength=batch.num_rows)
            c = np.bincount(np.repeat(np.arange(batch.num_rows), sizes), n, batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(c),
                    _lists(s.cls.astype(np.int32), of_word),
                    _lists(np.mean(each, axis=0).astype(np.float32), of_word),
                    _lists(np.array(each, np.float32).T.ravel(), of_word * len(each)),
                    _lists(np.array(p0).T.ravel(), np.full(batch.num_rows, len(p0))),
                    _lists(ctx, sizes),
                    _lists((own / len(p0)).astype(np.float32), sizes),
                ],
                ["token", "c", "cls", "p", "each", "p0", "ctx", "own"],
            )

    schema = "token binary, c bigint, cls array<int>, p array<float>, each array<float>, p0 array<double>, ctx array<bigint>, own array<float>"
    return counts.select("token", "ctx", "n", "types").mapInArrow(_released(run), schema)


def _frequent(model: DataFrame, m: PitmanYor) -> int:
    """The least count such that at most ``table_words`` words have it or more."""
    step = F.floor(F.log2(F.col("c")) * 8).cast("int")
    left, least = m.table_words, None
    for r in model.groupBy(step.alias("b")).agg(F.count("*").alias("k"), F.min("c").alias("c")).orderBy(F.desc("b")).collect():  # at most 8 * 64 rows
        if r["k"] > left:
            break
        left, least = left - r["k"], r["c"]
    return least if least is not None else 1 << 62


def _thin(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers from 0 in as few bytes as they need, byte by byte, so that they compress."""
    size = next(k for k in (1, 2, 4) if not len(values) or values.max() < 1 << 8 * k)
    return size, np.ascontiguousarray(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()


def _thick(thin: tuple[int, bytes]) -> np.ndarray:
    size, data = thin
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.int64)


def _pack(*values) -> bytes:
    data = pickle.dumps(values, protocol=5)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: bytes):
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd"))


def _thin_words(words: pa.BinaryArray):
    data, starts, sizes = _bytes_of(words)
    return _thin(sizes), data[starts[0] : starts[-1] + sizes[-1]].tobytes() if len(words) else b""


def _thick_words(thin) -> pa.BinaryArray:
    ends = np.concatenate(([0], np.cumsum(_thick(thin[0])))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(thin[1])])


def _by_bucket(buckets: np.ndarray):
    order = np.argsort(buckets, kind="stable")
    starts, length = _runs(buckets[order])
    for start, size in zip(starts.tolist(), length.tolist(), strict=True):
        yield int(buckets[order[start]]), order[start : start + size]


def _take(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows, one after another, and the size of each row."""
    sizes = ends[rows + 1] - ends[rows]
    at = np.repeat(ends[rows] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    return values[at], sizes


MODEL, CONTEXT, ASK, TEXTS = range(4)  # kinds of rows


def _row(bucket: int, kind: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["bucket", "kind", "data"])


def _ask(source: DataFrame, frequent: np.ndarray, kind: str, buckets: int) -> DataFrame:
    """Blocks of texts: rows of kind ASK, by bucket the different tokens with their contexts, how often each occurs and in
    which texts; and one row of kind TEXTS with the block's texts.  A context in ``frequent`` is sent as its place there."""
    shared = source.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        from pyspark import TaskContext

        frequent = shared.value

        for number, table in enumerate(_blocks(batches), TaskContext.get().partitionId() << 24):
            b = block_of(_column(table, 2), buckets)
            runs, empty = np.diff(b.ends), None
            place, there = _find(frequent, b.ids)
            code = np.where(there, place, len(frequent) + np.arange(len(b.ids)))
            ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), _column(table, 0))
            held = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), _column(table, 1))
            fields = pa.schema(
                [("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("ids", ids.type), ("held", held.type), ("sizes", pa.list_(pa.int64()))]
            )
            for k, words, pairs in b.parts():
                own, at = np.unique(code[b.pairs[pairs] & (1 << b.bits) - 1], return_inverse=True)
                rare = b.ids[own[own >= len(frequent)] - len(frequent)]
                of_texts = b.text[b.ends[pairs.start] : b.ends[pairs.stop]]
                data = _pack(words.start, _thin_words(b.words[words]), _thin(np.diff(b.first[words.start : words.stop + 1])), _thin(np.diff(own, prepend=0)), rare, _thin(at), _thin(runs[pairs]), _thin(of_texts))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((k, ASK, number, data, empty, empty, empty), fields, strict=True)], schema=fields)
            texts = [pa.array([number % buckets], pa.int32()), pa.array([TEXTS], pa.int32()), pa.array([number]), pa.array([None], pa.binary()), ids, held, _lists(b.sizes, np.array([len(b.sizes)]))]
            del b, runs
            yield pa.RecordBatch.from_arrays(texts, schema=fields)

    return source.mapInArrow(_released(run), f"bucket int, kind int, block bigint, data binary, ids array<{kind}>, held array<boolean>, sizes array<bigint>")


def _packed(model: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """The model as rows of kind MODEL, by bucket, pairs with contexts in ``frequent`` apart from others."""
    table = model.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        held, size = [], 0

        def out():
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            names = _column(whole, 0)
            flat = {k: np.asarray(whole.column(k).combine_chunks().flatten()) for k in ("cls", "each", "p0", "ctx", "own")}
            ends = {k: np.concatenate(([0], np.cumsum(_sizes(whole.column(k))))) for k in flat}
            c = np.asarray(whole.column("c"))
            for bucket, rows in _by_bucket(_bucket(_hashes(names), buckets)):
                ctx, sizes = _take(flat["ctx"], ends["ctx"], rows)
                cls, of_cls = _take(flat["cls"], ends["cls"], rows)
                each, p0, own = (_take(flat[k], ends[k], rows)[0].astype(np.float32) for k in ("each", "p0", "own"))
                place, there = _find(table.value, ctx)
                known = np.bincount(np.repeat(np.arange(len(rows)), sizes)[there], minlength=len(rows))
                pairs = (_thin(known), _thin(place[there]), own[there], _thin(sizes - known), ctx[~there], own[~there])
                yield _row(bucket, MODEL, _pack(_thin_words(names.take(pa.array(rows))), _thin(c[rows]), _thin(of_cls), _thin(cls), each, p0, pairs))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > 24 << 20:
                yield from out()
                size = 0
        if held:
            yield from out()

    return model.select("token", "c", "cls", "each", "p0", "ctx", "own").mapInArrow(_released(run), "bucket int, kind int, data binary")


def _packed_contexts(contexts: DataFrame, buckets: int) -> DataFrame:
    """Contexts as rows of kind CONTEXT, by the bucket of their word."""

    def run(batches):
        held, size = [], 0

        def out():
            ctx, c, types = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for bucket, rows in _by_bucket(_bucket(ctx, buckets)):
                yield _row(bucket, CONTEXT, _pack(ctx[rows], _thin(c[rows]), _thin(types[rows])))

        for batch in batches:
            held.append(tuple(np.asarray(x) for x in batch.columns))
            size += batch.num_rows
            if size > 1_000_000:
                yield from out()
                size = 0
        if held:
            yield from out()

    return contexts.select("ctx", "c", "types").mapInArrow(_released(run), "bucket int, kind int, data binary")


class _Contexts:
    """The contexts of one bucket."""

    def __init__(self, parts: list):
        ctx = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
        order = np.argsort(ctx)
        self.ctx = ctx[order]
        self.c, self.types = (np.concatenate([np.zeros(0, np.int64), *(_thick(p[k]) for p in parts)])[order] for k in (1, 2))


class _Model:
    """The model's words of one bucket; the row after the last stands for unseen words."""

    def __init__(self, parts: list, unseen: np.ndarray):
        join = lambda values, kind=np.int64: np.concatenate([np.zeros(0, kind), *values])
        self.rows = {t: k for k, t in enumerate(t for p in parts for t in _thick_words(p[0]).to_pylist())}
        rows, kept = len(self.rows), len(unseen)
        self.c = np.append(join(_thick(p[1]) for p in parts).astype(float), 0.0)
        self.slot = np.full((rows + 1) * CONTEXTS, -1, np.int32)
        cls = join(_thick(p[3]) for p in parts)
        self.slot[np.repeat(np.arange(rows), join(_thick(p[2]) for p in parts)) * CONTEXTS + cls] = np.arange(len(cls))
        self.each = join((p[4] for p in parts), np.float32).reshape(len(cls), kept)
        self.p0 = np.vstack([join((p[5] for p in parts), np.float32).reshape(rows, kept), unseen[None, :]])
        # pairs as (row, number of the context), ascending
        pairs = [p[6] for p in parts]
        self.own = [join((p[k] for p in pairs), np.float32) for k in (2, 5)]
        self.rare, at = np.unique(join(p[4] for p in pairs), return_inverse=True)
        self.pairs = [np.repeat(np.arange(rows) << 32, join(_thick(p[k]) for p in pairs)) | v for k, v in ((0, join(_thick(p[1]) for p in pairs)), (3, at))]

    def customers(self, row: np.ndarray, ctx: np.ndarray, rare: int) -> np.ndarray:
        """Averaged customers less discounts of pairs, 0 for unseen ones; ``ctx`` are places in the table, or in ``self.rare``."""
        at, there = _find(self.pairs[rare], row << 32 | ctx)
        return np.where(there, self.own[rare][at], 0) if len(self.own[rare]) else np.zeros(len(row))


def _shared(table, kept: list[Totals]) -> tuple:
    """(places of the contexts of ``table``, ctx ascending, c, types, further by sweep) of the contexts in ``table`` and of all
    with further tables; c is 0 outside ``table``."""
    ctx = np.unique(np.concatenate([table[0], *(t.extra[0] for t in kept)]))
    c, types, further = np.zeros(len(ctx), np.int64), np.zeros(len(ctx), np.int64), np.zeros((len(ctx), len(kept)), np.int32)
    at = np.searchsorted(ctx, table[0])
    c[at], types[at] = table[1], table[2]
    for k, t in enumerate(kept):
        further[np.searchsorted(ctx, t.extra[0]), k] = t.extra[1]
    return at, ctx, c, types, further


def _answer(rows: DataFrame, totals: list[Totals], table, z: float, m: PitmanYor, kind: str) -> DataFrame:
    """For every block and bucket one row: sums of the block's texts; what the context of a pair outside ``table`` decides
    yet; and customers and different words of those of its words that are such contexts.  TEXTS as they come."""
    kept = totals[1 + m.burn_in :]
    weights = np.array([t.back_off(m) for t in kept])  # sweeps x classes
    unseen = np.array([t.root(m, 0, 0) for t in kept])
    shared = rows.sparkSession.sparkContext.broadcast((_shared(table, kept), weights, unseen))

    def run(batches):
        (table, contexts, customers, different, further), weights, unseen = shared.value

        def score(words, rare, start, tokens, sizes, code, ids, at, runs, text):
            tokens, at = _thick_words(tokens), _thick(at)
            row = np.fromiter((words.rows.get(t, len(words.rows)) for t in tokens.to_pylist()), np.int64, len(tokens))
            known = words.c[row]
            known, base, row = (np.repeat(v, _thick(sizes)) for v in (known > 0, np.log10((known + 1) / z), row))
            code = np.cumsum(_thick(code))  # places in the table, then numbers of the words of ``ids``
            known_ctx = len(code) - len(ids)
            own = np.concatenate((contexts[table[code[:known_ctx]]], ids))
            place, there = _find(words.rare, ids)
            ctx = np.concatenate((code[:known_ctx], np.where(there, place, len(words.rare))))[at]
            of_rare = at >= known_ctx
            x = np.empty(len(at))
            for k, some in enumerate((~of_rare, of_rare)):
                x[some] = words.customers(row[some], ctx[some], k)
            cls = classes(own)[at]
            slot = words.slot[row * CONTEXTS + cls]
            p = weights.T[cls] * words.p0[row]
            p[slot >= 0] = words.each[slot[slot >= 0]]
            y = p.mean(axis=1)
            place, there = (np.concatenate(v) for v in zip((table[code[:known_ctx]], np.ones(known_ctx, bool)), _find(contexts, ids), strict=True))
            if len(contexts):
                p *= np.where(there[:, None], further[place], 0)[at]
                x += m.word_discount * p.mean(axis=1)
            del p, slot, cls
            c, types = (np.where(there, v[place], 0) if len(contexts) else np.zeros(len(own), np.int64) for v in (customers, different))
            done = (c > 0)[at]
            score = np.where(done, np.log10(np.maximum((x + (m.word_strength + m.word_discount * types[at]) * y) / (m.word_strength + c[at]), 1e-300)), 0.0)
            runs, text = _thick(runs), _thick(text)
            pair = np.repeat(np.arange(len(at)), runs)
            docs = np.flatnonzero(np.bincount(text))
            known, base, score = (np.bincount(text, v[pair])[docs] for v in (known, base, score))
            left = np.flatnonzero(~done)
            which, at = np.unique(at[left], return_inverse=True)
            numbers = code[which] - len(table)
            place, there = _find(rare.ctx, _context_ids(tokens, _hashes(tokens)))
            return _pack(
                (_thin(docs), _thin(known.astype(np.int64)), base, score.astype(np.float32)),
                (_thin(np.diff(numbers, prepend=0)), _thin(at), x[left].astype(np.float32), y[left].astype(np.float32), _thin(runs[left]), _thin(text[~done[pair]])),
                (start, *(_thin(np.where(there, v[place], 0) if len(v) else np.zeros(len(there), np.int64)) for v in (rare.c, rare.types))),
            )

        bucket, parts, of = None, {}, None
        for batch in batches:
            names = ["block", "data", "ids", "held", "sizes"]
            texts = batch.filter(pc.equal(batch.column("kind"), TEXTS))
            if texts.num_rows:
                yield texts.select(names)
            # by bucket the rows of the model and of contexts come first
            for k in range(batch.num_rows):
                if (this := batch.column("bucket")[k].as_py()) != bucket:
                    bucket, parts, of = this, {MODEL: [], CONTEXT: []}, None
                if (what := batch.column("kind")[k].as_py()) == TEXTS:
                    continue
                data = _unpack(batch.column("data")[k].as_py())
                if what != ASK:
                    parts[what].append(data)
                    continue
                if of is None:
                    of, parts = (_Model(parts[MODEL], unseen), _Contexts(parts[CONTEXT])), {}
                row = [batch.column("block").slice(k, 1), pa.array([score(*of, *data)], pa.binary()), *(pa.nulls(1, batch.column(c).type) for c in names[2:])]
                yield pa.RecordBatch.from_arrays(row, names)

    return rows.mapInArrow(_released(run), f"block bigint, data binary, ids array<{kind}>, held array<boolean>, sizes array<bigint>")


def _collect(answers: DataFrame, n: int, m: PitmanYor, kind: str) -> DataFrame:
    """The rows of each block's texts with their sums; pairs with contexts outside the table are scored here."""

    def run(batches):
        texts, held = None, []

        def out():
            sizes = np.asarray(texts[2])
            known, base, own = np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(len(sizes))
            parts = [_unpack(data) for data in held]
            of_words = [(start, _thick(c), _thick(types)) for _, _, (start, c, types) in parts]
            # by number of the word; an unlearned context leaves all to its class
            customers, types = np.zeros((2, 1 + max(start + len(c) for start, c, _ in of_words)), np.int64)
            for start, c, t in of_words:
                customers[start : start + len(c)], types[start : start + len(c)] = c, t
            for (docs, k, b, o), (numbers, at, x, y, runs, text), _ in parts:
                docs = _thick(docs)
                known[docs] += _thick(k)
                base[docs] += b
                own[docs] += o
                ctx = np.cumsum(_thick(numbers))[_thick(at)]
                y = y.astype(float)
                p = np.where(customers[ctx] > 0, (x + (m.word_strength + m.word_discount * types[ctx]) * y) / (m.word_strength + customers[ctx]), y)
                own += np.bincount(_thick(text), np.repeat(np.log10(np.maximum(p, 1e-300)), _thick(runs)), len(sizes))
            return pa.RecordBatch.from_arrays(
                [texts[0], texts[1], texts[2], pa.array(known), pa.array(np.full(len(sizes), n, np.int64)), pa.array(base), pa.array(own)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        block = None
        for batch in batches:
            for k, of in enumerate(batch.column("block").to_pylist()):
                if of != block:
                    if block is not None:
                        yield out()
                    block, held = of, []
                if (data := batch.column("data")[k]).is_valid:
                    held.append(data.as_py())
                else:
                    texts = [batch.column(c)[k].values for c in ("ids", "held", "sizes")]
        if block is not None:
            yield out()

    sorted_ = answers.repartition("block").sortWithinPartitions("block")
    return sorted_.mapInArrow(_released(run), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score_documents(docs: DataFrame, m: PitmanYor = PitmanYor(), folds: int = 7, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    held = crc_remainder(F.col("doc_id"), folds) == held_fold
    source = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    pairs = stored(count_pairs(source.where(~F.col("held_out"))))
    contexts = stored(contexts_of(pairs))
    table = frequent_contexts(contexts, m)
    counts = stored(with_types(pairs, contexts, table))
    _drop(pairs)
    v, whole = counts.count(), contexts.agg(F.sum("c").alias("n"), F.sum("types").alias("pairs")).first()
    n = whole["n"] or 0
    totals = sample(counts, v, m)
    buckets = max(12, (whole["pairs"] or 0) // 1_000_000)  # a bucket's pairs are held at once
    rare = contexts.where(F.col("c") < table[3])
    parts = (_packed(predictive(counts, totals, m), table[0], buckets), _packed_contexts(rare, buckets))
    rows = _ask(source, table[0], kind, buckets)
    for part in parts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    _free(docs.sparkSession)
    rows = rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    answers = stored(_answer(rows, totals, table, float(n + v + 1), m, kind))
    _drop(counts)
    _drop(contexts)
    return _collect(answers, n, m, kind)


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, perplexity): 10 to the mean negative log10 probability of a token."""
    return scores.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))

