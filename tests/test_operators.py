"""Synopses, folds, lookups and simulations: accuracy, algebra and literal cases."""

import datetime as dt
import hashlib
import ipaddress
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sketchloom.operators import bloom, cachesim, chunking, countmin, cuckoo, decay, heavy_hitters, hll, markov, networks, prefixes, quantiles, ratelimit, secrets
from sketchloom.sources.tables import load_bytes, load_sketch, save_sketch

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def items(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("element-"), F.col("id")).alias("item"))


# --- sketches -----------------------------------------------------------------------------


@pytest.mark.parametrize("p,n,tolerance", [(10, 1000, 0.08), (12, 10_000, 0.06), (14, 100_000, 0.03)])
def test_hll_accuracy(spark, p, n, tolerance):
    got = hll.estimate(hll.registers(items(spark, n), "item", p), p).first().estimate
    assert abs(got - n) <= tolerance * n


def test_hll_algebra(spark, tmp_path):
    a, b = (hll.registers(items(spark, 500, s), "item") for s in (0, 400))
    rows = lambda d: sorted(map(tuple, d.select("idx", "rho").collect()))
    assert rows(hll.merge(a, b)) == rows(hll.merge(b, a)) == rows(hll.registers(items(spark, 900), "item"))
    assert rows(hll.merge(a, a)) == rows(a)
    assert hll.precision(3) == hll.precision(19) == 14
    assert hll.estimate(hll.registers(items(spark, 0), "item")).first().estimate == 0
    with pytest.raises(hll.PrecisionMismatch):
        hll.merge(a, hll.registers(items(spark, 5), "item", 10))
    save_sketch(a, str(tmp_path / "hll"))
    assert rows(load_sketch(spark, str(tmp_path / "hll"))) == rows(a)


def test_countmin(spark):
    assert countmin.dimensions(0.01, 0.01) == (272, 5) and countmin.dimensions(-1, 2) == (2719, 5) and countmin.repaired(0, 0) == (272, 5)
    df = spark.range(1000).select(F.concat(F.lit("item-"), F.floor(F.sqrt("id"))).alias("item"))
    cells = countmin.sketch(df, "item")
    true = {r["item"]: r["count"] for r in df.groupBy("item").count().collect()}
    got = {r["item"]: r["estimate"] for r in countmin.counts(cells, df, "item").collect()}
    assert all(got[k] >= n for k, n in true.items()) and sum(got[k] == n for k, n in true.items()) > 25
    assert countmin.total(cells).first().total == 1000
    assert countmin.total(countmin.merge(cells, cells)).first().total == 2000
    with pytest.raises(countmin.DimensionMismatch):
        countmin.merge(cells, countmin.sketch(df, "item", 100, 5))
    assert countmin.counts(cells, spark.createDataFrame([("never",)], "item string"), "item").first().estimate <= countmin.total(cells).first().error + 5


def test_bloom(spark):
    f = bloom.Bloom.sized(100, 0.1)
    bits = bloom.build(items(spark, 100), "item", f)
    hits = {r["item"] for r in bloom.contains(bits, items(spark, 1100), "item", f).where("hit").collect()}
    assert {f"element-{k}" for k in range(100)} <= hits and len(hits) - 100 < 200
    assert abs(bloom.estimated_count(bits, f).first().estimate - 100) < 25
    assert bloom.semi_join(items(spark, 200), bits, "item", f).count() + bloom.semi_join(items(spark, 200), bits, "item", f, anti=True).count() == 200
    assert bloom.Bloom.sized(1_000_000, 0.01).bits == 1 << 24


def test_cuckoo(spark):
    table = cuckoo.build(items(spark, 5000), "item", 10_000)
    hits = cuckoo.contains(table, items(spark, 10_000), "item", 10_000).where("hit").count()
    assert 5000 <= hits < 5000 + 75
    ops = spark.createDataFrame([(1, "a", "delete"), (2, "a", "insert"), (3, "a", "insert"), (4, "a", "delete"), (5, "a", "delete"), (6, "a", "delete")], "t int, item string, op string")
    got = [(r["ok"], r["n_after"]) for r in cuckoo.replay(ops, "item", ["t"], "op", 64).orderBy("t").collect()]
    assert got == [(False, 0), (True, 1), (True, 2), (True, 1), (True, 0), (False, 0)]
    assert cuckoo.load(table, 10_000).first()["count"] == 5000


def test_quantiles(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    got = {r["q"]: r["quantile"] for r in quantiles.quantile(df, "v", [0, 0.1, 0.5, 0.99, 1, 7]).collect()}
    assert got == {0.0: 0.0, 0.1: 99.0, 0.5: 499.0, 0.99: 989.0, 1.0: 999.0}
    cdf = {r["x"]: r["cdf"] for r in quantiles.cdf(df, "v", [-10, 250, 500, 750, 950, 1000]).collect()}
    assert all(abs(cdf[x] - w) <= 0.01 for x, w in ((-10, 0), (250, 0.25), (500, 0.5), (750, 0.75), (950, 0.95), (1000, 1)))
    digest = quantiles.digest(df.repartition(5), "v")
    assert len(digest.first().means) <= 110
    for r in quantiles.digest_quantile(digest, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]).collect():
        assert abs(r["quantile"] - 1000 * r["q"]) <= 0.03 * 1000 * r["q"] + 1
    both = quantiles.merge_digests(digest.union(quantiles.digest(df.select((F.col("v") + 1000).alias("v")), "v")))
    assert abs(quantiles.digest_quantile(both, [0.5]).first().quantile - 1000) < 20
    assert quantiles.quantile(df.limit(0), "v", [0.5]).first().quantile is None


@pytest.mark.parametrize("few", [200_000, 2])
def test_quantiles_equal_those_of_whole_groups(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "PARTS", 5)
    monkeypatch.setattr(quantiles, "FEW", few)
    r = random.Random(2)
    odd = [math.inf, -math.inf, math.nan, None, 0.0, -0.0, 1.7e308, -1.7e308, 5e-324]
    rows = [("odd", at(1), r.choice(odd), r.randrange(9)) for _ in range(60)] + [(None, at(j % 2), r.choice([r.gauss(0, 1), 7.25, r.paretovariate(0.3)]), r.randrange(99)) for j in range(301)]
    rows += [("one", at(3), 4.5, 1), ("none", at(3), None, None), ("nan", None, math.nan, 2), ("low", None, -math.inf, 2)]
    df = spark.createDataFrame(rows, "k string, t timestamp, v double, n int").withColumn("d", F.col("n").cast("decimal(10,2)")).repartition(4).persist()
    qs = [0.5, 0, 0.01, 0.95, 0.99, 1, 3, 1 / 3]
    for value, keys in (("v", ["k", "t"]), ("n", ["k"]), ("d", ["k"]), ("v", [])):
        got = quantiles.quantile(df, value, qs, keys)
        wide = df.groupBy(*keys).agg(*(F.expr(f"percentile_disc({min(1.0, float(q))!r}D) within group (order by {value})").alias(f"_{j}") for j, q in enumerate(qs)))
        want = sorted(repr((*(w[c] for c in keys), min(1.0, float(q)), w[f"_{j}"])).replace("-0.0", "0.0") for w in wide.collect() for j, q in enumerate(qs))
        assert sorted(repr(tuple(x)).replace("-0.0", "0.0") for x in got.collect()) == want
        assert got.schema["quantile"].dataType == wide.schema["_0"].dataType
    assert "percentile" not in quantiles.quantile(df, "v", qs, ["k"])._jdf.queryExecution().toString()


def test_ranks_of_quantiles_at_all_sizes(spark):
    df = spark.range(1, 130).withColumnRenamed("id", "n").withColumn("v", F.explode(F.sequence(F.lit(1), "n"))).persist()
    qs = [0.01, 0.07, 0.1, 0.29, 0.5, 0.57, 0.9, 0.95, 0.99]
    got = {(x["n"], x["q"]): x["quantile"] for x in quantiles.quantile(df, "v", qs, ["n"]).collect()}
    wide = df.groupBy("n").agg(*(F.expr(f"percentile_disc({q!r}D) within group (order by v)").alias(f"_{j}") for j, q in enumerate(qs)))
    assert got == {(w["n"], q): w[f"_{j}"] for w in wide.collect() for j, q in enumerate(qs)}


def test_heavy_hitters(spark):
    s = heavy_hitters.SpaceSaving(3)
    for x in ["common"] * 10 + ["rare1", "rare2", "new"]:
        s.add(x)
    assert s.counts["common"] == [10, 0] and s.counts["new"] == [2, 1] and s.least() == 1
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",), (None,)], "item string")
    assert [tuple(r) for r in heavy_hitters.top(df, "item", 2).collect()] == [("a", 2), ("b", 2)]
    assert heavy_hitters.top(df, "item", 0).count() == 0
    timed = spark.createDataFrame([("old", at(0))] * 3 + [("new", at(300))] * 2, "item string, ts timestamp")
    got = {r["item"]: r["rate"] for r in heavy_hitters.top_rates(timed, "item", "ts", at(300), 60, 5).collect()}
    assert math.isclose(got["old"], 3 / 32) and got["new"] == 2 and next(iter(got)) == "new"


# --- decay and windows --------------------------------------------------------------------


def test_decayed_rates(spark):
    df = spark.createDataFrame([("k", at(0), 8.0, 1), ("k", at(60), 1.0, 2), ("k", at(60), 1.0, 3), ("k", at(999), 5.0, 4)], "k string, ts timestamp, n double, id int")
    assert math.isclose(decay.decayed_sum(df, ["k"], "ts", at(60), 60, "n").first().rate, 6.0)
    running = [r["rate"] for r in decay.running_rate(df, ["k"], "ts", "id", 60, "n").orderBy("id").collect()]
    assert all(map(math.isclose, running[:3], [8, 5, 6]))
    seeds = spark.createDataFrame([("k", at(30), 100.0)], "k string, ts timestamp, rate double")
    assert math.isclose(decay.seeded_rate(df, ["k"], "ts", at(90), 60, seeds, "n").first().rate, 50 + 2 * 2**-0.5)
    assert decay.half_life_or_default(0) == 60 and decay.interval_or_default(-1) == 5


def test_moving_averages(spark):
    seconds = [0, 1, 2, 7, 31, 32, 33, 34]
    df = spark.createDataFrame([("k", at(s), float(s), s) for s in seconds], "k string, ts timestamp, v double, id int")
    n = [sum(5 * t <= s < 5 * t + 5 for s in seconds) for t in range(7)]
    assert [r["n"] for r in decay.ticks(df, ["k"], "ts", 5).orderBy("tick").collect()] == n
    want = {k: None for k in ("m1", "m5", "m15")}
    for k, a in zip(want, (decay.ALPHA_1, decay.ALPHA_5, decay.ALPHA_15), strict=True):
        r = n[0] / 5
        for x in n[1:]:
            r = a * x / 5 + (1 - a) * r
        want[k] = r
    got = decay.moving_averages(df, ["k"], "ts", 5).first()
    assert all(math.isclose(got[k], v) for k, v in want.items())
    e = [r["ewma"] for r in decay.running_ewma(df, ["k"], "v", ["ts"], 0.5).orderBy("id").collect()]
    assert math.isclose(e[-1], decay.ewma_of_values(df, ["k"], "v", ["ts"], 0.5).first().ewma) and e[0] == 0


def test_fixed_windows(spark):
    w = ratelimit.FixedWindow(60)
    assert [w.allow("k", 2, t) for t in (0, 1, 2, 60, 60.001)] == [True, True, False, False, True]
    assert w.allow("other", 2, 2) and w.add("k", 5, 61) == 6 and w.add("k", 0, 61) == 6 and w.count("k", 200) == 0
    assert not w.allow("k", 2, 62)
    w = ratelimit.FixedWindow(10, max_keys=2)
    for k, t in (("a", 0), ("b", 1), ("c", 2)):
        w.allow(k, 5, t)
    assert set(w.keys) == {"b", "c"}
    rows = [("k", at(t), j) for j, t in enumerate((0, 1, 2, 60, 61))]
    out = ratelimit.replay(spark.createDataFrame(rows, "k string, ts timestamp, id int"), "k", "ts", "id", 2, 60)
    assert [r["allowed"] for r in out.orderBy("id").collect()] == [True, True, False, False, True]
    state = ratelimit.state_at(out, "k", "ts", "id", at(30)).first()
    assert (state["count"], state["locked"], state["expiry"]) == (3, True, at(60))
    assert ratelimit.state_at(out, "k", "ts", "id", at(300)).first()["count"] == 0


def test_a_bound_on_keys_is_kept_without_looking_at_all_keys():
    looked = [0]

    class Key(str):
        def __str__(self):
            looked[0] += 1
            return str.__str__(self)

    for seed in range(6):
        r = random.Random(seed)
        bound, w, open_ = r.choice([1, 3, 20]), None, {}
        w = ratelimit.FixedWindow(10, max_keys=bound)
        now = 0
        for _ in range(3000):
            now += r.choice([0, 0, 1, 2, 15]) if seed < 4 else r.choice([-3, 0, 1, 4])  # times may go back
            k, n = r.choice([1, "1", None, *"abcdefghijk", *range(30)]), r.choice([None, 1, 2])
            if k not in open_ and len(open_) >= bound:
                for gone in [x for x in open_ if now > open_[x][1]] or [min(open_, key=lambda x: (open_[x][1], str(x)))]:
                    del open_[gone]
            if k not in open_ or now > open_[k][1]:
                open_[k] = [0, now + 10, False]
            open_[k][0] += n or 1
            open_[k][2] |= n is None and open_[k][0] > 3
            assert (w.allow(k, 3, now) != open_[k][2]) if n is None else (w.add(k, n, now) == open_[k][0])
            assert {x: (e[0], e[2]) for x, e in w.keys.items()} == {x: (c, end) for x, (c, end, _) in open_.items()}
            assert len(w._ends) <= 2 * bound + 16
    w = ratelimit.FixedWindow(1000, max_keys=500)
    for j in range(3000):
        w.allow(Key(j), 3, j)
    assert looked[0] < 30_000  # each of 2500 evictions looked at all 500


def test_folds_stream_over_batches(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), at(r.randrange(500)), r.choice([1.0, 2.5, None]), j) for j in range(700)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, n double, id int").persist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        counts = {x["id"]: (x["allowed"], x["count"]) for x in ratelimit.replay(df, "k", "ts", "id", 3, 60).collect()}
        bounded = {x["id"]: x["allowed"] for x in ratelimit.replay_bounded(df, "k", "ts", "id", 3, 60, 2).collect()}
        rate = {x["id"]: x["rate"] for x in decay.running_rate(df, ["k"], "ts", "id", 60, "n").collect()}
        ewma = {x["id"]: x["ewma"] for x in decay.running_ewma(df, ["k"], "n", ["ts", "id"], 0.25).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    windows, open_, sums, means = {}, {}, {}, {}
    for k, ts, n, j in sorted(rows, key=lambda x: (x[1], x[3])):
        now = ts.timestamp()
        # one key's window
        if k not in windows or now > windows[k][1]:
            windows[k] = [0, now + 60]
        windows[k][0] += 1
        assert counts[j] == (windows[k][0] <= 3, windows[k][0])
        # two windows at most are open: expired ones go first, else the one that ends first
        if k not in open_ and len(open_) == 2:
            for gone in [x for x in open_ if now > open_[x][1]] or [min(open_, key=lambda x: (open_[x][1], str(x)))]:
                del open_[gone]
        if k not in open_ or now > open_[k][1]:
            open_[k] = [0, now + 60]
        open_[k][0] += 1
        assert bounded[j] == (open_[k][0] <= 3)
        sums.setdefault(k, []).append((now, n or 0))
        assert math.isclose(rate[j], sum(v * 0.5 ** ((now - t) / 60) for t, v in sums[k]), abs_tol=1e-9)
        if n is not None:
            means[k] = n if k not in means else 0.25 * n + 0.75 * means[k]
        assert ewma[j] == means.get(k)
    assert ratelimit.replay(df.limit(0), "k", "ts", "id", 3, 60).count() == 0


# --- chains and chunks --------------------------------------------------------------------


def test_markov(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "c"],), (["a", "b", "d"],), (None,), ([],)], "t array<string>")
    edges = markov.chain(df, "t", 2)
    p = {(tuple(r.current), r.next): r.p for r in markov.probabilities(edges).collect()}
    assert math.isclose(p[("a", "b"), "c"], 2 / 3) and p[("^", "^"), "a"] == 0.75
    probes = spark.createDataFrame([(["a", "b"], "c"), (["x", "y"], "z"), (["a"], "b")], "current array<string>, next string")
    assert {tuple(r.current): r.p for r in markov.transition_probability(edges, probes, 2).collect()} == {("a", "b"): 2 / 3, ("x", "y"): 0.0, ("a",): None}
    states = spark.range(3000).select(F.col("id").alias("state_id"), F.array(F.lit("a"), F.lit("b")).alias("current"))
    drawn = markov.generate_next(edges, states, 1).groupBy("next").count().collect()
    assert abs(next(r["count"] for r in drawn if r["next"] == "c") - 2000) < 150
    texts = markov.generate(edges, spark.createDataFrame([(1, ["^", "^"])], "state_id long, current array<string>"), 2, 10).first().tokens
    assert texts in (["a", "b", "c"], ["a", "b", "d"], [])
    assert spark.createDataFrame([("né",)], "s string").select(markov.characters(F.col("s")).alias("c")).first().c == ["n", "é"]


def test_chain_probabilities_equal_a_plain_version(spark):
    r = random.Random(3)
    texts = [[r.choice(["a", "b", "c", "", "^", None]) for _ in range(r.randrange(7))] for _ in range(80)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t array<string>")
    for order in (1, 2, 3):
        want = Counter()
        for t in texts:
            padded = ["^"] * order + t + ["$"] * order if t is not None else []
            want.update((tuple(padded[i : i + order]), padded[i + order]) for i in range(len(padded) - order))
        total = Counter()
        for (state, _), n in want.items():
            total[state] += n
        found = markov.chain_probabilities(df, "t", order)
        got = {(tuple(x.current), x.next): (x.freq, x.p) for x in found.collect()}
        assert got == {k: (n, n / total[k[0]]) for k, n in want.items()}
        assert got == {(tuple(x.current), x.next): (x.freq, x.p) for x in markov.probabilities(markov.chain(df, "t", order)).collect()}
        # edges are neither sorted for the join nor grouped by arrays
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(current" not in plan and "hashpartitioning(p#" not in plan
    with pytest.raises(ValueError):
        markov.chain_probabilities(df, "t", 0)


def test_chunks_cover_the_data(spark, tmp_path):
    data = random.Random(1).randbytes(200_000)
    c = chunking.Chunking(256, 1024, 8192)
    ends = chunking.boundaries(data, c)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and all(c.least < s <= c.most for s in sizes[:-1]) and ends == chunking.boundaries(data, c)
    moved = chunking.boundaries(b"shift" + data, c)
    assert len({e - 5 for e in moved} & set(ends)) > 0.9 * len(ends)
    h, mask = 0, chunking.gear_hashes(data[:300])
    for k, b in enumerate(data[:300]):
        h = ((h << 1) + int(chunking.GEAR[b])) % (1 << 64)
        assert h == int(mask[k])
    (tmp_path / "f.bin").write_bytes(data)
    files = load_bytes(spark, str(tmp_path / "f.bin"))
    rows = chunking.chunk(files, "content", ["path"], c, with_data=True).orderBy("offset").collect()
    assert b"".join(r["data"] for r in rows) == data and [r["offset"] + r["length"] for r in rows] == ends
    twice = chunking.chunk(files.union(files), "content", ["path"], c)
    assert math.isclose(chunking.dedup_ratio(twice).first().ratio, 0.5, abs_tol=0.01)
    assert chunking.boundaries(b"", c) == [] and chunking.boundaries(b"x", c) == [1]
    for bad in ((0, 1, 2), (5, 4, 6), (1, 2, 3, 4)):
        with pytest.raises(ValueError):
            chunking.Chunking(*bad)


def test_chunks_equal_a_plain_version(spark):
    """Byte by byte: the hash runs over the whole text, the harder mask holds up to the average size."""

    def plain(data, c):
        hard, easy = c.masks()
        ends, start, h = [], 0, 0
        for k, b in enumerate(data):
            h = (2 * h + int(chunking.GEAR[b])) % 2**64
            size = k + 1 - start
            if size > c.least and (h & (hard if size <= c.average else easy) == 0 or size == c.most):
                ends.append(k + 1)
                start = k + 1
        return [*ends, len(data)] if start < len(data) else ends

    r = random.Random(5)
    texts = ["", "a", "ab" * 700, "é" * 900, *("".join(r.choices("abc de\n", k=r.randrange(5000))) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate([*texts, None, texts[5]])), "id int, t string")
    for c in (chunking.Chunking(64, 256, 1024, 2), chunking.Chunking(16, 64, 100, 0), chunking.Chunking(1, 2, 3, 3)):
        want = []
        for j, t in enumerate([*texts, None, texts[5]]):
            data, start = (t or "").encode(), 0
            for end in plain(data, c):
                want.append((j, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                start = end
        got = chunking.chunk(df, "t", ["id"], c)
        assert sorted((x["id"], x["offset"], x["length"], x["hash"]) for x in got.collect()) == want
        sizes = Counter(x[3] for x in want)
        assert {x["hash"]: x["n"] for x in chunking.duplicates(got).collect()} == sizes


# --- lookups ------------------------------------------------------------------------------


def test_prefixes(spark):
    table = spark.createDataFrame([("", 0), ("app", 1), ("apple", 2), ("application", 3)], "key string, value int")
    probes = spark.createDataFrame([("apple pie",), ("ap",), ("applications",), (None,)], "p string")
    assert {r.p: r.value for r in prefixes.longest_prefix(table, probes, "p").collect()} == {"apple pie": 2, "ap": 0, "applications": 3}
    assert {r.value for r in prefixes.longest_prefix(table, probes, "p", shortest=True).collect()} == {0}
    assert prefixes.prefix_search(table, "appl").count() == 2 and prefixes.has_prefix(table, "") and not prefixes.has_prefix(table, "b")
    assert prefixes.delete_prefix(table, "app").count() == 1
    newer = spark.createDataFrame([("app", 9), ("new", 8)], "key string, value int")
    assert {r.key: r.value for r in prefixes.upsert(table, newer).collect()} == {"": 0, "app": 9, "apple": 2, "application": 3, "new": 8}


MERGES = [
    ["192.168.0.0/25", "192.168.0.128/25"], ["10.0.0.0/26", "10.0.0.64/26", "10.0.0.128/26", "10.0.0.192/26"], ["10.0.0.0/8", "10.1.2.3/32"],
    ["0.0.0.0/1", "128.0.0.0/1"], ["10.0.0.1/32", "10.0.0.2/31", "10.0.0.4/30", "10.0.0.8/32"], ["255.255.255.255/32", "255.255.255.254/32"],
]


@pytest.mark.parametrize("nets", MERGES)
def test_merged_networks(spark, nets):
    want = {str(n) for n in ipaddress.collapse_addresses(map(ipaddress.ip_network, nets))}
    df = spark.createDataFrame([(n,) for n in nets], "cidr string")
    assert {r.cidr for r in networks.merge(df, "cidr").collect()} == want
    assert {r.cidr for r in networks.merge_any(df, "cidr").collect()} == want


def test_random_networks(spark):
    r = random.Random(2)
    nets = [ipaddress.ip_network((r.getrandbits(12) << 20 | r.getrandbits(20) & 0xFFF00, r.randrange(8, 29)), strict=False) for _ in range(300)]
    df = spark.createDataFrame([(str(n),) for n in nets], "cidr string")
    assert {x.cidr for x in networks.merge(df, "cidr").collect()} == {str(n) for n in ipaddress.collapse_addresses(nets)}
    ips = [str(ipaddress.ip_address(r.getrandbits(32))) for _ in range(300)]
    got = {x.ip: x.hit for x in networks.contains(spark.createDataFrame([(i,) for i in ips], "ip string"), df, "ip", "cidr").collect()}
    assert got == {i: any(ipaddress.ip_address(i) in n for n in nets) for i in ips}


def test_networks(spark):
    holds = networks.matcher(["10.0.0.0/8", "2001:db8::/32"])
    df = spark.createDataFrame([("10.1.1.1",), ("11.0.0.0",), ("::ffff:10.0.0.1",), ("2001:db8::9",), ("2001:db9::",), ("bad",)], "ip string")
    assert [r.h for r in df.select(holds("ip").alias("h")).collect()] == [True, False, True, True, False, False]
    with pytest.raises(networks.BadNetwork):
        networks.matcher(["10.0.0.0/33"])
    with pytest.raises(networks.BadNetwork):
        networks.merge(spark.createDataFrame([("10.0.0.0/8",), ("x",)], "cidr string"), "cidr")
    one = spark.createDataFrame([("192.168.0.0/16",)], "cidr string")
    subnets = networks.split(one, "cidr", 24).orderBy("lo").collect()
    assert len(subnets) == 256 and subnets[1].subnet == "192.168.1.0/24" and networks.split(one, "cidr", 8).count() == 0
    six = spark.createDataFrame([("2001:db8::/33",), ("2001:db8:8000::/33",), ("10.0.0.0/8",)], "cidr string")
    assert {r.cidr for r in networks.merge_any(six, "cidr").collect()} == {"10.0.0.0/8", "2001:db8::/32"}


def test_random_networks_of_both_families(spark):
    r = random.Random(8)
    six = [ipaddress.ip_network(((0x2000 + r.getrandbits(3) << 112) | (r.getrandbits(6) << 106) | r.getrandbits(106), r.choice([13, 15, 16, 17, 20, 22, 64, 128])), strict=False) for _ in range(200)]
    four = [ipaddress.ip_network((r.getrandbits(32), r.choice([6, 8, 9, 16, 24])), strict=False) for _ in range(60)]
    df = spark.createDataFrame([(str(n),) for n in [*six, *four, six[0]]], "cidr string")
    want = {str(n) for v in (six, four) for n in ipaddress.collapse_addresses(v)}
    got = [x.cidr for x in networks.merge_any(df, "cidr").collect()]
    assert set(got) == want and len(got) == len(want)
    assert networks.merge_any(df.limit(0), "cidr").count() == 0
    ips = [*(ipaddress.ip_address((0x2000 + r.getrandbits(4) << 112) | r.getrandbits(112)) for _ in range(200)), *(ipaddress.ip_address(r.getrandbits(32)) for _ in range(100))]
    asked = spark.createDataFrame([(str(i),) for i in ips] + [("bad",), (None,)], "ip string")
    got = {x.ip: x.hit for x in networks.contains_any(asked, df.union(spark.createDataFrame([("no",)], "cidr string")), "ip", "cidr").collect()}
    assert got == {str(i): any(i in n for n in [*six, *four]) for i in ips} | {"bad": False}
    assert not any(x.hit for x in networks.contains_any(asked, df.limit(0), "ip", "cidr").collect())
    one = spark.createDataFrame([("2001:db8::/46",), ("10.0.0.0/8",), ("::/0",)], "cidr string")
    assert {x.subnet for x in networks.split_ipv6(one, "cidr", 48).collect()} == {str(n) for n in ipaddress.ip_network("2001:db8::/46").subnets(new_prefix=48)}
    with pytest.raises(networks.BadNetwork):
        networks.split_ipv6(one, "cidr", 129)


# --- secrets and caches -------------------------------------------------------------------


def test_secrets(spark):
    for secret in (b"x", b"\0leading", os.urandom(31)):
        shares = secrets.split(secret, 3, 5)
        assert secrets.combine(shares[2:], 3, len(secret)) == secret and secrets.verify(shares, 3)
        assert secrets.combine(shares[:2] + [(99, 1)], 3) != secret
        assert not secrets.verify([*shares[:4], (shares[4][0], shares[4][1] ^ 1)], 3) and secrets.verify(shares[:3], 3)
    data = os.urandom(100) + b"\0" * 40
    parts = secrets.split_bytes(data, 2, 4)
    assert secrets.combine_bytes(parts[1:3], 2, len(data)) == data
    small = secrets.split_gf256(data, 3, 200)
    assert secrets.combine_gf256(small[50:53]) == data and secrets.combine_gf256(small) == data
    assert secrets.decode_share(secrets.encode_share(7, 2**255, 2, 3)) == (7, 2**255, 2, 3)
    for bad in (lambda: secrets.split(b"x", 1, 3), lambda: secrets.split(b"x", 3, 2), lambda: secrets.split(b"\xff" * 32, 2, 2), lambda: secrets.split(b"x", 2, 2, [1, 1]), lambda: secrets.combine([(1, 2)], 2), lambda: secrets.decode_share("AAAA"), lambda: secrets.split_gf256(b"x", 2, 256)):
        with pytest.raises(secrets.ShareError):
            bad()
    df = spark.createDataFrame([(1, "secret one"), (2, "two")], "k int, s string")
    back = secrets.combine_table(secrets.split_table(df, "k", "s", 2, 3), "k").collect()
    assert {r.k: (bytes(r.secret).decode(), r.verified) for r in back} == {1: ("secret one", True), 2: ("two", True)}


def _secret_rows(spark):
    r = random.Random(6)
    rows = [(k, r.randbytes(r.randrange(1, 40))) for k in range(200)]
    return spark.createDataFrame(rows, "k int, s binary").coalesce(1), dict(rows)


def test_bytewise_shares_are_made_and_combined_in_batches(spark, monkeypatch):
    df, want = _secret_rows(spark)
    shares = secrets.split_gf256_table(df, "k", "s", 3, 4, seed=4)
    assert shares.select(F.spark_partition_id()).distinct().count() > 1  # one small file, many tasks
    got = {}
    for r in shares.collect():
        got.setdefault(r.k, []).append(bytes(r.share))
    assert got == {k: secrets.split_gf256(s, 3, 4, f"4:{k}") for k, s in want.items()}
    back = secrets.combine_gf256_table(shares, "k")
    assert {r.k: bytes(r.data) for r in back.collect()} == want
    assert "FlatMapGroups" not in back._jdf.queryExecution().toString()  # no call of Python for each key
    # lists of unlike numbers of shares, and the product of every two bytes by hand
    parts = [secrets.split_gf256(s, 3, 9)[: 3 + k % 5] for k, s in want.items()]
    assert secrets.combine_gf256_many(parts) == list(want.values())
    for a, b in ((0, 7), (7, 0), (0x57, 0x83), (0x53, 0xCA), (255, 255)):
        product = 0
        for bit in range(8):
            product ^= a << bit if b >> bit & 1 else 0
        for bit in range(14, 7, -1):
            product ^= 0x11B << bit - 8 if product >> bit & 1 else 0
        assert secrets._TIMES[a, b] == product
    for bad in ([b"ab"], [b"ab", b"abc"], [b"ab", b"cb"], [b"a\0", b"bc"], [b"a", b"b"]):
        with pytest.raises(secrets.ShareError):
            secrets.combine_gf256_many([parts[0], bad])
    monkeypatch.setattr(secrets, "_TOGETHER", 50)
    assert list(secrets._runs([20, 30, 60, 10, 40, 1])) == [(0, 2), (2, 3), (3, 5), (5, 6)] and list(secrets._runs([])) == []


def test_shares_of_numbers_are_combined_in_batches(spark):
    df, want = _secret_rows(spark)
    short = df.where(F.length("s") <= 31)
    shares = secrets.split_table(short, "k", "s", 3, 5, seed=1)
    parts = secrets.split_bytes_table(df, "k", "s", 2, 4, seed=3)
    back, long = secrets.combine_table(shares, "k"), secrets.combine_bytes_table(parts.where("x <> 2"), "k")
    for made in (shares, parts):
        assert made.select(F.spark_partition_id()).distinct().count() > 1
    for found in (back, long):
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert {r.k: bytes(r.secret) for r in back.where("verified").collect()} == {k: s for k, s in want.items() if len(s) <= 31}
    assert {r.k: bytes(r.data) for r in long.collect()} == want
    # places are weighed once for all secrets that share them
    secrets._weights.cache_clear()
    for s in (b"one", b"two", b"three"):
        assert secrets.verify(secrets.split(s, 3, 5), 3)
    assert secrets._weights.cache_info().misses == 2
    # a share that is missing is an error
    lost = shares.withColumn("share", F.when(F.col("k") != 7, F.col("share")))
    with pytest.raises(Exception, match="not a share of version 1"):
        secrets.combine_table(lost, "k").collect()


def test_adaptive_cache(spark):
    gone = []
    c = cachesim.AdaptiveCache(3, on_evict=lambda k, v: gone.append(k))
    for k in "abc":
        c.set(k, k.upper())
    assert c.get("a") == ("A", True) and "a" in c.often
    c.set("d", "D")
    assert gone == ["b"] and "b" in c.past_once and c.get("b") == (None, False) and c.target == 0
    c.set("b", "B")
    assert c.target == 1 and "b" in c.often and len(c) == 3
    for k in range(100):  # a scan leaves what is used often
        c.set(k, k)
    assert c.get("a")[1] or c.get("b")[1]
    t = cachesim.AdaptiveCache(2)
    t.set("x", 1, ttl=10, now=0)
    assert t.get("x", 10)[1] and not t.get("x", 10.1)[1] and len(t) == 0
    b = cachesim.AdaptiveCache(10, max_bytes=10)
    for k in range(5):
        b.set(k, k, size=4)
    assert b.bytes <= 10 and len(b) == 2 and b.delete(4) and not b.delete(4)
    df = spark.createDataFrame([(1, j, k) for j, k in enumerate("abababcdefab")], "c int, t int, k string")
    out = cachesim.replay(df, "c", "k", ["t"], 3)
    assert cachesim.hit_ratio(out, "c").first().hits >= 5


def test_replayed_cache_equals_a_plain_version(spark):
    """The adaptive replacement policy on plain lists, for a get and a set after each miss."""

    def plain(keys, size):
        t1, t2, b1, b2, p, out, evicted = [], [], [], [], 0, [], 0

        def replace(ghost_often):
            nonlocal evicted
            if t1 and (len(t1) > p or (len(t1) == p and ghost_often) or not t2):
                b1.append(t1.pop(0))
            else:
                b2.append(t2.pop(0))
            evicted += 1

        for k in keys:
            hit = k in t1 or k in t2
            if hit:
                (t1 if k in t1 else t2).remove(k)
                t2.append(k)
            elif k in b1:
                p = min(size, p + max(1, len(b2) // len(b1)))
                replace(False)
                b1.remove(k)
                t2.append(k)
            elif k in b2:
                p = max(0, p - max(1, len(b1) // len(b2)))
                replace(True)
                b2.remove(k)
                t2.append(k)
            else:
                if len(t1) == size:  # the oldest of the first list leaves, within a bound on what is remembered
                    if len(b1) + len(b2) >= size:
                        del b1[:1]
                    b1.append(t1.pop(0))
                    evicted += 1
                elif len(t1) + len(t2) == size:
                    if len(b1) + len(b2) >= size:
                        del (b2 or b1)[:1]
                    replace(False)
                t1.append(k)
            out.append((hit, p, len(t1) + len(t2), evicted))
        return out

    r = random.Random(6)
    traces = {c: [int(r.paretovariate(0.7)) % 40 if r.random() < 0.8 else 1000 + j for j in range(400)] for c in (1, 2)}
    df = spark.createDataFrame([(c, j, k) for c, keys in traces.items() for j, k in enumerate(keys)], "c int, t int, k int")
    for size in (1, 5, 12):
        got = cachesim.replay(df, "c", "k", ["t"], size).orderBy("c", "t").collect()
        want = [x for keys in traces.values() for x in plain(keys, size)]
        assert [(x["hit"], x["target"], x["resident"], x["evicted"]) for x in got] == want


def test_summaries_equal_a_plain_version(spark):
    r = random.Random(7)
    items = [int(r.paretovariate(0.8)) % 60 for _ in range(500)]
    df = spark.createDataFrame([(1, j, str(x)) for j, x in enumerate(items)], "k int, t int, item string")
    got = {x["item"]: (x["cnt"], x["err"]) for x in heavy_hitters.space_saving(df, "item", ["t"], 10, ["k"]).collect()}
    exact = Counter(map(str, items))
    assert len(got) == 10 and sum(c for c, _ in got.values()) == len(items)
    assert all(c - e <= exact[x] <= c for x, (c, e) in got.items())
    assert all(x in got for x, n in exact.items() if n > len(items) / 10)


def test_summaries_are_streamed(spark):
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), r.choice([0.5, math.nan, None]), r.choice([*range(300), None]), j, r.choice([*range(40), None])) for j in range(900)]
    df = spark.createDataFrame(rows, "k string, f double, t int, id int, item int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = heavy_hitters.space_saving(df, "item", ["t", "id"], 5, ["k", "f"])
        got = sorted(repr(tuple(x)) for x in found.collect())
        one = {(x["item"], x["cnt"], x["err"]) for x in heavy_hitters.space_saving(df, "item", ["t", "id"], 5, []).collect()}
        assert heavy_hitters.space_saving(df.limit(0), "item", ["t", "id"], 5, ["k"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain, whole = {}, heavy_hitters.SpaceSaving(5)
    for k, f, _, _, item in sorted(rows, key=lambda x: (x[2] is None, x[2] or 0, x[3])):
        if item is not None:
            plain.setdefault((k, repr(f)), (k, f, heavy_hitters.SpaceSaving(5)))[2].add(str(item))
            whole.add(str(item))
    assert got == sorted(repr((k, f, x, c, e)) for k, f, s in plain.values() for x, (c, e) in s.counts.items())
    assert one == {(x, c, e) for x, (c, e) in whole.counts.items()}
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()  # no key's rows are held


def test_every_two_shares_of_the_query_give_the_secret(spark, sf):
    from itertools import combinations

    from sketchloom.plans.folds import sh_1_shares

    names = {x["s_suppkey"]: x["s_name"] for x in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    shares = sh_1_shares(spark, sf).persist()
    numbered = shares.withColumn("x", F.row_number().over(Window.partitionBy("s_suppkey").orderBy("share")))
    for pair in combinations((1, 2, 3), 2):
        back = secrets.combine_table(numbered.where(F.col("x").isin(*pair)), "s_suppkey").collect()
        assert {x["s_suppkey"]: bytes(x["secret"]).decode() for x in back} == names
