"""Each operator against a plain version of itself on small inputs."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from sketchloom.llm import components, decontam, html_extract, langid, licenses, pieces, pitman_yor, quality, sharding, simhash, spm, urlfilter
from sketchloom.llm.common import read


def make_texts(n, seed, words=40):
    r = random.Random(seed)
    pool = [f"w{k}" for k in range(60)]
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(words))) for _ in range(n)]
    return texts + [t + " extra" for t in texts[: n // 4]] + texts[: n // 4]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(make_texts(60, 1))), "doc_id long, text string").persist()


# --- language ID --------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    params = langid.LanguageId()
    lattice = langid.Lattice(params.model)
    rng = np.random.default_rng(1)
    p = np.vstack([rng.random((lattice.size, 2)) / lattice.size, np.zeros((1, 2))])
    model = langid.LanguageModel(["a", "b"], np.log([0.5, 0.5]), p, params)
    m = pieces.Model.load(params.model)
    number = {}
    for text in {w[i:j] for w in ("▁there", "▁naïve", "▁qzqж") for i in range(len(w)) for j in range(i + 1, len(w) + 1)}:
        h = pieces.prefix_hashes(pieces.codes([text], len(text)))
        if len(text) <= lattice.index.longest and (k := int(lattice.index.find(h, 0, len(text))[0])) >= 0:
            number[text] = k
            assert text in m.pieces

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(word) + 1):
            if (piece := number.get(word[:k], lattice.size - 1 if k == 1 else None)) is not None:
                out = out + p[piece] * total(word[k:])
        return out

    for word in ("there", "naïve", "qzqж"):
        assert np.allclose(model.log_words(lattice, ["▁" + word])[0, :2], np.log(total("▁" + word)), rtol=1e-9)


def test_letters_that_none_has_learned_say_nothing():
    words = {"en": "the cat sat on the mat and the dog ran", "fr": "le chat est sur le tapis et le chien court vite"}
    counts = {k: Counter(langid.words_of(t)) for k, t in words.items()}
    scorer = langid.Scorer(langid.fit(counts, {"en": 3, "fr": 1}, langid.LanguageId()))
    for text in ("ฟ" * 30, "ฟ" * 60, "字" * 100, "ฟ" * 5000, "ж " * 40):  # the prior, whatever the length
        language, score, gain = scorer.predict([text])[0]
        assert language == "en" and abs(score - 0.75) < 1e-6 and gain < langid.LanguageId().min_gain
    for language, text in words.items():
        for more in ("", "ฟ" * 60, " " + "字" * 1000):
            found, score, gain = scorer.predict([text + more])[0]
            assert found == language and 0.9 < score <= 1
    assert scorer.predict(["le chat " * 20_000])[0][:2] == ("fr", 1.0)
    tie = langid.Scorer(langid.fit({"b": Counter(["▁x"]), "a": Counter(["▁x"])}, {"b": 2, "a": 2}, langid.LanguageId()))
    assert tie.predict(["x"])[0][:2] == ("a", 0.5)


def test_a_language_that_was_not_learned_is_rejected(spark):
    rows = [(k, "the cat sat on the mat with the dog", "en") for k in range(20)] + [(90, "ฟ" * 40, None), (91, "ж" * 40, "en"), (92, "the dog sat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in langid.keep_identified(df.where("doc_id != 91")).collect()} == {*range(20), 92}


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    both = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(both) > 100 and sum(r["lang_pred"] == r["lang"] for r in both) >= 0.97 * len(both)


# --- HTML ---------------------------------------------------------------------------------

CASES = {
    "<html><body><header>Site</header><div><p>One &amp; two</p><p>Three<br>four</p></div><div id='cookie-notice'>Accept</div><footer>f</footer></body></html>": ["One & two", "Three four"],
    "<nav>n</nav><main><h1>T</h1><p>a <b>b</b></p><section class='comments'><p>no</p></section><form><input name=q>no</form></main><aside>x</aside>": ["T", "a b"],
    "<article><header><h1>Title</h1></header><p>x</p><article class='comment'><p>reader</p></article><footer>by</footer></article>": ["Title", "x"],
    "<p>a<p>b<div>c<ul><li>d<li>e</ul>": ["a", "b", "c", "d", "e"],
    '<script>if (a<b) "</p>"</script><p>a < b &lt;3 &#x41;</p><!-- <p>no</p> --><style>p{}</style>': ["a < b <3 A"],
    "<article><h1>T</h1><p><b>x y.<br><p>z</p></article><footer>f": ["T", "x y.", "z"],
    "<form id='all'><div class='top has-sidebar'><nav>n</nav><article><p>x</p><form>y</form></article></div></form>": ["x"],
    "<div class='page has-sidebar'><p>x</p></div><aside><article><p>teaser</p></article></aside>": ["x"],
    "just text": ["just text"],
    "<div class='header'>Site</div><div id=topnav>n</div><article><div class='header'><h1>T</h1></div><p>x</p><div class='reader-comments'>no</div></article><div style='display: none'>h</div>": ["T", "x"],
    "<body><div class='wrap'><div id='sidebar'>s</div><div class='content'><h2>A</h2><p>b&nbsp;c &hellip;</p></div></div><div class='notice'>n</div>": ["A", "b c \u2026"],
    "<table><tr><td>a<td>b</table>": ["a", "b"],
}


@pytest.mark.parametrize("html", CASES)
def test_blocks(html):
    assert [t for t, _ in html_extract.blocks_of(html)[0]] == CASES[html]


def test_site_template_goes_and_articles_stay(spark):
    shared = "<div><p>About this site and its owner</p></div>"
    rows = [(k, f"http://h.org/{k}", f"<body>{shared}<div><p>Story number {k}</p></div></body>") for k in range(20)]
    rows += [(100 + k, f"http://h.org/c{k}", "<body><article><p>The same article</p></article></body>") for k in range(20)]
    rows += [(200, "http://other.org/", f"<body>{shared}</body>")]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == f"Story number {k}" for k in range(20))
    assert all(found[100 + k] == "The same article" for k in range(20))
    assert found[200] == "About this site and its owner"


def plain_extract(rows):
    """Template removal by plain counts of subtree hashes, from the parsed blocks."""
    rule, out = html_extract.TemplateRule(), {}
    parsed = [(k, url.split("/")[2], *html_extract.blocks_of(html)) for k, url, html in rows]
    for k, host, blocks, _, article, _ in parsed:
        contents = {c for _, h, *_, c in parsed if h == host}
        holders = lambda x, host=host: {c for _, h, _, own, _, c in parsed if h == host and x in own}
        template = lambda x, n=len(contents): len(holders(x)) >= rule.min_pages and (len(holders(x)) >= rule.many_pages or 5 * len(holders(x)) >= n)
        kept = [t for t, inside in blocks if not any(map(template, inside))]
        whole = [t for t, _ in blocks]
        if not kept or (article and 2 * sum(map(len, kept)) < sum(map(len, whole))):
            kept = whole
        out[k] = (" ".join(kept), len(whole) - len(kept))
    return out


def test_counts_decide_inside_articles_as_in_a_plain_version(spark):
    r = random.Random(15)
    story = lambda: " ".join(r.choice("ab cd efg hij klm nop".split()) for _ in range(25))
    box = "<section><p>Support our work</p><ul><li>one</li><li>two</li></ul></section>"
    rows = []
    for k in range(60):
        host, inner = f"h{k % 3}.org", f"<h1>Title</h1><div><p>{story()}</p>{box if k % 3 < 2 else ''}</div><p>{story()}</p>"
        rows.append((k, f"http://{host}/{k}", f"<nav>n</nav><article>{inner}</article>" if k % 2 else f"<body><div>{inner}</div></body>"))
    rows += [(100 + k, "http://h2.org/copy", "<article><p>one copied page</p></article>") for k in range(30)]
    rows += [(200 + k, "http://rare.org/", f"<article><p>{story()}</p>{box}</article>") for k in range(4)]
    got = {x["page_id"]: (x["text"], x["n_template"]) for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == plain_extract(rows)
    assert all("Support" not in got[k][0] and "Title" in got[k][0] for k in range(60) if k % 2 and k % 3 < 2)
    assert all("Support" in got[200 + k][0] for k in range(4)) and got[100] == ("one copied page", 0)


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert [t for t, _ in html_extract.blocks_of(f"<article>{deep}</article>")[0]] == ["x"]
    assert sum(len(t) for t, _ in html_extract.blocks_of("<article>" + "<p>some words here</p>" * 30_000 + "</article>")[0]) == 450_000


# --- licences -----------------------------------------------------------------------------


def test_phrases_counted_everywhere():
    r = random.Random(3)
    scanner = licenses.Scanner()
    pool = "under the mit license apache version 2 cc by nc other words licensed".split()
    for _ in range(300):
        text = " ".join(r.choice(pool) for _ in range(r.randrange(80)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = []
        for _, phrase in licenses.BASE_PHRASES:
            p = phrase.split()
            places += [k for k in range(len(words)) if words[k : k + len(p)] == p]
        n, got, *_ = scanner.scan(text.encode())
        assert n == len(words) and sorted(got) == sorted(places)


def test_matching_statistics():
    r = random.Random(4)
    templates = [[r.randrange(4) for _ in range(12)] for _ in range(3)]
    a = licenses.Automaton.of(templates, [[0, 1]])
    text = [r.randrange(5) for _ in range(200)]
    inside = {tuple(t[i:j]) for t in [*templates, [0, 1]] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for k, (_, n) in enumerate(a.statistics(text)):
        assert n == max(m for m in range(14) if m == 0 or tuple(text[k + 1 - m : k + 1]) in inside and m <= k + 1)


def test_template_with_a_gap_is_covered():
    text = b"Licensed under the GNU General Public License, version 3 of 2007."
    *_, labels, score, spans = licenses.Scanner().scan(text)
    assert labels == ["gpl"] and score == 1.0 and spans


def plain_cover(text, template, least, gap):
    """The most tokens of a template that a chain of common runs covers, over all chains."""
    runs = []
    for i in range(len(text)):
        for j in range(len(template)):
            if text[i] == template[j] and not (i and j and text[i - 1] == template[j - 1]):
                n = 0
                while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                    n += 1
                if n >= least:
                    runs.append((i + n, j + n, n))

    def after(run, covered):
        best = covered
        for e, p, n in runs:
            new = min(n, p - run[1], e - run[0])
            if new > 0 and (e, p) > run[:2] and e - n - run[0] <= gap:
                best = max(best, after((e, p, n), covered + new))
        return best

    return max((after(r, r[2]) for r in runs), default=0)


def test_chains_are_the_best_of_all():
    r = random.Random(14)
    for _ in range(150):
        texts = [[r.choice("abc") for _ in range(10)] for _ in range(2)]
        params = licenses.Scan(min_match=2, max_gap=3, phrases=(("x", "zz"),), templates=tuple((f"t{k}", " ".join(t)) for k, t in enumerate(texts)))
        scanner = licenses.Scanner(params)
        words = [r.choice("abcd") for _ in range(14)]
        *_, spans = scanner.scan(" ".join(words).encode())
        got = {k: round(c * 10) for k, _, _, c in spans}
        for k, template in enumerate(texts):
            assert got.get(k, 0) == plain_cover(words, template, 2, 3), (words, texts)


def test_all_occurrences_count():
    inner = licenses.Scan(templates=(("a", "one two three four five six seven eight"), ("b", "three four five six seven")))
    *_, labels, _, _ = licenses.Scanner(inner).scan(b"one two three four five six seven eight")
    assert labels == ["a", "b"]
    run = "p q r s t u"
    twice = licenses.Scan(templates=(("t", f"{run} a b c d {run} e f g h"),))
    *_, labels, score, _ = licenses.Scanner(twice).scan(f"{run} x a b c d y {run} x e f g h".encode())
    assert labels == ["t"] and score == 1.0
    mit = " ".join(next(t for t in licenses.TEMPLATES if t[0] == "mit" and len(t) > 5)[1:])
    *_, labels, score, _ = licenses.Scanner().scan(f"Copyright (c) 2024 Somebody. {mit}".encode())
    assert labels == ["mit"] and score == 1.0


# --- sharding -----------------------------------------------------------------------------


def test_sharding_laws(spark):
    r = random.Random(5)
    texts = [f"text {r.randrange(300)}" for _ in range(900)] + [f"single {k}" for k in range(1200)] + ["hot"] * 1100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(df).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    where = {r["doc_id"]: r["shard"] for r in rows}
    groups = {}
    for k, t in enumerate(texts[:900]):
        groups.setdefault(t, []).append(where[k])
    linked = [g for g in groups.values() if len(g) > 1]
    together = sum(max(Counter(g).values()) for g in linked) / sum(map(len, linked))
    assert together > 0.8  # at random, about 0.35
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]]) + 16 for r in rows)


# --- URL filters --------------------------------------------------------------------------


def test_inline_and_joined_rules_agree(spark, sf):
    pages = read(spark, sf, "pages").select("page_id", "url")
    pages = pages.union(spark.createDataFrame([(-1, "http://a.b.org/porn/x"), (-2, "http://c.net/casino/"), (-2, "http://c.net/casino/"), (-3, None)], "page_id long, url string"))
    a = sorted(map(str, urlfilter.judge_urls(pages).collect()))
    assert a == sorted(map(str, urlfilter.judge_urls(pages, inline_rules=0).collect()))
    assert sum("verdict='block'" in x for x in a) > 2


def test_rule_tokens():
    assert urlfilter.UrlRule("block", "example.org", "/en/1").tokens == ["example", "org", "en"]
    assert urlfilter.UrlRule("block", "", "*/ab/cd*ef/gh/*", True).tokens == ["ab", "gh"]
    assert urlfilter.UrlRule("block", "ab.cd*.ef.gh", "/", True).tokens == ["ab", "ef", "gh"]


@pytest.mark.parametrize("inline_rules", [0, 1000])
def test_block_list_lines(spark, inline_rules):
    rules = urlfilter.read_rules("! remark\n\n||bad.example^\n||shop.example/cart/*/pay\n@@||bad.example/ok/\n/banner/\n||cdn*.ads.example\npixel.gif\n".split("\n"))
    assert len(rules) == 6
    want = {
        "http://bad.example/": "block", "http://x.bad.example/a": "block", "http://notbad.example/": "allow", "http://bad.example/ok/1": "allow",
        "http://shop.example/cart/7/pay": "block", "http://shop.example/cart/pay": "allow", "http://a.net/x/banner/y": "block", "http://a.net/banner": "allow",
        "http://cdn7.ads.example/": "block", "http://ads.example/": "allow", "http://a.net/i/pixel.gif": "block", "http://a.net/" + "long/" * 5000 + "banner/": "block",
    }
    df = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r["url"]: r["verdict"] for r in urlfilter.judge_urls(df, (), rules, inline_rules).collect()} == want
    with pytest.raises(ValueError):
        urlfilter.read_rules(["example.com##.ad"])


def test_method_rules_fit_hosts_folders_and_files(spark):
    urls = [f"http://{w}.a.net/" for w in urlfilter.BLOCKED_WORDS] + [f"http://a.net/x/{w}{end}" for w in urlfilter.BLOCKED_WORDS for end in ("/", ".html")]
    fine = ["http://a.net/trackers/", "http://essex.net/", "http://a.net/adsorption.html", "http://a.net/poker"]
    df = spark.createDataFrame([(u,) for u in urls + fine], "url string")
    assert {r["url"] for r in urlfilter.judge_urls(df).where("verdict = 'block'").collect()} == set(urls)


# --- SimHash ------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_near_duplicates(docs):
    rows = docs.collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    linked = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = plain_components(prints, linked)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{p:016x}", want[k]) for k, p in prints.items()}


def test_jvm_hash_is_the_contract_hash(spark):
    text = "héllo wörld again"
    got = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("file_rows", [1, 4, 64])
def test_links_are_exact_in_hot_files(spark, file_rows):
    r = random.Random(6)
    seeds = [r.getrandbits(64) for _ in range(4)]
    prints = set(seeds)
    for s in seeds:  # chains and balls around the seeds
        x = s
        for _ in range(60):
            x ^= 1 << r.randrange(64)
            prints.add(x)
            prints.add(s ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    prints = sorted(simhash._signed(p) for p in prints)
    want = plain_components(prints, [(a, b) for a, b in combinations(prints, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {x["node"]: x["root"] for x in components.connected_components(simhash.links(fps, simhash.SimHash(file_rows=file_rows))).collect()}
    sets = lambda m: {frozenset(n for n in prints if m.get(n, n) == c) for c in {m.get(n, n) for n in prints}}
    assert sets(roots) == sets(want)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[k] for k in range(201)}) == 1 and len({got[1000 + k] for k in range(300)}) == 1 and got[5000] == got[5001]
    assert len(set(got.values())) == 3


# --- language model -----------------------------------------------------------------------


def test_base_scores_and_counts(docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    tokens = {k: [*t.lower().split(), "\n"] for k, t in rows.items()}
    train = Counter(t for k, ts in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for t in ts)
    n, v = sum(train.values()), len(train)
    for table_words in (0, 10, 100_000):
        got = {r["doc_id"]: r for r in pitman_yor.score_documents(docs, pitman_yor.PitmanYor(table_words=table_words)).collect()}
        for k, ts in tokens.items():
            r = got[k]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(train[t] > 0 for t in ts), n)
            assert math.isclose(r["base_score"], sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        if table_words:
            assert all(math.isclose(got[k]["score"], scores[k], rel_tol=1e-4) for k in tokens)
        scores = {k: r["score"] for k, r in got.items()}


def test_probabilities_sum_to_one(docs):
    m = pitman_yor.PitmanYor()
    counts = pitman_yor.count_tokens(docs.select(F.col("text").cast("binary").alias("text"))).persist()
    words = counts.count()
    totals = pitman_yor.sample(counts, words, m)
    model = pitman_yor.predictive(counts, totals, m).collect()
    kept = totals[1 + m.burn_in :]
    for context in range(pitman_yor.CONTEXTS):
        if not kept[0].customers[context]:
            continue
        total = np.mean([t.back_off(m)[context] * t.root(m, 0, 0) for t in kept])
        for r in model:
            total += r["p"][r["cls"].index(context)] if context in r["cls"] else np.mean([t.back_off(m)[context] * p for t, p in zip(kept, r["p0"], strict=True)])
        assert abs(total - 1) < 1e-4


def test_scores_by_the_word_before(spark, monkeypatch):
    rng = random.Random(3)
    words = ["ta", "ma", "ka", "on", "in", "un"]  # contexts of one class are told apart
    texts = [" ".join(w for _ in range(rng.randint(1, 6)) for w in rng.choice([["ta", "on"], ["ma", "in"], ["ka", rng.choice(words)], [f"w{rng.randint(0, 40)}a", "un"]])) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), *((k, t) for k, t in ((1002, "ta on"), (1003, "ta in"), (1004, "never on")))], "doc_id long, text string")
    tokens = {r["doc_id"]: [*r["text"].split(), "\n"] for r in docs.collect()}
    train = [t for k, t in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    pairs = Counter((u, w) for t in train for u, w in zip(["", *t], t, strict=False))
    customers, types = Counter(), Counter(u for u, _ in pairs)
    for (u, _), n in pairs.items():
        customers[u] += n
    real, held = pitman_yor.predictive, {}
    monkeypatch.setattr(pitman_yor, "_drop", lambda df: None)
    monkeypatch.setattr(pitman_yor, "predictive", lambda counts, totals, m: held.update(counts=counts, totals=totals) or real(counts, totals, m))
    for table_words in (0, 5, 1000):
        m = pitman_yor.PitmanYor(table_words=table_words)
        got = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(docs, m).collect()}
        model, kept = {bytes(r["token"]).decode(): r for r in real(held["counts"], held["totals"], m).collect()}, held["totals"][1 + m.burn_in :]
        assert {(u, w) for w, r in model.items() for u in {u for u, _ in pairs} if pitman_yor.context_id(u.encode()) in r["ctx"]} == set(pairs)

        def p(u, w, model=model, kept=kept, m=m):
            ctx, r, all_ = pitman_yor.context_id(u.encode()), model.get(w), []
            cls = pitman_yor.START if u == "" else u.encode()[-1] & 31
            for s, t in enumerate(kept):
                above = t.back_off(m)[cls] * (r["p0"][s] if r else t.root(m, 0, 0))
                if r and cls in r["cls"]:
                    above = r["each"][r["cls"].index(cls) * len(kept) + s]
                tables = types[u] + int(t.further(np.array([ctx]))[0])
                all_.append((m.word_strength + m.word_discount * tables) / (m.word_strength + customers[u]) * above)
            own = r["own"][r["ctx"].index(ctx)] if r and ctx in r["ctx"] else 0.0
            return own / (m.word_strength + customers[u]) + np.mean(all_)

        for u in ("", "ta", "ka", "never"):
            assert abs(sum(p(u, w) for w in model) + p(u, "no such word") - 1) < 1e-4
        for k, t in tokens.items():
            assert math.isclose(got[k], sum(math.log10(p(u, w)) for u, w in zip(["", *t], t, strict=False)), rel_tol=1e-4)
        assert p("ta", "on") > 10 * p("ta", "in") and p("ma", "in") > 10 * p("ma", "on")


def test_held_out_perplexity_beats_the_base(spark):
    rows = pitman_yor.score_documents(read(spark, "/root/testdata/sf0.01", "documents")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > rows["b"]


def test_blocks_hold_every_row_within_their_bounds(monkeypatch):
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 100)
    monkeypatch.setattr(pitman_yor, "BLOCK_DOCS", 8)
    rng = random.Random(4)
    texts = [None if k % 9 == 0 else b" Ab\x0bc  " * rng.choice([0, 1, 3, 40]) for k in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 30], pa.binary())], ["text"]) for k in range(0, 200, 30)]
    tables = [t.column(0).to_pylist() for t in pitman_yor._blocks(batches)]
    assert [x for t in tables for x in t] == texts
    assert all(len(t) == 1 or (len(t) <= 8 and sum(len(x or b"") for x in t) <= 100) for t in tables)
    for t in tables:
        b = pitman_yor.block_of(pa.array(t, pa.binary()), 5)
        words, mask = [*b.words.to_pylist(), b""], (1 << b.bits) - 1
        got = Counter((words[p >> b.bits], words[p & mask], k) for j, p in enumerate(b.pairs.tolist()) for k in b.text[b.ends[j] : b.ends[j + 1]].tolist())
        tokens = [[*(x or b"").lower().split(), b"\n"] for x in t]
        assert got == Counter((w, u, k) for k, ws in enumerate(tokens) for u, w in zip([b"", *ws], ws, strict=False))
        assert b.sizes.tolist() == [len(ws) for ws in tokens]


def test_words_of_contexts_are_the_same_sent_or_joined(docs):
    pairs = pitman_yor.count_pairs(docs.select(F.col("text").cast("binary").alias("text"))).persist()
    contexts = pitman_yor.contexts_of(pairs).persist()
    table = pitman_yor.frequent_contexts(contexts, pitman_yor.PitmanYor(table_words=5))
    types = {r["ctx"]: r["types"] for r in contexts.collect()}
    for max_rows in (0, 1_000_000):
        for r in pitman_yor.with_types(pairs, contexts, table, max_rows).collect():
            ctx, n, got = (np.frombuffer(r[c], np.int64).tolist() for c in ("ctx", "n", "types"))
            assert got == [types[u] for u, k in zip(ctx, n, strict=True) if k > 1]


def test_seating_matches_one_by_one():
    rng = np.random.default_rng(1)
    c = np.full(4000, 20)
    got = pitman_yor.seat(c, np.full(4000, 2.0), 0.5, rng).mean()
    total = 0
    for _ in range(4000):
        t = 1
        for seated in range(1, 20):
            t += rng.random() < 2.0 / (seated - 0.5 * t + 2.0)
        total += t
    assert abs(got - total / 4000) < 0.15


# --- SentencePiece ------------------------------------------------------------------------


def test_encoding_equals_the_library_and_decodes(spark, sf):
    texts = [r["text"] for r in read(spark, sf, "documents").collect()] + [r["html"] for r in read(spark, sf, "pages").collect()]
    texts += ["", " ", "  a  b   ", "日本語テキスト", "x" * 500, "a\n\tb 😀 ünï", "aaaaaaaaaaaaaaaaaaaaa bbb", "    def f(x):\n        return 1"]
    r = random.Random(7)
    texts += ["".join(r.choice("abcdeinorst ABC.,;01é") for _ in range(300)) for _ in range(50)]
    c = spm.Codec()
    ids = c.encode(texts)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    assert [x.tolist() for x in ids] == library.encode(texts, num_threads=1)
    assert [c.decode(x) for x in ids] == texts


def test_unigram_models_take_the_best_path():
    c = spm.Codec()
    object.__setattr__(c, "model", pieces.Model(c.model.pieces, c.model.scores, c.model.kinds, False, True, False))
    c.cache.clear()
    score = dict(zip(c.texts, c.scores, strict=True))

    def best(word):
        top = [(0.0, None)] + [(-math.inf, None)] * len(word)
        for j in range(1, len(word) + 1):
            top[j] = max((top[i][0] + score[word[i:j]], i) for i in range(max(0, j - 16), j) if word[i:j] in score)
        return top[-1][0]

    for text in ("hello there", "tokenization", "antidisestablishmentarianism"):
        got = c.encode([text])[0]
        assert math.isclose(sum(c.model.scores[k] for k in got), sum(best(w) for w in c.words(text)))


# --- decontamination ----------------------------------------------------------------------


@pytest.mark.parametrize("inline_hashes", [0, 4000])
def test_contained_items(spark, inline_hashes):
    r = random.Random(8)
    pool = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(pool) for _ in range(r.choice([1, 3, 5, 6, 12, 40, 90])))) for k in range(40)]
    docs = []
    for k in range(80):
        words = [r.choice(pool) for _ in range(r.randrange(300))]
        for _ in range(2):
            part = r.choice(items)[1].split()
            if r.random() < 0.5:
                part[r.randrange(len(part))] = "changed"
            at = r.randrange(len(words) + 1)
            words[at:at] = part[: max(1, len(part) - r.randrange(3))]
        docs.append((k, " ".join(words)))
    shingles = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = set()
    for d, t in docs:
        for k, x in items:
            n = min(5, len(x.split()))
            own = shingles(x.split(), n)
            found = len(own & shingles(t.split(), n))
            if 100 * found >= 80 * len(own):
                want.add((d, k, len(own), found))
    params = decontam.Containment(inline_hashes=inline_hashes)
    got = decontam.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), params)
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in got.collect()} == want and len(want) > 40


# --- quality ------------------------------------------------------------------------------


def test_repeat_words(spark):
    r = random.Random(9)
    texts = []
    for _ in range(120):
        words = [r.choice("abcdefgh") + str(r.randrange(6)) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = words[: r.randrange(20)]
        texts.append(" ".join(words))

    def plain(text):
        w = text.split()
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        return len({k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)})

    rows = quality.quality_verdicts(spark.createDataFrame([(k, t, "h") for k, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in rows} == {k: plain(t) for k, t in enumerate(texts)}
    assert sum(plain(t) > 0 for t in texts) > 20


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"g{k}" for k in range(30))
    rows = [(k, "short", "bad") for k in range(95)] + [(100 + k, good, "bad") for k in range(5)]
    rows += [(1000 + k, f"{good} {k}", f"fine{k % 9}") for k in range(300)] + [(2000, "short", "fine1"), (2001, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality.quality_verdicts(df).where("kept").collect()}
    assert kept == {*range(1000, 1300), 2001}
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == kept


def test_noisy_documents_go(spark):
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(words), " ".join([*words[:27], "a#", "b*", "<c"]), " ".join([*words[:26], "a#", "b*", "<c", "d|"]), "#" * 50, None]
    df = spark.createDataFrame([(k, t, "h" if k < 3 else f"h{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = {r["doc_id"]: r for r in quality.quality_verdicts(df, quality.QualityRules(max_host_rate=1.0)).collect()}
    assert [rows[k]["n_symbols"] for k in range(5)] == [0, 3, 4, 50, 0]
    assert [rows[k]["kept"] for k in range(5)] == [True, True, False, False, False]
    assert not rows[2]["base_failed"]
    assert {r["doc_id"] for r in quality.keep_good(df, quality.QualityRules(max_host_rate=1.0)).collect()} == {0, 1}


# --- near copies in the pipeline ----------------------------------------------------------


def five_words(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def test_minhash_is_the_least_of_each_function():
    times, plus = simhash._factors(8)
    own = simhash.shingle_set(" ".join(f"w{k}" for k in range(700)).encode(), 5)
    want = []
    for t, p in zip(times.tolist(), plus.tolist(), strict=True):
        every = [(h * t + p) % 2**64 for h in own.tolist()]
        want.append(min(((x ^ x >> 29) * int(simhash._MIX)) % 2**64 for x in every))
    assert simhash.minhash(own, times, plus).tolist() == want


def test_near_copies_share_a_block():
    near, r = simhash.Near(), random.Random(12)
    times, plus = simhash._factors(near.blocks * near.rows)
    keys = lambda own: set(simhash.blocks_of(simhash.minhash(np.array(sorted(own), np.uint64), times, plus), near).tolist())
    shared = apart = 0
    for _ in range(300):
        both = {r.getrandbits(64) for _ in range(80)}
        only = [r.getrandbits(64) for _ in range(20)]
        shared += bool(keys(both | set(only[:10])) & keys(both | set(only[10:])))  # similarity 0.8
        apart += bool(keys(set(list(both)[:20]) | set(only)) & keys(both))  # 0.2
    assert shared == 300 and apart < 30


@pytest.mark.parametrize("file_rows", [2, 64])
def test_near_copies_fall_together_and_others_stay(spark, file_rows):
    r = random.Random(10)
    pool = [f"w{k}" for k in range(3000)]
    texts, groups = [], []
    for g in range(60):
        words = [r.choice(pool) for _ in range(r.randrange(150, 400))]
        texts.append(" ".join(words))
        groups.append(g)
        for _ in range(g % 4):  # near copies: two words changed
            copy = list(words)
            for _ in range(2):
                copy[r.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
            groups.append(g)
        half = words[: len(words) // 2] + [r.choice(pool) for _ in range(len(words) // 2)]
        texts.append(" ".join(half))  # shares half: not a copy
        groups.append(1000 + g)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    params = simhash.SimHash(file_rows=file_rows)
    root = {x["doc_id"]: x["root"] for x in simhash.near_groups(df, params).collect()}
    linked = [(a, b) for a, b in combinations(range(len(texts)), 2) if groups[a] == groups[b]]
    similar = [(a, b) for a, b in linked if len(five_words(texts[a]) & five_words(texts[b])) >= 0.8 * len(five_words(texts[a]) | five_words(texts[b]))]
    assert len(similar) > 90 and sum(root[a] == root[b] for a, b in similar) >= 0.97 * len(similar)
    assert all(root[a] != root[b] for a, b in combinations(range(len(texts)), 2) if groups[a] != groups[b])
    kept = [x["doc_id"] for x in simhash.keep_one(df, params).collect()]
    assert len(kept) == len(set(root.values()))


def similar_pairs(texts):
    """All pairs of a five-word similarity of 0.8 or more, by brute force."""
    own = [five_words(t) for t in texts]
    return [(a, b) for a, b in combinations(range(len(texts)), 2) if 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b])]


def assert_groups_are(spark, texts, pairs):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {x["doc_id"]: x["root"] for x in simhash.near_groups(df).collect()}
    missed = [(a, b) for a, b in pairs if root[a] != root[b]]
    assert not missed, f"{len(missed)} of {len(pairs)}"
    return root


def test_appended_replaced_and_repeated_passages(spark):
    r = random.Random(21)
    pool = [f"w{k}" for k in range(5000)]
    some = lambda n: [r.choice(pool) for _ in range(n)]
    texts, apart = [], []
    for k in range(120):
        words, n = some(300), 300
        texts.append(" ".join(words))
        if k % 3 == 0:  # a paragraph appended, similarity 0.80 to 0.85
            texts.append(" ".join(words + some(52 + k % 20)))
        elif k % 3 == 1:  # a paragraph replaced, similarity 0.80 to 0.85
            at, n = r.randrange(200), 22 + k % 6
            texts.append(" ".join(words[:at] + some(n) + words[at + n :]))
        else:  # a passage repeated
            texts.append(" ".join(words + words[40:70] * 20))
        apart.append(" ".join(words[:200] + some(100)))
    pairs = similar_pairs(texts)
    assert len(pairs) == 120
    root = assert_groups_are(spark, texts + apart, pairs)
    assert len(set(root.values())) == 240


def test_pairs_within_large_mixed_files(spark):
    """Every shingle is held by hundreds of texts that are no copies of one another."""
    r = random.Random(22)
    parts = [" ".join(f"p{k}x{j}" for j in range(12)) for k in range(20)]
    texts = []
    for _ in range(150):
        words = " ".join(parts[k] for k in sorted(r.sample(range(20), 10))).split()
        texts.append(" ".join(words))
        texts.append(" ".join(words[:-1] if r.random() < 0.5 else words[:60] + ["new"] + words[60:]))
    pairs = similar_pairs(texts)
    assert len(pairs) >= 150
    roots = list(range(len(texts)))
    for a, b in pairs:
        roots = [roots[a] if x == roots[b] else x for x in roots]
    root = assert_groups_are(spark, texts, pairs)
    assert len(set(root.values())) == len(set(roots))
