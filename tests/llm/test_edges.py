"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from sketchloom.llm import decontam, html_extract, langid, licenses, pitman_yor, quality, sharding, simhash, spm, urlfilter

LONG = " ".join(f"word{k % 5000} and more" for k in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog " * 5, "en", "a", 5),
    (1, "the quick brown fox jumps over the lazy dog " * 5, "en", "a", 5),  # a repeated row
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "le chat est sur la table et il dort bien " * 4, "fr", "b", 3),
    (4, " \t\n ", "fr", "b", 3),
    (5, LONG, "en", None, 1),
    (6, "12345 !!! ???", "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ["host", "path", "rule", "verdict", "score", "lang_pred", "_lang_pred", "fp", "tag", "tokens", "n_tokens", "h", "uid", "_host", "kept", "shard", "slot", "size", "g"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASHES}).persist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_language_id(docs, none):
    rows = langid.predict_languages(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {2, 3, 4, 6}
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0) for r in rows)
    assert langid.predict_languages(none).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, None, 5}


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.predict_languages(df).collect()] == [("und", 0.0)]


def test_html(spark):
    rows = [(1, "http://x.org/a", "<p>a</p>"), (1, "http://x.org/a", "<p>a</p>"), (2, None, None), (3, "no scheme", ""), (None, "http://x.org/b", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("uid", F.lit(2))
    found = {(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    assert found == {(1, "a", 1), (2, "", 0), (3, "", 0), (None, "deep", 4)}
    assert html_extract.extract(pages).count() == 5
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_licenses(docs, none):
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == len(ROWS)
    empty = next(r for r in rows if r["doc_id"] == 2)
    assert (empty["n_words"], empty["n_base"], empty["first_word"], empty["labels"], empty["score"]) == (0, 0, None, "", 0.0)
    assert licenses.scan_licenses(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, sharding.Sharding(shards=3)).collect()
    assert len(rows) == len(ROWS)
    assert sorted(r["size"] for r in rows)[:3] == [16, 16, 20]
    assert sharding.shard_documents(none).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://Sub.Example.ORG/en/12?x"), (3, "HTTP://Sub.Example.ORG/en/12?x"), (4, "http://example.org"), (5, "x://a.com/de/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("own")).withColumn("verdict", F.lit("own"))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages).collect()}
    assert found == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("sub.example.org", "/en/12", "example.org/en/1", "block"),
        4: ("example.org", "", None, "allow"), 5: ("a.com", "/de/", "com/de/", "block"),
    }
    assert urlfilter.judge_urls(pages).count() == 6
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: r for r in rows}
    assert {found[k]["component_id"] for k in (2, 3, 4)} == {2} and found[2]["fingerprint"] == "0" * 16
    assert found[None]["component_id"] is None
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 6]
    assert simhash.keep_one(none).count() == 0


def test_scores(docs, none):
    rows = pitman_yor.score_documents(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert pitman_yor.score_documents(none).count() == 0


def test_scores_without_training(spark):
    held = next(k for k in range(100) if __import__("zlib").crc32(str(k).encode()) % 7 == 2)
    row = pitman_yor.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, 0.0)


def test_pieces(docs, none):
    out = spm.encode_documents(docs)
    assert out.columns == [*docs.columns, "_n_tokens", "ids_crc32", "decodes", "_tokens"]
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r["decodes"] and r["_n_tokens"] == len(r["_tokens"]) for r in rows)
    assert {r["_n_tokens"] for r in rows if not r["text"]} == {0}
    assert spm.encode_documents(none).count() == 0


def test_contained(spark, docs, none):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "lazy dog"), (4, "lazy dog")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in decontam.contained_items(docs, items).collect()}
    assert found == {(1, 1, 5, 5), (1, 4, 1, 1)}
    assert decontam.contained_items(none, items).count() == 0
    assert decontam.contained_items(docs, items.limit(0)).count() == 0
    left = decontam.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 2


def test_quality(docs, none):
    rows = quality.quality_verdicts(docs).collect()
    assert len(rows) == len(ROWS)
    empty = next(r for r in rows if r["doc_id"] == 2)
    assert (empty["n_words"], empty["word_chars"], empty["n_dup_lines"], empty["base_failed"], empty["kept"]) == (0, 0, 0, True, False)
    assert quality.quality_verdicts(none).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert quality.keep_good(none).count() == 0


def test_op8_returns_the_piece_ids(spark, sf):
    from sketchloom.llm import queries

    codec = spm.Codec()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts) and all(codec.decode(r["tokens"]) == texts[r["doc_id"]] and len(r["tokens"]) == r["n_tokens"] for r in rows)
