"""The pipeline's stages in their order, on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from sketchloom.llm import decontam, langid, simhash, spm
from sketchloom.llm.common import read


def test_stages(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "decontamination", "sentencepiece"]
    docs = first = read(spark, sf, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == first.columns
        before = docs.count()
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= before
    kept = docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert decontam.contained_items(kept, read(spark, sf, "benchmark")).count() == 0
    classes = simhash.near_duplicates(kept).collect()
    assert len({r["component_id"] for r in classes}) == len(classes)
    assert langid.keep_identified(kept).count() == kept.count()
    codec = spm.Codec()
    assert all(r["decodes"] and codec.decode(r["tokens"]) == r["text"] for r in docs.select("text", "tokens", "decodes").collect())
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


CLASHES = ["host", "tokens", "n_tokens", "decodes", "component_id", "fingerprint", "lang_pred", "score", "failed", "kept", "leak_id", "uid", "item_id", "h"]


def _save(spark, folder, documents, benchmark):
    documents.write.parquet(f"{folder}/documents.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_dirty_rows_change_nothing_for_the_others(spark, sf, tmp_path):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text and clashing columns."""
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect() if r["doc_id"] is not None)
    clean = ids(corpus_pipeline.run(spark, sf))
    nothing = [(None,) * len(docs.columns)]
    blank = [tuple({"doc_id": 10**6 + k, "text": t}.get(c) for c in docs.columns) for k, t in enumerate(["", " \t\n", "12345 !!!", None])]
    long = docs.where(docs.doc_id == clean[0]).withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda k: F.concat(F.lit("lonely"), k)), " ")).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)).withColumn("source", F.lit(None).cast("string"))
    dirty = docs.unionByName(docs.where(docs.doc_id % 3 == 0)).union(spark.createDataFrame(nothing * 2 + blank, docs.schema)).unionByName(long)
    dirty = dirty.withColumns({c: F.lit(f"own {c}") for c in CLASHES if c not in docs.columns})
    broken = items.union(items).union(spark.createDataFrame([(None,) * len(items.columns)], items.schema)).union(items.withColumn("text", F.lit("")).select(*items.columns))
    folder = _save(spark, tmp_path, dirty, broken)
    kept, sizes = read(spark, folder, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, kept, folder)
        assert kept.columns == dirty.columns
        kept.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        assert all(r[c] == f"own {c}" for c in CLASHES if c not in docs.columns for r in kept.select(c).distinct().collect())
        sizes.append(kept.where("text is null or trim(text) = ''").count())
    assert sizes == [0, 0, 0, 0] and ids(kept) == clean
    last = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    assert last.count() == kept.count()
    text_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == text_of[r["doc_id"]] for r in last.collect() if r["doc_id"] is not None)


def test_empty_tables(spark, sf, tmp_path):
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    assert corpus_pipeline.run(spark, _save(spark, tmp_path / "a", docs.limit(0), items)).count() == 0
    assert corpus_pipeline.run(spark, _save(spark, tmp_path / "b", docs, items.limit(0))).count() > 0
    assert corpus_pipeline.run(spark, _save(spark, tmp_path / "c", spark.createDataFrame([(None,) * len(docs.columns)] * 3, docs.schema), items)).count() == 0
