"""Nulls in any column, empty and very long texts, repeated rows, empty tables, clashing extra columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontaminate, language_id, lm_scoring, near_dup, piece_codec, suffix_dedup, surrogates, token_binary, toxicity


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_language(odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    got = language_id.predict(odd_docs, model).collect()
    assert len(got) == 12 and {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert language_id.fit(no_docs) is None and language_id.predict(no_docs, None).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, None).collect()} == {"und"}


def test_decontaminate(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while many other animals"), (None, "x y"), (2, None), (3, ""), (4, "one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd_docs, bench).collect()}
    assert {(1, 1), (2, 1), (10, 1), (7, 4)} <= got
    kept = decontaminate.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} >= {None, 3, 4, 5, 6}
    assert decontaminate.contaminated(no_docs, bench).count() == 0 and decontaminate.contaminated(odd_docs, bench.limit(0)).count() == 0


def test_repeated_strings(odd_docs, no_docs):
    got = suffix_dedup.repeated_strings(odd_docs, 40).collect()
    assert len(got) == 12
    for r in got:
        if r["doc_id"] in (3, 4):
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (0, 0, 0, hashlib.sha256(b"").hexdigest())
        if r["doc_id"] in (1, 2):
            assert r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1
    assert suffix_dedup.repeated_strings(no_docs, 40).count() == 0


def test_token_files(odd_docs, no_docs, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    spark = odd_docs.sparkSession
    got = token_binary.read_tokens(spark, token_binary.write_tokens(odd_docs, str(tmp_path / "a"), path), with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert all(r["ids"][-1] == 0 and len(r["ids"]) == r["n_tokens"] for r in got) and [r["n_tokens"] for r in got if r["doc_id"] in (3, 4)] == [1, 1]
    assert token_binary.read_tokens(spark, token_binary.write_tokens(no_docs, str(tmp_path / "b"), path)).count() == 0


def test_pieces(odd_docs, no_docs):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = piece_codec.encode_decode(odd_docs, path).collect()
    assert len(got) == 12 and all(r["ids"] == [2] and r["decoded"] == "" for r in got if r["doc_id"] in (3, 4))
    assert by_id(got)[9]["decoded"].startswith("é")
    assert piece_codec.encode_decode(no_docs, path, full=False).count() == 0


def test_near_duplicates(odd_docs, no_docs):
    got = near_dup.near_duplicates(odd_docs, 2).collect()
    assert len(got) == 12
    one = by_id(got)
    assert {one[i]["component_id"] for i in (1, 2, 10)} == {1} and not one[2]["kept"]
    assert one[7]["component_id"] == 7 == one[8]["component_id"]
    assert all(one[i]["kept"] and one[i]["n_shingles"] == 0 and one[i]["component_id"] == i for i in (3, 4, 5))
    assert one[None]["kept"] and one[None]["component_id"] is None
    assert near_dup.near_duplicates(no_docs, 2).count() == 0


def test_toxicity(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 1), (6, 0), (None, 1), (7, 5), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got) and all(r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    none = toxicity.fit(no_docs, labels.limit(0))
    assert toxicity.score(no_docs, none).count() == 0 and {r["score"] for r in toxicity.score(odd_docs, none).collect()} == {0.0}
    assert toxicity.reject(odd_docs, model).columns == odd_docs.columns


def test_surrogates(odd_docs, no_docs):
    extra = odd_docs.withColumn("_pii_map", F.lit(1)).withColumn("value", F.lit("v")).withColumn("canon", F.lit("c"))
    got = surrogates.replace(extra)
    rows = got.collect()
    assert got.columns == extra.columns and len(rows) == 12
    nine = by_id(rows)[9]
    assert "123-45-6789" not in nine["text"] and "a@b" not in nine["text"] and nine["n_chars"] == len(nine["text"])
    assert by_id(rows)[3]["text"] is None and surrogates.replace(no_docs).count() == 0


def test_language_model(odd_docs, no_docs):
    docs = odd_docs.withColumn("train", F.lit(True))
    got = lm_scoring.score_documents(docs).collect()
    assert len(got) == 12 and all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (3, 4, 5))
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert lm_scoring.score_documents(no_docs.withColumn("train", F.lit(True))).count() == 0
    untrained = lm_scoring.score_documents(docs.withColumn("train", F.lit(False))).collect()
    assert {r["n_known"] for r in untrained} == {0} and {r["base_score"] for r in untrained} == {0.0}


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark, odd_docs, tmp_path, empty):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.limit(0) if empty else docs
    spark.createDataFrame([(1, 0, 0), (6, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "word0 tail0. word1 tail1. word2 tail2. word3 tail3. word4 tail4.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if empty:
            assert docs.count() == 0
    if not empty:
        assert sorted((r["doc_id"] for r in docs.collect()), key=str) == sorted([1, 3, 4, 5, 7, 9, None], key=str)


def test_pipeline_on_the_tables(spark):
    """The whole run against its stages' own decisions by brute force."""
    import re

    from tests.llm.test_ops import brute_groups

    data = "/root/testdata/sf0.001"
    full = spark.read.parquet(f"{data}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in full.collect()]
    model = toxicity.fit(full, spark.read.parquet(f"{data}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(full, model).collect() if r["score"] >= 0.5}
    left = [(d, t) for d, t in docs if d not in bad]
    groups = brute_groups(left, 5)
    left = [(d, t) for d, t in left if groups[d][2]]
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    left = [(d, t) for d, t in left if not any(i in t for i in items)]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, data).collect()}
    assert set(got) == {d for d, _ in left}
    for d, t in left:
        if not re.search(r"\d|@", t):
            assert got[d]["decoded"] == t
