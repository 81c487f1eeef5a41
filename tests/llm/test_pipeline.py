"""The pipeline and the registered queries next to plain versions, on the smallest tables."""

import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lumicat.llm import decontaminate, quality
from lumicat.llm.base import ready
from tests.llm import common as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return ready(spark).read.parquet(f"{SF}/documents.parquet")


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names}


def test_join_and_repeats_queries(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = entry.queries()["op4_ngram_jaccard_join"](spark, SF)
    assert C.ordered(got.select("doc_id", "n_shingles", "component_id").collect()) == C.ordered(C.join_brute(rows))
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in C.repeats_brute(rows)]
    got = entry.queries()["op9_substring_dedup"](spark, SF)
    assert C.ordered(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == C.ordered(want)


def test_pipeline_equals_plain_stages(spark, docs):
    from tokenizers import Tokenizer

    from lumicat.llm import bpe

    good = quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, C.join_brute(rows)) if d == c]
    rows = [(d, kept if gone else t) for (d, t), (_, _, gone, kept) in zip(rows, C.repeats_brute(rows))]
    scanned = decontaminate.scan(C.frame(spark, rows), spark.read.parquet(f"{SF}/benchmark.parquet"))
    bad = {r.doc_id for r in scanned.where("contaminated").collect()}
    plain = Tokenizer.from_file(bpe.default_path())
    want = {d: len(plain.encode(t, add_special_tokens=False).ids) for d, t in rows if d not in bad}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)


def test_stages_keep_the_columns(spark, docs):
    some = docs.limit(40).selectExpr("*", "1 AS score", "2 AS `class`", "3 AS row", "4 AS kept")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, some, SF)
        assert out.dtypes == some.dtypes
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, some.limit(0), SF).count() == 0
