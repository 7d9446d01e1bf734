"""The pipeline and the registered queries: stage by stage against brute force."""

import collections
import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from emberline.llm import quality

from .test_corpus import brute_contaminated, brute_link, plain_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_stages(spark):
    docs = table(spark, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near duplicates", "decontamination", "personal data", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF)
        if name != "packing":
            assert docs.columns == before.columns
        rows = before.collect()
        if name == "quality":
            keep = {r["doc_id"] for r in quality.score(before, quality.train(before, table(spark, "labels"))).where("keep").collect()}
            assert {r["doc_id"] for r in docs.collect()} == keep and 0 < len(keep) < len(rows)
        elif name == "near duplicates":
            assert {r["doc_id"] for r in docs.collect()} == {i for i, _, c in brute_link([(r["doc_id"], r["text"]) for r in rows]) if i == c}
        elif name == "decontamination":
            bad = {i for i, *_ in brute_contaminated([(r["doc_id"], r["text"]) for r in rows], [tuple(r) for r in table(spark, "benchmark").select("item_id", "text").collect()])}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in rows} - bad
        elif name == "personal data":
            new = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert len(new) == len(rows)
            for r in rows:
                if not plain_spans(r["text"]):
                    assert new[r["doc_id"]] == r["text"]
                else:
                    assert not any(r["text"][s:f] in new[r["doc_id"]] for k, s, f in plain_spans(r["text"]) if k == "email")
        else:
            pieces = docs.collect()
            total = collections.Counter()
            for p in pieces:
                total[p["doc_id"]] += p["length"]
            assert set(total) == {r["doc_id"] for r in rows} and all(p["doc_tokens"] == total[p["doc_id"]] for p in pieces)
        docs = docs.cache()


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_stages_on_odd_input(spark, odd_docs, no_docs, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert (docs.count() > 0) == (start is odd_docs)


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


def test_quality_query_returns_every_document(spark):
    docs = table(spark, "documents")
    out, kept = entry.queries()["op8_quality"](spark, SF), quality.kept(docs, table(spark, "labels"))
    assert "keep" in out.columns and out.count() == docs.count() > kept.count()
    assert {r[0] for r in out.where("keep").select("doc_id").collect()} == {r[0] for r in kept.select("doc_id").collect()}
