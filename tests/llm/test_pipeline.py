"""The stages one after another, each against what it must and must not do."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from shoebox.llm.minhash import keep_one_per_group
from shoebox.llm.pii import find_personal_data
from shoebox.session import cut_lineage
from tests.llm.test_minhash import sets_of
from tests.llm.texts import DOCS, edge_docs, real_docs


def test_stages(spark):
    docs, out = spark.read.parquet(DOCS), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, "/root/testdata/sf0.001"), name)
        out[name] = docs
    for name in ("quality", "near_duplicates", "personal_data", "mixing"):
        assert out[name].columns == out["input"].columns
    assert out["quality"].exceptAll(out["input"]).isEmpty()
    assert out["near_duplicates"].exceptAll(out["quality"]).isEmpty()
    rows = [tuple(r) for r in out["near_duplicates"].select("doc_id", "text").collect()]
    sets = sets_of(rows, 5)
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    kept = {r[0] for r in rows}
    gone = [(r["doc_id"], r["text"]) for r in out["quality"].collect() if r["doc_id"] not in kept]
    for lost in sets_of(gone, 5):  # nothing goes without a near copy that was there
        assert any(100 * len(lost & s) >= 80 * len(lost | s) for s in sets_of([(r["doc_id"], r["text"]) for r in out["quality"].collect()], 5) if s is not lost)
    assert {r[0] for r in out["personal_data"].select("doc_id").collect()} == kept
    assert find_personal_data(out["personal_data"]).where("exists(spans, s -> s.base)").isEmpty()
    copies = Counter(r[0] for r in out["mixing"].select("doc_id").collect())
    assert set(copies) <= kept and max(copies.values()) <= 2
    pieces = out["packing"].collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == copies


def test_columns_of_any_name_keep_their_values(spark):
    names = ["_score", "_words", "_size", "_found", "_bits", "_slot", "_row", "row", "found", "key", "unit", "root", "size", "copies", "mixed_size", "own", "done", "hidden"]
    docs = real_docs(spark, 120).select("*", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = cut_lineage(stage(spark, docs, ""), name)
        assert out.columns == docs.columns and out.count() > 20
        for n in names:
            assert out.where(F.col(n) != F.concat(F.lit(f"{n}:"), "doc_id")).isEmpty(), (name, n)


def test_a_document_goes_only_with_its_own_text(spark):
    a, b, c = ("the quick brown fox jumps over the lazy dog and runs", "an entirely different text of ten words stands right here now", "a third one that nobody else has written down before today ok")
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (3, b + " "), (4, None), (4, None), (5, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in keep_one_per_group(docs).select("doc_id", "text").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, a), (2, b), (None, c), (4, None), (5, ""), (None, "")]))


def test_edge_cases_and_empty_tables(spark):
    for docs in (edge_docs(spark), edge_docs(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, ""), name)
        docs.count()
