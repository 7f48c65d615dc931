from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shoebox.llm.mixing import mix_documents, mix_sources
from tests.llm.texts import edge_docs


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Source -> target by dealing the excess again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if part[s] > cap * sizes[s]}
        if not full:
            return out | part
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def check(frame, near):
    rows = mix_sources(frame).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    docs = frame.collect()
    key = lambda x: str(x)
    assert sorted(((r["doc_id"], r["size"], r["source"]) for r in rows), key=key) == sorted(((d["doc_id"], words(d["text"]), d["source"]) for d in docs), key=key)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near(s, want[s]), s
    assert mix_sources(frame).exceptAll(mix_sources(frame.repartition(3))).count() == 0


def test_targets_and_taken_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = F.when(F.col("doc_id") % 50 == 7, None).when(F.col("doc_id") % 3 == 0, "éa").otherwise(F.col("source"))
    check(docs.withColumn("source", odd), lambda s, t: 0.005 * t + 20)


def test_edge_cases(spark):
    frame = edge_docs(spark)
    check(frame, lambda s, t: 60_000)
    assert mix_sources(frame.limit(0)).count() == 0
    silent = frame.where("doc_id in (3, 4, 5)")
    assert {r["taken"] for r in mix_sources(silent).collect()} == {0}


def test_the_mix_holds_each_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.where("doc_id = 5")).withColumn("rate", F.lit(1))
    wanted = mix_sources(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0")
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    lost = wanted.where("doc_id <> 5").exceptAll(got.where("doc_id <> 5")).count()
    assert lost == 0 and got.where("doc_id <> 5").exceptAll(wanted).count() == 0
