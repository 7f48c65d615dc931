from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.llm.common import crc_of_id
from shoebox.llm.langid import T, ByteTagger, cut_windows, detect_languages, training_windows
from tests.llm.texts import edge_docs

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    got = detect_languages(docs, crc_of_id() % 4 != 2, steps=150).join(docs, "doc_id")
    held = got.where(crc_of_id() % 4 == 2)
    right, total = held.where("lang = lang_pred").count(), held.count()
    assert total > 20 and right / total >= 0.95
    assert got.where("score < 0 or score > 1").count() == 0


def test_edge_cases(spark):
    frame = edge_docs(spark)
    got = detect_languages(frame, F.lit(True), steps=5).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert len(got) == frame.count() and by[1][0] == by[1][1]
    assert by[3] == by[4] == by[5] == [("und", 0.0)]
    assert {x[0] for x in by[8]} <= {"en", "de", "fr"}
    assert detect_languages(frame.limit(0), F.lit(True)).count() == 0
    untaught = detect_languages(frame, F.lit(False)).select("lang_pred").distinct().collect()
    assert [r[0] for r in untaught] == ["und"]


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = ByteTagger(["a", "b", "c"], hidden=3)
    for x in model.parameters():
        x += (rng.standard_normal(x.shape) * 0.1).astype(np.float32)
    tokens = rng.integers(97, 103, (7, 5)).astype(np.uint8)
    label, asked = np.array([0, 1, 2, 0, 1]), np.ones((7, 5), bool)
    asked[2, 3] = False
    _, grads = model.gradients(tokens, label, asked)
    for x, g in zip(model.parameters(), grads):
        place = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = x[place], 1e-2
        x[place] = old + step
        up, _ = model.gradients(tokens, label, asked)
        x[place] = old - step
        down, _ = model.gradients(tokens, label, asked)
        x[place] = old
        assert abs((up - down) / (2 * step) - g[place]) <= 0.02 * abs(g[place]) + 1e-4


def test_windows_cover_every_byte():
    texts = [b"", b"x" * T, b"y" * (T + 1), b"z"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    windows, doc, _ = cut_windows(data, offsets)
    assert [b"".join(w.tobytes() for w in windows[doc == i]).rstrip(b"\0") for i in range(4)] == texts


def test_sample_follows_from_the_texts_alone(spark):
    docs = spark.read.parquet(DOCS).where("lang is not null").select("text", "lang")
    want = training_windows(docs, 12)
    hot = docs.orderBy("text").limit(1)
    copies = hot.crossJoin(spark.range(500)).select("text", "lang")
    again = training_windows(docs.unionByName(copies).repartition(7, "text"), 12)
    assert want[0] == again[0]
    assert (want[1] == again[1]).all() and (want[2] == again[2]).all()
    texts = docs.groupBy("lang").agg(F.countDistinct("text").alias("n")).collect()
    assert np.bincount(want[2]).max() <= 12 * 4 and len(want[0]) == len(texts)
    with pytest.raises(ValueError):
        training_windows(docs, 12, most_languages=1)


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(DOCS).limit(120)
    one = {r["doc_id"]: r for r in detect_languages(docs, crc_of_id() % 4 != 2, steps=20).collect()}
    two = detect_languages(docs.repartition(5, "text"), crc_of_id() % 4 != 2, steps=20).collect()
    assert len(two) == len(one)
    for r in two:
        assert r["lang_pred"] == one[r["doc_id"]]["lang_pred"] and r["score"] == pytest.approx(one[r["doc_id"]]["score"], abs=1e-5)


def test_documents_match_a_plain_forward_pass():
    model = ByteTagger(["a", "b", "c"], hidden=3)
    texts = ["Grüße an alle! " * 9, "", "12 34", "short", "x" * (2 * T)]
    data = [t.encode() for t in texts]
    got = model.documents(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))

    def logistic(x):
        return 1 / (1 + math.exp(-x))

    def states(layer, window):
        k, h, out = layer.u.shape[0], [0.0] * layer.u.shape[0], []
        for byte in window:
            x, g = layer.w[byte], [sum(h[i] * layer.u[i][j] for i in range(k)) for j in range(3 * k)]
            reset = [logistic(x[j] + g[j]) for j in range(k)]
            keep = [logistic(x[k + j] + g[k + j]) for j in range(k)]
            new = [math.tanh(x[2 * k + j] + reset[j] * (g[2 * k + j] + layer.b[j])) for j in range(k)]
            h = [n + z * (old - n) for n, z, old in zip(new, keep, h)]
            out.append(h)
        return out

    for text, row in zip(data, got):
        total, letters = [0.0] * 3, 0
        for at in range(0, len(text), T):
            window = text[at : at + T].ljust(T, b"\0")
            forth, back = states(model.forth, window), states(model.back_, window[::-1])[::-1]
            for byte, f, b in zip(window, forth, back):
                if not (65 <= byte <= 90 or 97 <= byte <= 122 or byte >= 128):
                    continue
                logit = [sum(s * model.v[i][j] for i, s in enumerate(f + b)) + model.c[j] for j in range(3)]
                mass = [math.exp(x - max(logit)) for x in logit]
                total = [t + m / sum(mass) for t, m in zip(total, mass)]
                letters += 1
        assert row == pytest.approx([t / max(letters, 1) for t in total], abs=1e-4)
