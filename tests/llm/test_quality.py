from __future__ import annotations

import numpy as np

from shoebox.llm.quality import LABELLERS, keep_good, label_posteriors, measures, quotas, score_documents, train, votes
from tests.llm.texts import edge_docs


def test_agrees_with_labels_it_never_saw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = score_documents(docs).join(labels, "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in rows)
    clean_lost = sum(not r["kept"] for r in rows if r["quality"] == 1)
    assert len(rows) > 300 and right / len(rows) >= 0.97 and clean_lost <= 3


def test_edge_cases(spark):
    frame = edge_docs(spark)
    got = score_documents(frame).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["score"], r["kept"]))
    assert len(got) == frame.count() and by[1][0] == by[1][1] and by[6] == by[7]
    assert by[3] == by[4] == by[5] == [(0, 0.0, False)]
    kept = keep_good(frame)
    assert kept.columns == frame.columns and kept.where("text is null").count() == 0
    assert keep_good(frame.limit(0)).count() == 0


def test_em_finds_each_fault():
    rng = np.random.default_rng(6)
    k = len(LABELLERS)
    votes = np.ones((3000, k), np.int8)
    fault = rng.integers(0, k, 300)
    votes[np.arange(300), fault] = 0
    votes[rng.random(votes.shape) < 0.05] = -1
    votes[300 + rng.integers(0, 2700, 8), rng.integers(0, k, 8)] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, reliability = label_posteriors(patterns, counts.astype(float))
    poor = (patterns == 0).any(axis=1)
    assert (p[poor] < 0.5).all() and (p[~poor] > 0.5).all()
    assert all(good > 0.98 and own > 0.7 for good, own in reliability.values())


CLEAN = {
    "zh": "我们昨天去了图书馆，借了三本关于历史的书。今天下午天气很好，所以大家决定去公园散步。 老师说，GPU 可以用来训练模型。 ",
    "ja": "昨日は友達と一緒に映画を見に行きました。とても面白かったので、また行きたいと思います。 NHK のニュースによると、明日は雨が降るそうです。 ",
    "th": "เมื่อวานนี้เราไปห้องสมุดและยืมหนังสือประวัติศาสตร์สามเล่ม วันนี้อากาศดีมากทุกคนจึงไปเดินเล่นที่สวนสาธารณะ ",
    "hi": "कल हम पुस्तकालय गए और इतिहास की तीन किताबें लाए। आज मौसम बहुत अच्छा है इसलिए सब लोग बगीचे में टहलने गए। ",
    "ru": "Вчера мы ходили в библиотеку и взяли три книги по истории. Сегодня погода хорошая, поэтому все пошли гулять. ",
}
LIST = "Milk and bread\nFresh green apples\nTwo bottles of water\nBrown sugar\nOlive oil\nPepper\nCoffee beans\nA bag of rice\nDry pasta\nTomato soup\nSoft cheese\nLemon juice\nPaper towels\nHand soap"


def _cast(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return dict(zip(LABELLERS, votes(*measures(data, np.array([0, len(data)])))[0].tolist()))


def test_latin_thresholds_stay_silent_elsewhere():
    for name, text in CLEAN.items():
        found = _cast(text * 6)
        assert all(found[x] == -1 for x in ("capitals", "lengths", "stops")), name
    assert _cast(LIST)["stops"] == -1 and 0 not in _cast(LIST).values()
    assert _cast(" ".join(f"word{i} and" for i in range(40)))["stops"] == 0
    assert _cast("Größe über Äpfel und Birnen، süße Öfen؛ " * 8)["stops"] == 1


def test_clean_texts_of_other_scripts_and_lists_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = []
    for text in (*CLEAN.values(), LIST):
        gap = "\n" if "\n" in text else " "
        parts = [p for p in text.split(gap) if p]
        more += [gap.join((parts[k % len(parts) :] + parts[: k % len(parts)]) * (2 + k // 5)) for k in range(10)]
    extra = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    rows = score_documents(docs.unionByName(extra)).where("doc_id >= 1000000000").collect()
    assert len(rows) == 60 and all(r["kept"] for r in rows)


def test_quotas():
    assert quotas([5, 1000, 3, 2000], 100) == [5, 46, 3, 46]
    assert quotas([5, 6], 100) == [5, 6] and quotas([9, 9, 9], 2) == [1, 1, 1] and quotas([], 5) == []


def test_rare_fault_is_learned_from_a_small_sample(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstu"), rng.integers(3, 9)))
    clean = lambda: " ".join(word() + ("." if i % 7 == 6 else "") for i in range(50))
    shout = lambda: " ".join(w.upper() + "!!" for w in clean().split())
    rows = [(i, shout() if i % 250 == 3 else clean()) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in score_documents(frame, sample_docs=32).collect()}
    assert not any(kept[i] for i in range(3, 4000, 250)) and sum(kept.values()) > 3950


def test_model_is_of_the_rows_and_not_of_their_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a, b = (train(docs.repartition(n), sample_docs=40, rounds=20) for n in (1, 5))
    assert (a.weights == b.weights).all() and a.bias == b.bias and a.weights.any()
