from __future__ import annotations

import re

from pyspark.sql import functions as F

from shoebox.llm.pii import find_personal_data, mask_personal_data
from tests.llm.texts import edge_docs, real_docs

# The plain forms; the library uses possessive ones.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


ODD = [
    "a@b.c_d@e.f x@y z@w.", "a@b.c.d.e..f", "..a@-.-", "1.2.3.4.5.6.7.8.9", "256.1.1.1 00001.2.3.255", "1.2.3.4444444444",
    "4111 1111-1111 1111", "4111  1111", "+1 (415) 555-0100.", "+1-2", "++12345678901+", "😀 +49 30 1234567 é 10.0.0.1 é a@b.de",
    "5555555555554444 5555555555554444", "x" * 3000 + "@", "9" * 3000, "1." * 2000, ("+1 " * 500), "a@b.c," * 400,
]


def test_base_spans_equal_plain_patterns(spark):
    texts = ODD + [None, ""]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    for part in (frame, real_docs(spark, 200), edge_docs(spark)):
        texts_ = {}
        for r in part.collect():
            texts_.setdefault(r["doc_id"], []).append(base(r["text"]))
        got = find_personal_data(part).collect()
        assert len(got) == part.count()
        for r in got:
            mine = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
            assert mine in texts_[r["doc_id"]]
            every = [(s["start"], s["rank"]) for s in r["spans"]]
            assert every == sorted(every)


def test_masks_hide_every_span_and_nothing_else(spark):
    frame = real_docs(spark, 200)
    before = {r["doc_id"]: r for r in frame.collect()}
    spans = {r["doc_id"]: r["spans"] for r in find_personal_data(frame).collect()}
    masked = mask_personal_data(frame)
    assert masked.columns == frame.columns
    for r in masked.collect():
        text, at, out = before[r["doc_id"]]["text"], 0, ""
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                out += text[at : s["start"]] + f"<{s['kind'].upper()}>"
            at = max(at, s["end"])
        assert r["text"] == out + text[at:] and r["n_chars"] == len(r["text"])
    assert sum(map(len, spans.values())) > 10
    touched = masked.join(frame.withColumnRenamed("text", "old"), "doc_id").where("text <> old").count()
    assert touched == sum(1 for s in spans.values() if s)


def test_edge_cases(spark):
    frame = edge_docs(spark)
    assert mask_personal_data(frame).exceptAll(frame.withColumn("n_chars", F.length("text").cast("bigint"))).count() == 0
    assert find_personal_data(frame.limit(0)).count() == 0 and mask_personal_data(frame.limit(0)).count() == 0


def test_secrets_and_names_are_masked_whole(spark):
    long = "Ab3_" * 5000
    texts = [
        f"x api_key={long} y", f"token=abc.DEF123.{'q9' * 200}== end", "password: aaaabbbbccccdddd1. Next", "Ask Dr Jane Smith today", "Dr Müller came",
        "Prof. Ana María O'Neill-Ünal spoke", "secret=short", "Dr who",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in mask_personal_data(docs).collect()}
    assert got == {
        0: "x <SECRET> y", 1: "<SECRET> end", 2: "<SECRET>. Next", 3: "Ask <NAME> today", 4: "<NAME> came", 5: "<NAME> spoke", 6: "secret=short", 7: "Dr who",
    }
