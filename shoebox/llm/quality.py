"""Quality of documents from weak labels.

Heuristic labellers vote good, poor or abstain. Expectation-maximisation over
the counts of vote patterns estimates how often each is right on good documents
and on those with the fault it looks for; the posteriors label a bounded sample that trains a
hashed linear scorer, which then judges every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import small_batches
from .textpack import hash_words, mix, slices, word_bounds

#: Labellers and the words a text needs before they say anything.
LABELLERS = {"symbols": 5, "tails": 5, "repeats": 8, "variety": 20, "capitals": 5, "lengths": 10, "stops": 30}
BITS = 14

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
#: Stops of other scripts, as the big-endian value of their two or three bytes.
_STOPS_2, _STOPS_3 = (
    np.array([int.from_bytes(c.encode(), "big") for c in marks], np.int64) for marks in ("،؛؟۔։", "。，、；：！？．।॥…។៕၊။།።፣፤፧")
)
#: Labellers whose thresholds are those of Latin prose.
LATIN_ONLY = ("capitals", "lengths", "stops")


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a Latin letter starts in UTF-8, and where one of another script does."""
    lead, next_ = data, np.r_[data[1:], np.zeros(1, np.uint8)][: len(data)]
    latin = ((lead | 32) >= 97) & ((lead | 32) <= 122) | (lead >= 0xC3) & (lead <= 0xC9) | (lead == 0xE1) & (next_ >= 0xB8) & (next_ <= 0xBB)
    # Not letters: joined accents, general marks and symbols, CJK marks, private and full-width forms, emoji.
    other = (lead >= 0xCA) & ~latin & (lead != 0xCC) & ~((lead == 0xCD) & (next_ < 0xB0)) & (lead != 0xE2)
    other &= ~((lead == 0xE3) & (next_ == 0x80)) & (lead != 0xEE) & ~((lead == 0xEF) & (next_ >= 0xB8)) & ~((lead == 0xF0) & (next_ == 0x9F))
    return latin, other


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Words of each text and what the labellers look at, all as shares or means.

    ``foreign`` says that most letters are not Latin, ``listed`` that a text
    without stops is in lines which alone are too short to miss one.
    """
    starts, ends, first = word_bounds(data, offsets)
    texts = len(offsets) - 1
    n = np.diff(first)
    doc = np.repeat(np.arange(texts), n)
    h = hash_words(data, starts, ends)
    total = lambda x: np.bincount(doc, weights=x, minlength=texts)
    each = np.maximum(n, 1)
    solid = np.r_[0, np.cumsum(_ALNUM[data])]
    last, before = data[ends - 1], data[np.maximum(ends - 2, starts)]
    same = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if len(h) else np.zeros(0, bool)
    order = np.lexsort((h, doc))
    fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])] if len(h) else np.zeros(0, bool)
    upper = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
    ascii_ = np.r_[0, np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))]
    signs = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    latin, other = (np.r_[0, np.cumsum(x)] for x in _letters(data))
    lines = np.r_[0, np.cumsum(data == 10)]
    two, one = np.maximum(ends - 2, starts), np.maximum(ends - 3, starts)
    pair = data[two].astype(np.int64) << 8 | last
    stop = _STOP[last] | np.isin(pair, _STOPS_2) | np.isin(data[one].astype(np.int64) << 16 | pair, _STOPS_3)
    span = lambda c: c[offsets[1:]] - c[offsets[:-1]]
    distinct = np.bincount(doc[order][fresh], minlength=texts)
    return n, {
        "symbols": total(solid[ends] == solid[starts]) / each,
        "tails": total((ends - starts >= 3) & ~_ALNUM[last] & (last == before)) / each,
        "repeats": total(same) / each,
        "variety": distinct / np.sqrt(each),
        "capitals": span(upper) / np.maximum(span(ascii_), 1),
        "lengths": total(signs[ends] - signs[starts]) / each,
        "stops": total(stop) / each,
        "foreign": span(other) > span(latin),
        "listed": (total(stop) == 0) & (n < LABELLERS["stops"] * (span(lines) + 1)),
    }


def silent(n: np.ndarray, m: dict[str, np.ndarray], name: str) -> np.ndarray:
    """Texts on which a labeller says nothing."""
    out = n < LABELLERS[name]
    if name in LATIN_ONLY:
        out = out | m["foreign"]
    return out | m["listed"] if name == "stops" else out


def votes(n: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """1 good, 0 poor, -1 abstains: one row per text, one column per labeller."""

    found = {
        "symbols": (m["symbols"] > 0.1, m["symbols"] < 0.02),
        "tails": (m["tails"] > 0.15, m["tails"] < 0.03),
        "repeats": (m["repeats"] > 0.15, m["repeats"] < 0.06),
        "variety": (m["variety"] < 2.0, m["variety"] > 5.0),
        "capitals": (m["capitals"] > 0.5, m["capitals"] < 0.2),
        "lengths": ((m["lengths"] < 2) | (m["lengths"] > 16), (m["lengths"] > 2.5) & (m["lengths"] < 12)),
        "stops": ((m["stops"] > 0.6) | (m["stops"] == 0), (m["stops"] > 0.01) & (m["stops"] < 0.4)),
    }
    cast = lambda poor, good, mute: np.where(mute, -1, np.where(poor, 0, np.where(good, 1, -1)))
    return np.stack([cast(*found[name], silent(n, m, name)) for name in LABELLERS], axis=1).astype(np.int8)


def feature_slots(data: np.ndarray, offsets: np.ndarray, n: np.ndarray, m: dict[str, np.ndarray]):
    """Hashed features: slots of byte triples by position, and one slot per measure and level.

    Returns the slots of all positions, the number of positions before each
    text, and the level slots (one row per text).
    """
    wide = data.astype(np.uint64)
    inside = np.ones(len(data), bool)
    for back in (1, 2):  # a triple does not cross the end of its text
        inside[np.maximum(offsets[1:] - back, offsets[:-1])[np.diff(offsets) >= back]] = False
    at = np.flatnonzero(inside[: max(len(data) - 2, 0)])
    triple = (wide[at] << np.uint64(16)) | (wide[at + 1] << np.uint64(8)) | wide[at + 2]
    slot = ((triple * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    levels = []
    for i, name in enumerate(LABELLERS):
        scaled = m[name] if name in ("variety", "lengths") else m[name] * 20
        # Level 20 says nothing: the measure does not fit the text.
        level = np.where(silent(n, m, name), 20, np.minimum(np.floor(scaled), 19)).astype(np.uint64)
        levels.append((mix(level + np.uint64(1000 * (i + 1))) >> np.uint64(64 - BITS)).astype(np.int64))
    return slot, np.searchsorted(at, offsets), np.stack(levels, axis=1)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    reliability: dict[str, tuple[float, float]]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of words and score of each text; a text without words scores 0."""
        n, m = measures(data, offsets)
        slot, first, levels = feature_slots(data, offsets, n, m)
        sums = np.r_[0.0, np.cumsum(self.weights[slot])]
        count = np.maximum(np.diff(first), 1)
        z = (sums[first[1:]] - sums[first[:-1]]) / count + self.weights[levels].sum(axis=1) + self.bias
        return n, np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def label_posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, false_alarm: float = 0.003):
    """EM over labellers that each look for one kind of fault.

    patterns: distinct rows of votes; counts: how often each occurs. A
    document is good or has, mainly, the fault of one labeller; each of these
    classes has its own chance of a poor vote per labeller, abstentions count
    as missing. (With one class for all poor documents, those with one fault
    get good votes from all other labellers and EM would explain the fault
    away.) Chances of poor votes on good documents have a prior of
    ``false_alarm`` that weighs as much as the data. Returns P(good) of each
    pattern and, per labeller, how often it is right on good documents and on
    those of its own fault.
    """
    k = patterns.shape[1]
    poor, cast = (patterns == 0).astype(float), (patterns >= 0).astype(float)
    p = np.hstack([np.where(poor.any(axis=1), 0.05, 0.95)[:, None], poor + 0.01])
    p /= p.sum(axis=1, keepdims=True)
    total = counts.sum() + 1
    hits = np.vstack([np.full(k, false_alarm * total), np.where(np.eye(k) > 0, 9.0, 1.0)])
    tries = np.vstack([np.full(k, total), np.full((k, k), 10.0)])
    for _ in range(rounds):
        mass = p * counts[:, None]
        share = (mass.sum(axis=0) + 0.1) / (mass.sum() + 0.1 * (k + 1))
        rate = ((mass.T @ poor + hits) / (mass.T @ cast + tries)).clip(1e-4, 1 - 1e-4)
        # A class keeps its meaning: at least half of its documents show its fault.
        rate[1:][np.eye(k) > 0] = rate[1:][np.eye(k) > 0].clip(0.5)
        logs = np.log(share) + poor @ np.log(rate).T + (cast - poor) @ np.log(1 - rate).T
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
    return p[:, 0], {name: (float(1 - rate[0, j]), float(rate[j + 1, j])) for j, name in enumerate(LABELLERS)}


def quotas(counts: list[int], sample_docs: int) -> list[int]:
    """Rows to draw of each pattern: all of the rare ones, an equal part of what is left of the others, one at least."""
    level, left = max(1, sample_docs), sample_docs
    for i, count in enumerate(sorted(counts)):
        level = max(1, left // (len(counts) - i))
        if count > level:
            break
        left -= count
    return [min(count, level) for count in counts]


def _pattern(n: np.ndarray, m: dict[str, np.ndarray]) -> list[str]:
    return ["".join("-+_"[v if v >= 0 else 2] for v in row) for row in votes(n, m)]


def train(docs: DataFrame, *, sample_docs: int = 4096, rounds: int = 300, seed: int = 7) -> QualityModel:
    """Votes on all documents, then the scorer from a sample of at most ``sample_docs``.

    The vote patterns are counted over every document; at most 3^7 of them
    exist. Each pattern gives the rows with the least hashes of doc_id and
    text, as many as ``quotas`` says, so every fault that EM finds is in the
    sample at every size; one row per pattern is drawn even if that exceeds
    ``sample_docs``. Repeated rows of one doc_id and text are drawn once. Only
    drawn rows carry features (at most 2^14 slots each) to the driver.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select("text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern, words = [], [np.zeros(0, bool)]
            for _, _, data, offsets in slices(batch.column(0)):
                n, m = measures(data, offsets)
                pattern += _pattern(n, m)
                words.append(n > 0)
            # A text without words is counted and never drawn.
            draw = pc.if_else(pa.array(np.concatenate(words)), batch.column(1), pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.string()), draw], ["pattern", "draw"])

    looked = keyed.mapInArrow(look, "pattern string, draw bigint").groupBy("pattern", "draw").agg(F.count("*").alias("n"))
    seen = cut_lineage(looked, "votes")
    rows = sorted(seen.groupBy("pattern").agg(F.sum("n"), F.count("draw")).collect())
    decode = lambda s: ["-+_".index(c) if c != "_" else -1 for c in s]
    patterns = np.array([decode(r[0]) for r in rows], np.int8).reshape(len(rows), len(LABELLERS))
    counts = {r[0]: r[1] for r in rows}
    posterior, reliability = label_posteriors(patterns, np.array(list(counts.values()), float))
    by_pattern = dict(zip(counts, posterior))
    quota = {r[0]: q for r, q in zip(rows, quotas([r[2] for r in rows], sample_docs))}
    # Draws are spread evenly; this many below the limit hold the least ones but for a chance of 1e-9.
    limit = {r[0]: min(1.0, (quota[r[0]] + 6 * np.sqrt(quota[r[0]]) + 20) / max(1, r[2])) * 2.0**64 - 2.0**63 for r in rows}

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = np.array([limit[p] for p in batch.column(0).to_pylist()], float)
            yield batch.filter(pa.array(batch.column(1).to_numpy(zero_copy_only=False) <= top))

    drawn: dict[str, list[int]] = {}
    for p, d in seen.where("draw is not null").select("pattern", "draw").mapInArrow(least, "pattern string, draw bigint").collect():
        drawn.setdefault(p, []).append(d)
    chosen = {d for p, found in drawn.items() for d in sorted(found)[: quota[p]]}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for batch in batches:
            at = []
            for i, d in enumerate(batch.column(1).to_pylist()):
                if d in chosen and d not in sent:
                    sent.add(d)
                    at.append(i)
            some = batch.take(pa.array(at, pa.int64()))
            pattern, slots, values = [], [], []
            for start, end, data, offsets in slices(some.column(0)):
                n, m = measures(data, offsets)
                pattern += _pattern(n, m)
                slot, first, levels = feature_slots(data, offsets, n, m)
                for i in range(end - start):
                    found, count = np.unique(slot[first[i] : first[i + 1]], return_counts=True)
                    share = count / max(1, count.sum())
                    slots.append(np.r_[found, levels[i]].astype("<u2").tobytes())
                    values.append(np.r_[share, np.ones(levels.shape[1])].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [some.column(1), pa.array(pattern, pa.string()), pa.array(slots, pa.binary()), pa.array(values, pa.binary())],
                ["draw", "pattern", "slots", "shares"],
            )

    taken = keyed.mapInArrow(features, "draw bigint, pattern string, slots binary, shares binary").dropDuplicates(["draw"])
    sample = sorted(taken.select("pattern", "slots", "shares").collect()) if chosen else []
    weights, bias = np.zeros(1 << BITS), 0.0
    if sample:
        row = np.repeat(np.arange(len(sample)), [len(s[1]) // 2 for s in sample])
        slot = np.frombuffer(b"".join(bytes(s[1]) for s in sample), "<u2").astype(np.int64)
        share = np.frombuffer(b"".join(bytes(s[2]) for s in sample), "<f4")
        target = np.array([by_pattern[s[0]] for s in sample])
        # Both classes pull equally, however rare poor documents are; within a class a pattern
        # pulls by the square root of its share, so that rare faults count at every size.
        size = Counter(s[0] for s in sample)
        root = {p: np.sqrt(counts[p]) for p in size}
        whole = {good: sum(v for p, v in root.items() if (by_pattern[p] > 0.5) == good) for good in (True, False)}
        pull = np.array([0.5 * root[s[0]] / whole[by_pattern[s[0]] > 0.5] / size[s[0]] for s in sample])
        square, bias_square = np.full(1 << BITS, 1e-8), 1e-8
        for _ in range(rounds):
            z = np.bincount(row, weights[slot] * share, len(sample)) + bias
            delta = pull * (target - 1 / (1 + np.exp(-z.clip(-30, 30))))
            gradient = np.bincount(slot, delta[row] * share, 1 << BITS) - 1e-5 * weights
            square += gradient**2
            weights += 0.3 * gradient / np.sqrt(square)
            bias_square += delta.sum() ** 2
            bias += 0.3 * delta.sum() / np.sqrt(bias_square)
    return QualityModel(weights, bias, reliability)


def _scored(docs: DataFrame, model: QualityModel, columns: str) -> DataFrame:
    """Rows of docs (doc_id, text first) with n_words and score."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, offsets in slices(batch.column(batch.schema.get_field_index("text"))):
                words, scores = model.scores(data, offsets)
                n.append(words)
                s.append(scores)
            keep = batch if "text" in columns.split(",") else batch.drop_columns(["text"])
            for name, value in (("_words", np.concatenate(n)), ("_score", np.concatenate(s))):
                keep = keep.append_column(name, pa.array(value))
            yield keep

    schema = docs.schema if "text" in columns.split(",") else docs.drop("text").schema
    from pyspark.sql.types import DoubleType, LongType, StructType

    out = StructType(list(schema.fields)).add("_words", LongType()).add("_score", DoubleType())
    return docs.mapInArrow(score, out)


def score_documents(docs: DataFrame, *, threshold: float = 0.5, sample_docs: int = 4096) -> DataFrame:
    """Quality of every document: doc_id, n_words, score, kept.

    docs: doc_id, text; other columns are ignored. kept is score >= threshold.
    A null text, an empty one and one without words score 0 and are rejected;
    equal texts score equally; an empty table gives no rows.
    """
    own = docs.select("doc_id", "text")
    scored = _scored(own, train(own, sample_docs=sample_docs), "doc_id")
    return scored.select(
        "doc_id", F.col("_words").alias("n_words"), F.col("_score").alias("score"), (F.col("_score") >= threshold).alias("kept")
    )


def keep_good(docs: DataFrame, *, threshold: float = 0.5, sample_docs: int = 4096) -> DataFrame:
    """The documents that ``score_documents`` keeps, with all their columns.

    Columns keep their names and values, whatever they are called. Null and
    empty texts go; repeated rows share their fate; an empty table stays empty.
    """
    model = train(docs.select("doc_id", "text"), sample_docs=sample_docs)
    # The row travels as one value, so that its names meet no others.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return _scored(rows, model, "row").where(F.col("_score") >= threshold).select("row.*")
