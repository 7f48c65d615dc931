"""Language of documents: a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes. The network reads each window in both
directions, gives every byte a distribution over languages, and a document's
probabilities are the mean over the bytes of its letters. It is trained here,
in numpy, by backpropagation through time, on a bounded sample of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import small_batches
from .textpack import mix, slices

T = 64
HIDDEN = 8
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent layer: ``w`` by input byte, ``u`` by state, ``b`` inside the reset gate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.w = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(hidden, np.float32)

    def run(self, tokens: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the tokens (steps, batch), as (steps, batch, hidden)."""
        k = self.u.shape[0]
        h = np.zeros((tokens.shape[1], k), np.float32)
        out = np.empty((len(tokens), tokens.shape[1], k), np.float32)
        for t, byte in enumerate(tokens):
            x, g = self.w[byte], h @ self.u
            gate = _sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
            r, z = gate[:, :k], gate[:, k:]
            m = g[:, 2 * k :] + self.b
            n = np.tanh(x[:, 2 * k :] + r * m)
            if keep is not None:
                keep.append((h, r, z, m, n))
            h = n + z * (h - n)
            out[t] = h
        return out

    def back(self, tokens: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of w, u and b, through all steps, from those of the states."""
        k = self.u.shape[0]
        d_h = np.zeros_like(d_out[0])
        d_x = np.empty((len(tokens), tokens.shape[1], 3 * k), np.float32)
        d_u, d_b = np.zeros_like(self.u), np.zeros_like(self.b)
        for t in range(len(tokens) - 1, -1, -1):
            h, r, z, m, n = kept[t]
            d_h = d_h + d_out[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (h - n) * z * (1 - z)
            d_r = d_n * m * r * (1 - r)
            d_m = d_n * r
            d_g = np.concatenate([d_r, d_z, d_m], axis=1)
            d_x[t] = np.concatenate([d_r, d_z, d_n], axis=1)
            d_u += h.T @ d_g
            d_b += d_m.sum(axis=0)
            d_h = d_h * z + d_g @ self.u.T
        flat = tokens.reshape(-1)
        d_w = np.zeros_like(self.w)
        order = np.argsort(flat, kind="stable")
        present, first = np.unique(flat[order], return_index=True)
        d_w[present] = np.add.reduceat(d_x.reshape(-1, 3 * k)[order], first, axis=0)
        return [d_w, d_u, d_b]


class ByteTagger:
    """Both directions and a softmax on every position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forth, self.back_ = Direction(rng, hidden), Direction(rng, hidden)
        self.v = (rng.standard_normal((2 * hidden, len(languages))) * 0.3).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.forth.w, self.forth.u, self.forth.b, self.back_.w, self.back_.u, self.back_.b, self.v, self.c]

    def _softmax(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.v + self.c
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=-1, keepdims=True)

    def positions(self, tokens: np.ndarray) -> np.ndarray:
        """P(language) of every position of windows (steps, batch)."""
        states = np.concatenate([self.forth.run(tokens), self.back_.run(tokens[::-1])[::-1]], axis=2)
        return self._softmax(states)

    def gradients(self, tokens: np.ndarray, label: np.ndarray, counts: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients over windows (steps, batch); counts marks the positions that are asked."""
        kept_f: list = []
        kept_b: list = []
        forth = self.forth.run(tokens, kept_f)
        back = self.back_.run(tokens[::-1], kept_b)
        states = np.concatenate([forth, back[::-1]], axis=2)
        p = self._softmax(states)
        total = max(1, int(counts.sum()))
        picked = np.take_along_axis(p, np.broadcast_to(label[None, :, None], (*tokens.shape, 1)), axis=2)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * counts).sum() / total)
        d = p.copy()
        np.put_along_axis(d, np.broadcast_to(label[None, :, None], (*tokens.shape, 1)), (picked - 1)[..., None], axis=2)
        d *= (counts / total)[..., None].astype(np.float32)
        k = self.forth.u.shape[0]
        flat = d.reshape(-1, d.shape[2])
        d_states = (flat @ self.v.T).reshape(states.shape)
        out = self.forth.back(tokens, kept_f, d_states[..., :k])
        out += self.back_.back(np.ascontiguousarray(tokens[::-1]), kept_b, d_states[::-1, :, k:])
        return loss, out + [states.reshape(-1, 2 * k).T @ flat, flat.sum(axis=0)]

    def fit(self, windows: np.ndarray, label: np.ndarray, steps: int, batch: int = 256, rate: float = 0.02, seed: int = 5) -> float:
        """Adam over random batches of windows (n, T); returns the last smoothed loss."""
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(x) for x in self.parameters()]
        second = [np.zeros_like(x) for x in self.parameters()]
        smooth = 0.0
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            tokens = np.ascontiguousarray(windows[pick].T)
            loss, grads = self.gradients(tokens, label[pick], _LETTER[tokens])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for x, g, m, s in zip(self.parameters(), grads, first, second):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                x -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            smooth = loss if step == 1 else 0.95 * smooth + 0.05 * loss
        return smooth

    def documents(self, data: np.ndarray, offsets: np.ndarray, batch: int = 4096) -> np.ndarray:
        """Mean P(language) over the letters of each text (0 without letters)."""
        windows, doc, _ = cut_windows(data, offsets)
        texts, n = len(offsets) - 1, len(self.languages)
        total = np.zeros((texts, n))
        letters = np.zeros(texts)
        for start in range(0, len(windows), batch):
            tokens = np.ascontiguousarray(windows[start : start + batch].T)
            asked = _LETTER[tokens]
            mass = np.einsum("tbl,tb->bl", self.positions(tokens), asked.astype(np.float32))
            own = doc[start : start + batch]
            letters += np.bincount(own, asked.sum(axis=0), texts)
            for j in range(n):
                total[:, j] += np.bincount(own, mass[:, j], texts)
        return total / np.maximum(letters, 1)[:, None]


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in windows of T that do not cross texts, padded with zero bytes.

    Returns the windows, the text of each and its start.
    """
    count = -(-np.diff(offsets) // T)
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[doc] + place * T
    at = start[:, None] + np.arange(T)
    inside = at < offsets[doc + 1][:, None]
    padded = np.r_[data, np.zeros(1, np.uint8)]
    return np.where(inside, padded[np.minimum(at, len(data))], 0).astype(np.uint8), doc, start


def training_windows(
    docs: DataFrame, per_language: int, each: int = 4, most_languages: int = 1000
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``per_language`` different texts of every language (all, if fewer), ``each`` windows of a text.

    docs: text, lang (not null). Of each language the texts of least hash are
    taken, so a sample follows from the texts alone: not from their order, their
    files or how often a text is repeated. More than ``most_languages`` languages
    are refused, as the sample comes to the driver.
    """
    keyed = docs.where(F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = keyed.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= per_language).drop("place")
    if least.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    # At most per_language rows of each language: a bounded table.
    drawn = keyed.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes, found = batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64), []
            for start, end, data, offsets in slices(batch.column(2)):
                windows, doc, at = cut_windows(data, offsets)
                begin = (at - offsets[doc]).astype(np.uint64)
                rank = mix(begin + mix(hashes[start:end].copy())[doc])
                order = np.lexsort((rank, doc))
                first = np.searchsorted(doc[order], np.arange(end - start + 1))
                for i in range(end - start):
                    for w in order[first[i] : min(first[i + 1], first[i] + each)]:
                        found.append((langs[start + i], windows[w].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], ["lang", "bytes"]
            )

    rows = sorted((r[0], bytes(r[1])) for r in drawn.mapInArrow(draw, "lang string, bytes binary").collect())
    languages = sorted({r[0] for r in rows})
    windows = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, T)
    return languages, windows, np.array([languages.index(r[0]) for r in rows], np.int64)


def detect_languages(
    docs: DataFrame, train: Column, *, per_language: int = 800, steps: int = 300
) -> DataFrame:
    """Predicted language of every document: doc_id, lang_pred, score.

    docs: doc_id, text, lang; other columns are ignored. Rows where ``train``
    holds and lang is not null teach the network, through at most
    ``per_language`` different texts of each language, those of least hash: the
    model is the same for any order, layout and repetition of the rows. A
    prediction looks at the whole text and at nothing else. A text that is null or has no letter, and
    any text when there is nothing to learn from, is ``und`` with score 0.
    Repeated rows are predicted each; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    languages, windows, label = training_windows(docs.where(train & F.col("lang").isNotNull()), per_language)
    model = ByteTagger(languages) if len(windows) else None
    if model is not None:
        model.fit(windows, label, steps)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for start, end, data, offsets in slices(batch.column(1)):
                if model is None:
                    lang += [UNKNOWN] * (end - start)
                    score += [0.0] * (end - start)
                    continue
                p = model.documents(data, offsets)
                best, sure = p.argmax(axis=1), p.max(axis=1)
                solid = np.r_[0, np.cumsum(_LETTER[data] & (data < 128))]
                for i in range(end - start):
                    known = solid[offsets[i + 1]] > solid[offsets[i]] or any(
                        c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    )
                    lang.append(languages[best[i]] if known else UNKNOWN)
                    score.append(min(1.0, float(sure[i])) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double")
