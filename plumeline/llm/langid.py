"""Language identification with averaged hashed subword embeddings and a linear softmax.

Subwords are the byte 2- to 4-grams of lower-cased text with everything but letters as
spaces, hashed into BUCKETS. A document is the mean of its subwords' embeddings, and a
linear softmax over it gives the languages. Embeddings and softmax are trained in
numpy by stochastic gradient descent, on a bounded sample of labelled documents and on
a short piece of each, so that short texts are known too. On a part of the sample that
is left out, a temperature is fitted and a score found below which predictions are
rejected (`accepted` is false; the nearest language is named all the same).

As both layers are linear, executors get their product: a row of language weights for
each bucket.

Nulls and edge cases: a text that is null or has no letter is `und` with score 0; a
null lang labels nothing; rows without doc_id are predicted and neither held out nor
learned from; without labelled rows everything is `und`; repeated rows are predicted
alike; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, texts
from .textarrays import LOWER, per_row, salt, slices

#: About so many labelled documents are sampled, and never more than MOST.
SAMPLE, MOST = 2000, 4000
BUCKET_BITS = 13
DIM, EPOCHS, RATE, BATCH = 16, 6, 0.5, 32
#: Bytes of the short piece of each sampled document.
PIECE = 48
#: Accepted held-out predictions are right in so many cases.
ACCEPTED_RIGHT = 0.99
GRAMS = (2, 3, 4)

LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True


def subwords(data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length, the bucket of each position and whether it counts."""
    letters = LETTER[LOWER[data]]
    b = np.where(letters, LOWER[data], 32).astype(np.uint32)
    left = np.repeat(rows[1:], np.diff(rows)) - np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
    for n in GRAMS:
        h = np.full(len(b), int(salt(n)) & 0xFFFFFFFF, np.uint32)
        some = np.zeros(len(b), bool)
        for j in range(n):
            k = max(0, len(b) - j)
            h[:k] = (h[:k] ^ b[j:]) * np.uint32(0x01000193)
            some[:k] |= letters[j:]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        yield h >> np.uint32(32 - BUCKET_BITS), some & (left >= n)


def has_letter(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each text has a letter, of whatever script."""
    low = LOWER[data]
    plain = per_row((low >= 0x61) & (low <= 0x7A), rows) > 0
    for i in np.flatnonzero(~plain & (per_row(data >= 0x80, rows) > 0)):
        plain[i] = any(c.isalpha() for c in data[rows[i] : rows[i + 1]].tobytes().decode("utf-8", "replace"))
    return plain


def remainder(k: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def sample(docs: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Lang, buckets and counts of sampled documents and of a short piece of each. Every labelled document has the same chance."""
    labelled = docs.filter("lang is not null and text is not null and doc_id is not null").filter(remainder(4) != 2)
    n = labelled.count()
    if not n:
        return []
    share = min(1.0, SAMPLE / n)
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(MOST)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, rows in slices(batch, 0):
                got = {"lang": [], "buckets": [], "counts": []}
                at = rows[:-1] + (np.diff(rows) // 3)
                ends = np.minimum(at + PIECE, rows[1:])
                for a, b in [*zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True), *zip(at.tolist(), ends.tolist(), strict=True)]:
                    found = [h[ok] for h, ok in subwords(data[a:b], np.array([0, b - a]))]
                    buckets, counts = np.unique(np.concatenate(found), return_counts=True)
                    got["buckets"].append(buckets.astype(np.int32).tolist())
                    got["counts"].append(counts.astype(np.int32).tolist())
                got["lang"] = part.column(1).to_pylist() * 2
                yield pa.RecordBatch.from_pydict(got, schema=pa.schema([("lang", pa.string()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))

    rows = chosen.select("text", "lang").mapInArrow(counted, "lang string, buckets array<int>, counts array<int>").toArrow()
    out = [(lang.as_py(), b.values.to_numpy(), c.values.to_numpy()) for lang, b, c in zip(rows["lang"], rows["buckets"], rows["counts"], strict=True) if len(b)]
    return sorted(out, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))


class Model:
    """Languages, weights of buckets, bias, temperature, and the least accepted score."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 1):
        self.languages = sorted({r[0] for r in rows})
        rng = np.random.default_rng(seed)
        rows = [rows[i] for i in rng.permutation(len(rows))]
        y = np.array([self.languages.index(r[0]) for r in rows], np.int64)
        train = np.arange(len(rows)) % 5 != 0
        if train.sum() < 2 * len(self.languages):
            train[:] = True
        e = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM))
        w = rng.normal(0, 0.1, (DIM, len(self.languages)))
        bias = np.zeros(len(self.languages))
        order = np.flatnonzero(train)
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for lot in np.array_split(rng.permutation(order), max(1, len(order) // BATCH)):
                index = np.concatenate([rows[i][1] for i in lot])
                at = np.concatenate([[0], np.cumsum([len(rows[i][1]) for i in lot])[:-1]])
                share = np.concatenate([rows[i][2] / rows[i][2].sum() for i in lot])
                hidden = np.add.reduceat(e[index] * share[:, None], at)
                p = softmax(hidden @ w + bias)
                p[np.arange(len(lot)), y[lot]] -= 1
                back = p @ w.T
                w -= rate * hidden.T @ p / len(lot) * 4
                bias -= rate * p.mean(axis=0) * 0.1
                step = np.repeat(back, [len(rows[i][1]) for i in lot], axis=0) * share[:, None]
                np.subtract.at(e, index, rate * 20 * step / len(lot) * 4)
        self.weights, self.bias, self.temperature = e @ w, bias, 1.0
        left = np.flatnonzero(~train) if (~train).any() else order
        logits = np.array([(self.weights[rows[i][1]] * (rows[i][2] / rows[i][2].sum())[:, None]).sum(axis=0) for i in left]) + bias
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(left)), y[left]] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
        self.temperature = float(min(loss, key=loss.get))
        score = softmax(logits / self.temperature)
        best, right = score.max(axis=1), score.argmax(axis=1) == y[left]
        falling = np.argsort(-best, kind="stable")
        good = np.flatnonzero(np.cumsum(right[falling]) / np.arange(1, len(left) + 1) >= ACCEPTED_RIGHT)
        self.least = float(best[falling][good[-1]]) if len(good) else 1.0

    def predict(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and the score of each text."""
        sums = np.zeros((len(rows) - 1, len(self.languages)))
        n = np.zeros(len(rows) - 1)
        for bucket, ok in subwords(data, rows):
            at = np.flatnonzero(ok)
            bounds = np.searchsorted(at, rows)
            n += np.diff(bounds)
            chosen = self.weights[bucket[at]]
            total = np.zeros((len(at) + 1, len(self.languages)))
            np.cumsum(chosen, axis=0, out=total[1:])
            sums += total[bounds[1:]] - total[bounds[:-1]]
        p = softmax((sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(docs: DataFrame) -> Model | None:
    rows = sample(docs)
    return Model(rows) if rows else None


def predictions(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and accepted of each text."""
    known = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.get()
        for batch in batches:
            for part, data, rows in slices(batch, 1):
                ok = has_letter(data, rows)
                if model is None:
                    ok[:] = False
                    best, score, least = np.zeros(len(ok), np.int64), np.zeros(len(ok)), 1.0
                else:
                    best, score = model.predict(data, rows)
                    least = model.least
                names = [model.languages[k] if good else "und" for k, good in zip(best.tolist(), ok.tolist(), strict=True)]
                score = np.where(ok, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(ok & (score >= least))], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def report(docs: DataFrame) -> DataFrame:
    rows = texts(docs)
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    got = predictions(rows, train(labelled))
    return got.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
