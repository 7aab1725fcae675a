"""Toxicity of texts that may be obfuscated: a noisy channel restores words, a lexicon learned from labels scores them.

Suspect spans are tokens with digits or symbols among letters (`1d10t`), tokens with
letters repeated (`stuuupid`), and letters set apart one by one (`m o r o n`, `l.o.s.e.r`).
Each is a lattice: a character may stand for itself, for the letters it resembles, for
one or two of a run of its kind, or, between single letters, for nothing. Viterbi decoding
picks the path that is likeliest under the channel's costs and a character 4-gram model
of the whole corpus (interpolated by Witten and Bell, 2**20 counts, summed within tasks).

Restored texts are scored by words: a lexicon of hashed words and word beginnings holds,
for each, a lower bound of the share of toxic documents among those that have it. A
document's evidence is the norm of its different words' (minus the log of the share
left), of so high an order that one strong word outweighs many weak ones; a logistic
curve over it, fitted to the labels, is the score. Labels are learned from at most SAMPLE rows of each
label, one of those whose words have the same minimum hash, so copies count once.

Nulls and edge cases: null and empty texts have no evidence and get the curve's lowest
score; a null doc_id is scored, not held out and not learned from; labels that are null
or neither 0 nor 1 are left out, and of several labels of one document the highest counts;
without labels of both kinds every score is the share of toxic labels (0 without any);
repeated rows are scored alike; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Shared, texts
from .langid import remainder
from .textarrays import LOWER, hashes, mix, row_of, salt, slices, spans

#: Labelled rows of each label that the lexicon is learned from, at most.
SAMPLE = 10_000
#: A word or beginning is looked at from so many toxic documents on; the lexicon has the CANDIDATES most frequent of them at most.
LEAST, CANDIDATES = 5, 1 << 17
#: Lengths in bytes of beginnings, and 0 for whole words.
BEGINNINGS = (3, 4, 5, 6, 0)
#: Standard deviations of the lower bound, and the least multiple of the toxic share that it must reach.
DEVIATIONS, LIFT = 4.0, 2.0
PREDICTED = 0.7
#: Order of the norm over a document's words.
ORDER = 2.5

#: Letters that digits and symbols stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou",
}
#: What may stand between letters that are set apart.
BETWEEN = b" ._-,~/"
#: Costs (negative natural logarithms) of what the channel does.
DIGIT_STAYS, SYMBOL_BREAKS, SYMBOL_GOES, LOOKS_LIKE = 3.0, 2.0, 2.5, 1.0
ONE_OF_RUN, TWO_OF_RUN, RUN_STAYS, ONE_OF_TWO = 0.7, 1.6, 3.0, 2.5
GAP_GOES, GAP_STAYS = 0.7, 0.7
#: Characters decoded at once, paths kept at each, and decoded spans that a task remembers.
SPAN, BEAM, REMEMBERED = 48, 32, 200_000

#: Kinds of characters for the model: 0 none of the others, 1-26 a-z, 27 digits, 28-31 other letters by first byte.
KINDS = 32
KIND = np.zeros(256, np.int32)
KIND[0x61:0x7B] = np.arange(1, 27)
KIND[0x30:0x3A] = 27
KIND[0xC0:] = 28 + np.arange(64) % 4

LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in LOOKS if not c.isdigit()]] = True
GAP = np.zeros(256, bool)
GAP[[*BETWEEN]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower-cased ASCII and Latin letters."""
    out = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[after] += 0x20
    return out


def spaced(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased rows, each with a line end after it, and their bounds."""
    low, n = lowered(data), len(rows) - 1
    bounds = rows + np.arange(n + 1)
    out = np.full(len(data) + n, 10, np.uint8)
    out[np.arange(len(data)) + row_of(rows)] = low
    return out, bounds


class Characters:
    """Log probabilities of a kind of character after three others."""

    def __init__(self, counts: np.ndarray):
        p = np.full((1, KINDS), 1 / KINDS)
        for order in range(1, 5):
            n = counts.reshape(-1, KINDS ** (order - 1), KINDS).sum(axis=0).astype(np.float64)
            shorter = np.tile(p, (n.shape[0] // p.shape[0], 1))
            kinds = (n > 0).sum(axis=1, keepdims=True)
            p = np.where(kinds > 0, (n + kinds * shorter) / np.maximum(n.sum(axis=1, keepdims=True) + kinds, 1), shorter)
        self.log = np.log(p).astype(np.float32).reshape(-1)


def character_counts(rows: DataFrame) -> np.ndarray:
    """How often each four kinds follow each other in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS**4, np.int64)
        for batch in batches:
            for _, data, bounds in slices(batch, 1):
                low, _ = spaced(data, bounds)
                kind = KIND[low[(low < 0x80) | (low >= 0xC0)]]
                again = np.zeros(len(kind), bool)
                again[1:] = (kind[1:] == 0) & (kind[:-1] == 0)
                kind = np.concatenate([np.zeros(3, np.int32), kind[~again]])
                total += np.bincount(((kind[:-3] * KINDS + kind[1:-2]) * KINDS + kind[2:-1]) * KINDS + kind[3:], minlength=KINDS**4)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    sums = rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(KINDS**4, np.int64)
    counts[sums["gram"].to_numpy()] = sums["n"].to_numpy()
    return counts


class Channel:
    """Decodes suspect spans under a character model."""

    def __init__(self, model: Characters):
        self.log, self.known = model.log.tolist(), {}

    def __call__(self, seen: str) -> str:
        got = self.known.get(seen)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[seen] = "".join(self.decoded(seen[i : i + SPAN]) for i in range(0, len(seen), SPAN))
        return got

    @staticmethod
    def lattice(seen: str) -> list[list[tuple[str, float]]]:
        """For each character or run of one: what it may stand for, at what cost."""
        out, i = [], 0
        apart = len(seen) > 4 and all(ord(c) < 128 and GAP[ord(c)] for c in seen[1::2])
        while i < len(seen):
            c, n = seen[i], 1
            while i + n < len(seen) and seen[i + n] == c:
                n += 1
            if apart and i % 2:
                out.append([("", GAP_GOES), (" ", GAP_STAYS)])
                n = 1
            elif c in LOOKS:
                alike = LOOKS[c]
                options = [(x, LOOKS_LIKE + math.log(len(alike))) for x in alike]
                options += [(c, DIGIT_STAYS)] if c.isdigit() else [(" ", SYMBOL_BREAKS), ("", SYMBOL_GOES)]
                if n > 1:
                    options = [(x * m, cost) for x, cost in options for m in ({1, n} if x.strip() else {1})]
                out.append(options)
            elif n == 1:
                out.append([(c, 0.0)])
            elif n == 2:
                out.append([(c + c, 0.0), (c, ONE_OF_TWO)])
            else:
                out.append([(c, ONE_OF_RUN), (c + c, TWO_OF_RUN), (c * n, RUN_STAYS)])
            i += n
        return out

    def decoded(self, seen: str) -> str:
        log, paths = self.log, {0: (0.0, "")}
        for options in [*self.lattice(seen), [(" ", 0.0)]]:
            following: dict[int, tuple[float, str]] = {}
            for state, (cost, said) in paths.items():
                for emitted, extra in options:
                    at, total = state, cost + extra
                    for c in emitted:
                        gram = at * KINDS + kind_of(c)
                        total -= log[gram]
                        at = gram % KINDS**3
                    best = following.get(at)
                    if best is None or total < best[0] or total == best[0] and said + emitted < best[1]:
                        following[at] = (total, said + emitted)
            if len(following) > BEAM:
                following = dict(sorted(following.items(), key=lambda x: x[1])[:BEAM])
            paths = following
        return min(paths.values())[1][:-1]


def kind_of(c: str) -> int:
    return int(KIND[ord(c)]) if c < "\x80" else int(KIND[c.encode("utf-8", "replace")[0]])


def suspects(low: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of suspect spans of lower-cased rows with line ends, in order and apart."""
    body = LETTER | DIGIT | SYMBOL
    starts, ends, _ = spans(low, bounds, body)
    if not len(starts):
        return starts, ends
    plain = LETTER[low] | DIGIT[low]
    at = np.arange(len(low))
    last = np.maximum.accumulate(np.where(plain, at, -1))[ends - 1] + 1
    first = np.minimum.accumulate(np.where(plain, at, len(low))[::-1])[::-1][starts]
    ok = last > starts
    # one symbol before the first letter may be part of the token, symbols after the last one aren't
    begin = np.where(ok & (first - starts == 1), first - 1, np.minimum(first, ends))
    end = np.where(ok, last, begin)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    letters, odd = total(LETTER[low]), total((DIGIT | SYMBOL)[low])
    same = np.zeros(len(low), bool)
    same[:-1] = (low[1:] == low[:-1]) & (low[:-1] >= 0x61) & (low[:-1] <= 0x7A)
    same[:-3] |= (low[:-3] >= 0xC0) & (low[:-3] == low[2:-1]) & (low[1:-2] == low[3:])
    doubles = total(same)
    inside = lambda sums: sums[end] - sums[begin]
    suspect = (inside(letters) > 0) & ((inside(odd) > 0) | (inside(doubles) > 1))

    heads = total((low < 0x80) | (low >= 0xC0))
    single = heads[ends] - heads[starts] == 1
    link = np.zeros(len(starts), bool)
    link[:-1] = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & GAP[low[np.minimum(ends[:-1], len(low) - 1)]]
    a, b, _ = spans(link.astype(np.uint8), np.array([0, len(link)]), np.array([False, True] + [False] * 254))
    long = b - a >= 2
    a, b = a[long], b[long]
    chained = np.zeros(len(starts) + 1, np.int64)
    np.add.at(chained, a, 1)
    np.add.at(chained, b + 1, -1)
    alone = suspect & (np.cumsum(chained)[:-1] == 0)
    s, e = np.concatenate([begin[alone], starts[a]]), np.concatenate([end[alone], ends[b]])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def restored(data: np.ndarray, rows: np.ndarray, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased rows (each with a line end) with suspect spans decoded, and their bounds."""
    low, bounds = spaced(data, rows)
    starts, ends = suspects(low, bounds)
    if not len(starts):
        return low, bounds
    whole, parts, at = low.tobytes(), [], 0
    grown = np.zeros(len(starts), np.int64)
    for k, (i, j) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        said = channel(whole[i:j].decode("utf-8", "replace")).encode()
        parts += [whole[at:i], said]
        grown[k], at = len(said) - (j - i), j
    parts.append(whole[at:])
    more = np.concatenate([[0], np.cumsum(grown)])
    return np.frombuffer(b"".join(parts), np.uint8), bounds + more[np.searchsorted(starts, bounds)]


def word_keys(low: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's beginnings and of the word itself (one row each; 0: the word is shorter), and the text of each word."""
    starts, ends, of = spans(low, bounds, LETTER)
    keys = np.zeros((len(BEGINNINGS), len(starts)), np.uint64)
    for k, n in enumerate(BEGINNINGS):
        to = np.minimum(starts + n, ends) if n else ends
        keys[k] = np.where(ends - starts >= n, hashes(low, starts, to) ^ salt(n), 0)
    return keys, row_of(of)


class Lexicon:
    """Keys of words and beginnings (ascending) with the lower bound of the toxic share, and the curve's slope and height."""

    def __init__(self, keys: np.ndarray, shares: np.ndarray, base: float):
        order = np.argsort(keys)
        self.keys, self.shares, self.slope, self.height = keys[order], shares[order], 0.0, logit(base)

    def evidence(self, low: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of each row: the norm of its different words' evidence."""
        out = np.zeros(len(bounds) - 1)
        if not len(self.keys):
            return out
        keys, row = word_keys(low, bounds)
        best = np.zeros(keys.shape[1])
        for own in keys:
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            best = np.maximum(best, np.where(self.keys[at] == own, self.shares[at], 0.0))
        some = np.flatnonzero(best)
        _, first = np.unique(mix(keys[-1][some] ^ mix(row[some].astype(np.uint64))), return_index=True)
        some = some[first]
        np.add.at(out, row[some], (-np.log1p(-best[some])) ** ORDER)
        return out ** (1 / ORDER)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The logistic curve over bent(evidence) by Newton's method, with a slope that isn't negative."""
        design, theta = np.stack([x, np.ones(len(x))], axis=1), np.array([0.0, self.height])
        ridge = np.diag([1.0, 1e-6])
        for _ in range(60):
            p = 1 / (1 + np.exp(-design @ theta))
            step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (weight * (p - y)) + ridge @ theta)
            theta = theta - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        if theta[0] > 0:
            self.slope, self.height = float(theta[0]), float(theta[1])

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * bent(evidence) + self.height, -30, 30)))


def bent(evidence: np.ndarray) -> np.ndarray:
    """Evidence on a scale from 0: what one word adds counts more than what many add."""
    return np.log1p(20 * np.minimum(evidence, 20))


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def chosen(labels: DataFrame, id_col: str, label_col: str) -> tuple[DataFrame, dict[int, float]]:
    """doc_id and toxic of the rows learned from, SAMPLE of each label at most, and how many labelled rows each of them stands for."""
    of = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    of = of.filter("doc_id is not null and toxic in (0, 1)").filter(remainder(3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in of.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = lambda y: of.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").limit(SAMPLE)
    return draw(0).unionAll(draw(1)), {y: max(1.0, k / SAMPLE) for y, k in n.items()}


def learned(rows: DataFrame, labels: DataFrame, model: Shared, id_col: str = "doc_id", label_col: str = "toxic") -> Lexicon:
    """The lexicon and its curve, from rows of doc_id and text, and labels."""
    sample, stands = chosen(labels, id_col, label_col)
    nothing = Lexicon(np.zeros(0, np.uint64), np.zeros(0), sum(stands.values()) and (1.0 if set(stands) == {1} else 0.0))
    if set(stands) != {0, 1}:
        return nothing

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(model.get())
        for batch in batches:
            for part, data, bounds in slices(batch, 1):
                low, at = restored(data, bounds, channel)
                keys, row = word_keys(low, at)
                sketch = np.zeros(part.num_rows, np.uint64)
                np.maximum.at(sketch, row, mix(keys[-1] * np.uint64(3) + np.roll(keys[-1], -1)))
                whole = low.tobytes()
                said = [whole[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(sketch.view(np.int64)), pa.array(said, pa.binary())], names=["toxic", "sketch", "said"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word or beginning with how many of a task's texts have it."""
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for said in batch.column(0):
                low = np.frombuffer(said.as_buffer(), np.uint8)
                keys = np.unique(word_keys(low, np.array([0, len(low)]))[0])
                held.append(keys[keys > 0])
                if sum(map(len, held[-256:])) > 1 << 21 or len(held) > 255:
                    yield counted()
        yield counted()

    with Scratch(rows.sparkSession, "toxicity") as keep:
        # at most 2 * SAMPLE ids are broadcast
        all_said = keep(rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").mapInArrow(restore, "toxic int, sketch long, said binary"))
        first = keep(all_said.groupBy("toxic", "sketch").agg(F.first("said").alias("said")))
        sums = lambda y: first.filter(F.col("toxic") == y).select("said").mapInArrow(words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        toxic = sums(1).filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "key").limit(CANDIDATES)
        both = toxic.join(sums(0).withColumnRenamed("n", "clean"), "key", "left").toArrow()
        sizes = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        keys, t, c = (both[k].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("key", "n", "clean"))
        n, odds = t + c, stands[1] / stands[0]
        share = t / np.maximum(n, 1)
        low = (share + DEVIATIONS**2 / (2 * n) - DEVIATIONS * np.sqrt(share * (1 - share) / n + DEVIATIONS**2 / (4 * n * n))) / (1 + DEVIATIONS**2 / n)
        low = np.clip(low, 0, 0.999)
        low = low * odds / (low * odds + 1 - low)
        weights = {y: sizes.get(y, 0) * stands[y] for y in (0, 1)}
        base = weights[1] / max(1.0, weights[0] + weights[1])
        good = low >= LIFT * base
        lexicon = Lexicon(keys[good].view(np.uint64), low[good], base)
        known = Shared(rows.sparkSession, lexicon)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = known.get()
            for batch in batches:
                said = [x.as_py() for x in batch.column(1)]
                x = lexicon.evidence(np.frombuffer(b"".join(said), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in said])]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.rint(bent(x) * 100).astype(np.int64))], names=["toxic", "x"])

        points = first.select("toxic", "said").mapInArrow(weigh, "toxic int, x long").groupBy("toxic", "x").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "x").collect()
    x, y, w = (np.array([r[k] for r in points], np.float64) for k in ("x", "toxic", "n"))
    lexicon.fit(x / 100, y, w * np.array([stands[int(k)] for k in y]))
    return lexicon


def scored(rows: DataFrame, model: Shared, lexicon: Lexicon) -> DataFrame:
    """doc_id, score and evidence of each row of doc_id and text."""
    known = Shared(rows.sparkSession, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, lexicon = Channel(model.get()), known.get()
        for batch in batches:
            for part, data, bounds in slices(batch, 1):
                x = lexicon.evidence(*restored(data, bounds, channel))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lexicon.scores(x)), pa.array(x)], names=["doc_id", "score", "evidence"])

    return rows.mapInArrow(run, "doc_id long, score double, evidence double")


def restored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and restored: each text in lower case, with what was obfuscated decoded under a model of these texts."""
    rows = texts(docs, id_col, text_col)
    model = Shared(docs.sparkSession, Characters(character_counts(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(model.get())
        for batch in batches:
            for part, data, bounds in slices(batch, 1):
                low, at = restored(data, bounds, channel)
                whole = low.tobytes()
                said = [whole[i : j - 1].decode("utf-8", "replace") for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string())], names=["doc_id", "restored"])

    return rows.mapInArrow(run, "doc_id long, restored string")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document whether it is held out from learning, its score, and whether the score says toxic."""
    rows = texts(docs)
    model = Shared(docs.sparkSession, Characters(character_counts(rows)))
    got = scored(rows, model, learned(rows, labels, model))
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"), "evidence")
