"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are
compared with references by Jensen-Shannon distance (base 2, 0 to 1). References are
made from the corpus itself: for every language with LANGUAGE_WORDS words, the sums
over all its documents that pass the base rules and can stand for the language (few
symbols for their words, few capitals among their characters). Common words of a language are all
that make up COMMON of its words; to find them, each task reports the words that make
up a tenth of that among its own, and a second pass counts exactly those that can
reach COMMON over all tasks (at most 1 / (0.9 * COMMON) a language).

A document is compared with the language nearest to it, whatever its own lang. Characters
beyond ASCII are of one class with small letters: how many a text has tells its language
and script, not its quality, so clean text without or with a wrong lang, of a script or language
that has no reference, isn't far from those there are. If a document's own lang has too few words for a reference, the base rules
decide alone, however much text of other languages there is. Texts too short for a histogram to mean anything aren't judged by it.

Nulls and edge cases: a null or empty text has no words and fails the base rules; a
null lang isn't a language and gives no reference; with no reference (an empty table,
or no document that passes) the base rules decide alone; repeated rows are judged
alike; a null doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, small_batches, with_result
from .textarrays import ALNUM, LOWER, NOT_SPACE, grams, hashes, lengths_in_characters, mix, per_row, row_of, slices, spans, starts_of_grams

MIN_WORDS = 20
REPEAT_WINDOW, REPEAT_PERCENT = 8, 30

#: Share of a language's words that makes a word common, and number of words that makes a lang value a language.
COMMON = 0.003
LANGUAGE_WORDS = 1000
#: A reference takes documents with at most so many symbols a word and such a share of capitals.
REFERENCE_SYMBOLS, REFERENCE_CAPITALS = 0.1, 0.3
#: A histogram counts from so many characters or words on.
MIN_CHARS, MIN_COUNTED = 150, 40
#: A document is rejected beyond the first distance of characters, or beyond the second of characters and that of words at once.
FAR_CHARS, ODD_CHARS, ODD_WORDS = 0.30, 0.17, 0.26

#: Class of each byte: 0 a-z and characters beyond ASCII, 1 A-Z, 2 other ASCII, 3 symbols, -1 none. Digits have none: numbers in clean text vary too much.
CLASSES = 4
CLASS = np.full(256, 2, np.int64)
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0x30:0x3A] = 0, 1, -1
CLASS[[*b"#*$%&|<>"]] = 3
CLASS[0xC0:] = 0
CLASS[0x80:0xC0] = -1
CLASS[~NOT_SPACE] = -1

RESULT = T.StructType([
    *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("char_distance", T.DoubleType()),
    T.StructField("word_distance", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
])

NEWLINE = np.ones(256, bool)
NEWLINE[0x0A] = False


def copies(key: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def base_counts(data: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row, and classes: characters by class."""
    starts, ends, bounds = spans(data, rows, NOT_SPACE)
    n = len(rows) - 1
    row = row_of(bounds)
    g, whole = grams(hashes(data, starts, ends), REPEAT_WINDOW), starts_of_grams(bounds, REPEAT_WINDOW)
    at = np.flatnonzero(whole)
    at = at[copies(mix(g[at] ^ mix(row[at].astype(np.uint64))))]
    hit = np.zeros(len(starts) + 1, np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + REPEAT_WINDOW, -1)
    repeated = per_row(np.cumsum(hit)[:-1] > 0, bounds)

    first, last, lines = spans(data, rows, NEWLINE)
    inked = np.zeros(len(data) + 1, np.int64)
    np.cumsum(NOT_SPACE[data], out=inked[1:])
    some = inked[last] > inked[first]
    line_row = row_of(lines)[some]
    key = mix(hashes(data, first[some], last[some]) ^ mix(line_row.astype(np.uint64)))
    _, kept = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[kept] = False

    kind = CLASS[data]
    classes = np.zeros((n, CLASSES), np.int64)
    for c in range(CLASSES):
        classes[:, c] = per_row(kind == c, rows)
    return {
        "n_words": np.diff(bounds),
        "word_chars": per_row(lengths_in_characters(data, starts, ends), bounds),
        "n_symbols": classes[:, 3],
        "n_dup_lines": np.bincount(line_row[again], minlength=n),
        "n_repeat_words": repeated,
        "classes": classes,
    }


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])


def exemplary(c: dict[str, np.ndarray]) -> np.ndarray:
    """Whether a document may be part of a reference."""
    return ~base_failed(c) & (c["n_symbols"] <= REFERENCE_SYMBOLS * c["n_words"]) & (c["classes"][:, 1] <= REFERENCE_CAPITALS * c["word_chars"])


def counted_words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (as signed numbers) of lower-cased alphanumeric words, and each row's bounds."""
    low = LOWER[data]
    starts, ends, bounds = spans(low, rows, ALNUM)
    return hashes(low, starts, ends).view(np.int64), bounds


def entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=-1)


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts from a reference histogram."""
    total = counts.sum(axis=1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference / max(reference.sum(), 1)
    return np.sqrt(np.maximum(0, entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2))


class References:
    """Histograms of languages: character classes, and common words with all others in the last place."""

    def __init__(self, classes: list[np.ndarray], words: np.ndarray, counts: list[np.ndarray], names: list[str]):
        self.classes, self.words, self.counts, self.names = classes, words, counts, set(names)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where each word stands in a histogram."""
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, len(self.words))

    def judge(self, data: np.ndarray, rows: np.ndarray, langs: list[str | None]) -> dict[str, np.ndarray]:
        c = base_counts(data, rows)
        failed, n = base_failed(c), len(rows) - 1
        h, bounds = counted_words(data, rows)
        width = len(self.words) + 1
        words = np.bincount(row_of(bounds) * width + self.places(h), minlength=n * width).reshape(n, width)
        if self.classes:
            by_class = np.stack([distance(c["classes"], r) for r in self.classes])
            by_word = np.stack([distance(words, r) for r in self.counts])
            nearest = np.argmin(by_class + by_word, axis=0), np.arange(n)
            char, word = by_class[nearest], by_word[nearest]
        else:
            char = word = np.zeros(n)
        far = (char > FAR_CHARS) | (char > ODD_CHARS) & (word > ODD_WORDS) & (np.diff(bounds) >= MIN_COUNTED)
        far &= c["classes"].sum(axis=1) >= MIN_CHARS
        far &= np.array([k is None or k in self.names for k in langs], bool)
        return c | {"base_failed": failed, "char_distance": char, "word_distance": word, "kept": ~failed & ~far}


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """Reference histograms over all documents that pass the base rules. The driver gets a bounded number of rows a language."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("lang is not null and text is not null")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
        """Of each part: characters by class, lang values, words' hashes and each word's number in the lang values."""
        for batch in batches:
            for part, data, bounds in slices(batch, "text"):
                c = base_counts(data, bounds)
                passed = exemplary(c)
                names, number = np.unique(np.array(part.column(1).to_pylist(), dtype=object), return_inverse=True)
                h, words = counted_words(data, bounds)
                of = row_of(words)
                ok = passed[of]
                sums = np.zeros((len(names), CLASSES), np.int64)
                np.add.at(sums, number[passed], c["classes"][passed])
                yield sums, names.tolist(), h[ok], number[of[ok]]

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for sums, names, h, number in each(batches):
            for i, name in enumerate(names):
                own = held.setdefault(name, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(CLASSES, np.int64)])
                words, counts = np.unique(np.concatenate([own[0], h[number == i]]), return_counts=True)
                counts = counts.astype(np.int64)
                counts[np.searchsorted(words, own[0])] += own[1] - 1
                own[:] = [words, counts, own[2] + sums[i]]
        for name, (words, counts, classes) in held.items():
            keep = counts >= COMMON / 10 * counts.sum()
            yield pa.RecordBatch.from_pydict({"lang": [name], "total": [int(counts.sum())], "classes": [classes.tolist()], "words": [words[keep].tolist()], "counts": [counts[keep].tolist()]}, schema=pa.schema([("lang", pa.string()), ("total", pa.int64()), ("classes", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]))

    reports = rows.mapInArrow(often, "lang string, total long, classes array<long>, words array<long>, counts array<long>").persist()
    try:
        sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(CLASSES)]
        spark = docs.sparkSession
        totals = reports.groupBy("lang").agg(F.sum("total").alias("total"), *sums)
        languages = {r["lang"]: r for r in totals.filter(F.col("total") >= LANGUAGE_WORDS).collect()}
        if not languages:
            return References([], np.zeros(0, np.int64), [], [])
        bound = spark.createDataFrame([(k, r["total"]) for k, r in languages.items()], "lang string, all long")
        reported = reports.select("lang", "total", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"), F.sum("total").alias("seen"))
        possible = reported.join(F.broadcast(bound), "lang").filter(F.col("n") + COMMON / 10 * (F.col("all") - F.col("seen")) >= COMMON * F.col("all"))
        candidates = np.unique(np.array([r[0] for r in possible.select("word").distinct().collect()], np.int64))
    finally:
        reports.unpersist()
    names = sorted(languages)
    known = Shared(spark, (names, candidates))

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, candidates = known.get()
        of_name = {k: i for i, k in enumerate(names)}
        counts = np.zeros((len(names), len(candidates)), np.int64)
        for _, part_names, h, number in each(batches):
            to = np.array([of_name.get(k, -1) for k in part_names], np.int64)[number]
            at = np.minimum(np.searchsorted(candidates, h), len(candidates) - 1) if len(candidates) else np.zeros(0, np.int64)
            ok = (candidates[at] == h) & (to >= 0) if len(candidates) else np.zeros(0, bool)
            counts += np.bincount(to[ok] * len(candidates) + at[ok], minlength=counts.size).reshape(counts.shape)
        where = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(where[0].astype(np.int64)), pa.array(candidates[where[1]]), pa.array(counts[where])], names=["language", "word", "n"])

    exact = rows.mapInArrow(exactly, "language long, word long, n long").groupBy("language", "word").agg(F.sum("n").alias("n")).collect()
    total = np.array([languages[k]["total"] for k in names])
    common = np.unique(np.array([r["word"] for r in exact if r["n"] >= COMMON * total[r["language"]]], np.int64))
    counts = np.zeros((len(names), len(common) + 1), np.int64)
    for r in exact:
        at = int(np.searchsorted(common, r["word"]))
        if at < len(common) and common[at] == r["word"]:
            counts[r["language"], at] = r["n"]
    counts[:, -1] = total - counts.sum(axis=1)
    return References([np.array([languages[k][f"c{i}"] for i in range(CLASSES)]) for k in names], common, list(counts), names)


def annotate(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, str]:
    """`docs` with one more struct column, and its name: the base counts, both distances from the nearest language, and whether the document is kept."""
    known = Shared(docs.sparkSession, references(docs, text_col, lang_col))

    def judge(batch: pa.RecordBatch, column: str, held=[]) -> Iterator[tuple[pa.RecordBatch, pa.StructArray]]:  # noqa: B006  each task has its own copy
        if not held:
            held.append(known.get())
        for part, data, rows in slices(batch, column):
            langs = part.column([k.lower() for k in part.schema.names].index(lang_col.lower())).cast(pa.string()).to_pylist()
            got = held[0].judge(data, rows, langs)
            yield part, pa.StructArray.from_arrays([pa.array(got[f.name]) for f in RESULT.fields], names=RESULT.names)

    return with_result(docs, text_col, "quality", RESULT, judge)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    got, result = annotate(docs)
    return got.filter(F.col(f"`{result}`.kept")).select(*[f"`{c}`" for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    got, result = annotate(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang"))
    return got.select("doc_id", *[F.col(f"{result}.{f}").alias(f) for f in RESULT.names])
