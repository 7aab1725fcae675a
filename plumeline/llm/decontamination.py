"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes of the test texts the minimum is kept;
documents are winnowed the same way, so a document and an item that share 13 words
share a kept k-gram at the same place of the shared span: with k = 5 a selection
window of 9 hashes covers exactly 13 words. Kept fingerprints of documents are looked
up among those of the test items, and each hit is extended to the 13-word windows
around it, which are compared whole, by their bytes, with the items' windows. Items
of fewer than 13 words are one window each; for each such length all document
windows of that length are looked up (a selection window of one hash).

The test set is the stated query set: it is read to the driver in blocks of bounded
text size, each of which goes to the executors as a broadcast. If there is one block,
documents pass through it. If there are more, the fingerprints of all blocks go out first
(eight bytes for some thirty of text; in parts of PRINTS), documents pass through these
once, and only texts that share one, each text once, are written and pass through the
blocks. What is found comes back to documents by the text's digest. Texts of documents
are never shuffled, but for those.

Nulls and edge cases: a null or empty document has no words and no hit; a null or
empty item has no window; rows of one item_id are windows of one item; an item
without id counts for hit words but isn't named among the items; repeated documents
are judged alike; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, cut, fresh, texts, with_result
from .textarrays import ALNUM, LOWER, grams, hashes, per_row, row_of, slices, spans, starts_of_grams

WINDOW = 13
GRAM = 5
#: Bytes of test texts in one broadcast.
BLOCK_BYTES = 1 << 20
#: Blocks that one stage of suspect texts passes through before its result is written.
BLOCKS_PER_STAGE = 4
#: Fingerprints in one broadcast.
PRINTS = 1 << 23

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def winnowed(g: np.ndarray, whole: np.ndarray, reach: int) -> np.ndarray:
    """Whether each hash is the minimum of a selection window of `reach` hashes of one row (its last one on ties)."""
    n = len(g) - reach + 1
    keep = np.zeros(len(g), bool)
    if n <= 0:
        return keep
    least, where = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, reach):
        low = g[j : j + n] <= least
        least[low] = g[j : j + n][low]
        where[low] = j
    keep[(np.arange(n) + where)[whole[:n]]] = True
    return keep


class Words:
    """The words of some texts, their hashes and their bytes."""

    def __init__(self, data: np.ndarray, rows: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, self.bounds = spans(self.data, rows, ALNUM)
        self.h = hashes(self.data, self.starts, self.ends)
        self.row = row_of(self.bounds)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k words in a row, and their first words; a hash that starts too near a row's end is left out."""
        g, whole = grams(self.h, k), starts_of_grams(self.bounds, k)
        at = np.flatnonzero(whole)
        return g[at], at

    def text(self, first: int, k: int) -> bytes:
        raw = self.data.tobytes() if not hasattr(self, "raw") else self.raw
        self.raw = raw
        return b" ".join(raw[s:e] for s, e in zip(self.starts[first : first + k].tolist(), self.ends[first : first + k].tolist(), strict=True))


class Index:
    """Windows of a block of test items, and the fingerprints that find them."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        column = pa.array([text for _, text in items], pa.string())
        self.by_length: dict[int, tuple[np.ndarray, list[dict[bytes, set]]]] = {}
        found: dict[int, dict[int, dict[bytes, set]]] = {}
        prints: list[np.ndarray] = []
        done = 0
        for part, data, rows in slices(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            w = Words(data, rows)
            count = np.diff(w.bounds)
            for k in np.unique(np.minimum(count[count > 0], window)).tolist():
                g, at = w.windows(k)
                own = (count[w.row[at]] >= window) if k == window else (count[w.row[at]] == k)
                into = found.setdefault(k, {})
                for h, first in zip(g[own].tolist(), at[own].tolist(), strict=True):
                    into.setdefault(h, {}).setdefault(w.text(first, k), set()).add(items[done + int(w.row[first])][0])
            g, whole = grams(w.h, gram), starts_of_grams(w.bounds, window)
            prints.append(g[winnowed(g, whole, window - gram + 1)])
            done += part.num_rows
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        for k, windows in found.items():
            keys = np.array(sorted(windows), np.uint64)
            self.by_length[k] = keys, [windows[int(h)] for h in keys]

    def hits(self, w: Words) -> Iterator[tuple[int, int, set]]:
        """First word, length and items of each window of w that is an item's."""
        for k, (keys, windows) in self.by_length.items():
            if k == self.window:
                g, whole = grams(w.h, self.gram), starts_of_grams(w.bounds, k)
                kept = np.flatnonzero(winnowed(g, whole, k - self.gram + 1))
                kept = kept[among(g[kept], self.prints)]
                near = np.zeros(len(whole), bool)
                for back in range(k - self.gram + 1):
                    at = kept - back
                    near[at[(at >= 0) & (at < len(whole))]] = True
                at = np.flatnonzero(near & whole)
                g = grams(w.h, k)[at] if len(at) else np.zeros(0, np.uint64)
            else:
                g, at = w.windows(k)
            same = among(g, keys)
            for h, first in zip(np.searchsorted(keys, g[same]).tolist(), at[same].tolist(), strict=True):
                if (items := windows[h].get(w.text(first, k))) is not None:
                    yield first, k, items


class Sieve:
    """Fingerprints of many test items: which texts can have one of their windows."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.prints: list[np.ndarray] = []
        self.short: dict[int, list[np.ndarray]] = {}
        self.size = 0

    def add(self, items: list[tuple[str | None, str]]) -> None:
        column = pa.array([text for _, text in items], pa.string())
        for _, data, rows in slices(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            w = Words(data, rows)
            count = np.diff(w.bounds)
            for k in np.unique(count[(count > 0) & (count < self.window)]).tolist():
                g, at = w.windows(k)
                self.short.setdefault(k, []).append(g[count[w.row[at]] == k])
                self.size += len(self.short[k][-1])
            g, whole = grams(w.h, self.gram), starts_of_grams(w.bounds, self.window)
            self.prints.append(g[winnowed(g, whole, self.window - self.gram + 1)])
            self.size += len(self.prints[-1])

    def closed(self) -> Sieve:
        self.prints = [np.unique(np.concatenate(self.prints))]
        self.short = {k: [np.unique(np.concatenate(v))] for k, v in self.short.items()}
        return self

    def suspect(self, w: Words) -> np.ndarray:
        """Whether each text of w has a fingerprint."""
        out = np.zeros(len(w.bounds) - 1, bool)
        g, whole = grams(w.h, self.gram), starts_of_grams(w.bounds, self.window)
        kept = np.flatnonzero(winnowed(g, whole, self.window - self.gram + 1))
        out[w.row[kept[among(g[kept], self.prints[0])]]] = True
        for k, (keys,) in self.short.items():
            g, at = w.windows(k)
            out[w.row[at[among(g, keys)]]] = True
        return out


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def runs(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"first": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The test items, so many at once; the driver holds a block at a time."""
    some, rows, size = False, [], 0
    for row in benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).toLocalIterator():
        if row[1]:
            rows.append((row[0], row[1]))
            size += len(row[1])
        if size >= block_bytes:
            yield rows
            some, rows, size = True, [], 0
    if rows or not some:
        yield rows


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """`docs` with one more struct column, and its name: n_words, hits (runs of hit words) and items (ids of the items hit)."""
    first, *more = itertools.islice(blocks(benchmark, item_col, item_text_col, block_bytes), 2)
    if not more:
        return judged(docs, [first], text_col)
    name = fresh("contamination", docs.columns)
    digest = fresh("digest", [*docs.columns, name])
    found = suspects(docs, lambda: blocks(benchmark, item_col, item_text_col, block_bytes), text_col)
    found = found.select(F.col("digest").alias(digest), F.col("result.hits").alias("hits_"), F.col("result.items").alias("items_"))
    counted, n_words = with_result(docs, text_col, name, T.StructType([T.StructField("n_words", T.LongType())]), count_words)
    rows = counted.withColumn(digest, digest_of(text_col)).join(found.withColumnsRenamed({"hits_": f"{digest}hits", "items_": f"{digest}items"}), digest, "left")
    made = F.struct(F.col(f"`{n_words}`.n_words").alias("n_words"), *[F.coalesce(f"{digest}{c}", F.array().cast(RESULT[c].dataType)).alias(c) for c in ("hits", "items")])
    return rows.select(*[f"`{c}`" for c in docs.columns], made.alias(name)), name


def digest_of(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))


def count_words(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, pa.StructArray]]:
    for part, data, rows in slices(batch, column):
        yield part, pa.StructArray.from_arrays([pa.array(np.diff(spans(LOWER[data], rows, ALNUM)[2]))], names=["n_words"])


def suspects(docs: DataFrame, parts: Callable[[], Iterator[list]], text_col: str) -> DataFrame:
    """digest and result of each different text that has a window of the test items; `parts` gives their blocks."""
    contents = docs.select(digest_of(text_col).alias("digest"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    passed = None
    sieve = Sieve()

    def through(sieve: Sieve) -> DataFrame:
        known = Shared(docs.sparkSession, sieve.closed())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sieve = known.get()
            for batch in batches:
                for part, data, rows in slices(batch, 1):
                    yield part.filter(pa.array(sieve.suspect(Words(data, rows))))

        return contents.mapInArrow(run, "digest binary, text string")

    for block in parts():
        sieve.add(block)
        if sieve.size >= PRINTS:
            passed = through(sieve) if passed is None else passed.unionByName(through(sieve))
            sieve = Sieve()
    if sieve.size or passed is None:
        sieve.prints = sieve.prints or [np.zeros(0, np.uint64)]
        passed = through(sieve) if passed is None else passed.unionByName(through(sieve))
    out, name = judged(cut(passed.dropDuplicates(["digest"])), parts(), "text")
    return cut(out.select("digest", F.col(f"`{name}`").alias("result")).filter(F.size("result.hits") > 0))


def judged(docs: DataFrame, parts: Iterable[list], text_col: str) -> tuple[DataFrame, str]:
    """`docs` with the result column, after they have passed through all blocks of test items."""
    out, name, done = docs, "", 0
    for block in parts:
        before = name
        known = Shared(docs.sparkSession, Index(block))

        def judge(batch: pa.RecordBatch, column: str, known=known, before=before, held=[]) -> Iterator[tuple[pa.RecordBatch, pa.StructArray]]:  # noqa: B006  each task has its own copy
            if not held:
                held.append(known.get())
            index = held[0]
            for part, data, rows in slices(batch, column):
                w = Words(data, rows)
                hit, items = np.zeros(len(w.h) + 1, np.int64), {}
                for first, k, ids in index.hits(w):
                    hit[first] += 1
                    hit[first + k] -= 1
                    items.setdefault(int(w.row[first]), set()).update(ids)
                hit = np.cumsum(hit)[:-1] > 0
                counts = per_row(hit, w.bounds)
                earlier = part.column(part.schema.get_field_index(before)).to_pylist() if before else [None] * part.num_rows
                got = []
                for i, old in enumerate(earlier):
                    own = hit[w.bounds[i] : w.bounds[i + 1]] if counts[i] or old and old["hits"] else None
                    if old and old["hits"]:
                        own = own.copy()
                        for run in old["hits"]:
                            own[run["first"] : run["end"]] = True
                    ids = (items.get(i, set()) - {None}) | set(old["items"] if old else ())
                    got.append({"n_words": int(w.bounds[i + 1] - w.bounds[i]), "hits": runs(own) if own is not None else [], "items": sorted(ids)})
                yield part, pa.array(got, pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]))

        out, name = with_result(out, text_col, "contamination", RESULT, judge)
        if before:
            out = out.drop(before)
        done += 1
        if done % BLOCKS_PER_STAGE == 0:
            out = cut(out)
    return out, name


def verdict(result: str) -> dict[str, Column]:
    """The columns that say what the struct column `result` means."""
    n_hit = F.aggregate(F.col(f"`{result}`.hits"), F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    n_words = F.col(f"`{result}`.n_words")
    items = F.col(f"`{result}`.items")
    return {
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort(items), ","), 256),
        "contaminated": (n_hit > 0) & (n_hit * 20 >= n_words),
    }


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    got, result = annotate(docs, benchmark, text_col)
    return got.filter(~verdict(result)["contaminated"]).select(*[f"`{c}`" for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    got, result = annotate(texts(docs), benchmark)
    return got.select("doc_id", *[c.alias(n) for n, c in verdict(result).items()])


#: The exact result, by looking up every window: for small tables.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) t
), places AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM windows) q WHERE len(w) >= k) t
), hits AS (
  SELECT p.doc_id, p.i, p.k, x.item_id FROM places p JOIN windows x ON x.g = p.g AND x.k = p.k
), hit_words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) t GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) t GROUP BY 1
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN items m ON m.doc_id = d.doc_id
"""
