"""N-gram language model in Elias-Fano tries.

Words are counted over all training documents: each task counts its own and sends them
packed, by ranges of their hashes, to the tasks that add them up.

The model has two parts. Its lower orders are one trie that every task has: words with a
share of CLASS_SHARE of all tokens are its vocabulary, the rest is one class within which
a word has its smoothed share (words below KNOWN_SHARE have equal ones); bigrams with a
share of GRAM_SHARE have absolutely discounted probabilities, others back off. Being
shares, these bound the trie whatever the corpus: 1 / CLASS_SHARE words, 1 / GRAM_SHARE
bigrams, 1 / KNOWN_SHARE counts.

Its upper part grows with the corpus: all trigrams of all words that occur LEAST times,
in one trie for each range of the hashes of contexts' last words. Every token goes to its
range once, with its lower-order probability as a code; there trigrams of training
documents are counted and the range's trie is made. A context's probabilities are counts
over its total and MU more; MU and what is left out are the weight of the lower orders.
Words with a share of HOT_SHARE of all tokens would make a range too large: the contexts
that end with them are dealt out by both words. Contexts with such a share are dealt out
by all three; their totals go to all tasks (1 / HOT_SHARE at most). So no task ever holds
more than a range.

The trie of a range has three levels: last words of contexts; below each, the words that
follow it and the contexts that end with it; below each context, its third words, whose
ids are their places among those that follow its last word. A node's children are a range
between two pointers; pointers and child ids are monotone sequences in Elias-Fano form,
with probabilities and back-offs as 8-bit codes of even logarithmic steps, and lookups
search a range for the successor of an id. The lower orders' trie has the same levels,
with places among its vocabulary for ids.

fit() writes a model to a folder: a row for each range, whose trie is one piece of bytes
that is searched where Arrow has it, without being parsed or copied; score() applies it
to any table. report() does both in one pass: a range answers from its trie when it has
made it, as a second shuffle of all tokens would double what is written.

Counts of words too rare for a broadcast are looked up where they were added up, on the
same way as the trigrams.

Nulls and edge cases: a null or empty text is an end alone; rows without doc_id are
scored and neither held out nor learned from; repeated rows are counted and scored
each; without training documents probabilities are those of smoothing alone; an empty
table gives no rows; texts are read whole. Ids are whole numbers. Last words and contexts
are known by 32 and 31 bits of their hash within a range, third words by 24 after a last word.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, cut, in_order, shards_for, texts
from .textarrays import LOWER, NOT_SPACE, hashes, mix, row_of, salt, slices, spans

ALPHA = 0.1
DISCOUNT = 0.75
#: Shares of all tokens from which on a word is of the lower orders' vocabulary, a word's count goes to every task, a bigram is kept, a context is hot.
CLASS_SHARE, KNOWN_SHARE, GRAM_SHARE, HOT_SHARE = 2e-5, 1e-6, 1e-6, 1e-4
#: Trigrams are kept from so many occurrences on (all of hot contexts are); what is added to a context's total for the lower orders.
LEAST, MU = 2, 2.0
#: Steps of the codes of lower-order logarithms.
LOW_STEP = 0.05

#: The end's place among word hashes, and ids of the model's own symbols.
END_KEY = salt(1 << 40)
#: What stands before the first word.
START_KEY = salt(1 << 41)
START, END, RARE, FIRST = 0, 1, 2, 3
#: Tokens (and documents) that are sent at once; equal bigrams in a part of so many bytes are looked up once. Bytes of text for each range.
BLOCK_TOKENS, BLOCK_ROWS, SCORED_BYTES = 3 << 17, 1 << 15, 1 << 19
RANGE_BYTES = 3 << 19
#: Bytes of a sent token: three of its word, a code, two of its row with a bit for learning. Of a context: its hash, and how many tokens it has; of a last word: the same of its contexts.
TOKEN_BYTES, NODE_BYTES = 6, 8
#: What stands before a hot context's number, and the bits of the others' hashes.
HOT_BIT = 1 << 31
#: Counts that a task holds before equal ones are added up.
PENDING = 1 << 20

PACKED = "shard int, keys binary, counts binary"


class Sums:
    """Counts by key, added up now and then."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int64))
        self.size += len(keys)
        if self.size > PENDING:
            keys, counts = self.total()
            self.keys, self.counts, self.size = [keys], [counts], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of evenly spread 64-bit keys."""
    return ((keys >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int32)


def packed(sums: Sums, shards: int) -> pa.RecordBatch:
    """A row for each shard that has keys, these as gaps, both in planes of bytes and compressed."""
    keys, counts = sums.total()
    bounds = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    some = np.flatnonzero(np.diff(bounds))
    pack = zstandard.ZstdCompressor(level=1).compress
    part = lambda a, n: [pack(planes(a[bounds[s] : bounds[s + 1]], n).tobytes()) for s in some]
    gaps = np.diff(keys, prepend=keys[:1])
    gaps[bounds[some]] = keys[bounds[some]]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(part(gaps, 8), pa.binary()), pa.array(part(counts, 8), pa.binary())], names=["shard", "keys", "counts"])


def unsent(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of a row of packed()."""
    unpack = zstandard.ZstdDecompressor().decompress
    gaps, n = (numbers(np.frombuffer(unpack(x), np.uint8).reshape(8, -1)) for x in (keys, counts))
    return np.cumsum(gaps, dtype=np.uint64), n


def unpacked(keys: list[bytes], counts: list[bytes]) -> Sums:
    sums = Sums()
    for k, c in zip(keys, counts, strict=True):
        sums.add(np.frombuffer(k, "<u8"), np.frombuffer(c, "<u4" if 2 * len(c) == len(k) else "<u8"))
    return sums


def add_up(rows: DataFrame) -> DataFrame:
    """One row for each shard."""

    def merged(table: pa.Table) -> pa.Table:
        sums = Sums()
        for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True):
            sums.add(*unsent(k, c))
        keys, counts = sums.total()
        return pa.table({"shard": table["shard"][:1].combine_chunks(), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.astype("<u8").tobytes()], pa.binary())})

    return rows.groupBy("shard").applyInArrow(merged, PACKED)


def word_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, bounds = spans(low, rows, NOT_SPACE)
    return hashes(low, starts, ends), bounds


def word_counts(docs: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for part, data, rows in slices(batch, "text"):
                sums.add(word_hashes(data, rows)[0])
                sums.add(np.array([END_KEY]), np.array([part.num_rows]))
        yield packed(sums, shards)

    return add_up(docs.mapInArrow(run, PACKED))


class Vocabulary:
    """Totals, and the words whose counts every task knows, by hash; ids of those that are of the model's vocabulary, RARE for others."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens: int, words: int):
        order = np.argsort(keys)
        self.keys, self.counts, self.tokens, self.words = keys[order], counts[order], tokens, words
        chosen = np.flatnonzero((self.counts >= CLASS_SHARE * tokens) & (self.keys != END_KEY) & (self.counts > 0))
        chosen = chosen[np.lexsort((self.keys[chosen], -self.counts[chosen]))]
        self.ids = np.full(len(self.keys), RARE, np.int64)
        self.ids[chosen] = FIRST + np.arange(len(chosen))
        self.ids[self.keys == END_KEY] = END
        ends = int(self.counts[self.keys == END_KEY].sum())
        self.unigrams = np.array([ends, ends, tokens - ends - int(self.counts[chosen].sum()), *self.counts[chosen]], np.int64)
        self.of_id = np.array([START_KEY, END_KEY, 0, *self.keys[chosen]], np.uint64)
        self.rare_words = words - len(chosen) - (ends > 0)
        self.unknown_words = words - len(self.keys)
        self.unknown_tokens = tokens - int(self.counts.sum())
        self.ends = ends
        self.hot = self.counts >= max(1, HOT_SHARE * tokens)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h

    def sequence(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each row's words between START and END, and each row's bounds."""
        at, known = self.places(h)
        wide = bounds + 2 * np.arange(len(bounds))
        out = np.full(wide[-1], RARE, np.int64)
        out[wide[:-1]], out[wide[1:] - 1] = START, END
        out[np.arange(len(h)) + 1 + 2 * row_of(bounds)] = np.where(known, self.ids[at], RARE) if len(self.keys) else RARE
        return out, wide

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.tokens + ALPHA * (self.words + 1)))

    def within_rare(self, counts: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The shares of words in the rare class; those whose counts aren't known share what is left alike."""
        unknown = (self.unknown_tokens + ALPHA * (self.unknown_words + 1)) / (self.unknown_words + 1)
        return np.log10(np.where(known, counts + ALPHA, unknown) / (self.unigrams[RARE] + ALPHA * (self.rare_words + 1)))


def gram_key(order: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (np.uint64(order) << np.uint64(60)) | (a.astype(np.uint64) << np.uint64(40)) | (b.astype(np.uint64) << np.uint64(20)) | c.astype(np.uint64)


def grams_of(seq: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Keys of the bigrams."""
    row = row_of(wide)
    two = np.flatnonzero(row[1:] == row[:-1])
    return gram_key(2, np.zeros(len(two)), seq[two], seq[two + 1])


def gram_counts(docs: DataFrame, vocabulary: Shared, shards: int, least: float) -> DataFrame:
    """Keys and counts of the n-grams that occur often enough over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = vocabulary.get(), Sums()
        for batch in batches:
            for _, data, rows in slices(batch, "text"):
                sums.add(mix(grams_of(*words.sequence(*word_hashes(data, rows)))))
        yield packed(sums, shards)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = unpacked(batch.column(1).to_pylist(), batch.column(2).to_pylist()).total()
            kept = counts >= least
            yield pa.RecordBatch.from_arrays([pa.array(unmix(keys[kept]).view(np.int64)), pa.array(counts[kept])], names=["gram", "n"])

    return add_up(docs.mapInArrow(run, PACKED)).mapInArrow(often, "gram long, n long")


def unmix(x: np.ndarray) -> np.ndarray:
    """What mix() was given."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


#: The place of the r-th set bit of a byte.
NTH_BIT = np.array([([k for k in range(8) if i >> k & 1] + [0] * 8)[:8] for i in range(256)], np.uint8)
#: A byte of 0x01, 0x80, 0x55, 0x33 or 0x0F in each place of a word.
ONES, TOPS, PAIRS, QUADS, NIBBLES = (np.uint64(int.from_bytes(bytes([x]) * 8)) for x in (0x01, 0x80, 0x55, 0x33, 0x0F))
U = [np.uint64(k) for k in range(57)]


def nth_bit(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the set bit of each rank in each word: byte by prefix sums of bits within the word, then by table."""
    sums = words - ((words >> U[1]) & PAIRS)
    sums = (sums & QUADS) + ((sums >> U[2]) & QUADS)
    sums = ((sums + (sums >> U[4])) & NIBBLES) * ONES
    passed = ((rank * ONES | TOPS) - sums) & TOPS
    shift = (((passed >> U[7]) * ONES) >> U[56]) * U[8]
    before = ((sums << U[8]) >> shift) & np.uint64(255)
    byte = (words >> shift) & np.uint64(255)
    return shift.astype(np.int64) + NTH_BIT[byte.astype(np.int64), (rank - before).astype(np.int64)]


class EliasFano:
    """A monotone sequence: low bits packed side by side, high bits in unary with counts of ones for each 64."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        place = np.arange(self.n, dtype=np.uint64) * np.uint64(self.low_bits)
        bits = np.zeros(((self.n * self.low_bits + 63) // 64 + 1) * 64, np.uint8)
        for k in range(self.low_bits):
            bits[(place + np.uint64(k)).astype(np.int64)] = (values >> np.uint64(k)) & np.uint64(1)
        self.low = np.packbits(bits, bitorder="little").view(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(self.n)
        bits = np.zeros(((int(high[-1]) if self.n else 0) // 64 + 1) * 64, np.uint8)
        bits[high] = 1
        self.high = np.packbits(bits, bitorder="little").view(np.uint64)
        self.ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1))]).astype(np.uint32)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        high = word * 64 + nth_bit(self.high[word], (i - self.ones[word]).astype(np.uint64)) - i
        if not self.low_bits:
            return high
        place = i * self.low_bits
        at, shift = place >> 6, (place & 63).astype(np.uint64)
        low = (self.low[at] >> shift) | np.where(shift > 0, self.low[at + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (high << self.low_bits) | (low & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)


class Codes:
    """Logarithms as 8-bit codes of a codebook of even steps between the least and the greatest."""

    def __init__(self, values: np.ndarray):
        least, most = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        self.book = np.linspace(least, most, 256)
        self.codes = np.rint((values - least) / ((most - least) or 1) * 255).astype(np.uint8)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.book[self.codes[i]]


class Level:
    """Nodes in ranges by parent: ids that count on from range to range, and where there are such, probabilities, and back-offs and pointers to a level below."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, logp: np.ndarray | None = None, backoff: np.ndarray | None = None, children: np.ndarray | None = None):
        sizes = np.diff(first)
        last = np.zeros(len(sizes), np.int64)
        last[sizes > 0] = ids[first[1:][sizes > 0] - 1]
        before = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(sizes) else last
        self.ids = EliasFano(ids + np.repeat(before, sizes))
        self.logp = Codes(logp) if logp is not None else None
        self.backoff = Codes(backoff) if backoff is not None else None
        self.pointers = EliasFano(children) if children is not None else None

    def find(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first node of each range [low, high) with an id of at least the wanted one, and whether it is that one."""
        if not self.ids.n:
            return low, np.zeros(len(low), bool)
        goal = wanted + np.where(low > 0, self.ids[np.maximum(low - 1, 0)], 0)
        a, b = low.copy(), high.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) >> 1
            less = self.ids[mid] < goal[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        inside = a < high
        found = np.zeros(len(low), bool)
        found[inside] = self.ids[a[inside]] == goal[inside]
        return a, found


class Trie:
    """Levels of unigrams (ids are places), bigrams and trigrams."""

    def __init__(self, unigrams: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        n = len(unigrams)
        mask = (1 << 20) - 1
        a, b, c = (grams >> 40) & mask, (grams >> 20) & mask, grams & mask
        predicted = unigrams.astype(float)
        predicted[START] = 0
        p1 = (predicted + ALPHA) / (predicted.sum() + ALPHA * n)
        two = np.flatnonzero(grams >> 60 == 2)
        two = two[np.lexsort((c[two], b[two]))]
        u, v = b[two], c[two]
        first2 = np.searchsorted(u, np.arange(n + 1))
        p2 = np.maximum(counts[two] - DISCOUNT, 1e-3) / np.maximum(unigrams[u], 1)
        left = lambda p, lower, of, m: np.log10(np.maximum(1 - np.bincount(of, p, m), 1e-6) / np.maximum(1 - np.bincount(of, lower, m), 1e-6))
        back1 = left(p2, p1[v], u, n)
        pair = u * n + v  # ordered
        three = np.flatnonzero(grams >> 60 == 3)
        parent = np.searchsorted(pair, a[three] * n + b[three])
        suffix = np.searchsorted(pair, b[three] * n + c[three])
        relative = suffix - first2[b[three]]
        order = np.lexsort((relative, parent))
        three, parent, suffix, relative = three[order], parent[order], suffix[order], relative[order]
        p3 = np.maximum(counts[three] - DISCOUNT, 1e-3) / np.maximum(counts[two][parent], 1)
        back2 = left(p3, p2[suffix], parent, len(two))
        first3 = np.searchsorted(parent, np.arange(len(two) + 1))
        self.p1, self.back1, self.first2 = Codes(np.log10(p1)), Codes(back1), EliasFano(first2)
        self.two = Level(v, first2, np.log10(p2), back2, first3)
        self.three = Level(relative, first3, np.log10(p3))

    def log10(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of c after b after a; a is -1 where there is none."""
        low, high = self.first2[b], self.first2[b + 1]
        at, found = self.two.find(low, high, c)
        out = self.back1[b] + self.p1[c]
        out[found] = self.two.logp[at[found]]
        some = np.flatnonzero(a >= 0)
        node, there = self.two.find(self.first2[a[some]], self.first2[a[some] + 1], b[some])
        some, node = some[there], node[there]
        hit = np.zeros(len(some), bool)
        where = np.zeros(len(some), np.int64)
        if len(some):
            low3, high3 = self.two.pointers[node], self.two.pointers[node + 1]
            where, hit = self.three.find(low3, np.where(found[some], high3, low3), at[some] - low[some])
        out[some[~hit]] += self.two.backoff[node[~hit]]
        out[some[hit]] = self.three.logp[where[hit]]
        return out

    def bigrams(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The logarithm of each id after the one before it."""
        key, place = np.unique((before << 20) | ids, return_inverse=True)
        return self.log10(np.full(len(key), -1), key >> 20, key & ((1 << 20) - 1))[place]


class Range:
    """Trigrams in three levels: last words of contexts; the words after each (`after`) and the contexts that end with it; each context's words by their places in `after`."""

    def __init__(self, last: np.ndarray, context: np.ndarray, word: np.ndarray, counts: np.ndarray, total: np.ndarray):
        """Of each trigram, ordered by last word, context and word: their ids, its count, and its context's total from elsewhere (all of its words are kept) or -1."""
        new = np.ones(len(context), bool)
        new[1:] = (context[1:] != context[:-1]) | (last[1:] != last[:-1])
        of = np.cumsum(new) - 1
        kept = (counts >= LEAST) | (total >= 0)
        n = int(new.sum())
        own, left = np.bincount(of, counts, n), np.bincount(of[~kept], counts[~kept], n)
        whole = np.where(total[new] >= 0, total[new], own)
        node = np.flatnonzero(np.bincount(of[kept], minlength=n))
        children = np.searchsorted(of[kept], np.append(node, n))
        lasts, above = np.unique(last[new][node], return_inverse=True)
        contexts = np.searchsorted(above, np.arange(len(lasts) + 1))
        key = (np.searchsorted(lasts, last[kept]) << 24) | word[kept]
        after, rank = np.unique(key, return_inverse=True)
        first = np.searchsorted(after >> 24, np.arange(len(lasts) + 1))
        self.lasts = Level(lasts, np.array([0, len(lasts)]), children=contexts)
        self.first_after = EliasFano(first)
        self.after = Level(after & 0xFFFFFF, first)
        self.contexts = Level(context[new][node], contexts, backoff=np.log10((left[node] + MU) / (whole[node] + MU)), children=children)
        self.words = Level(rank - first[key >> 24], children, np.log10(counts[kept] / (whole[of[kept]] + MU)))

    def log10(self, last: np.ndarray, context: np.ndarray, total: np.ndarray, of: np.ndarray, word: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Of words after contexts, with their lower-order logarithms; `of` is each word's place among contexts, whose last words and totals are given as above."""
        start = np.zeros(len(last), np.int64)
        above, known = self.lasts.find(start, start + self.lasts.ids.n, last)
        some = np.flatnonzero(known)
        at, found = self.contexts.find(self.lasts.pointers[above[some]], self.lasts.pointers[above[some] + 1], context[some])
        node, backoff = np.full(len(last), -1), np.zeros(len(last))
        node[some[found]] = at[found]
        backoff[some[found]] = self.contexts.backoff[at[found]]
        backoff[total >= 0] = np.log10(MU / (total[total >= 0] + MU))
        out = 10 ** (backoff[of] + low)
        asked = np.flatnonzero(node[of] >= 0)
        first = self.first_after[above[of[asked]]]
        at, found = self.after.find(first, self.first_after[above[of[asked]] + 1], word[asked])
        asked, rank = asked[found], (at - first)[found]
        parent = node[of[asked]]
        at, found = self.words.find(self.contexts.pointers[parent], self.contexts.pointers[parent + 1], rank)
        out[asked[found]] += 10 ** self.words.logp[at[found]]
        return np.log10(out)


def remainder() -> Column:
    """What says whether a document is held out (0) or learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder() != 0)


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The driver gets totals, and at most 1 / KNOWN_SHARE words."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.frombuffer(c, "<u8") for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n], pa.int64()), pa.array([len(x) for x in n], pa.int64())], names=["n", "v"])

    n, v = counts.mapInArrow(totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, c = unpacked(batch.column(1).to_pylist(), batch.column(2).to_pylist()).total()
            kept = (c >= KNOWN_SHARE * n) | (keys == END_KEY)
            yield pa.RecordBatch.from_arrays([pa.array(keys[kept].view(np.int64)), pa.array(c[kept])], names=["word", "n"])

    rows = counts.mapInArrow(known, "word long, n long").toArrow()
    return Vocabulary(rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy(), n, v)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of two words' hashes in a row."""
    return mix(a * np.uint64(0xD1342543DE82EF95) + mix(b))


def planes(x: np.ndarray, n: int) -> np.ndarray:
    """The n lowest bytes of each number, lowest first, a plane for each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T)


def numbers(x: np.ndarray) -> np.ndarray:
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, : len(x)] = x.T
    return out.reshape(-1).view("<u8")


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that are equal in a row, and how many."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


class Hot:
    """Keys and totals of the contexts that many tokens have."""

    def __init__(self, keys: np.ndarray, totals: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.totals = keys[order], totals[order]

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


class Common:
    """What every task has of a model, and the number of its ranges."""

    def __init__(self, words: Vocabulary, trie: Trie, hot: Hot, shards: int):
        self.words, self.trie, self.hot, self.shards = words, trie, hot, shards


#: Parts of a model, by the name that they are stored under.
KINDS = {c.__name__: c for c in (EliasFano, Codes, Level, Trie, Range, Vocabulary, Hot, Common)}


def state(part):
    name = type(part).__name__
    return {"kind": name, **{k: state(v) for k, v in vars(part).items()}} if name in KINDS else part


def of_state(part):
    if not isinstance(part, dict):
        return part
    out = object.__new__(KINDS[part.pop("kind")])
    vars(out).update({k: of_state(v) for k, v in part.items()})
    return out


def stored(part) -> bytes:
    """A part of a model as bytes: sizes, its structure, and its arrays at multiples of 16."""
    arrays: list[pickle.PickleBuffer] = []
    pieces = [pickle.dumps(state(part), 5, buffer_callback=arrays.append), *(a.raw() for a in arrays)]
    sizes = np.array([len(pieces), *map(len, pieces)], "<u8").tobytes()
    return b"".join(x for p in (sizes, *pieces) for x in (p, b"\0" * (-len(p) % 16)))


def restored(data):
    """The part of a model that stored() gave; its arrays are where the bytes are."""
    view = memoryview(data)
    n = int(np.frombuffer(view, "<u8", 1)[0])
    at, pieces = -(-8 * (n + 1) // 16) * 16, []
    for size in np.frombuffer(view, "<u8", n, 8).tolist():
        pieces.append(view[at : at + size])
        at += -(-size // 16) * 16
    return of_state(pickle.loads(pieces[0], buffers=pieces[1:]))


class Block:
    """Documents that are sent at once: their tokens by range in as few bytes as possible, and all that is known where they are."""

    def __init__(self, common: Common):
        self.words, self.trie, self.hot, self.shards = common.words, common.trie, common.hot, common.shards
        self.clear()

    def clear(self) -> None:
        self.ids, self.known, self.tokens, self.rare = [], [], [], []
        self.size = 0

    def add(self, ids: list, learn: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> None:
        """Some documents: ids, whether they are learned from, hashes of words and their bounds."""
        words, m = self.words, len(ids)
        at, known = words.places(h)
        n = np.where(known, words.counts[at], 0) if len(words.keys) else np.zeros(len(h), np.int64)
        row = row_of(bounds)
        self.known.append((np.diff(bounds) + 1, np.bincount(row[known], minlength=m) + int(words.ends > 0), np.bincount(row[known], words.base(n[known]), m) + words.base(np.array([words.ends]))[0]))
        seq, wide = words.sequence(h, bounds)
        place = np.arange(len(h)) + 1 + 2 * row
        keys = np.full(wide[-1], END_KEY, np.uint64)
        keys[wide[:-1]] = START_KEY
        keys[place] = h
        token = np.ones(len(seq), bool)
        token[wide[:-1]] = False
        token = np.flatnonzero(token)
        low = np.zeros(len(seq))
        low[token] = self.trie.bigrams(seq[token - 1], seq[token])
        rare = seq[place] == RARE
        low[place[rare]] += words.within_rare(n[rare], known[rare])
        before = keys[token - 1]
        context = pair_key(np.where(before == START_KEY, START_KEY, keys[token - 2]), before)
        word = mix(keys[token])
        number, is_hot = self.hot.places(context)
        hot_word = np.zeros(len(seq), bool)
        if len(words.keys):
            hot_word[place] = known & words.hot[at]
        shard = shard_of(np.where(is_hot, mix(context ^ word), np.where(hot_word[token - 1], context, before)), self.shards)
        key = (before << np.uint64(32)) | np.where(is_hot, number.astype(np.uint64) | np.uint64(HOT_BIT), context & np.uint64(HOT_BIT - 1))
        of = row_of(wide)[token]
        done = len(self.ids)
        rows = (of + done).astype(np.uint64) | (learn[of].astype(np.uint64) << np.uint64(15))
        code = np.clip(np.rint(-low[token] / LOW_STEP), 0, 255).astype(np.uint8)
        self.tokens.append((shard, key, (word >> np.uint64(40)).astype(np.uint32), code, rows.astype(np.uint16)))
        unknown = np.flatnonzero(~known)
        self.rare.append((shard_of(h[unknown], self.shards), h[unknown], (row[unknown] + done).astype("<u2")))
        self.ids += ids
        self.size += len(token)

    def sent(self, number: int) -> pa.RecordBatch:
        """A row (shard, block, of_range, packed) for each range, and one of what is known here."""
        pack = zstandard.ZstdCompressor(level=1).compress
        shard, key, word, code, rows = (np.concatenate([t[k] for t in self.tokens]) for k in range(5))
        order = np.argsort(key)
        order = order[np.argsort(shard[order].astype(np.uint16 if self.shards < 1 << 16 else np.int32), kind="stable")]
        key, word, code, rows, ends = key[order], word[order], code[order], rows[order], np.searchsorted(shard[order], np.arange(self.shards + 1))
        rare_shard, rare, rare_row = (np.concatenate([t[k] for t in self.rare]) for k in range(3))
        order = np.argsort(rare_shard, kind="stable")
        rare, rare_row, rare_ends = rare[order], rare_row[order], np.searchsorted(rare_shard[order], np.arange(self.shards + 1))
        some = np.flatnonzero((np.diff(ends) > 0) | (np.diff(rare_ends) > 0)).tolist()
        packed_ = []
        for s in some:
            own, r = slice(ends[s], ends[s + 1]), slice(rare_ends[s], rare_ends[s + 1])
            context, of_context = runs(key[own])
            last, of_last = runs(context >> np.uint64(32))
            parts = np.array([own.stop - own.start, len(context), len(last)], "<u4"), planes(np.diff(last, prepend=last[:1]), 4), planes(of_last, 4), planes(context, 4), planes(of_context, 4), planes(word[own], 3), code[own], planes(rows[own], 2)
            packed_.append(pack(b"".join([*(x.tobytes() for x in parts), (last[:1].astype("<u8")).tobytes(), rare[r].astype("<u8").tobytes(), rare_row[r].tobytes()])))
        known = self.ids, *(np.concatenate([k[i] for k in self.known]) for i in range(3))
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([*some, number % self.shards], pa.int32()),
                pa.array([number] * (len(some) + 1), pa.int64()),
                pa.array([True] * len(some) + [False], pa.bool_()),
                pa.array([*packed_, pack(pickle.dumps(known, 5))], pa.binary()),
            ],
            names=["shard", "block", "of_range", "packed"],
        )
        self.clear()
        return out


def opened(message: bytes) -> tuple[np.ndarray, ...]:
    """What sent() made of a range's tokens: contexts with their last words, tokens of each, words, codes, rows; rare words and their rows."""
    n, c, m = np.frombuffer(message, "<u4", 3).tolist()
    at = 12

    def take(planes: int, size: int) -> np.ndarray:
        nonlocal at
        at += planes * size
        return np.frombuffer(message, np.uint8, planes * size, at - planes * size).reshape(planes, size)

    last, of_last, context, of_context, word, code, row = (numbers(take(*shape)) for shape in ((4, m), (4, m), (4, c), (4, c), (3, n), (1, n), (2, n)))
    if m:
        last = np.cumsum(last) + np.frombuffer(message, "<u8", 1, at)[0]
        at += 8
    rare = (len(message) - at) // 10
    keys = (np.repeat(last, of_last.astype(np.int64)) << np.uint64(32)) | context
    return keys, of_context.astype(np.int64), word.astype(np.uint32), code.astype(np.uint8), row.astype(np.uint16), np.frombuffer(message, "<u8", rare, at), np.frombuffer(message, "<u2", rare, at + 8 * rare)


class Tokens:
    """A range's tokens as pairs of context and word, ordered by last word, context and word; how often each is learned from; and what is known of each context."""

    def __init__(self, asked: list[tuple], hot: Hot):
        keys, sizes, word, code, row = (np.concatenate([np.zeros(0, kind), *(m[k] for m in asked)]) for k, kind in enumerate((np.uint64, np.int64, np.uint32, np.uint8, np.uint16), 1))
        contexts, at = np.unique(keys, return_inverse=True)
        pair, self.place = np.unique((np.repeat(at, sizes) << 24) | word.astype(np.int64), return_inverse=True)
        del keys, sizes, at, word
        self.of, self.word = pair >> 24, pair & 0xFFFFFF
        self.counts = np.bincount(self.place[row >> 15 == 1], minlength=len(pair))
        self.row = row & 0x7FFF
        self.low = np.zeros(len(pair))
        self.low[self.place] = -LOW_STEP * code
        self.last, self.context = (contexts >> np.uint64(32)).astype(np.int64), (contexts & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.total = np.full(len(contexts), -1.0)
        known = self.context >= HOT_BIT
        self.total[known] = hot.totals[self.context[known] - HOT_BIT]

    def learned(self) -> Range:
        """The trie of what is learned from."""
        some = np.flatnonzero(self.counts)
        of = self.of[some]
        return Range(self.last[of], self.context[of], self.word[some], self.counts[some], self.total[of])


def scored(asked: list[tuple], tokens: Tokens, trie: Range, keys: np.ndarray, held: np.ndarray, words: Vocabulary) -> list[tuple]:
    """Of a range's messages (block, what opened() gave), their tokens, its trie, and the counts of its words: (block, a bit for each row that has some, sums of logarithms) and (block, rows, known, base)."""
    out: list[tuple] = []
    values = trie.log10(tokens.last, tokens.context, tokens.total, tokens.of, tokens.word, tokens.low)
    end = 0
    for block, _, _, word, *_ in asked:
        mine = slice(end, end + len(word))
        end = mine.stop
        sums = np.bincount(tokens.row[mine], values[tokens.place[mine]])
        has = np.bincount(tokens.row[mine]) > 0
        rows = np.flatnonzero(has)
        if len(rows):
            out.append((block, np.packbits(has).tobytes(), sums[rows].astype(np.float32).tobytes()))
    for block, *_, wanted, rows in asked:
        if len(wanted):
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            n = np.where(keys[at] == wanted, held[at], 0) if len(keys) else np.zeros(len(wanted), np.int64)
            some, of = np.unique(rows, return_inverse=True)
            out.append((block, some, np.bincount(of, n > 0).astype(np.uint16 if len(n) < 1 << 16 else np.int64), np.bincount(of, words.base(n))))
    return out


def model_of(docs: DataFrame, shards: int) -> tuple[DataFrame, Common]:
    """Word counts, and of the training documents the parts of the model that every task has."""
    learned = training(docs)
    counts = cut(word_counts(learned, shards))
    words = vocabulary_of(counts)
    kept = gram_counts(learned, Shared(docs.sparkSession, words), shards, max(1, GRAM_SHARE * words.tokens)).toArrow()
    gram, n = kept["gram"].to_numpy(), kept["n"].to_numpy()
    a, b = (gram >> 20) & ((1 << 20) - 1), gram & ((1 << 20) - 1)
    many = (n >= max(1, HOT_SHARE * words.tokens)) & (a != RARE) & (b != RARE) & (b != END)
    keys = pair_key(np.append(words.of_id[a[many]], START_KEY), np.append(words.of_id[b[many]], START_KEY))
    return counts, Common(words, Trie(words.unigrams, gram, n), Hot(keys, np.append(n[many], words.ends)), shards)


def sent_tokens(docs: DataFrame, common: Common) -> DataFrame:
    """Tokens by range, in blocks of documents."""
    known = Shared(docs.sparkSession, common)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(known.get()), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, data, rows in slices(batch, "text", SCORED_BYTES):
                h, bounds = word_hashes(data, rows)
                if block.size and (block.size + len(h) > BLOCK_TOKENS or len(block.ids) + part.num_rows > BLOCK_ROWS):
                    yield block.sent(number)
                    number += 1
                block.add(part.column(0).to_pylist(), part.column(2).to_numpy(zero_copy_only=False), h, bounds)
        if block.size:
            yield block.sent(number)

    rows = docs.select("doc_id", "text", F.coalesce(remainder() != 0, F.lit(False)).alias("learn"))
    return rows.mapInArrow(send, "shard int, block long, of_range boolean, packed binary")


def messages(asked: pa.Table) -> tuple[list[tuple], list[tuple]]:
    """A range's messages, opened, and those of what is known where the documents are: (block, packed)."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = list(zip(asked["block"].to_pylist(), asked["packed"].to_pylist(), asked["of_range"].to_pylist(), strict=True))
    return [(k, *opened(unpack(x))) for k, x, r in rows if r], [(k, x) for k, x, r in rows if not r]


def fit(docs: DataFrame, path: str) -> None:
    """Learns from the training documents and writes the model to a new folder: `ranges`, with the counts of words and the trie of each, and `common`, of a size that shares of the tokens bound."""
    docs = in_order(texts(docs))
    counts, common = model_of(docs, shards_for(docs, RANGE_BYTES))
    hot = Shared(docs.sparkSession, common.hot)

    def learned(asked: pa.Table, held: pa.Table) -> pa.Table:
        got, _ = messages(asked)
        keys, n = unpacked(held["keys"].to_pylist(), held["counts"].to_pylist()).total()
        levels = stored(Tokens(got, hot.get()).learned())
        shard = (asked if asked.num_rows else held)["shard"][:1].combine_chunks()
        return pa.table({"shard": shard, "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([n.astype("<u8").tobytes()], pa.binary()), "levels": pa.array([levels], pa.binary())})

    tokens = sent_tokens(training(docs), common)
    tokens.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(learned, f"{PACKED}, levels binary").write.parquet(f"{path}/ranges")
    docs.sparkSession.createDataFrame([(bytearray(stored(common)),)], "common binary").write.parquet(f"{path}/common")


def scores(docs: DataFrame, common: Common, ranges: DataFrame) -> DataFrame:
    """Scores of documents by ranges that have `levels`, or that make them of the training documents among these."""
    known = Shared(docs.sparkSession, (common.words, common.hot))
    made = "levels" not in ranges.columns
    model: list = []  # each task has its own copy

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not model:
            model.extend(known.get())
        words, hot = model
        keys, n = unpacked(held["keys"].to_pylist(), held["counts"].to_pylist()).total()
        got, others = messages(asked)
        tokens = Tokens(got, hot)
        if made:
            trie = tokens.learned()
        elif held.num_rows:
            trie = restored(held["levels"][0].as_buffer())
        else:
            trie = Tokens([], hot).learned()
        out = others + [(k, pickle.dumps(x, 5)) for k, *x in scored(got, tokens, trie, keys, n, words)]
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "packed": pa.array([x[1] for x in out], pa.binary()), "known": pa.array([k < len(others) for k in range(len(out))], pa.bool_())})

    def summed(table: pa.Table) -> pa.Table:
        packed_, first = table["packed"].to_pylist(), table["known"].to_pylist().index(True)
        ids, tokens, n_known, base = pickle.loads(zstandard.ZstdDecompressor().decompress(packed_[first]))
        score = np.zeros(len(ids))
        for k, x in enumerate(packed_):
            if k != first:
                rows, values, *more = pickle.loads(x)
                if more:
                    n_known[rows] += values
                    base[rows] += more[0]
                else:
                    score[np.flatnonzero(np.unpackbits(np.frombuffer(rows, np.uint8)))] += np.frombuffer(values, np.float32)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": tokens, "n_known": n_known, "base_score": base, "score": score})

    answers = sent_tokens(docs, common).groupBy("shard").cogroup(ranges.groupBy("shard")).applyInArrow(answer, "block long, packed binary, known boolean")
    got = answers.groupBy("block").applyInArrow(summed, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return got.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(common.words.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, path: str) -> DataFrame:
    """The rows of report() for any documents, by a model that fit() wrote."""
    read = docs.sparkSession.read
    return scores(in_order(texts(docs)), restored(read.parquet(f"{path}/common").first()[0]), read.parquet(f"{path}/ranges"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document, by what is learned from the training documents among them."""
    docs = in_order(texts(docs))
    counts, common = model_of(docs, shards_for(docs, RANGE_BYTES))
    return scores(docs, common, counts)
