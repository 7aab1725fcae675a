"""Alignment of two tokenizers' ids over the same bytes.

A text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B), without
special tokens. Packed bitsets over the bytes of many texts mark where tokens of A and
of B end. The AND of both is where both end: these shared cuts part the tokens into
groups. Every set bit of the OR ends one overlap of a token of A with one of B, so it
is one link. Popcounts before a cut (rank) say which tokens lie on its left, which
gives the token ranges of groups and the two tokens of each link.

Links are then expanded into corpus-wide counts: in how many documents does an id pair
occur linked. Each document keeps its distinct pairs packed, in the shared folder;
tasks count them before anything is shuffled. Pair counts are looked up by every task
while there are at most `at_once` pairs; beyond, pairs and counts are joined.

Nulls and edge cases: a text that is null, empty, or whose tokens don't give its bytes
back (a normalizing B) has no tokens: zeros and an empty digest; a null doc_id is kept;
every row is a document, so repeated rows count as often as they occur; an empty table
gives no rows; texts are encoded whole; special tokens' strings are plain text.
"""

from __future__ import annotations

import hashlib
import pathlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Shared, cut, texts
from .packing import Encoder, vocabulary
from .textarrays import slices

#: Pairs that every task may have in memory, of 17 bytes each; beyond, they are joined.
AT_ONCE = 1 << 21
#: Distinct pairs that a task holds while it counts.
HELD = 1 << 22

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
GROUPS = "doc_id long, group long, start long, end long, a_ids array<long>, b_ids array<long>"


class Bits:
    """A bitset over byte offsets, with the number of bits before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def at(offsets: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-(size + 1) // 64) * 64, bool)
        flags[offsets] = True
        return Bits(np.packbits(flags, bitorder="little").view(np.uint64))

    def rank(self, offsets: np.ndarray) -> np.ndarray:
        """How many bits are set below each offset."""
        word, bit = offsets >> 6, (offsets & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def select(self) -> np.ndarray:
        """The offsets of all bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Plain(Encoder):
    """Ids of whole texts, in which added tokens' strings are ordinary text."""

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), np.int64)
        except Exception:  # a text on which the regular expression gives up
            from tokenizers import Tokenizer

            slow = Tokenizer.from_str(self.json)
            slow.encode_special_tokens = True
            return np.asarray(slow.encode(text, add_special_tokens=False).ids, np.int64)


class Vocabularies:
    """What tasks need of both tokenizers; a fixed few MB."""

    def __init__(self, byte_level_path: str, piece_path: str):
        text = pathlib.Path(byte_level_path).read_text(encoding="utf-8")
        ranks, added = vocabulary(text)
        self.name, self.ranks, self.added, self.json = byte_level_path, ranks, added, text
        self.model = pathlib.Path(piece_path).read_bytes()

    def open(self) -> Tokenizers:
        return Tokenizers(self)


class Tokenizers:
    """Both tokenizers, opened in a task, and their tokens' bytes."""

    def __init__(self, v: Vocabularies):
        import sentencepiece

        self.a = Plain(v.name, v.ranks, v.added, v.json)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=v.model)
        self.a_bytes = [b""] * (max([*v.ranks.values(), *v.added.values()]) + 1)
        for token, i in v.ranks.items():
            self.a_bytes[i] = token
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.n_b = n

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none where one of them doesn't give the text's bytes back."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        whole = b" " + text.encode()
        a, b = self.a(" " + text), np.asarray(self.b.encode(text), np.int64)
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole:
            return none, none
        return a, b


class Alignment:
    """Groups and links of many texts at once, whose bytes lie one after the other."""

    def __init__(self, t: Tokenizers, ids: list[tuple[np.ndarray, np.ndarray]]):
        none = [np.zeros(0, np.int64)]
        self.a, self.b = np.concatenate([x for x, _ in ids] + none), np.concatenate([x for _, x in ids] + none)
        self.a_rows, self.b_rows = (np.concatenate([[0], np.cumsum([len(x[k]) for x in ids])]).astype(np.int64) for k in (0, 1))
        a_ends, b_ends = np.cumsum(t.a_sizes[self.a]), np.cumsum(t.b_sizes[self.b])
        size = int(a_ends[-1]) if len(a_ends) else 0
        in_a, in_b = Bits.at(a_ends, size), Bits.at(b_ends, size)
        self.rows = np.concatenate([[0], a_ends])[self.a_rows]
        self.cuts = Bits(in_a.words & in_b.words).select()
        self.group_rows = np.searchsorted(self.cuts, self.rows, "right")
        self.a_to, self.b_to = in_a.rank(self.cuts) + 1, in_b.rank(self.cuts) + 1
        ends = Bits(in_a.words | in_b.words).select()
        self.link_rows = np.searchsorted(ends, self.rows, "right")
        self.link_a, self.link_b = in_a.rank(ends), in_b.rank(ends)

    def digests(self) -> list[str]:
        """The hex digest of each text's groups as `a1,a2|b1;a3|b2,b3`; of one without tokens, nothing."""
        a_of, b_of = np.diff(self.a_to, prepend=0), np.diff(self.b_to, prepend=0)
        n = len(self.a) + len(self.b)
        ids, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
        a_at = np.arange(len(self.a)) + np.repeat(self.b_to - b_of, a_of)
        b_at = np.arange(len(self.b)) + np.repeat(self.a_to, b_of)
        ids[a_at], ids[b_at] = self.a, self.b
        mark[a_at[self.a_to - 1]], mark[b_at[self.b_to - 1]] = ord("|"), ord(";")
        width = len(str(int(ids.max()))) if n else 1
        sizes = np.searchsorted(10 ** np.arange(1, width), ids, "right") + 1
        shown = np.zeros((n, width + 1), np.uint8)
        for k in range(width):
            shown[:, k] = ids // 10 ** np.maximum(sizes - 1 - k, 0) % 10 + 48
        shown[np.arange(n), sizes] = mark
        flat = shown[np.arange(width + 1) <= sizes[:, None]].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes + 1)])[self.a_rows + self.b_rows].tolist()
        return [hashlib.sha256(flat[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]

    def pairs(self, n_b: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The distinct id pairs (a * n_b + b, ascending) among each text's links, and how many links each has."""
        code = self.a[self.link_a] * n_b + self.b[self.link_b]
        out = []
        for i, j in zip(self.link_rows[:-1].tolist(), self.link_rows[1:].tolist(), strict=True):
            out.append(np.unique(code[i:j], return_counts=True))
        return out


def packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    return np.concatenate([np.diff(codes, prepend=0), counts]).astype(np.int64).tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob, np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def aligned(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """Counts, digest and distinct pairs of each row of doc_id and text."""
    known = Shared(docs.sparkSession, vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = known.get().open()
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part, _, _ in slices(batch, 1):
                got = Alignment(t, [t.encode(x) for x in part.column(1).to_pylist()])
                columns = [np.diff(x) for x in (got.a_rows, got.b_rows, got.group_rows, got.link_rows)]
                blobs = [pack(packed(*p)) for p in got.pairs(t.n_b)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(got.digests(), pa.string()), pa.array(blobs, pa.binary())],
                    names=[c.split()[0] for c in ALIGNED.split(", ")],
                )

    return docs.mapInArrow(run, ALIGNED)


def groups(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each group: its number, its bytes in space+text, and the ids of both tokenizers that it holds."""
    rows = texts(docs, id_col, text_col)
    known = Shared(docs.sparkSession, Vocabularies(byte_level_path, piece_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = known.get().open()
        for batch in batches:
            for part, _, _ in slices(batch, 1):
                got = Alignment(t, [t.encode(x) for x in part.column(1).to_pylist()])
                n = np.diff(got.group_rows)
                row = np.repeat(np.arange(len(n)), n)
                first = np.concatenate([[0], got.cuts])[:-1]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]).astype(np.int32)), pa.array(ids)) for to, ids in ((got.a_to, got.a), (got.b_to, got.b))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(np.arange(len(row)) - got.group_rows[row]), pa.array(first - got.rows[row]), pa.array(got.cuts - got.rows[row]), *lists],
                    names=[c.split()[0] for c in GROUPS.split(", ")],
                )

    return rows.mapInArrow(run, GROUPS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """code and n: in how many rows each pair is. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)

        def sums(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for blob in batch.column(0):
                codes = unpacked(unpack(blob.as_buffer()))[0]
                held.append((codes, np.ones(len(codes), np.int64)))
                size += len(codes)
                if size >= HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield sums(*held[0])
                        held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        yield sums(*merged())

    return rows.select("pairs").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def weights(counts: DataFrame, n_b: int) -> DataFrame:
    """`counts` with best: whether no pair of the same A id has a higher count."""
    a = F.expr(f"code div {n_b}").alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("top"))
    return counts.select("code", "n", a).join(top, "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))


def looked_up(rows: DataFrame, weighed: DataFrame) -> DataFrame:
    """n_best and count_sum beside each row, from weights that every task has."""
    table = weighed.toArrow().sort_by("code")
    known = Shared(rows.sparkSession, tuple(table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("code", "n", "best")))
    schema = f"{ALIGNED.rpartition(', ')[0]}, n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = known.get()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), np.int64)
            for i, blob in enumerate(batch.column(batch.num_columns - 1)):
                own, links = unpacked(unpack(blob.as_buffer()))
                at = np.searchsorted(codes, own)
                sums[:, i] = links[best[at]].sum(), (links * n[at]).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums[0]), pa.array(sums[1])], names=[*batch.schema.names[:-1], "n_best", "count_sum"])

    return rows.mapInArrow(run, schema)


def joined(rows: DataFrame, weighed: DataFrame) -> DataFrame:
    """What looked_up() gives, by a join of every row's pairs with the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own, links = unpacked(unpack(blob.as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row)), pa.array(own), pa.array(links)], names=["row", "code", "links"])

    exploded = rows.select("row", "pairs").mapInArrow(run, "row long, code long, links long")
    sums = exploded.join(weighed, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links"))).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs").join(sums, "row", "left").withColumns({c: F.coalesce(F.col(c), zero) for c in ("n_best", "count_sum")}).drop("row")


def report(docs: DataFrame, byte_level_path: str, piece_path: str, at_once: int = AT_ONCE) -> DataFrame:
    """Per document the counts of tokens, groups and links, the links whose pair is the best of its A id corpus-wide, and the sum of the links' pair counts."""
    spark = docs.sparkSession
    vocabularies = Vocabularies(byte_level_path, piece_path)
    n_b = vocabularies.open().n_b
    with Scratch(spark, "alignment") as keep:
        rows = keep(aligned(texts(docs), vocabularies).withColumn("row", F.monotonically_increasing_id()))
        weighed = keep(weights(keep(pair_counts(rows)), n_b))
        fields = [c.split()[0] for c in ALIGNED.split(", ")]
        few = weighed.limit(at_once + 1).count() <= at_once
        got = looked_up(rows.select(fields), weighed) if few else joined(rows.select("row", *fields), weighed)
        return cut(got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
