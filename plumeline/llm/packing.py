"""Hierarchical multi-length packing of token ids into training sequences.

Documents are cut at the longest context size; what is left of each goes to the
smallest context size (tier) that holds it. Windows are packed from the longest
tier down: the longest open item starts a window, its gap is filled with the
longest shorter items that fit, and the last few places with a cut of one more
item. What a block leaves over goes to windows of falling powers of two, so no
sequence has padding. Windows of one tier are dealt into step groups of equal token
budget, so that groups cost about the same attention work.

Every task packs its own documents, in blocks of bounded size: no shuffle, no state
beyond a block, and a lost task gives the same pieces again.

Nulls and edge cases: a null or empty text is the end id alone; a null doc_id is
kept; repeated rows are packed as often as they occur; an empty table gives no
pieces; a text of any length is cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, texts

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16384
BLOCK_TOKENS = 2 << 20
END_ID = 1

#: Fixed value: how byte-level BPE files of this kind cut text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = "doc_id long, doc_tokens long, start long, length long, sequence_id long, offset long, window long, step_group long, ids binary"


def byte_of_letter() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable bytes for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(tokenizer_json: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to ids of a byte-level BPE file whose ids are in the order of its merges, and its added tokens."""
    model = json.loads(tokenizer_json)
    if model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("a byte-level BPE file without prefix space is needed")
    if any(t.get(k) for t in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens must be found wherever they stand, as they are")
    letter, added = byte_of_letter(), {t["content"]: t["id"] for t in model["added_tokens"]}
    return {bytes(letter[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}, added


class Encoder:
    """Ids of whole texts, as `tokenizers` gives them: where an added token's string stands in a text, it is that token."""

    def __init__(self, name: str, ranks: dict[bytes, int], added: dict[str, int], tokenizer_json: str):
        import tiktoken

        known = tiktoken.registry.ENCODINGS  # lives as long as the worker process
        if name not in known:
            known[name] = tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=ranks, special_tokens=added)
        self.fast, self.json = known[name], tokenizer_json

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        except Exception:  # a text on which the regular expression gives up
            from tokenizers import Tokenizer

            return np.asarray(Tokenizer.from_str(self.json).encode(text, add_special_tokens=False).ids, np.uint32)


class Block:
    """Items (document, start, length) by length; windows are taken from them until none is left."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = sorted(tiers)
        self.items: list[list[tuple[int, int, int]]] = [[] for _ in range(self.tiers[-1] + 1)]
        self.lengths = 0  # bit n: there are items of length n

    def put(self, doc: int, start: int, length: int) -> None:
        if length:
            self.items[length].append((doc, start, length))
            self.lengths |= 1 << length

    def take(self, length: int) -> tuple[int, int, int]:
        got = self.items[length].pop()
        if not self.items[length]:
            self.lengths &= ~(1 << length)
        return got

    def windows(self, sizes: list[int]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Window sizes and contents; each id of each document is in exactly one."""
        top = self.tiers[-1]
        for doc, n in enumerate(sizes):
            for start in range(0, n - top + 1, top):
                yield top, [(doc, start, top)]
            self.put(doc, n - n % top, n % top)
        while self.lengths:
            first = self.take(self.lengths.bit_length() - 1)
            size = next(t for t in self.tiers if t >= first[2])
            window, gap = [first], size - first[2]
            while gap and self.lengths:
                fits = (self.lengths & ((2 << gap) - 1)).bit_length() - 1
                if fits > 0:
                    window.append(self.take(fits))
                    gap -= fits
                else:
                    doc, start, length = self.take((self.lengths & -self.lengths).bit_length() - 1)
                    window.append((doc, start, gap))
                    self.put(doc, start + gap, length - gap)
                    gap = 0
            if gap:
                yield from self.tail(window, size - gap)
            else:
                yield size, window

    @staticmethod
    def tail(window: list[tuple[int, int, int]], n: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """A last window cut into full ones of falling powers of two."""
        window = window[::-1]
        while n:
            size = 1 << (n.bit_length() - 1)
            part, gap = [], size
            while gap:
                doc, start, length = window.pop()
                part.append((doc, start, min(length, gap)))
                if length > gap:
                    window.append((doc, start + gap, length - gap))
                gap -= min(length, gap)
            yield size, part
            n -= size


def step_groups(sizes: np.ndarray, costs: np.ndarray, step_tokens: int) -> np.ndarray:
    """A group for each window: of one size and of step_tokens in all, dealt to and fro by falling cost."""
    out, base = np.zeros(len(sizes), np.int64), 0
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        n = -(-len(at) * int(size) // step_tokens)
        at = at[np.argsort(-costs[at], kind="stable")]
        lap, place = np.divmod(np.arange(len(at)), n)
        out[at] = base + np.where(lap % 2, n - 1 - place, place)
        base += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents' ids (32-bit little-endian in `ids`) with their places in sequences.

    tokenizer_path: a byte-level BPE file; its bytes (a fixed few MB) go to the executors.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    known = docs.sparkSession.sparkContext.broadcast((tokenizer_path, *vocabulary(text), text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*known.value)
        next_sequence = next_step = TaskContext.get().partitionId() << 32
        ends = np.array([end_id], np.uint32)

        def packed(doc_ids: list, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal next_sequence, next_step
            windows = list(Block(tiers).windows([len(x) for x in ids]))
            sizes = np.array([size for size, _ in windows], np.int64)
            costs = np.array([sum(p[2] * p[2] for p in parts) for _, parts in windows], np.int64)
            steps = step_groups(sizes, costs, step_tokens) + next_step
            rows: list[list] = [[] for _ in range(9)]
            for k, (size, parts) in enumerate(windows):
                offset = 0
                for doc, start, length in parts:
                    values = (doc_ids[doc], len(ids[doc]), start, length, next_sequence + k, offset, size, int(steps[k]), ids[doc][start : start + length].tobytes())
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    offset += length
            next_sequence += len(windows)
            next_step = int(steps.max()) + 1
            kinds = [pa.int64()] * 8 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        doc_ids, ids, total = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.concatenate([encode(text.as_py() or ""), ends]).astype("<u4")
                doc_ids.append(doc_id)
                ids.append(got)
                total += len(got)
                if total >= block_tokens:
                    yield from packed(doc_ids, ids)
                    doc_ids, ids, total = [], [], 0
        if ids:
            yield from packed(doc_ids, ids)

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    name = fresh("ids_crc32", pieces.columns)
    return pieces.withColumn(name, F.crc32("ids")).select("doc_id", "start", "length", name, "doc_tokens", "sequence_id", "offset", "window", "step_group")
