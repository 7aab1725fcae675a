"""The alignment of two tokenizers against a plain version."""

import collections
import hashlib
import json
import pathlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumeline.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: i for i, c in enumerate(chr(x) for x in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])}
    byte = {c: ord(c) for c in letters}
    free = [x for x in range(256) if x not in byte.values()]
    byte |= {chr(256 + k): x for k, x in enumerate(free)}
    tokens = {i: bytes(byte[c] for c in t) for t, i in json.loads(pathlib.Path(A).read_text())["model"]["vocab"].items() if t != "<|endoftext|>"}

    def ends(sizes):
        return np.cumsum(sizes).tolist()

    def one(text):
        """ids of A and of B, groups as (A ids, B ids), linked pairs."""
        if not text:
            return [], [], [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xs = [tokens[i] for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            return [], [], [], []
        ex, ey = ends([len(t) for t in xs]), ends([len(t) for t in ys])
        groups, i, j = [], 0, 0
        for cut in sorted(set(ex) & set(ey)):
            k, m = ex.index(cut, i) + 1, ey.index(cut, j) + 1
            groups.append((x[i:k], y[j:m]))
            i, j = k, m
        links, j = [], 0
        for i, end in enumerate(ex):
            start = end - len(xs[i])
            while j and ey[j - 1] > start:
                j -= 1
            while ey[j] <= start:
                j += 1
            k = j
            while k < len(y) and ey[k] - len(ys[k]) < end:
                links.append((x[i], y[k]))
                k += 1
        return x, y, groups, links

    return one


def expected(plain, pairs):
    rows = [(doc, *plain(text)) for doc, text in pairs]
    count = collections.Counter(p for r in rows for p in set(r[4]))
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc, x, y, groups, links in rows:
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        sha = hashlib.sha256(said.encode()).hexdigest() if x else ""
        out.append((doc, len(x), len(y), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=repr)


@pytest.mark.parametrize("at_once", [alignment.AT_ONCE, 10])
def test_report(documents, pairs, plain, at_once):
    """Whole odd and plain texts; pairs looked up and pairs joined."""
    got = alignment.report(documents, A, B, at_once)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(plain, pairs)


def test_empty_table(nothing):
    assert alignment.report(nothing, A, B).count() == 0
    assert alignment.groups(nothing, A, B).count() == 0


def test_groups(spark, plain):
    texts = [(1, "naïve \U0001f600 <|endoftext|> </s> tokenization"), (1, "naïve \U0001f600 <|endoftext|> </s> tokenization"), (2, None), (3, ""), (None, " two  spaces\n\nand lines ")]
    rows = alignment.groups(spark.createDataFrame(texts, "key int, body string"), A, B, "key", "body").collect()
    for key, body in {x for x in texts if x[1]}:
        mine = sorted(r for r in rows if r["doc_id"] == key)
        want = plain(body)[2] * texts.count((key, body))
        assert sorted((r["a_ids"], r["b_ids"]) for r in mine) == sorted(want)
        assert {r["start"] for r in mine} - {r["end"] for r in mine} == {0} and max(r["end"] for r in mine) == len(body.encode()) + 1
    assert {r["doc_id"] for r in rows} == {1, None}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_texts(plain, bodies):
    t = alignment.Vocabularies(A, B).open()
    got = alignment.Alignment(t, [t.encode(x) for x in bodies])
    pairs = got.pairs(t.n_b)
    for i, body in enumerate(bodies):
        x, y, groups, links = plain(body)
        assert got.a[got.a_rows[i] : got.a_rows[i + 1]].tolist() == x and got.b[got.b_rows[i] : got.b_rows[i + 1]].tolist() == y
        assert got.group_rows[i + 1] - got.group_rows[i] == len(groups)
        assert collections.Counter(dict(zip(pairs[i][0].tolist(), pairs[i][1].tolist(), strict=True))) == collections.Counter(a * t.n_b + b for a, b in links)


def test_texts_that_fill_words_of_bits(plain):
    """Bytes of all texts together at and around multiples of 64."""
    t = alignment.Vocabularies(A, B).open()
    for n in range(60, 132):
        got = alignment.Alignment(t, [t.encode("x" * (n - 1))])
        assert got.a_to[-1] == len(plain("x" * (n - 1))[0]) and got.rows[-1] == n


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 300)), st.lists(st.integers(0, 300), min_size=1))
def test_bits(offsets, asked):
    bits = alignment.Bits.at(np.array(sorted(offsets), np.int64), 300)
    assert bits.select().tolist() == sorted(offsets)
    assert bits.rank(np.array(asked)).tolist() == [sum(o < x for o in offsets) for x in asked]
