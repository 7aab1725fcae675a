"""Noisy-channel decoding against all paths, and scores on labels that weren't learned from."""

import collections
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumeline.llm import toxicity
from plumeline.llm.common import Shared, table, texts

SOME = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.Characters(toxicity.character_counts(texts(table(spark, SOME, "documents"))))


@pytest.fixture(scope="module")
def channel(model):
    return toxicity.Channel(model)


def test_character_counts(spark):
    bodies = ["Ab1  ä!", None, "", "aB"]
    got = toxicity.character_counts(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").coalesce(1))
    kinds = [0, 0, 0]
    for body in bodies:
        for c in (body or "") + "\n":
            k = toxicity.kind_of(c.lower())
            kinds += [k] if k or kinds[-1] or len(kinds) == 3 else []
    want = collections.Counter(zip(kinds, kinds[1:], kinds[2:], kinds[3:], strict=False))
    assert {tuple(int(x) for x in np.unravel_index(i, (32,) * 4)): got[i] for i in np.flatnonzero(got)} == want


def test_probabilities(model):
    assert np.allclose(np.exp(model.log.astype(float)).reshape(-1, toxicity.KINDS).sum(axis=1), 1)


def all_paths(channel, seen):
    """The cheapest of all paths through a lattice, and its cost."""
    best = None
    for path in itertools.product(*channel.lattice(seen)):
        said, cost = "".join(c for c, _ in path), sum(x for _, x in path)
        at = 0
        for c in said + " ":
            gram = at * toxicity.KINDS + toxicity.kind_of(c)
            cost -= channel.log[gram]
            at = gram % toxicity.KINDS**3
        if best is None or cost < best[0] - 1e-9:
            best = cost, said
    return best


@settings(max_examples=80, deadline=None)
@given(st.text("ab1d0!$ot", min_size=1, max_size=7))
def test_decoding_is_the_best_of_all_paths(channel, seen):
    said = channel.decoded(seen)
    best = all_paths(channel, seen)
    again = [p for p in itertools.product(*channel.lattice(seen)) if "".join(c for c, _ in p) == said]
    cost = min(sum(x for _, x in p) for p in again)
    at = 0
    for c in said + " ":
        gram = at * toxicity.KINDS + toxicity.kind_of(c)
        cost -= channel.log[gram]
        at = gram % toxicity.KINDS**3
    assert cost == pytest.approx(best[0])


PLAIN = ["idiot", "moron", "stupid", "loser", "scum", "trash", "clown"]
HIDDEN = {
    "1d10t": "idiot", "m0r0n": "moron", "5tup1d": "stupid", "l0s3r": "loser", "$cum": "scum", "tr@sh": "trash", "cl0wn": "clown",
    "idiooot": "idiot", "stuuupid": "stupid", "iiddiioott": "idiot", "m o r o n": "moron", "l.o.s.e.r": "loser", "s-c-u-m": "scum", "t r @ s h": "trash",
}


def test_hidden_words_are_restored(channel):
    body = "the " + " in ".join(HIDDEN) + " and"
    got, _ = toxicity.restored(np.frombuffer(body.encode(), np.uint8), np.array([0, len(body)]), channel)
    assert got.tobytes().decode().rstrip("\n") == "the " + " in ".join(HIDDEN.values()) + " and"


def test_plain_texts_stay(channel):
    for body in ("Plain words. THE!! of*** a$$$ 1,234 (555) 2.0", "ÉTÉ à la Öffnung, señor", "", "\n\n", "y a"):
        data = np.frombuffer(body.encode(), np.uint8)
        got, bounds = toxicity.restored(data, np.array([0, len(data)]), channel)
        assert got.tobytes().decode() == body.lower() + "\n" and bounds.tolist() == [0, len(got)]


def test_rows_stay_apart(channel):
    bodies = ["1d10t one", "", "two m o r o n", "1d10t"]
    data = np.frombuffer("".join(bodies).encode(), np.uint8)
    got, bounds = toxicity.restored(data, np.cumsum([0, *map(len, bodies)]), channel)
    assert [got[i:j].tobytes().decode() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == ["idiot one\n", "\n", "two moron\n", "idiot\n"]


def test_held_out_and_hidden(spark):
    """Labels that weren't learned from, plain and hidden words, and clean documents."""
    docs, labels = table(spark, SOME, "documents"), table(spark, SOME, "labels")
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    said = {r["doc_id"]: r for r in docs.join(labels, "doc_id").collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    held = [k for k in said if got[k]["held_out"] and said[k]["lang"] == "en"]
    toxic = [k for k in held if said[k]["toxic"] == 1]
    assert sum(got[k]["predicted"] for k in toxic) >= 0.85 * len(toxic) > 5
    assert sum(got[k]["predicted"] for k in held if said[k]["toxic"] == 0) == 0
    rows = texts(docs)
    known = Shared(spark, toxicity.Characters(toxicity.character_counts(rows)))
    lexicon = toxicity.learned(rows, labels, known)
    bodies = [f"and in {a} of {b} the" for a, b in zip(HIDDEN, [*HIDDEN][1:], strict=False)] + [f"and in {a} of {b} the" for a, b in zip(PLAIN, PLAIN[1:], strict=False)] + ["and in the", None, ""]
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string"), known, lexicon).collect()}
    caught = sum(scores[i] >= toxicity.PREDICTED for i in range(len(bodies) - 3))
    assert caught >= 0.8 * (len(bodies) - 3) and max(scores[len(bodies) - k] for k in (1, 2, 3)) < 0.2


def test_odd_rows(spark, documents, pairs, nothing):
    labels = spark.createDataFrame([(100_004, 1), (100_004, 0), (100_006, 0), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    got = toxicity.report(documents, labels).collect()
    assert sorted((repr(r["doc_id"]) for r in got)) == sorted(repr(k) for k, _ in pairs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity.report(nothing, labels).count() == 0


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    one = lambda y: spark.createDataFrame([(k, y) for k in range(5)], "doc_id long, toxic int")
    assert all(r["score"] > 0.9 for r in toxicity.report(docs, one(1)).collect())
    assert all(r["score"] < 0.1 for r in toxicity.report(docs, one(0)).collect())
    assert all(r["score"] < 0.1 for r in toxicity.report(docs, one(0).filter("false")).collect())


def test_curve_and_lexicon():
    lexicon = toxicity.Lexicon(np.array([9, 4], np.uint64), np.array([0.5, 0.9]), 0.1)
    assert lexicon.keys.tolist() == [4, 9] and lexicon.shares.tolist() == [0.9, 0.5]
    x = np.concatenate([np.zeros(90), np.full(10, toxicity.bent(np.array(2.0)))])
    lexicon.fit(x, np.repeat([0.0, 1.0], [90, 10]), np.ones(100))
    low, high = lexicon.scores(np.array([0.0, 2.0]))
    assert low < 0.05 and high > 0.8
    lexicon.fit(x, np.repeat([1.0, 0.0], [90, 10]), np.ones(100))
    assert lexicon.slope >= 0


def test_restored_texts(spark):
    docs = spark.createDataFrame([(1, "An 1d10t"), (2, None), (1, "An 1d10t")] + [(k, "idiot is said by an idiot") for k in range(3, 30)], "key long, body string")
    got = [(r["doc_id"], r["restored"]) for r in toxicity.restored_texts(docs, "key", "body").collect()]
    assert got.count((1, "an idiot")) == 2 and (2, "") in got
