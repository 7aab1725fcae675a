import collections
import pathlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plumeline.llm import chat, decontamination, langid, minhash, ngram_lm, packing, pii, quality, secrets, substrings, textarrays
from plumeline.llm.common import texts
from tests.llm import brute
from tests.llm.conftest import DATA

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ordered(rows):
    return sorted(rows, key=repr)


def test_hashes_are_of_content():
    a = np.frombuffer(b"xx abc d abc", np.uint8)
    s, e, b = textarrays.spans(a, np.array([0, 8, 12]), textarrays.NOT_SPACE)
    h = textarrays.hashes(a, s, e)
    assert b.tolist() == [0, 3, 4] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_ids(spark):
    short = texts(spark.createDataFrame([(7, "a b c"), (None, "d")], "key int, text string"), "key")
    assert ordered((r["doc_id"], r["n"]) for r in minhash.signatures(short).collect()) == [(7, 1), (None, 1)]
    with pytest.raises(TypeError, match="integers"):
        texts(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


# --- packing ---


def test_packing(documents, pairs):
    from tokenizers import Tokenizer

    got = packing.digests(packing.pack(documents, TOKENIZER, block_tokens=50_000)).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    ids = {}
    for doc, text in pairs:
        x = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        ids[doc, len(x)] = x
        want[doc, len(x)] += len(x)
    total = collections.Counter()
    for r in got:
        x = ids[r["doc_id"], r["doc_tokens"]]
        assert zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        total[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert total == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["window"], r["step_group"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        n = parts[-1][0] + parts[-1][1]
        assert n == parts[0][2] <= 2048 and n & (n - 1) == 0
        assert len({p[3] for p in parts}) == 1
    steps = collections.Counter()
    for parts in sequences.values():
        steps[parts[0][3]] += parts[0][2]
    assert max(steps.values()) <= packing.STEP_TOKENS


def test_ids_of_added_tokens():
    """Strings of added tokens within texts are those tokens, as by default."""
    from tokenizers import Tokenizer

    plain, text = Tokenizer.from_file(TOKENIZER), pathlib.Path(TOKENIZER).read_text()
    encode = packing.Encoder(TOKENIZER, *packing.vocabulary(text), text)
    assert encode("<|endoftext|> hi").tolist() == [50256, 23105]
    rng = np.random.default_rng(4)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "a", " b", "'s", "9", "é", "<", "\t x", "\u3000", "!!"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_blocks_hold_every_token():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(1, 6000, rng.integers(1, 40)).tolist()
        seen = [np.zeros(n, int) for n in sizes]
        for size, parts in packing.Block((256, 512, 1024, 2048)).windows(sizes):
            assert sum(p[2] for p in parts) == size
            for doc, start, length in parts:
                seen[doc][start : start + length] += 1
        assert all((s == 1).all() for s in seen)


def test_packing_nothing(nothing):
    assert packing.digests(packing.pack(nothing, TOKENIZER)).count() == 0


# --- decontamination ---


def test_documents_pass_a_large_benchmark_once(spark, monkeypatch):
    """20 MB of test items: only texts that share a fingerprint are written, and results are right."""
    rng = np.random.default_rng(6)
    item = lambda: " ".join(f"w{k}" for k in rng.integers(0, 10**6, 400))
    items = [(str(k), item()) for k in range(7400)]
    docs = [(k, item()) for k in range(300)] + [(1000 + k, items[k * 700][1]) for k in range(10)] + [(2000, None), (1000, items[0][1])]
    written, whole = [], decontamination.cut
    monkeypatch.setattr(decontamination, "cut", lambda df: written.append(whole(df)) or written[-1])
    got = decontamination.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string").repartition(8)).collect()
    assert sum(len(t) for _, t in items) > 20e6
    assert all(df.count() <= 10 for df in written)
    assert {r["doc_id"] for r in got if r["contaminated"]} == {1000 + k for k in range(10)} and len(got) == 312
    assert all(r["n_items"] == 1 and r["n_hit"] == 400 for r in got if r["contaminated"])


@pytest.mark.parametrize("block_bytes", [1 << 20, 500])
def test_contamination(spark, documents, pairs, block_bytes):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "one two three four five"), (901, None), (902, "!!"), (None, "wörd1 wörd2 wörd3"), (0, "ONE"), (903, " ".join(f"wörd{i}" for i in range(5, 17)))], "item_id long, text string"))
    got, name = decontamination.annotate(documents, items, block_bytes=block_bytes)
    rows = got.select("doc_id", *decontamination.verdict(name).values()).collect()
    assert ordered(map(tuple, rows)) == ordered(brute.contamination(pairs, [tuple(r) for r in items.collect()]))


def test_contamination_of_nothing(spark, documents, nothing):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontamination.report(nothing, items).count() == 0
    assert decontamination.report(documents, items.filter("false")).filter("contaminated").count() == 0
    kept = decontamination.decontaminated(documents, items)
    assert kept.columns == documents.columns and 0 < kept.count() < documents.count()


# --- quality ---


def test_quality(documents, pairs):
    rows = quality.report(documents).collect()
    base = lambda r: (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
    assert ordered(map(base, rows)) == ordered((doc, *brute.quality(text)) for doc, text in pairs)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_verdicts_against_dictionaries(documents):
    """Both distances and the verdict, with references made from the same documents."""
    docs = documents.select("doc_id", "text", "lang")
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"], r["lang"]].append(r["text"])
    got = quality.report(docs).collect()
    rows = [(t, lang) for (_, lang), ts in texts.items() for t in ts]
    ids = [i for (i, _), ts in texts.items() for _ in ts]
    counts = [brute.quality(t) for t, _ in rows]  # n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    verdicts = brute.quality_verdicts([(t, lang, c[5], c[0], c[2], c[1]) for (t, lang), c in zip(rows, counts, strict=True)])
    place = lambda x: (repr(x[0]), *x[1:])
    want = sorted((place((i, c[0], c[1], v)) for i, c, v in zip(ids, counts, verdicts, strict=True)), key=repr)
    have = sorted((place((r["doc_id"], r["n_words"], r["word_chars"], (r["char_distance"], r["word_distance"], r["kept"]))) for r in got), key=repr)
    assert len(want) == len(have)
    for w, h in zip(want, have, strict=True):
        assert w[:3] == h[:3] and w[3][2] == h[3][2] and w[3][:2] == pytest.approx(h[3][:2], abs=1e-9)
    assert 0 < sum(v[2] for v in verdicts) < len(verdicts)


def test_quality_follows_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.report(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in rows.collect()}
    assert kept[1] > 0.995 and kept[0] < 0.2


def test_distances_against_the_formula(spark):
    p, q = np.array([3.0, 1.0, 0.0]), np.array([10.0, 20.0, 30.0])
    a, b = p / p.sum(), q / q.sum()
    kl = lambda x, y: sum(u * np.log2(u / v) for u, v in zip(x, y, strict=True) if u)
    want = np.sqrt((kl(a, (a + b) / 2) + kl(b, (a + b) / 2)) / 2)
    assert quality.distance(p[None, :], q)[0] == pytest.approx(want)


def test_common_words_are_exact(spark):
    """Of words spread over many partitions, those common in all and no others."""
    rows = [(i, " ".join(["alpha"] * 3 + [f"w{i}x{k}" for k in range(97)] + (["beta"] * 20 if i == 0 else [])), "l") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(12)
    found = quality.references(docs)
    h = textarrays.hashes(np.frombuffer(b"alpha", np.uint8), np.array([0]), np.array([5])).view(np.int64)
    beta = textarrays.hashes(np.frombuffer(b"beta", np.uint8), np.array([0]), np.array([4])).view(np.int64)
    total = 60 * 100 + 20
    assert set(found.words.tolist()) == {int(h[0]), int(beta[0])} and found.counts[0].sum() == total
    assert found.counts[0][found.words.tolist().index(int(h[0]))] == 180


def test_quality_of_a_rare_language(spark):
    """Clean documents of a language with few words beside another's are kept, with a reference of their own and without."""
    rng = np.random.default_rng(3)
    words = {k: ["".join(rng.choice(list(a), rng.integers(3, 9))) for _ in range(300)] for k, a in (("xx", "abcdefghijklmnopqrstuvwxyz"), ("ru", "абвгдежзиклмнопрстуфхцчшщыэюя"), ("el", "αβγδεζηθικλμνξοπρστυφχψω"))}
    langs = ["xx"] * 1000 + ["ru"] * 4 + ["el"]
    docs = [(i, " ".join(rng.choice(words[k], 400)), k) for i, k in enumerate(langs)]
    got = quality.report(spark.createDataFrame(docs, "doc_id long, text string, lang string")).filter("doc_id >= 1000").collect()
    assert len(got) == 5 and all(r["kept"] for r in got)


def test_quality_without_or_with_a_wrong_lang(spark):
    """Clean documents of scripts that have no reference are kept whatever lang they are said to have; junk in them isn't."""
    rng = np.random.default_rng(8)
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    words = lambda letters, n: ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(n)]
    said = lambda ws: ". ".join(" ".join(ws[k : k + 12]).capitalize() for k in range(0, len(ws), 12)) + "."
    clean, junk = [], []
    for letters in ("абвгдежзиклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "aáăâbcdđeêghiklmnoôơpqrstuưvxy"):
        clean += [said(words(letters, 60)) for _ in range(10)]
        junk += [" ".join(w + str(rng.choice(["***", "%%%", "$$$"])) for w in words(letters, 60)) for _ in range(10)]
    rows = [(1_000_000 + k, t, lang) for k, t in enumerate(clean) for lang in (None, "en", "zz")] + [(2_000_000 + k, t, lang) for k, t in enumerate(junk) for lang in (None, "en")]
    got = quality.report(known.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).filter("doc_id >= 1000000").collect()
    assert all(r["kept"] for r in got if r["doc_id"] < 2_000_000) and not any(r["kept"] for r in got if r["doc_id"] >= 2_000_000)


def test_quality_of_nothing(documents, nothing):
    assert quality.report(nothing).count() == 0
    kept = quality.accepted(documents)
    assert kept.columns == documents.columns and 0 < kept.count() < documents.count()
    assert quality.report(documents.withColumn("lang", F.lit(None).cast("string"))).count() == documents.count()


# --- language model ---


def test_language_model(documents, pairs):
    rows = ngram_lm.report(documents).collect()
    n, want = brute.unigram_scores(pairs)
    assert len(rows) == len(pairs)
    for r in rows:
        if r["doc_id"] is None:
            continue
        tokens, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_counts_are_sent_in_few_bytes():
    """Keys and counts of any size come back from their gaps and planes of bytes, in fewer bytes than keys of 8 and counts of 4."""
    rng = np.random.default_rng(12)
    keys = np.unique(np.concatenate([rng.integers(0, 2**64, 50_000, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
    counts = rng.integers(1, 3, len(keys))
    counts[::1000] = 1 << 40
    sums = ngram_lm.Sums()
    sums.add(keys, counts)
    sent = ngram_lm.packed(sums, 7)
    assert sent.nbytes < 8 * len(keys)
    got = [ngram_lm.unsent(k, c) for k, c in zip(sent["keys"].to_pylist(), sent["counts"].to_pylist(), strict=True)]
    assert np.array_equal(np.concatenate([k for k, _ in got]), keys) and np.array_equal(np.concatenate([c for _, c in got]), counts)
    assert ngram_lm.packed(ngram_lm.Sums(), 7).num_rows == 0


def test_trigrams_against_dictionaries(documents, pairs, monkeypatch):
    """Scores are those of the formula, but for the steps of the codes; some contexts are hot and some aren't, and all words are of the vocabulary."""
    monkeypatch.setattr(ngram_lm, "CLASS_SHARE", 1e-9)
    want, hot = brute.trigram_scores(pairs)
    assert 1 < len(hot) < 5000
    worst = mean = n = 0
    for r in ngram_lm.report(documents).filter("doc_id is not null").collect():
        off = (r["score"] - want[r["doc_id"]]) / r["n_tokens"]
        worst, mean, n = max(worst, abs(off)), mean + off * r["n_tokens"], n + r["n_tokens"]
    assert worst < 0.05 and abs(mean / n) < 0.01


def range_of(trigrams, hot=()):
    """A stored range of a dictionary of trigrams, read back, with the last words, ids and totals of its contexts."""
    rows = sorted((b, a, c, n) for (a, b, c), n in trigrams.items())
    sums = collections.Counter()
    for b, a, _, n in rows:
        sums[b, a] += n
    total = lambda b, a: float(sums[b, a]) if (b, a) in hot else -1.0
    b, a, c, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    model = ngram_lm.Range(b, a, c, n, np.array([total(*k) for k in zip(b, a, strict=True)]))
    return ngram_lm.restored(ngram_lm.stored(model)), sums, total


def test_probabilities_of_a_range_sum_to_one():
    rng = np.random.default_rng(3)
    trigrams = collections.Counter(map(tuple, rng.integers(0, [5, 4, 40], (900, 3)).tolist()))
    hot = {(b, a) for b in range(4) for a in range(5) if (a + b) % 3 == 0}
    model, _, total = range_of(trigrams, hot)
    low = np.log10(np.full(40, 1 / 40))
    for b in range(5):  # one more than there are
        for a in range(6):
            got = model.log10(np.array([b]), np.array([a]), np.array([total(b, a)]), np.zeros(40, np.int64), np.arange(40), low)
            assert (10**got).sum() == pytest.approx(1, abs=0.03)


def test_trigrams_of_a_range_by_their_places():
    """Third words are found by their places among those that follow the second, in a range that was stored; what wasn't learned gets the lower order."""
    rng = np.random.default_rng(4)
    trigrams = collections.Counter(map(tuple, (rng.zipf(1.3, (5000, 3)) % [300, 50, 1000] + 7).tolist()))
    hot = {(8, 8), (9, 8)}
    model, sums, total = range_of(trigrams, hot)
    after = collections.defaultdict(set)
    for (a, b, c), n in trigrams.items():
        if n >= ngram_lm.LEAST or (b, a) in hot:
            after[b].add(c)
    kept = {k: n for k, n in trigrams.items() if n >= ngram_lm.LEAST or (k[1], k[0]) in hot}
    assert model.words.ids.n == len(kept) > 300 and model.after.ids.n == sum(map(len, after.values()))
    places = np.diff(model.words.ids[np.arange(model.words.ids.n)], prepend=0)
    assert places.max() < max(map(len, after.values()))
    left = collections.Counter()
    for (a, b, _), n in trigrams.items():
        left[b, a] += n
    for (a, b, _), n in kept.items():
        left[b, a] -= n
    asked = [*trigrams, *((a, b, c + 1) for a, b, c in trigrams), (10**6, 8, 8), (8, 10**6, 8)]
    a, b, c = (np.array(x, np.int64) for x in zip(*asked, strict=True))
    got = model.log10(b, a, np.array([total(*k) for k in zip(b, a, strict=True)]), np.arange(len(a)), c, np.full(len(a), -3.0))
    for k, g in zip(asked, got, strict=True):
        t = sums[k[1], k[0]] + ngram_lm.MU
        assert g == pytest.approx(np.log10(kept.get(k, 0) / t + (left[k[1], k[0]] + ngram_lm.MU) / t * 1e-3), abs=0.02)


def test_stored_language_model(spark, documents, nothing, tmp_path):
    """A model that was written scores the documents it was learned from as report() does, and others that it has never seen."""
    documents.count()  # its size, and so the number of ranges, is known from here on
    ngram_lm.fit(documents, str(tmp_path / "model"))
    with pytest.raises(AnalysisException):
        ngram_lm.fit(documents, str(tmp_path / "model"))
    levels = [ngram_lm.restored(r[0]) for r in spark.read.parquet(str(tmp_path / "model/ranges")).select("levels").collect()]
    assert sum(t.words.ids.n for t in levels) > 1000 and sum(t.after.ids.n for t in levels) > 1000
    by_id = lambda rows: sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0] is None, *map(float, r[1:5]), r[0]))
    got, want = by_id(ngram_lm.score(documents, str(tmp_path / "model"))), by_id(ngram_lm.report(documents))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-6) for r in want]
    text = next(r["text"] for r in documents.filter("length(text) between 300 and 2000").orderBy("doc_id").collect())
    shuffled = " ".join(sorted(text.split()))
    second = spark.createDataFrame([(1, text, "x"), (2, shuffled, "x"), (3, None, "x"), (4, "nieseen", "x")], "doc_id int, text string, score string")
    rows = {r["doc_id"]: r for r in ngram_lm.score(second, str(tmp_path / "model")).collect()}
    assert rows[1]["base_score"] == pytest.approx(rows[2]["base_score"]) and rows[1]["score"] > rows[2]["score"] + 10
    assert (rows[3]["n_tokens"], rows[4]["n_tokens"], rows[4]["n_known"]) == (1, 2, 1)
    ngram_lm.fit(nothing, str(tmp_path / "empty"))
    assert ngram_lm.score(nothing, str(tmp_path / "empty")).count() == 0
    assert {r["train_tokens"] for r in ngram_lm.score(second, str(tmp_path / "empty")).collect()} == {0}


def test_language_model_of_nothing(documents, nothing):
    assert ngram_lm.report(nothing).count() == 0
    untrained = documents.filter("doc_id is null")
    assert [r["train_tokens"] for r in ngram_lm.report(untrained).collect()] == [0, 0]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in [(0, 0), (1, 0), (1, 10**6), (1000, 50), (1000, 10**9), (5000, 5000)]:
        v = np.sort(rng.integers(0, top + 1, n))
        assert (ngram_lm.EliasFano(v)[np.arange(n)] == v).all()


def test_trie_against_dictionaries():
    """The trie's probabilities are those of the formula, within the steps of its codes, and sum to one."""
    rng = np.random.default_rng(1)
    n = 30
    seq = rng.integers(2, n, 4000) * (rng.random(4000) < 0.7) + 2 * 1
    seq = np.clip(seq, 1, n - 1)
    uni = np.bincount(seq, minlength=n).astype(np.int64)
    uni[0] = 1
    two = collections.Counter(zip(seq.tolist(), seq[1:].tolist(), strict=False))
    three = collections.Counter(zip(seq.tolist(), seq[1:].tolist(), seq[2:].tolist(), strict=False))
    two = {k: c for k, c in two.items() if c >= 2}
    three = {k: c for k, c in three.items() if c >= 2}
    key = lambda order, a, b, c: (order << 60) | (a << 40) | (b << 20) | c
    grams = np.array([key(2, 0, *k) for k in two] + [key(3, *k) for k in three], np.int64)
    trie = ngram_lm.Trie(uni, grams, np.array([*two.values(), *three.values()], np.int64))
    trie = ngram_lm.restored(ngram_lm.stored(trie))
    for (b, c), count in list(two.items())[:50]:
        want = np.log10((count - ngram_lm.DISCOUNT) / uni[b])
        assert trie.log10(np.array([-1]), np.array([b]), np.array([c]))[0] == pytest.approx(want, abs=0.02)
    for (a, b, c), count in list(three.items())[:50]:
        want = np.log10((count - ngram_lm.DISCOUNT) / two[a, b])
        assert trie.log10(np.array([a]), np.array([b]), np.array([c]))[0] == pytest.approx(want, abs=0.02)
    every = np.arange(1, n)
    for a, b in [(-1, 3), (3, 4), (5, 2)]:
        assert (10 ** trie.log10(np.full(n - 1, a), np.full(n - 1, b), every)).sum() == pytest.approx(1, abs=0.05)


# --- chat ---


def test_chat_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    got = chat.report(spark.read.parquet(f"{DATA}/conversations.parquet")).toPandas()
    want = con.execute(chat.ORACLE).df()
    assert ordered(got[sorted(got)].values.tolist()) == ordered(want[sorted(want)].values.tolist())


def test_chat_edges(spark):
    texts = [None, "", "<|im_end|>", r"<\|im_start|>", r"<\\|x <| <\| |<|", "é<", "|"]
    rows = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(texts)]
    rows += [(2, None, None, "first"), (2, 0, "odd\nrole <|", "x"), (2, 0, "assistant", "tie"), (None, 1, "user", "a"), (3, 1, "user", "u"), (3, 1, "user", "u"), (4, 0, "user", "u"), (4, 1, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    found = {r["conv_id"]: r for r in chat.formatted(turns).withColumn("back", chat.read_back(F.col("text"))).collect()}
    assert [(t["role"], t["text"]) for t in found[1]["back"]] == [(["user", "assistant"][k % 2], t or "") for k, t in enumerate(texts)]
    assert [(t["role"], t["text"]) for t in found[2]["back"]] == [("", "first"), ("assistant", "tie"), ("odd\nrole <|", "x")]
    assert len(found[3]["back"]) == 2 and not found[3]["allowed"] and found[3]["refused"] == 1
    assert found[4]["allowed"] and [s["text"] for s in found[4]["segments"] if s["loss"]] == ["a"]
    assert found[1]["text"].count("<|") == 2 * len(texts)
    assert chat.report(turns.filter("false")).count() == 1


# --- secrets ---


def test_secrets(spark, documents, pairs, tmp_path):
    rows = secrets.report(documents).collect()
    got = ordered((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows)
    want = []
    for doc, text in pairs:
        counts, joined = brute.spans(text, brute.SECRETS)
        want.append((doc, *counts, brute.sha(joined)))
    assert got == ordered(want)


def test_ledger_is_incremental(spark, documents, tmp_path):
    path = str(tmp_path / "ledger")
    half = documents.filter("doc_id % 2 = 0")
    secrets.scan(half, path)
    before = spark.read.parquet(path).count()
    secrets.scan(half, path)
    assert spark.read.parquet(path).count() == before
    secrets.scan(documents, path)
    after = spark.read.parquet(path)
    assert after.count() == after.select("blob", "rule_version").distinct().count() == documents.select(F.coalesce("text", F.lit(""))).distinct().count()
    secrets.scan(half, path, "2")
    assert spark.read.parquet(path).filter("rule_version = '2'").count() == before


def test_redaction(spark, documents):
    docs = documents.select(*COLUMNS)
    out = secrets.redacted(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert secrets.report(out).filter("n_hex > 0 or n_access > 0 or n_assign > 0").count() == 0
    changed = out.join(docs.withColumnRenamed("text", "old"), "doc_id").filter("text <> old")
    assert changed.filter("not text like '%[secret]%'").count() == 0
    assert secrets.find("x ghp_" + "a1" * 20)[0]["kind"] == "github"


def test_secrets_of_nothing_and_beside_other_columns(spark, nothing):
    assert secrets.report(nothing).count() == 0 and secrets.redacted(nothing).count() == 0
    docs = spark.createDataFrame([(1, "token: abcdef12 x", 7, "b", 17), (None, None, None, None, None), (1, "token: abcdef12 x", 7, "b", 17)], "doc_id long, text string, findings int, BLOB string, n_chars long")
    assert ordered(tuple(r) for r in secrets.redacted(docs).collect()) == ordered([(1, "[secret] x", 7, "b", 10)] * 2 + [(None, None, None, None, None)])


def test_texts_without_a_ledger_stay_where_they_are(spark, documents, tmp_path, monkeypatch):
    plans = []
    write = type(documents).dropDuplicates
    monkeypatch.setattr(type(documents), "dropDuplicates", lambda self, *a: plans.append(self) or write(self, *a))
    secrets.scan(documents, str(tmp_path / "ledger"))
    assert "Exchange" not in plans[0]._jdf.queryExecution().executedPlan().toString()


# --- personal data ---

PERSONAL = [
    "a@b.c_d@e.f x@y.z@q.r 1.2.3.4.5.6.7.8 300.1.2.3.4.5 00001.002.3.255 0256.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111, 4111  1111 1 2 3 4 5 6 7 8 9 0 1 2\x01 3 4+12 (345) 678-9012 +1+2 345678901",
    "é @a.b 4111111111111111" * 2 + " 4111111111111111x 12-4111111111111111",
    "1 " * 3000 + "a.b@" * 2000 + "a" * 50_000 + " a@" + "b.c" * 3000 + " +" + "1-" * 5000 + "1",
    "\x01 1\x011 1 \x024111 1111 1111 1111\x02",
]


def test_personal_data(spark, documents, pairs):
    more = [(200_000 + k, t) for k, t in enumerate(PERSONAL)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = pii.report(docs).collect()
    got = ordered((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows)
    want = []
    for doc, text in pairs + more:
        counts, joined = brute.spans(text, brute.PERSONAL)
        want.append((doc, *counts, brute.sha(joined)))
    assert got == ordered(want)


def test_trees_add_what_context_speaks_for(spark):
    rows = [(1, "my ssn is 123-45-6789 ok"), (2, "order 123-45-6789"), (3, "call 415-555-1234 now"), (4, "invoice 415.555.1234")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "national_id:10:21", 2: "", 3: "local_phone:5:17", 4: ""}
    assert {r["doc_id"]: r["text"] for r in pii.redacted(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()} == {1: "my ssn is [national_id] ok"}


def test_personal_data_of_other_wordings(spark):
    """Precision and recall on sentences that the training rule doesn't make; numbers with the right or a wrong check digit, overlaps, dates and prices."""
    yes = [
        "iban: NL91ABNA0417164300", "Send the rent to FR1420041010050500013M02606, please", "DE89370400440532013000 is my IBAN", "GB82 WEST 1234 5698 7654 32 belongs to her",
        "telephone number 415-555-1234", "reach me at 415-555-1234", "Her mobile (changed in May): (212) 736-5000", "For a table, call 646.555.0199 before noon", "fax 303 555 0111", "Ruf uns an, Telefon 415-555-2671",
        "Social security 219-09-9999 was on the form", "Passport or SSN? I wrote 457-55-5462", "identity check for 321-54-9876 passed", "tax number 509-21-7777 of the widow",
    ]
    no = [
        "iban DE00000000000000000000", "account NL91ABNA0417164301 was refused", "order 415-555-1234 has left", "catalogue item 303.555.0111", "The build 646-555-0199 broke", "invoice 219-09-9999 of June",
        "lot 457-55-5462, 12 boxes", "On 2024-05-17 at 10.30 it cost 1,299.00", "pages 100-120 and 230-245", "version 10.20.3000", "tracking 212 736 5000 shipped", "serial 509-21-7777",
    ]
    rows = [(i, t) for i, t in enumerate(yes + no)]
    got = {r["doc_id"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).filter("spans <> ''").collect()}
    right = len([i for i in got if i < len(yes)])
    assert right >= 0.9 * len(yes) and right >= 0.9 * len(got)


def test_wordings_of_training_are_not_the_cues():
    """Fewer than a third of the wordings have a word of the features' lists for and against."""
    cue = regex.compile(rf"(?<!\pL)(?:{'|'.join(pii.CUES.values())})(?!\pL)")
    wordings = [w for k in pii.SPEAKING.values() for w in k] + pii.AGAINST + pii.NEUTRAL
    assert 3 * len([w for w in wordings if cue.search(w.lower())]) < len(wordings)


def test_personal_data_without_cues(spark):
    """Sentences that no wording makes, those that are personal without a word of the lists: most are found, of numbers of things one at most."""
    yes = [
        "whatsapp 415-555-1234", "her number: 415-555-1234", "he is at (212) 867-5309", "You will find me under (415) 555-1234", "the employee record lists 219-09-9999",
        "Send a note to (646) 736-5000", "Grandma picks up at 303-555-0199", "Mr. Jones wants a reply, 212-736-5000", "The driver showed 457-55-5462 at the gate", "Sarah Connor's is 321-54-9876",
        "Her son was given 509-21-7777 at birth", "Mary, 718-555-0123, will pick you up", "I can be found at 212.736.5001",
    ]
    no = [
        "order 415-555-1234 has left", "catalogue item 303.555.0111", "The build 646-555-0199 broke", "invoice 219-09-9999 of June", "lot 457-55-5462, 12 boxes", "On 2024-05-17 at 10.30 it cost 1,299.00",
        "version 10.20.3000", "tracking 212 736 5000 shipped", "serial 509-21-7777", "The valve 415-555-1234 leaks", "QC 303-555-0111 failed", "300 400 5000 people came", "we sold 212 736 5000 of them",
        "the price rose to 219.736.5000 yen", "SKU#457-55-5462", "file 219-09-9999.pdf", "consignment 321-54-9876", "WO 646-555-0199",
    ]
    rows = [(i, t) for i, t in enumerate(yes + no)]
    got = {r["doc_id"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).filter("spans <> ''").collect()}
    assert len([i for i in got if i < len(yes)]) >= 8 and len([i for i in got if i >= len(yes)]) <= 1


def test_overlaps_of_personal_data(spark):
    """Spans that cross a base span go; of others the one of the highest score stays."""
    rows = [(1, "call +1 (415) 555-1234 now"), (2, "IBAN DE89 3704 0044 0532 0130 00 or call 415-555-1234")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "phone:5:22", 2: "iban:5:32,local_phone:41:53"}


def test_personal_data_beside_other_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.co", "x"), (None, None, "y")], "doc_id long, text string, spans string").withColumn("scored", F.lit(1))
    assert ordered((r["doc_id"], r["spans"]) for r in pii.report(docs).collect()) == [(1, "email:0:6"), (None, "")]


def test_trees_as_columns(spark):
    trees, _ = pii.model(spark)
    x = np.random.default_rng(0).integers(0, 12, (200, len(pii.FEATURES)))
    frame = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)], "i int, " + ", ".join(f"{f} int" for f in pii.FEATURES))
    got = [r[0] for r in frame.orderBy("i").select(trees.column([F.col(f) for f in pii.FEATURES])).collect()]
    assert np.allclose(got, trees.scores(x))


def test_personal_data_stays_in_sql(nothing):
    assert pii.report(nothing).count() == 0
    plan = pii.report(nothing)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- near duplicates ---


def test_near_duplicates(documents, pairs):
    rows = minhash.annotate(documents).collect()
    want = brute.components(pairs)
    assert len(rows) == len(pairs)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert ordered(r["n_shingles"] for r in rows) == ordered(len(brute.shingles(t)) for _, t in pairs)


def test_near_duplicates_of_edited_texts(spark):
    """Chains and stars of edited copies around the limit, in groups larger than a small bucket."""
    rng = np.random.default_rng(5)
    docs = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(120)]
        for c in range(60):
            text = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 7)):
                text[at] = f"e{rng.integers(10**9)}"
            docs.append((len(docs), " ".join(text)))
            if c % 9 == 0:
                base = text
    got = {r["doc_id"]: r["component_id"] for r in minhash.annotate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.components(docs)


@pytest.mark.parametrize("block", [minhash.BLOCK, 20_000])
def test_near_duplicates_far_from_the_best_of_their_bucket(spark, monkeypatch, block):
    """Texts whose only link is to one of many copies, in large buckets of their common original, with few drawn members: 5 are lost without the queries; blocks of one and of several to a group."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "DRAWS", 1)
    rng = np.random.default_rng(11)

    def edited(text, edits):
        text = list(text)
        for at in rng.choice(len(text), edits, replace=False):
            text[at] = f"e{rng.integers(10**12)}"
        return text

    base = [f"w{k}" for k in range(400)]
    docs = [edited(base, rng.integers(1, 4)) for _ in range(300)]
    for _ in range(30):
        some = edited(base, 1)
        docs += [some, edited(some, 11)]
    docs = [(i, " ".join(t)) for i, t in enumerate(docs)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.annotate(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()}
    assert got == brute.components(docs)


def test_deduplicated(documents, nothing):
    docs = documents.select(*COLUMNS)
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(100_006) == 0 and ids.count(100_005) == 1 and ids.count(None) == 2 and len(set(ids)) == len(ids) - 1
    assert minhash.annotate(nothing).count() == 0 and minhash.deduplicated(nothing).count() == 0


# --- passages ---


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, least = int(rng.integers(0, 60)), int(rng.integers(1, 9))
        bounds = np.concatenate([[0], np.sort(rng.integers(0, n + 1, 2)), [n]])
        v = rng.integers(0, 30, n).astype(np.uint64)
        want = set()

        def tree(low, high, v=v, least=least, want=want):
            if high - low + 1 >= least:
                m = low + int(np.argmin(v[low : high + 1]))
                want.add((low, m, high))
                tree(low, m - 1)
                tree(m + 1, high)

        for i in range(3):
            tree(bounds[i], bounds[i + 1] - 1)
        assert set(zip(*[x.tolist() for x in substrings.compact_windows(v, bounds, least)], strict=True)) == want


def test_compact_windows_climbed_no_higher_than_needed():
    """Where windows of the least length start is known from what is near, of long texts with equal hashes too."""
    rng = np.random.default_rng(12)
    least = 9
    bounds = np.array([0, 700, 705, 2000])
    for v in (rng.integers(0, 60, 2000), np.arange(2000), np.arange(2000)[::-1], np.zeros(2000, int)):
        l, m, r = substrings.compact_windows(v.astype(np.uint64), bounds, least)
        near = substrings.compact_windows(v.astype(np.uint64), bounds, least, far=least)
        assert near[1].tolist() == m.tolist() and (near[0] >= l).all() and (near[2] <= r).all()
        assert np.maximum(near[0], m - least + 1).tolist() == np.maximum(l, m - least + 1).tolist()
        assert np.minimum(m, near[2] - least + 1).tolist() == np.minimum(m, r - least + 1).tolist()


def test_windows_alone_with_their_key_go_first():
    """Of keys that several documents have, all windows stay, in order."""
    rng = np.random.default_rng(13)
    for n, keys in ((0, 1), (1, 1), (400, 50), (400, 10**6), (5000, 2**32)):
        windows = np.zeros(n, substrings.WINDOW)
        windows["key"], windows["doc"], windows["m"] = rng.integers(0, keys, n), rng.integers(0, 9, n), rng.permutation(n)
        docs_of = collections.defaultdict(set)
        for k, d in zip(windows["key"].tolist(), windows["doc"].tolist(), strict=True):
            docs_of[k].add(d)
        want = sorted(w[:3] for w in windows.tolist() if len(docs_of[w[0]]) > 1)
        got, bounds = substrings.grouped(windows)
        assert [w[:3] for w in got.tolist()] == want
        assert [got["key"][a] for a in bounds[:-1]] == sorted({w[0] for w in want}) and bounds[-1] == len(got)
    # most windows go before the rest are sorted
    few = substrings.among(np.arange(10**5, dtype=np.uint32), np.arange(0, 10**5, 1000, dtype=np.uint32))
    assert few[::1000].all() and few.sum() < 10**4


def test_few_places_are_compared_without_an_index(monkeypatch):
    """Groups of few places, which are most, need no table of all shingles, and give what the index gives."""
    rng = np.random.default_rng(14)
    groups = []
    for n in (2, 3, 8, 40):
        group = np.zeros(n, substrings.PLACE)
        group["doc"] = group["other"] = np.arange(n)
        kinds = rng.integers(1, 2**16, (n // 2 + 1, substrings.AROUND), dtype=np.uint16)
        group["around"] = kinds[rng.integers(0, len(kinds), n)]
        group["around"][:, :20] = rng.integers(1, 2**16, (n, 20), dtype=np.uint16)
        groups.append(group)
    pairs = lambda: [sorted(zip(*[x.tolist() for x in substrings.elected(g)], strict=True)) for g in groups]
    monkeypatch.setattr(substrings, "FEW", -1, raising=False)
    want = pairs()
    monkeypatch.undo()
    monkeypatch.setattr(substrings, "rare", lambda shingles: pytest.fail("an index of few places"))
    assert pairs() == want and any(want)


def test_keys_of_passages():
    """Each overlap of the intervals of both trees of a band has a key, of the least shingles of all windows of the least length in it."""
    rng = np.random.default_rng(3)
    bounds = np.array([0, 150, 160, 420])
    g = rng.integers(0, 2**63, 420).astype(np.uint64)
    g[200:260] = g[200:210].repeat(6)
    keys, at = substrings.joined_windows(g, bounds)
    want = []
    for band in range(substrings.BANDS):
        values = [(g ^ textarrays.salt(1 << 21 | f)) * (textarrays.salt(1 << 22 | f) | np.uint64(1)) for f in (2 * band, 2 * band + 1)]
        before = None
        for s in [*range(150 - substrings.LENGTH + 1), *range(160, 420 - substrings.LENGTH + 1)]:
            least = (s >= 160, *[s + int(np.argmin(v[s : s + substrings.LENGTH])) for v in values])
            if least != before:
                want.append(least[1:])
            before = least
    assert at.tolist() == [m for m, _ in want]
    of = dict(zip(keys.tolist(), [(g[m], g[n]) for m, n in want], strict=True))
    assert len(of) == len(set(keys.tolist())) and all(of[k] == (g[m], g[n]) for k, (m, n) in zip(keys.tolist(), want, strict=True))


def test_passages(documents, pairs, nothing):
    got = substrings.find(documents).collect()
    text = {i: brute.words(t) for i, t in pairs if i is not None}
    holders = collections.defaultdict(set)
    for i, w in text.items():
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    covered = collections.defaultdict(set)
    for r in got:
        s = {tuple(text[r["doc_id"]][k : k + 5]) for k in range(r["start"], r["end"] - 4)}
        t = {tuple(text[r["other_id"]][k : k + 5]) for k in range(r["other_start"], r["other_end"] - 4)}
        assert r["end"] - r["start"] >= 50 and r["other_id"] < r["doc_id"] and 100 * len(s & t) >= 75 * len(s | t)
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
        covered[r["other_id"]].update(range(r["other_start"], r["other_end"]))
    for i, w in text.items():
        for k in range(len(w) - 49):
            if len(holders[tuple(w[k : k + 50])]) > 1:
                assert set(range(k, k + 50)) <= covered[i]
    assert substrings.find(nothing).count() == 0


def test_edited_passages(spark):
    rng = np.random.default_rng(2)
    passage = [f"p{k}" for k in range(90)]
    edited = [w if k % 40 else f"x{k}" for k, w in enumerate(passage)]
    noise = lambda n: [f"n{rng.integers(10**9)}" for _ in range(n)]
    docs = [(1, " ".join(noise(100) + passage + noise(70))), (2, " ".join(noise(30) + edited + noise(200))), (3, " ".join(noise(300)))]
    got = substrings.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(2, 1)}


def edited(words, rng, n):
    """So many edits at places drawn: words replaced, inserted or left out."""
    out = list(words)
    for at in sorted(rng.choice(len(words), n, replace=False).tolist(), reverse=True):
        kind = rng.integers(3)
        out[at : at + (kind != 1)] = [f"e{rng.integers(10**9)}"] if kind < 2 else []
    return out


def test_passages_with_insertions_and_deletions(spark):
    """Passages whose shingle sets have a similarity of 75 % or more are found, whatever the edits."""
    rng = np.random.default_rng(7)
    noise = lambda n: [f"n{rng.integers(10**9)}" for _ in range(n)]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    docs, planted = [], {}
    while len(planted) < 150:
        i = 2 * len(planted)
        whole = noise(int(rng.integers(52, 140)))
        other = edited(whole, rng, int(rng.integers(0, len(whole) // 17 + 1)))
        s, t = shingles(whole), shingles(other)
        if len(other) >= 50 and 100 * len(s & t) >= 75 * len(s | t):
            docs += [(i, " ".join(noise(60) + whole + noise(60))), (i + 1, " ".join(noise(90) + other + noise(20)))]
            planted[i] = len(s & t) / len(s | t)
    got = {(r["other_id"], r["doc_id"]) for r in substrings.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got <= {(i, i + 1) for i in planted}
    assert len(got) >= 0.95 * len(planted) and min(planted.values()) < 0.8
    # one inserted word in the middle of 90
    docs = []
    for i in range(0, 60, 2):
        w = noise(90)
        docs += [(i, " ".join(noise(40) + w + noise(40))), (i + 1, " ".join(noise(10) + w[:45] + ["x"] + w[45:] + noise(10)))]
    assert substrings.find(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id").distinct().count() == 30


def test_copies_and_links_of_passages(spark):
    """Equal texts of a task are copies of one; an edited one's place is found though its leader is unlike it."""
    rng = np.random.default_rng(8)
    w = [f"w{rng.integers(10**9)}" for _ in range(60)]
    rows = [(i, " ".join(w)) for i in range(30)] + [(30, " ".join(w + ["end"])), (31, " ".join(w[:49]))]
    got = substrings.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {i for r in got for i in (r["doc_id"], r["other_id"])} == set(range(31))
    assert all((r["start"], r["end"], r["other_start"], r["other_end"]) == (0, 60, 0, 60) for r in got)


def test_passages_of_few_after_a_frequent_line(spark):
    """A line of 45 words that all documents have comes before all; each passage it is a part of only two documents share."""
    line = [f"l{k}" for k in range(45)]
    docs = [(i, " ".join([f"a{i}_{k}" for k in range(60)] + line + [f"t{i // 2}_{k}" for k in range(6)] + [f"b{i}_{k}" for k in range(60)])) for i in range(80)]
    got = substrings.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")).collect()
    assert {(2 * i + 1, 2 * i, 60, 111) for i in range(40)} <= {(r["doc_id"], r["other_id"], r["start"], r["end"]) for r in got}


def test_classes_of_passages(spark):
    """A group's rows name some pairs, its class all documents; passages of one text that don't meet are apart."""
    rng = np.random.default_rng(9)
    noise = lambda n: [f"n{rng.integers(10**9)}" for _ in range(n)]
    one, two = noise(60), noise(70)
    docs = [(i, " ".join(noise(40) + one + noise(30))) for i in range(12)] + [(i, " ".join(noise(20) + two + noise(30))) for i in range(20, 23)]
    docs += [(30, " ".join(noise(25) + two + noise(30) + one + noise(5)))]
    got = substrings.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    of = collections.defaultdict(set)
    for r in got:
        of[r["class_doc"], r["class_start"], r["class_docs"]] |= {r["doc_id"], r["other_id"]}
    assert of == {(0, 40, 13): {*range(12), 30}, (20, 20, 4): {20, 21, 22, 30}}


def test_passages_of_groups_of_all_sizes(spark):
    """What documents share is said alike, whether a few or many more have it too."""
    rng = np.random.default_rng(10)
    noise = lambda n: [f"n{rng.integers(10**9)}" for _ in range(n)]
    passage = noise(60)
    docs = [(i, " ".join(noise(40) + passage + noise(30))) for i in range(12)]
    few, many = (substrings.find(spark.createDataFrame(docs[:n], "doc_id long, text string")).drop("class_docs").collect() for n in (5, 12))
    assert set(few) == {r for r in many if r["doc_id"] < 5}
    assert {r["doc_id"] for r in many} == set(range(1, 12)) and {(r["class_doc"], r["class_start"]) for r in many} == {(0, 40)}


def test_places_are_connected_across_their_parts():
    """Windows that have passages already are connected with others that only they are alike."""
    rng = np.random.default_rng(11)
    half = substrings.LENGTH - 1
    x, y, z = rng.integers(1, 2**16, (3, half), dtype=np.uint16)
    group = np.zeros(4, substrings.PLACE)
    group["doc"] = group["other"] = np.arange(4)
    around = lambda a, b: np.concatenate([a, [7], b])
    noise = lambda: rng.integers(1, 2**16, half, dtype=np.uint16)
    # 0 and 1 have a passage; 3 has one with 2, which has another one with 1
    for i, (a, b) in enumerate(((noise(), x), (y, x), (y, z), (noise(), z))):
        group["around"][i] = around(a, b)
    group["part"][:2] = 5
    got = {tuple(sorted(p)) for p in zip(*[p.tolist() for p in substrings.elected(group)], strict=True)}
    assert {(1, 2), (2, 3)} <= got <= {(0, 1), (1, 2), (2, 3)}


def test_leaders_leave_no_pair_out():
    """Each place that has a passage with others of its group is paired with one of them, whatever leads."""
    rng = np.random.default_rng(5)
    common = rng.integers(1, 2**16, substrings.AROUND, dtype=np.uint16)
    kinds = rng.integers(1, 2**16, (30, substrings.AROUND), dtype=np.uint16)
    kinds[:, 25:62] = common[25:62]
    group = np.zeros(200, substrings.PLACE)
    group["doc"] = np.arange(200)
    kinds[:10, 15:25] = kinds[:10, 15:16]
    group["around"] = rng.integers(1, 2**16, (200, substrings.AROUND), dtype=np.uint16)
    group["around"][:, 25:62] = common[25:62]
    of = rng.integers(0, 60, 200)
    for i in np.flatnonzero(of < 30):
        group["around"][i, 15:70] = kinds[of[i], 15:70]
    got = {tuple(sorted(p)) for p in zip(*[x.tolist() for x in substrings.elected(group)], strict=True)}
    for i in range(200):
        others = [j for j in range(200) if j != i and of[j] == of[i] < 30]
        assert not others or any(tuple(sorted((i, j))) in got for j in others)
    assert len(got) < 400


# --- language identification ---


def test_languages(spark, documents, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    odd = {r["doc_id"]: r for r in langid.report(documents).filter("doc_id > 100000").collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (100_001, 100_002, 100_003))
    assert odd[100_004]["lang_pred"] in ("en", "de", "fr", "es")
    assert langid.report(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.report(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_letters():
    texts = ["", "12 !", "x", "日本", "— …", "١٢", "é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    rows = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    assert langid.has_letter(data, rows).tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_a_place_is_compared_with_a_large_class_no_further_than_needed(monkeypatch):
    """Places in no passage yet, alike with a large class but not with each other, meet two places of it and aren't compared with all."""
    from plumeline.llm import substrings

    rng = np.random.default_rng(4)
    group = np.zeros(1200, substrings.PLACE)
    group["doc"] = group["other"] = np.arange(1200)
    group["part"] = 1
    group["around"] = rng.integers(1, 1 << 16, substrings.AROUND)
    alone = np.arange(5, 1200, 200)
    for k, i in enumerate(alone):  # each has another stretch of a passage's length in common with the class
        own = rng.integers(1, 1 << 16, substrings.AROUND)
        own[8 * k : 8 * k + substrings.LENGTH] = group["around"][0, 8 * k : 8 * k + substrings.LENGTH]
        group["around"][i], group["part"][i] = own, 0
    asked, whole = [], substrings.alike
    monkeypatch.setattr(substrings, "alike", lambda lead, rest: asked.append(len(rest)) or whole(lead, rest))
    a, b = substrings.elected(group)
    assert sum(asked) < 2 * len(group)
    pairs = set(zip(a.tolist(), b.tolist(), strict=True))
    assert {(i, j) for i in alone[:1].tolist() for j in (0, 1)} <= pairs and {i for i, _ in pairs} | {j for _, j in pairs} >= set(alone.tolist())
