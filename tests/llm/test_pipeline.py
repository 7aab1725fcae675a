import pathlib

import __spark_entry__
import corpus_pipeline
from plumeline.llm import minhash, packing, quality
from plumeline.llm.common import table
from tests.llm import brute
from tests.llm.conftest import DATA


def test_stages(spark, tmp_path):
    """Each stage over what the one before kept, against plain versions."""
    docs = table(spark, DATA, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "sequence_packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = before, docs
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    pairs = lambda d: [tuple(r) for r in d.select("doc_id", "text").collect()]
    before, after = kept["quality_rules"]
    assert ids(after) == ids(quality.report(before).filter("kept"))
    before, after = kept["near_duplicates"]
    assert ids(after) == {i for i, c in brute.components(pairs(before)).items() if i == c} == ids(minhash.annotate(before).filter("kept"))
    before, after = kept["benchmark_decontamination"]
    items = [tuple(r) for r in table(spark, DATA, "benchmark").collect()]
    assert ids(after) == {r[0] for r in brute.contamination(pairs(before), items) if not r[-1]}
    before, after = kept["secret_scan"]
    clean = {i: t for i, t in pairs(before) if not brute.spans(t, brute.SECRETS)[1]}
    got = dict(pairs(after))
    assert set(got) == ids(before) and all(got[i] == t for i, t in clean.items())
    assert not any(brute.spans(t, brute.SECRETS)[1] for t in got.values())
    before, after = kept["sequence_packing"]
    assert ids(after) == ids(before) and after.agg({"length": "sum"}).first()[0] == packing.pack(before, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).agg({"length": "sum"}).first()[0]


def test_stages_of_odd_rows(spark):
    """Nulls, repeated and long rows, other columns named like results, and nothing at all pass through every stage."""
    long = " ".join(f"word{k % 997}" for k in range(30_000))
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "", 0), (7, long, "en", "a", len(long)), (7, long, "en", "a", len(long)), (8, "x", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = table(spark, DATA, "documents").unionByName(odd).selectExpr("*", "1 as kept", "2 as KEY", "3 as quality", "4 as findings", "'b' as blob", "5 as contamination", "6 as gone", "7 as digest")
    for frame in (docs, docs.filter("false")):
        rows = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, DATA)
            if name != "sequence_packing":
                assert out.columns == docs.columns
            rows = spark.createDataFrame(out.collect(), out.schema)
        assert rows.isEmpty() == frame.isEmpty()
        assert frame.isEmpty() or rows.filter("doc_id = 7").select("doc_tokens").distinct().count() == 1


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    assert not list(folder.glob("**/pipeline-*")) and not list(folder.glob("**/secret-ledger-*"))


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
