"""Secret scans with an incremental blob ledger.

Every text is content-addressed (a blob, by SHA-256), whatever document or version
of it holds it. The ledger is a Parquet table of what each rule version found in
each blob. A scan reads the blobs that the ledger hasn't seen under its rule version,
appends what it finds to the ledger, and joins the ledger's findings back to all
documents. A second scan with the same rules scans new blobs only.

Without anything in the ledger texts stay where they are: each task scans its own
different blobs, and only digests and findings are shuffled. Otherwise digests alone meet
the ledger, and texts are moved (if the new digests are too many for a broadcast) only to
leave out those that it has. A blob that a third of the documents hold is scanned once by
each task that has it; a lost task scans its blobs again; a blob that is in the ledger
twice counts once.

Nulls and edge cases: a null text is the empty blob; a null doc_id keeps its findings;
repeated documents share a blob and each gets its findings; an empty table gives an
empty ledger; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, fresh, small_batches, texts

#: Raise it with every change of the rules.
RULE_VERSION = "1"

#: Kinds in their order, each with its pattern, the group and the fewest characters of it that count.
ASSIGN = re.compile(
    "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
RULES: tuple[tuple[str, re.Pattern, int, int], ...] = (
    ("assign", ASSIGN, 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
    ("private_key", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), 0, 1),
    ("github", re.compile(r"gh[oprsu]_[A-Za-z0-9]{36,}"), 0, 1),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
)
BASE = ("assign", "access", "hex")
#: A text without these letters (lower-cased for the first kind) has no match of a kind.
HINTS: dict[str, tuple[str, ...]] = {"assign": ("passw", "secret", "token", "api"), "access": ("AKIA",), "private_key": ("-----BEGIN",), "github": ("gh",), "slack": ("xox",), "jwt": ("eyJ",)}

FINDINGS = "array<struct<kind: string, start: int, end: int>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def find(text: str) -> list[dict]:
    """Spans of all kinds by start, then kind; code points, end exclusive."""
    found, low = [], text.lower()
    for order, (kind, pattern, group, least) in enumerate(RULES):
        hints = HINTS.get(kind)
        if hints and not any(h in (low if kind == "assign" else text) for h in hints):
            continue
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(found)]


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(docs: DataFrame, path: str) -> DataFrame | None:
    try:
        return docs.sparkSession.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def scan(docs: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """Scans the blobs of `docs` that the ledger hasn't seen under this rule version, appends them, and gives the ledger's rows of this version."""
    small_batches(docs.sparkSession)
    contents = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts_ = batch.column(0)
            keys = [hashlib.sha256(t.as_buffer()).digest() for t in texts_]
            new = []
            for key in keys:
                new.append(key not in seen)
                seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), texts_], names=["blob", "text"]).filter(pa.array(new, pa.bool_()))

    blobs = contents.mapInArrow(distinct, "blob binary, text string")
    ledger = read_ledger(docs, ledger_path)
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct()
        new = contents.select(blob(F.col("text")).alias("blob")).distinct().join(known, "blob", "left_anti")
        blobs = blobs.join(new, "blob", "left_semi")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rule_version] * len(found), pa.string()), pa.array(found, pa.list_(SPAN))], names=["blob", "rule_version", "findings"])

    found = blobs.mapInArrow(scanned, f"blob binary, rule_version string, findings {FINDINGS}")
    found.dropDuplicates(["blob"]).write.mode("append").parquet(ledger_path)
    return docs.sparkSession.read.parquet(ledger_path).filter(F.col("rule_version") == rule_version)


def annotate(docs: DataFrame, ledger_path: str | None = None, rule_version: str = RULE_VERSION, text_col: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    """`docs` with one more column, and its name: the findings in each document's text. Without a ledger's path, one is made in the shared folder for this scan alone."""
    name, key = fresh("findings", docs.columns), fresh("blob", docs.columns)
    found_in = lambda ledger: ledger.filter(F.size("findings") > 0).dropDuplicates(["blob"]).select(F.col("blob").alias(key), F.col("findings").alias(name))
    if ledger_path:
        found = found_in(scan(docs, ledger_path, rule_version, text_col))
    else:
        with Scratch(docs.sparkSession, "secret-ledger") as keep:
            found = cut(found_in(scan(docs, keep.path, rule_version, text_col)))
    paths = docs.withColumn(key, blob(F.col(f"`{text_col}`").cast("string")))
    if not keep_text:
        paths = paths.drop(text_col)
    got = paths.join(found, key, "left").drop(key)
    return got.withColumn(name, F.coalesce(name, F.array().cast(FINDINGS))), name


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    got, name = annotate(texts(docs), keep_text=False)
    spans = F.col(name)
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with every secret in their texts replaced; n_chars, where there is one, follows the new text."""
    got, name = annotate(docs, text_col=text_col)
    at, spans_at, n_at = got.columns.index(text_col), got.columns.index(name), next((i for i, c in enumerate(docs.columns) if c == "n_chars"), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            found = columns.pop(spans_at)
            rows = [i for i, f in enumerate(found) if len(f)]
            if rows:
                values = columns[at].to_pylist()
                sizes = columns[n_at].to_pylist() if n_at is not None else None
                for i in rows:
                    values[i] = replaced(values[i], found[i].as_py(), mark)
                    if sizes is not None:
                        sizes[i] = len(values[i])
                columns[at] = pa.array(values, columns[at].type)
                if sizes is not None:
                    columns[n_at] = pa.array(sizes, columns[n_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=[n for k, n in enumerate(batch.schema.names) if k != spans_at])

    return got.mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[dict], mark: str) -> str:
    out, done = [], 0
    for span in spans:
        if span["start"] >= done:
            out += [text[done : span["start"]], mark]
        done = max(done, span["end"])
    return "".join(out) + text[done:]
