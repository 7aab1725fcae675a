"""Near-duplicate documents by MinHash with tensored banding.

Documents are linked when the Jaccard similarity of their sets of 5-word shingles is
75 % or more; a component is what links reach.

1. Equal sets become one class, before anything is compared.
2. Two collections of 16 blocks of 2 minhashes each; a table's key is a block of the
   first with a block of the second. So 64 minhashes serve 256 tables of 4 minhashes,
   which would take 1024 of their own. A pair at 75 % has a key in common unless all
   16 blocks of one collection differ: 2 * (1 - 0.75**2)**16, about 4e-6.
3. A key can only be shared if both its blocks are. Blocks are counted first, and keys
   are formed of shared blocks only, so documents without relatives form none.
4. In each bucket every member is paired with the one whose blocks are the most shared:
   the text that most copies stem from. No step emits all pairs of a large group.
5. Candidates whose sizes allow a link are confirmed on their full shingle sets, from
   their texts.
6. Components by label propagation with pointer jumping, on executors.
7. Members that are still apart from their bucket's best one are compared again: in
   buckets of up to SMALL members with all others, in larger ones with DRAWS members drawn
   for each bucket. Their links join the others.
8. Members of large buckets that are apart even then are a set of queries against all
   members of the large buckets whose best ones are of one component: in blocks of about
   BLOCK shingles on each side, each pair of blocks a group of its own that counts common
   shingles in place and gives links only. So every pair with a key in common is compared
   or joined by a chain of links, however large the bucket.

Ids are integers. Nulls and edge cases: texts without words have an empty set and no links; fewer than
five words are one shingle; rows without doc_id get their set's size, but neither
links nor a component; repeated rows have equal sets and one component; an empty table
gives an empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, packed_texts, texts, unpacked_rows
from .textarrays import LOWER, NOT_SPACE, SLICE_BYTES, grams, hashes, mix, row_of, salt, slices, spans, starts_of_grams

WORDS = 5
PERCENT = 75
BLOCKS = 16  # of each collection
ROWS = 2  # minhashes of a block
SMALL = 8
DRAWS = 2
BLOCK = 1 << 20  # shingles


def shingle_sets(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ordered, and each row's bounds."""
    low = LOWER[data]
    starts, ends, bounds = spans(low, rows, NOT_SPACE)
    h = hashes(low, starts, ends)
    whole = starts_of_grams(bounds, WORDS)
    g = grams(h, WORDS)[whole]
    row = row_of(bounds)[: len(whole)][whole]
    first = np.searchsorted(row, np.arange(len(rows)))
    sets = []
    for i, n in enumerate(np.diff(bounds).tolist()):
        if n >= WORDS:
            s = np.sort(g[first[i] : first[i + 1]])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            sets.append(grams(h[bounds[i] : bounds[i + 1]], n))
        else:
            sets.append(g[:0])
    sizes = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else g[:0]), sizes


def blocks_of(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Both collections' blocks of each non-empty set: pairs of 32-bit minhashes as 64-bit numbers."""
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(at), 2 * BLOCKS), np.uint64)
    for j in range(2 * BLOCKS):
        for k in range(ROWS):
            seed = j * ROWS + k
            least = np.minimum.reduceat(((sets ^ salt(2 * seed + 1)) * (salt(2 * seed + 2) | np.uint64(1))) >> np.uint64(32), at)
            out[:, j] = (out[:, j] << np.uint64(32)) | least
    return out.view(np.int64)


def digests_of(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of each non-empty set, whatever the order."""
    at = bounds[:-1][np.diff(bounds) > 0]
    sums = np.stack([np.add.reduceat(mix(sets ^ salt(1 << 20 | k)), at) for k in range(2)], axis=1)
    return [r.tobytes() for r in sums]


def signatures(docs: DataFrame) -> DataFrame:
    """Of each document: n_shingles, digest (equal for equal sets; null without id or words) and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, rows in slices(batch, 1):
                sets, bounds = shingle_sets(data, rows)
                n = np.diff(bounds)
                digest, blocks = [None] * len(n), [None] * len(n)
                ids = part.column(0).to_pylist()
                if len(sets):
                    for i, d, b in zip(np.flatnonzero(n).tolist(), digests_of(sets, bounds), blocks_of(sets, bounds).tolist(), strict=True):
                        if ids[i] is not None:
                            digest[i], blocks[i] = d, b
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(digest, pa.binary()), pa.array(blocks, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "blocks"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, blocks array<long>")


def tables_of(classes: DataFrame) -> DataFrame:
    """The keys of each class (id, n, score, key) that others may share; score: how many classes hold its blocks."""
    keys = classes.select("id", "n", F.posexplode("blocks").alias("place", "block"))
    shared = keys.groupBy("place", "block").agg(F.count("*").alias("holders")).filter("holders > 1")
    live = keys.join(shared, ["place", "block"]).groupBy("id", "n").agg(F.collect_list(F.struct("place", "block")).alias("live"), F.sum("holders").alias("score"))
    first = F.filter("live", lambda b: b["place"] < BLOCKS)
    second = F.filter("live", lambda b: b["place"] >= BLOCKS)
    tables = live.select("id", "n", "score", F.explode(first).alias("x"), second.alias("second")).select("id", "n", "score", "x", F.explode("second").alias("y"))
    return tables.select("id", "n", "score", F.xxhash64("x.place", "x.block", "y.place", "y.block").alias("key"))


def buckets_of(tables: DataFrame) -> DataFrame:
    """Of each key that is shared: members, the member of the highest score, and DRAWS drawn at random."""
    best = F.max(F.struct("score", (-F.col("id")).alias("minus"), "n"))
    draws = [F.min(F.struct(F.xxhash64("id", "key", F.lit(k)).alias("draw"), "id", "n")) for k in range(DRAWS)]
    made = tables.groupBy("key").agg(F.count("*").alias("members"), best.alias("best"), *[d.alias(f"draw{k}") for k, d in enumerate(draws)]).filter("members > 1")
    return made.select("key", "members", (-F.col("best.minus")).alias("best"), F.col("best.n").alias("best_n"), *[F.struct(f"draw{k}.id", f"draw{k}.n").alias(f"drawn{k}") for k in range(DRAWS)])


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b) with a < b, once each, of pairs (id, n, id2, n2) whose sizes allow a link."""
    fit = pairs.filter("id <> id2").filter(F.least("n", "n2") * 100 >= F.greatest("n", "n2") * PERCENT)
    return fit.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def candidates(members: DataFrame) -> DataFrame:
    """Every member with its bucket's best one."""
    return distinct_pairs(members.select("id", "n", F.col("best").alias("id2"), F.col("best_n").alias("n2")))


def labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """`rows` with the component of column `node` as column `name`: its own id where it has no links."""
    of = labels.select(F.col("node").alias(f"{name}_node"), F.col("label").alias(f"{name}_found"))
    return rows.join(of, F.col(node) == F.col(f"{name}_node"), "left").withColumn(name, F.coalesce(f"{name}_found", node)).drop(f"{name}_node", f"{name}_found")


def more_candidates(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Of members that no link joins to their bucket's best one: all pairs of small buckets, and in large ones those with the drawn one."""
    apart = labelled(labelled(members, labels, "id", "own"), labels, "best", "lead").filter("own <> lead")
    large = [apart.filter(F.col("members") > SMALL).select("id", "n", "own", F.col(f"drawn{k}.id").alias("id2"), F.col(f"drawn{k}.n").alias("n2")).distinct() for k in range(DRAWS)]
    large = labelled(reduce(DataFrame.unionByName, large).distinct(), labels, "id2", "other").filter("own <> other").select("id", "n", "id2", "n2")
    some = apart.filter(F.col("members").between(3, SMALL)).select("key", "best", F.col("id").alias("id2"), F.col("n").alias("n2"))
    small = members.select("key", "id", "n").join(some, "key").filter("id <> best").select("id", "n", "id2", "n2")
    return distinct_pairs(large.unionByName(small))


def still_apart(members: DataFrame, labels: DataFrame, held: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of large buckets by their best ones' component (lead), where some are of others (own): with their texts, and into how many blocks the queries (`rows`) and all of them (`cols`) go."""
    large = members.filter(F.col("members") > SMALL).select("id", "n", "best").distinct()
    within = labelled(labelled(large, labels, "id", "own"), labels, "best", "lead").select("lead", "id", "own", "n").distinct()
    blocks = lambda n: F.ceil(F.sum(n) / block).cast("int")
    parts = within.groupBy(F.col("lead").alias("of")).agg(blocks(F.when(F.col("own") != F.col("lead"), F.col("n"))).alias("rows"), blocks(F.col("n")).alias("cols")).filter("rows is not null")
    placed = within.join(parts, F.col("lead") == F.col("of")).drop("of", "n")
    return placed.join(held.select(F.col("doc_id").alias("id"), "packed"), "id").select("lead", "id", "own", "rows", "cols", "packed")


def links_apart(placed: DataFrame) -> DataFrame:
    """Links (a, b) between the members that are apart and all others of their lead that are of another component, on full sets."""
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = placed.filter("own <> lead").select("lead", place("rows").alias("row"), every("cols").alias("col"), "id", "own", "packed")
    among = placed.select("lead", every("rows").alias("row"), place("cols").alias("col"), "id", "own", "packed")

    def sets_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = rows.schema.get_field_index("packed")
        sets, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for batch in rows.to_batches():
            for _, (text,) in unpacked_rows(batch, (at,), SLICE_BYTES):
                found, bounds = shingle_sets(*text)
                sets.append(found)
                sizes.append(np.diff(bounds))
        return rows["id"].to_numpy(), rows["own"].to_numpy(), np.concatenate(sets), np.cumsum(np.concatenate(sizes))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            (ids, own, x, bx), (others, others_own, y, by) = sets_of(left), sets_of(right)
            n = np.diff(by)
            values, at_value = np.unique(y, return_inverse=True)
            marked = np.zeros(len(values) + 1, np.int64)
            for i in range(len(ids)):
                s = x[bx[i] : bx[i + 1]]
                fit = (others_own != own[i]) & (np.minimum(n, len(s)) * 100 >= np.maximum(n, len(s)) * PERCENT)
                if not fit.any():
                    continue
                at = np.searchsorted(values, s)
                at = at[values[np.minimum(at, len(values) - 1)] == s]
                marked[at] = 1
                common = np.add.reduceat(marked[at_value], by[:-1])
                marked[at] = 0
                linked = others[fit & (100 * common >= PERCENT * (len(s) + n - common))]
                a.append(np.minimum(linked, ids[i]))
                b.append(np.maximum(linked, ids[i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    met = queries.groupBy("lead", "row", "col").cogroup(among.groupBy("lead", "row", "col"))
    return met.applyInArrow(compare, "a long, b long").distinct()


def confirmed(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs that are links, on the full shingle sets of their texts; `held` has the texts, packed."""
    both = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("packed").alias("text_a")), "a").join(held.select(F.col("doc_id").alias("b"), F.col("packed").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for first, texts_ in unpacked_rows(batch, (2, 3), SLICE_BYTES):
                (x, bx), (y, by) = (shingle_sets(*t) for t in texts_)
                for i in range(len(bx) - 1):
                    s, t = x[bx[i] : bx[i + 1]], y[by[i] : by[i + 1]]
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    linked[first + i] = len(s) > 0 and 100 * common >= PERCENT * (len(s) + len(t) - common)
            yield batch.select([0, 1]).filter(pa.array(linked))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Of each node of the links (a, b): the smallest node reachable (label). Nodes are of any type that has an order; `keep` writes what a round needs."""
    links = keep(links)
    ways = keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = keep(ways.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        seen = ways.join(labels, ways["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, labels["node"] == seen["a"]).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = keep(lower.join(jump, "low", "left").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("moved")))
        labels = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return labels


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of `docs`."""
    docs = texts(docs, id_col, text_col)
    known = cut(signatures(docs))
    least = known.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "blocks")).alias("c"))
    classes = cut(least.select("digest", F.col("c.doc_id").alias("id"), F.col("c.n").alias("n"), F.col("c.blocks").alias("blocks")))
    with Scratch(docs.sparkSession, "near-duplicates") as keep:
        tables = keep(tables_of(classes))
        members = keep(tables.join(buckets_of(tables), "key"))
        nodes = members.select(F.col("id").alias("doc_id")).distinct()
        held = keep(packed_texts(docs.filter("doc_id is not null")).join(nodes, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
        links = keep(confirmed(keep(candidates(members)), held))
        labels = components(links)
        more = keep(confirmed(keep(more_candidates(members, labels)), held))
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
        placed = keep(still_apart(members, labels, held, block))
        rest = keep(links_apart(placed))
        if not rest.isEmpty():
            labels = components(links.unionByName(rest))
    of_class = classes.join(labels, classes["id"] == labels["node"], "left").select("digest", F.coalesce("label", "id").alias("component"))
    rows = known.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component; of repeated rows of one doc_id and text one stays, rows without doc_id all stay."""
    found = cut(annotate(docs))
    gone = found.filter("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    return left.filter("doc_id is null").unionByName(left.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]))


#: The exact result, by comparing all documents that share a shingle: for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0) t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y
), c AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id
"""
