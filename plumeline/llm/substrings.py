"""Near-duplicate passages by compact windows.

A passage is at least WORDS words of a text, as its 5-word shingles. Under one hash
function, the shingle of least hash within a window stands for the window, and all
windows that it stands for are one compact window (l, m, r): those that start in
[l, m] and end in [m, r]. Compact windows are the nodes of the Cartesian tree of the
hashes that are long enough for a passage, about two for each passage length. Windows
of the least length that a node stands for start in one interval, [max(l, m-n+1),
min(m, r-n+1)], and these intervals tile a text.

1. Functions come in BANDS of two, each with its trees. Within each text the intervals of
   both functions' compact windows are joined: where they overlap, all windows have the
   same two least shingles, which are the overlap's key. Across documents, overlaps are
   joined by equal keys. A passage at 75 % has a key in common with its copy unless all bands
   fail: (1 - 0.75**2)**BANDS, 0.016 for one window of the least length; longer ones
   have more windows. Equal passages have all keys in common.
2. Keys meet where their hash falls. Of the places of a group, those with equal shingles
   around them are paired with the first of them, which stands for them; these first ones
   are paired with a leader, that of the smallest document. Groups of all sizes are paired
   in this way.
3. Pairs of documents are aligned on their texts, along each distance between their
   places, give or take SLACK words: a passage is a run from one shingle in common to
   another with 75 % of those of either side in common, insertions and deletions
   counted. It is confirmed on its shingle sets.
4. In groups whose places aren't all of one class of passages then, they are compared by
   the shingles around them and an index of the rarest of these, until all that are alike
   are connected: what is apart from the largest part is compared with all that it isn't
   connected with. Places in no passage are also aligned with BESIDE others before and
   after them, as a long passage may be less alike around a place.
   What is found is aligned and confirmed in the same way.

So every place that has a passage with another text by a key in common is in a row of the
result, but not with every text: one partner stands for those that are connected with it.
Rows carry the class of passages that they join, which has all documents of the group.

Nulls and edge cases: texts that are null, empty or shorter than a passage have none;
rows without doc_id are left out; rows of one doc_id are one document, with any of its
texts; of equal texts within a task one is compared and the others are its copies;
passages that repeat within one document only aren't reported; an empty table gives no
rows; texts of any length are taken whole. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, packed_texts, shards_for, texts, unpacked_rows
from .minhash import components
from .textarrays import LOWER, NOT_SPACE, SLICE_BYTES, grams, hashes, mix, row_of, salt, slices, spans

WORDS = 50
SHINGLE = 5
LENGTH = WORDS - SHINGLE + 1
BANDS = 5
PERCENT = 75
#: How far a passage may drift from the distance of a place that agrees, by insertions and deletions.
SLACK = 12
#: The shingles around a place that any least passage at it can have, and how many of them such a passage has in common.
AROUND = 2 * LENGTH - 1
COMMON = -(-LENGTH * 6 // 7) - 1
#: A place is compared with all others of its group while so large a share of them is alike, then with those that share a rare shingle.
WORTHWHILE = 1 / 8
#: So many others a place is compared with at first, then with twice as many each time.
FIRST = 128
#: A place is paired with so many of those that are alike and connected with each other already.
STANDING = 2
#: A place that is in no passage with its group's leader is aligned with so many that come before and after it there.
BESIDE = 5
#: Pairs of places compared at once.
CHUNK = 1 << 14
#: So many pairs of places of a group are compared without an index.
FEW = 1 << 12
#: Windows that a task holds before it sends them, and bytes of windows in a shard.
HELD, SHARD_BYTES = 3 << 18, 6 << 20

#: A window: hash within the shard, document, place, hash of the shingles around it. A pair: documents and places. A copy of a text, with its words.
WINDOW = np.dtype([("key", "<u4"), ("doc", "<i8"), ("m", "<u4"), ("content", "<u8")])
PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("ma", "<u4"), ("mb", "<u4")])
COPY = np.dtype([("doc", "<i8"), ("of", "<i8"), ("words", "<u4")])
#: A window, another with equal shingles around it (of another document if there is one); with that, the class of passages that it lies in (0: none), and the shingles around it (0: none).
STANDS = np.dtype([("key", "<u8"), ("doc", "<i8"), ("m", "<u4"), ("other", "<i8"), ("mo", "<u4")])
PLACE = np.dtype([*STANDS.descr, ("part", "<i8"), ("around", "<u2", (AROUND,))])
#: Kinds of rows of places(): a pair; a window that stands for its equals in a group of three or more such, with the leader; a copy and what it is of.
PAIRED, MEMBER, COPIED = range(3)


def shingles(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hash at each word of each row that begins one, and each row's bounds."""
    low = LOWER[data]
    starts, ends, bounds = spans(low, rows, NOT_SPACE)
    n = np.maximum(np.diff(bounds) - SHINGLE + 1, 0)
    out = np.concatenate([[0], np.cumsum(n)])
    g = grams(hashes(low, starts, ends), SHINGLE)
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], n)
    return g[at], out


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each `width` values in a row, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def windows_of(bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each place, which windows of `length` lie in one row, and which places lie in none of these."""
    row = row_of(bounds)
    whole = row[: max(len(row) - length + 1, 0)] == row[length - 1 :]
    return row, whole, np.repeat(np.diff(bounds) < length, np.diff(bounds))


def compact_windows(v: np.ndarray, bounds: np.ndarray, length: int = LENGTH, windows: tuple | None = None, far: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, m, r) of all compact windows of at least `length` of each row's hashes, r inclusive: the nodes of the rows' Cartesian trees that are long enough. The first of equal hashes is the least.

    With `far`, of at least `length`, what is so far from m or farther may be left out of the windows: the trees are climbed no higher.
    """
    if len(v) < length:
        none = np.zeros(0, np.int64)
        return none, none, none
    row, whole, outside = windows or windows_of(bounds, length)
    # the greatest of the minima of a place's windows is its own hash if it is the least of one of them
    greatest = np.zeros(len(v) + length - 1, np.uint64)
    np.multiply(sliding(v, length, np.minimum), whole, out=greatest[length - 1 : length - 1 + len(whole)])
    m = np.flatnonzero(sliding(greatest, length, np.maximum)[: len(v)] == v)
    m = m[~outside[m]]
    k = len(m)
    h, of = v[m], row[m]
    # the nearest lower hash of the row on either side, before it an equal one too; only what still moves is looked at
    before, after = np.arange(-1, k - 1), np.arange(1, k + 1)
    far = far or len(v)
    at = np.arange(1, k)
    while len(at):
        to = before[at]
        goes = (of[to] == of[at]) & (h[to] > h[at]) & (m[at] - m[to] < far)
        at = at[goes]
        before[at] = before[to[goes]]
        at = at[before[at] >= 0]
    at = np.arange(k - 1)
    while len(at):
        to = after[at]
        goes = (of[to] == of[at]) & (h[to] >= h[at]) & (m[to] - m[at] < far)
        at = at[goes]
        after[at] = after[to[goes]]
        at = at[after[at] < k]
    inside = (before >= 0) & (of[np.maximum(before, 0)] == of)
    left = np.where(inside, m[np.maximum(before, 0)] + 1, bounds[of])
    inside = (after < k) & (of[np.minimum(after, k - 1)] == of)
    right = np.where(inside, m[np.minimum(after, k - 1)] - 1, bounds[of + 1] - 1)
    long = right - left + 1 >= length
    return left[long], m[long], right[long]


def joined_windows(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and place of each overlap of a band's two functions' intervals, for all bands.

    The windows of the least length that a compact window holds start in an interval; those of one function tile the text."""
    keys, places_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    windows = windows_of(bounds)

    def intervals(function: int) -> tuple[np.ndarray, np.ndarray]:
        l, m, _ = compact_windows((g ^ salt(1 << 21 | function)) * (salt(1 << 22 | function) | np.uint64(1)), bounds, LENGTH, windows, LENGTH)
        return np.maximum(l, m - LENGTH + 1), m

    for band in range(BANDS):
        (s1, m1), (s2, m2) = intervals(2 * band), intervals(2 * band + 1)
        starts = np.concatenate([s1, s2])
        starts.sort()
        starts = starts[np.diff(starts, prepend=-1) > 0]
        one, other = m1[np.searchsorted(s1, starts, "right") - 1], m2[np.searchsorted(s2, starts, "right") - 1]
        keys.append(mix(g[one] * np.uint64(0xD1342543DE82EF95) + g[other] + salt(1 << 23 | band)))
        places_.append(one)
    return np.concatenate(keys), np.concatenate(places_)


def bounds_of(keys: np.ndarray) -> np.ndarray:
    """Where equal keys in a row begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which 32-bit values may be among some: all that are, and few others."""
    bits = min(max(12, len(some).bit_length() + 4), 24)
    slot = lambda x: (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    held = np.zeros(1 << bits, bool)
    held[slot(some)] = True
    return held[slot(values)]


def grouped(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose key more than one document has, in order of key, document and place, and the bounds of keys."""
    # most are alone with their key
    keys = np.sort(windows["key"])
    once = np.ones(len(keys) + 1, bool)
    np.not_equal(keys[1:], keys[:-1], out=once[1:-1])
    many = keys[:-1][once[:-2] & ~once[1:-1]] if len(keys) else keys
    windows = windows[among(windows["key"], many)]
    windows = windows[np.lexsort((windows["m"], windows["doc"], windows["key"]))]
    if not len(windows):
        return windows, np.zeros(1, np.int64)
    bounds = bounds_of(windows["key"])
    many = windows["doc"][bounds[:-1]] != windows["doc"][bounds[1:] - 1]
    size = np.diff(bounds)
    return windows[np.repeat(many, size)], np.concatenate([[0], np.cumsum(size[many])])


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of two lists of windows, without those of one document; the smaller document first."""
    apart = x["doc"] != y["doc"]
    x, y = x[apart], y[apart]
    turn = x["doc"] > y["doc"]
    out = np.zeros(len(x), PAIR)
    for a, b, name in (("a", "b", "doc"), ("ma", "mb", "m")):
        out[a], out[b] = np.where(turn, y[name], x[name]), np.where(turn, x[name], y[name])
    return out


def contents(g: np.ndarray, bounds: np.ndarray, m: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A hash of the shingles around each place, and of how far the text goes on either side."""
    low, high = np.maximum(bounds[of], m - LENGTH + 1), np.minimum(bounds[of + 1], m + LENGTH)
    return mix(hashes(g, low, high) + (m - low).astype(np.uint64))


def equals(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the list of the first and the last window with each one's key and content."""
    order = np.lexsort((windows["content"], windows["key"]))
    key, content = windows["key"][order], windows["content"][order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(order)))
    first, last = np.zeros((2, len(order)), np.int64)
    first[order], last[order] = np.repeat(order[at], size), np.repeat(order[at + size - 1], size)
    return first, last


def leaders(windows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The place in the list of each window's leader: the first of its group, or for others of the first one's document the first of another, if there is one."""
    lead = np.repeat(bounds[:-1], np.diff(bounds))
    own = windows["doc"] == windows["doc"][lead]
    place = np.arange(len(windows))
    other = np.minimum.reduceat(np.where(own, len(windows), place), bounds[:-1]) if len(windows) else place
    other = np.repeat(other, np.diff(bounds))
    return np.where(own & (place != lead) & (other < len(windows)), other, lead)


def around(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The shingles around each place of a text, as 16-bit numbers; 0 beyond its ends."""
    low = np.maximum((mix(x) >> np.uint64(48)).astype(np.uint16), np.uint16(1))
    edge = np.zeros(LENGTH - 1, np.uint16)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, low, edge]), AROUND)[m]


def alike(lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which have a passage at their place whose shingles the leader has, 6 of 7 of them; from one in common to one in common."""
    known = np.zeros(1 << 16, bool)
    known[lead] = True
    known[0] = False
    equal = known[rest]
    have = equal.sum(axis=1) >= COMMON
    at = np.flatnonzero(have)
    if len(at):
        equal = equal[at]
        sums = np.zeros((len(at), AROUND + 1), np.int16)
        np.cumsum(equal * np.int16(7) - np.int16(6), axis=1, dtype=np.int16, out=sums[:, 1:])
        least = np.minimum.accumulate(np.where(equal[:, :LENGTH], sums[:, :LENGTH], np.int16(1 << 14)), axis=1)
        have[at] = (equal[:, LENGTH - 1 :] & (sums[:, LENGTH:] >= least - np.int16(6))).any(axis=1)
    return have


def rare(shingles_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle as its rank) of each row's rarest ones: any two rows with COMMON in common share one of them. Of rows with a shingle twice, all."""
    keys = np.sort(shingles_, axis=1)
    new = keys > 0
    all_ = new.sum(axis=1)
    new[:, 1:] &= keys[:, 1:] != keys[:, :-1]
    by_count = np.argsort(np.bincount(keys[new], minlength=1 << 16), kind="stable")
    rank = np.zeros(1 << 16, np.uint16)
    rank[by_count] = np.arange(1 << 16, dtype=np.uint16)
    ranks = np.where(new, rank[keys], np.uint16(0xFFFF))
    ranks.sort(axis=1)
    n = new.sum(axis=1)
    some = np.maximum(np.where(n < all_, n, n - COMMON + 1), 0)
    return np.repeat(np.arange(len(keys), dtype=np.int32), some), ranks[np.arange(AROUND) < some[:, None]]


def worthwhile(places_: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which places of groups have COMMON shingles around them that others have which they aren't connected with; shingles are told apart by a hash, so more may seem to be such."""
    group = row_of(bounds).astype(np.uint32)
    part = np.arange(len(places_), dtype=np.uint32)
    some = np.flatnonzero(places_["part"])
    part[some] = len(places_) + np.unique(places_["part"][some], return_inverse=True)[1]
    bits = min(max(12, (AROUND * len(places_)).bit_length() + 1), 22)

    def slots(k: int) -> np.ndarray:
        x = (group * np.uint32(0x9E3779B1) + places_["around"][:, k]) * np.uint32(0x85EBCA6B)
        return ((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)

    seen, mixed = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, bool)
    for k in range(AROUND):
        seen[slots(k)] = part
    for k in range(AROUND):
        h = slots(k)
        mixed[h[seen[h] != part]] = True
    common = np.zeros(len(places_), np.uint8)
    for k in range(AROUND):
        common += mixed[slots(k)] & (places_["around"][:, k] > 0)
    return common >= COMMON


def elected(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in the group) of windows that are alike, which connect all that are; those of one part are connected already."""
    c, doc, second = group["around"], group["doc"], group["other"]
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    every = np.arange(len(group))
    up = every.copy()
    met = group["part"] != 0
    some = np.flatnonzero(met)
    _, one, of = np.unique(group["part"][some], return_index=True, return_inverse=True)
    up[some] = some[one[of]]
    compared = np.zeros(len(group), bool)

    def parts(x: np.ndarray) -> np.ndarray:
        """What stands for all windows that each is connected with."""
        top = up[x]
        while (up[top] != top).any():
            top = up[top]
        up[x] = top
        return top

    def compare(i: int, near: np.ndarray) -> bool:
        """Window i with those of others that it isn't connected with, of each part until STANDING are alike; whether many of them were."""
        top = parts(near)
        other = top != parts(every[i : i + 1])
        if second[i] == doc[i]:
            other &= (doc[near] != doc[i]) | (second[near] != doc[i])
        near, top = near[other], top[other]
        met[i] = True
        got, tops, asked, size = [], [], 0, FIRST
        stand = np.zeros(len(group), np.int64)
        while len(near):
            head, its = near[:size], top[:size]
            near, top = near[size:], top[size:]
            asked += len(head)
            size *= 2
            good = alike(c[i], c[head])
            if good.any():
                got.append(head[good])
                tops.append(its[good])
                np.add.at(stand, tops[-1], 1)
                open_part = stand[top] < STANDING
                near, top = near[open_part], top[open_part]
        if not got:
            return asked == 0
        near, top = np.concatenate(got), np.concatenate(tops)
        met[near] = True
        order = np.argsort(top, kind="stable")
        top = top[order]
        first = np.searchsorted(top, top)
        partner = near[order][np.arange(len(top)) - first < STANDING]
        out.append((np.full(len(partner), i), partner))
        up[top] = parts(every[i : i + 1])
        return len(near) >= WORTHWHILE * asked

    while len(open_ := np.flatnonzero(~met)):
        compared[open_[0]] = True
        if not compare(open_[0], every):
            break
    # what is connected with most needn't be asked: all that are apart from it are
    top = parts(every)
    most = np.bincount(top).argmax()
    open_ = np.flatnonzero((top != most) & ~compared)
    if len(open_) * len(group) <= FEW:
        for i in open_.tolist():
            if parts(every[i : i + 1]) != parts(every[most : most + 1]):
                compare(i, every)
    else:
        row, shingle = rare(c)
        order = np.argsort(shingle, kind="stable")
        row, shingle = row[order], shingle[order]
        at = np.concatenate([[0], np.cumsum(np.bincount(shingle, minlength=1 << 16))])
        # only shingles of windows of more than one part connect parts
        some = np.flatnonzero(np.diff(at))
        mixed = np.zeros(1 << 16, bool)
        mixed[some] = np.minimum.reduceat(top[row], at[some]) != np.maximum.reduceat(top[row], at[some])
        shared = mixed[shingle]
        mine = np.flatnonzero(shared)[np.argsort(row[shared], kind="stable")]
        own = np.searchsorted(row[mine], np.arange(len(group) + 1))
        for i in open_.tolist():
            if own[i] < own[i + 1] and parts(every[i : i + 1]) != parts(every[most : most + 1]):
                near = np.unique(np.concatenate([row[at[k] : at[k + 1]] for k in shingle[mine[own[i] : own[i + 1]]].tolist()]))
                for k in range(0, len(near), CHUNK):
                    compare(i, near[k : k + CHUNK])
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b


def apart(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of windows (doc, m, and other and mo, their equals) as pairs of two documents, where one or its equal is of another than the other."""
    ends = []
    same = x["doc"] == y["doc"]
    instead = same & (y["other"] != x["doc"])
    for w, turn in ((x, same & ~instead), (y, instead)):
        end = np.zeros(len(w), WINDOW)
        end["doc"], end["m"] = np.where(turn, w["other"], w["doc"]), np.where(turn, w["mo"], w["m"])
        ends.append(end)
    return ends[0], ends[1]


def sent(shard: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A row (shard, windows) for each shard that has values."""
    low = int(shard.min())
    # of 16-bit numbers, the sort is by digits
    order = np.argsort((shard - low).astype(np.uint16) if int(shard.max()) - low < 1 << 16 else shard, kind="stable")
    shard, values = shard[order], values[order]
    bounds = bounds_of(shard)
    ends = bounds.tolist()
    return pa.RecordBatch.from_arrays([pa.array(shard[bounds[:-1]].astype(np.int32)), pa.array([values[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["shard", "windows"])  # noqa: B905


def places(docs: DataFrame, shards: int) -> DataFrame:
    """Rows (kind, a, b, ma, mb, group, other, mo) of places that agree; see the kinds."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        task = TaskContext.get().partitionId()
        found: list[tuple] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            key, doc, m, content = (np.concatenate(x) for x in zip(*found, strict=True))
            windows = np.zeros(len(key), WINDOW)
            windows["key"], windows["doc"], windows["m"], windows["content"] = key & np.uint64(0xFFFFFFFF), doc, m, content
            found.clear()
            return sent(((key >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64), windows)

        for batch in batches:
            for part, data, rows in slices(batch, 1):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                g, bounds = shingles(data, rows)
                raw, new, copies = data.tobytes(), np.ones(len(ids), bool), []
                for i in np.flatnonzero(np.diff(bounds) >= LENGTH).tolist():
                    of = seen.setdefault(hashlib.blake2b(raw[rows[i] : rows[i + 1]], digest_size=16).digest(), int(ids[i]))
                    if of != ids[i]:
                        new[i] = False
                        copies.append((ids[i], of, bounds[i + 1] - bounds[i] + SHINGLE - 1))
                if copies:
                    yield sent(np.full(len(copies), -1 - task), np.array(copies, COPY))
                if not new.all():
                    size_of = np.diff(bounds)
                    g = g[np.repeat(new, size_of)]
                    bounds = np.concatenate([[0], np.cumsum(np.where(new, size_of, 0))])
                key, m = joined_windows(g, bounds)
                of = np.searchsorted(bounds, m, "right") - 1
                found.append((key, ids[of].astype(np.int64), m - bounds[of], contents(g, bounds, m, of)))
                size += len(key)
                if size >= HELD:
                    yield flushed()
                    size = 0
        if size:
            yield flushed()

    def row(kind: int, a: np.ndarray, b: np.ndarray, ma: np.ndarray, mb: np.ndarray, *more: np.ndarray) -> pa.Table:
        group, other, mo = more or np.zeros((3, len(a)))
        columns = (("a", a), ("b", b), ("ma", ma), ("mb", mb), ("group", group), ("other", other), ("mo", mo))
        return pa.table({"kind": pa.array(np.full(len(a), kind, np.int32))} | {n: pa.array(x.astype(np.int64)) for n, x in columns})

    def meet(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        buffers = [w.as_buffer() for chunk in table["windows"].chunks for w in chunk]
        if shard < 0:
            copies = np.concatenate([np.frombuffer(b, COPY) for b in buffers])
            return row(COPIED, copies["doc"], copies["of"], copies["words"], copies["words"])
        windows, _ = grouped(np.concatenate([np.frombuffer(b, WINDOW) for b in buffers]))
        first, last = equals(windows)
        one = np.flatnonzero(first == np.arange(len(windows)))
        rest = np.flatnonzero(first != np.arange(len(windows)))
        partner = np.where(windows["doc"][rest] == windows["doc"][first[rest]], last[rest], first[rest])
        pairs = [paired(windows[partner], windows[rest])]
        # a window for each content, in order of key and document, with another of its equals
        places_ = np.zeros(len(one), STANDS)
        for name, x in (("doc", windows["doc"][one]), ("m", windows["m"][one]), ("other", windows["doc"][last[one]]), ("mo", windows["m"][last[one]]), ("key", windows["key"][one])):
            places_[name] = x
        places_["key"] |= np.uint64(shard) << np.uint64(32)
        bounds = bounds_of(places_["key"])
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]
        pairs.append(paired(*apart(places_[two], places_[two + 1])))
        large = places_[np.repeat(size > 2, size)]
        bounds = np.concatenate([[0], np.cumsum(size[size > 2])]).astype(np.int64)
        lead = large[leaders(large, bounds)]
        pairs = np.concatenate(pairs)
        return pa.concat_tables([row(PAIRED, pairs["a"], pairs["b"], pairs["ma"], pairs["mb"]), row(MEMBER, large["doc"], lead["doc"], large["m"], lead["m"], large["key"], large["other"], large["mo"])])

    return docs.mapInArrow(send, "shard int, windows binary").groupBy("shard").applyInArrow(meet, "kind int, a long, b long, ma long, mb long, group long, other long, mo long")


def led(windows: DataFrame, held: DataFrame, shards: int) -> DataFrame:
    """Pairs (a, b, ma, mb) of windows (a, ma, group, part, other, mo) of groups of more than one part; `held` has the texts, packed."""
    of_doc = windows.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list(F.struct("group", "ma", "part", "other", "mo")).alias("windows")).join(held, "doc_id").select("doc_id", "windows", "packed")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts_ in unpacked_rows(batch, (2,), SLICE_BYTES):
                x, bounds = shingles(*texts_[0])
                own = batch.slice(first, len(bounds) - 1)
                of = np.repeat(np.arange(own.num_rows), own.column(1).value_lengths().to_numpy())
                key, m, part, other, mo = (k.to_numpy(zero_copy_only=False) for k in own.column(1).flatten().flatten())
                ids = own.column(0).to_numpy()
                some = m < np.diff(bounds)[of]
                key, m, part, other, mo, of = (x[some] for x in (key, m, part, other, mo, of))
                got = np.zeros(len(key), PLACE)
                got["key"], got["doc"], got["m"], got["part"], got["other"], got["mo"] = key, ids[of], m, part, other, mo
                ends = np.searchsorted(of, np.arange(own.num_rows + 1))
                for i in range(own.num_rows):
                    if ends[i] < ends[i + 1]:
                        got["around"][ends[i] : ends[i + 1]] = around(x[bounds[i] : bounds[i + 1]], m[ends[i] : ends[i + 1]])
                if len(got):
                    yield sent((mix(got["key"]) % np.uint64(shards)).astype(np.int64), got)

    def meet(table: pa.Table) -> pa.Table:
        places_ = np.concatenate([np.frombuffer(p.as_buffer(), PLACE) for chunk in table["windows"].chunks for p in chunk])
        places_ = places_[np.lexsort((places_["m"], places_["doc"], places_["key"]))]
        some = np.arange(len(places_))
        for _ in range(2):
            some = some[worthwhile(places_[some], bounds_of(places_["key"][some]))]
        bounds = bounds_of(places_["key"][some])
        alone = places_["part"] == 0
        out = [np.zeros(0, PAIR)]
        for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
            at = some[bounds[k] : bounds[k + 1]]
            first, other = (at[x] for x in elected(places_[at]))
            out.append(paired(*apart(places_[first], places_[other])))
        for step in range(1, BESIDE + 1):
            x = np.flatnonzero((alone[:-step] | alone[step:]) & (places_["key"][:-step] == places_["key"][step:]))
            out.append(paired(*apart(places_[x], places_[x + step])))
        pairs = np.concatenate(out)
        return pa.table({c: pa.array(pairs[c].astype(np.int64)) for c in PAIR.names})

    return of_doc.mapInArrow(send, "shard int, windows binary").groupBy("shard").applyInArrow(meet, "a long, b long, ma long, mb long")


class Indexed:
    """A text's shingles by value and place."""

    def __init__(self, y: np.ndarray):
        self.y, self.wide = y, len(y) + 1
        order = y.argsort(kind="stable")
        ordered = y[order]
        new = np.ones(len(y), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        self.values = ordered[new]
        # a last one that is near nothing
        self.ranked = np.full(len(y) + 1, 1 << 62)
        self.ranked[:-1] = (new.cumsum() - 1) * self.wide + order

    def ranks(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of x that have a shingle in common with this text, that shingle, and where its places begin among the ranked."""
        at = np.minimum(self.values.searchsorted(x), len(self.values) - 1)
        i = (self.values[at] == x).nonzero()[0]
        return i, x[i], at[i] * self.wide

    def matches(self, i: np.ndarray, shingle: np.ndarray, rank: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j) of shingles in common with j - i near the shift, both rising; the rest as ranks() gives it."""
        j = i + shift
        inside = np.minimum(np.maximum(j, 0), len(self.y) - 1)
        unlike = ((inside != j) | (self.y[inside] != shingle)).nonzero()[0]
        if len(unlike):
            straight, first = j[unlike], rank[unlike]
            near = self.ranked[self.ranked.searchsorted(first + np.maximum(straight - SLACK, 0))] - first
            good = near <= np.minimum(straight + SLACK, self.wide - 1)
            j[unlike] = near
            some = np.ones(len(j), bool)
            some[unlike] = good
            i, j = i[some], j[some]
            if len(j):
                rising = np.ones(len(j), bool)
                np.greater(j[1:], np.maximum.accumulate(j)[:-1], out=rising[1:])
                i, j = i[rising], j[rising]
        return i, j


def runs(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Passages (start, end, start, end; shingles) of places in common: the leftmost first, each as long as 75 % are in common."""
    if len(i) <= COMMON:
        return
    value = 7 * np.arange(len(i)) - 3 * (i + j)
    # the last place up to which enough is in common: the greatest from a place on falls, so it is where it gets too small
    last = len(i) - 1 - np.maximum.accumulate(value[::-1]).searchsorted(value - 1)
    starts = (np.minimum(i[last] - i, j[last] - j) + 1 >= LENGTH).nonzero()[0]
    p = 0
    while (at := starts.searchsorted(p)) < len(starts):
        p = starts[at]
        q = last[p]
        yield int(i[p]), int(i[q]) + 1, int(j[p]), int(j[q]) + 1
        p = q + 1


def passages(x: np.ndarray, other: Indexed, seeds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Confirmed passages (start, end, start, end; words) of two texts' shingles, from seeds: the distance (other's place less x's) of places that agree, the first and the last of x's.

    Distances whose places lie in passages found before, in both texts, are left out.
    """
    y = other.y
    if len(x) < LENGTH or len(y) < LENGTH:
        return []
    if len(x) == len(y) and (x == y).all():
        return [(0, len(x) + SHINGLE - 1, 0, len(y) + SHINGLE - 1)]
    places_ = other.ranks(x)
    out: list[tuple[int, int, int, int]] = []
    if len(places_[0]) <= COMMON:
        return out
    for shift, low, high in sorted(seeds.tolist(), key=lambda s: (s[1] - s[2], s)):
        ahead, behind = low + shift, high + shift + SHINGLE
        if any(a <= low and high + SHINGLE <= b for a, b, _, _ in out) and any(c <= ahead and behind <= d for _, _, c, d in out):
            continue
        for s, e, t, u in runs(*other.matches(*places_, shift)):
            if any(a <= s and e + SHINGLE - 1 <= b and c <= t and u + SHINGLE - 1 <= d for a, b, c, d in out):
                continue
            own, theirs = set(x[s:e].tolist()), set(y[t:u].tolist())
            common = len(own & theirs)
            if 100 * common >= PERCENT * (len(own) + len(theirs) - common):
                out.append((s, e + SHINGLE - 1, t, u + SHINGLE - 1))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that documents share: doc_id, start and end (words), the same of the other document, whose id is smaller, and the passage's class; see classes()."""
    docs = texts(docs, id_col, text_col).filter("doc_id is not null")
    shards = shards_for(docs, SHARD_BYTES)
    with Scratch(docs.sparkSession, "passages") as keep:
        found = keep(places(docs, shards))
        members = found.filter(F.col("kind") == MEMBER)
        turned = [F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("a", "b"), ("b", "a"), ("ma", "mb"), ("mb", "ma"))]
        pairs = keep(with_seeds(found.filter((F.col("kind") != COPIED) & (F.col("a") != F.col("b"))).select(*turned)))
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        held = keep(packed_texts(docs).join(nodes, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
        first = keep(confirmed(pairs, held))
        known = classes(first, keep)
        ends = known.select(F.explode(F.array(F.struct("doc_id", "start", "end"), F.struct(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start"), F.col("other_end").alias("end")))).alias("s"), F.xxhash64("class_doc", "class_start").alias("part"))
        covered = ends.groupBy(F.col("s.doc_id").alias("a")).agg(F.collect_set(F.struct("s.start", "s.end", "part")).alias("spans"))
        part = F.get(F.filter("spans", lambda s: (s["start"] <= F.col("ma")) & (F.col("ma") + SHINGLE <= s["end"])), F.lit(0))["part"]
        windows = keep(members.join(covered, "a", "left").select("a", "ma", "group", "other", "mo", F.coalesce(part, F.lit(0)).alias("part")))
        left = windows.groupBy("group").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low = 0 or high = 0 or low <> high").select("group")
        others = keep(with_seeds(led(windows.join(left, "group", "left_semi"), held, 4 * shards)))
        tried = pairs.select("a", "b", F.col("seeds.shift").alias("tried"))
        new = F.filter("seeds", lambda s: ~F.coalesce(F.array_contains("tried", s["shift"]), F.lit(False))).alias("seeds")
        second = confirmed(others.join(tried, ["a", "b"], "left").select("a", "b", new).filter(F.size("seeds") > 0), held)
        copies = found.filter(F.col("kind") == COPIED).select(F.greatest("a", "b").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.col("ma").alias("end"), F.least("a", "b").alias("other_id"), F.lit(0).cast("long").alias("other_start"), F.col("ma").alias("other_end"))
        return cut(classes(keep(first.unionByName(second).unionByName(copies)), keep))


def classes(found: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """`found` with each row's class of passages: class_doc and class_start, where its first place is, and class_docs, its number of documents.

    Spans that overlap within a document are one place; a class is all places that rows join, so it has every document that shares a
    passage of it, though rows name one partner each.
    """
    sides = {"doc_id": ("doc_id", "start", "end"), "other_id": ("other_id", "other_start", "other_end")}
    each = reduce(DataFrame.unionByName, [found.select(*[F.col(c).alias(n) for c, n in zip(cs, ("doc", "from", "to"), strict=True)]) for cs in sides.values()]).distinct()
    by_start = Window.partitionBy("doc").orderBy("from", "to")
    so_far = F.max("to").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = each.withColumn("opens", F.when(so_far.isNull() | (so_far <= F.col("from")), F.col("from")))
    spots = keep(opened.select("doc", "from", "to", F.struct("doc", F.max("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)).alias("from")).alias("spot")))
    placed = found
    for side, columns in sides.items():
        spot = spots.select(*[F.col(n).alias(c) for c, n in zip(columns, ("doc", "from", "to"), strict=True)], F.col("spot").alias(f"spot_{side}"))
        placed = placed.join(spot, list(columns))
    placed = keep(placed)
    labels = keep(components(placed.select(F.col("spot_doc_id").alias("a"), F.col("spot_other_id").alias("b")).distinct(), keep))
    size = labels.groupBy("label").agg(F.count_distinct("node.doc").alias("class_docs"))
    known = labels.join(size, "label").select(F.col("node").alias("spot_doc_id"), F.col("label.doc").alias("class_doc"), F.col("label.from").alias("class_start"), "class_docs")
    return placed.join(known, "spot_doc_id").select("doc_id", "start", "end", "other_id", "other_start", "other_end", "class_doc", "class_start", "class_docs")


def confirmed(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The passages of pairs of documents (a, b, seeds), from the distances of places that agree; `held` has the texts, packed. Rows come by their smaller document, whose index serves for all that follow."""
    both = pairs.join(held.select(F.col("doc_id").alias("b"), F.col("packed").alias("text_b")), "b").join(held.select(F.col("doc_id").alias("a"), F.col("packed").alias("text_a")), "a")

    def indexes(batch: pa.RecordBatch, ids: list[int], held_id: int | None) -> Iterator[Indexed]:
        """The indexes of the smaller documents of a batch's rows, one whenever another follows."""
        new = [k for k, (before, now) in enumerate(zip([held_id, *ids], ids)) if now != before]  # noqa: B905
        for _, texts_ in unpacked_rows(batch.take(pa.array(new, pa.int64())), (4,), SLICE_BYTES):
            y, bounds = shingles(*texts_[0])
            for k in range(len(bounds) - 1):
                yield Indexed(y[bounds[k] : bounds[k + 1]])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, index = None, None
        for batch in batches:
            got: list[tuple] = []
            ids = [batch.column(k).to_pylist() for k in range(2)]
            seeds = np.stack([k.to_numpy() for k in batch.column(2).flatten().flatten()], axis=1)
            of = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            others = indexes(batch, ids[0], held_id)
            for first, texts_ in unpacked_rows(batch, (3,), SLICE_BYTES):
                x, bounds = shingles(*texts_[0])
                for k in range(len(bounds) - 1):
                    row = first + k
                    if ids[0][row] != held_id:
                        held_id, index = ids[0][row], next(others)
                    got += [(ids[1][row], s, e, held_id, t, u) for s, e, t, u in passages(x[bounds[k] : bounds[k + 1]], index, seeds[of[row] : of[row + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(6)], names=["doc_id", "start", "end", "other_id", "other_start", "other_end"])

    return both.select("a", "b", "seeds", "text_b", "text_a").mapInArrow(confirm, "doc_id long, start long, end long, other_id long, other_start long, other_end long")


def with_seeds(rows: DataFrame) -> DataFrame:
    """(a, b, seeds) of places that agree (a, b, ma, mb): for each distance the first and the last place in b."""
    each = rows.repartition("a", "b").groupBy("a", "b", (F.col("ma") - F.col("mb")).alias("shift")).agg(F.min("mb").alias("low"), F.max("mb").alias("high"))
    return each.groupBy("a", "b").agg(F.collect_list(F.struct("shift", "low", "high")).alias("seeds"))
