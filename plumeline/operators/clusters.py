"""Clusters of grid cells by greedy bisection: the state's size, so arrays on the driver."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
from pyspark.sql import DataFrame


def clusterize(field: np.ndarray, n: int, mask: np.ndarray | None = None, least: tuple[int, int] = (1, 1)) -> np.ndarray:
    """A cluster number for each cell (-1 where masked), of at most about n clusters.

    The cluster with the greatest absolute sum is halved across its longer side, again and
    again; a square one on the side whose halves are more alike, and at an odd side the middle
    line goes to the half that makes them more alike. A side of the least length (rows, columns)
    isn't cut while the other is longer. Parts of a cluster that the mask has cut apart become
    clusters of their own, so there can be a few more.
    """
    mask = np.ones(field.shape, bool) if mask is None else mask.astype(bool)
    n = min(n, int(mask.sum()))
    boxes: dict[int, np.ndarray] = {}
    heap: list[tuple[float, int]] = []
    made = 0

    def add(cells: np.ndarray) -> None:
        nonlocal made
        boxes[made] = cells
        heapq.heappush(heap, (-abs(field[cells[:, 0], cells[:, 1]].sum()) if len(cells) > 1 else 1.0, made))
        made += 1

    for part in connected(np.argwhere(mask)):
        add(part)
    while len(boxes) < n and heap and heap[0][0] <= 0:
        _, k = heapq.heappop(heap)
        halves = halved(field, boxes.pop(k), least)
        for half in halves:
            for part in connected(half):
                add(part)
    out = np.full(field.shape, -1)
    for number, k in enumerate(sorted(boxes)):
        out[boxes[k][:, 0], boxes[k][:, 1]] = number
    return out


def halved(field: np.ndarray, cells: np.ndarray, least: tuple[int, int] = (1, 1)) -> tuple[np.ndarray, np.ndarray]:
    size = np.ptp(cells, axis=0) + 1
    cut = [k for k in (0, 1) if size[k] > 1]
    free = [k for k in cut if size[k] != least[k]] or cut
    if len(free) == 2 and size[0] != size[1]:
        free = [int(np.argmax(size))]
    return min((split(field, cells, k) for k in free), key=lambda w: unlike(field, *w))


def unlike(field: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    return abs(field[a[:, 0], a[:, 1]].sum() - field[b[:, 0], b[:, 1]].sum())


def split(field: np.ndarray, cells: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """At the middle of the side; of an odd side the middle line goes where it balances better. Both parts have cells."""
    values = cells[:, axis]
    low, side = values.min(), np.ptp(values) + 1
    ways = [(cells[values < k], cells[values >= k]) for k in dict.fromkeys((low + side // 2, low + (side + 1) // 2))]
    return min((w for w in ways if len(w[0]) and len(w[1])), key=lambda w: unlike(field, *w))


def connected(cells: np.ndarray) -> list[np.ndarray]:
    """Parts whose cells touch along sides."""
    left = set(map(tuple, cells.tolist()))
    out = []
    while left:
        queue, part = deque([left.pop()]), []
        while queue:
            y, x = queue.popleft()
            part.append((y, x))
            for near in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if near in left:
                    left.remove(near)
                    queue.append(near)
        out.append(np.array(sorted(part)))
    return sorted(out, key=lambda p: tuple(p[0]))


def cluster_rows(cells: DataFrame, n: int, value: str, mask: str | None = None) -> DataFrame:
    """icell, ipos of a grid's cells (ilat, ilon, icell, a value to balance, and where there is a mask, whether they count)."""
    rows = cells.select("ilat", "ilon", "icell", value, *([mask] if mask else [])).collect()
    shape = max(r["ilat"] for r in rows) + 1, max(r["ilon"] for r in rows) + 1
    field, ok, number = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, np.int64)
    for r in rows:
        at = r["ilat"], r["ilon"]
        field[at], number[at], ok[at] = r[value], r["icell"], bool(r[mask]) if mask else True
    found = clusterize(field, n, ok)
    made = [(int(number[y, x]), int(found[y, x])) for y, x in np.argwhere(found >= 0)]
    return cells.sparkSession.createDataFrame(made, "icell int, ipos int")
