"""Optimal one-to-one assignment with a cost limit: a join that keeps only cheap enough pairs, and an exact solver for what stays ambiguous."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kerbside.operators.arrow import whole_runs
from kerbside.operators.detections import FRAME
from kerbside.operators.pairs import SHUFFLED, iou_pairs


def solve(gain: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of greatest total gain; only positive gains are taken. Shortest augmenting paths with potentials."""
    n, m = gain.shape
    if not n or not m:
        return []
    cost = np.zeros((n, m + n))  # a column of its own for each row: staying alone costs nothing
    cost[:, :m] = -np.maximum(gain, 0)
    width = m + n
    of_row, of_column = np.zeros(n + 1), np.zeros(width + 1)
    row_of, way = np.zeros(width + 1, int), np.zeros(width + 1, int)
    for row in range(1, n + 1):
        row_of[0], column = row, 0
        least, used = np.full(width + 1, np.inf), np.zeros(width + 1, bool)
        while True:
            used[column] = True
            r = row_of[column]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[r - 1, free - 1] - of_row[r] - of_column[free]
            closer = reduced < least[free]
            least[free[closer]], way[free[closer]] = reduced[closer], column
            nearest = free[np.argmin(least[free])]
            delta = least[nearest]
            of_row[row_of[used]] += delta
            of_column[used] -= delta
            least[free] -= delta
            column = nearest
            if not row_of[column]:
                break
        while column:
            row_of[column] = row_of[way[column]]
            column = way[column]
    return sorted((row_of[c] - 1, c - 1) for c in range(1, m + 1) if row_of[c] and gain[row_of[c] - 1, c - 1] > 0)


def components(at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """For each pair of (row, column) numbers the component of the bipartite graph that it is in, as its smallest row."""
    low, before = at_a.copy(), None
    of_a, of_b = np.arange(at_a.max() + 1), np.full(at_b.max() + 1, at_a.max() + 1)
    while before is None or (low != before).any():
        before = low
        np.minimum.at(of_b, at_b, low)
        np.minimum.at(of_a, at_a, of_b[at_b])
        low = of_a[at_a]
    return low


def _numbers(frame: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A number for each row, equal where frame and id are."""
    by = np.lexsort((ids, frame))
    new = (frame[by][1:] != frame[by][:-1]) | (ids[by][1:] != ids[by][:-1])
    found = np.empty(len(by), int)
    found[by] = np.concatenate(([0], np.cumsum(new)))
    return found


def _small(part: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(taken, open), by row: components with a single box on a side take their best pair, those of two and two boxes the better of both ways to pair them; larger ones are open.
    part: ascending numbers from 0."""
    def first_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row whether it has its component's smallest number, and for each component how many numbers it has."""
        low = np.full(part[-1] + 1, at.max() + 1)
        np.minimum.at(low, part, at)
        return at == low[part], np.bincount(part[np.unique(at, return_index=True)[1]], minlength=part[-1] + 1)

    first_a, n_a = first_of(at_a)
    first_b, n_b = first_of(at_b)
    single, square = (np.minimum(n_a, n_b) == 1)[part], ((n_a == 2) & (n_b == 2))[part]
    best = np.lexsort((-gain, part))
    best = best[np.concatenate(([True], part[best][1:] != part[best][:-1]))]
    taken = np.zeros(len(gain), bool)
    taken[best] = True
    straight = first_a == first_b
    sums = [np.bincount(part, gain * way, part[-1] + 1) for way in (straight, ~straight)]
    return np.where(square, straight == (sums[0] >= sums[1])[part], taken & single), ~(single | square)


def settled(frame: np.ndarray, a_id: np.ndarray, b_id: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Which pairs (of positive gain) are taken: each frame's components solved for themselves, small ones all at once, the others one by one."""
    at_a, at_b = _numbers(frame, a_id), _numbers(frame, b_id)
    part = np.unique(components(at_a, at_b), return_inverse=True)[1]
    order = np.argsort(part, kind="stable")
    part, at_a, at_b, gain = part[order], at_a[order], at_b[order], gain[order]
    taken = np.zeros(len(gain), bool)
    found, left = _small(part, at_a, at_b, gain)
    taken[order] = found
    at = np.flatnonzero(left)
    for rows in np.split(at, np.flatnonzero(np.diff(part[at])) + 1) if len(at) else []:
        i, j = (np.unique(x[rows], return_inverse=True)[1] for x in (at_a, at_b))
        small, row = np.zeros((i.max() + 1, j.max() + 1)), np.zeros((i.max() + 1, j.max() + 1), int)
        small[i, j], row[i, j] = gain[rows], rows
        taken[order[[row[x] for x in solve(small)]]] = True
    return taken


def assign_boxes(a: DataFrame, b: DataFrame, id_col: str, limit: float, keys: tuple[str, ...] = FRAME) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches: keys, a_id, b_id, iou; unmatched a; unmatched b): the sum of (1 - iou - limit) over the pairs is least.

    Pairs that are both sides' only choice match at once. What is ambiguous goes in sorted Arrow batches of whole frames to numpy, which settles all connected components with a single box
    on a side, or two on both, together; the solver gets the others, one at a time: its matrix is as large as a cluster of boxes, not as a frame.
    """
    near = iou_pairs(a, b, id_col, keys).filter(1 - F.col("iou") < limit)
    alone = near.withColumns({"of_a": F.count("*").over(Window.partitionBy(*keys, "a_id")), "of_b": F.count("*").over(Window.partitionBy(*keys, "b_id"))})
    sure = (F.col("of_a") == 1) & (F.col("of_b") == 1)
    schema, n_keys = near.schema, len(keys)

    def run(batches):
        for columns, edges in whole_runs(batches, n_keys):
            a_id, b_id, overlap = columns[n_keys:]
            taken = settled(np.repeat(np.arange(len(edges) - 1), np.diff(edges)), a_id, b_id, limit - 1 + overlap)
            yield pa.RecordBatch.from_arrays([pa.array(c[taken], f.type) for c, f in zip(columns, arrow)], schema=arrow)

    arrow = to_arrow_schema(schema)
    hard = alone.filter(~sure).drop("of_a", "of_b").repartition(*keys).sortWithinPartitions(*keys, "a_id", "b_id").mapInArrow(run, schema)
    matches = alone.filter(sure).drop("of_a", "of_b").unionByName(hard)
    rest = lambda df, side: df.join(matches.select(*keys, F.col(f"{side}_id").alias(id_col)).hint(SHUFFLED), [*keys, id_col], "left_anti")
    return matches, rest(a, "a"), rest(b, "b")
