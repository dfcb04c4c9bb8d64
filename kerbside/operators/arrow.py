"""Sorted Arrow batches in tasks: runs of equal keys, whole, whatever batch their rows came in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _changes(keys: list[np.ndarray]) -> np.ndarray:
    """Where a row's keys differ from those of the row before."""
    changed = np.zeros(len(keys[0]) - 1, bool)
    for c in keys:
        differs = c[1:] != c[:-1]
        if c.dtype.kind == "f":  # a null is equal to a null
            differs &= ~(np.isnan(c[1:]) & np.isnan(c[:-1]))
        changed |= differs
    return np.flatnonzero(changed) + 1


def run_starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.concatenate(([0], _changes(keys))) if len(keys[0]) else np.zeros(0, int)


def whole_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, edges): batches that end where a run of equal values in the first n_keys columns ends; edges are where runs begin, and the end."""
    held: list[np.ndarray] = []
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        now = [np.concatenate(x) for x in zip(held, now)] if held else now
        if not len(now[0]):
            continue
        edges = run_starts(now[:n_keys])
        if len(edges) > 1:
            yield [c[: edges[-1]] for c in now], edges
        held = [c[edges[-1] :] for c in now]
    if held and len(held[0]):
        yield held, np.array([0, len(held[0])])


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(keys, the other columns) of each run."""
    plain = lambda x: x.item() if hasattr(x, "item") else x
    for columns, edges in whole_runs(batches, n_keys):
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield tuple(plain(c[a]) for c in columns[:n_keys]), [c[a:b] for c in columns[n_keys:]]


def ranges_of(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the numbers starts[k] .. starts[k] + counts[k] - 1, beside k, in two arrays."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of]
