"""Prediction by partial matching over bytes, on arrays: the trie is one sorted array of grams for each order.

A gram of order k is k context bytes and the byte after them, packed into a long. A text is framed by byte 0xFF (which
UTF-8 never has): ``order`` of them before it, one after it. Escape estimation is method C; symbols seen in the context that escaped are excluded
below it. As a context's symbols are a subset of those of its suffix, what is excluded depends on the longer context alone and is summed up once.
"""

from __future__ import annotations

import numpy as np

EDGE = 0xFF
#: Symbols that the last resort, order -1, is uniform over: all bytes.
SYMBOLS = 256


def grams(framed: np.ndarray, order: int) -> np.ndarray:
    """The gram of each byte but the first ``order``."""
    n = len(framed) - order
    code = np.zeros(max(n, 0), np.int64)
    for k in range(order + 1):
        code <<= 8
        code |= framed[k : k + n]
    return code


def counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and how often each occurs (or its summed weight)."""
    if weights is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, weights = codes[order], weights[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    n = np.diff(np.append(starts, len(codes))) if weights is None else np.add.reduceat(weights, starts) if len(starts) else np.zeros(0, np.int64)
    return codes[starts], n.astype(np.int64)


def frame(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts framed, in one array, and the number of bytes of each with its end."""
    head, tail = bytes([EDGE]) * order, bytes([EDGE])
    joined = b"".join(x for t in texts for x in (head, t, tail))
    return np.frombuffer(joined, np.uint8), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))


def text_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the texts' bytes and ends, one text after the other, and their number for each text."""
    framed, sizes = frame(texts, order)
    every = grams(framed, order)
    if len(texts) > 1:  # those that begin in one text and end in the head of the next are no grams of a text
        keep = np.ones(len(every), bool)
        ends = np.cumsum(sizes + order)[:-1]
        for k in range(order):
            keep[ends - order + k] = False
        every = every[keep]
    return every, sizes


class Model:
    """counts: for each order, from 0 up, (sorted grams, counts)."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.order = len(counts) - 1
        self.grams = [g for g, _ in counts]
        self.log_count = [np.log10(n) for _, n in counts]
        self.contexts: list[np.ndarray] = []
        self.log_all: list[np.ndarray] = []  # log10(n + d), where the search begins at this context
        self.log_escape: list[np.ndarray] = []
        self.log_all_below: list[np.ndarray] = []  # the same for the next shorter context, after this one escaped
        self.log_escape_below: list[np.ndarray] = []
        before = None
        for k, (g, n) in enumerate(counts):
            context = g >> 8
            starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(g) else np.zeros(0, np.int64)
            context = context[starts]
            total = np.add.reduceat(n, starts) if len(starts) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(starts, len(g)))
            self.contexts.append(context)
            self.log_all.append(np.log10(np.maximum(total + kinds, 1)))
            self.log_escape.append(np.log10(np.maximum(kinds, 1)) - self.log_all[-1])
            if k:
                lower_g, lower_n, lower_context, lower_total, lower_kinds = before
                at = np.searchsorted(lower_g, g & ((1 << 8 * k) - 1))
                hit = np.append(lower_g, -1)[at] == g & ((1 << 8 * k) - 1)
                seen = np.where(hit, np.append(lower_n, 0)[at], 0)
                parent = np.searchsorted(lower_context, context & ((1 << 8 * (k - 1)) - 1) if k > 1 else np.zeros(len(context), np.int64))
                rest = np.append(lower_total, 0)[parent] - np.add.reduceat(seen, starts) if len(starts) else np.zeros(0, np.int64)
                left = np.append(lower_kinds, 0)[parent] - (np.add.reduceat(hit.astype(np.int64), starts) if len(starts) else 0)
            else:
                rest, left = np.zeros(len(context), np.int64), np.maximum(SYMBOLS - kinds, 0)
            whole = np.maximum(rest + left, 1)
            self.log_all_below.append(np.log10(whole))
            self.log_escape_below.append(np.where(left > 0, np.log10(np.maximum(left, 1)) - np.log10(whole), 0.0))
            before = (g, n, context, total, kinds)
        for logs in (self.log_count, self.log_all, self.log_escape, self.log_all_below, self.log_escape_below):
            logs[:] = [x.astype(np.float32) for x in logs]

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each (distinct, sorted) gram after the bytes before it."""
        out = np.zeros(len(codes))
        rest = np.arange(len(codes))
        child = np.full(len(codes), -1)  # the context, one longer, that has escaped
        for k in range(self.order, -1, -1):
            code = codes[rest] & ((1 << 8 * (k + 1)) - 1)
            at = np.searchsorted(self.grams[k], code)
            hit = np.append(self.grams[k], -1)[at] == code
            began = child < 0
            below_all = self.log_all_below[k + 1] if k < self.order else np.zeros(1)
            below_escape = self.log_escape_below[k + 1] if k < self.order else np.zeros(1)
            context = code >> 8
            where = np.searchsorted(self.contexts[k], context)
            seen = np.append(self.contexts[k], -1)[where] == context
            own_all = np.append(self.log_all[k], 0.0)[where]
            own_escape = np.append(self.log_escape[k], 0.0)[where]
            whole = np.where(began, own_all, np.append(below_all, 0.0)[child])
            out[rest[hit]] += np.append(self.log_count[k], 0.0)[at][hit] - whole[hit]
            gone = ~hit
            escape = np.where(seen, np.where(began, own_escape, np.append(below_escape, 0.0)[child]), 0.0)
            out[rest[gone]] += escape[gone]
            child = np.where(seen, where, child)[gone] if k else np.where(seen, where, -1)[gone]
            rest = rest[gone]
        if len(rest):
            kinds = len(self.grams[0])
            out[rest] -= np.log10(max(SYMBOLS - kinds, 1))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        codes, sizes = text_grams(texts, self.order)
        if not len(codes):
            return np.zeros(len(texts))
        order = np.argsort(codes)
        ranked = codes[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        values = self.log10(ranked[first])
        each = np.empty(len(codes))
        each[order] = values[np.cumsum(first) - 1]
        return np.add.reduceat(each, np.concatenate(([0], np.cumsum(sizes)[:-1])))
