"""The tracker for many stretches of cameras at once: each step of numpy does the next frame of all of them.

A lane is a stretch: a slice, a segment, or a camera's frames in a micro-batch. Lanes know nothing of each other, and a lane's rows are, bit by bit, those of
``tracker.CameraTracker`` over the same frames. Live tracks are slots of columns; ``tracked`` and ``lost`` hold slots by lane, and within a lane in the order that the tracker keeps.
"""

from __future__ import annotations

import numpy as np

from kerbside.operators import kalman
from kerbside.operators.arrow import ranges_of
from kerbside.operators.assignment import solve

IDS = 65536  # ids wrap here

#: Pairs of boxes that are compared at once.
PAIRS = 1_000_000


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - IoU of tlwh boxes side by side, pixels counted whole."""
    side = np.maximum(0, np.minimum(a[..., :2] + a[..., 2:], b[..., :2] + b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]) + 1)
    inter = side[..., 0] * side[..., 1]
    area = lambda x: (x[..., 2] + 1) * (x[..., 3] + 1)
    return 1 - inter / (area(a) + area(b) - inter)


def near_pairs(lane_a: np.ndarray, a: np.ndarray, lane_b: np.ndarray, b: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), in order, of boxes of the same lane whose distance ``near`` says yes to; lanes ascend."""
    none = np.zeros(0, int)
    if not len(a) or not len(b):
        return none, none
    first = np.searchsorted(lane_b, lane_a)
    counts = np.searchsorted(lane_b, lane_a, "right") - first
    upto = np.cumsum(counts)
    found, at = [], 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        i, j = ranges_of(first[at:end], counts[at:end])
        i += at
        yes = near(distances(a[i], b[j]))
        found.append((i[yes], j[yes]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0]


def matched(lane_a: np.ndarray, a: np.ndarray, lane_b: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), in order, of each lane's best assignment: those closer than limit where nobody has a choice, else the solver's."""
    i, j = near_pairs(lane_a, a, lane_b, b, lambda dist: limit - dist.astype(float) > 0)
    if not len(i):
        return i, j
    choice = (np.bincount(i, minlength=len(a)) > 1)[i] | (np.bincount(j, minlength=len(b)) > 1)[j]
    if not choice.any():
        return i, j
    lanes = np.unique(lane_a[i[choice]])
    sure = ~np.isin(lane_a[i], lanes)
    parts = [(i[sure], j[sure])]
    for lane in lanes.tolist():
        (a0, a1), (b0, b1) = (np.searchsorted(x, (lane, lane + 1)) for x in (lane_a, lane_b))
        pairs = np.array(solve(limit - distances(a[a0:a1, None], b[None, b0:b1]).astype(float)), int).reshape(-1, 2)
        parts.append((pairs[:, 0] + a0, pairs[:, 1] + b0))
    i, j = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


class _Slots:
    """Columns of live tracks; a slot is free again when its track is gone."""

    COLUMNS = {"id": (int, ()), "start": (int, ()), "nth": (int, ()), "last": (int, ()), "score": (float, ()), "cls": (int, ()), "confirmed": (bool, ()), "tracked": (bool, ()), "lock": (bool, ()), "pointed": (bool, ()),
               "boxed": (bool, ()), "det": (float, (4,)), "points": (int, ()), "gate": (float, ()), "kf": (np.float32, (6, 4)), "used": (int, ()), "labels": (int, (4,)), "hits": (int, (4,))}

    def __init__(self) -> None:
        self.free = np.zeros(0, int)
        for name, (kind, shape) in self.COLUMNS.items():
            setattr(self, name, np.zeros((0, *shape), kind))

    def take(self, n: int) -> np.ndarray:
        if n > len(self.free):
            size = len(self.id)
            more = max(n, size, 64)
            for name in self.COLUMNS:
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros((more, *old.shape[1:]), old.dtype))))
            self.free = np.concatenate((self.free, np.arange(size, size + more)))
        found, self.free = self.free[:n], self.free[n:]
        for name in ("confirmed", "lock", "pointed", "boxed"):
            getattr(self, name)[found] = False
        self.tracked[found], self.gate[found] = True, np.nan
        for name in ("points", "used", "labels", "hits"):
            getattr(self, name)[found] = 0
        return found

    def give(self, slots: np.ndarray) -> None:
        self.free = np.concatenate((self.free, slots))

    def vote(self, t: np.ndarray, frame: np.ndarray, label: np.ndarray, score: np.ndarray) -> None:
        """Each of these tracks gets a vote for its class, as by CameraTracker._vote."""
        own = lambda t: np.where(self.labels[t] == self.cls[t][:, None], self.hits[t], 0).sum(axis=1)
        counts = ~self.lock[t]
        counts[counts] = (score[counts] > 0.7) | (frame[counts] - self.start[t[counts]] <= 5) | (own(t[counts]) < 3)
        t, label, score = t[counts], label[counts], score[counts]
        if not len(t):
            return
        same = (self.labels[t] == label[:, None]) & (self.hits[t] > 0)
        known = same.any(axis=1)
        at = np.where(known, same.argmax(axis=1), self.used[t])
        while at.max() >= self.labels.shape[1]:
            self.labels, self.hits = (np.concatenate((x, np.zeros_like(x)), axis=1) for x in (self.labels, self.hits))
        self.labels[t, at] = label
        self.hits[t, at] += np.where(score > 0.8, 2, 1)
        self.used[t] += ~known
        hits = self.hits[t]
        top = hits.max(axis=1)
        best = np.where(hits == top[:, None], self.labels[t], np.iinfo(int).max).min(axis=1)
        turned = (best != self.cls[t]) & (top >= own(t) + 2)
        self.cls[t[turned]] = best[turned]
        self.lock[t] = top > 8


def by_lane(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, lanes) of parts of such, by lane and within a lane in the order of the parts."""
    slots, lanes = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(lanes, kind="stable")
    return slots[order], lanes[order]


class Lockstep:
    """n lanes. frame: of each the last frame that is done; border: rows are put out from this frame on, and the state there is kept (-1: from the first on); until: the frame before
    which a lane ends. ``put`` is called with (lane, frame, slots, pointed, removed) of rows, ``border_at`` and ``ended`` with lanes: their state is then what ``state`` says."""

    def __init__(self, params, frame: np.ndarray, border: np.ndarray, until: np.ndarray, put, issued, border_at=None, ended=None) -> None:
        self.params, self.frame, self.border, self.until = params, frame.copy(), border, until
        self.put, self.issued, self.border_at, self.ended = put, issued, border_at, ended
        n = len(frame)
        self.own, self.done, self.next_id = border < 0, np.zeros(n, bool), np.zeros(n, int)
        self.s, none = _Slots(), np.zeros(0, int)
        self.tracked, self.tracked_lane, self.lost, self.lost_lane = none, none, none, none

    def resume(self, lane: int, state: list, next_id: int) -> None:
        """A lane goes on with these live tracks (rows of tracker.STATE); call by ascending lanes."""
        s, t = self.s, self.s.take(len(state))
        for k, row in zip(t.tolist(), state):
            place, key, start, nth, last, score, cls, confirmed, tracked, labels, counts, lock, box, points, gate, mean, cov = row
            s.id[k], s.start[k], s.nth[k], s.last[k], s.score[k], s.cls[k] = key, start, nth, last, score, cls
            s.confirmed[k], s.tracked[k], s.lock[k], s.boxed[k], s.points[k] = confirmed, tracked, lock, box is not None, points
            s.det[k] = 0 if box is None else box
            s.gate[k] = np.nan if gate is None else gate
            s.kf[k] = kalman.of_matrix(np.array(mean, np.float32), np.array(cov, np.float32).reshape(8, 8))
            while len(labels) > s.labels.shape[1]:
                s.labels, s.hits = (np.concatenate((x, np.zeros_like(x)), axis=1) for x in (s.labels, s.hits))
            s.used[k], s.labels[k, : len(labels)], s.hits[k, : len(labels)] = len(labels), labels, counts
        lost = np.array([row[0] for row in state], int) == 1
        at = lambda t: (t, np.full(len(t), lane))
        self.tracked, self.tracked_lane = by_lane((self.tracked, self.tracked_lane), at(t[~lost]))
        self.lost, self.lost_lane = by_lane((self.lost, self.lost_lane), at(t[lost]))
        self.next_id[lane] = next_id

    def state(self, lane: int) -> list[tuple]:
        """A lane's live tracks as rows of tracker.STATE."""
        found, s = [], self.s
        for place, slots, lanes in ((0, self.tracked, self.tracked_lane), (1, self.lost, self.lost_lane)):
            for k in slots[slice(*np.searchsorted(lanes, (lane, lane + 1)))].tolist():
                mean, cov = kalman.as_matrix(s.kf[k])
                hits = sorted(zip(s.labels[k, : s.used[k]].tolist(), s.hits[k, : s.used[k]].tolist()))
                gate = None if np.isnan(s.gate[k]) else float(s.gate[k])
                box = s.det[k].tolist() if s.boxed[k] else None
                found.append((place, int(s.id[k]), int(s.start[k]), int(s.nth[k]), int(s.last[k]), float(s.score[k]), int(s.cls[k]), bool(s.confirmed[k]), bool(s.tracked[k]), [x for x, _ in hits], [n for _, n in hits], bool(s.lock[k]), box, int(s.points[k]), gate, mean.tolist(), cov.ravel().tolist()))
        return found

    def live(self) -> np.ndarray:
        """Live tracks by lane."""
        n = len(self.frame)
        return np.bincount(self.tracked_lane, minlength=n) + np.bincount(self.lost_lane, minlength=n)

    def run(self, lane: np.ndarray, frame: np.ndarray, tlwh: np.ndarray, scores: np.ndarray, labels: np.ndarray, more: np.ndarray | None = None) -> None:
        """Detections by lane and frame, all of them later than what is done. more: lanes that stop after their last detection, as there are more to come."""
        far = np.iinfo(int).max
        new = np.ones(len(lane), bool)
        new[1:] = (lane[1:] != lane[:-1]) | (frame[1:] != frame[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(lane)))
        when = np.append(frame[begin], far)  # of each run of a lane's frame
        at, end = (np.searchsorted(lane[begin], np.arange(len(self.frame)), side) for side in ("left", "right"))
        boxes, labels = tlwh.astype(np.float32), labels.astype(int)
        with np.errstate(all="ignore"):
            while True:
                coming = np.where(at < end, when[at], far)
                going = ~self.done
                if more is not None:
                    going &= ~more | (at < end)
                on = np.flatnonzero(going)
                if not len(on):
                    return
                stop = np.where(self.own, self.until, self.border)
                next_ = np.where(self.live() > 0, self.frame + 1, np.minimum(coming, stop))
                stopped = on[next_[on] >= stop[on]]
                if len(stopped):
                    self._stop(stopped)
                    continue
                stepping = np.zeros(len(self.frame), bool)
                stepping[on] = True
                self.frame[on] = next_[on]
                seen = on[coming[on] == next_[on]]
                of, rows = ranges_of(begin[at[seen]], count[at[seen]])
                at[seen] += 1
                self._step(seen[of], tlwh[rows], boxes[rows], scores[rows], labels[rows], stepping if len(on) < len(self.frame) else None)

    def _stop(self, lanes: np.ndarray) -> None:
        first = lanes[~self.own[lanes]]
        if len(first):
            self.border_at(first)
            self.own[first] = True
        last = lanes[~np.isin(lanes, first)]
        if len(last):
            if self.ended is not None:
                self.ended(last)
            self.done[last] = True
            gone = [self.done[x] for x in (self.tracked_lane, self.lost_lane)]
            self.s.give(np.concatenate((self.tracked[gone[0]], self.lost[gone[1]])))
            self.tracked, self.tracked_lane, self.lost, self.lost_lane = self.tracked[~gone[0]], self.tracked_lane[~gone[0]], self.lost[~gone[1]], self.lost_lane[~gone[1]]

    def _take(self, t: np.ndarray, lanes: np.ndarray, tlwh: np.ndarray, score: np.ndarray) -> None:
        s = self.s
        s.kf[t], s.gate[t] = kalman.updated(s.kf[t], kalman.xyah_of(tlwh))
        s.tracked[t] = s.confirmed[t] = True
        s.last[t], s.score[t] = self.frame[lanes], score

    def _pointed(self, t: np.ndarray, lanes: np.ndarray, tlwh: np.ndarray, score: np.ndarray, label: np.ndarray) -> None:
        s = self.s
        s.det[t], s.boxed[t] = tlwh, True
        s.vote(t, self.frame[lanes], label, score)
        s.points[t] += 1
        s.pointed[t] = True

    def _step(self, lane: np.ndarray, tlwh: np.ndarray, boxes: np.ndarray, scores: np.ndarray, labels: np.ndarray, only: np.ndarray | None) -> None:
        """A frame of each stepping lane (only; None: all), in the order of CameraTracker.step."""
        p, s = self.params, self.s
        rest = None
        if only is not None:  # tracks of lanes that wait
            a, b = only[self.tracked_lane], only[self.lost_lane]
            if not (a.all() and b.all()):
                rest = self.tracked[~a], self.tracked_lane[~a], self.lost[~b], self.lost_lane[~b]
                self.tracked, self.tracked_lane, self.lost, self.lost_lane = self.tracked[a], self.tracked_lane[a], self.lost[b], self.lost_lane[b]
        high, low = np.flatnonzero(scores >= p.track_thresh), np.flatnonzero(scores < p.track_thresh)
        sure = s.confirmed[self.tracked]
        unconfirmed, unconfirmed_lane = self.tracked[~sure], self.tracked_lane[~sure]
        pool, pool_lane = by_lane((self.tracked[sure], self.tracked_lane[sure]), (self.lost, self.lost_lane))
        s.kf[self.lost, 1, 3] = 0
        state = s.kf[pool]
        before = kalman.tlwh_of(state)  # of the last update: predicting doesn't move what is matched
        s.kf[pool] = kalman.predicted(state)

        i, j = matched(pool_lane, before, lane[high], boxes[high], p.match_thresh)
        t, k = pool[i], high[j]
        was = s.tracked[t]
        self._take(t, lane[k], tlwh[k], scores[k])
        own = k[was]
        self._pointed(t[was], lane[own], tlwh[own], scores[own], labels[own])
        refound = t[~was], lane[k[~was]]  # a found track was copied before the frame's box, vote and point
        alone, free = np.ones(len(pool), bool), np.ones(len(high), bool)
        alone[i], free[j] = False, False
        left = high[free]
        again = np.flatnonzero(alone & s.tracked[pool])
        i, j = matched(pool_lane[again], before[again], lane[low], boxes[low], p.second_thresh)
        t, k = pool[again[i]], low[j]
        self._take(t, lane[k], tlwh[k], scores[k])
        self._pointed(t, lane[k], tlwh[k], scores[k], labels[k])
        alone = np.ones(len(again), bool)
        alone[i] = False
        newly = again[alone]
        s.tracked[pool[newly]] = False
        i, j = matched(unconfirmed_lane, kalman.tlwh_of(s.kf[unconfirmed]), lane[left], boxes[left], p.unconfirmed_thresh)
        self._take(unconfirmed[i], lane[left[j]], tlwh[left[j]], scores[left[j]])
        alone, free = np.ones(len(unconfirmed), bool), np.ones(len(left), bool)
        alone[i], free[j] = False, False
        gone, gone_lane = unconfirmed[alone], unconfirmed_lane[alone]
        s.tracked[gone] = False
        fresh = self._fresh(left[free], lane, tlwh, scores, labels)

        lost = ~s.tracked[self.lost]
        expired = lost & (self.frame[self.lost_lane] - s.last[self.lost] > p.max_time_lost)
        removed, removed_lane = by_lane((gone, gone_lane), (self.lost[expired], self.lost_lane[expired]))
        stays = s.tracked[self.tracked]
        self.tracked, self.tracked_lane = by_lane((self.tracked[stays], self.tracked_lane[stays]), fresh, refound)
        stays = lost & ~expired
        slots, lanes = np.concatenate((self.lost[stays], pool[newly])), np.concatenate((self.lost_lane[stays], pool_lane[newly]))
        order = np.lexsort((s.id[slots], lanes))
        self.lost, self.lost_lane = slots[order], lanes[order]
        self._dedupe()
        size = kalman.tlwh_of(s.kf[self.tracked])
        shown = self.own[self.tracked_lane] & (size[:, 2] * size[:, 3] > p.min_box_area)
        out, out_lane = self.tracked[shown], self.tracked_lane[shown]
        if len(out):
            self.put(out_lane, self.frame[out_lane], out, s.pointed[out], False)
        s.pointed[self.tracked] = False
        shown = self.own[removed_lane]
        if shown.any():
            self.put(removed_lane[shown], self.frame[removed_lane[shown]], removed[shown], np.zeros(int(shown.sum()), bool), True)
        s.give(removed)
        if rest is not None:
            self.tracked, self.tracked_lane = by_lane((self.tracked, self.tracked_lane), rest[:2])
            self.lost, self.lost_lane = by_lane((self.lost, self.lost_lane), rest[2:])

    def _fresh(self, k: np.ndarray, lane: np.ndarray, tlwh: np.ndarray, scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tracks that begin with detections k."""
        if not len(k):
            return k, k
        s, t, of = self.s, self.s.take(len(k)), lane[k]
        begun = np.unique(of, return_counts=True)
        s.nth[t] = np.arange(len(k)) - np.searchsorted(of, of)
        s.id[t] = (self.next_id[of] + s.nth[t]) % IDS
        s.start[t] = s.last[t] = self.frame[of]
        s.score[t], s.cls[t], s.confirmed[t] = scores[k], labels[k], self.frame[of] == 1
        s.kf[t] = kalman.started(kalman.xyah_of(tlwh[k]))
        self.next_id[begun[0]] = (self.next_id[begun[0]] + begun[1]) % IDS
        own = self.own[begun[0]]
        self.issued(begun[0][own], self.frame[begun[0][own]], begun[1][own])
        return t, of

    def _dedupe(self) -> None:
        if not len(self.tracked) or not len(self.lost):
            return
        s = self.s
        limit = self.params.duplicate_dist
        i, j = near_pairs(self.tracked_lane, kalman.tlwh_of(s.kf[self.tracked]), self.lost_lane, kalman.tlwh_of(s.kf[self.lost]), lambda dist: dist < limit)
        if not len(i):
            return
        a, b = self.tracked[i], self.lost[j]
        older = s.last[a] - s.start[a] > s.last[b] - s.start[b]
        stay_a, stay_b = np.ones(len(self.tracked), bool), np.ones(len(self.lost), bool)
        stay_a[i[~older]], stay_b[j[older]] = False, False
        s.pointed[self.tracked[~stay_a]] = False
        s.give(np.concatenate((self.tracked[~stay_a], self.lost[~stay_b])))
        self.tracked, self.tracked_lane = self.tracked[stay_a], self.tracked_lane[stay_a]
        self.lost, self.lost_lane = self.lost[stay_b], self.lost_lane[stay_b]
