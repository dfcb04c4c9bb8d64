"""Lanes side by side against one tracker after another, bit by bit."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kerbside.operators import kalman, tracker
from kerbside.operators.lockstep import Lockstep
from kerbside.streaming import monitors
from tests.test_operators import busy


def crowd(seed, frames, wide, n=12):
    """Boxes of all sizes that cross, jump and vanish, in a small place."""
    rng, rows = random.Random(seed), []
    at = [[rng.uniform(0, wide), rng.uniform(0, wide), rng.uniform(2, 90), rng.uniform(2, 90), rng.uniform(-4, 4), rng.uniform(-4, 4)] for _ in range(n)]
    for f in range(1 + rng.randint(0, 3), frames):
        for b in at:
            b[0], b[1] = (b[0] + b[4]) % wide, (b[1] + b[5]) % wide
            if rng.random() < (0.85 if f % 120 < 60 else 0.1):
                x, y = int(b[0]), int(b[1])
                rows.append((0, f, rng.choice([1, 2, 3, 77, 900, rng.randint(0, 10**6)]), rng.choice([0.95, 0.75, 0.6, 0.36, 0.3]), x, y, x + int(b[2]), y + int(b[3])))
    return rows


def columns_of(rows):
    d = sorted(rows, key=lambda r: (r[1], r[4], r[5], r[2]))
    a = np.array([r[4:8] for r in d], float).reshape(-1, 4)
    return np.array([r[1] for r in d], int), np.column_stack([a[:, :2], a[:, 2:] - a[:, :2]]), np.array([r[3] for r in d], float), np.array([r[2] for r in d], int)


def one_by_one(rows, until, params):
    frames, tlwh, scores, labels = columns_of(rows)
    one, out = tracker.CameraTracker(params, int(frames[0]) - 1), []
    for f in range(int(frames[0]), until):
        own = frames == f
        for t, p in one.step(f, tlwh[own], scores[own], labels[own]):
            out.append((f, *row_of(t, p), False))
        out += [(f, *row_of(t, False), True) for t in one.removed]
    return out, one.state()


def row_of(t, p):
    return (t.nth, t.start, t.last, t.class_id, t.score, *t.tlwh.tolist(), t.det_box, p, t.points)


@pytest.mark.parametrize("params", [tracker.TrackParams(), tracker.TrackParams(track_thresh=0.7, duplicate_dist=0.6, track_buffer=8)])
@pytest.mark.parametrize("cuts", [(), (50, 90, 91, 170)])
def test_lanes_are_single_trackers(params, cuts):
    many = [crowd(k, 200, 150 + 100 * k) for k in range(5)] + [busy(3, 200, (20, 60)), [r for r in busy(4, 200, (1, 1)) if r[1] > 120]]
    until, found, states = 260, [[] for _ in many], {}
    cols = [columns_of(rows) for rows in many]

    def put(lane, frame, slots, pointed, removed):
        s = lanes.s
        for n, f, k, p in zip(lane.tolist(), frame.tolist(), slots.tolist(), pointed.tolist()):
            box = tuple(s.det[k].tolist()) if s.boxed[k] else None
            found[n].append((f, int(s.nth[k]), int(s.start[k]), int(s.last[k]), int(s.cls[k]), float(s.score[k]), *kalman.tlwh_of(s.kf[k]).tolist(), box, p, int(s.points[k]), removed))

    def ended(at):
        states.update({k: lanes.state(k) for k in at.tolist()})

    lanes = Lockstep(params, np.array([c[0][0] - 1 for c in cols]), np.full(len(many), -1), np.full(len(many), until), put, lambda *_: None, None, ended)
    edges = [0, *cuts, 10**6]
    for a, b in zip(edges[:-1], edges[1:]):
        part = [[c[(frames >= a) & (frames < b)] for c in (frames, *rest)] for frames, *rest in cols]
        lane = np.repeat(np.arange(len(many)), [len(p[0]) for p in part])
        lanes.run(lane, *[np.concatenate(x) for x in zip(*part)], more=None if b == edges[-1] else np.ones(len(many), bool))
    for k, rows in enumerate(many):
        want, state = one_by_one(rows, until, params)
        assert Counter(map(repr, found[k])) == Counter(map(repr, want)) and len(want) > 100
        assert tracker.agrees_by(states[k]) == tracker.agrees_by(state)


@pytest.mark.parametrize("rows", [1, 7, 60, 10**6])
def test_held_runs_are_whole_or_in_parts(rows):
    rng = random.Random(rows)
    keys = [(a, b, n, f) for a in range(2) for b in range(3) for n in range(2) for f in range(rng.choice([1, 2, 30])) for _ in range(rng.randint(1, 4))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*keys[k : k + 11])], names=list("abnf")) for k in range(0, len(keys), 11)]
    seen, open_ = [], None
    for columns, edges, goes_on, more in tracker._held(iter(batches), 3, rows):
        part = list(zip(*(c.tolist() for c in columns)))
        assert edges[-1] == len(part) and goes_on == (open_ is not None)
        runs = [part[a:b] for a, b in zip(edges[:-1], edges[1:])]
        assert all(len({r[:3] for r in run}) <= 1 for run in runs) and (len(runs) == 1 or not (goes_on or more))
        assert not goes_on or not part or part[0][:3] == open_
        open_ = (part[0][:3] if part else open_) if more else None
        if seen and part:
            assert seen[-1] != part[0]  # a frame is never cut
        seen += part
    assert seen == keys and open_ is None


@pytest.mark.parametrize("held", [1, 300, 10**6])
def test_tracks_do_not_depend_on_what_is_held(spark, held):
    rows = [(c, *r[1:]) for c in range(2) for r in busy(c, 700, (100, 300))]
    d = spark.createDataFrame(rows, "camera_id int, frame_id long, label int, confidence double, xmin int, ymin int, xmax int, ymax int")
    last = spark.createDataFrame([(0, 900), (1, 800)], "camera_id int, last_frame long")
    found = tracker.track(d, last, cut=tracker.SliceParams(frames=180, warmup=150, held_rows=held))
    one = tracker.track(d, last, cut=tracker.SliceParams(frames=10**6, warmup=150))
    rows_of = lambda df: sorted(map(repr, df.drop("segment").collect()))
    assert rows_of(found) == rows_of(one)


@pytest.mark.parametrize("next_id", [0, 65_530])
@pytest.mark.parametrize("cuts", [(), (61, 120, 121, 300)])
def test_stretches_of_a_stream_are_one_tracker(next_id, cuts):
    """Stretches between long gaps are tracked together, with the ids of one pass, also where ids wrap."""
    rows = [(0, r[1] + 150 * k, *r[2:]) for k in range(4) for r in [*busy(k, 60, (1, 1)), *crowd(k, 60, 300, 4)]]
    frames, tlwh, scores, labels = columns_of(rows)
    params, until = tracker.TrackParams(), int(frames[-1]) + 1
    one, want = tracker.CameraTracker(params, 0, next_id), []
    for f in range(1, until):
        own = frames == f
        want += [(f, t.id, t.det_box, p, False) for t, p in one.step(f, tlwh[own], scores[own], labels[own])]
        want += [(f, t.id, None, False, True) for t in one.removed]
    frame, key, live, found = 0, next_id, [], []
    for a, b in zip((0, *cuts), (*cuts, until)):
        own = (frames >= a) & (frames < b)
        if not own.any():
            continue
        out, frame, key, live = monitors.stretches(params, frame, key, live, frames[own], tlwh[own], scores[own], labels[own])
        for at, ids, det, boxed, pointed, removed in out:
            found += [(f, k, tuple(x) if y and not removed else None, p, removed) for f, k, x, y, p in zip(at.tolist(), ids.tolist(), det.tolist(), boxed.tolist(), pointed.tolist())]
    assert Counter(found) == Counter(want) and len({r[1] for r in want}) > 20
    assert (frame, key, live) == (one.frame, one.next_id, one.state())
