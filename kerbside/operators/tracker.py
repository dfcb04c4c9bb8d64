"""Multi-object tracking: one camera's state machine over frames, as a batch operator over independent stretches of a camera.

The state is numpy arrays and small objects (``CameraTracker``); batch and stream feed it the same frames. In batch, a camera is cut wherever it has no
detections for so long that no track can live on (segments), and segments of a busy camera again every ``SliceParams.frames`` frames. A slice does not know the tracks that come into it, so it
starts ``warmup`` frames early with none; its state at its border is then compared with the one its predecessor ends with. Where both agree, which they
do once all tracks that lived when the warm-up began are gone, the slice's rows are those of a single pass. Where they do not, the slice is run again from its predecessor's
state, and on until it agrees with a later slice; this is checked again, and after ``rounds`` rounds what is left of a camera is run on in one go. So
results never depend on how a camera was cut.

A track is known by the frame it began in and its number there; ids are the sum of those issued in earlier frames.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kerbside.operators import kalman, ranges
from kerbside.operators.arrow import run_starts, runs, whole_runs
from kerbside.operators.assignment import solve
from kerbside.operators.kalman import xyah_of
from kerbside.operators.lockstep import IDS, Lockstep
from kerbside.operators.pairs import SHUFFLED

@dataclass(frozen=True)
class TrackParams:
    track_thresh: float = 0.35
    match_thresh: float = 0.9
    second_thresh: float = 0.5
    unconfirmed_thresh: float = 0.7
    min_box_area: float = 10.0
    track_buffer: int = 30
    frame_rate: int = 30
    duplicate_dist: float = 0.15

    @property
    def max_time_lost(self) -> int:
        return int(self.track_buffer / 20 * self.frame_rate)


def started(xyah: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return kalman.as_matrix(kalman.started(xyah))


def predicted(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return kalman.as_matrix(kalman.predicted(kalman.of_matrix(mean, cov)))


def updated(mean: np.ndarray, cov: np.ndarray, xyah: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The state after a measurement, and the measurement's squared Mahalanobis distance before it."""
    state, gate = kalman.updated(kalman.of_matrix(mean, cov), xyah)
    return *kalman.as_matrix(state), float(gate)


@dataclass
class Track:
    id: int
    start: int
    last: int
    score: float
    class_id: int
    mean: np.ndarray
    cov: np.ndarray
    confirmed: bool
    tracked: bool = True
    hits: dict[int, int] = field(default_factory=dict)
    class_lock: bool = False
    det_box: tuple[float, ...] | None = None
    points: int = 0
    gate: float = float("nan")
    nth: int = 0  # of those that began in the same frame

    @property
    def tlwh(self) -> np.ndarray:
        x, y, a, h = self.mean[:4]
        return np.array([x - a * h / 2, y - h / 2, a * h, h], np.float32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - IoU of two sets of tlwh boxes, pixels counted whole."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.float32)
    a1, b1 = a[:, None, :2], b[None, :, :2]
    a2, b2 = a1 + a[:, None, 2:], b1 + b[None, :, 2:]
    side = np.maximum(0, np.minimum(a2, b2) - np.maximum(a1, b1) + 1)
    inter = side[..., 0] * side[..., 1]
    areas = lambda x: (x[:, 2] + 1) * (x[:, 3] + 1)
    return 1 - inter / (areas(a)[:, None] + areas(b)[None, :] - inter)


def matched(dist: np.ndarray, limit: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    gain = limit - dist.astype(float)
    near = gain > 0
    if not dist.size or (near.sum(axis=0).max() <= 1 and near.sum(axis=1).max() <= 1):
        pairs = [(i, j) for i, j in np.argwhere(near).tolist()]  # nobody has a choice
    else:
        pairs = solve(gain)
    rows, columns = {i for i, _ in pairs}, {j for _, j in pairs}
    return pairs, [i for i in range(dist.shape[0]) if i not in rows], [j for j in range(dist.shape[1]) if j not in columns]


class CameraTracker:
    """step() takes a frame's detections; ``rows`` are then what the frame puts out, ``removed`` the tracks that ended."""

    def __init__(self, params: TrackParams = TrackParams(), frame: int = 0, next_id: int = 0) -> None:
        self.params, self.frame, self.next_id, self.begun = params, frame, next_id, 0
        self.tracked: list[Track] = []
        self.lost: list[Track] = []
        self.removed: list[Track] = []

    def _vote(self, t: Track, label: int, score: float) -> None:
        if t.class_lock or not (score > 0.7 or self.frame - t.start <= 5 or t.hits.get(t.class_id, 0) < 3):
            return
        t.hits[label] = t.hits.get(label, 0) + (2 if score > 0.8 else 1)
        best = min(t.hits, key=lambda k: (-t.hits[k], k))
        if best != t.class_id and t.hits[best] >= t.hits.get(t.class_id, 0) + 2:
            t.class_id = best
        t.class_lock = t.hits[best] > 8

    def _take(self, t: Track, det: np.ndarray, score: float) -> None:
        t.mean, t.cov, t.gate = updated(t.mean, t.cov, xyah_of(det))
        t.tracked = t.confirmed = True
        t.last, t.score = self.frame, score

    def step(self, frame: int, boxes: np.ndarray, scores: np.ndarray, labels: np.ndarray) -> list[tuple[Track, bool]]:
        """boxes: tlwh. (track, has a point in this frame) of all tracks put out."""
        p = self.params
        self.frame, self.removed = frame, []
        high, low = np.flatnonzero(scores >= p.track_thresh), np.flatnonzero(scores < p.track_thresh)
        unconfirmed = [t for t in self.tracked if not t.confirmed]
        pool = [t for t in self.tracked if t.confirmed] + self.lost
        for t in pool:
            if not t.tracked:
                t.mean[7] = 0
        boxes_before = np.array([t.tlwh for t in pool], np.float32).reshape(-1, 4)  # of the last update: predicting doesn't move what is matched
        for t in pool:
            t.mean, t.cov = predicted(t.mean, t.cov)
        pointed: set[int] = set()
        refound: list[Track] = []

        def side_effects(t: Track, k: int) -> None:
            t.det_box = tuple(float(v) for v in boxes[k])
            self._vote(t, int(labels[k]), float(scores[k]))
            t.points += 1
            pointed.add(id(t))

        pairs, alone, free = matched(distances(boxes_before, boxes[high].astype(np.float32)), p.match_thresh)
        for i, j in pairs:
            t, k = pool[i], high[j]
            was = t.tracked
            self._take(t, boxes[k], float(scores[k]))
            if was:
                side_effects(t, k)
            else:
                refound.append(t)  # a found track was copied before the frame's box, vote and point
        left = high[free]
        again = [i for i in alone if pool[i].tracked]
        pairs, alone, _ = matched(distances(boxes_before[again], boxes[low].astype(np.float32)), p.second_thresh)
        for i, j in pairs:
            t, k = pool[again[i]], low[j]
            self._take(t, boxes[k], float(scores[k]))
            side_effects(t, k)
        newly_lost = [pool[again[i]] for i in alone]
        for t in newly_lost:
            t.tracked = False
        pairs, alone, free = matched(distances(np.array([t.tlwh for t in unconfirmed], np.float32).reshape(-1, 4), boxes[left].astype(np.float32)), p.unconfirmed_thresh)
        for i, j in pairs:
            self._take(unconfirmed[i], boxes[left[j]], float(scores[left[j]]))
        gone = {id(unconfirmed[i]) for i in alone}
        self.removed += [unconfirmed[i] for i in alone]
        fresh = []
        for k in left[free]:
            mean, cov = started(xyah_of(boxes[k]))
            fresh.append(Track(self.next_id, frame, frame, float(scores[k]), int(labels[k]), mean, cov, frame == 1, nth=len(fresh)))
            self.next_id = (self.next_id + 1) % IDS
        self.begun = len(fresh)
        old = [t for t in self.lost if not t.tracked and frame - t.last > p.max_time_lost]
        self.removed += old
        expired = {id(t) for t in old}
        self.tracked = [t for t in self.tracked if t.tracked and id(t) not in gone] + fresh + refound
        self.lost = sorted([t for t in self.lost if not t.tracked and id(t) not in expired] + newly_lost, key=lambda t: t.id)
        self._dedupe()
        area = [t.tlwh[2] * t.tlwh[3] for t in self.tracked]
        return [(t, id(t) in pointed) for t, a in zip(self.tracked, area) if a > p.min_box_area]

    def _dedupe(self) -> None:
        if not self.tracked or not self.lost:
            return
        a, b = np.array([t.tlwh for t in self.tracked]), np.array([t.tlwh for t in self.lost])
        drop_a, drop_b = set(), set()
        for i, j in np.argwhere(distances(a, b) < self.params.duplicate_dist):
            s, t = self.tracked[i], self.lost[j]
            (drop_b if s.last - s.start > t.last - t.start else drop_a).add(j if s.last - s.start > t.last - t.start else i)
        self.tracked = [t for i, t in enumerate(self.tracked) if i not in drop_a]
        self.lost = [t for j, t in enumerate(self.lost) if j not in drop_b]

    def skip_to(self, frame: int) -> list[tuple[int, Track]]:
        """Frames without detections up to, not including, this one; the tracks that end in them, and where."""
        ended = []
        nothing = (np.zeros((0, 4)), np.zeros(0), np.zeros(0, int))
        while self.frame + 1 < frame and (self.tracked or self.lost):
            self.step(self.frame + 1, *nothing)
            ended += [(self.frame, t) for t in self.removed]
        self.frame = max(self.frame, frame - 1)
        return ended

    def state(self) -> list[tuple]:
        """The live tracks as plain values, in order: those tracked, then those lost (STATE)."""
        return [_plain(t, k) for k, of in enumerate((self.tracked, self.lost)) for t in of]

    @classmethod
    def resumed(cls, params: TrackParams, frame: int, state: list, next_id: int | None = None) -> CameraTracker:
        """A tracker that has just done ``frame`` and has these live tracks (rows of STATE); without next_id ids go on after the largest."""
        tracks = [(row[0], _from_plain(row)) for row in state]
        found = cls(params, frame, max((t.id for _, t in tracks), default=-1) + 1 if next_id is None else next_id)
        found.tracked, found.lost = ([t for k, t in tracks if k == which] for which in (0, 1))
        return found

    def agrees_by(self) -> bytes:
        """Equal for trackers that will put out the same from here on: all of the state but the ids, whose order is that of the rows."""
        return agrees_by(self.state())


def agrees_by(state: list[tuple]) -> bytes:
    """What rows of STATE say but for the ids."""
    return hashlib.blake2b(repr([row[:1] + row[2:] for row in state]).encode(), digest_size=16).digest()


#: A live track as typed values; ``place`` is 0 for tracked, 1 for lost ones.
STATE = "place int, id long, start long, nth int, last long, score double, class_id int, confirmed boolean, tracked boolean, hit_labels array<int>, hit_counts array<int>, class_lock boolean, det_box array<double>, points int, gate double, mean array<float>, cov array<float>"


def _plain(t: Track, place: int) -> tuple:
    labels = sorted(t.hits)
    box = None if t.det_box is None else list(t.det_box)
    gate = None if np.isnan(t.gate) else float(t.gate)
    return (place, t.id, t.start, t.nth, t.last, float(t.score), t.class_id, t.confirmed, t.tracked, labels, [t.hits[k] for k in labels], t.class_lock, box, t.points, gate, t.mean.tolist(), t.cov.ravel().tolist())


def _from_plain(row) -> Track:
    _, key, start, nth, last, score, class_id, confirmed, tracked, labels, counts, lock, box, points, gate, mean, cov = row
    hits = {int(k): int(n) for k, n in zip(labels, counts)}
    box = None if box is None else tuple(float(v) for v in box)
    mean, cov = np.array(mean, np.float32), np.array(cov, np.float32).reshape(8, 8)
    return Track(int(key), int(start), int(last), float(score), int(class_id), mean, cov, bool(confirmed), bool(tracked), hits, bool(lock), box, int(points), float("nan") if gate is None else float(gate), int(nth))


ROW = "camera_id int, segment long, frame_id long, track_id long, start_frame long, last_frame long, class_id int, score double, x double, y double, w double, h double, det_x double, det_y double, det_w double, det_h double, has_point boolean, n_points int, gate_d2 double, kind string"
#: What tasks put out: the rows with the number of their track in its first frame (in track_id), and rows of kind issued (n: tracks begun in the frame) and state (of a slice:
#: what it agrees by at its start and end, and the live tracks at its end).
FOUND = ROW + f", slice long, round int, n long, starts_as binary, ends_as binary, live array<struct<{STATE}>>"


def _row(camera: int, segment: int, frame: int, t: Track, pointed: bool, kind: str) -> tuple:
    box, det = [float(v) for v in t.tlwh], t.det_box or (None,) * 4
    return (camera, segment, frame, t.nth, t.start, t.last, t.class_id, t.score, *box, *det, pointed, t.points, None if np.isnan(t.gate) else t.gate, kind)


def _marked(detections: DataFrame, max_time_lost: int, width: int) -> DataFrame:
    """(camera_id, frame_id, segment) of all frames with detections."""
    frames = ranges.previous(detections.select("camera_id", "frame_id").distinct(), "camera_id", "frame_id", width, "from_")
    new = F.coalesce((F.col("frame_id") - F.col("from_") > max_time_lost + 1).cast("long"), F.lit(0))
    return ranges.running_sum(frames, "camera_id", "frame_id", new, width, "segment").drop("from_")


def track_segments(detections: DataFrame, max_time_lost: int, width: int = ranges.FRAMES) -> DataFrame:
    """detections with ``segment``: a camera's stretches between gaps that no track outlives. Gaps are looked for in ranges of width frame numbers."""
    return detections.join(_marked(detections, max_time_lost, width).hint(SHUFFLED), ["camera_id", "frame_id"])


@dataclass(frozen=True)
class SliceParams:
    frames: int = 9_000  # of a slice: five minutes at 30 a second
    warmup: int = 900
    rounds: int = 3  # of running disagreeing slices again side by side, before the rest is run on in one go
    broadcast_rows: int = 100_000
    held_rows: int = 400_000  # detections of a task that are tracked together

    def __post_init__(self) -> None:
        if not 0 < self.warmup <= self.frames:
            raise ValueError("0 < warmup <= frames")


class _Slice:
    """Runs a slice and those after it from a state, over frames in order; ``out`` collects rows of FOUND."""

    def __init__(self, key: tuple, params: TrackParams, width: int, out: list, number: int, tracker: CameraTracker) -> None:
        self.camera, self.segment, self.slice = key
        self.params, self.width, self.out, self.number, self.tracker = params, width, out, number, tracker
        self.starts_as, self.done = tracker.agrees_by(), False

    def _put(self, row: tuple, n: int | None = None) -> None:
        self.out.append((*row, self.slice, self.number, n, None, None, None))

    def _skip(self, frame: int) -> None:
        for at, t in self.tracker.skip_to(frame):
            self._put(_row(self.camera, self.segment, at, t, False, "removed"))

    def frame(self, frame: int, tlwh: np.ndarray, scores: np.ndarray, labels: np.ndarray) -> None:
        self._skip(frame)
        for t, pointed in self.tracker.step(frame, tlwh, scores, labels):
            self._put(_row(self.camera, self.segment, frame, t, pointed, "out"))
        for t in self.tracker.removed:
            self._put(_row(self.camera, self.segment, frame, t, False, "removed"))
        if self.tracker.begun:
            self._put((self.camera, self.segment, frame, *[None] * 16, "issued"), self.tracker.begun)

    def end(self, until: int) -> None:
        """All frames before this one; says what state the slice ends with."""
        self._skip(until)
        state = (self.camera, self.segment, until, *[None] * 16, "state", self.slice, self.number, None, self.starts_as, self.tracker.agrees_by(), self.tracker.state())
        self.out.append(state)

    def border(self, wanted: bytes) -> None:
        """The next slice begins; the run is done if that one began with the state that this one has now."""
        self.end((self.slice + 1) * self.width)
        self.slice, self.starts_as = self.slice + 1, self.tracker.agrees_by()
        self.done = self.starts_as == wanted


def _emitted(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    out.clear()
    return batch


def _held(batches: Iterator[pa.RecordBatch], n_keys: int, rows: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, bool, bool]]:
    """(columns, edges, goes on, more): whole runs of equal values in the first n_keys columns, as many as have about ``rows`` rows. A run of more rows comes by itself in
    several parts, each of which ends with a whole run of the first n_keys + 1 columns: goes on says that a part is not its run's first, more that it is not its last."""
    held: list[list[np.ndarray]] = []
    n, key, goes_on = 0, None, False

    def parts(final: bool):
        nonlocal held, n, key, goes_on
        every = [np.concatenate(x) for x in zip(*held)]
        if goes_on:
            starts = np.append(run_starts(every[:n_keys]), len(every[0]))
            end = int(starts[1]) if len(every[0]) and tuple(c[0] for c in every[:n_keys]) == key else 0
            goes_on = not final and end == len(every[0])
            yield [c[:end] for c in every], np.array([0, end]), True, goes_on
            every = [c[end:] for c in every]
        starts = run_starts(every[:n_keys])
        if final and len(starts):
            yield every, np.append(starts, len(every[0])), False, False
        elif len(starts) > 1:
            yield [c[: starts[-1]] for c in every], starts, False, False
            every = [c[starts[-1] :] for c in every]
        elif len(every[0]) >= rows:
            yield every, np.array([0, len(every[0])]), False, True
            key, goes_on, every = tuple(c[0] for c in every[:n_keys]), True, [c[:0] for c in every]
        held, n = [every], len(every[0])

    for columns, _ in whole_runs(batches, n_keys + 1):
        held.append(columns)
        n += len(columns[0])
        if n >= rows:
            yield from parts(False)
    if held:
        yield from parts(True)


class _Lanes:
    """Slices side by side in a Lockstep; puts out Arrow batches of FOUND."""

    def __init__(self, columns: list[np.ndarray], edges: np.ndarray, params: TrackParams, cut: SliceParams, schema: pa.Schema) -> None:
        self.schema = schema
        first, last = edges[:-1], edges[1:] - 1
        self.camera, self.segment, self.slice, frame = (c[first] for c in columns[:4])
        until, first_slice, last_slice = (c[last] for c in columns[-3:])
        border = np.where(self.slice == first_slice, -1, self.slice * cut.frames)
        until = np.where(self.slice == last_slice, until, (self.slice + 1) * cut.frames)
        self.starts_as = [b""] * len(first)
        self.rows: list[tuple] = []
        self.begun: list[tuple] = []
        self.states: list[tuple] = []
        self.all = Lockstep(params, frame - 1, border, until, self._put, lambda *x: self.begun.append(x), self._border, self._ended)

    def _put(self, lane: np.ndarray, frame: np.ndarray, slots: np.ndarray, pointed: np.ndarray, removed: bool) -> None:
        s = self.all.s
        self.rows.append((lane, frame, s.nth[slots], s.start[slots], s.last[slots], s.cls[slots], s.score[slots], kalman.tlwh_of(s.kf[slots]), s.det[slots], s.boxed[slots], pointed, s.points[slots], s.gate[slots], np.full(len(lane), removed)))

    def _border(self, lanes: np.ndarray) -> None:
        live = self.all.live()
        for lane in lanes.tolist():
            self.starts_as[lane] = agrees_by(self.all.state(lane) if live[lane] else [])

    def _ended(self, lanes: np.ndarray) -> None:
        live = self.all.live()
        for lane in lanes.tolist():
            state = self.all.state(lane) if live[lane] else []
            self.states.append((int(self.camera[lane]), int(self.segment[lane]), int(self.all.until[lane]), *[None] * 16, "state", int(self.slice[lane]), 0, None, self.starts_as[lane], agrees_by(state), state))

    def run(self, columns: list[np.ndarray], edges: np.ndarray, more: bool) -> Iterator[pa.RecordBatch]:
        _, _, _, frame, labels, scores, x0, y0, x1, y1, *_ = columns
        lane = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        self.all.run(lane, frame, np.column_stack([x0, y0, x1 - x0, y1 - y0]), scores, labels, np.array([True]) if more else None)
        yield from self._emitted()

    def _emitted(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            lane, frame, nth, start, last, cls, score, box, det, boxed, pointed, points, gate, removed = (np.concatenate(x) for x in zip(*self.rows))
            self.rows.clear()
            dets = {f"det_{c}": pa.array(det[:, k], mask=~boxed) for k, c in enumerate("xywh")}
            kind = pa.DictionaryArray.from_arrays(pa.array(removed.astype(np.int8)), ["out", "removed"])
            yield from self._batches(lane, frame_id=frame, track_id=nth, start_frame=start, last_frame=last, class_id=cls, score=score, **{c: box[:, k].astype(float) for k, c in enumerate("xywh")}, **dets, has_point=pointed, n_points=points, gate_d2=pa.array(gate, mask=np.isnan(gate)), kind=kind)
        if self.begun:
            lane, frame, n = (np.concatenate(x) for x in zip(*self.begun))
            self.begun.clear()
            yield from self._batches(lane, frame_id=frame, n=n, kind=pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(lane), np.int8)), ["issued"]))
        if self.states:
            yield _emitted(self.states, self.schema)

    def _batches(self, lane: np.ndarray, size: int = 20_000, **columns) -> Iterator[pa.RecordBatch]:
        columns |= {"camera_id": self.camera[lane], "segment": self.segment[lane], "slice": self.slice[lane], "round": np.zeros(len(lane), np.int32)}
        arrays = [(columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name])).cast(f.type) if f.name in columns else pa.nulls(len(lane), f.type) for f in self.schema]
        batch = pa.RecordBatch.from_arrays(arrays, schema=self.schema)
        yield from (batch.slice(k, size) for k in range(0, len(batch), size))


_BOX = ("xmin", "ymin", "xmax", "ymax")


def _sliced(detections: DataFrame, last_frames: DataFrame, params: TrackParams, cut: SliceParams) -> DataFrame:
    """Detections with segment, slice, and of their segment its first and last slice and the frame up to which its tracks may end."""
    from kerbside.sources.scratch import written

    marked = written(_marked(detections, params.max_time_lost, ranges.FRAMES), "track-frames")  # read twice
    of = lambda c: F.floor(c / cut.frames).cast("long")
    spans = marked.groupBy("camera_id", "segment").agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"))
    spans = spans.withColumn("next", F.lead("first").over(Window.partitionBy("camera_id").orderBy("segment"))).join(F.broadcast(last_frames), "camera_id")  # a row a camera
    until = F.least(F.coalesce("next", F.col("last_frame") + 1), F.col("last_frame") + 1)
    spans = spans.select("camera_id", "segment", until.alias("until"), of(F.col("first")).alias("first_slice"), of(F.col("last")).alias("last_slice"))
    joined = detections.join(marked.join(spans.hint(SHUFFLED), ["camera_id", "segment"]).hint(SHUFFLED), ["camera_id", "frame_id"])
    return joined.select("camera_id", "segment", of(F.col("frame_id")).alias("slice"), "frame_id", "label", F.col("confidence").cast("double").alias("confidence"), *[F.col(c).cast("double").alias(c) for c in _BOX], "until", "first_slice", "last_slice")


_ORDER = ("camera_id", "segment", "slice", "frame_id")


def _parallel(rows: DataFrame, params: TrackParams, cut: SliceParams) -> DataFrame:
    """Rows of FOUND: all slices side by side, each from its warm-up on."""
    c = F.col
    early = (c("slice") < c("last_slice")) & (c("frame_id") >= (c("slice") + 1) * cut.frames - cut.warmup)
    every = rows.withColumn("slice", F.explode(F.when(early, F.array(c("slice"), c("slice") + 1)).otherwise(F.array("slice"))))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.repartition(n, *_ORDER[:3]).sortWithinPartitions(*_ORDER, "xmin", "ymin", "label")
    schema = to_arrow_schema(StructType.fromDDL(FOUND))

    def run(batches):
        for columns, edges, goes_on, more in _held(batches, 3, cut.held_rows):
            if not goes_on:
                lanes = _Lanes(columns, edges, params, cut, schema)
            yield from lanes.run(columns, edges, more)

    return dealt.mapInArrow(run, FOUND)


def _again(rows: DataFrame, redo: DataFrame, starts: DataFrame, number: int, params: TrackParams, cut: SliceParams) -> DataFrame:
    """Rows of FOUND: each row of redo (camera_id, segment, run: its first slice, stop: the slice it ends before, live: the tracks that come in) over its slices until it
    agrees with a slice's start (starts: camera_id, segment, slice, starts_as)."""
    c = F.col
    of = redo.select("camera_id", "segment", "run", F.explode(F.sequence("run", c("stop") - 1)).alias("slice"))
    own = rows.join(of, ["camera_id", "segment", "slice"])
    nothing = {"label": "int", "confidence": "double", **dict.fromkeys(_BOX, "double"), "until": "long", "last_slice": "long"}
    detected = own.select("camera_id", "segment", "run", "frame_id", F.lit(1).alias("turn"), F.lit(None).cast("binary").alias("starts_as"), F.lit(None).cast(f"array<struct<{STATE}>>").alias("live"), *nothing)
    empty = [F.lit(None).cast(t).alias(x) for x, t in nothing.items()]
    first = redo.select("camera_id", "segment", "run", (c("run") * cut.frames).alias("frame_id"), F.lit(0).alias("turn"), F.lit(None).cast("binary").alias("starts_as"), "live", *empty)
    later = of.filter("slice > run").join(starts, ["camera_id", "segment", "slice"])
    later = later.select("camera_id", "segment", "run", (c("slice") * cut.frames).alias("frame_id"), F.lit(0).alias("turn"), "starts_as", F.lit(None).cast(f"array<struct<{STATE}>>").alias("live"), *empty)
    every = detected.unionByName(first).unionByName(later)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.repartition(n, "camera_id", "segment", "run").sortWithinPartitions("camera_id", "segment", "run", "frame_id", "turn", "xmin", "ymin", "label")
    schema = to_arrow_schema(StructType.fromDDL(FOUND))

    def run(batches):
        out: list[tuple] = []
        now, running, until, last = None, None, 0, 0

        def close():
            if running is not None and not running.done:
                running.end(until if running.slice == last else (running.slice + 1) * cut.frames)

        for (*key, frame, turn), (wanted, live, labels, scores, x0, y0, x1, y1, ends, lasts) in runs(batches, 5):
            if key != now:
                close()
                now, tracker = key, CameraTracker.resumed(params, frame - 1, [tuple(r.values()) for r in live[0]])
                running = _Slice(tuple(key), params, cut.frames, out, number, tracker)
            elif running.done:
                continue
            elif not turn:
                running.border(wanted[0])
            else:
                until, last = int(ends[0]), int(lasts[0])
                running.frame(frame, np.column_stack([x0, y0, x1 - x0, y1 - y0]), scores, labels.astype(int))
            if len(out) > 5000:
                yield _emitted(out, schema)
        close()
        if out:
            yield _emitted(out, schema)

    return dealt.mapInArrow(run, FOUND)


def track(detections: DataFrame, last_frames: DataFrame, params: TrackParams = TrackParams(), cut: SliceParams = SliceParams()) -> DataFrame:
    """Track rows (ROW): kind 'out' (a track put out in a frame) and 'removed' (a track that ended, in the frame it ended).

    last_frames: (camera_id, last_frame): tracks are removed only as far as a camera has frames. Detections of a slice are read in order, as many slices at
    once as have ``held_rows`` detections, a larger slice in parts, so memory is bound by those. Rows are those of a single pass over each camera. The driver sees counts of slices only.
    """
    from kerbside.sources.scratch import written

    if cut.frames <= params.max_time_lost + 1:
        raise ValueError("a slice must be longer than a lost track lives")
    rows = _sliced(detections, last_frames, params, cut)
    rounds = [written(_parallel(rows, params, cut), "track-rows")]
    place, c = ["camera_id", "segment", "slice"], F.col
    order = Window.partitionBy("camera_id", "segment").orderBy("slice")
    for number in range(1, cut.rounds + 2):
        states = functools.reduce(DataFrame.unionByName, rounds).filter("kind = 'state'")
        latest = states.groupBy(*place).agg(F.max_by(F.struct("starts_as", "ends_as"), "round").alias("s"), F.max("round").alias("round")).select(*place, "s.*", "round")
        checked = latest.withColumns({"came_as": F.lag("ends_as").over(order), "end": F.max("slice").over(Window.partitionBy("camera_id", "segment")) + 1})
        wrong = checked.filter("came_as <> starts_as").withColumn("stop", F.coalesce(F.lead("slice").over(order), c("end")))
        if number > cut.rounds:  # from each segment's first disagreement to its end
            wrong = wrong.withColumn("nth", F.row_number().over(order)).filter("nth = 1").withColumn("stop", c("end"))
        wrong = written(wrong.select("camera_id", "segment", c("slice").alias("run"), "stop"), "track-wrong")
        if not wrong.count():
            break
        ends = states.join(latest.select(*place, "round"), [*place, "round"]).select("camera_id", "segment", (c("slice") + 1).alias("run"), "live")
        redo = written(wrong.join(ends, ["camera_id", "segment", "run"]), "track-runs")
        starts = latest.select(*place, "starts_as" if number <= cut.rounds else F.lit(b"").alias("starts_as"))  # the last round stops nowhere
        rounds.append(written(_again(rows, redo, starts, number, params, cut), "track-rows"))
    found = rounds[0]
    if len(rounds) > 1:
        every = functools.reduce(DataFrame.unionByName, rounds)
        newest = every.filter("kind = 'state'").groupBy(*place).agg(F.max("round").alias("round"))
        newest = written(newest, "track-newest")
        found = every.join(F.broadcast(newest) if newest.count() <= cut.broadcast_rows else newest, [*place, "round"])
    return _numbered(found)


def _numbered(found: DataFrame) -> DataFrame:
    """The rows with the ids of a single pass: those issued in earlier frames of the camera, and the track's number in its frame."""
    names = [f.split()[0] for f in ROW.split(", ")]
    issued = found.filter("kind = 'issued'").select("camera_id", "frame_id", "n")
    summed = ranges.running_sum(issued, "camera_id", "frame_id", F.col("n"), ranges.FRAMES, "upto")
    before = summed.select(F.col("camera_id").alias("of_"), F.col("frame_id").alias("began_"), (F.col("upto") - F.col("n")).alias("before"))
    rows = found.filter("kind in ('out', 'removed')").select(*names)
    joined = rows.join(before.hint(SHUFFLED), (rows["camera_id"] == before["of_"]) & (rows["start_frame"] == before["began_"]))
    return joined.withColumn("track_id", (F.col("track_id") + F.col("before")) % IDS).select(*names)
