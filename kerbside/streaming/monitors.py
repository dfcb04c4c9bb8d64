"""Streaming twins: rates, gaps, sticky hazards, radar, tracking. State is kept by camera; late rows are put out with kind late."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from kerbside.operators.health import code_of
from kerbside.operators.lockstep import IDS, Lockstep
from kerbside.operators.messages import OBJECT
from kerbside.operators.radar import SKEW_CODE
from kerbside.operators.tracker import STATE, TrackParams
from kerbside.streaming.ordered import Ordered, OrderedColumns, packed, run, unmarked, unpacked

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fps_stream(frames: DataFrame, seconds: int = 5, late: str = "10 seconds", by: str = "camera_id", ts: str = "ts") -> DataFrame:
    """(camera, window_start, fps) by tumbling window of event time; health.with_empty_windows adds those without frames when the result is read."""
    window = F.window(ts, f"{seconds} seconds")
    counted = frames.withWatermark(ts, late).groupBy(by, window.alias("w")).agg(F.count("*").alias("n"))
    return counted.select(by, F.unix_millis("w.start").alias("window_start"), (F.col("n") / seconds).alias("fps"))


GAPS = "camera_id int, from_ms long, to_ms long, gap_ms long, code int, kind string"


class GapProcessor(StatefulProcessor):
    """Reports a gap when a camera's next frame comes, limit_ms or more after the one before. A frame older than the newest of an earlier micro-batch is put out
    with kind late (to_ms: its time) and changes nothing. With silent_ms a camera from which no micro-batch has had a frame for that long, by the clock, is put
    out once with kind silent (from_ms: its newest frame), and again only after it has spoken."""

    def __init__(self, limit_ms: int, silent_ms: int | None = None) -> None:
        self.limit_ms, self.silent_ms, self.handle = limit_ms, silent_ms, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("ts_ms", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(unpacked(rows)["ts_ms"].to_numpy())
        before = self.last.get()[0] if self.last.exists() else None
        late = times[:0] if before is None else times[times < before]
        if before is not None:
            times = np.concatenate(([before], times[times > before]))
        at = np.flatnonzero(np.diff(times) >= self.limit_ms)
        if len(times):
            self.last.update((int(times[-1]),))
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        if len(at):
            yield pd.DataFrame({"camera_id": int(key[0]), "from_ms": times[at], "to_ms": times[at + 1], "gap_ms": times[at + 1] - times[at], "code": code_of("no_camera_data"), "kind": "gap"})
        if len(late):
            none = pd.array([None] * len(late), "Int64")
            yield pd.DataFrame({"camera_id": int(key[0]), "from_ms": none, "to_ms": late, "gap_ms": none, "code": none.astype("Int32"), "kind": "late"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        none = pd.array([None], "Int64")
        yield pd.DataFrame({"camera_id": int(key[0]), "from_ms": [self.last.get()[0]], "to_ms": none, "gap_ms": none, "code": code_of("no_camera_data"), "kind": "silent"})

    def close(self) -> None:
        pass


def gap_stream(frames: DataFrame, limit_ms: int = 1200, silent_ms: int | None = None) -> DataFrame:
    """Gaps and late frames of a stream of (camera_id, ts_ms), and with silent_ms silent cameras, told apart by kind. Needs the RocksDB state store."""
    mode = "None" if silent_ms is None else "ProcessingTime"
    return packed(frames.select("camera_id", "ts_ms"), "camera_id").groupBy("camera_id").transformWithStateInPandas(GapProcessor(limit_ms, silent_ms), GAPS, "Append", mode)


class StickyProcessor(OrderedColumns):
    """The newest sampled frame's hazards for every frame; an empty result replaces as well. A late frame is put out without hazards."""

    fields = "frame_id long, hazards string"
    output = "camera_id int, frame_id long, hazards string, kind string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getValueState("newest", "hazards string")

    def released_columns(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        now = self.newest.get()[0] if self.newest.exists() else ""
        known = np.concatenate(([now], rows["hazards"].to_numpy(object)))
        at = np.maximum.accumulate(np.where(pd.isna(known), 0, np.arange(len(known))))[1:]
        self.newest.update((known[at[-1]],))
        yield self.table(key, len(rows), frame_id=rows["frame_id"].array, hazards=known[at], kind="frame")

    def late(self, row: tuple) -> tuple:
        return (row[0], None, "late")


def sticky_stream(frames: DataFrame, delay_frames: int = 250) -> DataFrame:
    """frames: camera_id, frame_id, hazards (text; null on frames that weren't sampled), mark if the source gives marks. (camera_id, frame_id, hazards, kind: frame or late)."""
    return run(unmarked(frames), "camera_id", StickyProcessor(delay_frames))


class RadarProcessor(OrderedColumns):
    """Frames with the newest sweep not after them, and what comes of it: at most one skew alert in each stretch of ``every_ms``, and an alert at every
    ``miss_limit``-th frame without a sweep (of the last ``max_age_ms``). Sweeps come before frames of their time. Late frames and sweeps are put out. Only rows of ``kinds`` are, if given."""

    fields = "ts_ms long, side int, id long"  # side: 0 sweep, 1 frame
    output = "camera_id int, frame_id long, ts_ms long, sweep_id long, sweep_ts long, skew_ms long, lost long, code int, kind string"

    def __init__(self, delay: int, skew_ms: int, every_ms: int, miss_limit: int, max_age_ms: int | None, kinds: tuple[str, ...] | None = None) -> None:
        super().__init__(delay)
        self.kinds = kinds or ("frame", "skew", "missing", "late")
        self.skew_ms, self.every_ms, self.miss_limit, self.max_age_ms = skew_ms, every_ms, miss_limit, max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getValueState("known", "sweep_ts long, sweep_id long, stretch long, lost long")

    def released_columns(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        sweep_ts, sweep_id, stretch, lost = self.known.get() if self.known.exists() else (None, None, None, 0)
        ts = np.concatenate(([0 if sweep_ts is None else sweep_ts], rows["ts_ms"].to_numpy(np.int64)))
        ids = pd.concat([pd.Series([sweep_id], dtype="Int64"), rows["id"]], ignore_index=True).array
        frame = np.concatenate(([False], rows["side"].to_numpy(np.int64) == 1))
        newest = np.maximum.accumulate(np.where(frame, 0, np.arange(len(ts))))  # of each row its sweep; 0 is the one known before
        at, of = np.flatnonzero(frame), newest[frame]
        none = (of == 0) & (sweep_ts is None)
        skew = ts[at] - ts[of]
        stretches_, lost_ = ts[at] // self.every_ms, lost + np.cumsum(none if self.max_age_ms is None else none | (skew > self.max_age_ms))
        over = np.flatnonzero(~none & (np.abs(skew) > self.skew_ms))
        first = over[np.concatenate((stretches_[over[:1]] != stretch if stretch is not None else np.ones(len(over[:1]), bool), np.diff(stretches_[over]) != 0))]
        missing = np.flatnonzero((np.diff(lost_, prepend=lost) > 0) & (lost_ % self.miss_limit == 0))
        masked = lambda values, k: pd.arrays.IntegerArray(values[k].astype(np.int64), none[k].copy())
        for kind, k, more in (("frame", np.arange(len(at)), {}), ("skew", first, {"code": np.full(len(first), SKEW_CODE)}), ("missing", missing, {"lost": lost_[missing], "code": np.full(len(missing), code_of("no_radar_data"))})):
            if kind in self.kinds and len(k):
                yield self.table(key, len(k), frame_id=ids[at[k]], ts_ms=ts[at[k]], sweep_id=ids[of[k]], sweep_ts=masked(ts[of], k), skew_ms=masked(skew, k), kind=kind, **more)
        last, known = int(newest[-1]), sweep_ts is not None or newest[-1] > 0
        number = ids[last]
        self.known.update((int(ts[last]) if known else None, None if pd.isna(number) else int(number), int(stretches_[over[-1]]) if len(over) else stretch, int(lost_[-1]) if len(at) else lost))

    def late(self, row: tuple) -> tuple:
        ts, side, key = row
        return (key if side else None, ts, None if side else key, None, None, None, None, "late")


def radar_stream(frames: DataFrame, sweeps: DataFrame, delay_ms: int = 2_000, skew_ms: int = 400, every_ms: int = 20_000, miss_limit: int = 1000, max_age_ms: int | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Two streams in one keyed state: frames (camera_id, frame_id, ts_ms) and sweeps (camera_id, sweep_id, ts_ms), either with mark. Kinds: frame (with sweep_id,
    sweep_ts, skew_ms), skew and missing (alerts, with code), late; with kinds only those."""
    side = lambda df, key, k: unmarked(df).select("camera_id", F.col("ts_ms").cast("long").alias("ts_ms"), F.lit(k).alias("side"), F.col(key).cast("long").alias("id"), "mark")
    both = side(frames, "frame_id", 1).unionByName(side(sweeps, "sweep_id", 0))
    return run(both, "camera_id", RadarProcessor(delay_ms, skew_ms, every_ms, miss_limit, max_age_ms, kinds))


class RateProcessor(OrderedColumns):
    """Frames by window of event time: a window's rate comes once time has passed it, windows without frames included, with an alert for each of those."""

    fields = "ts_ms long"
    output = "camera_id int, window_start long, fps double, code int, kind string"

    def __init__(self, delay: int, seconds: int, silent_ms: int | None) -> None:
        super().__init__(delay, silent_ms, silent_ms or 0)
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "window_start long, n long")

    def _closed(self, start: int, n: int) -> list[tuple]:
        rate = [(start, n / self.seconds, None, "rate")]
        return rate if n else [*rate, (start, 0.0, code_of("no_infer_data"), "none")]

    def _until(self, open_: tuple[int, int] | None, until: int, out: list[tuple]) -> tuple[int, int] | None:
        """Closes windows up to the one of until; the one that is open then."""
        if open_ is None:
            return None
        (start, n), size = open_, self.seconds * 1000
        while start < until // size * size:
            out += self._closed(start, n)
            start, n = start + size, 0
        return start, n

    def released(self, rows: list[tuple]) -> list[tuple]:
        return self._closing(np.array([ts for (ts,) in rows], np.int64))

    def released_columns(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = self._closing(rows["ts_ms"].to_numpy(np.int64))
        if out:
            yield self.frame(key, out)

    def _closing(self, times: np.ndarray) -> list[tuple]:
        size, out = self.seconds * 1000, []
        now = tuple(self.open.get()) if self.open.exists() else None  # read and kept once for all rows
        for start, n in zip(*(x.tolist() for x in np.unique(times // size * size, return_counts=True))):
            now = self._until(now, start, out) or (start, 0)
            now = (now[0], now[1] + n)
        _, passed = self.time.get()
        now = self._until(now, passed + 1, out)  # a clock moves windows on as well
        if now is not None:
            self.open.update(now)
        return out

    def ended(self) -> list[tuple]:
        if not self.open.exists():
            return []
        found = self._closed(*self.open.get())
        self.open.clear()
        return found

    def late(self, row: tuple) -> tuple:
        return (row[0], None, None, "late")


def rate_stream(frames: DataFrame, seconds: int = 5, delay_ms: int = 10_000, silent_ms: int | None = None) -> DataFrame:
    """(camera_id, window_start, fps, code, kind: rate, none (an alert for a window without frames) or late (window_start is the frame's time)) of frames (camera_id, ts_ms),
    with mark if the source gives marks. With silent_ms windows close by a timer while nothing comes."""
    return run(unmarked(frames), "camera_id", RateProcessor(delay_ms, seconds, silent_ms))


class ColorProcessor(Ordered):
    """Colour votes on live tracks: a map by track of its hits by colour and whether a colour has locked it. A track is there from its first row to its end, when it is put out
    with its colour and leaves the map; votes of a track that is not there are put out as unknown, those after the lock do not count."""

    fields = "frame_id long, turn int, segment long, track_id long, color int, confidence double, start_frame long, n_points int"  # turn: 0 track seen, 1 vote, 2 track ended
    output = "camera_id int, segment long, track_id long, start_frame long, end_frame long, n_points int, color int, kind string"

    def __init__(self, delay: int, strong: float, lock_at: int) -> None:
        super().__init__(delay)
        self.strong, self.lock_at = strong, lock_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.votes = handle.getMapState("votes", "segment long, track_id long", "last long, colors array<int>, hits array<int>, locked boolean")

    def released(self, rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        live: dict[tuple, list | None] = {}

        def state(key: tuple) -> list | None:
            if key not in live:
                found = self.votes.getValue(key) if self.votes.containsKey(key) else None
                live[key] = None if found is None else [found[0], dict(zip(found[1], found[2])), found[3]]
            return live[key]

        for frame, turn, segment, track, color, confidence, start, n_points in rows:
            now = state((segment, track))
            if turn == 0:
                live[segment, track] = [frame, *(now[1:] if now else ({}, False))]
            elif turn == 1 and now is None:
                out.append((segment, track, None, frame, None, color, "unknown"))
            elif turn == 1 and not now[2]:
                now[1][color] = now[1].get(color, 0) + (3 if confidence > self.strong else 1)
                now[2] = now[1][color] > self.lock_at
            elif turn == 2:
                hits = now[1] if now else {}
                leads = min(hits, key=lambda c: (-hits[c], c), default=0)
                out.append((segment, track, start, frame, n_points, leads, "ended"))
                live[segment, track] = None
        for key, now in live.items():
            if now is not None:
                colors = sorted(now[1])
                self.votes.updateValue(key, (now[0], colors, [now[1][c] for c in colors], now[2]))
            elif self.votes.containsKey(key):
                self.votes.removeKey(key)
        return out

    def late(self, row: tuple) -> tuple:
        return (row[2], row[3], None, row[0], None, row[4], "late")


def color_stream(tracks: DataFrame, votes: DataFrame, delay_frames: int = 250, strong: float = 0.95, lock_at: int = 4) -> DataFrame:
    """Ended tracks with their colour. tracks: track rows (camera_id, segment, track_id, frame_id, start_frame, last_frame, n_points, kind out or removed), with mark if the source gives
    marks; votes: camera_id, segment, track_id, vote_seq (the frame), color, confidence. Kinds: ended, unknown, late."""
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    ended = F.col("kind") == "removed"
    seen = unmarked(tracks).select("camera_id", F.coalesce(F.when(ended, F.col("last_frame")), F.col("frame_id")).alias("frame_id"), F.when(ended, 2).otherwise(0).alias("turn"), "segment", "track_id", none("color", "int"), none("confidence", "double"), F.col("start_frame").cast("long").alias("start_frame"), F.col("n_points").cast("int").alias("n_points"), "mark")
    voted = votes.select("camera_id", F.col("vote_seq").cast("long").alias("frame_id"), F.lit(1).alias("turn"), "segment", "track_id", "color", F.col("confidence").cast("double").alias("confidence"), none("start_frame", "long"), none("n_points", "int"), none("mark", "string"))
    return run(seen.unionByName(voted), "camera_id", ColorProcessor(delay_frames, strong, lock_at))


class MessageProcessor(Ordered):
    """A message for each frame, made when time has passed it: its own row, its objects and its hazards come in three streams. What comes for a frame that has gone out is late."""

    fields = "frame_id long, turn int, id long, target_type int, x_norm double, y_norm double, w_norm double, h_norm double, color int, published boolean"  # turn: 0 object, 1 hazard, 2 frame
    output = f"camera_id int, frame_id long, frame_seq long, objects_number int, published_number int, objects array<{OBJECT}>, kind string"

    def released(self, rows: list[tuple]) -> list[tuple]:
        out, objects, shown, at = [], 0, [], None
        for frame, turn, key, kind, x, y, w, h, color, published in rows:
            if frame != at:
                objects, shown, at = 0, [], frame
            if turn == 2:
                shown.sort(key=lambda o: [(v is not None, v) for v in o.values()])
                out.append((frame, frame, objects, len(shown), shown, "message"))
                continue
            objects += 1
            if published:
                shown.append({"id": key, "target_type": kind, "x_norm": x, "y_norm": y, "w_norm": w, "h_norm": h, "color": color, "plate_number": ""})
        return out

    def late(self, row: tuple) -> tuple:
        return (row[0], None, None, None, [], "late")


def message_stream(frames: DataFrame, objects: DataFrame, hazards: DataFrame, delay_frames: int = 250) -> DataFrame:
    """messages.frame_messages as a stream of its three inputs: frames (camera_id, frame_id, with mark if the source gives marks), objects (camera_id, frame_id, id, target_type,
    x_norm..h_norm, color, published) and hazards (the same without color and published). Kinds: message, late."""
    unit = [F.col(c).cast("double").alias(c) for c in ("x_norm", "y_norm", "w_norm", "h_norm")]
    placed = lambda df, turn, color, published, mark: df.select("camera_id", "frame_id", F.lit(turn).alias("turn"), F.col("id").cast("long").alias("id"), F.col("target_type").cast("int").alias("target_type"), *unit, color.cast("int").alias("color"), published.alias("published"), mark.alias("mark"))
    none = F.lit(None).cast("string")
    known = unmarked(frames).select("camera_id", "frame_id", "mark", *[F.lit(None).alias(c) for c in ("id", "target_type", "x_norm", "y_norm", "w_norm", "h_norm")])
    every = placed(known, 2, F.lit(0), F.lit(True), F.col("mark")).unionByName(placed(objects, 0, F.col("color"), F.col("published"), none)).unionByName(placed(hazards, 1, F.lit(0), F.lit(True), none))
    return run(every, "camera_id", MessageProcessor(delay_frames))


def stretches(params: TrackParams, frame: int, next_id: int, live: list[tuple], frames: np.ndarray, tlwh: np.ndarray, scores: np.ndarray, labels: np.ndarray) -> tuple[list[tuple], int, int, list[tuple]]:
    """A camera's later frames from its last frame, next id and live tracks on: ((frames, ids, detected boxes, whether there is one, whether it has a point, removed) of rows; and the three after them).

    Frames are cut at gaps that no track outlives, and what lies between is tracked side by side. Only then is it known how many ids those before have taken; a stretch in which ids
    wrap is done again with its own, as the order of lost tracks is that of their ids.
    """
    first = np.flatnonzero(np.append(True, np.diff(frames) > params.max_time_lost + 1))
    edges = np.append(first, len(frames))
    last = len(first) - 1

    def tracked(lanes: np.ndarray, ids: list[int]) -> tuple[Lockstep, list[tuple], np.ndarray]:
        rows: list[tuple] = []
        begun = np.zeros(len(lanes), int)

        def put(lane, at, slots, pointed, removed):
            s = run.s
            rows.append((lane, at, s.id[slots], s.det[slots], s.boxed[slots], pointed, removed))

        def issued(lane, at, n):
            begun[lane] += n

        done, until = frames[first[lanes]] - 1, np.append(frames[first[1:]], np.iinfo(int).max)[lanes]
        if lanes[0] == 0:
            done[0] = frame
        run = Lockstep(params, done, np.full(len(lanes), -1), until, put, issued)
        for k, n in enumerate(ids):
            run.resume(k, live if lanes[k] == 0 else [], n)
        of = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in lanes])
        run.run(np.repeat(np.arange(len(lanes)), np.diff(edges)[lanes]), frames[of], tlwh[of], scores[of], labels[of], more=lanes == last)
        return run, rows, begun

    run, rows, begun = tracked(np.arange(len(first)), [next_id])
    base, again, at = np.zeros(len(first), int), {}, int(run.next_id[0])
    for k in range(1, len(first)):
        base[k], n = at, int(begun[k])
        if at + n > IDS:
            again[k] = tracked(np.array([k]), [at])
            base[k], n = 0, int(again[k][2][0])
        at = (at + n) % IDS
    out = []
    for lane, when, ids, *rest in rows:
        own = ~np.isin(lane, list(again)) if again else slice(None)
        *columns, removed = rest
        out.append((when[own], ((ids + base[lane]) % IDS)[own], *[c[own] for c in columns], removed))
    for _, more, _ in again.values():
        out += [(when, ids, *rest) for _, when, ids, *rest in more]
    end, lane = (again[last][0], 0) if last in again else (run, last)
    live = [(row[0], (row[1] + int(base[last])) % IDS, *row[2:]) for row in end.state(lane)]
    whole = [tuple(np.concatenate(x) for x in zip(*(r[:-1] for r in out if r[-1] == kind))) + (kind,) for kind in (False, True) if any(r[-1] == kind for r in out)]
    return whole, int(end.frame[lane]), at, live


class TrackProcessor(StatefulProcessor):
    """One camera's tracker in typed state: a map of its live tracks by id, and a row with the schema's version, the last frame and the next id. Frames of a micro-batch are
    sorted first and tracked in stretches side by side, older ones than the last are late. State of version 1, a pickled tracker in one value, is taken over and cleared."""

    VERSION = 2

    def __init__(self, params: TrackParams) -> None:
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.old = handle.getValueState("tracker", StructType([StructField("data", BinaryType())]))
        self.head = handle.getValueState("head", "version int, frame long, next_id long")
        self.live = handle.getMapState("live", "id long", f"{STATE}, pos int")

    def _known(self) -> tuple[int, int, list[tuple]]:
        """(last frame, next id, live tracks)."""
        if self.head.exists():
            _, frame, next_id = self.head.get()
            rows = sorted((tuple(value) for _, value in self.live.iterator()), key=lambda row: row[-1])
            return frame, next_id, [row[:-1] for row in rows]
        if self.old.exists():
            found = pickle.loads(self.old.get()[0])
            self.old.clear()
            return found.frame, found.next_id, found.state()
        return 0, 0, []

    def _keep(self, frame: int, next_id: int, rows: list[tuple], before: set[int]) -> None:
        for pos, row in enumerate(rows):
            self.live.updateValue((row[1],), (*row, pos))
        for key in before - {row[1] for row in rows}:
            self.live.removeKey((key,))
        self.head.update((self.VERSION, frame, next_id))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = unpacked(rows).to_pandas().sort_values(["frame_id", "xmin", "ymin", "label"])
        frame, next_id, live = self._known()
        before = {row[1] for row in live} if self.head.exists() else set()
        late = found.frame_id[found.frame_id <= frame].to_numpy()
        if len(late):
            yield self._rows(key[0], late, None, np.full(len(late), np.nan), np.full(len(late), np.nan), np.zeros(len(late), bool), "late")
        d = found[found.frame_id > frame]
        if len(d):
            tlwh = np.column_stack([d.xmin, d.ymin, d.xmax - d.xmin, d.ymax - d.ymin]).astype(float)
            tracked, frame, next_id, live = stretches(self.params, frame, next_id, live, d.frame_id.to_numpy(), tlwh, d.confidence.to_numpy(float), d.label.to_numpy(int))
            for at, ids, det, boxed, pointed, removed in tracked:
                x, y = (np.where(boxed & (not removed), det[:, k], np.nan) for k in (0, 1))
                yield self._rows(key[0], at, ids, x, y, pointed, "removed" if removed else "out")
        self._keep(frame, next_id, live, before)

    @staticmethod
    def _rows(camera, frame: np.ndarray, ids: np.ndarray | None, x: np.ndarray, y: np.ndarray, pointed: np.ndarray, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"camera_id": int(camera), "frame_id": frame, "track_id": pd.array([None] * len(frame) if ids is None else ids, "Int64"), "det_x": x, "det_y": y, "has_point": pointed, "kind": kind})

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, params: TrackParams = TrackParams()) -> DataFrame:
    """Track rows of a stream of detections; kinds out, removed and late. Needs the RocksDB state store."""
    return packed(detections.select("camera_id", "frame_id", "label", "confidence", "xmin", "ymin", "xmax", "ymax"), "camera_id").groupBy("camera_id").transformWithStateInPandas(TrackProcessor(params), "camera_id int, frame_id long, track_id long, det_x double, det_y double, has_point boolean, kind string", "Append", "None")
