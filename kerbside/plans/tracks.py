"""Queries: assignment, tracking, trajectories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators import assignment, boxes, hazards, messages, tracker, trajectories, votes
from kerbside.plans import geometry, scenes
from kerbside.plans.fixtures import fixture, oracle
from kerbside.sources.bundles import read_bundles
from kerbside.sources.scratch import folder, written


def assign_boxes(spark, sf_dir):
    matches, _, _ = assignment.assign_boxes(fixture(spark, sf_dir, "fx_detections"), fixture(spark, sf_dir, "fx_boxes_b"), "vehicle_id", 0.9)
    return matches.withColumn("iou", F.round("iou", 6))


def assign_ambiguous(spark, sf_dir):
    """Vehicles with one or two boxes on either side: clusters that the solver decides."""
    matches, _, _ = assignment.assign_boxes(fixture(spark, sf_dir, "fx_boxes_many_a"), fixture(spark, sf_dir, "fx_boxes_many_b"), "box_id", 0.6)
    return matches.withColumn("iou", F.round("iou", 6))


#: Track rows that this session has written: tracking is the costly part of most queries here, and they read the same rows.
_TRACKED: dict[tuple, DataFrame] = {}


def _state_of(spark, path: str) -> tuple:
    """What changes when a table's files do: their names, sizes and times."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(at)))


def _rows(spark, sf_dir, params=tracker.TrackParams(), name="fx_detections"):
    key = (spark.sparkContext.applicationId, folder(spark), sf_dir, params, name)
    now = (*key, _state_of(spark, f"{sf_dir}/part.parquet"))  # the table that these fixtures come from
    if now not in _TRACKED:
        for old in [k for k in _TRACKED if k[:5] == key]:
            del _TRACKED[old]
        detections = fixture(spark, sf_dir, name)
        last = fixture(spark, sf_dir, "fx_frames").groupBy("camera_id").agg(F.max("frame_id").alias("last_frame"))
        _TRACKED[now] = written(tracker.track(detections.drop("vehicle_id"), last, params), "tracked")
    return _TRACKED[now]


def track_segments(spark, sf_dir):
    found = tracker.track_segments(fixture(spark, sf_dir, "fx_detections").drop("vehicle_id"), 45)
    return found.groupBy("camera_id", "segment").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.count("*").alias("n"))


def track_summary(spark, sf_dir):
    """Ids issued and tracks confirmed by camera."""
    rows = _rows(spark, sf_dir).filter("kind = 'out'")
    return rows.groupBy("camera_id").agg(F.countDistinct("segment", "track_id").alias("issued"), F.count_if("has_point").alias("points"))


def track_points(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("kind = 'out' and has_point")
    near = (F.abs(F.col("x") - F.col("det_x")) < 3) & (F.abs(F.col("y") - F.col("det_y")) < 3)
    return rows.select("camera_id", "frame_id", F.col("det_x").cast("int").alias("xmin"), F.col("det_y").cast("int").alias("ymin"), near.alias("near"))


def track_points_busy(spark, sf_dir):
    """Cameras that are never without vehicles, in slices of 1,000 frames."""
    last = fixture(spark, sf_dir, "fx_frames").groupBy("camera_id").agg(F.max("frame_id").alias("last_frame"))
    rows = tracker.track(fixture(spark, sf_dir, "fx_detections_busy").drop("vehicle_id"), last, cut=tracker.SliceParams(frames=1000, warmup=400)).filter("kind = 'out' and has_point")
    near = (F.abs(F.col("x") - F.col("det_x")) < 3) & (F.abs(F.col("y") - F.col("det_y")) < 3)
    return rows.select("camera_id", "frame_id", F.col("det_x").cast("int").alias("xmin"), F.col("det_y").cast("int").alias("ymin"), near.alias("near"))


def published_objects(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("kind = 'out' and det_x is not null")
    det = [F.col(c).cast("int") for c in ("det_x", "det_y", "det_w", "det_h")]
    shown = rows.filter(boxes.inside(*det, F.lit(1920), F.lit(1080)))
    return shown.select("camera_id", "frame_id", det[0].alias("xmin"), det[1].alias("ymin"))


def trajectory_summary(spark, sf_dir):
    found = trajectories.trajectories(_rows(spark, sf_dir), 38)
    return found.select("camera_id", "start_frame", "end_frame", "duration", "n_points", F.size("points").alias("kept_points"))


def trajectory_lines(spark, sf_dir):
    found = trajectories.with_lines(trajectories.trajectories(_rows(spark, sf_dir), 30))
    return found.select("camera_id", "start_frame", "end_frame", "day", F.substring("path", 1, 32).alias("path_start"), F.size("lines").alias("n_lines"))


def trajectory_files(spark, sf_dir):
    """Trajectories written as text, many tracks a file, and read back by the index: what their lines say."""
    path = f"{folder(spark)}/kerbside/trajectories-{uuid.uuid4().hex}"
    index = trajectories.write_trajectories(trajectories.trajectories(_rows(spark, sf_dir), 30), path, text=True)
    text = F.col("text")
    said = lambda pattern: F.regexp_extract(text, pattern, 1)
    numbers = F.regexp_extract_all(text, F.lit(r"(?m)^frame_(\d+): x: [0-9.]+, y: [0-9.]+, class: [1-6]$"), F.lit(1))
    read = read_bundles(index, path)
    return read.select(F.col("key").cast("int").alias("camera_id"), F.substring("name", 1, 32).alias("path_start"), said(r"duration_frame: (\d+)").cast("long").alias("duration"), F.size(F.split(text, "\n")).alias("n_lines"), F.array_join(numbers, ",").alias("frames"))


_TRACK = ("camera_id", "segment", "track_id")


def _color_votes(rows):
    """A vote for each frame in which a track was seen, as a classifier gives it from its box, and one a track for a track that is not there."""
    seen = rows.filter("kind = 'out' and has_point").select(*_TRACK, F.col("frame_id").alias("vote_seq"), F.expr("cast((cast(det_y as int) div 100 + frame_id div 4) % 8 + 1 as int)").alias("color"), ((50 + (F.col("frame_id") * 37) % 50) / 100.0).alias("confidence"))
    nobody = seen.withColumn("track_id", -1 - F.col("track_id")).dropDuplicates([*_TRACK])
    return seen.unionByName(nobody).select(F.struct(*_TRACK).alias("track"), "vote_seq", "color", "confidence")


def track_colors(spark, sf_dir):
    """Trajectories with the colour that their track's votes end with."""
    rows = _rows(spark, sf_dir)
    colors = votes.color_majority(_color_votes(rows), key="track").select("track.*", "color")
    return trajectories.with_colors(trajectories.trajectories(rows, 30), colors, _TRACK).select("camera_id", "start_frame", "end_frame", "color")


def message_parts(spark, sf_dir):
    """(objects, hazards) of all frames, from tracks: their ids, stable classes and colours so far, those outside the left 500 pixels unpublished."""
    rows = _rows(spark, sf_dir)
    leading = votes.color_so_far(_color_votes(rows), key="track").select("track.*", "vote_seq", "color")
    out = trajectories.with_colors_so_far(rows.filter("kind = 'out'"), leading).filter("det_x is not null")
    x, y, w, h = (F.col(c).cast("int") for c in ("det_x", "det_y", "det_w", "det_h"))
    boxed = boxes.normalize_boxes(out.withColumns({"xmin": x, "ymin": y, "xmax": x + w, "ymax": y + h}), F.lit(1920), F.lit(1080))
    unit = ("x_norm", "y_norm", "w_norm", "h_norm")
    objects = boxed.select("camera_id", "frame_id", F.col("track_id").alias("id"), F.col("class_id").alias("target_type"), *unit, "color", boxes.inside(x, y, w, h, F.lit(500), F.lit(1080)).alias("published"))
    found = hazards.map_hazards(boxes.normalize_boxes(scenes.good_hazards(spark, sf_dir), F.lit(1920), F.lit(1080))).select("camera_id", "frame_id", F.col("target_id").alias("id"), "target_type", *unit)
    return objects, found


def message_digest(made):
    """What the SQL can say of messages."""
    total = lambda f: F.aggregate("objects", F.lit(0.0), lambda a, o: a + f(o))
    ids = F.size(F.array_distinct(F.transform(F.filter("objects", lambda o: o["color"] > 0), lambda o: o["id"]))).cast("long")
    return made.select("camera_id", "frame_id", "frame_seq", "objects_number", "published_number", F.round(total(lambda o: o["x_norm"]) * 1920).cast("long").alias("x_sum"), total(lambda o: o["color"].cast("double")).cast("long").alias("color_sum"), ids.alias("n_ids"))


def track_messages(spark, sf_dir):
    """A frame's message from tracks and hazards."""
    return message_digest(messages.frame_messages(fixture(spark, sf_dir, "fx_frames"), *message_parts(spark, sf_dir)))


def tracks_low_score(spark, sf_dir):
    """With a threshold over the detector's the second round has work."""
    rows = _rows(spark, sf_dir, tracker.TrackParams(track_thresh=0.5)).filter("kind = 'out'")
    return rows.groupBy("camera_id").agg(F.countDistinct("segment", "track_id").alias("tracks"), F.count_if("has_point").alias("points"), F.count("*").alias("n"))


def gated_outliers(spark, sf_dir):
    """Matches farther from their track's prediction than 95 % would be (chi-square with four degrees of freedom), where one vehicle in three
    jumps once: the jump and the return from it. xmin is the filtered box's, as a track that is found again still shows its earlier detection."""
    found = _rows(spark, sf_dir, name="fx_detections_jumpy").filter("kind = 'out' and gate_d2 > 9.4877")
    return found.select("camera_id", "frame_id", F.round("x").cast("int").alias("xmin"), "has_point")


QUERIES = {f.__name__: f for f in (assign_boxes, assign_ambiguous, track_points_busy, track_segments, track_summary, track_points, published_objects, trajectory_summary, trajectory_lines, trajectory_files, track_colors, track_messages, tracks_low_score, gated_outliers)}

_T = """, k as (select camera_id, vehicle_id, frame_id, xmin, ymin, frame_id - lag(frame_id) over w = 1 pm, lead(frame_id) over w - frame_id = 1 nx from fx_detections window w as (partition by vehicle_id order by frame_id)),
 st as (select vehicle_id, camera_id, min(frame_id) s from k where coalesce(nx, false) or frame_id = 1 group by 1, 2),
 pt as (select k.camera_id, k.vehicle_id, k.frame_id, k.xmin, k.ymin from k join st using (vehicle_id) where coalesce(pm, false) and k.frame_id >= s + case when s = 1 then 1 else 2 end),
 tr as (select st.camera_id, st.vehicle_id, s, max(k.frame_id) e, (select count(*) from pt where pt.vehicle_id = st.vehicle_id) n from st join k using (vehicle_id) group by 1, 2, 3)"""

_PB = ", pb as (select k.camera_id, k.vehicle_id, k.frame_id from k join (select vehicle_id, min(frame_id) p from pt group by 1) using (vehicle_id) where k.frame_id >= p)"
_VOTED = _T + """, vt as (select vehicle_id, frame_id q, (ymin//100+frame_id//4)%8+1 color, (50+(frame_id*37)%50)/100.0::double confidence from pt),
 vr as (select *, sum(case when confidence>0.95 then 3 else 1 end) over (partition by vehicle_id, color order by q) hits from vt), vl as (select *, min(case when hits>4 then q end) over (partition by vehicle_id) lk from vr),
 vc as (select vehicle_id, q, color, hits, max(hits*10-color) over (partition by vehicle_id order by q) m from vl where lk is null or q<=lk),
 co as (select vehicle_id, (10-arg_max(m, q)%10)%10 color from vc group by 1)"""

ORACLE_SQL = {
    "gated_outliers": oracle("""select camera_id, frame_id, xmin, frame_id-f=1 has_point from (select *, lag(xmin) over w b, lag(frame_id) over w f from fx_detections_jumpy window w as (partition by vehicle_id order by frame_id)) where vehicle_id%3=0 and (xmin=210 or b=210)""", "fx_detections_jumpy"),
    "tracks_low_score": oracle(""", w as (select camera_id, vehicle_id, frame_id f, confidence >= 0.5 h, frame_id - row_number() over (partition by vehicle_id order by frame_id) isl from fx_detections),
 x as (select *, coalesce(h and lead(h) over v and lead(f) over v = f+1, false) hh from w window v as (partition by vehicle_id order by f)), st as (select vehicle_id, min(f) s from x where hh or (h and f=1) group by 1),
 y as (select x.*, s, h and (s is null or f < s) lone, min(case when h and f >= s then f end) over (partition by x.vehicle_id, isl) fh from x left join st using (vehicle_id))
 select camera_id, count(*) filter (lone) + count(distinct vehicle_id) filter (s is not null) tracks, count(*) filter (f > fh and f >= s + case when s=1 then 1 else 2 end) points, count(*) filter (lone or f >= fh) n from y group by 1""", "fx_detections"),
    "track_colors": oracle(_VOTED + " select tr.camera_id, s start_frame, e end_frame, cast(coalesce(color, 0) as int) color from tr left join co using (vehicle_id) where n >= 30", "fx_detections"),
    "track_messages": oracle(scenes._HZ + _VOTED + _PB + """, ob as (select pb.*, pt.xmin, pt.ymin, pt.xmin+120<=500 p from pb asof join pt on pb.vehicle_id = pt.vehicle_id and pb.frame_id >= pt.frame_id),
 oc as (select ob.camera_id, ob.frame_id, ob.xmin, p, (10-m%10)%10 color, 1 own from ob asof join vc on ob.vehicle_id = vc.vehicle_id and ob.frame_id >= vc.q union all select camera_id, frame_id, xmin, true, 0, 0 from hz),
 n as (select camera_id, frame_id, count(*) c, count(*) filter (p) pc, sum(xmin) filter (p) xs, sum(color) filter (p) cs, sum(own) filter (p) ids from oc group by 1, 2)
 select f.camera_id, f.frame_id, f.frame_id frame_seq, coalesce(c,0) objects_number, coalesce(pc,0) published_number, cast(coalesce(xs,0) as bigint) x_sum, cast(coalesce(cs,0) as bigint) color_sum, cast(coalesce(ids,0) as bigint) n_ids from fx_frames f left join n using (camera_id, frame_id)""", "fx_hazards", "fx_detections", "fx_frames"),
    "assign_boxes": oracle(geometry._AGED + f" select camera_id, frame_id, a.v a_id, b.v b_id, round({geometry._IOU},6) iou from (select camera_id, frame_id, a, unnest(list_filter(coalesce(bb, []), lambda b: b.v = a.v)) b from pa)", "fx_detections"),
    "assign_ambiguous": oracle(f""", both_ as (select *, 0 side from fx_boxes_many_a union all select *, 1 from fx_boxes_many_b),
 f as (select camera_id, frame_id, box_id//2 v, list({{'i':box_id,'x':xmin,'y':ymin,'x2':xmax,'y2':ymax}}) filter (side=0) aa, list({{'i':box_id,'x':xmin,'y':ymin,'x2':xmax,'y2':ymax}}) filter (side=1) bb from both_ group by 1, 2, 3),
 p as (select camera_id, frame_id, v, a.i a_id, b.i b_id, {geometry._IOU} iou from (select camera_id, frame_id, v, a, unnest(bb) b from (select camera_id, frame_id, v, unnest(aa) a, bb from f)) where {geometry._IOU} > 0.4),
 c as (select camera_id, frame_id, v, list({{'a':a_id,'b':b_id,'iou':iou}}) ps from p group by 1, 2, 3),
 s as (select camera_id, frame_id, v, ps, [p1] m, p1.iou-0.4 g from (select *, unnest(ps) p1 from c) union all
  select camera_id, frame_id, v, ps, [p1, p2], p1.iou+p2.iou-0.8 from (select *, unnest(ps) p2 from (select *, unnest(ps) p1 from c)) where p1.a < p2.a and p1.b <> p2.b),
 best as (select camera_id, frame_id, arg_max(m, g) m from s group by camera_id, frame_id, v)
 select camera_id, frame_id, x.a a_id, x.b b_id, round(x.iou,6) iou from (select camera_id, frame_id, unnest(m) x from best)""", "fx_boxes_many_a", "fx_boxes_many_b"),
    "track_points_busy": oracle(_T.replace("fx_detections", "fx_detections_busy") + " select camera_id, frame_id, xmin, ymin, true near from pt", "fx_detections_busy"),
    "trajectory_files": oracle(_T + """, fr as (select vehicle_id, string_agg(cast(frame_id as varchar), ',' order by frame_id) frames from pt group by 1)
 select camera_id, strftime(epoch_ms(e*40), '%Y-%m-%d/tracks/%Y%m%d%H%M%S') path_start, e-s duration, cast(n+2 as int) n_lines, frames from tr join fr using (vehicle_id) where n >= 30""", "fx_detections"),
    "track_segments": oracle(""", f as (select camera_id, frame_id, count(*) n from fx_detections group by 1, 2), g as (select *, case when frame_id - lag(frame_id) over w > 46 then 1 else 0 end x from f window w as (partition by camera_id order by frame_id)),
 h as (select *, cast(sum(x) over (partition by camera_id order by frame_id) as bigint) segment from g) select camera_id, segment, min(frame_id) first_frame, max(frame_id) last_frame, cast(sum(n) as bigint) n from h group by 1, 2""", "fx_detections"),
    "track_summary": oracle(_T + """ select camera_id, cast(sum(i) as bigint) issued, cast(sum(p) as bigint) points from (select camera_id, count(*) i, 0 p from st group by 1 union all
 select k.camera_id, count(*), 0 from k join st using (vehicle_id) where frame_id < s group by 1 union all select camera_id, 0, count(*) from pt group by 1) group by 1""", "fx_detections"),
    "track_points": oracle(_T + " select camera_id, frame_id, xmin, ymin, true near from pt", "fx_detections"),
    "published_objects": oracle(_T + _PB + """ select pb.camera_id, pb.frame_id, pt.xmin, pt.ymin from pb asof join pt on pb.vehicle_id = pt.vehicle_id and pb.frame_id >= pt.frame_id""", "fx_detections"),
    "trajectory_summary": oracle(_T + " select camera_id, s start_frame, e end_frame, e-s duration, cast(n as int) n_points, cast(n as int) kept_points from tr where n >= 38", "fx_detections"),
    "trajectory_lines": oracle(_T + " select camera_id, s start_frame, e end_frame, strftime(epoch_ms(e*40), '%Y-%m-%d') as day, concat(strftime(epoch_ms(e*40), '%Y-%m-%d/tracks/%Y%m%d%H%M%S')) path_start, cast(n+2 as int) n_lines from tr where n >= 30", "fx_detections"),
}
