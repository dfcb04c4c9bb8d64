"""Queries: boxes, decoding, suppression, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.operators import boxes, detections, pairs
from kerbside.plans.fixtures import fixture, oracle


def _d(v):
    return boxes.rounded(v, 6)


def letterbox_geometry(spark, sf_dir):
    frames = fixture(spark, sf_dir, "fx_frames").select("camera_id", "frame_id", (F.col("width") - F.col("frame_id") % 5 * 300).cast("int").alias("width"), "height")
    return boxes.letterbox_geometry(frames).withColumn("ratio", _d("ratio"))


def dequantize(spark, sf_dir):
    q = F.array(*[F.floor(F.get("cls_conf", F.lit(i)) * 100).cast("tinyint") for i in range(6)])
    raw = fixture(spark, sf_dir, "fx_raw_outputs").select("camera_id", "frame_id", "box_idx", q.alias("q"))
    names = tuple(f"c{i + 1}" for i in range(6))
    return detections.dequantize(raw, "q", 0.01, names).select("camera_id", "frame_id", "box_idx", *[_d(c).alias(c) for c in names])


def decode_multilabel(spark, sf_dir):
    found = detections.decode_multilabel(fixture(spark, sf_dir, "fx_raw_outputs"))
    return found.select("camera_id", "frame_id", "box_idx", "class_id", *[_d(c).alias(c) for c in ("score", "x1", "y1", "x2", "y2")])


def decode_bestclass(spark, sf_dir):
    found = detections.decode_best_class(fixture(spark, sf_dir, "fx_raw_outputs"))
    return found.select("camera_id", "frame_id", "box_idx", "class_id", *[_d(c).alias(c) for c in ("score", "x1", "y1", "x2", "y2")])


def _kept(spark, sf_dir):
    return detections.nms(detections.decode_multilabel(fixture(spark, sf_dir, "fx_raw_outputs")))


def nms(spark, sf_dir):
    return _kept(spark, sf_dir).select("camera_id", "frame_id", "class_id", *[_d(c).alias(c) for c in ("score", "x1", "y1", "x2", "y2")])


def top_detections(spark, sf_dir):
    found = detections.top_detections(detections.decode_multilabel(fixture(spark, sf_dir, "fx_raw_outputs")), 3)
    return found.select("camera_id", "frame_id", "box_idx", "class_id", _d("score").alias("score"))


def unletterbox_clip(spark, sf_dir):
    found = detections.decode_multilabel(fixture(spark, sf_dir, "fx_raw_outputs"))
    geometry = boxes.letterbox_geometry(found.withColumns({"width": F.lit(1920), "height": F.lit(1080)}))
    done = boxes.to_source_pixels(geometry, F.col("ratio"), F.col("tx"), F.col("ty"), F.col("width"), F.col("height"))
    return done.select("camera_id", "frame_id", "box_idx", "class_id", "xmin", "ymin", "xmax", "ymax")


def detections_per_class(spark, sf_dir):
    """Raw outputs to valid detections, counted by camera and class."""
    geometry = boxes.letterbox_geometry(_kept(spark, sf_dir).withColumns({"width": F.lit(1920), "height": F.lit(1080)}))
    done = boxes.to_source_pixels(geometry, F.col("ratio"), F.col("tx"), F.col("ty"), F.col("width"), F.col("height"))
    return boxes.valid_detections(done, F.col("width"), F.col("height")).groupBy("camera_id", "class_id").agg(F.count("*").alias("n"))


def detections_valid(spark, sf_dir):
    found = fixture(spark, sf_dir, "fx_detections").withColumn("xmin", F.col("xmin") - 300)
    return boxes.valid_detections(found, F.lit(480), F.lit(600)).select("camera_id", "frame_id", "vehicle_id", "xmin", "ymin", "xmax", "ymax")


def normalized_boxes(spark, sf_dir):
    found = boxes.normalize_boxes(fixture(spark, sf_dir, "fx_detections"), F.lit(1920), F.lit(1080))
    return found.select("camera_id", "frame_id", "vehicle_id", *[_d(c).alias(c) for c in ("x_norm", "y_norm", "w_norm", "h_norm")])


def score_split(spark, sf_dir):
    return boxes.score_split(fixture(spark, sf_dir, "fx_detections"), 0.5).select("camera_id", "frame_id", "vehicle_id", "is_high")


def cadence_sample(spark, sf_dir):
    return boxes.cadence_sample(fixture(spark, sf_dir, "fx_frames_gappy"), 6).select("camera_id", "frame_id", "ts_ms")


def box_formats(spark, sf_dir):
    found = boxes.with_formats(fixture(spark, sf_dir, "fx_detections"))
    return found.select("camera_id", "frame_id", "vehicle_id", *[_d(c).alias(c) for c in ("w", "h", "cx", "cy", "aspect")])


def iou_pairs(spark, sf_dir):
    found = pairs.iou_pairs(fixture(spark, sf_dir, "fx_detections"), fixture(spark, sf_dir, "fx_boxes_b"), "vehicle_id")
    return found.withColumn("iou", _d("iou"))


def dedupe_overlaps(spark, sf_dir):
    age = lambda name: fixture(spark, sf_dir, name).select("camera_id", "frame_id", "vehicle_id", "xmin", "ymin", "xmax", "ymax", (F.col("vehicle_id") % 3 + (0 if name == "fx_detections" else F.col("frame_id") % 3)).alias("age"))
    return pairs.dedupe_overlaps(age("fx_detections"), age("fx_boxes_b"), "vehicle_id", "age")


def _sides(spark, sf_dir):
    keep = ("camera_id", "frame_id", "vehicle_id", "xmin")
    return fixture(spark, sf_dir, "fx_detections").filter("vehicle_id % 3 <> 0").select(*keep), fixture(spark, sf_dir, "fx_boxes_b").select(*keep)


def keyed_union(spark, sf_dir):
    return pairs.keyed_union(*_sides(spark, sf_dir), ["camera_id", "frame_id", "vehicle_id"])


def keyed_subtract(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return pairs.keyed_subtract(a.unionByName(a), b, ["camera_id", "frame_id", "vehicle_id"])


QUERIES = {f.__name__: f for f in (letterbox_geometry, dequantize, decode_multilabel, decode_bestclass, nms, top_detections, unletterbox_clip, detections_per_class, detections_valid, normalized_boxes, score_split, cadence_sample, box_formats, iou_pairs, dedupe_overlaps, keyed_union, keyed_subtract)}

_LABELS = "unnest(generate_series(1,6)) class_id"
_CAND = f""", cand as (select camera_id, frame_id, box_idx, cast(class_id as int) class_id, cls_conf[class_id] score,
  cx-w/2 x1, cy-h/2 y1, cx-w/2+w x2, cy-h/2+h y2 from (select *, {_LABELS} from fx_raw_outputs) where cls_conf[class_id] > 0.35)"""
_SIX = "round(score,6) score, round(x1,6) x1, round(y1,6) y1, round(x2,6) x2, round(y2,6) y2"
_NMS = _CAND + """, ranked as (select *, row_number() over (partition by camera_id, frame_id, class_id order by score desc, x1, y1, x2, y2) rk from cand),
 grouped as (select camera_id, frame_id, class_id, list({'s':score,'x1':x1,'y1':y1,'x2':x2,'y2':y2} order by rk) bs from ranked group by 1,2,3),
 walk as (
  select camera_id, frame_id, class_id, bs, 1 i, [bs[1]] kept from grouped
  union all
  select camera_id, frame_id, class_id, bs, i+1, case when len(list_filter(kept, lambda k:
     greatest(0, least(k.x2, bs[i+1].x2)-greatest(k.x1, bs[i+1].x1)) * greatest(0, least(k.y2, bs[i+1].y2)-greatest(k.y1, bs[i+1].y1)) >
     0.45 * ((k.x2-k.x1)*(k.y2-k.y1) + (bs[i+1].x2-bs[i+1].x1)*(bs[i+1].y2-bs[i+1].y1) -
       greatest(0, least(k.x2, bs[i+1].x2)-greatest(k.x1, bs[i+1].x1)) * greatest(0, least(k.y2, bs[i+1].y2)-greatest(k.y1, bs[i+1].y1))))) > 0
     then kept else list_append(kept, bs[i+1]) end
  from walk where i < len(bs)),
 nms as (select camera_id, frame_id, class_id, b.s score, b.x1 x1, b.y1 y1, b.x2 x2, b.y2 y2 from
  (select camera_id, frame_id, class_id, unnest(kept) b from walk where i = len(bs))),
 top300 as (select * from (select *, row_number() over (partition by camera_id, frame_id order by score desc, class_id, x1, y1, x2, y2) rk from nms) where rk <= 300)"""
_HALF = "cast(greatest(0, least({m}, floor(abs(({c}-{t})/(1/3.0::double))+0.5)*sign(({c}-{t})/(1/3.0::double)))) as int)"
_PX = ", ".join(_HALF.format(c=c, t=t, m=m) + f" {n}" for c, t, m, n in (("x1", 0, 1920, "xmin"), ("y1", 140, 1080, "ymin"), ("x2", 0, 1920, "xmax"), ("y2", 140, 1080, "ymax")))
_AGED = """, both_ as (select camera_id, frame_id, vehicle_id, xmin, ymin, xmax, ymax, vehicle_id%3 age, 0 side from fx_detections union all
  select camera_id, frame_id, vehicle_id, xmin+5, ymin+3, xmax+5, ymax+3, vehicle_id%3 + frame_id%3, 1 from fx_detections where vehicle_id%4<>0),
 f as (select camera_id, frame_id, list({'v':vehicle_id,'x':xmin,'y':ymin,'x2':xmax,'y2':ymax,'g':age}) filter (side=0) aa, list({'v':vehicle_id,'x':xmin,'y':ymin,'x2':xmax,'y2':ymax,'g':age}) filter (side=1) bb from both_ group by 1, 2),
 pa as (select camera_id, frame_id, unnest(aa) a, bb from f), pb as (select camera_id, frame_id, unnest(bb) b, aa from f)"""
_INTER = "(greatest(0, least(a.x2,b.x2)-greatest(a.x,b.x)+1)*greatest(0, least(a.y2,b.y2)-greatest(a.y,b.y)+1))"
_IOU = f"({_INTER}/((a.x2-a.x+1)*(a.y2-a.y+1)+(b.x2-b.x+1)*(b.y2-b.y+1)-{_INTER})::double)"

ORACLE_SQL = {
    "letterbox_geometry": oracle("""select camera_id, frame_id, w width, height, round(least(640.0::double/w, 640.0::double/height),6) ratio,
 case when 640.0::double/w < 640.0::double/height then 0 else cast(trunc((640-trunc(w*(640.0::double/height)))/2) as int) end tx,
 case when 640.0::double/w < 640.0::double/height then cast(trunc((640-trunc(height*(640.0::double/w)))/2) as int) else 0 end ty
 from (select *, cast(width - frame_id%5*300 as int) w from fx_frames)""", "fx_frames"),
    "dequantize": oracle("select camera_id, frame_id, box_idx, " + ", ".join(f"round(cast(floor(cls_conf[{i}]*100) as tinyint)*0.01::double, 6) c{i}" for i in range(1, 7)) + " from fx_raw_outputs", "fx_raw_outputs"),
    "decode_multilabel": oracle(_CAND + f" select camera_id, frame_id, box_idx, class_id, {_SIX} from cand", "fx_raw_outputs"),
    "decode_bestclass": oracle(f"select camera_id, frame_id, box_idx, cast(list_position(cls_conf, list_max(cls_conf))-1 as int) class_id, round(list_max(cls_conf),6) score, round(cx-w/2,6) x1, round(cy-h/2,6) y1, round(cx-w/2+w,6) x2, round(cy-h/2+h,6) y2 from fx_raw_outputs where list_max(cls_conf) > 0.35", "fx_raw_outputs"),
    "nms": oracle(_NMS + f" select camera_id, frame_id, class_id, {_SIX} from top300", "fx_raw_outputs").replace("with ", "with recursive ", 1),
    "top_detections": oracle(_CAND + " select camera_id, frame_id, box_idx, class_id, round(score,6) score from (select *, row_number() over (partition by camera_id, frame_id order by score desc, class_id, x1, y1, x2, y2) rk from cand) where rk <= 3", "fx_raw_outputs"),
    "unletterbox_clip": oracle(_CAND + f" select camera_id, frame_id, box_idx, class_id, {_PX} from cand", "fx_raw_outputs"),
    "detections_per_class": oracle(_NMS + f" select camera_id, class_id, count(*) n from (select camera_id, class_id, {_PX} from top300) where xmin>=0 and ymin>=0 and xmax<=1920 and ymax<=1080 group by 1,2", "fx_raw_outputs").replace("with ", "with recursive ", 1),
    "detections_valid": oracle("select camera_id, frame_id, vehicle_id, xmin-300 xmin, ymin, xmax, ymax from fx_detections where xmin-300>=0 and ymin>=0 and xmax<=480 and ymax<=600", "fx_detections"),
    "normalized_boxes": oracle("select camera_id, frame_id, vehicle_id, round(xmin/1920.0::double,6) x_norm, round(ymin/1080.0::double,6) y_norm, round((xmax-xmin)/1920.0::double,6) w_norm, round((ymax-ymin)/1080.0::double,6) h_norm from fx_detections", "fx_detections"),
    "score_split": oracle("select camera_id, frame_id, vehicle_id, confidence >= 0.5::double is_high from fx_detections", "fx_detections"),
    "cadence_sample": oracle("select camera_id, frame_id, ts_ms from (select *, row_number() over (partition by camera_id order by frame_id) k from fx_frames_gappy) where (k+1)%6=0", "fx_frames_gappy"),
    "box_formats": oracle("select camera_id, frame_id, vehicle_id, (xmax-xmin)::double w, (ymax-ymin)::double h, round(xmin+(xmax-xmin)/2.0::double,6) cx, round(ymin+(ymax-ymin)/2.0::double,6) cy, round((xmax-xmin)/(ymax-ymin)::double,6) aspect from fx_detections", "fx_detections"),
    "iou_pairs": oracle(_AGED + f" select camera_id, frame_id, a.v a_id, b.v b_id, round({_IOU},6) iou from (select camera_id, frame_id, a, unnest(bb) b from pa) where {_INTER} > 0", "fx_detections"),
    "dedupe_overlaps": oracle(_AGED + f""" select 'a' side, camera_id, frame_id, a.v id from pa where len(list_filter(coalesce(bb, []), lambda b: {_INTER} > 0 and 1-{_IOU}<0.15 and a.g<=b.g)) = 0
 union all select 'b', camera_id, frame_id, b.v from pb where len(list_filter(coalesce(aa, []), lambda a: {_INTER} > 0 and 1-{_IOU}<0.15 and a.g>b.g)) = 0""", "fx_detections"),
    "keyed_union": oracle("""select camera_id, frame_id, vehicle_id, xmin from fx_detections where vehicle_id%3<>0 union all
 select camera_id, frame_id, vehicle_id, xmin from fx_boxes_b where vehicle_id%3=0""", "fx_detections", "fx_boxes_b"),
    "keyed_subtract": oracle("select camera_id, frame_id, vehicle_id, xmin from fx_detections where vehicle_id%3<>0 and vehicle_id%4=0", "fx_detections", "fx_boxes_b"),
}
