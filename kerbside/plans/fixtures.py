"""Inputs of the registered queries, derived from the given tables by SQL that means the same in Spark and DuckDB (FIXTURES.md)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "supplier", "part", "events", "embeddings")

#: Tokens that the two SQL dialects write differently.
SPARK = {"{U}": "explode", "{SEQ}": "sequence", "{D}": " div ", "{ARR}": "array", "{US}": "unix_micros(cast(ts as timestamp))"}
DUCK = {"{U}": "unnest", "{SEQ}": "generate_series", "{D}": "//", "{ARR}": "list_value", "{US}": "epoch_us(ts)"}

SQL = {
    "fx_frames": """select cast(c.camera_id as int) camera_id, cast(f.frame_id as bigint) frame_id,
 cast(f.frame_id*40 as bigint) ts_ms, 1920 width, 1080 height
 from (select {U}({SEQ}(0,5)) camera_id) c
 cross join (select {U}({SEQ}(1, mx)) frame_id from (select (max(p_partkey){D}24)*120+120 mx from part) m) f""",
    "fx_detections": """select camera_id, sf+k frame_id, v vehicle_id,
 cast(case when (v+k)%9=0 then 1+(v+1)%6 else 1+v%6 end as int) label,
 (36+(v*7+k*13)%60)/100.0D0 confidence,
 cast(50+8*k as int) xmin, cast(100+200*lane as int) ymin, cast(170+8*k as int) xmax, cast(180+200*lane as int) ymax
 from (select v, camera_id, lane, sf, {U}({SEQ}(0,dur-1)) k from
   (select p_partkey v, cast(p_partkey%6 as int) camera_id, (p_partkey{D}6)%4 lane, (p_partkey{D}24)*120+1 sf, 40+p_size%20 dur from part) a) b
 where (v*31+k*17)%13<>0""",
    "fx_raw_outputs": """select camera_id, frame_id, vehicle_id*4+j box_idx,
 ((xmin+xmax)/2.0D0 + 10*j*j)/3.0D0 cx, ((ymin+ymax)/2.0D0 + 7*j*j)/3.0D0 + 140.0D0 cy, (xmax-xmin)/3.0D0 w, (ymax-ymin)/3.0D0 h,
 {ARR}(case when label=1 then confidence-0.021D0*j else 0.05D0 end, case when label=2 then confidence-0.021D0*j else 0.05D0 end,
  case when label=3 then confidence-0.021D0*j else 0.05D0 end, case when label=4 then confidence-0.021D0*j else 0.05D0 end,
  case when label=5 then confidence-0.021D0*j else 0.05D0 end, case when label=6 then confidence-0.021D0*j when (vehicle_id+frame_id)%11=0 then 0.4D0+0.001D0*j else 0.05D0 end) cls_conf
 from (select *, {U}({SEQ}(0,3)) j from fx_detections) d""",
    "fx_hazards": """select cast(p_partkey%6 as int) camera_id, (p_partkey{D}24)*120+5+6*(p_partkey%7) frame_id, p_partkey cand_id,
 cast(p_partkey%4 as int) label, cast(40+p_size*9 as int) xmin, cast(60+(p_partkey*53)%800 as int) ymin,
 cast(40+p_size*9+30 as int) xmax, cast(60+(p_partkey*53)%800+40 as int) ymax from part""",
    "fx_radar": """select camera_id, n sweep_id, n*50+(n*7)%13 ts_ms, o obj_idx,
 ((n*17+o*31+camera_id*5)%101)/100.0D0 x_norm_long, ((n*13+o*7)%101)/100.0D0 y_norm_long,
 ((n*11+o*3)%101)/100.0D0 x_norm_short, ((n*19+o*23+camera_id)%101)/100.0D0 y_norm_short
 from (select camera_id, n, {U}({SEQ}(0,2)) o from (select camera_id, {U}({SEQ}(1, mx)) n from
   (select cast(r_regionkey as int) camera_id, mx from region cross join (select ((max(p_partkey){D}24)*120+120)*40{D}50 mx from part) m) q) p) z
 where n%400 >= 30""",
    "fx_color_votes": "select user_id track_id, event_id vote_seq, cast(1+event_id%8 as int) color, (50+(event_id*37)%50)/100.0D0 confidence from events",
    "fx_registry": """select r_name mec_name, n_name pole_name, cast(n_nationkey as int) pole_index, cast(s_suppkey as int) camera_index,
 case when s_suppkey%2=0 then 'upstream' else 'downstream' end direction, case when s_suppkey%4<2 then 'long' else 'short' end focal_type,
 concat('10.', cast(s_suppkey{D}256 as int), '.', cast(s_suppkey%256 as int), '.1') ip, case when s_suppkey%5=0 then null else cast(8000+s_suppkey as int) end port
 from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey""",
    "fx_stage_log": "select event_type stage, event_id seq, {US} t_us, cast(1+event_id{D}4000 as int) batch_size from events",
    "fx_pixels": """select img_id, r, c, cast((r*7+c*13+img_id*29)%256 as int) b, cast((r*c+img_id*11)%256 as int) g, cast((r*r+c*3+img_id*5)%256 as int) rr
 from (select img_id, r, {U}({SEQ}(0,15)) c from (select img_id, {U}({SEQ}(0,11)) r from (select p_partkey img_id from part) x) y) z""",
    "fx_boxes_b": """select camera_id, frame_id, vehicle_id, label, confidence, xmin+5 xmin, ymin+3 ymin, xmax+5 xmax, ymax+3 ymax
 from fx_detections where vehicle_id%4<>0""",
    "fx_boxes_many_a": """select camera_id, frame_id, vehicle_id*2+d box_id, xmin+35*d xmin, ymin, xmax+35*d xmax, ymax
 from (select *, {U}({SEQ}(0, case when vehicle_id%3=0 then 1 else 0 end)) d from fx_detections) q""",
    "fx_boxes_many_b": """select camera_id, frame_id, vehicle_id*2+d box_id, xmin+5+25*d+frame_id%7*d xmin, ymin+3 ymin, xmax+5+25*d+frame_id%7*d xmax, ymax+3 ymax
 from (select *, {U}({SEQ}(0, case when vehicle_id%5<2 then 1 else 0 end)) d from fx_detections where vehicle_id%4<>0) q""",
    "fx_detections_busy": """select camera_id, sf+k frame_id, v vehicle_id,
 cast(case when (v+k)%9=0 then 1+(v+1)%6 else 1+v%6 end as int) label, (36+(v*7+k*13)%60)/100.0D0 confidence,
 cast(50+8*k as int) xmin, cast(y as int) ymin, cast(170+8*k as int) xmax, cast(y+80 as int) ymax
 from (select v, camera_id, y, sf, {U}({SEQ}(0,dur-1)) k from (select p_partkey v, cast(p_partkey%6 as int) camera_id,
   100+200*((p_partkey{D}6)%4)+100*((p_partkey{D}24)%2) y, (p_partkey{D}24)*60+1 sf, 40+p_size%20 dur from part) a) b
 where (v*31+k*17)%13<>0""",
    "fx_detections_jumpy": """select camera_id, frame_id, vehicle_id, label, confidence, xmin, ymin + j ymin, xmax, ymax + j ymax
 from (select *, case when vehicle_id%3=0 and xmin=210 then 45 else 0 end j from fx_detections) d""",
    "fx_frames_gappy": "select * from fx_frames where frame_id%500 not between 100 and 140",
}

#: Numbers of a block of IN_BLOCKS.
BLOCK = 1000
_BLOCKS = "select {U}({SEQ}(0L, (mx-1) div %d)) block, mx from (select %%s mx from part)" % BLOCK
_IN_BLOCK = f"{{U}}({{SEQ}}(block*{BLOCK}+1, least(block*{BLOCK}+{BLOCK}, mx)))"

#: The same rows as SQL's for Spark, which would count up to the largest number in one task: blocks of numbers are dealt out first.
IN_BLOCKS = {
    "fx_frames": f"""select {{U}}({{SEQ}}(0,5)) camera_id, frame_id, frame_id*40 ts_ms, 1920 width, 1080 height
 from (select {_IN_BLOCK} frame_id from (select /*+ REPARTITION({{N}}) */ * from ({_BLOCKS % "(max(p_partkey) div 24)*120+120"})))""",
    "fx_radar": SQL["fx_radar"][: SQL["fx_radar"].index(" from (select camera_id, n,")] + f""" from (select camera_id, n, {{U}}({{SEQ}}(0,2)) o from (select camera_id, {_IN_BLOCK} n from (select /*+ REPARTITION({{N}}) */ *
  from (select cast(r_regionkey as int) camera_id, block, mx from region cross join ({_BLOCKS % "((max(p_partkey) div 24)*120+120)*40 div 50"})))))
 where n%400 >= 30""",
}


def _needs(name: str) -> list[str]:
    return [n for n in SQL if n != name and re.search(rf"\b{n}\b", SQL[name])]


def _written(name: str, tokens: dict[str, str]) -> str:
    text = IN_BLOCKS.get(name, SQL[name]) if tokens is SPARK else SQL[name]
    for token, means in tokens.items():
        text = text.replace(token, means)
    return re.sub(r"(\d+\.\d+)D0", r"\1D" if tokens is SPARK else r"\1::double", text)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame. Where a row becomes many, the rows are dealt out first: a table's file may be too small for more than one task."""
    for n in _needs(name):
        fixture(spark, sf_dir, n)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    text = _written(name, SPARK).replace("{N}", str(parts))
    for table in TABLES:
        if re.search(rf"\b{table}\b", text):
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            (rows.repartition(parts) if "{U}" in SQL[name] and name not in IN_BLOCKS else rows).createOrReplaceTempView(table)
    found = spark.sql(text)
    found.createOrReplaceTempView(name)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL: the fixtures as common tables, then body, which may go on with more of them (``, x as (...) select``) or select."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _needs(name):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    text = ",\n".join(f"{n} as materialized ({_written(n, DUCK)})" for n in order)
    return f"with {text}{'' if body.lstrip().startswith(',') else chr(10)}{body}" if text else body
