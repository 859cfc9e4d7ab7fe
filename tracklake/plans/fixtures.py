"""Tracking data derived from the driver's tables: each user of `events` is an animal, each event a frame of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    u = F.col("user_id")
    return events.select(
        (u % 3).cast("int").alias("video"), (u % 12).cast("int").alias("clip"), frame.cast("int").alias("frame"), u.cast("int").alias("gt_id"),
        F.col("event_id").cast("int").alias("event_id"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _boxes(b: DataFrame) -> DataFrame:
    f = F.col("frame") % 60
    x, y = ((F.col("gt_id") % 15) * 256 + 2 * f).cast("double"), (F.floor(F.col("gt_id") / 15) * 200 + f).cast("double")
    return b.withColumns({"x1": x, "y1": y, "x2": x + 40, "y2": y + 30})


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(base(spark, sf_dir)).select("video", "clip", "frame", "gt_id", "x1", "y1", "x2", "y2")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction of each animal, shifted and renamed; an event's true box is in its own row, so no join is needed."""
    b = _boxes(base(spark, sf_dir)).filter("event_type <> 'error'")
    d = F.when((F.col("event_type") == "signup") & (F.col("k") % 2 == 0), 90.0).otherwise(0.0)
    dx, dy = F.col("event_id") % 5 + d, F.col("event_id") % 3 + d
    swap = F.col("frame") % 20 >= 10
    even = F.floor(F.col("gt_id") / 12) % 2 == 0
    pred = F.when(F.col("k") % 25 == 0, F.col("gt_id") + 100000).when(swap & even, F.col("gt_id") + 12).when(swap, F.col("gt_id") - 12).otherwise(F.col("gt_id"))
    return b.select(
        "video", "clip", "frame", pred.cast("int").alias("pred_id"),
        (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"),
        (1 / (1 + F.col("value") / 100)).alias("score"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = base(spark, sf_dir).groupBy("video", "clip").agg(F.max("frame").alias("last"))
    c, v = F.col("clip"), F.col("video").cast("string")
    return last.select(
        "video", "clip",
        F.concat(F.lit("v"), v, F.lit("-Loop"), F.lpad(c.cast("string"), 2, "0"), F.lit(".mp4")).alias("loop_clip_name"),
        F.concat(F.lit("v"), v, F.lit(".mov")).alias("video_name"),
        (c * 1000 + 1).cast("int").alias("loop_start_frame_ffmpeg"), (c * 1000 + 1 + F.col("last")).cast("int").alias("loop_end_frame_ffmpeg"),
        (c * 1000 + F.floor(F.col("last") / 2)).cast("int").alias("escape_start_frame_0idx"),
        F.when(c % 2 == 0, "Triggered").otherwise("Spontaneous").alias("escape_type"), F.lit(59.94).alias("fps"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = clips(spark, sf_dir).select("clip", (F.col("escape_start_frame_0idx") - (F.col("loop_start_frame_ffmpeg") - 1)).alias("from"))
    p = predictions(spark, sf_dir).join(F.broadcast(start), "clip")  # at most twelve clips
    return p.select(
        "video", "clip", F.col("frame").alias("t"), F.col("pred_id").alias("individual"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"),
        (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.col("score").alias("confidence"), (F.col("frame") >= F.col("from")).cast("tinyint").alias("escape_state"),
    )


def via_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    text = lambda c: F.col(c).cast("string")
    shape = F.concat(F.lit('{"name":"rect","x":'), text("l_partkey"), F.lit(',"y":'), text("l_suppkey"), F.lit(',"width":'), q.cast("string"), F.lit(',"height":'), (q + 1).cast("string"), F.lit("}"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat(F.lit("frame_"), F.lpad(text("l_orderkey"), 8, "0"), F.lit(".png")).alias("filename"), shape.alias("region_shape_attributes"),
        F.concat(F.lit('{"track":"'), text("l_linenumber"), F.lit('"}')).alias("region_attributes"), "l_linenumber",
    )


#: The same views in SQL, for comparison.
VIEWS = {
    "base": """select cast(user_id % 3 as int) video, cast(user_id % 12 as int) clip,
 cast(row_number() over (partition by user_id order by ts,event_id)-1 as int) frame,
 cast(user_id as int) gt_id, cast(event_id as int) event_id, event_type, value, cast(json_extract_string(props,'$.k') as int) k from events""",
    "gt": """select video,clip,frame,gt_id,
 cast((gt_id % 15)*256 + 2*(frame % 60) as double) x1, cast(floor(gt_id/15)*200 + (frame % 60) as double) y1,
 cast((gt_id % 15)*256 + 2*(frame % 60) + 40 as double) x2, cast(floor(gt_id/15)*200 + (frame % 60) + 30 as double) y2 from base""",
    "pred": """select b.video,b.clip,b.frame, cast(case when b.k % 25 = 0 then b.gt_id+100000 when b.frame % 20 >= 10 and floor(b.gt_id/12) % 2 = 0 then b.gt_id+12 when b.frame % 20 >= 10 then b.gt_id-12 else b.gt_id end as int) pred_id,
 g.x1+(b.event_id % 5)+o.d x1, g.y1+(b.event_id % 3)+o.d y1, g.x2+(b.event_id % 5)+o.d x2, g.y2+(b.event_id % 3)+o.d y2,
 1/(1+b.value/100) score
 from base b join gt g on b.clip=g.clip and b.frame=g.frame and b.gt_id=g.gt_id
 join (select event_id, case when event_type='signup' and k % 2 = 0 then 90.0::double else 0.0::double end d from base) o on o.event_id=b.event_id
 where b.event_type <> 'error'""",
    "clips": """select video, clip, concat('v', cast(video as varchar), '-Loop', lpad(cast(clip as varchar),2,'0'), '.mp4') loop_clip_name,
 concat('v', cast(video as varchar), '.mov') video_name, cast(clip*1000+1 as int) loop_start_frame_ffmpeg, cast(clip*1000+1+max(frame) as int) loop_end_frame_ffmpeg,
 cast(clip*1000 + floor(max(frame)/2) as int) escape_start_frame_0idx, case when clip % 2 = 0 then 'Triggered' else 'Spontaneous' end escape_type, cast(59.94 as double) fps
 from base group by video, clip""",
    "observations": """select p.video,p.clip,p.frame t,p.pred_id individual,(x1+x2)/2 x,(y1+y2)/2 y,x2-x1 w,y2-y1 h,score confidence,
 cast(case when p.frame >= c.escape_start_frame_0idx-(c.loop_start_frame_ffmpeg-1) then 1 else 0 end as tinyint) escape_state
 from pred p join clips c on p.clip=c.clip""",
    "via_rows": """select l_orderkey, concat('frame_', lpad(cast(l_orderkey as varchar),8,'0'), '.png') filename,
 concat('{"name":"rect","x":', cast(l_partkey as varchar), ',"y":', cast(l_suppkey as varchar), ',"width":', cast(cast(trunc(l_quantity) as int) as varchar), ',"height":', cast(cast(trunc(l_quantity) as int)+1 as varchar), '}') region_shape_attributes,
 concat('{"track":"', cast(l_linenumber as varchar), '"}') region_attributes, l_linenumber from lineitem""",
}


def sql(*views: str) -> str:
    """A WITH clause of views, and of those that they read."""
    needs = {"gt": ["base"], "pred": ["base", "gt"], "clips": ["base"], "observations": ["base", "gt", "pred", "clips"]}
    wanted = [v for v in VIEWS if v in views or any(v in needs.get(x, []) for x in views)]
    return "with " + ", ".join(f"{v} as ({VIEWS[v]})" for v in wanted)
