"""The catalogue: a query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, names
from ..functions.storage import shared_dir, written
from ..operators import analysis, annotations, detection_metrics, matching, mota, pixels, sampling, store, sync, tracker
from ..sources import coco, files, frames, via
from ..streaming.tracker import track_stream
from . import fixtures
from .fixtures import sql

KEYS = ["video", "clip"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


IOU = """greatest(0, least(g.x2,p.x2)-greatest(g.x1,p.x1)+{e})*greatest(0, least(g.y2,p.y2)-greatest(g.y1,p.y1)+{e})"""
OVER = f"({IOU})/((g.x2-g.x1+{{e}})*(g.y2-g.y1+{{e}})+(p.x2-p.x1+{{e}})*(p.y2-p.y1+{{e}})-({IOU}))"
ON = "g.video=p.video and g.clip=p.clip and g.frame=p.frame"


# boxes


@query(
    sql("gt")
    + """ select video,clip,frame,gt_id, x1 x, y1 y, x2-x1 w, y2-y1 h, (x1+x2)/2 cx, (y1+y2)/2 cy, (x2-x1)*(y2-y1) area, round((x2-x1)/(y2-y1),6) ratio,
 x1 back_x1, y2 back_y2, round((x1+x2)/2-sqrt((x2-x1)*(y2-y1)*((x2-x1)/(y2-y1)))/2,6) state_x1 from gt"""
)
def box_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixtures.truth(spark, sf_dir)
    x, y, w, h = boxes.xyxy_to_xywh(*boxes.CORNERS)
    cx, cy, area, ratio = boxes.xyxy_to_state(*boxes.CORNERS)
    back = boxes.center_to_xyxy(cx, cy, w, h)
    return g.select(
        *KEYS, "frame", "gt_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), cx.alias("cx"), cy.alias("cy"), area.alias("area"), r6(ratio).alias("ratio"),
        back[0].alias("back_x1"), back[3].alias("back_y2"), r6(boxes.state_to_xyxy(cx, cy, area, ratio)[0]).alias("state_x1"),
    )


@query(sql("gt", "pred") + f" select g.video,g.clip,g.frame,gt_id,pred_id, round({OVER.format(e='1.0')},6) iou from gt g join pred p on {ON} where {OVER.format(e='1.0')} > 0.1")
def iou_pairs_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.box_pairs(fixtures.truth(spark, sf_dir), fixtures.predictions(spark, sf_dir), KEYS, 0.1, inclusive=True)
    return pairs.select(*KEYS, "frame", "gt_id", "pred_id", r6("iou").alias("iou"))


CONTINUOUS = sql("gt", "pred") + f" select g.video,g.clip,g.frame,gt_id,pred_id, round({OVER.format(e='0.0')},6) iou from gt g join pred p on {ON} where {OVER.format(e='0.0')} > 0.1"


@query(CONTINUOUS)
def iou_pairs_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.box_pairs(fixtures.truth(spark, sf_dir), fixtures.predictions(spark, sf_dir), KEYS, 0.1)
    return pairs.select(*KEYS, "frame", "gt_id", "pred_id", r6("iou").alias("iou"))


@query(CONTINUOUS)
def iou_pairs_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.grid_pairs(fixtures.truth(spark, sf_dir), fixtures.predictions(spark, sf_dir), KEYS, 128.0, 0.1)
    return pairs.select(*KEYS, "frame", "gt_id", "pred_id", r6("iou").alias("iou"))


@query(sql("gt", "pred") + f" select p.video,p.clip,p.frame,pred_id, round(coalesce(max({OVER.format(e='0.0')}),0),6) best_iou from pred p left join gt g on {ON} group by all")
def best_iou_per_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = matching.best_overlap(fixtures.truth(spark, sf_dir), fixtures.predictions(spark, sf_dir), KEYS)
    return best.select(*KEYS, "frame", "pred_id", r6("best_iou").alias("best_iou"))


@query(sql("pred") + " select video,clip,frame,pred_id, round(score,6) score from pred where score > 0.5")
def score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.above_score(fixtures.predictions(spark, sf_dir), 0.5).select(*KEYS, "frame", "pred_id", r6("score").alias("score"))


@query(sql("gt") + " select video,clip,frame,gt_id, least(greatest(x1,0),1920) x1, least(greatest(y1,0),1080) y1, least(x2,1920) x2, least(y2,1080) y2 from gt where least(x2,1920)-least(x1,1920) >= 10 and least(y2,1080)-least(y1,1080) >= 10")
def sanitized_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.sanitize(fixtures.truth(spark, sf_dir), 1920, 1080, 10)


# tracking accuracy

MOTA = (
    sql("gt", "pred")
    + f""", shown as (select g.* from gt g where exists (select 1 from pred p where {ON})),
 matched as (select g.video,g.clip,g.frame,g.gt_id,p.pred_id from shown g left join pred p on {ON} and {OVER.format(e="1.0")} > 0.1),
 ranked as (select *, dense_rank() over (partition by clip order by frame) ord from matched),
 known as (select *, last_value(pred_id ignore nulls) over (partition by clip, gt_id order by ord rows between unbounded preceding and 1 preceding) known,
  case when pred_id is not null then lag(gt_id) over (partition by clip, pred_id order by ord) end before, case when pred_id is not null then lag(ord) over (partition by clip, pred_id order by ord) end before_ord from ranked),
 marked as (select *, case when pred_id <> known then 1 else 0 end reid, case when before_ord = ord-1 and before <> gt_id then 1 else 0 end swap from known),
 per as (select video,clip,frame, count(*) total_ground_truth, count(pred_id) true_positives, count(*)-count(pred_id) missed_detections,
  (select count(*) from pred p where p.clip=m.clip and p.frame=m.frame)-count(pred_id) false_positives, cast(sum(reid)+sum(swap) as bigint) switches, cast(sum(reid) as bigint) reid, cast(sum(swap) as bigint) swap from marked m group by video,clip,frame)"""
)


def _per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mota.mota_per_frame(fixtures.truth(spark, sf_dir), fixtures.predictions(spark, sf_dir), KEYS)


@query(
    MOTA
    + """ select video,clip,frame, cast(frame-min(frame) over (partition by video,clip) as int) frame_index, total_ground_truth,true_positives,missed_detections,false_positives,switches,
 round(1-(missed_detections+false_positives+switches)/total_ground_truth,6) mota from per"""
)
def mota_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["total_ground_truth", "true_positives", "missed_detections", "false_positives", "switches"]
    return _per_frame(spark, sf_dir).select(*KEYS, "frame", "frame_index", *counts, r6("mota").alias("mota"))


@query(
    MOTA
    + """ select count(*) n_frames, round(avg(1-(missed_detections+false_positives+switches)/total_ground_truth),6) mean_mota,
 round(1-sum(missed_detections+false_positives+switches)/sum(total_ground_truth),6) aggregated_mota from per"""
)
def mota_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mota.mota_overall(_per_frame(spark, sf_dir)).select("n_frames", r6("mean_mota").alias("mean_mota"), r6("aggregated_mota").alias("aggregated_mota"))


@query(MOTA + " select video, clip, cast(sum(reid) as bigint) reid, cast(sum(swap) as bigint) swap from per group by video, clip")
def id_switches_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_frame(spark, sf_dir).groupBy(*KEYS).agg(F.sum("reid").alias("reid"), F.sum("swap").alias("swap"))


@query(sql("gt", "pred") + " select count(*) n from (select distinct video,clip,frame from pred) p where not exists (select 1 from gt g where g.clip=p.clip and g.frame=p.frame)")
def prediction_only_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = [*KEYS, "frame"]
    return fixtures.predictions(spark, sf_dir).select(*on).distinct().join(fixtures.truth(spark, sf_dir).select(*on).distinct(), on, "left_anti").agg(F.count("*").alias("n"))


def _crowd(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Boxes moved so near to each other that they overlap their neighbours."""
    near = lambda d: d.withColumns({"x1": F.col("x1") / 16, "y1": F.col("y1") / 8, "x2": F.col("x1") / 16 + 80, "y2": F.col("y1") / 8 + 60})
    return near(fixtures.truth(spark, sf_dir)), near(fixtures.predictions(spark, sf_dir))


CROWD = ", ".join(f"{w} as (select * replace (x1/16 as x1, y1/8 as y1, x1/16+80 as x2, y1/8+60 as y2) from {v})" for w, v in (("wg", "gt"), ("wp", "pred")))


#: The greedy match as a fold over a frame's predictions: each takes the first of its candidates that isn't taken.
GREEDY = (
    sql("gt", "pred").replace("with ", "with recursive ", 1)
    + f""", {CROWD},
 pairs as (select g.video,g.clip,g.frame,gt_id,pred_id, {OVER.format(e="1.0")} iou from wg g join wp p on {ON} where {OVER.format(e="1.0")} > 0.1),
 turns as (select *, dense_rank() over (partition by video,clip,frame order by pred_id) k from pairs),
 cand as (select video,clip,frame,k,pred_id, list({{'gt':gt_id,'iou':iou}} order by iou desc, gt_id) c from turns group by all),
 r as (select distinct video,clip,frame, cast(0 as bigint) k, cast([] as int[]) taken, cast(null as int) pred_id, cast(null as int) gt_id, cast(null as double) iou from cand
  union all select video,clip,frame,k, case when pick is null then taken else list_append(taken, pick.gt) end, pred_id, pick.gt, pick.iou
  from (select c.video,c.clip,c.frame,c.k,c.pred_id,r.taken, list_filter(c.c, lambda x: not list_contains(r.taken, x.gt))[1] pick from r join cand c on c.video=r.video and c.clip=r.clip and c.frame=r.frame and c.k=r.k+1)),
 greedy as (select video,clip,frame,gt_id,pred_id,iou from r where gt_id is not null)"""
)


@query(GREEDY + " select video,clip,frame,gt_id,pred_id, round(iou,6) iou from greedy")
def greedy_match_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.box_pairs(*_crowd(spark, sf_dir), KEYS, 0.1, inclusive=True)
    return matching.greedy_match(pairs, KEYS).select(*KEYS, "frame", "gt_id", "pred_id", r6("iou").alias("iou"))


@query(
    GREEDY
    + MOTA[MOTA.index(", shown as") :].replace(f"left join pred p on {ON} and {OVER.format(e='1.0')} > 0.1", "left join greedy p on g.video=p.video and g.clip=p.clip and g.frame=p.frame and g.gt_id=p.gt_id")
    + " select video,clip,frame, total_ground_truth,true_positives,missed_detections,false_positives,switches, round(1-(missed_detections+false_positives+switches)/total_ground_truth,6) mota from per"
)
def mota_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy where boxes compete for their partners."""
    per = mota.mota_per_frame(*_crowd(spark, sf_dir), KEYS)
    return per.select(*KEYS, "frame", "total_ground_truth", "true_positives", "missed_detections", "false_positives", "switches", r6("mota").alias("mota"))


@query()
def optimal_match_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.box_pairs(*_crowd(spark, sf_dir), KEYS)
    return matching.optimal_match(pairs, KEYS, 0.1).select(*KEYS, "frame", "gt_id", "pred_id", r6("iou").alias("iou"))


#: Of all ways to match a frame's predictions one after another, with each set of taken true boxes only the best sum goes on.
OPTIMUM = (
    sql("gt", "pred").replace("with ", "with recursive ", 1)
    + f""", {CROWD},
 pairs as (select g.video,g.clip,g.frame,gt_id,pred_id, {OVER.format(e="0.0")} iou from wg g join wp p on {ON} where {OVER.format(e="0.0")} > 0),
 ranked as (select *, dense_rank() over (partition by video,clip,frame order by pred_id) k from pairs),
 ways as (select video,clip,frame,k,gt_id,iou from ranked union all select distinct video,clip,frame,k,cast(null as int),cast(0 as double) from ranked),
 r as (select distinct video,clip,frame, cast(0 as bigint) k, cast([] as int[]) taken, cast(0 as double) total from pairs
  union all select video,clip,frame,k,taken,max(total) total from
  (select w.video,w.clip,w.frame,w.k, case when w.gt_id is null then r.taken else list_sort(list_append(r.taken, w.gt_id)) end taken, r.total+w.iou total from r join ways w on w.video=r.video and w.clip=r.clip and w.frame=r.frame and w.k=r.k+1 where w.gt_id is null or not list_contains(r.taken, w.gt_id)) group by video,clip,frame,k,taken)"""
)


@query(OPTIMUM + " select video,clip,frame, round(max(total),5) total from r where k > 0 group by video,clip,frame")
def optimal_match_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest sum of overlaps of each crowded frame, which is one where its assignment may not be."""
    matches = matching.optimal_match(matching.box_pairs(*_crowd(spark, sf_dir), KEYS), KEYS)
    return matches.groupBy(*KEYS, "frame").agg(F.round(F.sum("iou"), 5).alias("total"))


# detection

LEVELS = [0.5, 0.6, 0.7, 0.75, 0.8, 0.9]
HITS = f"hits as (select p.video,p.clip,p.frame, {OVER.format(e='0.0')} iou from gt g join pred p on {ON} where {OVER.format(e='0.0')} > 0)"


@query(
    sql("gt", "pred")
    + f""", {HITS}, l as (select cast(unnest({LEVELS}) as double) threshold), c as (select threshold, (select count(*) from hits where iou > threshold) tp, (select count(*) from pred) p, (select count(*) from gt) g from l)
 select threshold, tp, p-tp fp, g-tp fn, round(case when p=0 then 0 else tp/p end,6) as "precision", round(case when g=0 then 0 else tp/g end,6) recall from c"""
)
def precision_recall_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detection_metrics.by_threshold(fixtures.truth(spark, sf_dir), fixtures.predictions(spark, sf_dir), KEYS, LEVELS)
    return out.select("threshold", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(
    sql("gt", "pred")
    + f""", {HITS}, f as (select video,clip,frame from gt union select video,clip,frame from pred),
 c as (select f.video, f.clip, f.frame, (select count(*) from hits h where h.clip=f.clip and h.frame=f.frame and iou > 0.5) tp, (select count(*) from pred p where p.clip=f.clip and p.frame=f.frame) p, (select count(*) from gt g where g.clip=f.clip and g.frame=f.frame) g from f)
 select video, clip, count(*) n, round(avg(case when p=0 then 0 else tp/p end),6) as "precision", round(avg(case when g=0 then 0 else tp/g end),6) recall from c group by video, clip"""
)
def precision_recall_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detection_metrics.confusion(fixtures.truth(spark, sf_dir), fixtures.predictions(spark, sf_dir), KEYS, 0.5)
    return detection_metrics.mean_over(out, KEYS).select(*KEYS, "n", r6("precision").alias("precision"), r6("recall").alias("recall"))


BATCHES = "b as (select distinct video, clip, frame, concat_ws('-', video, clip, frame-frame % 60+frame % 30) batch from base)"


@query(
    sql("gt", "pred")
    + f""", {BATCHES}, {HITS}, c as (select b.batch, (select count(*) from hits h join b using (video, clip, frame) where b.batch=x.batch and iou > 0.5) tp,
  (select count(*) from pred p join b using (video, clip, frame) where b.batch=x.batch) p, (select count(*) from gt g join b using (video, clip, frame) where b.batch=x.batch) g from (select distinct batch from b) x join b on b.batch=x.batch group by b.batch, x.batch)
 select batch, tp, p-tp fp, g-tp fn, round(case when p=0 then 0 else tp/p end,6) as "precision", round(case when g=0 then 0 else tp/g end,6) recall from c"""
)
def batch_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames, half a minute apart, are a batch whose boxes are matched as one pool."""
    key = F.concat_ws("-", "video", "clip", F.col("frame") - F.col("frame") % 60 + F.col("frame") % 30)
    batched = fixtures.base(spark, sf_dir).select(*KEYS, "frame", key.alias("batch")).distinct()
    out = detection_metrics.batch_confusion(fixtures.truth(spark, sf_dir), fixtures.predictions(spark, sf_dir), batched, KEYS, 0.5)
    return out.select("batch", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")), r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("""with t as (select p_partkey trial, p_size/50.0 p, p_retailprice/2000.0 r from part) select trial, round(p,6) as "precision", round(r,6) recall from t order by (p+r)/2 desc, trial limit 1""")
def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial"), (F.col("p_size") / 50.0).alias("precision"), (F.col("p_retailprice").cast("double") / 2000.0).alias("recall"))
    return detection_metrics.best_trial(part).select("trial", r6("precision").alias("precision"), r6("recall").alias("recall"))


# tracking


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.predictions(spark, sf_dir).withColumn("det_idx", F.col("pred_id"))


@query()
def sort_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = tracker.track(_detections(spark, sf_dir), KEYS, score=0.1)
    return tracks.select(*KEYS, "frame", "emit_idx", "track_id", *(F.round(c, 3).alias(c) for c in boxes.CORNERS), r6("score").alias("score"))


#: One box a sequence: the filter's axes are independent, each with a place, a speed and three numbers of doubt.
STEADY = """det as (select video, clip, gt_id, frame, x1+(frame*gt_id) % 5 x1, y1+(frame*gt_id) % 3 y1 from gt where frame < 60 and (frame*7+gt_id) % 5 <> 0),
 span as (select video, clip, gt_id, min(frame) a, max(frame) b from det group by all),
 r as (select d.video, d.clip, d.gt_id, d.frame, true hit, x1+20.0::double u, y1+15.0::double v, 0.0::double du, 0.0::double dv, 10.0::double p, 0.0::double c, 10000.0::double q from det d join span s on s.gt_id=d.gt_id and d.frame=s.a
  union all select video, clip, gt_id, frame, hit, case when hit then u+p/(p+1)*(zu-u) else u end, case when hit then v+p/(p+1)*(zv-v) else v end, case when hit then du+c/(p+1)*(zu-u) else du end, case when hit then dv+c/(p+1)*(zv-v) else dv end,
   case when hit then p/(p+1) else p end, case when hit then c/(p+1) else c end, case when hit then q-c*c/(p+1) else q end
  from (select r.video, r.clip, r.gt_id, r.frame+1 frame, d.x1 is not null hit, r.u+r.du u, r.v+r.dv v, r.du, r.dv, r.p+2*r.c+r.q+1 p, r.c+r.q c, r.q+0.01 q, d.x1+20 zu, d.y1+15 zv
   from r join span s on s.gt_id=r.gt_id left join det d on d.gt_id=r.gt_id and d.frame=r.frame+1 where r.frame < s.b))"""


def _steady(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixtures.truth(spark, sf_dir).filter("frame < 60 and (frame * 7 + gt_id) % 5 <> 0")
    dx, dy = F.col("frame") * F.col("gt_id") % 5, F.col("frame") * F.col("gt_id") % 3
    return g.withColumns({"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + dy, "y2": F.col("y2") + dy, "score": F.lit(1.0), "det_idx": F.lit(0)})


def _rounded(tracks: DataFrame) -> DataFrame:
    return tracks.select(*KEYS, "gt_id", "frame", "track_id", *(F.round(c, 3).alias(c) for c in boxes.CORNERS))


@query(sql("gt").replace("with ", "with recursive ", 1) + f", {STEADY} select video, clip, gt_id, frame, cast(1 as bigint) track_id, round(u-20,3) x1, round(v-15,3) y1, round(u+20,3) x2, round(v+15,3) y2 from r where hit")
def sort_tracks_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each animal, with a gap every fifth frame: the filter alone, as nothing competes."""
    return _rounded(tracker.track(_steady(spark, sf_dir), [*KEYS, "gt_id"]))


@query(ORACLES["sort_tracks_of_one"])
def stream_tracks_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sequences as a stream that starts twice from its checkpoint: files of frames 0 to 39, then those of 40 to 59."""
    found, root = written(_steady(spark, sf_dir), "detections"), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for lo, hi, run in ((0, 20, False), (20, 40, True), (40, 60, True)):
        found.filter(F.col("frame").between(lo, hi - 1)).repartition(*KEYS, "gt_id").write.mode("append").parquet(f"{root}/in")
        if run:
            stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 64).parquet(f"{root}/in")
            tracks = track_stream(stream, [*KEYS, "gt_id"]).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            tracks.option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").start().awaitTermination()
    return _rounded(spark.read.parquet(f"{root}/out"))


#: With a pause of frames 25 to 44, which no track outlives; a track born after it shows from its second box on.
PAUSED = STEADY.replace("where frame < 60", "where frame < 60 and frame not between 25 and 44").replace("det as (select video, clip, gt_id, frame", "det as (select video, clip, gt_id*2+cast(frame >= 45 as int) gt_id, frame")


@query(
    sql("gt").replace("with ", "with recursive ", 1)
    + f""", {PAUSED} select r.video, r.clip, r.gt_id//2 gt_id, frame, cast(r.gt_id % 2 + 1 as bigint) track_id, round(u-20,3) x1, round(v-15,3) y1, round(u+20,3) x2, round(v+15,3) y2 from r join span s on s.gt_id=r.gt_id
 where hit and (r.gt_id % 2 = 0 or frame > s.a)"""
)
def sort_tracks_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with a pause, cut there and tracked in parallel."""
    found = _steady(spark, sf_dir).filter("frame not between 25 and 44")
    return _rounded(tracker.track_in_pieces(found, [*KEYS, "gt_id"]))


#: Two boxes of one size that cross: of the two ways to give them to the two tracks the one with more overlap goes on.
CROSSING = """det as (select gt_id//2 pair, gt_id % 2 k, frame, case when gt_id % 2 = 0 then 2*frame+(frame*gt_id) % 3 else 120-2*frame+(frame*gt_id) % 4 end::double x, (8*(gt_id % 2)+frame % 2)::double y from gt where frame < 60),
 n as (select pair, min(c) m from (select pair, k, count(*) c from det group by all) group by pair having count(*) = 2),
 two as (select a.pair, a.frame, a.x+20 xa, a.y+15 ya, b.x+20 xb, b.y+15 yb from det a join det b on b.pair=a.pair and b.frame=a.frame and a.k=0 and b.k=1 join n on n.pair=a.pair where a.frame < m),
 r as (select pair, frame, xa u, ya v, 0.0::double du, 0.0::double dv, xb s, yb t, 0.0::double ds, 0.0::double dt, 10.0::double p, 0.0::double c, 10000.0::double q from two where frame = 0
  union all select pair, frame, u+g*(zu-u), v+g*(zv-v), du+h*(zu-u), dv+h*(zv-v), s+g*(zs-s), t+g*(zt-t), ds+h*(zs-s), dt+h*(zt-t), p/(p+1), c/(p+1), q-c*c/(p+1)
  from (select *, p/(p+1) g, c/(p+1) h, case when own then xa else xb end zu, case when own then ya else yb end zv, case when own then xb else xa end zs, case when own then yb else ya end zt
   from (select *, ua/(2400-ua)+sb/(2400-sb) >= ub/(2400-ub)+sa/(2400-sa) own
    from (select *, greatest(0,40-abs(u-xa))*greatest(0,30-abs(v-ya)) ua, greatest(0,40-abs(u-xb))*greatest(0,30-abs(v-yb)) ub, greatest(0,40-abs(s-xa))*greatest(0,30-abs(t-ya)) sa, greatest(0,40-abs(s-xb))*greatest(0,30-abs(t-yb)) sb
     from (select r.pair, d.frame, r.u+r.du u, r.v+r.dv v, r.du, r.dv, r.s+r.ds s, r.t+r.dt t, r.ds, r.dt, r.p+2*r.c+r.q+1 p, r.c+r.q c, r.q+0.01 q, d.xa, d.ya, d.xb, d.yb from r join two d on d.pair=r.pair and d.frame=r.frame+1)))))"""


@query(
    sql("gt").replace("with ", "with recursive ", 1)
    + f""", {CROSSING} select pair, frame, cast(1 as bigint) track_id, round(u-20,3) x1, round(v-15,3) y1 from r union all select pair, frame, 2, round(s-20,3), round(t-15,3) from r"""
)
def sort_tracks_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two animals whose boxes cross, so that both tracks compete for both of them."""
    g, even = fixtures.truth(spark, sf_dir).filter("frame < 60"), F.col("gt_id") % 2 == 0
    pair, turn = F.expr("gt_id div 2").cast("int").alias("pair"), F.col("frame") * F.col("gt_id")
    x = F.when(even, 2 * F.col("frame") + turn % 3).otherwise(120 - 2 * F.col("frame") + turn % 4).cast("double")
    y = (8 * (F.col("gt_id") % 2) + F.col("frame") % 2).cast("double")
    found = g.select(pair, "frame", (F.col("gt_id") % 2).cast("int").alias("det_idx"), x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 30).alias("y2"), F.lit(1.0).alias("score"))
    both = found.groupBy("pair", "frame").agg(F.count("*").alias("n")).filter("n = 2").select("pair", "frame")
    return tracker.track(found.join(both, ["pair", "frame"]), ["pair"]).select("pair", "frame", "track_id", F.round("x1", 3).alias("x1"), F.round("y1", 3).alias("y1"))


# annotations


@query(
    sql("pred")
    + """ select concat('frame_', lpad(cast(frame as varchar),8,'0'), '.png') filename, 8888 file_size, '{"clip":123}' file_attributes, 1 region_count, 0 region_id,
 concat('{"name":"rect","x":', cast(x1 as varchar), ',"y":', cast(y1 as varchar), ',"width":', cast(cast(trunc(x2-x1) as int) as varchar), ',"height":', cast(cast(trunc(y2-y1) as int) as varchar), '}') region_shape_attributes,
 concat('{"track":"', cast(pred_id as varchar), '", "confidence":"', cast(round(score,3) as varchar), '"}') region_attributes from pred"""
)
def via_rows_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return via.rows_of_tracks(fixtures.predictions(spark, sf_dir).withColumn("track_id", F.col("pred_id")).withColumn("score", F.round("score", 3)))


@query(
    sql("via_rows")
    + """ select l_orderkey, l_linenumber, filename, cast(l_orderkey as int) frame, l_linenumber gt_id, cast(json_extract_string(region_shape_attributes,'$.x') as double) x, cast(json_extract_string(region_shape_attributes,'$.y') as double) y,
 cast(json_extract_string(region_shape_attributes,'$.width') as double) width, cast(json_extract_string(region_shape_attributes,'$.height') as double) height from via_rows"""
)
def via_rows_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return via.parse_rows(fixtures.via_rows(spark, sf_dir)).drop("confidence")


@query("select l_orderkey as key, max(l_linenumber) file, count(*) n_files, sum(case when l_linenumber = m then 1 else 0 end) n_regions from (select *, max(l_linenumber) over (partition by l_orderkey) m from lineitem) group by l_orderkey")
def via_combine_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line number is a file, each order an image in it."""
    line = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("file"))
    kept = via.last_wins(line, ["key"], ["file"]).groupBy("key").agg(F.max("file").alias("file"), F.count("*").alias("n_regions"))
    return kept.join(line.groupBy("key").agg(F.count("*").alias("n_files")), "key")


@query(
    sql("via_rows")
    + """, i as (select filename, row_number() over (order by filename) id from (select distinct filename from via_rows))
 select row_number() over (order by i.id, v.l_linenumber, v.region_shape_attributes) id, i.id image_id, v.filename file_name, cast(json_extract_string(region_shape_attributes,'$.x') as double) x,
 cast(json_extract_string(region_shape_attributes,'$.width') as double)*cast(json_extract_string(region_shape_attributes,'$.height') as double) area, 0 iscrowd from via_rows v join i using (filename)"""
)
def coco_from_via(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.from_json("region_shape_attributes", via.SHAPE)
    entry = F.struct("l_linenumber", "region_shape_attributes", F.struct(shape.alias("shape_attributes")).alias("r"))
    pictures = fixtures.via_rows(spark, sf_dir).groupBy("filename").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["r"]).alias("regions"))
    image, annotation, _ = via.coco_rows(pictures, ["filename"])
    return annotation.join(image.select(F.col("id").alias("image_id"), "file_name"), "image_id").select("id", "image_id", "file_name", F.col("bbox")[0].alias("x"), "area", "iscrowd")


@query("select l_orderkey, l_linenumber, min(l_partkey) l_partkey from lineitem l where (l_partkey, l_suppkey, l_quantity, l_extendedprice) = (select (l_partkey, l_suppkey, l_quantity, l_extendedprice) from lineitem m where m.l_orderkey=l.l_orderkey and m.l_linenumber=l.l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice limit 1) group by all")
def dedupe_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = fixtures.table(spark, sf_dir, "lineitem")
    return annotations.dedupe(line, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query(sql("via_rows") + " select l_orderkey, l_linenumber, filename from via_rows where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def exclude_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = fixtures.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return annotations.exclude(fixtures.via_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", "filename"), gone, "l_orderkey")


@query("select p_partkey from part where not regexp_matches(p_name, 'gr[ae]|blue')")
def exclude_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return via.without(fixtures.table(spark, sf_dir, "part"), "gr[ae]|blue", "p_name").select("p_partkey")


@query("with n as (select n_nationkey video, n_regionkey old from nation), s as (select s_nationkey video, count(*) neu from supplier where s_nationkey % 2 = 0 group by 1) select coalesce(n.video, s.video) video, case when s.video is not null then neu else old end value from n full join s on n.video = s.video")
def merge_new_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fixtures.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("video"), F.col("n_regionkey").cast("long").alias("value"))
    new = fixtures.table(spark, sf_dir, "supplier").filter("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("video")).agg(F.count("*").alias("value"))
    return annotations.merged(old, new, value="value")


@query("select c_custkey video, coalesce(f,'') frames from customer left join (select o_custkey, string_agg(cast(k as varchar), ',' order by k) f from (select distinct o_custkey, o_orderkey % 1000 k from orders) group by 1) on c_custkey = o_custkey")
def frames_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video"))
    chosen = fixtures.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video"), (F.col("o_orderkey") % 1000).cast("int").alias("frame"))
    return annotations.selections(videos, chosen).select("video", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))


# clips and the store


@query(
    sql("pred", "clips")
    + """ select p.video, p.clip, c.loop_clip_name, count(*) n, min(c.loop_start_frame_ffmpeg-1) first_frame, min(c.loop_end_frame_ffmpeg-1) last_frame, min(lower(c.escape_type)) escape_type
 from pred p join clips c on p.video=c.video and p.clip=c.clip group by p.video, p.clip, c.loop_clip_name"""
)
def clip_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = store.clip_frames(fixtures.clips(spark, sf_dir)).select(*KEYS, "loop_clip_name", "clip_first_frame_0idx", "clip_last_frame_0idx", "clip_escape_type")
    name = F.concat(F.lit("v"), F.col("video").cast("string"), F.lit("-Loop"), F.lpad(F.col("clip").cast("string"), 2, "0"), F.lit(".mp4"))
    counts = fixtures.predictions(spark, sf_dir).withColumn("loop_clip_name", name).groupBy("loop_clip_name").agg(F.count("*").alias("n"))
    joined = store.with_metadata(counts, c)
    return joined.select(*KEYS, "loop_clip_name", "n", F.col("clip_first_frame_0idx").alias("first_frame"), F.col("clip_last_frame_0idx").alias("last_frame"), F.col("clip_escape_type").alias("escape_type"))


@query(sql("observations") + " select video, clip, t, min(escape_state) escape_state, count(*) n from observations group by video, clip, t")
def escape_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = fixtures.predictions(spark, sf_dir).groupBy(*KEYS, F.col("frame").alias("t")).agg(F.count("*").alias("n"))
    return store.escape_states(times, fixtures.clips(spark, sf_dir), KEYS).select(*KEYS, "t", "escape_state", "n")


@query(sql("clips") + " select video, clip, loop_end_frame_ffmpeg-loop_start_frame_ffmpeg+1 clip_length, loop_end_frame_ffmpeg-escape_start_frame_0idx escape_length, escape_start_frame_0idx-loop_start_frame_ffmpeg+1 outside_length from clips")
def clip_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.clip_lengths(store.clip_frames(fixtures.clips(spark, sf_dir))).select(*KEYS, "clip_length", "escape_length", "outside_length")


@query(sql("clips") + ", c as (select video, case when clip = 5 then 25.0 else fps end f from clips) select video, count(distinct f) n_fps, count(distinct f) = 1 is_uniform from c group by video")
def uniform_fps_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.clips(spark, sf_dir).withColumn("fps", F.when(F.col("clip") == 5, 25.0).otherwise(F.col("fps")))
    return store.uniform_fps(c).select("video", "n_fps", "is_uniform")


@query(
    sql("observations")
    + """, i as (select distinct video, clip, individual from observations), n as (select *, row_number() over (partition by video, clip order by individual)-1 n from i)
 select video, clip, individual, concat('id_', lpad(cast(n as varchar), cast(length(cast(max(n) over (partition by video) as varchar)) as int), '0')) label from n"""
)
def renumbered_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fixtures.observations(spark, sf_dir).select(*KEYS, "individual").distinct()
    return store.renumbered(ids)


@query(sql("clips") + " select loop_clip_name, concat(split_part(loop_clip_name,'-Loop',1)) video, regexp_replace(regexp_replace(loop_clip_name,'[.]mp4$',''),'^.*-','') clip_id, loop_clip_name clip_file from clips")
def filename_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.clips(spark, sf_dir).select("loop_clip_name", F.regexp_replace("loop_clip_name", r"\.mp4$", "_tracks.csv").alias("file"))
    return f.select("loop_clip_name", names.video_name("file").alias("video"), names.clip_id(names.clip_file("file")).alias("clip_id"), names.clip_file("file").alias("clip_file"))


@query("select event_id, cast(trunc((hour(ts)*3600+minute(ts)*60+second(ts)-3600)*29.97::double) as int) frame from events")
def clock_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "events").select("event_id", names.frame_at(F.date_format("ts", "HH:mm:ss"), F.lit("01:00:00"), 29.97).alias("frame"))


@query(sql("clips") + " select video, clip, round(loop_start_frame_ffmpeg/fps-0.5/fps,6) pts_from, round(loop_end_frame_ffmpeg/fps+0.5/fps,6) pts_to, loop_end_frame_ffmpeg-loop_start_frame_ffmpeg+1 expected_frames, round((loop_end_frame_ffmpeg-loop_start_frame_ffmpeg+1)/fps/60,6) \"minutes\" from clips")
def clip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.clips(spark, sf_dir)
    n = names.clip_length("loop_start_frame_ffmpeg", "loop_end_frame_ffmpeg")
    lo, hi = names.pts_window(F.col("loop_start_frame_ffmpeg") / F.col("fps"), F.col("loop_end_frame_ffmpeg") / F.col("fps"), "fps")
    return c.select(*KEYS, r6(lo).alias("pts_from"), r6(hi).alias("pts_to"), n.alias("expected_frames"), r6(names.frames_to_minutes(n, F.col("fps"))).alias("minutes"))


# statistics


@query(sql("observations") + " select video, clip, individual, count(*) n_samples from observations group by all")
def track_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.track_lengths(fixtures.observations(spark, sf_dir), KEYS)


@query(sql("observations") + " select video, clip, individual, count(*) n, round(avg(x),6) mean_x from observations group by all having count(*) >= 50")
def long_tracks_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = analysis.long_tracks(fixtures.observations(spark, sf_dir), KEYS, 50)
    return kept.groupBy(*KEYS, "individual").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean_x"))


@query(sql("observations") + " select video, clip, round(avg(confidence),6) mean, round(stddev_pop(confidence),6) std, round(min(confidence),6) min, round(max(confidence),6) max, round(median(confidence),6) median, count(confidence) n from observations group by video, clip")
def confidence_stats_by_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = analysis.confidence_stats(fixtures.observations(spark, sf_dir), KEYS)
    return s.select(*KEYS, *(r6(c).alias(c) for c in ("mean", "std", "min", "max", "median")), "n")


@query(sql("observations") + " select t, round(avg(confidence),6) confidence_mean, round(stddev_pop(confidence),6) confidence_std from observations group by t")
def confidence_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = analysis.reduced(fixtures.observations(spark, sf_dir), ["t"], "confidence")
    return s.select("t", r6("confidence_mean").alias("confidence_mean"), r6("confidence_std").alias("confidence_std"))


@query(sql("observations") + ", l as (select count(*) n from observations group by video, clip, individual) select cast(least(floor(n/5.0), 19) as int) bin, count(*) n from l where n between 0 and 100 group by 1")
def hist_track_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.histogram(analysis.track_lengths(fixtures.observations(spark, sf_dir), KEYS), "n_samples", 0, 100, 20)


@query(sql("observations") + " select cast(least(floor((confidence-0)/0.05::double),19) as int) bin, count(*) n from observations where confidence between 0 and 1 group by 1")
def hist_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.histogram(fixtures.observations(spark, sf_dir), "confidence", 0, 1, 20)


@query(sql("observations") + " select cast(least(floor(x/(4096.0::double/100)),99) as int) bx, cast(least(floor(y/(2160.0::double/53)),52) as int) \"by\", count(*) n from observations where x between 0 and 4096 and y between 0 and 2160 group by 1,2")
def occupancy_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.occupancy(fixtures.observations(spark, sf_dir), 4096, 2160, 100)


@query(
    sql("observations")
    + """, e as (select video, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from observations group by video)
 select o.video, cast(case when x1=x0 then 0 else least(floor((x-x0)*40/(x1-x0)),39) end as int) bx, cast(case when y1=y0 then 0 else least(floor((y-y0)*20/(y1-y0)),19) end as int) "by", count(*) n from observations o join e on e.video=o.video group by 1,2,3"""
)
def occupancy_2d_autorange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.occupancy_of_range(fixtures.observations(spark, sf_dir), ["video"], 40, 20)


@query(sql("observations") + " select cast(floor(x) as int) px, cast(floor(y) as int) py, count(*) n from observations where x >= 0 and x < 4096 and y >= 0 and y < 2160 group by 1,2")
def raster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.raster(fixtures.observations(spark, sf_dir), 4096, 2160)


@query(sql("observations") + " select video, clip, individual, min_by(x, t) x, min_by(y, t) y from observations group by all")
def first_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.first_positions(fixtures.observations(spark, sf_dir), KEYS)


@query(
    sql("observations")
    + """, s as (select video, clip, individual, t, case when confidence > 0.5 then 1 else 0 end v from observations), c as (select *, case when lag(v) over w is not distinct from v then 0 else 1 end c from s window w as (partition by clip, individual order by t)),
 r as (select *, sum(c) over (partition by clip, individual order by t) run from c) select video, clip, individual, cast(run as bigint) run, min(v) v, min(t) as "start", count(*) length from r group by video, clip, individual, run"""
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.observations(spark, sf_dir).select(*KEYS, "individual", "t", F.when(F.col("confidence") > 0.5, 1).otherwise(0).alias("v"))
    return analysis.run_lengths(s, [*KEYS, "individual"], "v")


@query(sql("observations") + " select video, clip, individual, t, row_number() over (partition by clip, individual order by t) n_past, count(*) over (partition by clip, individual)-row_number() over (partition by clip, individual order by t) n_future from observations")
def past_future_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.past_future_counts(fixtures.observations(spark, sf_dir), KEYS)


@query(sql("clips") + " select video, count(*) n_clips, max(loop_end_frame_ffmpeg) n_frames, round(max(loop_end_frame_ffmpeg)/min(fps)/60,6) \"minutes\", round((max(loop_end_frame_ffmpeg)-1)/min(fps)/3600,6) \"hours\" from clips group by video")
def video_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = analysis.video_durations(store.clip_frames(fixtures.clips(spark, sf_dir)))
    return d.select("video", "n_clips", "n_frames", r6("minutes").alias("minutes"), r6("hours").alias("hours"))


@query(sql("clips") + " select video, count(distinct clip) n_clips from clips where clip <> 0 group by video having count(distinct clip) < 4")
def small_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.small_videos(fixtures.clips(spark, sf_dir).filter("clip <> 0"), 4)


@query(sql("clips") + " select lower(escape_type) escape_type, count(*) n from clips group by 1")
def escape_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.escape_type_counts(fixtures.clips(spark, sf_dir))


@query(sql("observations") + " select o.video, o.clip, t, individual from observations o join clips c on o.clip=c.clip and o.video=c.video where lower(escape_type)='triggered' and t between 0 and 10 and o.video = 0")
def selected_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.clips(spark, sf_dir).select(*KEYS, F.split("video_name", r"\.")[0].alias("video_id"), "escape_type")
    chosen = analysis.select_clips(c, "triggered", "v0*")
    return analysis.time_slice(fixtures.observations(spark, sf_dir), 0, 10).join(F.broadcast(chosen.select(*KEYS)), KEYS).select(*KEYS, "t", "individual")


@query(sql("observations") + " select distinct video, clip, individual from observations")
def individuals_in_and_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.individuals_in_and_out(fixtures.observations(spark, sf_dir), KEYS)


@query(sql("observations") + " select video, clip, t, individual, round(x*0.5,6) x, round(y*0.5,6) y from observations")
def scaled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.scaled(fixtures.observations(spark, sf_dir), 0.5).select(*KEYS, "t", "individual", r6("x").alias("x"), r6("y").alias("y"))


# frames, pairs, pixels


@query(sql("base") + ", f as (select video, frame, max(case when event_type='click' then 1 else 0 end)=1 seen from base group by video, frame) select video, frame, row_number() over (partition by video order by frame) pair_count from f where seen")
def saved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.base(spark, sf_dir).groupBy("video", "frame").agg(F.max(F.col("event_type") == "click").alias("seen"))
    return analysis.running_count(f, ["video"], "seen").select("video", "frame", "pair_count")


@query(sql("base") + " select video, count(*) filter (event_type='click') detected, count(*) filter (event_type<>'click') not_detected from base group by video")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.detection_counts(fixtures.base(spark, sf_dir).withColumn("seen", F.col("event_type") == "click"), ["video"], "seen")


@query(sql("base") + " select video, clip, frame, gt_id from base where frame % 20 = 0 and frame < 60")
def every_nth_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_frames(sampling.every_nth(fixtures.base(spark, sf_dir), 20), 60).select(*KEYS, "frame", "gt_id")


PIXELS = ", px as (select video, frame, gt_id % 15 px, clip py, max(k % 100) v from base group by all)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fixtures.base(spark, sf_dir)
    return b.groupBy("video", "frame", (F.col("gt_id") % 15).alias("px"), F.col("clip").alias("py")).agg(F.max(F.col("k") % 100).alias("value"))


@query(sql("base") + PIXELS + ", m as (select video, px, py, avg(v) a from px group by all), s as (select px.video, px.px, px.py, max(abs(v-a)) d, min(a) a from px join m on px.video=m.video and px.px=m.px and px.py=m.py group by all) select p.video, p.frame, p.px, p.py, round((case when d=0 then 0 else (v-a)/d end+1)/2,6) \"value\" from px p join s on p.video=s.video and p.px=s.px and p.py=s.py")
def background_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.without_background(_pixels(spark, sf_dir)).select("video", "frame", "px", "py", r6("value").alias("value"))


@query(sql("base") + PIXELS + " select a.video, a.frame, a.px, a.py, abs(b.v-a.v) \"value\" from px a join px b on a.video=b.video and a.px=b.px and a.py=b.py and b.frame=a.frame+2")
def motion_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.motion(_pixels(spark, sf_dir), 2)


@query("with m as (select l_orderkey image, l_suppkey % 8 px, l_linenumber py, cast(max(l_partkey % 3) as smallint) id from lineitem group by all), i as (select *, px-row_number() over (partition by image, py, id order by px) g from m) select image, py, id, min(px) as \"start\", count(*) len from i group by image, py, id, g")
def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 3).alias("id"), (F.col("l_suppkey") % 8).alias("px"), F.col("l_linenumber").alias("py"))
    return frames.mask_runs(frames.merged_masks(line))


@query("with m as (select l_orderkey image, l_suppkey % 8 px, l_linenumber % 6 py, cast(max(l_partkey % 3) as smallint) id from lineitem group by all), i as (select *, py*8+px pixel, py*8+px-row_number() over (partition by image, id order by py*8+px) g from m) select image, id, cast(min(pixel) as bigint) as \"start\", count(*) len from i group by image, id, g")
def instance_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 3).alias("id"), (F.col("l_suppkey") % 8).alias("px"), (F.col("l_linenumber") % 6).alias("py"))
    return frames.instances(frames.merged_masks(line), 8, 6)


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _pixels(spark, sf_dir).select("video", "frame", "px", "py", (v * 2).alias("r"), (v * 3 % 256).alias("g"), ((v + F.col("frame")) % 256).alias("b"))


COLOURS = ", gray as (select video, frame, px, py, cast(floor((v*2)*0.299::double+(v*3 % 256)*0.587::double+((v+frame) % 256)*0.114::double+0.5) as int) v from px)"
#: Weights of a kernel of five, mirrored at both ends of a line of n pixels.
MIRRORED = """w{n} as (select x, case when x+i < 0 then -(x+i) when x+i > {n}-1 then 2*({n}-1)-(x+i) else x+i end s, sum(g/(select sum(exp(-j*j/(2*1.1*1.1::double))) from range(-2,3) u(j))) w
  from range({n}) t(x), (select i, exp(-i*i/(2*1.1*1.1::double)) g from range(-2,3) u(i)) group by all)"""


@query(
    sql("base") + PIXELS + COLOURS
    + f""", {MIRRORED.format(n=15)}, {MIRRORED.format(n=12)},
 h as (select p.video, p.frame, p.px, p.py, sum(w*q.v) v from gray p join w15 on x=p.px join gray q on q.video=p.video and q.frame=p.frame and q.py=p.py and q.px=s group by all),
 b as (select p.video, p.frame, p.px, p.py, sum(w*q.v) v from h p join w12 on x=p.py join h q on q.video=p.video and q.frame=p.frame and q.px=p.px and q.py=s group by all)
 select video, frame, px, py, round(v, 5) "value" from b"""
)
def gray_blurred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray values, blurred over lines and columns."""
    gray = pixels.grayscale(_colours(spark, sf_dir))
    out = pixels.blurred(gray, ["video", "frame"], 15, 12, (5, 5), 1.1, whole=False)
    return out.select("video", "frame", "px", "py", F.round("value", 5).alias("value"))


FACTORS = [1.0, 0.75, 0.5, 0.25]


@query(
    sql("base") + PIXELS
    + f""", f as (select unnest({FACTORS})::double f), i as (select f, x, x*15 // cast(floor(15*f) as int) s from f, range(15) t(x) where x < floor(15*f)), j as (select f, y, y*12 // cast(floor(12*f) as int) s from f, range(12) t(y) where y < floor(12*f))
 select i.f factor, video, frame, cast(x as int) px, cast(y as int) py, v "value" from px join i on i.s=px.px join j on j.s=px.py and j.f=i.f"""
)
def downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image at four scales, by nearest neighbours."""
    out = [pixels.resampled(_pixels(spark, sf_dir), 15, 12, f).select(F.lit(f).alias("factor"), "video", "frame", "px", "py", "value") for f in FACTORS]
    return functools.reduce(DataFrame.unionByName, out)


@query(
    """with m as (select l_orderkey image, l_suppkey % 8 px, l_linenumber % 6 py, cast(max(l_partkey % 3) as smallint) id from lineitem group by all),
 s as (select image, id, avg(px) cx, avg(py) cy, var_pop(px)+1/12 a, var_pop(py)+1/12 c, covar_pop(px, py) b from m group by all),
 e as (select *, 2*sqrt((a+c)/2+sqrt(((a-c)/2)**2+b**2)) p, 2*sqrt(greatest(0, (a+c)/2-sqrt(((a-c)/2)**2+b**2))) q, atan2(2*b, a-c)/2 w from s where abs(b) > 0.001 or abs(a-c) > 0.001)
 select image, id, round(least(cx+p*cos(w)-q*sin(w), cx+p*cos(w)+q*sin(w), cx-p*cos(w)+q*sin(w), cx-p*cos(w)-q*sin(w)), 5) left_end, round(greatest(cy+p*sin(w)+q*cos(w), cy+p*sin(w)-q*cos(w), cy-p*sin(w)-q*cos(w), cy-p*sin(w)+q*cos(w)), 5) low_end,
  round(abs(p*cos(w))*2, 5) major_width, round(abs(q*cos(w))*2, 5) minor_height from e"""
)
def ellipse_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ellipses' corners and axes span, where they aren't circles."""
    line = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 3).alias("id"), (F.col("l_suppkey") % 8).alias("px"), (F.col("l_linenumber") % 6).alias("py"))
    merged = frames.merged_masks(line)
    e = pixels.ellipse_corners(frames.mask_moments(merged))
    spread = merged.groupBy("image", "id").agg(F.covar_pop("px", "py").alias("b"), (F.var_pop("px") - F.var_pop("py")).alias("d")).filter("abs(b) > 0.001 or abs(d) > 0.001")
    e = e.join(spread, ["image", "id"])
    return e.select(
        "image", "id", F.round(F.array_min(F.transform("corners", lambda p: p["x"])), 5).alias("left_end"), F.round(F.array_max(F.transform("corners", lambda p: p["y"])), 5).alias("low_end"),
        F.round(F.abs(F.col("major_axis")[1]["x"] - F.col("major_axis")[0]["x"]), 5).alias("major_width"), F.round(F.abs(F.col("minor_axis")[1]["y"] - F.col("minor_axis")[0]["y"]), 5).alias("minor_height"),
    )


# files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """select cast(l_orderkey as int) image_id, concat('frame_', lpad(cast(l_orderkey as varchar),8,'0'), '.png') file_name, l_partkey+trunc(l_quantity)/2 x, l_suppkey+(trunc(l_quantity)+1)/2 y, trunc(l_quantity) w, trunc(l_quantity)+1 h
 from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) = 1"""
)
def coco_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One COCO document of all images, written from sorted parts and read again element by element; then images are excluded and boxes centred."""
    orders, line = fixtures.table(spark, sf_dir, "orders"), fixtures.table(spark, sf_dir, "lineitem")
    named = lambda c: F.concat(F.lit("frame_"), F.lpad(F.col(c).cast("string"), 8, "0"), F.lit(".png"))
    whole = lambda c: F.col(c).cast("int")
    images = orders.select(whole("o_orderkey").alias("id"), F.lit(0).alias("width"), F.lit(0).alias("height"), named("o_orderkey").alias("file_name"))
    line = annotations.dedupe(line, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])
    q = whole("l_quantity").cast("double")
    box = F.array(F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"), q, q + 1)
    boxes_ = line.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int").alias("id"), whole("l_orderkey").alias("image_id"), F.lit(1).alias("category_id"), box.alias("bbox"), (q * (q + 1)).alias("area"), F.lit(0).alias("iscrowd"))
    kinds = line.select(F.lit(1).alias("id"), F.lit("animal").alias("name"), F.lit("animal").alias("supercategory")).limit(1)
    path = _folder(spark, "coco")
    coco.write(images, boxes_, kinds, path)
    read = coco.read_large(spark, [path])
    gone = orders.filter("o_orderstatus = 'F'").select(named("o_orderkey").alias("file_name"))
    kept, left = coco.exclude(read[0], read[1], gone)
    return coco.centers(kept, left).select("image_id", "file_name", "x", "y", "w", "h")


@query(
    sql("via_rows")
    + """ select filename, cast(l_orderkey as int) frame, l_linenumber gt_id, cast(json_extract_string(region_shape_attributes,'$.x') as double) x1, cast(json_extract_string(region_shape_attributes,'$.y') as double) y1,
 cast(json_extract_string(region_shape_attributes,'$.x') as double)+cast(json_extract_string(region_shape_attributes,'$.width') as double) x2 from via_rows"""
)
def via_table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VIA's CSV with its cells of JSON, written and read again as tracks."""
    rows, path = fixtures.via_rows(spark, sf_dir), _folder(spark, "via")
    rows = rows.select("filename", F.lit(8888).alias("file_size"), F.lit('{"clip":123}').alias("file_attributes"), F.lit(1).alias("region_count"), F.lit(0).alias("region_id"), "region_shape_attributes", "region_attributes")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    tracks = via.read_tracks(spark, path)
    return tracks.select(F.format_string("frame_%08d.png", "frame").alias("filename"), "frame", "gt_id", "x1", "y1", "x2")


@query(
    sql("observations")
    + """ select concat('v', video) video_id, concat('c', clip) clip_id, count(*) n, round(sum(case when video = 1 then x+1000 else x end), 3) x, max(escape_state) escape_state from observations group by video, clip"""
)
def track_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all clips, of which those of one video are then replaced, read again."""
    o, path = fixtures.observations(spark, sf_dir), _folder(spark, "store")
    o = o.withColumn("video_id", F.concat(F.lit("v"), "video")).withColumn("clip_id", F.concat(F.lit("c"), "clip")).drop("video", "clip")
    store.write(o, path)
    store.write(o.filter("video_id = 'v1'").withColumn("x", F.col("x") + 1000), path, "a", "w")
    return store.read(spark, path).groupBy("video_id", "clip_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"), F.max("escape_state").alias("escape_state"))


# synchronisation, sampling, parameters

SYNC = ", t as (select clip, loop_end_frame_ffmpeg-loop_start_frame_ffmpeg+1 n, 1000+clip*7 s from clips), w as (select max(s) s, min(s+n-1) e from t)"


@query(sql("clips") + SYNC + " select cast(clip as varchar) video, cast(t.s as bigint) start_frames, cast(t.s+n-1 as bigint) end_frames, cast(case when t.s=w.s then 0 else w.s-t.s end as bigint) start_idx, cast(case when t.s+n-1=w.e then n-1 else w.e-t.s end as bigint) end_idx from t, w")
def sync_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = 1000 + F.col("clip") * 7
    code = F.format_string("00:%02d:%02d:%02d", (start / 1500).cast("int"), ((start % 1500) / 25).cast("int"), (start % 25).cast("int"))
    n = F.col("loop_end_frame_ffmpeg") - F.col("loop_start_frame_ffmpeg") + 1
    streams = fixtures.clips(spark, sf_dir).select(F.col("clip").cast("string").alias("video"), F.lit("25/1").alias("r_frame_rate_str"), n.alias("n_frames"), code.alias("timecode"))
    return sync.window(sync.timecodes(streams)).select("video", "start_frames", "end_frames", "start_idx", "end_idx")


@query("with n as (select count(*) n from orders) select * from (select 'train' split, cast(trunc(n*0.8::double) as bigint) n from n union all select 'test', cast(trunc((n-trunc(n*0.8::double))*0.5) as bigint) from n union all select 'val', cast(n-trunc(n*0.8::double)-trunc((n-trunc(n*0.8::double))*0.5) as bigint) from n)")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return coco.split(images).groupBy("split").agg(F.count("*").alias("n"))


@query("with n as (select o_orderkey id, (row_number() over (order by o_orderkey)-1)//32 batch from orders) select batch, count(*) n from n where batch < floor((select max(batch)+1 from n)*0.25) group by batch")
def limited_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return coco.limited(coco.batches(images, 32), 0.25).groupBy("batch").agg(F.count("*").alias("n"))


@query(
    sql("base")
    + """, c as (select distinct video, clip, concat('c', clip) clip_name, cast(trunc((clip % 3)*60*0.25) as int) a, cast(trunc(((clip % 3)*60+80)*0.25) as int) b from base), f as (select distinct video, clip, frame from base)
 select f.video, f.clip, clip_name, frame, frame-a clip_frame from f join c on f.video=c.video and f.clip=c.clip and frame between a and b"""
)
def clip_frames_by_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame every four seconds; clips of 80 seconds begin at 0, 1 or 2 minutes."""
    f = fixtures.base(spark, sf_dir).select(*KEYS, "frame").distinct()
    at = lambda s: F.format_string("01:%02d:%02d", F.floor(s / 60).cast("int"), (s % 60).cast("int"))
    start = (F.col("clip") % 3) * 60
    c = f.select(*KEYS).distinct().select(*KEYS, F.concat(F.lit("c"), "clip").alias("clip_name"), F.lit(0.25).alias("fps"), F.lit("01:00:00").alias("video_start"), at(start).alias("clip_start"), at(start + 80).alias("clip_end"))
    return sampling.cut_by_clock(f, c, KEYS).select(*KEYS, "clip_name", "frame", "clip_frame")


@query("select concat('mlruns/1/', n_nationkey, '/checkpoints/last.ckpt') path, cast(n_nationkey as varchar) run, case when n_nationkey < 20 then n_name end name from nation")
def parameters_by_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = fixtures.table(spark, sf_dir, "nation")
    runs = nation.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("run"), F.create_map(F.lit("cli_args/name"), F.col("n_name")).alias("params"))
    paths = nation.select(F.concat(F.lit("mlruns/1/"), "n_nationkey", F.lit("/checkpoints/last.ckpt")).alias("path"))
    return files.stored_parameters(paths, runs).select("path", "run", F.try_element_at("params", F.lit("cli_args/name")).alias("name"))


@query(sql("base") + ", n as (select gt_id, frame, row_number() over (partition by gt_id order by frame)-1 r, greatest(1, count(*) over (partition by gt_id)//10) s from base) select gt_id, frame from n where r % s = 0 and r < s*10")
def initial_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.initial_samples(fixtures.base(spark, sf_dir), ["gt_id"], 10).select("gt_id", "frame")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.table(spark, sf_dir, "embeddings")
    vector = next(c for c, t in e.dtypes if t.startswith("array"))
    return e.select(F.col(e.columns[0]).alias("frame"), F.col(vector).alias("features"))


@query("""with v as (select vec_id frame, label % 2 side, unnest(cast(embedding as double[])) x, generate_subscripts(embedding, 1) i from embeddings), m as (select side, i, avg(x) c from v group by side, i),
 d as (select frame, side, sum((x-c)*(x-c)) d from v join m using (side, i) group by frame, side), n as (select *, row_number() over (partition by side order by d, frame) r from d) select frame, side, round(d,5) distance from n where r <= 5""")
def frames_of_two_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of vectors a thousand apart, with all components kept: the clusters, and so the rows nearest to their centres, are known."""
    e = fixtures.table(spark, sf_dir, "embeddings").withColumn("side", F.col("label") % 2)
    far = F.concat(F.array((1000.0 * F.col("side")).cast("double")), F.col("embedding").cast("array<double>"))
    v = e.select(F.col("vec_id").alias("frame"), "side", far.alias("features"))
    chosen = sampling.diverse(v, "features", n_components=len(v.first()["features"]), n_clusters=2)
    return chosen.select("frame", "side", F.round("distance", 5).alias("distance"))


@query()
def frames_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = sampling.diverse(_vectors(spark, sf_dir), "features")
    return chosen.select("frame", "cluster", r6("distance").alias("distance"))


@query("select n_nationkey run, 'model' section, 'lr' as name, cast(n_regionkey as varchar) \"value\" from nation union all select n_nationkey, 'model', 'n', n_name from nation")
def config_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.create_map(F.lit("config/model/lr"), F.col("n_regionkey").cast("string"), F.lit("config/model/n"), F.col("n_name"), F.lit("cli_args/seed"), F.lit("42"))
    return files.two_levels(fixtures.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run"), p.alias("params")), "config")


@query("select n_nationkey run, case when n_nationkey % 2 = 0 then '7' else '42' end seed from nation")
def stored_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.create_map(F.lit("cli_args/seed"), F.lit("42"))
    return fixtures.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run"), files.argument(F.when(F.col("n_nationkey") % 2 == 0, "7"), p, "seed").alias("seed"))
