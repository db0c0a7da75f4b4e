"""Necessity of the verifier: failure frames, rescued and new objects, failure intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions import box as B

from . import matching
from .prevalence import ratio


def small_boxes(gt: DataFrame, max_area: float) -> DataFrame:
    """Boxes of at most max_area; where area is 0 or less, width times height counts."""
    return gt.where(F.when(F.col("area") > 0, F.col("area")).otherwise(F.col("w") * F.col("h")) <= F.lit(max_area))


def success(gt: DataFrame, pred: DataFrame, iou_thr: float, strict: bool = True) -> DataFrame:
    """image_id, ok: all boxes matched (strict) or any."""
    m = matching.gt_matches(gt, pred, iou_thr)
    return m.select("image_id", (F.col("matched") == F.col("n_gt") if strict else F.col("matched") >= 1).alias("ok"))


def failure_frames(gt: DataFrame, off: DataFrame, on: DataFrame, iou_thr: float, strict: bool = True) -> DataFrame:
    """image_id, failure: succeeds with `on` only."""
    a, b = success(gt, off, iou_thr, strict), success(gt, on, iou_thr, strict)
    return a.toDF("image_id", "_off").join(b.toDF("image_id", "_on"), "image_id").select("image_id", (F.col("_on") & ~F.col("_off")).alias("failure"))


def rescued(gt: DataFrame, off: DataFrame, on: DataFrame, iou_thr: float) -> DataFrame:
    """Boxes that a prediction of `on` hits and none of `off`."""
    hit_on = matching.any_hit(gt, on, iou_thr)
    hit_off = matching.any_hit(gt, off, iou_thr).select("image_id", "ord")
    return hit_on.join(hit_off, ["image_id", "ord"], "left_anti")


def new_objects(objects: DataFrame, boxes: DataFrame, times: DataFrame, window: int, max_distance: float | None = 50.0, iou_thr: float = 0.3, per_video: bool = True) -> DataFrame:
    """objects without a box in the `window` frames before theirs that lies near (centres, or IoU if max_distance is None).

    times: image_id, video_id, t.  The look-back is an equality on the time's bucket: every box is filed
    under its own bucket and the next, so a pair within the window shares one, and no range join is needed.
    """
    keys = ["video_id"] if per_video else []
    placed = boxes.join(times, "image_id").select(*keys, F.col("t").alias("_tt"), *[F.col(c).alias(f"b_{c}") for c in "xywh"])
    bucket = F.floor(F.col("_tt") / window)
    placed = placed.withColumn("_k", F.explode(F.array(bucket, bucket + 1)))
    asked = objects.join(times, "image_id").withColumn("_k", F.floor(F.col("t") / window))
    a, b = B.box(), B.box("b_")
    near = B.center_distance(a, b) <= F.lit(max_distance) if max_distance is not None else B.iou(a, b) >= F.lit(iou_thr)
    before = (F.col("_tt") < F.col("t")) & (F.col("_tt") >= F.col("t") - window)
    # the window's pairs only need to exist: keys of objects that have one
    seen = asked.select(*keys, "_k", "t", "image_id", "ord", *"xywh").join(placed, [*keys, "_k"]).where(before & near).select("image_id", "ord").distinct()
    return objects.join(seen, ["image_id", "ord"], "left_anti")


def time_index(frames: DataFrame, per_video: bool = True) -> DataFrame:
    """image_id, video_id, t: position in the video, or in the order (frame_idx, image_id) over all frames.

    The global order is one sequence by definition; its numbers come from counts by frame_idx, so that no
    task gets all frames.
    """
    if per_video:
        return frames.select("image_id", "video_id", F.col("frame_idx").alias("t"))
    counts = frames.groupBy("frame_idx").agg(F.count("*").alias("_n"))
    # as many rows as the longest video has frames
    starts = counts.select("frame_idx", (F.sum("_n").over(Window.orderBy("frame_idx")) - F.col("_n")).alias("_s"))
    inside = F.row_number().over(Window.partitionBy("frame_idx").orderBy("image_id"))
    return frames.join(starts, "frame_idx").select("image_id", "video_id", (F.col("_s") + inside - 1).cast("long").alias("t"))


#: Stretches of time that failures are dealt to where no group splits them.
STRETCHES = 4096


def intervals(failures: DataFrame, times: DataFrame, *groups: str) -> DataFrame:
    """Mean and 95th percentile of the distances between consecutive failure times, and their inverses.

    Without groups the failures are one sequence: they are dealt to STRETCHES of time, whose ends (one row each)
    bridge the gaps between them.
    """
    at = failures.where("failure").join(times, "image_id")
    if groups:
        w = Window.partitionBy(*groups).orderBy("t")
        d = at.withColumn("delta", F.col("t") - F.lag("t").over(w))
    else:
        limits = times.agg(F.min("t").alias("_a"), F.max("t").alias("_z"))  # one row
        stretch = F.floor((F.col("t") - F.col("_a")) / (F.floor((F.col("_z") - F.col("_a")) / STRETCHES) + 1))
        at = at.join(F.broadcast(limits)).withColumn("_s", stretch)
        ends = at.groupBy("_s").agg(F.max("t").alias("_e"))
        ends = ends.select("_s", F.lag("_e").over(Window.orderBy("_s")).alias("_before"))
        w = Window.partitionBy("_s").orderBy("t")
        d = at.join(F.broadcast(ends), "_s").withColumn("delta", F.col("t") - F.coalesce(F.lag("t").over(w), "_before"))
    t = d.where("delta is not null").groupBy(*groups).agg(F.count("*").alias("n_intervals"), F.avg("delta").alias("mean_delta"), F.percentile("delta", 0.95).alias("p95_delta"))
    inverse = lambda c: F.when(F.col(c) > 0, F.lit(1.0) / F.col(c))
    return t.withColumns({"csf_mean": inverse("mean_delta"), "csf_p95": inverse("p95_delta")})


def need_summary(failures: DataFrame, rescued_boxes: DataFrame, new: DataFrame) -> DataFrame:
    """Frames with small boxes, failures, their ratio; rescued boxes, new ones among them, their ratio."""
    f = failures.agg(F.count("*").alias("eval_frames"), F.count_if("failure").alias("failure_frames"))
    r = rescued_boxes.agg(F.count("*").alias("rescued_total"))
    n = new.agg(F.count("*").alias("rescued_new"))
    one = f.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(n))  # one row each
    return one.withColumns({"ffr": ratio(F.col("failure_frames"), F.col("eval_frames")), "nodr": ratio(F.col("rescued_new"), F.col("rescued_total"))})
