"""Pseudo-tracks of ground-truth boxes, their KPIs and conditional evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequarry.functions import box as B

from . import matching, runs
from .state import Machine, fold, iou


def linker(iou_thr: float = 0.3, center: float | None = None, center_frac: float = 0.0) -> Machine:
    """Links a frame's boxes to tracks of the frame before; frames without boxes needn't be rows: gaps end all tracks.

    center: by distance of centres of at most that many pixels or, if it is 0 or less, of center_frac diagonals of the
    new box (a pixel at least); as the rule stands, a distance of a whole pixel or more never links.
    """

    def score(a, b) -> float | None:
        if center is None:
            v = iou(a, b)
            return v if v >= iou_thr else None
        d = ((a[0] + a[2] / 2 - b[0] - b[2] / 2) ** 2 + (a[1] + a[3] / 2 - b[1] - b[3] / 2) ** 2) ** 0.5
        reach = center if center > 0 else center_frac * max(1.0, (b[2] ** 2 + b[3] ** 2) ** 0.5)
        return -d if d <= reach and d < 1.0 else None

    def step(s: dict, row: dict):
        boxes = [tuple(b[k] for k in "xywh") for b in row["boxes"]]
        ids, places, free, active = [0] * len(boxes), [0] * len(boxes), list(range(len(boxes))), []
        for t, last, n in s["active"] if row["frame_idx"] == s["before"] + 1 else []:
            fits = [(v, -j) for j in free if (v := score(last, boxes[j])) is not None]
            if fits:
                j = -max(fits)[1]
                free.remove(j)
                ids[j], places[j] = t, n
                active.append((t, boxes[j], n + 1))
        born = s["born"]
        for j in free:
            born += 1
            ids[j] = born
            active.append((born, boxes[j], 1))
        return {"active": active, "before": row["frame_idx"], "born": born}, {"ids": ids, "places": places}

    kinds = (("ids", T.ArrayType(T.IntegerType())), ("places", T.ArrayType(T.IntegerType())))
    return Machine("linker", lambda: {"active": [], "before": -2, "born": 0}, step, kinds)


def pseudo_tracks(frames: DataFrame, gt: DataFrame, iou_thr: float = 0.3, center: float | None = None, center_frac: float = 0.0) -> DataFrame:
    """image_id, video_id, frame_idx, ord, x, y, w, h, local_id, pos: boxes linked over consecutive frames.

    Tracks in the order of their birth take the best free box (IoU, or nearest centre within `center`); a track without one
    ends, and a frame without boxes ends all.  (video_id, local_id) names a track; pos counts its frames from 0.
    Only frames with boxes pass the shuffle: gaps show in their frame numbers.
    """
    boxes = gt.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", *"xywh"))).alias("boxes"))
    rows = frames.select("image_id", "video_id", "frame_idx").join(boxes, "image_id")
    linked = fold(rows, linker(iou_thr, center, center_frac), carry=["image_id", "frame_idx", "boxes"])
    each = linked.select("image_id", "video_id", "frame_idx", F.explode(F.arrays_zip("boxes", "ids", "places")).alias("z"))
    return each.select("image_id", "video_id", "frame_idx", *[F.col(f"z.boxes.{c}").alias(c) for c in ("ord", *"xywh")], F.col("z.ids").alias("local_id"), F.col("z.places").alias("pos"))


def track_hits(tracks: DataFrame, pred: DataFrame, iou_thr: float = 0.5, **center) -> DataFrame:
    """tracks with hit: whether any prediction of the frame matches the box."""
    hit = matching.any_hit(tracks.select("image_id", "ord", *"xywh"), pred, iou_thr, **center).select("image_id", "ord").withColumn("_h", F.lit(1))
    return tracks.join(hit, ["image_id", "ord"], "left").withColumn("hit", F.coalesce("_h", F.lit(0))).drop("_h")


def track_facts(hits: DataFrame, lock_n: int, small_max_area: float = 1024.0, ready_n: int = 2) -> DataFrame:
    """One row for each track: frames, small share, first hit, lock, start of the first run of ready_n hits."""
    key = ["video_id", "local_id"]
    base = hits.groupBy(*key).agg(
        F.count("*").alias("n_frames"),
        F.avg((B.area(B.box()) <= F.lit(small_max_area)).cast("double")).alias("small_frac"),
        F.min(F.when(F.col("hit") == 1, F.col("pos"))).alias("first_hit"),
        F.min("frame_idx").alias("start_frame"),
    )
    lock = runs.sustained_lock(hits, F.col("hit") == 1, key, "pos", lock_n)
    ready = runs.first_run_start(hits, F.col("hit") == 1, key, "pos", ready_n).withColumnRenamed("start", "ready_at")
    return base.join(lock, key).join(ready, key)


def track_kpis(facts: DataFrame, small_track_frac: float = 0.5) -> DataFrame:
    """Rows `overall` and `small_only`: recall, time to detection of found tracks, miss, lock and ready rates."""
    both = facts.withColumn("_s", F.when(F.col("small_frac") >= F.lit(small_track_frac), F.array(F.lit("overall"), F.lit("small_only"))).otherwise(F.array(F.lit("overall"))))
    rows = both.withColumn("scope", F.explode("_s"))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("scope").agg(
        F.count("*").alias("num_tracks"),
        share(F.col("first_hit").isNotNull()).alias("track_init_recall"),
        F.percentile("first_hit", 0.5).alias("ttd_p50"),
        F.percentile("first_hit", 0.9).alias("ttd_p90"),
        share(F.col("first_hit").isNull()).alias("miss_rate"),
        share(F.col("locked")).alias("sustained_lock_rate"),
        share(F.col("ready_at").isNotNull()).alias("ready_rate"),
    )


def motion(tracks: DataFrame) -> DataFrame:
    """video_id, local_id, n_frames, avg_motion: mean displacement of the centre between frames (0 for one frame)."""
    cx, cy = B.center(B.box())
    w = Window.partitionBy("video_id", "local_id").orderBy("pos")
    step = F.hypot(cx - F.lag(cx).over(w), cy - F.lag(cy).over(w))
    moved = tracks.withColumn("_d", step)
    return moved.groupBy("video_id", "local_id").agg(F.count("*").alias("n_frames"), F.coalesce(F.avg("_d"), F.lit(0.0)).alias("avg_motion"))


def evaluation_sets(tracks: DataFrame, frames: DataFrame, gt: DataFrame, max_len: int = 10, small_frac: float = 0.5, small_max_area: float = 1024.0, top: float = 0.2, bottom: float = 0.2, gap: int = 5) -> DataFrame:
    """video_id, local_id, set_name for the sets: new_appearance, short_dwell, hard_small, high_motion, low_motion_small."""
    key = ["video_id", "local_id"]
    facts = tracks.groupBy(*key).agg(F.count("*").alias("n_frames"), F.avg((B.area(B.box()) <= F.lit(small_max_area)).cast("double")).alias("small"), F.min("frame_idx").alias("start"))
    facts = facts.join(motion(tracks).drop("n_frames"), key)
    # frames without boxes right before a track's start
    present = gt.select("image_id").distinct().withColumn("_g", F.lit(1))
    order = Window.partitionBy("video_id").orderBy("frame_idx")
    last = F.max(F.when(F.col("_g").isNotNull(), F.col("frame_idx"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = frames.join(present, "image_id", "left").select("video_id", F.col("frame_idx").alias("start"), (F.col("frame_idx") - 1 - F.coalesce(last, F.lit(-1))).alias("_gap"))
    facts = facts.join(gaps, ["video_id", "start"])
    limits = facts.agg(F.percentile("avg_motion", 1.0 - top).alias("_hi"), F.percentile("avg_motion", bottom).alias("_lo"))
    facts = facts.join(F.broadcast(limits))  # one row
    tag = lambda cond, name: F.when(cond, F.lit(name))
    hard = F.col("small") >= F.lit(small_frac)
    tags = F.array_compact(
        F.array(
            tag(F.col("_gap") >= gap, "new_appearance"),
            tag(F.col("n_frames") <= max_len, "short_dwell"),
            tag(hard, "hard_small"),
            tag(F.col("avg_motion") >= F.col("_hi"), "high_motion"),
            tag(hard & (F.col("avg_motion") <= F.col("_lo")), "low_motion_small"),
        )
    )
    return facts.select(*key, F.explode(tags).alias("set_name"))


def global_ids(tracks: DataFrame) -> DataFrame:
    """tracks with track_id: 1, 2, ... by (video_id, local_id); numbers come from counts by video, not from one sorted task."""
    counts = tracks.groupBy("video_id").agg(F.max("local_id").alias("_n"))
    starts = counts.select("video_id", (F.sum("_n").over(Window.orderBy("video_id")) - F.col("_n")).alias("_s"))
    return tracks.join(starts, "video_id").withColumn("track_id", (F.col("_s") + F.col("local_id")).cast("long")).drop("_s")


def small_share(column: Column, limit: float) -> Column:
    """Share of boxes whose area is at most the limit."""
    return F.avg((column <= F.lit(limit)).cast("double"))
