"""Suppression and matching of boxes within a frame.

Greedy rules depend on order, so every box carries an ordinal and ties go to the smaller one.  The
folds are higher-order functions over one frame's arrays and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions import box as B


def ranked_boxes(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and an array of (score, ord, x, y, w, h), best score first, then by ord."""
    item = F.struct((-F.col("score")).alias("neg"), "ord", "x", "y", "w", "h", "score")
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias(name))


def suppress(df: DataFrame, threshold: float, keys: list[str], measure=B.iou, max_det: int | None = None) -> DataFrame:
    """Greedy suppression by group: a box stays if its measure with every kept better one is at most the threshold."""

    def keep(kept: Column, c: Column) -> Column:
        rival = F.exists(kept, lambda k: measure(B.box(of=k), B.box(of=c)) > F.lit(threshold))
        return F.when(rival, kept).otherwise(F.concat(kept, F.array(c)))

    ranked = ranked_boxes(df, keys, "_b")
    kept = F.aggregate("_b", F.slice("_b", 1, 0), keep)
    if max_det:
        kept = F.slice(kept, 1, max_det)
    out = ranked.select(*keys, F.posexplode(kept).alias("rank", "_k"))
    return out.select(*keys, (F.col("rank") + 1).alias("rank"), *[F.col("_k")[c].alias(c) for c in ("ord", "x", "y", "w", "h", "score")])


def postprocess(df: DataFrame, frames: DataFrame, score_thr: float = 0.6, nms_iou: float = 0.35, max_det: int = 100, class_agnostic: bool = True, clamp: bool = True, nms: bool = True) -> DataFrame:
    """Score filter, corner clamp, suppression, best max_det of each image (0: all)."""
    rows = df.where(F.col("score") >= F.lit(score_thr)).join(frames.select("image_id", "width", "height"), "image_id")
    if clamp:
        b = B.clip_corners(B.box(), F.col("width").cast("double"), F.col("height").cast("double"))
        rows = rows.withColumns({"x": b.x, "y": b.y, "w": b.w, "h": b.h}).where("w > 0 and h > 0")
    if nms:
        keys = ["image_id"] if class_agnostic else ["image_id", "category_id"]
        rows = suppress(rows, nms_iou, keys).drop("rank")
    if max_det:
        order = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "ord")
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_det)
    return rows.drop("width", "height")


def frame_match(frames: DataFrame, gt: DataFrame, pred: DataFrame, iou_thr: float, score_thr: float) -> DataFrame:
    """image_id, tp, fp, fn, max_conf: predictions by score each take their best free box with IoU of iou_thr or more.

    tp is 1 if any prediction found a box; fp counts predictions without one; fn is 1 where boxes exist and tp is 0.
    """
    boxes = gt.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("_g"))
    ranked = ranked_boxes(pred.where(F.col("score") >= F.lit(score_thr)), ["image_id"], "_p")
    both = frames.select("image_id").join(boxes, "image_id", "left").join(ranked, "image_id", "left")
    none = F.array().cast("array<int>")

    def take(used: Column, p: Column) -> Column:
        scored = F.transform("_g", lambda g, i: F.struct(B.iou(B.box(of=g), B.box(of=p)).alias("v"), (-i).alias("i")))
        free = F.filter(scored, lambda c: (c["v"] >= F.lit(iou_thr)) & (c["v"] > 0) & ~F.array_contains(used, -c["i"]))
        return F.when(F.size(free) > 0, F.concat(used, F.array(-F.array_max(free)["i"]))).otherwise(used)

    used = F.when(F.col("_g").isNull() | F.col("_p").isNull(), none).otherwise(F.aggregate("_p", none, take))
    n_pred = F.coalesce(F.when(F.col("_p").isNotNull(), F.size("_p")), F.lit(0))
    out = both.withColumns({"_u": F.size(used), "_n": n_pred, "_has": F.col("_g").isNotNull(), "max_conf": F.coalesce(F.element_at("_p", 1)["score"], F.lit(0.0))})
    tp = (F.col("_u") > 0).cast("int")
    return out.select("image_id", tp.alias("tp"), (F.col("_n") - F.col("_u")).alias("fp"), (F.col("_has") & (F.col("_u") == 0)).cast("int").alias("fn"), "max_conf")


def gt_matches(gt: DataFrame, pred: DataFrame, iou_thr: float) -> DataFrame:
    """image_id, n_gt, matched: boxes in their order each take their best free prediction (IoU of iou_thr or more)."""
    boxes = gt.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("_g"))
    preds = pred.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("_p"))
    both = boxes.join(preds, "image_id", "left")
    none = F.array().cast("array<int>")

    def take(used: Column, g: Column) -> Column:
        scored = F.transform("_p", lambda p, i: F.struct(B.iou(B.box(of=g), B.box(of=p)).alias("v"), (-i).alias("i")))
        free = F.filter(scored, lambda c: (c["v"] >= F.lit(iou_thr)) & (c["v"] > 0) & ~F.array_contains(used, -c["i"]))
        return F.when(F.size(free) > 0, F.concat(used, F.array(-F.array_max(free)["i"]))).otherwise(used)

    used = F.when(F.col("_p").isNull(), none).otherwise(F.aggregate("_g", none, take))
    return both.select("image_id", F.size("_g").alias("n_gt"), F.size(used).alias("matched"))


def any_hit(gt: DataFrame, pred: DataFrame, iou_thr: float | None = 0.5, center_px: float = 0.0, center_frac: float = 0.0) -> DataFrame:
    """gt's boxes with a prediction in their image that overlaps by iou_thr, or, if that is None, lies near by centre."""
    p = pred.select("image_id", *[F.col(c).alias(f"p_{c}") for c in "xywh"])
    g, q = B.Box(*[gt[c] for c in "xywh"]), B.Box(*[p[f"p_{c}"] for c in "xywh"])
    if iou_thr is not None:
        near = B.iou(g, q) >= F.lit(iou_thr)
    else:
        reach = F.lit(center_px) if center_px > 0 else F.lit(center_frac) * F.greatest(F.lit(1.0), B.diagonal(g))
        near = B.center_distance(g, q) <= reach
    return gt.join(p, (gt["image_id"] == p["image_id"]) & near, "left_semi")


def best_overlap(gt: DataFrame, pred: DataFrame, measure=B.iou, name: str = "best") -> DataFrame:
    """image_id, ord of each prediction and its best measure with any box of the image (null without boxes)."""
    g = gt.select("image_id", *[F.col(c).alias(f"g_{c}") for c in "xywh"])
    pairs = pred.join(g, "image_id", "left").withColumn("_v", measure(B.box(), B.box("g_")))
    return pairs.groupBy("image_id", "ord").agg(F.max("_v").alias(name))
