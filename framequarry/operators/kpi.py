"""Frame facts and the KPI tables built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import matching, prevalence, runs
from .prevalence import maybe_ratio, ratio


def gt_index(frames: DataFrame, gt: DataFrame, small_taus=(0.01, 0.02)) -> DataFrame:
    """frames with n_gt, is_pos, is_empty and has_small_<k>: any box of at most that share of the image's area."""
    sized = gt.join(frames.select("image_id", (F.col("width") * F.col("height")).cast("double").alias("_a")), "image_id")
    small = [F.max((F.col("area") / F.col("_a") <= F.lit(t)).cast("int")).alias(f"has_small_{k}") for k, t in enumerate(small_taus)]
    per = sized.groupBy("image_id").agg(F.count("*").alias("n_gt"), *small)
    out = frames.join(per, "image_id", "left").withColumns({"n_gt": F.coalesce("n_gt", F.lit(0))} | {f"has_small_{k}": F.coalesce(f"has_small_{k}", F.lit(0)) for k in range(len(small_taus))})
    return out.withColumns({"is_pos": F.col("n_gt") > 0, "is_empty": F.col("n_gt") == 0})


def frame_facts(frames: DataFrame, gt: DataFrame, pred: DataFrame, cost: DataFrame, iou_thr: float = 0.5, conf_thr: float = 0.25, small_taus=(0.01, 0.02), taus=prevalence.TAUS, average: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """One row for each frame: ground-truth flags, match results, predictions by tau, cost. The base of all KPI tables.

    average: the run's mean tiles and latency, which stand for frames without a cost (the verifier ran if the tiles are above 0).
    """
    index = gt_index(frames, gt, small_taus)
    match = matching.frame_match(frames, gt, pred, iou_thr, conf_thr)
    counts = pred.groupBy("image_id").agg(F.count_if(F.col("score") >= F.lit(conf_thr)).alias("n_pred"), F.array(*[F.count_if(F.col("score") >= F.lit(t)) for t in taus]).alias("n_ge"))
    out = index.join(match, "image_id").join(counts, "image_id", "left").join(cost, "image_id", "left")
    return out.withColumns({"n_pred": F.coalesce("n_pred", F.lit(0)), "n_ge": F.coalesce("n_ge", F.array(*[F.lit(0).cast("long") for _ in taus])), "verifier_on": F.coalesce("verifier_on", F.lit(int(average[0] > 0))), "tiles_used": F.coalesce("tiles_used", F.lit(average[0] or 0)), "latency_ms": F.coalesce("latency_ms", F.lit(float(average[1])))})


def _mean_if(cond: Column, value: Column) -> Column:
    return F.avg(F.when(cond, value.cast("double")))


def per_video(facts: DataFrame) -> DataFrame:
    """One KPI row for each video (conditional aggregation), with its segments' delays and misses."""
    empty, pos, on = F.col("is_empty"), F.col("is_pos"), F.col("verifier_on") == 1
    rows = facts.groupBy("video_id").agg(
        F.count("*").alias("num_frames"),
        F.count_if(pos).alias("num_pos_frames"),
        F.count_if(empty).alias("num_empty_frames"),
        F.avg(F.col("verifier_on").cast("double")).alias("verifier_on_ratio"),
        F.avg(F.col("tiles_used").cast("double")).alias("avg_tiles"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.count_if(empty & on).alias("_eo"),
        F.count_if(~empty & on).alias("_po"),
        _mean_if(empty, F.col("tiles_used")).alias("empty_avg_tiles"),
        _mean_if(~empty, F.col("tiles_used")).alias("pos_avg_tiles"),
        F.count_if(empty & (F.col("fp") > 0)).alias("_ef"),
        F.max("has_small_0").alias("has_small"),
    )
    seg = runs.segment_delay_miss(facts, pos).groupBy("video_id").agg(
        F.count("*").alias("num_segments"),
        F.avg("delay").alias("delay_mean"),
        F.percentile("delay", 0.5).alias("delay_p50"),
        F.percentile("delay", 0.9).alias("delay_p90"),
        F.avg("miss_streak").alias("miss_mean"),
        F.percentile("miss_streak", 0.9).alias("miss_p90"),
    )
    c = F.col
    rows = rows.withColumns(
        {
            "presence_ratio": ratio(c("num_pos_frames"), c("num_frames")),
            "fps": maybe_ratio(F.lit(1000.0), c("avg_latency_ms")),
            "empty_verifier_on_ratio": ratio(c("_eo"), c("num_empty_frames")),
            "pos_verifier_on_ratio": ratio(c("_po"), c("num_frames") - c("num_empty_frames")),
            "empty_fp_rate": ratio(c("_ef"), c("num_empty_frames")),
        }
    ).drop("_eo", "_po", "_ef")
    return rows.join(seg, "video_id", "left").withColumn("num_segments", F.coalesce("num_segments", F.lit(0)))


def summary(facts: DataFrame) -> DataFrame:
    """One row over all frames (not an average of the videos' rows)."""
    empty, on = F.col("is_empty"), F.col("verifier_on") == 1
    t = facts.agg(
        F.count("*").alias("num_frames"),
        F.count_if(empty).alias("num_empty_frames"),
        F.sum("tp").alias("tp_frames"),
        F.count_if(F.col("fp") > 0).alias("fp_frames"),
        F.sum("fn").alias("fn_frames"),
        F.sum("n_pred").alias("num_pred_boxes"),
        F.count_if(on).alias("verifier_on_frames"),
        F.sum("tiles_used").alias("total_tiles"),
        F.sum(F.when(on, F.col("tiles_used"))).alias("tiles_on"),
        F.count_if(empty & on).alias("empty_on_frames"),
        F.count_if(empty & (F.col("fp") > 0)).alias("empty_fp_frames"),
        F.sum(F.when(empty, F.col("tiles_used"))).alias("empty_tiles"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )
    c = F.col
    return t.withColumns(
        {
            "verifier_on_ratio": ratio(c("verifier_on_frames"), c("num_frames")),
            "avg_tiles": ratio(c("total_tiles"), c("num_frames")),
            "avg_tiles_on": ratio(c("tiles_on"), c("verifier_on_frames")),
            "empty_fp_rate": ratio(c("empty_fp_frames"), c("num_empty_frames")),
            "fps": maybe_ratio(F.lit(1000.0), c("avg_latency_ms")),
        }
    )


def latency_stats(cost: DataFrame, *groups: str) -> DataFrame:
    """Frames, mean, exact percentiles and frames a second of the latencies."""
    t = cost.groupBy(*groups).agg(F.count("*").alias("frames"), F.avg("latency_ms").alias("mean_ms"), *[F.percentile("latency_ms", q).alias(f"p{int(q * 100)}_ms") for q in (0.5, 0.9, 0.95)])
    return t.withColumn("fps", maybe_ratio(F.lit(1000.0), F.col("mean_ms")))


def truncated_percentile(values: Column, p: float) -> Column:
    """Aggregate: the sorted value at index int(p * (n - 1)), without interpolation."""
    ordered = F.sort_array(F.collect_list(values))
    return F.get(ordered, F.floor(F.lit(p) * (F.size(ordered) - 1)).cast("int"))


def coverage_buckets(facts: DataFrame, streak: Column, seed_empty: Column, value: Column) -> DataFrame:
    """Mean of value by overlapping filters: all, each streak bucket, seed-empty or not."""
    bucket = runs.streak_bucket(streak)
    tags = F.array(F.lit("all"), F.concat(F.lit("streak_"), bucket), F.when(seed_empty, F.lit("seed_empty")).otherwise(F.lit("not_seed_empty")))
    return facts.select(F.explode(tags).alias("bucket"), value.cast("double").alias("_v")).groupBy("bucket").agg(F.count("*").alias("frames"), F.avg("_v").alias("mean_value"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values."""
    t = df.groupBy(column).agg(F.count("*").alias("n"))
    total = t.agg(F.sum("n").alias("_total"))
    return t.join(F.broadcast(total)).select(column, "n", ratio(F.col("n"), F.col("_total")).alias("share"))
