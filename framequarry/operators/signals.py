"""Scalar signals of a frame as Column expressions: difference statistics, motion, risk, escapes, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def array_percentile(values: Column, q: float) -> Column:
    """Linear interpolation over an array; 0 for an empty one."""
    s = F.array_sort(values)
    at = F.lit(q) * (F.size(s) - 1).cast("double")
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return F.when(F.size(s) > 0, a + (b - a) * (at - low.cast("double"))).otherwise(F.lit(0.0))


def array_stats(values: Column) -> dict[str, Column]:
    """mean, std (population), p95, p99 and the gap of the two largest of an array of doubles; 0 where undefined."""
    n = F.size(values).cast("double")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(n > 0, total / n).otherwise(F.lit(0.0))
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    s = F.sort_array(values, False)
    return {
        "mean": mean,
        "std": F.when(n > 0, F.sqrt(squares / n)).otherwise(F.lit(0.0)),
        "p95": array_percentile(values, 0.95),
        "p99": array_percentile(values, 0.99),
        "top1_gap": F.coalesce(F.get(s, 0) - F.coalesce(F.get(s, 1), F.lit(0.0)), F.lit(0.0)),
    }


def lagged_difference(df: DataFrame, value: str, lag: int, key: str = "video_id", t: str = "frame_idx", name: str = "motion") -> DataFrame:
    """|value - value `lag` frames before| (0 without one)."""
    w = Window.partitionBy(key).orderBy(t)
    return df.withColumn(name, F.coalesce(F.abs(F.col(value) - F.lag(value, lag).over(w)), F.lit(0.0)))


def accumulated(df: DataFrame, value: str, window: int, key: str = "video_id", t: str = "frame_idx", name: str = "motion") -> DataFrame:
    """Mean of the last `window` values."""
    w = Window.partitionBy(key).orderBy(t).rowsBetween(-(window - 1), 0)
    return df.withColumn(name, F.avg(value).over(w))


def additive_risk(motion: Column, blur: Column, n_boxes: Column, max_score: Column, margin: Column, tracking_fail: Column, low_motion: float = 1.0, low_margin: float = 0.05, low_score: float = 0.15, low_blur: float = 20.0) -> dict[str, Column]:
    """Generation 3: flags and their sum; low motion counts only beside another suspicious signal."""
    uncertain = (n_boxes > 0) & ((max_score < F.lit(low_score)) | (margin < F.lit(low_margin)))
    still = motion < F.lit(low_motion)
    one = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return {"low_motion": still, "blur_susp": blur < F.lit(low_blur), "uncertain": uncertain, "risk": one(still & (uncertain | tracking_fail | (n_boxes == 0))) + one(tracking_fail) + one(uncertain)}


def escapes(z: Column, n_target: Column, n_all: Column, streak_target: Column, streak_all: Column, z_low: float = 1.0, z_high: float = 1.5, soft: int = 10, hard: int = 30, skip: int = 20) -> dict[str, Column]:
    """Generation 4: escapes from blind stretches, and frames that are safe to skip."""
    still, change = z < F.lit(-z_low), z > F.lit(z_high)
    is_soft = (n_target == 0) & ~still & (change | (streak_target >= soft))
    return {"escape_soft": is_soft, "escape_hard": is_soft & (streak_all >= hard), "strong_skip": (n_target == 0) & (n_all == 0) & still & (streak_all >= skip)}


def threshold_buckets(df: DataFrame, values: dict[str, float], id_column: str = "image_id") -> DataFrame:
    """bucket, id: for each column and quantile, rows up to the quantile's value (<column>_low) and above (<column>_high)."""
    limits = df.agg(*[F.percentile(c, q).alias(f"_{c}") for c, q in values.items()])
    rows = df.join(F.broadcast(limits))  # one row
    tags = F.array_compact(F.array(F.lit("overall"), *[F.when(F.col(c) <= F.col(f"_{c}"), F.lit(f"{c}_low")).when(F.col(c) > F.col(f"_{c}"), F.lit(f"{c}_high")) for c in values]))
    return rows.select(F.explode(tags).alias("bucket"), id_column)


def miss_signals(df: DataFrame, miss: str, signals: list[str]) -> DataFrame:
    """signal, mean and population deviation over missed frames and over all."""
    pieces = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in signals])).alias("p")
    rows = df.select(miss, pieces).select(miss, "p.*")
    own = F.when(F.col(miss), F.col("v"))
    return rows.groupBy("signal").agg(F.avg(own).alias("mean_miss"), F.stddev_pop(own).alias("std_miss"), F.avg("v").alias("mean_all"), F.stddev_pop("v").alias("std_all"))
