"""False positives on empty frames: masks, labels per threshold, prevalence tables.

All steps are one lazy plan: predictions are counted per frame before any join, so the joins carry
one row for each frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAUS = (0.3, 0.5, 0.7)


def ratio(n: Column, d: Column) -> Column:
    """n / d; 0 where d is 0."""
    return F.coalesce(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)), F.lit(0.0))


def maybe_ratio(n: Column, d: Column) -> Column:
    """n / d; null where d is 0."""
    return n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))


def empty_mask(frames: DataFrame, gt: DataFrame, target: int | None = None) -> DataFrame:
    """frames with gt_num_boxes and is_empty: no box of the target category (None: of any)."""
    boxes = gt if target is None else gt.where(F.col("category_id") == target)
    counts = boxes.groupBy("image_id").agg(F.count("*").alias("gt_num_boxes"))
    out = frames.join(counts, "image_id", "left").withColumn("gt_num_boxes", F.coalesce("gt_num_boxes", F.lit(0)))
    return out.withColumn("is_empty", F.col("gt_num_boxes") == 0)


def empty_mask_summary(mask: DataFrame) -> DataFrame:
    """frames, empty frames and their ratio by video_id; the row with video_id null holds the total."""
    out = mask.groupBy("video_id").agg(F.count("*").alias("n"), F.count_if("is_empty").alias("e"))
    total = out.agg(F.sum("n").alias("n"), F.sum("e").alias("e")).select(F.lit(None).cast(mask.schema["video_id"].dataType).alias("video_id"), "n", "e")
    out = out.unionByName(total)
    return out.select("video_id", F.col("n").alias("num_frames"), F.col("e").alias("num_empty_frames"), ratio(F.col("e"), F.col("n")).alias("empty_ratio"))


def prevalence_input(mask: DataFrame, pred: DataFrame, cost: DataFrame, taus=TAUS) -> DataFrame:
    """One row for each frame: mask, cost (0 without one), number of predictions and top score, and n_ge: their numbers by tau."""
    by_tau = F.array(*[F.count_if(F.col("score") >= F.lit(t)) for t in taus])
    per_image = pred.groupBy("image_id").agg(F.count("*").alias("pred_count"), F.max("score").alias("top_score"), by_tau.alias("n_ge"))
    out = mask.join(per_image, "image_id", "left").join(cost.select("image_id", "verifier_on", "tiles_used", "latency_ms"), "image_id", "left")
    none = F.array(*[F.lit(0).cast("long") for _ in taus])
    return out.withColumns(
        {
            "pred_count": F.coalesce("pred_count", F.lit(0)),
            "top_score": F.coalesce("top_score", F.lit(0.0)),
            "n_ge": F.coalesce("n_ge", none),
            "verifier_on": F.coalesce("verifier_on", F.lit(0)),
            "tiles_used": F.coalesce("tiles_used", F.lit(0)),
            "latency_ms": F.coalesce("latency_ms", F.lit(0.0)),
        }
    )


def high_conf_labels(rows: DataFrame, taus=TAUS) -> DataFrame:
    """Long form: one row for each frame and tau with has_high_conf_fp, fp_count, max_fp_conf."""
    long = rows.select("image_id", "video_id", "is_empty", "verifier_on", "top_score", F.posexplode("n_ge").alias("_k", "pred_count_ge"))
    tau = F.element_at(F.array(*[F.lit(float(t)) for t in taus]), F.col("_k") + 1)
    fp = F.col("is_empty") & (F.col("pred_count_ge") > 0)
    return long.select(
        "image_id",
        "video_id",
        "is_empty",
        "verifier_on",
        tau.alias("tau"),
        "pred_count_ge",
        fp.alias("has_high_conf_fp"),
        F.when(F.col("is_empty"), F.col("pred_count_ge")).otherwise(F.lit(0)).alias("fp_count"),
        F.when(fp, F.col("top_score")).otherwise(F.lit(0.0)).alias("max_fp_conf"),
    )


def prevalence_table(labels: DataFrame, *groups: str) -> DataFrame:
    """Prevalence over empty frames by tau (and `groups`), overall and with the verifier on or off."""
    on = F.col("verifier_on") == 1
    fp = F.col("has_high_conf_fp")
    # labels of non-empty frames count nothing: they needn't pass the shuffle
    t = (
        labels.where("is_empty")
        .groupBy(*groups, "tau")
        .agg(
            F.count("*").alias("num_empty_frames"),
            F.count_if(fp).alias("num_empty_fp_frames"),
            F.count_if(on).alias("num_empty_verifier_on_frames"),
            F.count_if(on & fp).alias("num_empty_fp_on_frames"),
            F.count_if(~on).alias("num_empty_verifier_off_frames"),
            F.count_if(~on & fp).alias("num_empty_fp_off_frames"),
            F.sum("fp_count").alias("_fp"),
            # scores are hundredths: their sum in integers doesn't depend on the order of rows
            F.sum(F.when(fp, F.round(F.col("max_fp_conf") * 1e6).cast("long"))).alias("_conf"),
        )
    )
    c = F.col
    on_ratio, off_ratio = ratio(c("num_empty_fp_on_frames"), c("num_empty_verifier_on_frames")), ratio(c("num_empty_fp_off_frames"), c("num_empty_verifier_off_frames"))
    return t.withColumns(
        {
            "prevalence_on_empty": ratio(c("num_empty_fp_frames"), c("num_empty_frames")),
            "prevalence_given_on": on_ratio,
            "prevalence_given_off": off_ratio,
            "amplification_ratio": on_ratio / F.nullif(off_ratio, F.lit(0.0)),
            "amplification_diff": on_ratio - off_ratio,
            "mean_fp_count_on_empty": ratio(c("_fp"), c("num_empty_frames")),
            "mean_max_fp_conf": F.coalesce(c("_conf").cast("double") / F.nullif(c("num_empty_fp_frames").cast("double"), F.lit(0.0)) / 1e6, F.lit(0.0)),
        }
    ).drop("_fp", "_conf")


def effr_efpd(labels: DataFrame, *groups: str) -> DataFrame:
    """Over empty frames by tau: share of frames with a prediction (effr) and predictions a frame (efpd)."""
    t = labels.where("is_empty").groupBy(*groups, "tau").agg(F.count("*").alias("num_empty"), F.count_if("has_high_conf_fp").alias("_f"), F.sum("fp_count").alias("_n"))
    return t.select(*groups, "tau", "num_empty", ratio(F.col("_f"), F.col("num_empty")).alias("effr"), ratio(F.col("_n"), F.col("num_empty")).alias("efpd"))


def disagreement(mask: DataFrame, scores_a: DataFrame, scores_b: DataFrame, high: float, low: float) -> DataFrame:
    """Empty frames where model A's best score is at least `high` and B's below `low`; the strongest first."""
    best = lambda s, name: s.groupBy("image_id").agg(F.max("score").alias(name))
    out = mask.where("is_empty").join(best(scores_a, "max_a"), "image_id", "left").join(best(scores_b, "max_b"), "image_id", "left")
    out = out.select("image_id", "video_id", F.coalesce("max_a", F.lit(0.0)).alias("max_a"), F.coalesce("max_b", F.lit(0.0)).alias("max_b"))
    return out.where((F.col("max_a") >= high) & (F.col("max_b") < low)).orderBy(F.col("max_a").desc(), "max_b", "image_id")
