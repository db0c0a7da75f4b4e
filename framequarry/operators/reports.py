"""Summaries of controller logs, budgets, confirmations; collected result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prevalence import maybe_ratio, ratio

QUANTILES = (0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


def _share(cond: Column) -> Column:
    return ratio(F.count_if(cond), F.count("*"))


def mode_log(log: DataFrame, flags: list[str], *groups: str) -> DataFrame:
    """Counts and shares of modes, tiles where the verifier ran, risk by action, shares of flags.

    log: mode, num_tiles, risk and the flags (booleans, null counts as false).
    """
    ran = F.col("mode") != "skip"
    cols = [F.count("*").alias("num_frames"), F.count_if(ran).alias("do_verify_frames"), _share(ran).alias("do_verify_ratio")]
    for m in ("full", "subset", "skip"):
        cols += [F.count_if(F.col("mode") == m).alias(f"n_{m}"), _share(F.col("mode") == m).alias(f"share_{m}")]
    tiles = F.when(ran, F.col("num_tiles").cast("double"))
    cols += [F.coalesce(F.avg(tiles), F.lit(0.0)).alias("tiles_mean"), F.coalesce(F.percentile(tiles, 0.5), F.lit(0.0)).alias("tiles_p50"), F.coalesce(F.percentile(tiles, 0.95), F.lit(0.0)).alias("tiles_p95"), F.coalesce(F.max(tiles), F.lit(0.0)).alias("tiles_max")]
    for name, cond in (("all", F.lit(True)), ("do_verify", ran), ("skip", ~ran)):
        r = F.when(cond, F.col("risk"))
        cols += [F.coalesce(F.avg(r), F.lit(0.0)).alias(f"risk_mean_{name}"), F.coalesce(F.percentile(r, 0.95), F.lit(0.0)).alias(f"risk_p95_{name}")]
    cols += [_share(F.coalesce(F.col(f), F.lit(False))).alias(f"share_{f}") for f in flags]
    return log.groupBy(*groups).agg(*cols)


def quantile_table(log: DataFrame, columns: list[str], qs=QUANTILES) -> DataFrame:
    """Long form: one row for each column and quantile."""
    arrays = log.agg(*[F.percentile(c, F.array(*[F.lit(q) for q in qs])).alias(c) for c in columns])
    pieces = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])).alias("p")
    rows = arrays.select(pieces).select("p.column", F.posexplode("p.v").alias("_k", "value"))
    return rows.select("column", F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("_k") + 1).alias("q"), "value")


def escape_stats(log: DataFrame) -> DataFrame:
    """Frames with a soft, hard or any escape, and escapes that were skipped all the same."""
    soft, hard = F.coalesce("escape_soft", F.lit(False)), F.coalesce("escape_hard", F.lit(False))
    return log.agg(F.count_if(soft).alias("escape_soft"), F.count_if(hard).alias("escape_hard"), F.count_if(soft | hard).alias("escape_any"), F.count_if((soft | hard) & (F.col("mode") == "skip")).alias("escape_any_skip"))


def skipped_failures(failures: DataFrame, log: DataFrame) -> DataFrame:
    """Modes on failure frames; the last log row of an image counts; frames without one are reported.

    failures: image_id; log: image_id, ord, mode.
    """
    last = log.groupBy("image_id").agg(F.max_by("mode", "ord").alias("mode"))
    both = failures.select("image_id").distinct().join(last, "image_id", "left")
    t = both.agg(F.count("*").alias("num_failures"), F.count_if(F.col("mode").isNull()).alias("missing"), *[F.count_if(F.col("mode") == m).alias(f"n_{m}") for m in ("skip", "subset", "full")])
    return t.withColumn("skip_rate", ratio(F.col("n_skip"), F.col("num_failures") - F.col("missing")))


def confirmation_stats(log: DataFrame) -> DataFrame:
    """log: num_confirmed, num_unconfirmed, newly_confirmed, ttc_list. The 90th percentile is truncated, not interpolated."""
    ordered = F.sort_array(F.flatten(F.collect_list("ttc_list")))
    t = log.agg(
        F.count_if(F.col("num_confirmed") > 0).alias("confirm_frames"),
        F.count_if(F.col("num_unconfirmed") > 0).alias("unconfirmed_frames"),
        F.sum("newly_confirmed").alias("newly_confirmed_total"),
        ordered.alias("_t"),
    )
    n = F.size("_t")
    mean = maybe_ratio(F.aggregate("_t", F.lit(0).cast("long"), lambda a, x: a + x), n)
    return t.withColumns({"ttc_count": n, "ttc_mean": mean, "ttc_p90": F.get("_t", F.floor(F.lit(0.9) * (n - 1)).cast("int"))}).drop("_t")


def budget_stats(plans: DataFrame) -> DataFrame:
    """Histogram of reasons and buckets: what, value, frames."""
    rows = plans.select(F.explode(F.array(F.struct(F.lit("reason").alias("what"), F.col("reason").alias("value")), F.struct(F.lit("bucket").alias("what"), F.col("bucket_used").alias("value")))).alias("p"))
    return rows.select("p.*").groupBy("what", "value").agg(F.count("*").alias("frames"))


def location_stats(images: DataFrame, annotations: DataFrame, empty_category: int = 0, distinct_images: bool = False) -> DataFrame:
    """location, num_images, num_empty, empty_ratio; each annotation counts as an image unless distinct_images."""
    rows = annotations.select("image_id", (F.col("category_id") == empty_category).alias("_e")).join(images.select("image_id", "location"), "image_id")
    if distinct_images:
        rows = rows.groupBy("image_id", "location").agg(F.min("_e").alias("_e"))
    t = rows.where("location is not null").groupBy("location").agg(F.count("*").alias("num_images"), F.count_if("_e").alias("num_empty"))
    return t.withColumn("empty_ratio", ratio(F.col("num_empty"), F.col("num_images")))


def bundles(stats: DataFrame, sizes: list[int], min_images: int = 0, min_ratio: float = 0.0) -> DataFrame:
    """The `size` emptiest locations for each size: bundle_size, locations, num_images, num_empty, empty_ratio.

    One row for each location passes the driver's ordered top; sizes bound it.
    """
    order = [F.col("empty_ratio").desc(), F.col("num_images").desc(), F.col("location")]
    best = stats.where((F.col("num_images") >= min_images) & (F.col("empty_ratio") >= F.lit(min_ratio))).orderBy(*order).limit(max(sizes)).collect()
    rows = []
    for n in sizes:
        part = best[:n]
        if part:
            images, empty = sum(r.num_images for r in part), sum(r.num_empty for r in part)
            rows.append((n, [str(r.location) for r in part], images, empty, empty / images if images else 0.0))
    return stats.sparkSession.createDataFrame(rows, "bundle_size int, locations array<string>, num_images long, num_empty long, empty_ratio double")


def flattened(summaries: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Nested summary rows as a wide table: name -> path of a field; fields that don't exist become null."""

    def field(path: str) -> Column:
        kind = summaries.schema
        for part in path.split("."):
            if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
                return F.lit(None)
            kind = kind[part].dataType
        return F.col(path)

    return summaries.select(*[field(p).alias(n) for n, p in paths.items()])


def real_costs(runs: DataFrame) -> DataFrame:
    """method, fps by the first of: measured, frames / elapsed, 1000 / mean latency; runs: method, frames, elapsed_s, fps, mean_ms."""
    fps = F.coalesce("fps", maybe_ratio(F.col("frames"), F.col("elapsed_s")), maybe_ratio(F.lit(1000.0), F.col("mean_ms")))
    return runs.withColumn("fps", fps)


def acceptance(windows: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """One row for each check (name, FAIL or WARN, condition over an aggregate of windows) and whether it holds."""
    row = windows.agg(*[c.alias(n) for n, _, c in checks])
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.when(F.col(n), F.lit("OK")).otherwise(F.lit(level)).alias("result")) for n, level, _ in checks])).alias("p")
    return row.select(parts).select("p.*")


#: The least width and height of a focus window.
LEAST_WINDOW = (240.0, 220.0)


def union_boxes(boxes: DataFrame) -> DataFrame:
    """image_id, x, y, w, h: the smallest box around all boxes of an image."""
    low, high = [F.min(c).alias(c) for c in "xy"], [F.max(F.col(c) + F.col(s)).alias(f"_{c}") for c, s in (("x", "w"), ("y", "h"))]
    t = boxes.groupBy("image_id").agg(*low, *high)
    return t.select("image_id", "x", "y", (F.col("_x") - F.col("x")).alias("w"), (F.col("_y") - F.col("y")).alias("h"))


def focus_windows(frames: DataFrame, gt: DataFrame, pred: DataFrame, margin: float = 120.0) -> DataFrame:
    """image_id, x1, y1, x2, y2: what to show of each frame: all its boxes with a margin, widened to LEAST_WINDOW, inside the frame; without boxes the frame."""
    around = union_boxes(gt.select("image_id", *"xywh").unionByName(pred.select("image_id", *"xywh")))
    t = frames.select("image_id", F.col("width").cast("double").alias("_w"), F.col("height").cast("double").alias("_h")).join(around, "image_id", "left")
    out = {}
    for c, size, end, least in (("x", "w", "_w", LEAST_WINDOW[0]), ("y", "h", "_h", LEAST_WINDOW[1])):
        low, high = F.greatest(F.lit(0.0), F.col(c) - margin), F.least(F.col(end), F.col(c) + F.col(size) + margin)
        more = F.greatest(F.lit(0.0), (F.lit(least) - (high - low)) / 2)
        out[f"{c}1"] = F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(F.when(more > 0, F.greatest(F.lit(0.0), low - more)).otherwise(low))
        out[f"{c}2"] = F.when(F.col(c).isNull(), F.col(end)).otherwise(F.when(more > 0, F.least(F.col(end), high + more)).otherwise(high))
    return t.select("image_id", *[out[n].alias(n) for n in ("x1", "y1", "x2", "y2")])


def split_report(clips: DataFrame) -> DataFrame:
    """One row for each split: locations, clips, frames, presence over all frames, and truncating percentiles of the clips' presence.

    clips: one row for each clip with split, location, n_frames, presence; clips are few beside frames.
    """
    positive = F.sum(F.bround(F.col("presence") * F.col("n_frames")).cast("long"))
    t = clips.groupBy("split").agg(
        F.count_distinct("location").alias("num_locations"),
        F.count("*").alias("num_clips"),
        F.sum("n_frames").alias("num_frames"),
        positive.alias("_p"),
        F.sort_array(F.collect_list("presence")).alias("_r"),
    )
    at = lambda p: F.get("_r", F.floor(F.lit(p) * (F.size("_r") - 1)).cast("int"))
    return t.select("split", "num_locations", "num_clips", "num_frames", ratio(F.col("_p"), F.col("num_frames")).alias("overall_presence"), *[at(p / 100).alias(f"clip_presence_p{p}") for p in (25, 50, 75)])
