"""Dataset preparation: slimming, subsets, clips, splits, unions with new ids.

Seeded choices use md5 of the seed and the key, so that any engine reproduces them.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runs
from .prevalence import ratio


def draw(seed: int, *keys: Column) -> Column:
    """A reproducible random string by key; its order is a shuffle."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def slim(pred: DataFrame, score_thr: float, top_k: int = 100, category: int | None = None, remap: dict[int, int] | None = None) -> DataFrame:
    """Predictions with score and category (after remapping), the best top_k of each image (0 or less: 100); rank from 1."""
    top_k = top_k if top_k > 0 else 100
    if remap:
        table = F.create_map(*[F.lit(x) for kv in sorted(remap.items()) for x in kv])
        pred = pred.withColumn("category_id", F.coalesce(F.element_at(table, F.col("category_id")), F.col("category_id")))
    rows = pred.where(F.col("score") >= F.lit(score_thr))
    if category is not None:
        rows = rows.where(F.col("category_id") == category)
    order = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "ord")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def slim_counts(pred: DataFrame, score_thr: float, top_k: int = 100, category: int | None = None) -> DataFrame:
    """Rows dropped by each reason, in the order of the checks, and rows kept."""
    usable = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    early = F.when(F.col("score") < F.lit(score_thr), F.lit("score"))
    if category is not None:
        early = early.when(F.col("category_id") != category, F.lit("category"))
    marked = pred.withColumn("_r", early.when(~usable, F.lit("format")))
    order = Window.partitionBy("image_id", F.col("_r").isNull()).orderBy(F.col("score").desc(), "ord")
    marked = marked.withColumn("_k", F.row_number().over(order))
    reason = F.coalesce("_r", F.when(F.col("_k") > top_k, F.lit("topk")), F.lit("kept"))
    return marked.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def target_absent(frames: DataFrame, gt: DataFrame, target: int) -> DataFrame:
    """Frames without a box of the target category."""
    return frames.join(gt.where(F.col("category_id") == target).select("image_id"), "image_id", "left_anti")


def small_subset(frames: DataFrame, gt: DataFrame, tau: float) -> DataFrame:
    """Boxes whose share of the image's area is at most tau."""
    sized = gt.join(frames.select("image_id", (F.col("width") * F.col("height")).cast("double").alias("_a")), "image_id")
    return sized.where(F.col("area") / F.col("_a") <= F.lit(tau)).drop("_a")


def clip_presence(frames: DataFrame, gt: DataFrame, min_len: int = 1, max_ratio: float | None = None) -> DataFrame:
    """video_id, n_frames, n_pos, presence of clips with at least min_len frames and at most max_ratio presence."""
    pos = gt.select("image_id").distinct().withColumn("_p", F.lit(1))
    t = frames.join(pos, "image_id", "left").groupBy("video_id").agg(F.count("*").alias("n_frames"), F.count("_p").alias("n_pos"))
    t = t.withColumn("presence", ratio(F.col("n_pos"), F.col("n_frames"))).where(F.col("n_frames") >= min_len)
    return t.where(F.col("presence") <= F.lit(max_ratio)) if max_ratio is not None else t


def video_meta(flags: DataFrame) -> DataFrame:
    """By video: length, positive segments, longest runs with and without, presence. flags: video_id, frame_idx, flag."""
    t = flags.groupBy("video_id").agg(F.count("*").alias("video_len"), F.count_if("flag").alias("n_pos"))
    hit = runs.segments(flags, F.col("flag")).groupBy("video_id").agg(F.count("*").alias("num_pos_segments"), F.max("length").alias("max_pos_run"))
    miss = runs.segments(flags, ~F.col("flag")).groupBy("video_id").agg(F.max("length").alias("max_neg_run"))
    t = t.join(hit, "video_id", "left").join(miss, "video_id", "left")
    zero = {c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("num_pos_segments", "max_pos_run", "max_neg_run")}
    return t.withColumns(zero | {"presence": ratio(F.col("n_pos"), F.col("video_len"))})


def bins(meta: DataFrame) -> DataFrame:
    """meta with len_bin, seg_bin, ratio_bin."""
    n, s, r = F.col("video_len"), F.col("num_pos_segments"), F.col("presence")
    return meta.withColumns(
        {
            "len_bin": F.when(n <= 30, F.lit("L<=30")).when(n <= 60, F.lit("31-60")).when(n <= 120, F.lit("61-120")).otherwise(F.lit(">120")),
            "seg_bin": F.when(s == 0, F.lit("0")).when(s == 1, F.lit("1")).otherwise(F.lit(">=2")),
            "ratio_bin": F.when(r == 0, F.lit("0")).when(r <= F.lit(0.1), F.lit("(0,0.1]")).when(r <= F.lit(0.3), F.lit("(0.1,0.3]")).otherwise(F.lit(">0.3")),
        }
    )


def stratified_split(meta: DataFrame, strata: list[str], share: float, seed: int = 0, key: str = "video_id") -> DataFrame:
    """meta with split: in each stratum max(1, round(n * share)) keys, but not all of several, are the holdout."""
    by = Window.partitionBy(*strata)
    n = F.count("*").over(by)
    k = F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("int"))
    k = F.when(n > 1, F.least(k, n - 1)).otherwise(F.lit(1))
    rank = F.row_number().over(by.orderBy(draw(seed, F.col(key)), key))
    return meta.withColumn("split", F.when(rank <= k, F.lit("holdout")).otherwise(F.lit("dev")))


def location_split(frames_per_location: DataFrame, dev_frac: float, seed: int = 0, location: str = "location", n: str = "n_frames") -> DataFrame:
    """Whole locations to dev or holdout: by size (ties shuffled), dev while the frames before fall short of the target.

    One row for each location passes the ordered window: locations are few beside frames.
    """
    order = Window.orderBy(F.col(n).desc(), draw(seed, F.col(location)), location)
    total = Window.partitionBy()
    before = F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goal = F.floor(F.lit(dev_frac) * F.sum(n).over(total))
    t = frames_per_location.withColumns({"_dev": before < goal, "_i": F.row_number().over(order), "_m": F.count("*").over(total)})
    t = t.withColumn("_d", F.sum(F.col("_dev").cast("int")).over(total))
    # neither side stays empty
    dev = F.when((F.col("_d") == 0) & (F.col("_m") > 0), F.col("_i") == 1).when((F.col("_d") == F.col("_m")) & (F.col("_m") > 0), F.col("_i") < F.col("_m")).otherwise(F.col("_dev"))
    return t.select(location, n, F.when(dev, F.lit("dev")).otherwise(F.lit("holdout")).alias("split"))


def union_dedupe(parts: list[DataFrame], name: str, id_name: str = "id") -> DataFrame:
    """Rows of several tables, one for each `name` (that of the earliest table wins), with new ids 1, 2, ... by name.

    Ids come from ranges of names: each range is numbered apart and starts after the counts of those before.
    """
    tagged = [p.withColumn("_src", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for p in tagged[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    first = Window.partitionBy(name).orderBy("_src")
    rows = both.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return numbered(rows, name, id_name).withColumnRenamed("_src", "source_nr")


#: Names that are looked at to cut all names into ranges, and ranges.
CUT_NAMES, RANGES = 20_000, 1000


def numbered(rows: DataFrame, name: str, id_name: str = "id") -> DataFrame:
    """rows with 1, 2, ... by `name` (unique strings): counts by range of names give the starts, ranks within it the rest.

    The ranges are cut at names of a sample by hash (CUT_NAMES at most), so that common beginnings of names don't
    matter; numbers don't depend on them.  The driver gets the sample, each task RANGES cuts.
    """
    sample = sorted(r[0] for r in rows.where(F.col(name).isNotNull()).select(name).orderBy(F.xxhash64(name), name).limit(CUT_NAMES).collect())
    step = max(1, len(sample) // RANGES)
    cuts = [x.encode() for x in sample[step::step]]

    @F.pandas_udf("int")
    def place(names: pd.Series) -> pd.Series:
        return names.map(lambda x: -1 if x is None else bisect_right(cuts, x.encode())).astype("int32")

    t = rows.withColumn("_x", place(F.col(name)))
    counts = t.groupBy("_x").agg(F.count("*").alias("_n"))
    starts = counts.select("_x", (F.sum("_n").over(Window.orderBy("_x")) - F.col("_n")).alias("_s"))  # RANGES rows
    inside = F.row_number().over(Window.partitionBy("_x").orderBy(name))
    return t.join(F.broadcast(starts), "_x").withColumn(id_name, (F.col("_s") + inside).cast("long")).drop("_x", "_s")


def event_windows(flags: DataFrame, length: int, pre: tuple[int, int], seed: int = 0) -> DataFrame:
    """One window of `length` frames around each segment, started a seeded number of frames before it, kept inside the video."""
    sizes = flags.groupBy("video_id").agg(F.count("*").cast("int").alias("_n"))
    seg = runs.segments(flags, F.col("flag")).join(sizes, "video_id")
    own = F.least(F.lit(length), F.col("_n"))
    spread = pre[1] - pre[0] + 1
    back = F.lit(pre[0]) + F.pmod(F.conv(F.substring(draw(seed, F.col("video_id"), F.col("s")), 1, 8), 16, 10).cast("long"), F.lit(spread)).cast("int")
    start = F.greatest(F.lit(0), F.col("s") - back)
    start = F.greatest(F.lit(0), F.least(start, F.col("_n") - own))
    # a longer segment than the window's rest: the window ends with it
    start = F.when(F.col("e") > start + own - 1, F.greatest(F.lit(0), F.col("e") - own + 1)).otherwise(start)
    return seg.select("video_id", start.cast("int").alias("start"), (start + own - 1).cast("int").alias("end"), F.lit("event").alias("type"))


def balanced(windows: DataFrame, target: int, max_per_video: int, seed: int = 0) -> DataFrame:
    """Round robin over shuffled videos: first windows of all videos, then second ones, ..., `target` in all."""
    inside = F.row_number().over(Window.partitionBy("video_id").orderBy(draw(seed, F.col("video_id"), F.col("start")), "start"))
    ranked = windows.withColumn("_r", inside).where(F.col("_r") <= max_per_video)
    return ranked.orderBy("_r", draw(seed, F.col("video_id")), "video_id").limit(target).drop("_r")


def window_frames(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """The windows' frames; a frame in two windows appears twice."""
    rows = windows.select("video_id", "start", F.explode(F.sequence("start", "end")).alias("frame_idx"))
    return rows.join(frames.select("video_id", "frame_idx", "image_id"), ["video_id", "frame_idx"])


def with_negatives(events: DataFrame, negatives: DataFrame, target: float, tolerance: float, max_per_video: int, seed: int = 0, rounds: int = 10) -> DataFrame:
    """events and as many shuffled negative windows as bring the share of flagged frames to `target`.

    events, negatives: video_id, start, end, pos_frames, len_frames.  A video gives max_per_video windows in all; a number
    near the target is computed, then corrected one window at a time, `rounds` times at most.  Windows are ranked by a
    seeded hash: its first digits deal them to 4096 groups, whose counts and sums and those of 2 * rounds + 1 windows
    reach the driver.
    """
    pos, size = events.agg(F.sum("pos_frames"), F.sum("len_frames")).first()
    pos, size = pos or 0, size or 0
    used = events.groupBy("video_id").agg(F.count("*").alias("_u"))
    inside = F.row_number().over(Window.partitionBy("video_id").orderBy(draw(seed, F.col("video_id"), F.col("start")), "start"))
    free = negatives.join(used, "video_id", "left").withColumn("_k", inside).where(F.col("_k") + F.coalesce("_u", F.lit(0)) <= max_per_video).drop("_u", "_k")
    mean = negatives.agg(F.avg("len_frames")).first()[0] or 50.0
    need = int(-(-max(0, -(-pos // target) - size) // round(mean)) if target > 0 else 0)
    free = free.withColumn("_d", draw(seed + 1, F.col("video_id"), F.col("start"))).withColumn("_g", F.substring("_d", 1, 3))
    groups = sorted(map(tuple, free.groupBy("_g").agg(F.count("*"), F.sum("pos_frames"), F.sum("len_frames")).collect()))
    total = sum(g[1] for g in groups)
    n = min(need, total)
    first, last = max(1, n - rounds), min(total, n + rounds)
    starts, count, p, t = [], 0, 0, 0
    for g, k, own_pos, own_len in groups:
        starts.append((g, count, p, t))
        count, p, t = count + k, p + own_pos, t + own_len
    starts = events.sparkSession.createDataFrame(starts, "_g string, _c long, _p long, _t long")
    order = Window.partitionBy("_g").orderBy("_d", "video_id", "start")
    ranked = free.join(F.broadcast(starts), "_g").withColumn("_i", F.col("_c") + F.row_number().over(order))
    sums = ranked.withColumns({"_p": F.col("_p") + F.sum("pos_frames").over(order), "_t": F.col("_t") + F.sum("len_frames").over(order)})
    at = {r["_i"]: (r["_p"], r["_t"]) for r in sums.where(F.col("_i").between(first, last)).select("_i", "_p", "_t").collect()} | {0: (0, 0)}
    for _ in range(rounds):
        frames = size + at[n][1]
        share = (pos + at[n][0]) / frames if frames else 0.0
        if abs(share - target) <= tolerance or (share > target and n == total) or (share < target and n == 0):
            break
        n += 1 if share > target else -1
    chosen = ranked.where(F.col("_i") <= n).drop("_i", "_g", "_d", "_c", "_p", "_t")
    return events.unionByName(chosen, allowMissingColumns=True)


def merge_sequences(a: DataFrame, b: DataFrame, suffix: str = "_val", video: str = "video_id") -> DataFrame:
    """Frames of two sequence lists; a video of b that a has, too, gets the suffix; rows without a video are dropped."""
    seen = a.select(F.col(video).alias("_seen")).distinct()
    rows = b.join(seen, F.col(video) == F.col("_seen"), "left")
    rows = rows.withColumn(video, F.when(F.col("_seen").isNotNull(), F.concat(F.col(video).cast("string"), F.lit(suffix))).otherwise(F.col(video).cast("string"))).drop("_seen")
    return a.withColumn(video, F.col(video).cast("string")).unionByName(rows, allowMissingColumns=True).where(F.col(video).isNotNull())


def target_subsets(images: DataFrame, bundles: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """tag (as target20) and the images of each bundle's locations; with a listing (file_name), only images that are there.

    bundles: target_empty_ratio, locations (array); an image may belong to several.  A manifest is the annotations of a tag's images.
    """
    tag = F.concat(F.lit("target"), F.lpad(F.bround(F.col("target_empty_ratio") * 100).cast("int").cast("string"), 2, "0"))
    places = bundles.select(tag.alias("tag"), F.explode(F.array_distinct("locations")).alias("_at")).distinct()
    out = images.join(places, images["location"].cast("string") == F.col("_at")).drop("_at")
    return out if listing is None else out.join(listing.select("file_name").distinct(), "file_name", "left_semi")
