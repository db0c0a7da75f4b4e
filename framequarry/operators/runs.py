"""Runs of frames: segments, streaks, delays, locks. Gaps and islands over (video_id, frame order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(df: DataFrame, flag: Column, key: str = "video_id", t: str = "frame_idx") -> DataFrame:
    """Maximal runs of frames (t, t + 1, ...) where flag holds: key, s, e (inclusive), length."""
    hits = df.where(flag).select(key, t)
    island = F.col(t) - F.row_number().over(Window.partitionBy(key).orderBy(t))
    runs = hits.withColumn("_i", island).groupBy(key, "_i").agg(F.min(t).alias("s"), F.max(t).alias("e"))
    return runs.select(key, "s", "e", (F.col("e") - F.col("s") + 1).alias("length"))


def flagged(df: DataFrame, flag: Column, key: str = "video_id", t: str = "frame_idx") -> DataFrame:
    """df with seg_start: the first frame of the run that a frame with flag belongs to, else null.

    The run's start is the latest frame without the flag, plus one: a running maximum in the order that
    other windows over (key, t) use too, so it adds no shuffle to theirs.
    """
    first = F.min(t).over(Window.partitionBy(key))
    before = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    last_off = F.max(F.when(~flag, F.col(t))).over(before)
    return df.withColumn("seg_start", F.when(flag, F.coalesce(last_off + 1, first)))


def segment_delay_miss(facts: DataFrame, flag: Column, key: str = "video_id", t: str = "frame_idx") -> DataFrame:
    """For each segment: delay to the first frame with tp (its length without one) and the longest run of fn."""
    marked = flagged(facts, flag, key, t).where("seg_start is not null")
    in_run = Window.partitionBy(key, "seg_start").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    since = F.col(t) - F.coalesce(F.max(F.when(F.col("fn") != 1, F.col(t))).over(in_run), F.col("seg_start") - 1)
    marked = marked.withColumn("_miss", F.when(F.col("fn") == 1, since).otherwise(F.lit(0)))
    seg = marked.groupBy(key, "seg_start").agg(F.max(t).alias("e"), F.min(F.when(F.col("tp") == 1, F.col(t))).alias("_first"), F.max("_miss").alias("miss_streak"))
    length = F.col("e") - F.col("seg_start") + 1
    return seg.select(key, F.col("seg_start").alias("s"), "e", length.alias("length"), F.coalesce(F.col("_first") - F.col("seg_start"), length).alias("delay"), "miss_streak")


def streak_since(df: DataFrame, hit: Column, key: str, order: list, name: str = "streak") -> DataFrame:
    """Rows since the last hit in the order (0 on a hit; from the start, if there was none)."""
    w = Window.partitionBy(key).orderBy(*order)
    rank = df.withColumn("_n", F.row_number().over(w))
    last = F.max(F.when(hit, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rank.withColumn(name, F.col("_n") - F.coalesce(last, F.lit(0))).drop("_n")


def streak_bucket(streak: Column) -> Column:
    return F.when(streak <= 1, F.lit("0_1")).when(streak <= 5, F.lit("2_5")).otherwise(F.lit("6p"))


def longest_run(df: DataFrame, hit: Column, key: list[str], t: str, name: str = "longest") -> DataFrame:
    """key and the longest run of consecutive t with hit (0 without one)."""
    all_keys = df.groupBy(*key).agg(F.count("*").alias("_n"))
    island = F.col(t) - F.row_number().over(Window.partitionBy(*key).orderBy(t))
    runs = df.where(hit).withColumn("_i", island).groupBy(*key, "_i").agg(F.count("*").alias("_l"))
    best = runs.groupBy(*key).agg(F.max("_l").alias(name))
    return all_keys.join(best, key, "left").select(*key, F.coalesce(name, F.lit(0)).alias(name))


def sustained_lock(df: DataFrame, hit: Column, key: list[str], t: str, n: int) -> DataFrame:
    """key and locked: whether n hits follow each other; always, if n is 0 or less."""
    out = longest_run(df, hit, key, t)
    return out.select(*key, (F.col("longest") >= n if n > 0 else F.lit(True)).alias("locked"))


def first_run_start(df: DataFrame, hit: Column, key: list[str], t: str, n: int) -> DataFrame:
    """key and start: the first t of the first run of n hits or more; null without one."""
    all_keys = df.groupBy(*key).agg(F.count("*").alias("_n"))
    island = F.col(t) - F.row_number().over(Window.partitionBy(*key).orderBy(t))
    runs = df.where(hit).withColumn("_i", island).groupBy(*key, "_i").agg(F.count("*").alias("_l"), F.min(t).alias("_s"))
    found = runs.where(F.col("_l") >= max(1, n)).groupBy(*key).agg(F.min("_s").alias("start"))
    return all_keys.join(found, key, "left").select(*key, "start")


def merged_intervals(windows: DataFrame, key: str = "video_id", start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or adjacent [start, end] merged: key, run, start, end, and gap: frames since the run before."""
    w = Window.partitionBy(key).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (seen.isNull() | (F.col(start) > seen + 1)).cast("int")
    runs = windows.withColumn("_o", opens).withColumn("_r", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(key, "_r").agg(F.min(start).alias("start"), F.max(end).alias("end"))
    gap = F.col("start") - F.lag("end").over(Window.partitionBy(key).orderBy("_r")) - 1
    return out.select(key, F.col("_r").cast("int").alias("run"), "start", "end", gap.alias("gap"))


def sliding_windows(flags: DataFrame, length: int, step: int, max_ratio: float, key: str = "video_id", t: str = "frame_idx", flag: str = "flag") -> DataFrame:
    """Windows of `length` frames (or the whole video) every `step` whose share of flagged frames is at most max_ratio.

    One prefix sum for each frame; a window's count is the sum over its own frames, found by a window frame.
    """
    per = Window.partitionBy(key)
    n = flags.withColumn("_n", F.count("*").over(per))
    own = F.least(F.lit(length), F.col("_n"))
    up_to = F.sum(F.col(flag).cast("int")).over(per.orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumns({"_l": own, "_p": up_to})
    end = n.select(key, F.col(t).alias("end"), F.col("_p").alias("_pe"), "_l").withColumn("start", F.col("end") - F.col("_l") + 1)
    end = end.where((F.col("start") >= 0) & (F.col("start") % step == 0))
    begin = n.select(key, F.col(t).alias("start"), (F.col("_p") - F.col(flag).cast("int")).alias("_ps"))
    out = end.join(begin, [key, "start"]).withColumn("pos_frames", F.col("_pe") - F.col("_ps"))
    share = F.col("pos_frames").cast("double") / F.col("_l").cast("double")
    return out.where(share <= F.lit(float(max_ratio))).select(key, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("pos_frames").cast("long").alias("pos_frames"), F.col("_l").cast("long").alias("len_frames"), share.alias("pos_ratio"))
