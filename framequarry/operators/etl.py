"""Normalising detection datasets: names, categories, clips, exports, static cost logs."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .splits import numbered


def parsed_names(images: DataFrame, name: str = "file_name") -> DataFrame:
    """images with location (first part of the path), session (second to last) and base_name (last)."""
    parts = F.split(F.regexp_replace(F.col(name), r"\\", "/"), "/")
    n = F.size(parts)
    return images.withColumns({"location": F.when(n > 1, F.element_at(parts, 1)), "session": F.when(n > 2, F.element_at(parts, -2)), "base_name": F.element_at(parts, -1)})


def one_class(images: DataFrame, annotations: DataFrame, categories: DataFrame, drop: tuple[str, ...] = ("empty", "human", "person"), category: int = 1) -> tuple[DataFrame, DataFrame]:
    """Images and annotations with new ids (by file name) and one class; annotations of dropped categories go.

    A category is dropped if its name holds one of the words. Raises if an annotation names an unknown image.
    """
    unwanted = categories.where(F.lower("name").rlike("|".join(drop))).select(F.col("id").alias("category_id"))
    kept = annotations.join(F.broadcast(unwanted), "category_id", "left_anti")
    if not kept.join(images.select("image_id"), "image_id", "left_anti").isEmpty():
        raise ValueError("an annotation names an image that isn't there")
    ids = numbered(images, "file_name", "_new")
    out = kept.join(ids.select("image_id", "_new"), "image_id").withColumn("image_id", F.col("_new")).drop("_new").withColumn("category_id", F.lit(category))
    return ids.withColumn("image_id", F.col("_new")).drop("_new"), out


def target_category(categories: DataFrame, category_id: int | None = None, name: str | None = None) -> int:
    """An explicit id, else the id of a name (ignoring case), else the only category; otherwise raises."""
    if category_id is not None:
        return category_id
    rows = categories.where(F.lower("name") == name.lower()).limit(2).collect() if name else categories.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"no single category{f' named {name}' if name else ''}")
    return rows[0]["id"]


def keep_by_either(rows: DataFrame, image_ids: DataFrame, sequence_ids: DataFrame) -> DataFrame:
    """Rows whose image_id or seq_id is listed: two equality joins, no join on a disjunction."""
    a = image_ids.select("image_id").distinct().withColumn("_a", F.lit(1))
    b = sequence_ids.select("seq_id").distinct().withColumn("_b", F.lit(1))
    return rows.join(a, "image_id", "left").join(b, "seq_id", "left").where("_a is not null or _b is not null").drop("_a", "_b")


def exported_sequences(images: DataFrame, with_ids: bool = True) -> DataFrame:
    """video_id (seq_id, else location), new image ids in the order (video, frame_num, file name), frame_idx."""
    video = F.coalesce("seq_id", "location")
    order = Window.partitionBy("_v").orderBy(F.col("frame_num").asc_nulls_last(), "file_name")
    rows = images.withColumn("_v", video).withColumn("frame_idx", F.row_number().over(order) - 1)
    if with_ids:
        counts = rows.groupBy("_v").agg(F.count("*").alias("_n"))
        starts = counts.select("_v", (F.sum("_n").over(Window.orderBy("_v")) - F.col("_n")).alias("_s"))
        rows = rows.join(starts, "_v").withColumn("new_id", (F.col("_s") + F.col("frame_idx") + 1).cast("long")).drop("_s")
    return rows.withColumnRenamed("_v", "video_id") if "video_id" not in images.columns else rows.withColumn("video_id", F.col("_v")).drop("_v")


def static_cost_log(frames: DataFrame, on: bool, tiles: Column | int = 0, latency_ms: float = 0.0) -> DataFrame:
    """A cost row for each frame of a constant schedule."""
    n = tiles if isinstance(tiles, Column) else F.lit(int(tiles))
    return frames.select("video_id", F.col("frame_idx").alias("t"), "image_id", F.lit(int(on)).alias("verifier_on"), (n if on else F.lit(0)).alias("tiles_used"), F.lit(float(latency_ms)).alias("latency_ms"))


def target_bundle(stats: DataFrame, ratio: float, images: int, tolerance: int, min_images: int = 1, trials: int = 20, seed: int = 0, most: int = 100_000) -> dict:
    """A set of locations whose images and empty share come near the targets, by restarts of greedy adding, dropping and swapping.

    stats: location, num_images, num_empty; one small row for each location reaches the driver (at most `most`, else it raises).
    """
    rows = [(str(r.location), int(r.num_images), int(r.num_empty)) for r in stats.where(F.col("num_images") >= min_images).limit(most + 1).collect()]
    if not rows or len(rows) > most:
        raise ValueError("no location, or too many of them")

    def error(chosen: set[int]) -> float:
        n, e = sum(rows[i][1] for i in chosen), sum(rows[i][2] for i in chosen)
        return 1e9 if n <= 0 else abs(e / n - ratio) + 0.05 * abs(n - images) / max(tolerance, 1)

    best: tuple[float, list[int]] = (float("inf"), [])
    for trial in range(trials):
        order = list(range(len(rows)))
        random.Random(seed + trial).shuffle(order)
        order.sort(key=lambda i: (abs(rows[i][2] / rows[i][1] - ratio), abs(rows[i][1] - min(images, 2000))))
        chosen: set[int] = set()
        for i in order:
            size = sum(rows[j][1] for j in chosen)
            if size >= images + tolerance:
                break
            if len(chosen) < 4 or size < 0.85 * images or error(chosen | {i}) <= error(chosen):
                chosen.add(i)
        while True:
            now = error(chosen)
            moves = [chosen - {i} for i in chosen] + [chosen | {i} for i in order if i not in chosen] + [chosen - {i} | {j} for i in chosen for j in order if j not in chosen]
            better = min(moves, key=error, default=chosen)
            if error(better) >= now:
                break
            chosen = better
        best = min(best, (error(chosen), sorted(chosen)))
    n, e = sum(rows[i][1] for i in best[1]), sum(rows[i][2] for i in best[1])
    return {"locations": sorted(rows[i][0] for i in best[1]), "num_images": n, "num_empty": e, "empty_ratio": e / n if n else 0.0, "score": best[0]}
