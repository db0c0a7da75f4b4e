"""Detector seam: any callable from images to boxes, run in Arrow batches over frames or tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import matching, tiles

#: A detector gets payloads (bytes or None) and returns, for each, boxes (x, y, w, h, score, label).
Detector = Callable[[list], list[list[tuple[float, float, float, float, float, int]]]]
BOXES = "array<struct<x:double,y:double,w:double,h:double,score:double,label:int>>"


def detect(rows: DataFrame, make: Callable[[], Detector], payload: str, keys: list[str], batch: int = 32) -> DataFrame:
    """keys and one row for each box; `make` builds the detector once in each task."""
    kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("x", "y", "w", "h", "score")] + [("label", pa.int32())]))
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + f", boxes {BOXES}"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                found = [[dict(zip(("x", "y", "w", "h", "score", "label"), d)) for d in each] for each in run(part.column(payload).to_pylist())]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(found, kind)], [*keys, "boxes"])

    found = rows.select(*keys, payload).mapInArrow(step, schema)
    return found.select(*keys, F.posexplode("boxes").alias("ord", "b")).select(*keys, "ord", "b.*")


def sliced(frames: DataFrame, grid: DataFrame, crop: Callable[[list, list], list], make: Callable[[], Detector], payload: str = "content", score_thr: float = 0.25, nms_iou: float = 0.5, **preset) -> DataFrame:
    """Tiles of every frame are detected, shifted back, filtered, merged by class, and postprocessed.

    crop: from payloads and tiles (x, y, w, h) to the tiles' payloads.
    """
    jobs = frames.join(F.broadcast(grid), ["width", "height"])

    def cropping() -> Detector:
        run = make()
        return lambda rows: run(crop([r["p"] for r in rows], [(r["x"], r["y"], r["w"], r["h"]) for r in rows]))

    packed = jobs.withColumn("_job", F.struct(F.col(payload).alias("p"), "x", "y", "w", "h")).withColumnsRenamed({"x": "tx", "y": "ty"})
    found = detect(packed, cropping, "_job", ["image_id", "tile_id", "tx", "ty"])
    shifted = found.where(F.col("score") >= F.lit(score_thr)).select("image_id", "tile_id", F.col("label").alias("category_id"), (F.col("x") + F.col("tx")).alias("x"), (F.col("y") + F.col("ty")).alias("y"), "w", "h", "score", F.col("ord").alias("_o"))
    order = Window.partitionBy("image_id").orderBy("tile_id", "_o")
    numbered = shifted.withColumn("ord", F.row_number().over(order)).drop("_o", "tile_id")
    merged = matching.suppress(numbered, nms_iou, ["image_id", "category_id"]).drop("rank")
    return matching.postprocess(merged, frames, **preset)


def coarse_stats(boxes: DataFrame, keep: float = 0.25, low: float = 0.05, small_area: float = 1024.0) -> DataFrame:
    """By image: best and mean score and margin of the two best over all boxes; counts over the kept ones."""
    ordered = F.sort_array(F.collect_list("score"), False)
    kept = F.col("score") >= F.lit(keep)
    t = boxes.groupBy("image_id").agg(F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), ordered.alias("_s"), F.count_if(kept).alias("num_boxes"), F.count_if(F.col("score") <= F.lit(low)).alias("num_low"), F.count_if(kept & (F.col("w") * F.col("h") <= F.lit(small_area))).alias("num_small"))
    return t.withColumn("margin", F.get("_s", 0) - F.coalesce(F.get("_s", 1), F.lit(0.0))).drop("_s")


def mapped_labels(boxes: DataFrame, mapping: dict[int, int], column: str = "category_id") -> DataFrame:
    """Labels through a map; labels without an entry stay."""
    if not mapping:
        return boxes
    table = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return boxes.withColumn(column, F.coalesce(F.element_at(table, F.col(column)), F.col(column)))


def contiguous_labels(n: int = 80) -> dict[int, int]:
    """Label i to category i + 1."""
    return {i: i + 1 for i in range(n)}


def full_grid(frames: DataFrame, **grid) -> DataFrame:
    """The tiles of every frame: image_id, tile_id, x, y, w, h."""
    return frames.select("image_id", "width", "height").join(F.broadcast(tiles.grid(frames, **grid)), ["width", "height"]).select("image_id", "tile_id", "x", "y", "w", "h")
