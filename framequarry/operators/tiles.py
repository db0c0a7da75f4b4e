"""Tile grids and tile relations.

A grid depends on the frame size only, so it is generated once for each distinct size (a handful) and
joined to frames by equality of the size; boxes meet tiles by arithmetic on the grid's starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts(length: Column, size: int, overlap: float) -> Column:
    """Start offsets along one axis: steps of int(size * (1 - overlap)), and one flush with the far edge if these leave a rest."""
    step = max(1, int(size * (1.0 - overlap)))
    last = length - F.lit(size)
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
    rest = F.array_max(regular) < last
    return F.when(last <= 0, F.array(F.lit(0))).when(rest, F.concat(regular, F.array(last))).otherwise(regular)


def grid(sizes: DataFrame, tile_w: int = 512, tile_h: int = 512, overlap_w: float = 0.2, overlap_h: float = 0.2) -> DataFrame:
    """width, height, tile_id (row-major from 0), x, y, w, h, and the tile's row and col, for each distinct size."""
    axes = sizes.select("width", "height").distinct()
    axes = axes.withColumns({"_xs": _starts(F.col("width"), tile_w, overlap_w), "_ys": _starts(F.col("height"), tile_h, overlap_h)})
    rows = axes.select("width", "height", "_xs", F.posexplode("_ys").alias("row", "y"))
    cells = rows.select("width", "height", "row", "y", F.size("_xs").alias("_n"), F.posexplode("_xs").alias("col", "x"))
    return cells.select("width", "height", (F.col("row") * F.col("_n") + F.col("col")).alias("tile_id"), "x", "y", F.least(F.lit(tile_w), F.col("width") - F.col("x")).alias("w"), F.least(F.lit(tile_h), F.col("height") - F.col("y")).alias("h"), "row", "col")


def estimated_tiles(width: Column, height: Column, tile_w: int, tile_h: int, overlap_w: float, overlap_h: float) -> Column:
    """Number of tiles by an untruncated stride and a ceiling; differs from the grid's size for some lengths."""

    def along(length: Column, size: int, overlap: float) -> Column:
        stride = max(1.0, size * (1.0 - overlap))
        return F.when(length <= size, F.lit(1)).otherwise(F.ceil((length - size).cast("double") / F.lit(stride)).cast("int") + 1)

    return along(width, tile_w, overlap_w) * along(height, tile_h, overlap_h)


def adaptive_grid(sizes: DataFrame, overlap: float = 0.15, restrict: int = 512) -> DataFrame:
    """6 or 12 square patches (12 if the longer side exceeds restrict * (4 - 3 * overlap) + 1), the last ones flush with the edge."""
    limit = restrict * (4.0 - 3.0 * overlap) + 1.0
    wide = F.col("width") >= F.col("height")
    many = F.greatest("width", "height") > F.lit(limit)
    d = sizes.select("width", "height").distinct().withColumn("_k", F.when(many, F.lit(12)).otherwise(F.lit(6)))
    long_side, short_side = F.when(many, F.lit(4)).otherwise(F.lit(3)), F.when(many, F.lit(3)).otherwise(F.lit(2))
    d = d.withColumns({"_a": F.when(wide, long_side).otherwise(short_side), "_b": F.when(wide, short_side).otherwise(long_side)})
    need = lambda length, n: length.cast("double") / (n.cast("double") - (n - 1).cast("double") * F.lit(overlap))
    d = d.withColumn("p", F.greatest(F.ceil(F.greatest(need(F.col("width"), F.col("_a")), need(F.col("height"), F.col("_b")))).cast("int"), F.lit(1)))
    d = d.withColumn("_s", F.greatest(F.bround(F.col("p") * F.lit(1.0 - overlap)).cast("int"), F.lit(1)))
    rows = d.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("_a") - 1)))
    at = lambda i, length: F.when(F.col("p") >= length, F.lit(0)).otherwise(F.least(i * F.col("_s"), length - F.col("p")))
    return cells.select("width", "height", F.col("_k").alias("patches"), (F.col("row") * F.col("_a") + F.col("col")).alias("tile_id"), at(F.col("col"), F.col("width")).alias("x"), at(F.col("row"), F.col("height")).alias("y"), F.col("p").alias("w"), F.col("p").alias("h"), "row", "col")


def boxes_in_tiles(boxes: DataFrame, frames: DataFrame, tiles: DataFrame) -> DataFrame:
    """image_id, ord, tile_id for tiles that hold the box's centre (half-open).

    Each frame's few tiles travel as one array and are filtered in place: no join of boxes with tiles.
    """
    arrays = tiles.groupBy("width", "height").agg(F.sort_array(F.collect_list(F.struct("tile_id", "x", "y", "w", "h"))).alias("_t"))
    sized = frames.select("image_id", "width", "height").join(F.broadcast(arrays), ["width", "height"])
    cx, cy = F.col("x") + F.col("w") / F.lit(2.0), F.col("y") + F.col("h") / F.lit(2.0)
    holds = lambda t: (t["x"] <= cx) & (cx < t["x"] + t["w"]) & (t["y"] <= cy) & (cy < t["y"] + t["h"])
    return boxes.join(sized, "image_id").select("image_id", "ord", F.explode(F.filter("_t", holds)["tile_id"]).alias("tile_id"))


def neighbours(tiles: DataFrame, hops: int = 1, diagonal: bool = False, with_self: bool = False) -> DataFrame:
    """width, height, tile_id, near_id: tiles of the same grid within `hops` steps (4 or 8 directions)."""
    offsets = [(r, c) for r in range(-hops, hops + 1) for c in range(-hops, hops + 1) if (max(abs(r), abs(c)) if diagonal else abs(r) + abs(c)) <= hops and (with_self or (r, c) != (0, 0))]
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets])
    a = tiles.select("width", "height", "tile_id", "row", "col", F.explode(moves).alias("m"))
    a = a.select("width", "height", "tile_id", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col"))
    return a.join(tiles.select("width", "height", "row", "col", F.col("tile_id").alias("near_id")), ["width", "height", "row", "col"]).select("width", "height", "tile_id", "near_id")


def coverage(selected: DataFrame, needed: DataFrame) -> DataFrame:
    """By image of `needed` (image_id, tile_id): n_needed, n_hit, covered (share) and miss (any needed tile not selected)."""
    n = needed.select("image_id", "tile_id").distinct()
    s = selected.select("image_id", "tile_id").distinct().withColumn("_s", F.lit(1))
    both = n.join(s, ["image_id", "tile_id"], "left").groupBy("image_id").agg(F.count("*").alias("n_needed"), F.count("_s").alias("n_hit"))
    return both.select("image_id", "n_needed", "n_hit", (F.col("n_hit").cast("double") / F.col("n_needed")).alias("covered"), (F.col("n_hit") < F.col("n_needed")).alias("miss"))


def area_ratio(selected: DataFrame, frames: DataFrame, tiles: DataFrame) -> DataFrame:
    """image_id and the sum of selected tile areas over the frame's (overlaps count twice)."""
    sized = selected.join(frames.select("image_id", "width", "height"), "image_id").join(F.broadcast(tiles.select("width", "height", "tile_id", "w", "h")), ["width", "height", "tile_id"])
    return sized.groupBy("image_id").agg((F.sum(F.col("w") * F.col("h")) / F.first(F.col("width") * F.col("height"))).alias("area_ratio"))


def expanded(x: Column, y: Column, w: Column, h: Column, margin: float, width: Column, height: Column) -> dict[str, Column]:
    """A tile grown by a share of its size on each side, clipped to the frame."""
    mx, my = F.bround(w * F.lit(margin)).cast("int"), F.bround(h * F.lit(margin)).cast("int")
    x1, y1 = F.greatest(x - mx, F.lit(0)), F.greatest(y - my, F.lit(0))
    return {"x": x1, "y": y1, "w": F.least(x + w + mx, width) - x1, "h": F.least(y + h + my, height) - y1}
