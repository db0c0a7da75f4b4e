"""Adapter views: the driver's order tables seen as videos, frames and boxes.

A customer is a video, an order a frame, a lineitem an object.  `SQL` states the same views for DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frame size and category of the views.
WIDTH, HEIGHT, TARGET = 640, 360, 14


@dataclass(frozen=True)
class Views:
    """frames: image_id, video_id, frame_idx, width, height; gt and pred: image_id, ord, category_id, x, y, w, h
    and area or score; cost: image_id, verifier_on, tiles_used, latency_ms."""

    frames: DataFrame
    gt: DataFrame
    pred: DataFrame
    cost: DataFrame


def views(spark: SparkSession, sf_dir: str) -> Views:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_tax")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    frames = orders.select(
        F.col("o_orderkey").alias("image_id"),
        F.col("o_custkey").alias("video_id"),
        (F.row_number().over(order) - 1).cast("int").alias("frame_idx"),
        F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"),
    )
    # the video is a column of orders: boxes don't need the frame number's window
    joined = items.join(orders.select("o_orderkey", "o_custkey"), items.l_orderkey == orders.o_orderkey)
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line, video, image = F.col("l_linenumber"), F.col("o_custkey"), F.col("l_orderkey")
    objects = joined.select(
        image.alias("image_id"),
        F.row_number().over(place).cast("int").alias("ord"),
        ((video * 37 + line * 97) % 560 + image % 7).cast("double").alias("x"),
        ((video * 53 + line * 61) % 290 + image % 5).cast("double").alias("y"),
        (16 + line * 6).cast("double").alias("w"),
        (14 + line * 5).cast("double").alias("h"),
        "l_returnflag",
        F.col("l_discount").cast("double").alias("_d"),
        F.col("l_tax").cast("double").alias("_t"),
        ((5 + (F.col("l_partkey") * 13 + line * 29) % 95).cast("double") / F.lit(100.0)).alias("score"),
    )
    category = F.lit(TARGET).alias("category_id")
    gt = objects.where("l_returnflag = 'A'").select("image_id", "ord", category, "x", "y", "w", "h", (F.col("w") * F.col("h")).alias("area"))
    pred = objects.where(F.col("_d") < F.lit(0.09)).select("image_id", "ord", category, (F.col("x") + F.col("_t") * F.lit(100.0)).alias("x"), (F.col("y") + F.col("_d") * F.lit(60.0)).alias("y"), "w", "h", "score")
    key, on = F.col("o_orderkey"), F.col("o_orderkey") % 4 == 0
    cost = orders.select(
        key.alias("image_id"),
        on.cast("int").alias("verifier_on"),
        F.when(on, 1 + key % 6).otherwise(F.lit(0)).cast("int").alias("tiles_used"),
        (5 + key % 11 + F.when(on, F.lit(20)).otherwise(F.lit(0))).cast("double").alias("latency_ms"),
    )
    return Views(frames, gt, pred, cost)


SQL = """
WITH vx_frames AS (
  SELECT o_orderkey AS image_id, o_custkey AS video_id,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS frame_idx,
         640 AS width, 360 AS height
  FROM orders
), vx_inst AS (
  SELECT l_orderkey AS image_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS ord,
         l_returnflag AS rf, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t,
         CAST((o_custkey * 37 + l_linenumber * 97) % 560 + l_orderkey % 7 AS DOUBLE) AS bx,
         CAST((o_custkey * 53 + l_linenumber * 61) % 290 + l_orderkey % 5 AS DOUBLE) AS by_,
         CAST(16 + l_linenumber * 6 AS DOUBLE) AS w, CAST(14 + l_linenumber * 5 AS DOUBLE) AS h,
         CAST(5 + (l_partkey * 13 + l_linenumber * 29) % 95 AS DOUBLE) / CAST(100 AS DOUBLE) AS score
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), vx_gt AS (
  SELECT image_id, ord, 14 AS category_id, bx AS x, by_ AS y, w, h, w * h AS area FROM vx_inst WHERE rf = 'A'
), vx_pred AS (
  SELECT image_id, ord, 14 AS category_id, bx + t * CAST(100 AS DOUBLE) AS x, by_ + d * CAST(60 AS DOUBLE) AS y, w, h, score
  FROM vx_inst WHERE d < CAST(0.09 AS DOUBLE)
), vx_cost AS (
  SELECT o_orderkey AS image_id, CAST(o_orderkey % 4 = 0 AS INTEGER) AS verifier_on,
         CAST(CASE WHEN o_orderkey % 4 = 0 THEN 1 + o_orderkey % 6 ELSE 0 END AS INTEGER) AS tiles_used,
         CAST(5 + o_orderkey % 11 + CASE WHEN o_orderkey % 4 = 0 THEN 20 ELSE 0 END AS DOUBLE) AS latency_ms
  FROM orders
), vx_taus AS (
  SELECT CAST(unnest([0.3, 0.5, 0.7]) AS DOUBLE) AS tau
)"""


def iou_sql(a: str, b: str) -> str:
    """IoU of two aliases' boxes for DuckDB, in the same steps as functions.box.iou()."""
    shared = (
        f"(greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), CAST(0 AS DOUBLE))"
        f" * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), CAST(0 AS DOUBLE)))"
    )
    union = f"({a}.w * {a}.h + {b}.w * {b}.h - {shared})"
    return f"(CASE WHEN {shared} > 0 AND {union} > 0 THEN {shared} / {union} ELSE CAST(0 AS DOUBLE) END)"
