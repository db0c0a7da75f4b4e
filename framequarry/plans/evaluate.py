"""One job from files to reports: ground truth, sequences, predictions and a cost log to KPI tables on disk."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framequarry.functions import box as B
from framequarry.operators import coco, etl, kpi, prevalence, runs, splits, tiles
from framequarry.sources import readers, writers

#: Methods whose cost follows from the frame alone: no verifier, all tiles on every frame, all tiles on key frames.
PLAIN, FULL, KEYFRAME = "plain", "full", "keyframe"


@dataclass(frozen=True)
class Settings:
    """iou, conf: of a frame's match; taus: safety thresholds; small: shares of the image that are small; slice: width, height, overlaps of a tile."""

    method: str = "logged"
    iou: float = 0.5
    conf: float = 0.25
    taus: tuple[float, ...] = prevalence.TAUS
    small: tuple[float, ...] = (0.01, 0.02)
    key_interval: int = 4
    slice: tuple[int, int, float, float] = (512, 512, 0.2, 0.2)
    #: mean tiles and latency of the run, for frames that the log leaves out
    average: tuple[float, float] = (0.0, 0.0)
    about: dict = field(default_factory=dict)


def frames_of(images: DataFrame, sequences: DataFrame | None) -> DataFrame:
    """image_id, video_id, frame_idx, width, height: by the sequence list, else by the images' own video and frame ids."""
    size = images.select("image_id", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"))
    if sequences is not None:
        return sequences.select("image_id", "video_id", "frame_idx").join(size, "image_id", "left").fillna(0, ["width", "height"])
    order = Window.partitionBy("video_id").orderBy(F.col("frame_id").asc_nulls_last(), "image_id")
    own = images.select("image_id", F.coalesce(F.col("video_id").cast("string"), F.lit("")).alias("video_id"), "frame_id")
    return own.withColumn("frame_idx", (F.row_number().over(order) - 1).cast("int")).drop("frame_id").join(size, "image_id")


def frame_costs(frames: DataFrame, log: DataFrame | None, s: Settings) -> DataFrame:
    """image_id, verifier_on, tiles_used, latency_ms of each frame."""
    sw, sh, ow, oh = s.slice
    every = tiles.estimated_tiles(F.col("width"), F.col("height"), sw, sh, ow, oh).cast("double")
    none = F.lit(0.0)
    if s.method == PLAIN:
        on, used, ms = F.lit(0), none, none
    elif s.method == FULL:
        on, used, ms = F.lit(1), every, none
    elif s.method == KEYFRAME:
        key = F.col("frame_idx") % s.key_interval == 0
        on, used, ms = key.cast("int"), F.when(key, every).otherwise(none), none
    else:
        known = log.select("image_id", F.lit(True).alias("_known"), "verifier_on", "tiles_used", "latency_ms") if log is not None else None
        rows = frames.join(known, "image_id", "left") if known is not None else frames.withColumns({"_known": F.lit(None).cast("boolean"), "verifier_on": F.lit(None).cast("int"), "tiles_used": F.lit(None).cast("double"), "latency_ms": F.lit(None).cast("double")})
        pick = lambda c, mean: F.when(F.col("_known"), F.coalesce(c, F.lit(0))).otherwise(F.lit(mean))
        return rows.select("image_id", pick("verifier_on", int(s.average[0] > 0)).cast("int").alias("verifier_on"), pick("tiles_used", float(s.average[0])).cast("double").alias("tiles_used"), pick("latency_ms", float(s.average[1])).cast("double").alias("latency_ms"))
    return frames.select("image_id", on.alias("verifier_on"), used.alias("tiles_used"), ms.alias("latency_ms"))


def cost_records(frames: DataFrame, costs: DataFrame, backend: str = "tiles") -> DataFrame:
    """The per-frame cost log's rows as the reader of cost logs takes them."""
    on = F.col("verifier_on")
    rows = frames.select("image_id", F.col("video_id").cast("string").alias("video_id"), F.col("frame_idx").alias("t")).join(costs, "image_id")
    return rows.select("video_id", "t", "image_id", on.alias("sahi_on"), "tiles_used", F.lit(backend).alias("verifier_backend"), on.alias("verifier_executed"), F.col("tiles_used").cast("int").alias("num_verifier_regions"), F.col("tiles_used").alias("verifier_cost_proxy"), "latency_ms")


def run_stats(records: DataFrame) -> DataFrame:
    """One row: frames, elapsed seconds (by the latencies), fps, verifier frames and tiles, latency percentiles."""
    ms, on = F.col("latency_ms"), F.col("sahi_on") == 1
    t = records.agg(F.count("*").alias("num_frames"), (F.sum(ms) / 1000).alias("elapsed_s"), F.count_if(on).alias("verifier_frames"), F.sum("tiles_used").alias("total_tiles"), F.avg("tiles_used").alias("avg_tiles"), F.avg(ms).alias("mean_ms"), *[F.percentile(ms, q).alias(f"p{int(q * 100)}_ms") for q in (0.5, 0.9, 0.95)])
    return t.withColumn("fps", F.when(F.col("elapsed_s") > 0, F.col("num_frames") / F.col("elapsed_s")))


def clamped(pred: DataFrame, frames: DataFrame) -> DataFrame:
    """Predictions of known images, moved into them; oob: whether that changed them."""
    rows = pred.join(frames.select("image_id", "width", "height"), "image_id")
    b, moved = B.shift_clamp(B.box(), F.col("width").cast("double"), F.col("height").cast("double"))
    known = (F.col("width") > 0) & (F.col("height") > 0)
    return rows.select("image_id", "ord", "category_id", *[F.when(known, getattr(b, c)).otherwise(F.col(c)).alias(c) for c in "xywh"], "score", (known & moved).alias("oob"))


def _spread(rows: DataFrame, column: str) -> dict:
    """mean, p50, p90 of a column (null without rows)."""
    return rows.agg(F.avg(column).alias("mean"), F.percentile(column, 0.5).alias("p50"), F.percentile(column, 0.9).alias("p90")).first().asDict()


def _quality(gt: DataFrame, pred: DataFrame) -> dict:
    r = coco.summary(gt, pred).first()
    if pred.isEmpty():
        return {"mAP": 0.0, "AP50": 0.0, "AP75": 0.0, "Recall": 0.0}
    return {"mAP": r.ap, "AP50": r.ap50, "AP75": r.ap75, "Recall": r.ar_100}


def evaluate(spark: SparkSession, gt_path: str, pred_path: str, out: str, seq_path: str | None = None, cost_path: str | None = None, target: int | None = None, target_name: str | None = None, settings: Settings = Settings()) -> dict:
    """Write per_video.csv, per_frame.jsonl.gz, summary.json and summary.md below `out`; returns the summary.

    Defined cases: frames without ground truth are empty frames; predictions of unknown images or other categories don't
    count; a missing cost log gives the run's averages; without predictions all quality figures are 0.
    """
    s = settings
    images, notes, categories = readers.coco(spark, gt_path)
    target = etl.target_category(categories, target, target_name)
    images = images.dropDuplicates(["image_id"])
    frames = frames_of(images, readers.sequences(spark, seq_path) if seq_path else None)
    gt = notes.where(F.col("category_id") == target).select("image_id", "ord", "category_id", *"xywh", "area", "iscrowd")
    pred = readers.predictions(spark, pred_path).where(F.col("category_id") == target).select("image_id", "ord", "category_id", *"xywh", "score")
    log = readers.cost_log(spark, cost_path)
    costs = frame_costs(frames, log, s)
    facts = kpi.frame_facts(frames, gt, pred, costs, s.iou, s.conf, s.small, s.taus)
    per_video = kpi.per_video(facts)
    writers.report_csv(per_video, f"{out}/per_video.csv", ["video_id", "num_frames", "num_pos_frames"], "overwrite")
    writers.jsonl_gz(cost_records(frames, costs), f"{out}/per_frame.jsonl.gz", "overwrite")

    inside = clamped(pred, frames)
    total = kpi.summary(facts).first().asDict()
    segments = runs.segment_delay_miss(facts, F.col("is_pos"))
    checked = inside.agg(F.count("*").alias("n"), F.count_if("oob").alias("oob")).first()
    mask = prevalence.empty_mask(frames, gt)
    safety = prevalence.effr_efpd(prevalence.high_conf_labels(prevalence.prevalence_input(mask, pred, costs, s.taus), s.taus))
    cost = {c: _spread(facts, c) for c in ("tiles_used", "latency_ms")}
    small = {}
    for tau in s.small:
        own = splits.small_subset(frames, gt, tau)
        only = inside.join(own.select("image_id").distinct(), "image_id", "left_semi")
        small[str(tau)] = {"mAP": 0.0, "AP50": 0.0, "AP75": 0.0, "Recall": 0.0} if own.isEmpty() else _quality(own, only)
        flag = F.col(f"has_small_{s.small.index(tau)}") == 1
        parts = runs.segment_delay_miss(facts, flag)
        small[str(tau)] |= {"delay": _spread(parts, "delay"), "miss_streak": _spread(parts, "miss_streak")}
    summary = {
        "run_meta": {"method": s.method, "target_category_id": target, "conf": s.conf, "iou": s.iou, **s.about},
        "quality": _quality(gt, inside) | {"delay": _spread(segments, "delay"), "miss_streak": _spread(segments, "miss_streak"), "empty_fp_rate": total["empty_fp_rate"], "num_tp_frames": total["tp_frames"], "num_fp_frames": total["fp_frames"], "num_fn_frames": total["fn_frames"], "bbox_oob_rate": checked.oob / checked.n if checked.n else 0.0},
        "safety": {str(r.tau): {"EFFR": r.effr, "EFPD": r.efpd} for r in safety.collect()},
        "cost": cost | {k: total[k] for k in ("verifier_on_ratio", "avg_tiles", "avg_tiles_on", "avg_latency_ms", "fps", "verifier_on_frames", "total_tiles", "num_pred_boxes")},
        "small_tau": small,
    }
    text = spark.createDataFrame([(json.dumps(summary, default=str),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{out}/summary.json")
    q, c = summary["quality"], summary["cost"]
    line = [(s.method, *(None if v is None else float(v) for v in (q["mAP"], q["AP50"], q["Recall"], q["delay"]["mean"], q["miss_streak"]["mean"], q["empty_fp_rate"], c["verifier_on_ratio"], c["avg_tiles"], c["avg_latency_ms"], c["fps"])))]
    table = spark.createDataFrame(line, "method string, mAP double, AP50 double, Recall double, delay double, miss double, empty_fp_rate double, verifier_on double, tiles double, latency_ms double, fps double")
    spark.createDataFrame([(writers.markdown(table),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary.md")
    return summary


def convert_voc(spark: SparkSession, folder: str, out: str, names: dict[str, int], suffix: str = ".jpg") -> tuple[DataFrame, DataFrame]:
    """A tree of annotation files <video>/<frame>.xml to one COCO document and a sequence list below `out`.

    Images are numbered by (video, frame file), also those without objects; objects of other names are dropped.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(folder)
    path = F.split(F.regexp_replace("path", r"\.xml$", ""), "/")
    files = listing.select("path", F.element_at(path, -2).alias("video_id"), F.element_at(path, -1).alias("_frame"), F.col("content").cast("string").alias("_text"))
    number = lambda tag: F.regexp_extract("_text", rf"<{tag}>\s*([0-9]+)\s*</{tag}>", 1)
    size = lambda tag: F.nullif(number(tag), F.lit("")).cast("int")
    images = files.select("path", "video_id", F.concat_ws("/", "video_id", F.concat("_frame", F.lit(suffix))).alias("file_name"), size("width").alias("width"), size("height").alias("height"))
    images = splits.numbered(images, "file_name", "image_id")
    order = Window.partitionBy("video_id").orderBy("file_name")
    images = images.withColumn("frame_idx", (F.row_number().over(order) - 1).cast("int")).withColumn("frame_id", F.col("frame_idx").cast("long"))
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    kinds = F.create_map(*[x for n, i in names.items() for x in (F.lit(n), F.lit(i))])
    found = readers.voc_xml(spark, f"{folder}/*/*.xml").withColumn("category_id", F.element_at(kinds, F.col("name"))).where("category_id is not null")
    found = found.drop("width", "height").join(images.select(plain("path").alias("_p"), "image_id", "video_id"), plain("file") == F.col("_p"))
    place = F.concat_ws("/", F.lpad(F.col("image_id").cast("string"), 18, "0"), F.lpad(F.col("ord").cast("string"), 6, "0"))
    notes = splits.numbered(found.withColumn("_place", place), "_place", "ann_id")
    notes = notes.select("ann_id", "image_id", "category_id", *"xywh", (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"), "difficult", "track_id")
    categories = spark.createDataFrame([(i, n) for n, i in names.items()], "id int, name string")
    writers.coco_document(images.select("image_id", "file_name", "width", "height", "video_id", "frame_id"), notes, categories, f"{out}/annotations.json", "overwrite")
    writers.sequence_list(images, f"{out}/sequences.json", "overwrite")
    return images.drop("path"), notes
