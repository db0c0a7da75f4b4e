"""Average precision and recall by the COCO protocol.

Matching works on one image's boxes in Arrow batches: all overlap thresholds and area ranges at once.
Curves need one order of all detections of a category.  It is kept without sorting them in one task:
detections are dealt by category and score bucket; counts by bucket, summed from the best bucket on,
say how many stand before each bucket, and every bucket gives the best precision at each recall point,
of which the largest counts.  The shuffle by bucket is used twice, so matching runs once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The protocol's overlap thresholds, recall points, area ranges and numbers of detections.
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
RECALL_POINTS = 101
AREAS = (("all", 0.0, 1e10), ("small", 0.0, 32.0**2), ("medium", 32.0**2, 96.0**2), ("large", 96.0**2, 1e10))
MAX_DETS = (1, 10, 100)
#: Score buckets of a category: scores from 0 to 1 fall into so many of equal width; others count as well.
BUCKETS = 1024


class Curve(NamedTuple):
    """One curve of each category: area range, number of detections, threshold."""

    area: int
    dets: int
    threshold: int


def curves(areas, max_dets, thresholds) -> list[Curve]:
    """Every range with the largest number of detections, the first range with the others."""
    pairs = [(0, d) for d in range(len(max_dets) - 1)] + [(a, len(max_dets) - 1) for a in range(len(areas))]
    return [Curve(a, d, t) for a, d in pairs for t in range(len(thresholds))]


def image_matches(found: list[tuple], boxes: list[tuple], limits: list[float], areas) -> list[tuple[int, int]]:
    """For each detection, the best first, two bit masks over (area, threshold): whether it has a box, and whether it is ignored.

    found: x, y, w, h; boxes in their order: x, y, w, h, area, crowd.  A detection takes the free box with the largest
    overlap of at least the threshold (later boxes win ties), ignored boxes (crowds and those out of range) last.  A crowd
    is never used up, and overlaps with it count as shares of the detection.  A detection without a box that lies out of
    range is ignored.
    """
    near: list[list[tuple[float, int]]] = []
    for x, y, w, h in found:
        own = []
        for j, (a, b, c, d, _, crowd) in enumerate(boxes):
            shared = max(0.0, min(x + w, a + c) - max(x, a)) * max(0.0, min(y + h, b + d) - max(y, b))
            if shared > 0:
                v = shared / (w * h if crowd else w * h + c * d - shared)
                if v >= limits[0]:
                    own.append((v, j))
        near.append(own)
    out = []
    taken: dict[tuple[int, int], set[int]] = {}
    n = len(limits)
    every = (1 << n) - 1
    wanted = Counter(j for own in near for _, j in own)
    for (_, _, w, h), own in zip(found, near):
        hit = gone = 0
        alone = not own or (len(own) == 1 and (wanted[own[0][1]] == 1 or boxes[own[0][1]][5]))
        for k, (_, low, high) in enumerate(areas):
            far = not low <= w * h <= high
            if alone:  # no other detection wants its box: it takes it at all thresholds up to the overlap
                got = (1 << bisect_right(limits, own[0][0])) - 1 if own else 0
                ignored = own and (boxes[own[0][1]][5] or not low <= boxes[own[0][1]][4] <= high)
                hit |= got << (k * n)
                gone |= (got * bool(ignored) | (every ^ got) * far) << (k * n)
                continue
            ranked = sorted(((not (boxes[j][5] or not low <= boxes[j][4] <= high), v, j) for v, j in own), reverse=True)
            for t, limit in enumerate(limits):
                bit = 1 << (k * n + t)
                used = taken.setdefault((k, t), set())
                match = next((m for m in ranked if m[1] >= limit and m[2] not in used), None)
                if match is None:
                    gone |= bit * far
                else:
                    hit |= bit
                    gone |= bit * (not match[0])
                    if not boxes[match[2]][5]:
                        used.add(match[2])
        out.append((hit, gone))
    return out


def detections(gt: DataFrame, pred: DataFrame, thresholds=THRESHOLDS, max_dets: int = MAX_DETS[-1], areas=AREAS) -> DataFrame:
    """category_id, image_id, ord, score, rank (in its image and category) and the bit masks hit and ignored of the best max_dets.

    gt: image_id, category_id, ord, x, y, w, h, area, and iscrowd if there are crowds.
    """
    if len(thresholds) * len(areas) > 62:
        raise ValueError("more thresholds and areas than a bit mask holds")
    keys = ["image_id", "category_id"]
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "ord")
    best = pred.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_dets)
    dets = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", "ord", "score", *"xywh"))).alias("_d"))
    crowd = F.coalesce(F.col("iscrowd"), F.lit(0)).cast("int") if "iscrowd" in gt.columns else F.lit(0)
    boxes = gt.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", *"xywh", "area", crowd.alias("crowd")))).alias("_g"))
    both = dets.join(boxes, keys, "left")
    limits = [min(t, 1 - 1e-10) for t in thresholds]

    def columns(items: pa.ListArray, names: list[str]) -> tuple[np.ndarray, list[list]]:
        flat = items.flatten()
        return items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), [flat.field(n).to_pylist() for n in names]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_found, (rank, ord_, score, *place) = columns(batch.column("_d"), ["_r", "ord", "score", *"xywh"])
            n_boxes, given = columns(batch.column("_g"), [*"xywh", "area", "crowd"])
            place, given = list(zip(*place)), list(zip(*given))
            hit, ignored, at, box = [], [], 0, 0
            for n, m in zip(n_found.tolist(), n_boxes.tolist()):
                for a, b in image_matches(place[at : at + n], given[box : box + m], limits, areas):
                    hit.append(a)
                    ignored.append(b)
                at, box = at + n, box + m
            image, category = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n_found) for c in ("image_id", "category_id"))
            cols = [pa.array(category, pa.int32()), pa.array(image, pa.int64()), pa.array(ord_, pa.int32()), pa.array(score, pa.float64()), pa.array(rank, pa.int32()), pa.array(hit, pa.int64()), pa.array(ignored, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["category_id", "image_id", "ord", "score", "rank", "hit", "ignored"]
    rows = both.select(F.col("image_id").cast("long").alias("image_id"), F.col("category_id").cast("int").alias("category_id"), "_d", "_g")
    return rows.mapInArrow(step, "category_id int, image_id long, ord int, score double, rank int, hit long, ignored long")


def average_precision(gt: DataFrame, dets: DataFrame, thresholds=THRESHOLDS, max_dets=MAX_DETS, areas=AREAS) -> DataFrame:
    """category_id, area, max_dets, thr, n_gt, ap (101 recall points), recall, for curves with boxes that count."""
    spark, n_thr = dets.sparkSession, len(thresholds)
    lines = curves(areas, max_dets, thresholds)
    bits = np.array([c.area * n_thr + c.threshold for c in lines])
    most = np.array([max_dets[c.dets] for c in lines])
    counts = F.col("iscrowd").isNull() | (F.col("iscrowd") == 0) if "iscrowd" in gt.columns else F.lit(True)
    n = gt.where(counts).groupBy("category_id").agg(*[F.count_if((F.col("area") >= F.lit(low)) & (F.col("area") <= F.lit(high))).alias(f"_{k}") for k, (_, low, high) in enumerate(areas)])
    n = n.select(F.col("category_id").cast("int").alias("category_id"), F.array(*[f"_{k}" for k in range(len(areas))]).alias("_n"))
    dealt = dets.withColumn("bucket", F.floor(F.col("score") * BUCKETS).cast("long"))

    def marks(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """By row and curve: 1 where it hits, and where it counts."""
        hit, gone = ((rows[c].to_numpy()[:, None] >> bits) & 1 for c in ("hit", "ignored"))
        counts = (1 - gone) * (rows["rank"].to_numpy()[:, None] <= most)
        return hit * counts, counts

    def totals(rows: pd.DataFrame) -> pd.DataFrame:
        hits, counts = marks(rows)
        return pd.DataFrame({"category_id": [rows["category_id"].iloc[0]], "bucket": [rows["bucket"].iloc[0]], "hits": [hits.sum(axis=0)], "counts": [counts.sum(axis=0)]})

    def before(rows: pd.DataFrame) -> pd.DataFrame:
        """Of one category: what stands before each bucket; one row for each of its buckets."""
        rows = rows.sort_values("bucket", ascending=False)
        out = rows[["category_id", "bucket", "_n"]].copy()
        for c in ("hits", "counts"):
            sums = np.cumsum(np.stack(rows[c].to_list()), axis=0)
            out[c] = list(np.concatenate([np.zeros_like(sums[:1]), sums[:-1]]))
        return out

    def best(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        """By curve: the largest precision at each recall point that a hit of this bucket reaches (0: none), and the hits up to its end."""
        if not len(rows) or not len(start):
            return pd.DataFrame({"category_id": [], "curve": [], "points": [], "hits": []})
        rows = rows.sort_values(["score", "image_id", "ord"], ascending=[False, True, True], kind="stable")
        hits, counts = marks(rows)
        n_gt = np.asarray(start["_n"].iloc[0], dtype=float)
        tp = np.asarray(start["hits"].iloc[0]) + np.cumsum(hits, axis=0)
        seen = np.asarray(start["counts"].iloc[0]) + np.cumsum(counts, axis=0)
        points = []
        reach = np.linspace(0.0, 1.0, RECALL_POINTS)
        for k, c in enumerate(lines):
            at = np.flatnonzero(hits[:, k])
            row = np.zeros(RECALL_POINTS)
            if len(at) and n_gt[c.area]:
                recall, precision = tp[at, k] / n_gt[c.area], tp[at, k] / seen[at, k]
                envelope = np.maximum.accumulate(precision[::-1])[::-1]
                first = np.searchsorted(recall, reach, side="left")
                row = np.where(first < len(at), envelope[np.minimum(first, len(at) - 1)], 0.0)
            points.append(row)
        return pd.DataFrame({"category_id": rows["category_id"].iloc[0], "curve": np.arange(len(lines)), "points": points, "hits": tp[-1]})

    keys = ["category_id", "bucket"]
    arrays = "category_id int, bucket long, hits array<long>, counts array<long>"
    sums = dealt.groupBy(*keys).applyInPandas(totals, arrays).join(F.broadcast(n), "category_id")
    starts = sums.groupBy("category_id").applyInPandas(before, "category_id int, bucket long, _n array<long>, hits array<long>, counts array<long>")
    parts = dealt.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(best, "category_id int, curve int, points array<double>, hits long")
    zero = F.array_repeat(F.lit(0.0), RECALL_POINTS)
    # RECALL_POINTS numbers for each curve and bucket: the largest of each point
    longest = F.aggregate(F.collect_list("points"), zero, lambda a, p: F.zip_with(a, p, lambda x, y: F.greatest(x, y)))
    per = parts.groupBy("category_id", "curve").agg((F.aggregate(longest, F.lit(0.0), lambda a, x: a + x) / F.lit(float(RECALL_POINTS))).alias("ap"), F.max("hits").alias("hits"))
    named = [(i, areas[c.area][0], c.area, max_dets[c.dets], float(thresholds[c.threshold])) for i, c in enumerate(lines)]
    named = spark.createDataFrame(named, "curve int, area string, _a int, max_dets int, thr double")
    out = n.join(F.broadcast(named)).withColumn("n_gt", F.get("_n", F.col("_a"))).where("n_gt > 0").join(per, ["category_id", "curve"], "left")
    return out.select("category_id", "area", "max_dets", "thr", "n_gt", F.coalesce("ap", F.lit(0.0)).alias("ap"), (F.coalesce("hits", F.lit(0)) / F.col("n_gt").cast("double")).alias("recall"))


def by_category(gt: DataFrame, pred: DataFrame, max_dets=MAX_DETS, areas=AREAS) -> DataFrame:
    """average_precision() of predictions."""
    return average_precision(gt, detections(gt, pred, max_dets=max_dets[-1], areas=areas), max_dets=max_dets, areas=areas)


def summary(gt: DataFrame, pred: DataFrame, max_dets=MAX_DETS, areas=AREAS) -> DataFrame:
    """One row: ap, ap50, ap75, ap_<area> of the other ranges, ar_<number> of the first range, ar_<area>; -1 where no box counts."""
    t, most = by_category(gt, pred, max_dets, areas), max_dets[-1]
    first = areas[0][0]
    at = lambda area, dets: (F.col("area") == area) & (F.col("max_dets") == dets)
    mean = lambda cond, c: F.coalesce(F.avg(F.when(cond, F.col(c))), F.lit(-1.0))
    cols = [mean(at(first, most), "ap").alias("ap")]
    cols += [mean(at(first, most) & (F.col("thr") == thr), "ap").alias(name) for name, thr in (("ap50", 0.5), ("ap75", 0.75))]
    cols += [mean(at(name, most), "ap").alias(f"ap_{name}") for name, _, _ in areas[1:]]
    cols += [mean(at(first, d), "recall").alias(f"ar_{d}") for d in max_dets]
    cols += [mean(at(name, most), "recall").alias(f"ar_{name}") for name, _, _ in areas[1:]]
    return t.agg(*cols)


def split_at(max_area: float) -> tuple:
    """Ranges of the small-object protocol: all, up to max_area, from it on."""
    return (("all", 0.0, 1e12), ("small", 0.0, max_area), ("large", max_area, 1e12))
