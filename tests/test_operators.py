"""Operators against hand cases and independent brute-force versions over random small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions import box as B
from framequarry.operators import coco, kpi, matching, need, runs, splits, state, tiles, tracks

BOX = "image_id long, ord int, category_id int, x double, y double, w double, h double, score double, area double"


def iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    s = max(w, 0) * max(h, 0)
    u = a[2] * a[3] + b[2] * b[3] - s
    return s / u if s > 0 and u > 0 else 0.0


def random_boxes(rng, n_images, most):
    rows = []
    for i in range(n_images):
        for o in range(rng.randint(0, most)):
            x, y, w, h = rng.randint(0, 30), rng.randint(0, 30), rng.randint(5, 20), rng.randint(5, 20)
            rows.append((i, o, 1, float(x), float(y), float(w), float(h), rng.randint(0, 10) / 10, float(w * h)))
    return rows


def test_clamps(spark):
    df = spark.createDataFrame([(-5.0, 0.0, 20.0, 10.0), (95.0, 95.0, 20.0, 3.0), (120.0, 5.0, 4.0, 4.0)], "x double, y double, w double, h double")
    cut = B.clip_corners(B.box(), F.lit(100.0), F.lit(100.0))
    moved, oob = B.shift_clamp(B.box(), F.lit(100.0), F.lit(100.0))
    got = df.select(cut.x, cut.y, cut.w, cut.h, moved.x, moved.y, moved.w, moved.h, oob).collect()
    assert tuple(got[0]) == (0.0, 0.0, 15.0, 10.0, 0.0, 0.0, 20.0, 10.0, True)
    assert tuple(got[1]) == (95.0, 95.0, 5.0, 3.0, 95.0, 95.0, 5.0, 3.0, True)
    assert tuple(got[2])[4:] == (100.0, 5.0, 0.0, 4.0, True)


def test_nms_cases(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 10.0, 10.0, 0.9, 100.0), (1, 1, 1, 1.0, 1.0, 10.0, 10.0, 0.8, 100.0), (1, 2, 1, 50.0, 50.0, 5.0, 5.0, 0.7, 25.0), (1, 3, 1, 0.5, 0.0, 10.0, 10.0, 0.95, 100.0)]
    kept = matching.suppress(spark.createDataFrame(rows, BOX), 0.5, ["image_id"])
    assert [r.score for r in kept.orderBy("rank").collect()] == [0.95, 0.7]


@pytest.mark.parametrize("seed", range(3))
def test_nms_brute(spark, seed):
    rows = random_boxes(random.Random(seed), 25, 8)
    got = {(r.image_id, r.ord) for r in matching.suppress(spark.createDataFrame(rows, BOX), 0.35, ["image_id"]).collect()}
    want = set()
    for i in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[7], r[1])):
            if all(iou(r[3:7], k[3:7]) <= 0.35 for k in kept):
                kept.append(r)
        want |= {(r[0], r[1]) for r in kept}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_frame_match_brute(spark, seed):
    rng = random.Random(seed)
    gt, pred = random_boxes(rng, 30, 4), random_boxes(rng, 30, 6)
    frames = spark.range(30).withColumnRenamed("id", "image_id")
    got = {r.image_id: (r.tp, r.fp, r.fn) for r in matching.frame_match(frames, spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX), 0.3, 0.25).collect()}
    for i in range(30):
        g = [r for r in gt if r[0] == i]
        used, fp = set(), 0
        for p in sorted((r for r in pred if r[0] == i and r[7] >= 0.25), key=lambda r: (-r[7], r[1])):
            best, at = 0.0, None
            for j, b in enumerate(g):
                v = iou(b[3:7], p[3:7])
                if j not in used and v > best:
                    best, at = v, j
            if at is not None and best >= 0.3:
                used.add(at)
            else:
                fp += 1
        assert got[i] == (int(bool(used)), fp, int(bool(g) and not used)), i


def test_frame_match_cases(spark):
    box = lambda i, o, s: (i, o, 1, 0.0, 0.0, 10.0, 10.0, s, 100.0)
    gt = spark.createDataFrame([box(1, 0, 0.0), box(2, 0, 0.0)], BOX)
    pred = spark.createDataFrame([box(1, 0, 0.9), box(1, 1, 0.8), box(3, 0, 0.9), box(3, 1, 0.9)], BOX)
    frames = spark.createDataFrame([(1,), (2,), (3,), (4,)], "image_id long")
    got = {r.image_id: (r.tp, r.fp, r.fn) for r in matching.frame_match(frames, gt, pred, 0.5, 0.25).collect()}
    assert got == {1: (1, 1, 0), 2: (0, 0, 1), 3: (0, 2, 0), 4: (0, 0, 0)}


def flags(spark, text):
    return spark.createDataFrame([(1, i, c == "1") for i, c in enumerate(text)], "video_id int, frame_idx int, hit boolean")


def test_runs(spark):
    df = flags(spark, "0110111")
    assert [(r.s, r.e) for r in runs.segments(df, F.col("hit")).orderBy("s").collect()] == [(1, 2), (4, 6)]
    first = runs.first_run_start(flags(spark, "10111"), F.col("hit"), ["video_id"], "frame_idx", 2).first()
    assert first.start == 2
    assert runs.sustained_lock(df, F.col("hit"), ["video_id"], "frame_idx", 0).first().locked
    assert not runs.sustained_lock(df, F.col("hit"), ["video_id"], "frame_idx", 4).first().locked
    never = flags(spark, "111").selectExpr("*", "0 as tp", "1 as fn")
    r = runs.segment_delay_miss(never, F.col("hit")).first()
    assert (r.delay, r.miss_streak) == (3, 3)
    buckets = spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 6)], "n int").select(runs.streak_bucket(F.col("n")).alias("b"))
    assert [r.b for r in buckets.collect()] == ["0_1", "0_1", "2_5", "2_5", "6p"]


def test_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8, 9)], "v double")
    r = df.agg(F.percentile("v", 0.9).alias("p"), kpi.truncated_percentile(F.col("v"), 0.9).alias("t")).first()
    assert (round(r.p, 9), r.t) == (8.6, 8.0)


def test_tile_grid(spark):
    sizes = spark.createDataFrame([(1920, 1080), (2150, 512)], "width int, height int")
    g = tiles.grid(sizes)
    big = g.where("width = 1920").orderBy("tile_id").collect()
    assert [r.x for r in big[:5]] == [0, 409, 818, 1227, 1408] and sorted({r.y for r in big}) == [0, 409, 568] and len(big) == 15
    assert g.where("width = 2150").count() == 6
    est = sizes.where("width = 2150").select(tiles.estimated_tiles(F.col("width"), F.col("height"), 512, 512, 0.2, 0.2).alias("n")).first()
    assert est.n == 5


def naive_tracks(frames, thr):
    """frames: lists of boxes; returns for each frame the ids of its boxes."""
    out, active, born = [], {}, 0
    for boxes in frames:
        ids, nxt = [None] * len(boxes), {}
        if boxes:
            for t, last in active.items():
                best = max(((iou(last, b), -j) for j, b in enumerate(boxes) if ids[j] is None), default=None)
                if best and best[0] >= thr:
                    ids[-best[1]] = t
                    nxt[t] = boxes[-best[1]]
            for j, b in enumerate(boxes):
                if ids[j] is None:
                    born += 1
                    ids[j], nxt[born] = born, b
        active = nxt
        out.append(ids)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pseudo_tracks(spark, seed):
    rows = random_boxes(random.Random(seed), 40, 4)
    frames = spark.createDataFrame([(i, i // 20, i % 20) for i in range(40)], "image_id long, video_id int, frame_idx int")
    got = {(r.image_id, r.ord): r.local_id for r in tracks.pseudo_tracks(frames, spark.createDataFrame(rows, BOX), 0.2).collect()}
    for v in range(2):
        per = [[r[3:7] for r in rows if r[0] == v * 20 + f] for f in range(20)]
        for f, ids in enumerate(naive_tracks(per, 0.2)):
            for o, t in enumerate(ids):
                assert got[(v * 20 + f, o)] == t


def naive_ap(gt, pred, thr):
    """Interpolated at 101 points, one category."""
    found, n = [], len(gt)
    for i in {r[0] for r in pred}:
        free = [r for r in gt if r[0] == i]
        for p in sorted((r for r in pred if r[0] == i), key=lambda r: (-r[7], r[1])):
            best = max(((iou(g[3:7], p[3:7]), k) for k, g in enumerate(free)), default=(0, 0))
            hit = best[0] >= thr
            if hit:
                free.pop(best[1])
            found.append((-p[7], i, p[1], hit))
    found.sort()
    tp, curve = 0, []
    for k, f in enumerate(found):
        tp += f[3]
        curve.append((tp / n, tp / (k + 1)))
    total = 0.0
    for r in range(101):
        total += max((p for rec, p in curve if rec >= r / 100), default=0.0)
    return total / 101, tp / n


@pytest.mark.parametrize("seed", range(3))
def test_average_precision(spark, seed):
    rng = random.Random(seed)
    gt, pred = random_boxes(rng, 25, 3), random_boxes(rng, 25, 5)
    d = coco.detections(spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX), thresholds=(0.3, 0.5))
    rows = coco.average_precision(spark.createDataFrame(gt, BOX), d, (0.3, 0.5)).where("area = 'all' and max_dets = 100").collect()
    assert {r.thr for r in rows} == {0.3, 0.5}
    for r in rows:
        ap, recall = naive_ap(gt, pred, r.thr)
        assert r.ap == pytest.approx(ap) and r.recall == pytest.approx(recall)


def naive_protocol(gt, pred, thr, low, high, most):
    """The protocol step by step for one category. gt: image, ord, box, area, crowd; pred: image, ord, box, score."""
    found, n = [], sum(1 for g in gt if not g[4] and low <= g[3] <= high)
    for i in {p[0] for p in pred}:
        boxes = sorted((g for g in gt if g[0] == i), key=lambda g: g[1])
        skip = [bool(g[4]) or not low <= g[3] <= high for g in boxes]
        used = set()
        for p in sorted((p for p in pred if p[0] == i), key=lambda p: (-p[3], p[1]))[:most]:
            match = None
            for pass_skipped in (False, True):
                best = min(thr, 1 - 1e-10)
                for k, g in enumerate(boxes):
                    if skip[k] != pass_skipped or (k in used and not g[4]):
                        continue
                    (x, y, w, h), (a, b, c, d) = p[2], g[2]
                    shared = max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))
                    v = shared / (w * h if g[4] else w * h + c * d - shared)
                    if v >= best:
                        best, match = v, k
                if match is not None:
                    break
            if match is not None:
                used.add(match)
            ignored = skip[match] if match is not None else not low <= p[2][2] * p[2][3] <= high
            if not ignored:
                found.append((-p[3], i, p[1], match is not None))
    found.sort()
    tp, curve = 0, []
    for k, f in enumerate(found):
        tp += f[3]
        curve.append((tp / n if n else 0, tp / (k + 1)))
    points = [max((p for rec, p in curve if rec >= r), default=0.0) for r in np.linspace(0.0, 1.0, 101)]
    return n, sum(points) / 101, tp / n if n else 0


@pytest.mark.parametrize("seed", range(2))
def test_full_protocol(spark, seed):
    """Crowds, area ranges, numbers of detections, ties in scores, an image without boxes and one without detections."""
    rng = random.Random(seed)
    box = lambda: (float(rng.randrange(0, 60)), float(rng.randrange(0, 60)), float(rng.choice([8, 20, 40, 90])), float(rng.choice([8, 20, 40, 90])))
    gt, pred = [], []
    for i in range(24):
        for k in range(rng.randrange(0, 6) if i != 3 else 0):
            b = box()
            gt.append((i, k, b, b[2] * b[3] * rng.choice([1, 0.7]), int(rng.random() < 0.2)))
        for k in range(rng.randrange(0, 16) if i != 4 else 0):
            near = rng.choice([g[2] for g in gt if g[0] == i] or [box()])
            b = near if rng.random() < 0.2 else (near[0] + rng.randrange(-4, 5), near[1] + rng.randrange(-4, 5), near[2], near[3]) if rng.random() < 0.7 else box()
            pred.append((i, k, b, rng.choice([0.1, 0.5, 0.5, 0.9, 1.0]) if rng.random() < 0.5 else round(rng.random(), 3)))
    g = spark.createDataFrame([(i, k, 7, *b, area, crowd) for i, k, b, area, crowd in gt], "image_id long, ord int, category_id int, x double, y double, w double, h double, area double, iscrowd int")
    p = spark.createDataFrame([(i, k, 7, *b, s) for i, k, b, s in pred], "image_id long, ord int, category_id int, x double, y double, w double, h double, score double")
    areas, dets = (("all", 0.0, 1e10), ("small", 0.0, 400.0), ("large", 400.0, 1e10)), (1, 3, 10)
    old, coco.BUCKETS = coco.BUCKETS, 8
    try:
        rows = coco.by_category(g, p, dets, areas).collect()
        total = coco.summary(g, p, dets, areas).first()
    finally:
        coco.BUCKETS = old
    assert len(rows) == 5 * 10
    limits = {a: (low, high) for a, low, high in areas}
    for r in rows:
        n, ap, recall = naive_protocol(gt, pred, r.thr, *limits[r.area], r.max_dets)
        assert (r.category_id, r.n_gt) == (7, n) and r.ap == pytest.approx(ap) and r.recall == pytest.approx(recall), (r.area, r.max_dets, r.thr)
    mean = lambda area, most, c: np.mean([r[c] for r in rows if (r.area, r.max_dets) == (area, most)])
    assert total.ap == pytest.approx(mean("all", 10, "ap")) and total.ar_3 == pytest.approx(mean("all", 3, "recall")) and total.ap_small == pytest.approx(mean("small", 10, "ap"))
    assert coco.summary(g, p.limit(0)).first().ap == 0.0 and coco.summary(g.limit(0), p).first().ap == -1.0


def test_budget_reasons():
    quiet = {"has_det": False, "num_active": 0, "max_miss_streak": 0, "recent_lost": False, "motion_z": 0.0, "motion_peak": 0.0, "diff_gap": 0.0, "diff_std": 0.0, "has_target": False, "num_unconfirmed": 0, "num_confirmed": 0}
    rows = [{**quiet, "no_det_streak": k} for k in range(1, 6)]
    out = list(state.policy(7).run(rows))
    assert [o["reason"] for o in out] == ["seed_empty_skip", "seed_empty_skip", "seed_empty_explore", "seed_empty_explore", "empty_budget_skip"]


def test_confirmation():
    row = {"frame_idx": 0, "boxes": [{"x": 0, "y": 0, "w": 10, "h": 10, "category_id": 1}]}
    out = list(state.confirmation_gate().run([row, row]))
    assert [o["num_confirmed"] for o in out] == [0, 1]
    times = list(state.confirmation_times().run([row, {**row, "frame_idx": 1}]))
    assert [o["ttc_list"] for o in times] == [[], [2]]


def test_controllers():
    base = {"risk": 0.0, "tracking_fail": False, "escape_hard": False, "escape_soft": False, "strong_skip": False, "escape_soft_streak": 0, "subset_ok": False}
    rows = [{**base, "frame_idx": t} for t in range(12)]
    assert [o["mode"] for o in state.heartbeat_controller().run(rows)] == ["full"] + ["skip"] * 9 + ["full", "skip"]
    rows = [{**base, "frame_idx": t, "escape_soft_streak": t} for t in range(8)]
    modes = [o["mode"] for o in state.subset_first_controller().run(rows)]
    assert modes == ["skip", "skip", "subset", "subset", "full", "full", "full", "subset"]


def test_fold_any_partitioning(spark):
    rows = [(v, t, float((v * 7 + t * 3) % 5)) for v in range(6) for t in range(30)]
    df = spark.createDataFrame(rows, "video_id int, frame_idx int, motion double")
    a = sorted(map(tuple, state.fold(df, state.motion_z()).collect()))
    b = sorted(map(tuple, state.fold(df.orderBy(F.rand(3)).repartition(7), state.motion_z()).collect()))
    assert a == b
    mu, dev = 0.0, 1.0
    for t in range(30):
        g = rows[t][2]
        mu = 0.98 * mu + 0.02 * g
        dev = 0.98 * dev + 0.02 * abs(g - mu)
        assert a[t][2:] == pytest.approx((mu, dev, (g - mu) / (dev + 1e-3)))


def test_splits(spark):
    meta = spark.createDataFrame([(i, "a" if i < 7 else "b" if i < 8 else "c") for i in range(20)], "video_id int, s string")
    got = splits.stratified_split(meta, ["s"], 0.4).groupBy("s").agg(F.count_if(F.col("split") == "holdout").alias("n")).collect()
    assert {r.s: r.n for r in got} == {"a": 3, "b": 1, "c": 5}
    loc = spark.createDataFrame([("x", 10), ("y", 5), ("z", 5)], "location string, n_frames long")
    assert {r.location: r.split for r in splits.location_split(loc, 0.5).collect()}["x"] == "dev"
    one = spark.createDataFrame([("x", 10), ("y", 1)], "location string, n_frames long")
    assert {r.split for r in splits.location_split(one, 1.0).collect()} == {"dev", "holdout"}


def test_new_objects_iou(spark):
    frames = spark.createDataFrame([(i, 1, i) for i in range(6)], "image_id long, video_id int, frame_idx int")
    rows = [(i, 0, 1, 0.0 if i != 5 else 300.0, 0.0, 10.0, 10.0, 0.0, 100.0) for i in (0, 3, 5)]
    boxes = spark.createDataFrame(rows, BOX)
    new = need.new_objects(boxes, boxes, need.time_index(frames), 3, None, 0.3)
    assert sorted(r.image_id for r in new.collect()) == [0, 5]
