"""The job from files to reports, VOC conversion and the signals from pixels."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.operators import pixels, state
from framequarry.plans import evaluate
from framequarry.sources import readers


@pytest.fixture
def run_files(tmp_path):
    """Two videos of four and two frames: one box that is found late, one empty frame with a false detection."""
    images = [{"id": i, "file_name": f"{i}.jpg", "width": 100, "height": 100, "video_id": "a" if i < 4 else "b", "frame_id": i % 4} for i in range(6)]
    notes = [{"id": i, "image_id": i, "category_id": 1, "bbox": [10, 10, 20, 20]} for i in (0, 1, 2)]
    notes += [{"id": 9, "image_id": 4, "category_id": 1, "bbox": [0, 0, 5, 5]}, {"id": 10, "image_id": 5, "category_id": 2, "bbox": [0, 0, 5, 5]}]
    (tmp_path / "gt.json").write_text(json.dumps({"images": images, "annotations": notes, "categories": [{"id": 1, "name": "bird"}, {"id": 2, "name": "cat"}]}))
    pred = [{"image_id": i, "category_id": 1, "bbox": [10, 10, 20, 20], "score": 0.9} for i in (1, 2)]
    pred += [{"image_id": 3, "category_id": 1, "bbox": [90, 90, 20, 20], "score": 0.8}, {"image_id": 5, "category_id": 2, "bbox": [0, 0, 5, 5], "score": 0.9}, {"image_id": 77, "category_id": 1, "bbox": [0, 0, 5, 5], "score": 0.9}]
    with gzip.open(tmp_path / "pred.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, pred)))
    cost = [{"image_id": i, "sahi_on": i % 2, "tiles_used": 6 * (i % 2), "latency_ms": 10.0 + i} for i in range(5)]
    with gzip.open(tmp_path / "cost.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, cost)))
    (tmp_path / "seq.json").write_text(json.dumps([{"video_id": "a", "frame_ids": [0, 1, 2, 3]}, {"video_id": "b", "frame_ids": [4, 5]}]))
    return tmp_path


@pytest.mark.parametrize("with_sequences", [True, False])
def test_evaluate(spark, run_files, with_sequences):
    d = run_files
    out = str(d / "out")
    settings = evaluate.Settings(average=(3.0, 99.0), small=(0.01,), about={"run": "x"})
    got = evaluate.evaluate(spark, str(d / "gt.json"), str(d / "pred.jsonl.gz"), out, str(d / "seq.json") if with_sequences else None, str(d / "cost.jsonl.gz"), target_name="Bird", settings=settings)
    q, c = got["quality"], got["cost"]
    assert (q["num_tp_frames"], q["num_fp_frames"], q["num_fn_frames"]) == (2, 1, 2)
    assert q["delay"]["mean"] == pytest.approx(1.0) and q["miss_streak"]["mean"] == pytest.approx(1.0)  # (1, 1) and (1, 1)
    assert q["empty_fp_rate"] == pytest.approx(1 / 2) and q["bbox_oob_rate"] == pytest.approx(1 / 3)
    assert q["Recall"] == pytest.approx(0.5)
    assert got["safety"]["0.7"] == {"EFFR": 0.5, "EFPD": 0.5}
    assert c["total_tiles"] == 6 + 6 + 3 and c["avg_latency_ms"] == pytest.approx((10 + 11 + 12 + 13 + 14 + 99) / 6)
    assert got["small_tau"]["0.01"]["mAP"] == 0.0 and got["run_meta"]["target_category_id"] == 1
    rows = {r.video_id: r for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/per_video.csv").collect()}
    assert rows["a"].num_frames == 4 and rows["a"].num_pos_frames == 3 and rows["b"].num_empty_frames == 1
    log = readers.cost_log(spark, f"{out}/per_frame.jsonl.gz")
    assert {r.image_id: (r.verifier_on, r.tiles_used, r.latency_ms) for r in log.collect()}[5] == (1, 3.0, 99.0)
    stats = evaluate.run_stats(readers.lines(spark, f"{out}/per_frame.jsonl.gz", readers.COST)).first()
    assert stats.num_frames == 6 and stats.verifier_frames == 3 and stats.fps == pytest.approx(6 / 0.159)
    assert json.loads(spark.read.text(f"{out}/summary.json").first()[0])["quality"] == q
    assert spark.read.text(f"{out}/summary.md").count() == 3


def test_fixed_costs(spark):
    frames = spark.createDataFrame([(i, "v", i, 1920, 1080) for i in range(6)], "image_id long, video_id string, frame_idx int, width int, height int")
    costs = lambda m: [(r.verifier_on, r.tiles_used) for r in evaluate.frame_costs(frames, None, evaluate.Settings(method=m)).orderBy("image_id").collect()]
    assert costs(evaluate.PLAIN) == [(0, 0.0)] * 6
    full = costs(evaluate.FULL)
    assert len(set(full)) == 1 and full[0][1] > 1
    assert costs(evaluate.KEYFRAME) == [full[0] if i % 4 == 0 else (0, 0.0) for i in range(6)]


def test_voc(spark, tmp_path):
    def xml(objects):
        inside = "".join(f"<object><name>{n}</name><trackid>{t}</trackid><bndbox><xmin>{x}</xmin><ymin>{y}</ymin><xmax>{x + 4}</xmax><ymax>{y + 6}</ymax></bndbox></object>" for n, t, x, y in objects)
        return f"<annotation><size><width>64</width><height>48</height></size>{inside}</annotation>"

    for video, frame, objects in (("v1", "000000", [("bird", 3, 1, 2)]), ("v1", "000001", []), ("v2", "000000", [("cat", 1, 0, 0), ("bird", 2, 5, 5)])):
        (tmp_path / "in" / video).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / video / f"{frame}.xml").write_text(xml(objects))
    out = str(tmp_path / "out")
    evaluate.convert_voc(spark, str(tmp_path / "in"), out, {"bird": 7})
    images, notes, categories = readers.coco(spark, f"{out}/annotations.json")
    assert [(r.image_id, r.file_name, r.width, r.height) for r in images.orderBy("image_id").collect()] == [(1, "v1/000000.jpg", 64, 48), (2, "v1/000001.jpg", 64, 48), (3, "v2/000000.jpg", 64, 48)]
    assert [(r.ann_id, r.image_id, r.category_id, r.x, r.h, r.track_id) for r in notes.orderBy("ann_id").collect()] == [(1, 1, 7, 1.0, 6.0, 3), (2, 3, 7, 5.0, 6.0, 2)]
    assert categories.first().name == "bird"
    lines = {json.loads(r.value)["video_id"]: json.loads(r.value)["frame_ids"] for r in spark.read.text(f"{out}/sequences.json").collect()}
    assert lines == {"v1": [1, 2], "v2": [3]}


GRID = [(0, 0, 8, 8), (4, 4, 8, 8), (30, 0, 8, 8), (0, 10, 100, 100)]


def decode(row):
    return np.frombuffer(row["px"], np.uint8).reshape(row["high"], -1, 3)


def film():
    rng = np.random.default_rng(5)
    frames = [rng.integers(0, 256, (14 if t < 9 else 10, 17, 3), dtype=np.uint8) for t in range(12)]
    return frames, [{"video_id": 1, "frame_idx": t, "px": f.tobytes(), "high": f.shape[0]} for t, f in enumerate(frames)]


def plain_gray(f, every):
    g = 0.2989 * f[..., 0] + 0.587 * f[..., 1] + 0.114 * f[..., 2]
    return g[: f.shape[0] // every * every : every, : f.shape[1] // every * every : every] if every > 1 else g


def plain_means(d, every):
    out = []
    for x, y, w, h in GRID:
        part = d[y // every : max(0, (y + h) // every), x // every : max(0, (x + w) // every)]
        out.append(float(part.mean()) if part.size else 0.0)
    return out


@pytest.mark.parametrize("lag", [1, 4, None])
def test_motion_tiles(lag):
    frames, rows = film()
    got = list(pixels.motion_tiles(GRID, decode, 2, lag, 3).run(rows))
    seen, motion = [], 0.0
    for f, o in zip(frames, got):
        g = plain_gray(f, 2)
        if seen and seen[-1].shape != g.shape:
            seen, motion = [], 0.0
        seen.append(g)
        want = np.zeros_like(g)
        if len(seen) > 1:
            want = np.abs(g - seen[max(0, len(seen) - 1 - lag)]) if lag else np.mean([np.abs(b - a) for a, b in zip(seen[-3:], seen[-3:][1:])], axis=0)
            motion = 0.8 * motion + 0.2 * want.mean()
        assert o["tile_scores"] == pytest.approx(plain_means(want, 2), rel=1e-4, abs=1e-4)
        assert o["motion"] == pytest.approx(motion if len(seen) > 1 else 0.0, rel=1e-4)


def test_difference_and_picture(spark):
    frames, rows = film()
    for background, keep in ((None, 0.0), (0.05, 0.0), (None, 0.5)):
        old = scores = None
        for f, o in zip(frames, pixels.difference_tiles(GRID, decode, 1, background, keep).run(rows)):
            g = plain_gray(f, 1)
            if old is None or old.shape != g.shape:
                old, d = g, np.zeros_like(g)
            elif background is None:
                d, old = np.abs(g - old), g
            else:
                old = (1 - background) * old + background * g
                d = np.abs(g - old)
            means = np.array(plain_means(d, 1))
            scores = means if scores is None or not keep else keep * scores + (1 - keep) * means
            assert o["tile_scores"] == pytest.approx(scores.tolist(), rel=1e-4, abs=1e-4) and o["difference"] == pytest.approx(d.mean(), rel=1e-4, abs=1e-5)
    df = spark.createDataFrame([(r["video_id"], r["frame_idx"], bytearray(r["px"]), r["high"]) for r in rows], "video_id int, frame_idx int, px binary, high int")
    table = sorted(map(tuple, state.fold(df.orderBy(F.rand(1)), pixels.picture_signals(lambda row: np.frombuffer(row["px"], np.uint8).reshape(row["high"], -1, 3))).collect()))
    motion, old = 0.0, None
    for f, (_, t, m, blur) in zip(frames, table):
        g = plain_gray(f, 1)
        lap = np.roll(g, 1, 0) + np.roll(g, -1, 0) + np.roll(g, 1, 1) + np.roll(g, -1, 1) - 4 * g
        same = old is not None and old.shape == g.shape
        motion = 0.8 * motion + 0.2 * np.abs(g - old).mean() if same else motion
        assert blur == pytest.approx(lap.var(), rel=1e-3) and m == pytest.approx(motion if same else 0.0, rel=1e-4)
        old = g
