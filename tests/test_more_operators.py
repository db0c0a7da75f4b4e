"""Planner, reports, ETL, detector seam, discovery."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.operators import bootstrap, detect, etl, need, planner, reports, splits, state, tracks
from framequarry.sources import discovery

GRID = [(x, y, 10, 10) for y in (0, 10, 20) for x in (0, 10, 20, 30)]


def test_planner_parts():
    assert planner.covering(GRID, 10, 10) == [5]
    assert planner.around(GRID, [5], 1) == [1, 4, 6, 9]
    assert planner.around(GRID, [0], 1, diagonal=True) == [1, 4, 5]
    assert planner.protected(GRID, [(0, 0, 2, 2, 0.5), (34, 24, 2, 2, 0.9)], 4) == [11, 7, 10, 0]
    assert planner.with_row_quota([9, 5, 1, 2], GRID, 2, False) == [1, 9]
    assert planner.with_row_quota([5, 1, 9, 2], GRID, 3, True) == [1, 9, 5]
    assert planner.with_row_quota([5, 4], GRID, 1, True) == [5]
    assert planner.peaks([1.0, 2.0, 10.0], 95.0)[2] == pytest.approx(11.0)
    assert planner.subset_tiles(GRID, [], [0, 0, 3, 0, 2, 0, 0, 0, 0, 0, 0, 0], k_min=2, top=1) == [2, 4]
    assert planner.round_robin(5, 3, 2, 4) == ([4, 1, 3], 0)


def test_planner_machine():
    m = planner.tile_planner(GRID, planner.PlannerConfig(memory_ttl=2, row_quota=True, source="diff"))
    row = {"mode": "subset", "k": 2, "protect_frac": 0.0, "tracks": [], "diff": [0.0] * 8 + [9.0, 8.0, 0.0, 0.0], "motion": [0.0] * 12, "hard": True}
    out = list(m.run([row, {**row, "diff": [0.0] * 12}, {**row, "mode": "full_burst"}, {**row, "k": 0}]))
    assert out[0]["tiles"] == [0, 8] and out[0]["tile_mode"] == "explore"
    assert out[1]["tiles"] == [0, 8]  # remembered
    assert len(out[2]["tiles"]) == 12 and out[3]["tile_mode"] == "off"


def test_reports(spark):
    log = spark.createDataFrame([(1, 0, "skip", 0, 0.2, True), (2, 1, "full", 9, 1.5, None), (3, 2, "subset", 3, 1.0, False)], "image_id long, ord int, mode string, num_tiles int, risk double, low_motion boolean")
    r = reports.mode_log(log, ["low_motion"]).first()
    assert (r.n_full, r.tiles_mean, r.tiles_max, r.risk_mean_skip) == (1, 6.0, 9.0, 0.2) and r.share_low_motion == pytest.approx(1 / 3)
    q = reports.quantile_table(log, ["risk"]).where("q = 0.5").first()
    assert q.value == 1.0
    fails = spark.createDataFrame([(1,), (9,)], "image_id long")
    r = reports.skipped_failures(fails, log).first()
    assert (r.num_failures, r.missing, r.n_skip, r.skip_rate) == (2, 1, 1, 1.0)
    c = spark.createDataFrame([(1, 0, 2, [2, 5]), (0, 1, 0, [])], "num_confirmed int, num_unconfirmed int, newly_confirmed int, ttc_list array<int>")
    r = reports.confirmation_stats(c).first()
    assert (r.confirm_frames, r.unconfirmed_frames, r.ttc_count, r.ttc_mean, r.ttc_p90) == (1, 1, 2, 3.5, 2)
    nested = spark.createDataFrame([(1, (2.0,))], "a int, b struct<c:double>")
    r = reports.flattened(nested, {"x": "b.c", "y": "b.d", "z": "a"}).first()
    assert (r.x, r.y, r.z) == (2.0, None, 1)
    checks = reports.acceptance(log, [("enough", "FAIL", F.count("*") > 5), ("some", "WARN", F.count("*") > 1)])
    assert {r.check: r.result for r in checks.collect()} == {"enough": "FAIL", "some": "OK"}


def test_locations(spark):
    images = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(10)], "image_id long, location string")
    notes = spark.createDataFrame([(i, 0 if i % 2 else 3) for i in range(10)] + [(0, 3)], "image_id long, category_id int")
    s = reports.location_stats(images, notes)
    assert {r.location: (r.num_images, r.num_empty) for r in s.collect()} == {"a": (7, 3), "b": (4, 2)}
    assert reports.location_stats(images, notes, distinct_images=True).where("location = 'a'").first().num_images == 6
    b = reports.bundles(s, [1, 2]).orderBy("bundle_size").collect()
    assert b[0].locations == ["b"] and b[1].num_images == 11
    got = etl.target_bundle(s, 0.5, 4, 1)
    assert got["locations"] == ["b"] and got["empty_ratio"] == 0.5


def test_etl(spark):
    images = spark.createDataFrame([(7, "loc2/s/b.jpg"), (8, "loc1/s/a.jpg")], "image_id long, file_name string")
    p = {r.image_id: (r.location, r.session, r.base_name) for r in etl.parsed_names(images).collect()}
    assert p[7] == ("loc2", "s", "b.jpg")
    cats = spark.createDataFrame([(1, "Empty"), (2, "bird")], "id int, name string")
    notes = spark.createDataFrame([(7, 2), (8, 1)], "image_id long, category_id int")
    i, n = etl.one_class(images, notes, cats)
    assert {r.file_name: r.image_id for r in i.collect()} == {"loc1/s/a.jpg": 1, "loc2/s/b.jpg": 2}
    assert [(r.image_id, r.category_id) for r in n.collect()] == [(2, 1)]
    with pytest.raises(ValueError):
        etl.one_class(images.where("image_id = 8"), notes, cats)
    assert etl.target_category(cats, name="BIRD") == 2
    with pytest.raises(ValueError):
        etl.target_category(cats)
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "image_id long, seq_id string")
    kept = etl.keep_by_either(rows, rows.where("image_id = 1"), rows.where("seq_id = 'z'"))
    assert sorted(r.image_id for r in kept.collect()) == [1, 3]
    seq = spark.createDataFrame([("b", None, 2, "q"), ("b", None, 1, "p"), (None, "a", None, "r")], "seq_id string, location string, frame_num long, file_name string")
    got = {r.file_name: (r.video_id, r.frame_idx, r.new_id) for r in etl.exported_sequences(seq).collect()}
    assert got == {"r": ("a", 0, 1), "p": ("b", 0, 2), "q": ("b", 1, 3)}


def test_detector_seam(spark):
    frames = spark.createDataFrame([(1, 20, 10, b"x"), (2, 20, 10, b"y")], "image_id long, width int, height int, content binary")
    grid = spark.createDataFrame([(20, 10, 0, 0, 0, 12, 10), (20, 10, 1, 8, 0, 12, 10)], "width int, height int, tile_id int, x int, y int, w int, h int")

    def make():
        return lambda crops: [[(9.0 - t[0], 1.0, 3.0, 3.0, 0.9, 5), (0.0, 0.0, 1.0, 1.0, 0.1, 5)] for _, t in crops]

    out = detect.sliced(frames, grid, lambda payloads, ts: list(zip(payloads, ts)), make).collect()
    assert sorted((r.image_id, r.x, r.score) for r in out) == [(1, 9.0, 0.9), (2, 9.0, 0.9)]  # found in both tiles, kept once
    stats = detect.coarse_stats(spark.createDataFrame([(1, 0.9, 2.0, 2.0), (1, 0.03, 2.0, 2.0)], "image_id long, score double, w double, h double")).first()
    assert (stats.num_boxes, stats.num_low, stats.num_small) == (1, 1, 1) and stats.margin == pytest.approx(0.87)
    assert detect.contiguous_labels(2) == {0: 1, 1: 2}


def test_discovery(spark, tmp_path):
    for n in ("annotations_dev.json", "sequences_dev.json", "annotations_x.json"):
        (tmp_path / n).write_text("[]")
    folder = f"file://{tmp_path}"
    assert discovery.available_splits(spark, folder) == ["dev", "x"]
    assert discovery.resolved_paths(spark, folder, "dev")[0].endswith("annotations_dev.json")
    with pytest.raises(FileNotFoundError, match="dev"):
        discovery.resolved_paths(spark, folder, "x")
    assert discovery.flat_settings("a: 1\nb: 0.5 # half\nc: 'x'\n# no\nd: true\ne:") == {"a": 1, "b": 0.5, "c": "x", "d": True, "e": None}
    assert discovery.listed_ids({"n": 3, "other": [{"video_id": "v"}], "videos": ["w", 2]}) == ["w", "2"]
    assert discovery.split_map(json.loads('{"splits": {"train": [1], "info": "x"}}')) == {"train": ["1"]}


def test_bootstrap_weights():
    """Every trial draws n of n; blocks share the draws as one draw would."""
    sizes, trials = [7, 0, 30, 13], 400
    w = [bootstrap.weights(sizes, b, trials, 5) for b in range(4)]
    assert [x.shape for x in w] == [(trials, n) for n in sizes]
    assert (sum(x.sum(axis=1) for x in w) == 50).all()
    each = np.concatenate(w, axis=1)
    assert abs(each.mean() - 1) < 1e-9 and abs(each.var() - 49 / 50) < 0.05
    assert abs(np.cov(each[:, 0], each[:, -1])[0, 1] + 1 / 50) < 0.15


def test_bootstrap_sums(spark):
    rows = [(i, float(i % 9), None if i % 4 else i % 5) for i in range(300)]
    items = spark.createDataFrame(rows, "id int, v double, first_hit int")
    sizes = [len([1 for r in bootstrap._blocks(items, ["id"], 60)[0].collect() if r["_block"] == b]) for b in range(5)]
    dealt = sorted((r["_block"], r["id"], r["v"], r["first_hit"]) for r in bootstrap._blocks(items, ["id"], 60)[0].collect())
    w = np.concatenate([bootstrap.weights(sizes, b, 50, 3) for b in range(5)], axis=1)
    got = {r.trial: (r.n, r.v) for r in bootstrap.summed(items.repartition(7), ["id"], ["v"], 50, 3, 60).collect()}
    for t in range(50):
        assert got[t][0] == 300 and abs(got[t][1] - sum(k * r[2] for k, r in zip(w[t], dealt))) < 1e-6
    counts = {(r.trial, r.value): r.weight for r in bootstrap.counted(items, ["id"], "first_hit", 50, 3, 60).collect()}
    want = {}
    for t in range(50):
        for k, r in zip(w[t], dealt):
            if r[3] is not None and k:
                want[t, float(r[3])] = want.get((t, float(r[3])), 0) + int(k)
    assert counts == want
    ci = bootstrap.mean_ci(items, "v", ["id"], trials=1000).first()
    sd = np.std([r[1] for r in rows]) / 300**0.5
    assert ci.n_boot == 1000 and abs(ci.mean - np.mean([r[1] for r in rows])) < 0.1 and abs(ci.ci_high - ci.ci_low - 2 * 1.96 * sd) < 0.1
    none = bootstrap.mean_ci(items.limit(0), "v", ["id"], trials=10).first()
    assert none.n_boot == 0 and none.mean is None


def test_numbered_names(spark):
    rng = random.Random(1)
    names = list({"common/prefix/" + "".join(rng.choices("aböz0Z😀", k=rng.randint(0, 6))) for _ in range(500)})
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int").repartition(5)
    old = splits.CUT_NAMES, splits.RANGES
    try:
        for splits.CUT_NAMES, splits.RANGES in (old, (40, 7), (1, 1)):
            got = {r.name: r.id for r in splits.numbered(df, "name").collect()}
            assert got == {n: k + 1 for k, n in enumerate(sorted(names))}
    finally:
        splits.CUT_NAMES, splits.RANGES = old
    assert splits.numbered(df.limit(0), "name").count() == 0


def test_intervals_in_stretches(spark):
    rng = random.Random(4)
    for most in (1, 40, 100_000):
        times = sorted(rng.sample(range(most), min(most, 300)))
        bad = [t for t in times if rng.random() < 0.4]
        rows = spark.createDataFrame([(t, t) for t in times], "image_id long, t long")
        fails = spark.createDataFrame([(t, t in bad) for t in times], "image_id long, failure boolean")
        old = need.STRETCHES
        try:
            for need.STRETCHES in (old, 7):
                got = need.intervals(fails, rows).first()
                d = np.diff(bad)
                assert got.n_intervals == len(d)
                if len(d):
                    assert abs(got.mean_delta - d.mean()) < 1e-9 and abs(got.p95_delta - np.percentile(d, 95)) < 1e-9
        finally:
            need.STRETCHES = old


@pytest.mark.parametrize("target", [0.0, 0.1, 0.3, 0.9])
def test_negatives_by_rank(spark, target):
    rng = random.Random(int(target * 10))
    events = [(v, 10, 15, rng.randint(1, 6), 6) for v in range(0, 40, 2)]
    neg = [(v, s, s + 5, rng.randint(0, 2), 6) for v in range(40) for s in range(0, 60, 6)]
    schema = "video_id long, start int, end int, pos_frames long, len_frames long"
    e, n = spark.createDataFrame(events, schema), spark.createDataFrame(neg, schema)
    got = {(r.video_id, r.start) for r in splits.with_negatives(e, n, target, 0.01, 4, seed=3).collect()} - {(v, s) for v, s, *_ in events if s == 10}
    draw = lambda seed, *k: hashlib.md5("/".join(map(str, (seed, *k))).encode()).hexdigest()
    free = []
    for v in range(40):
        own = sorted((r for r in neg if r[0] == v), key=lambda r: (draw(3, v, r[1]), r[1]))
        free += own[: 4 - (v % 2 == 0)]
    free.sort(key=lambda r: (draw(4, r[0], r[1]), r[0], r[1]))
    pos, size = sum(r[3] for r in events), sum(r[4] for r in events)
    k = min(int(-(-max(0, -(-pos // target) - size) // 6)) if target else 0, len(free))
    for _ in range(10):
        share = (pos + sum(r[3] for r in free[:k])) / (size + sum(r[4] for r in free[:k]))
        if abs(share - target) <= 0.01 or (share > target and k == len(free)) or (share < target and k == 0):
            break
        k += 1 if share > target else -1
    assert got == {(r[0], r[1]) for r in free[:k]}


def test_blended_scores():
    assert planner.blended([], [], "mixed") == [] and planner.blended([0.0, -1.0], [0.0], "mixed") == [0.0, -1.0]
    assert planner.blended([2.0, 1.0, 0.0], [4.0], "mixed") == pytest.approx([2.0, 0.5, 0.0], abs=1e-5)
    assert planner.sized([1.0], 3) == [1.0, 0.0, 0.0]
    grid = [(0, 0, 10, 10), (10, 0, 10, 10), (0, 10, 10, 10)]
    row = {"mode": "subset", "k": 1, "protect_frac": 0.0, "tracks": [], "diff": [], "motion": [0.0, 3.0, 1.0], "hard": True, "gap": 5.0}
    for limit, kept in ((0.0, [1, 1]), (1.0, [1, 2]), (9.0, [1, 1])):
        machine = planner.tile_planner(grid, planner.PlannerConfig(memory_ttl=3, memory_when="top1_gap", memory_limit=limit))
        out = list(machine.run([row, {**row, "motion": [0.0, 0.0, 1.0]}]))
        assert [o["tiles_explore"][0] for o in out] == kept


def test_link_by_diagonal(spark):
    frames = spark.createDataFrame([(i, 1, i) for i in range(3)], "image_id long, video_id int, frame_idx int")
    box = "image_id long, ord int, x double, y double, w double, h double"
    boxes = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 0.5, 0.0, 10.0, 10.0), (2, 0, 3.0, 0.0, 10.0, 10.0)], box)
    ids = lambda **k: [r.local_id for r in sorted(tracks.pseudo_tracks(frames, boxes, **k).collect(), key=lambda r: r.image_id)]
    assert ids(center=0.0, center_frac=0.1) == [1, 1, 2] and ids(center=0.0, center_frac=0.01) == [1, 2, 3] and ids(center=5.0) == [1, 1, 2]


def test_budget_tiles():
    scores = [0.1, 0.9, 0.5, 0.9, 0.2]
    assert planner.budget_tiles(scores, {4, 0, 9}, 3, 1, 0.5) == [0, 4, 1]
    assert planner.budget_tiles(scores, {4, 0}, 1, 1, 0.5) == [0]
    assert planner.budget_tiles(scores, {4}, 5, 3, 0.8, keep_active=False) == [1, 3, 2]
    assert planner.budget_tiles(scores, set(), 4, 2, 2.0) == [1, 3] and planner.budget_tiles([], {1}, 3, 1, 0.0) == []
    rows = [{"scores": scores, "hit_tiles": [4] if t == 0 else []} for t in range(4)]
    assert [o["tiles"] for o in planner.activity(2, 1, 0.95, 2).run(rows)] == [[1], [4], [4], [1]]


def test_stability_tracker():
    box = lambda x: {"x": float(x), "y": 0.0, "w": 10.0, "h": 10.0, "score": 0.9}
    rows = [{"boxes": [box(0), box(100), box(200)]}, *[{"boxes": [box(200)]}] * 4, {"boxes": []}]
    out = list(state.stability_tracker().run(rows))
    assert [(o["num_tracks"], o["num_dropped"], o["tracking_fail"]) for o in out] == [(3, 0, False), (3, 0, False), (3, 0, False), (1, 2, True), (1, 0, False), (1, 0, False)]
