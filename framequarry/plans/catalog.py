"""Registered queries of the detection-analytics library and their SQL for DuckDB.

All of them run over the adapter views of `adapt`.  Fractions that depend on the order of additions are
rounded to nine places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framequarry.functions import box as B
from framequarry.operators import bootstrap, coco, etl, kpi, matching, need, planner, prevalence, reports, runs, signals, splits, state, tiles, tracks

from . import adapt
from .adapt import SQL as VIEWS
from .adapt import iou_sql, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

IOU, CONF, SMALL = 0.5, 0.25, 1500.0


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL (following the views' WITH clause)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            # some of the statements fold step by step
            ORACLE_SQL[f.__name__] = VIEWS.replace("WITH ", "WITH RECURSIVE ", 1) + sql
        return f

    return add


def _r(c, name: str | None = None):
    out = F.round(F.col(c) if isinstance(c, str) else c, 9)
    return out.alias(name or c)


# --- masks and prevalence ----------------------------------------------------------------------

_MASK = """, mask AS (
  SELECT f.image_id, f.video_id, f.frame_idx, count(g.image_id) AS gt_num_boxes, count(g.image_id) = 0 AS is_empty
  FROM vx_frames f LEFT JOIN vx_gt g ON f.image_id = g.image_id GROUP BY ALL
), scores AS (
  SELECT image_id, tau, count(*) FILTER (score >= tau) AS n FROM vx_pred, vx_taus GROUP BY ALL
), tops AS (
  SELECT image_id, max(score) AS top_score, count(*) AS pred_count FROM vx_pred GROUP BY ALL
), labels AS (
  SELECT m.image_id, m.video_id, m.is_empty, c.verifier_on, t.tau, coalesce(s.n, 0) AS pred_count_ge,
         m.is_empty AND coalesce(s.n, 0) > 0 AS has_high_conf_fp,
         CASE WHEN m.is_empty THEN coalesce(s.n, 0) ELSE 0 END AS fp_count,
         CASE WHEN m.is_empty AND coalesce(s.n, 0) > 0 THEN p.top_score ELSE CAST(0 AS DOUBLE) END AS max_fp_conf
  FROM mask m JOIN vx_cost c USING (image_id) CROSS JOIN vx_taus t
  LEFT JOIN scores s ON s.image_id = m.image_id AND s.tau = t.tau LEFT JOIN tops p ON p.image_id = m.image_id
)
"""


def _labels(v: adapt.Views) -> DataFrame:
    mask = prevalence.empty_mask(v.frames, v.gt, adapt.TARGET)
    return prevalence.high_conf_labels(prevalence.prevalence_input(mask, v.pred, v.cost))


@query(
    _MASK
    + """, agg AS (
  SELECT tau, count(*) AS num_empty_frames, count(*) FILTER (has_high_conf_fp) AS num_empty_fp_frames,
         count(*) FILTER (verifier_on = 1) AS num_empty_verifier_on_frames, count(*) FILTER (verifier_on = 1 AND has_high_conf_fp) AS num_empty_fp_on_frames,
         count(*) FILTER (verifier_on <> 1) AS num_empty_verifier_off_frames, count(*) FILTER (verifier_on <> 1 AND has_high_conf_fp) AS num_empty_fp_off_frames,
         sum(fp_count) AS fp, sum(CAST(round(max_fp_conf * 1e6) AS BIGINT)) FILTER (has_high_conf_fp) AS conf
  FROM labels WHERE is_empty GROUP BY tau
)
SELECT tau, num_empty_frames, num_empty_fp_frames, num_empty_verifier_on_frames, num_empty_fp_on_frames, num_empty_verifier_off_frames, num_empty_fp_off_frames,
       round(num_empty_fp_frames / num_empty_frames, 9) AS prevalence_on_empty,
       round(num_empty_fp_on_frames / num_empty_verifier_on_frames, 9) AS prevalence_given_on,
       round(num_empty_fp_off_frames / num_empty_verifier_off_frames, 9) AS prevalence_given_off,
       round((num_empty_fp_on_frames / num_empty_verifier_on_frames) / (num_empty_fp_off_frames / num_empty_verifier_off_frames), 9) AS amplification_ratio,
       round(num_empty_fp_on_frames / num_empty_verifier_on_frames - num_empty_fp_off_frames / num_empty_verifier_off_frames, 9) AS amplification_diff,
       round(CAST(fp AS DOUBLE) / num_empty_frames, 9) AS mean_fp_count_on_empty,
       round(CAST(conf AS DOUBLE) / num_empty_fp_frames / 1e6, 9) AS mean_max_fp_conf
FROM agg"""
)
def empty_fp_prevalence(spark, sf_dir):
    table = prevalence.prevalence_table(_labels(views(spark, sf_dir)))
    exact = [c for c in table.columns if c == "tau" or c.startswith("num_")]
    return table.select(*exact, *[_r(c) for c in table.columns if c not in exact])


@query(_MASK + "SELECT image_id, video_id, frame_idx, gt_num_boxes, is_empty FROM mask")
def empty_mask(spark, sf_dir):
    v = views(spark, sf_dir)
    return prevalence.empty_mask(v.frames, v.gt).select("image_id", "video_id", "frame_idx", "gt_num_boxes", "is_empty")


@query(
    _MASK
    + """SELECT video_id, count(*) AS num_frames, count(*) FILTER (is_empty) AS num_empty_frames, round(count(*) FILTER (is_empty) / count(*), 9) AS empty_ratio
FROM mask GROUP BY GROUPING SETS ((video_id), ())"""
)
def empty_mask_summary(spark, sf_dir):
    v = views(spark, sf_dir)
    return prevalence.empty_mask_summary(prevalence.empty_mask(v.frames, v.gt)).select("video_id", "num_frames", "num_empty_frames", _r("empty_ratio"))


@query(_MASK + "SELECT image_id, video_id, is_empty, verifier_on, tau, pred_count_ge, has_high_conf_fp, fp_count, max_fp_conf FROM labels")
def high_conf_fp_labels(spark, sf_dir):
    return _labels(views(spark, sf_dir))


@query(
    _MASK
    + """SELECT tau, count(*) AS num_empty, round(count(*) FILTER (has_high_conf_fp) / count(*), 9) AS effr, round(CAST(sum(fp_count) AS DOUBLE) / count(*), 9) AS efpd
FROM labels WHERE is_empty GROUP BY tau"""
)
def effr_efpd(spark, sf_dir):
    return prevalence.effr_efpd(_labels(views(spark, sf_dir))).select("tau", "num_empty", _r("effr"), _r("efpd"))


@query(
    _MASK
    + """SELECT verifier_on, tau, count(*) AS num_empty, round(count(*) FILTER (has_high_conf_fp) / count(*), 9) AS effr, round(CAST(sum(fp_count) AS DOUBLE) / count(*), 9) AS efpd
FROM labels WHERE is_empty GROUP BY verifier_on, tau"""
)
def effr_efpd_on_off(spark, sf_dir):
    return prevalence.effr_efpd(_labels(views(spark, sf_dir)), "verifier_on").select("verifier_on", "tau", "num_empty", _r("effr"), _r("efpd"))


@query(
    _MASK
    + """, a AS (SELECT image_id, max(score) AS m FROM vx_pred GROUP BY image_id), b AS (SELECT image_id, max(score) AS m FROM vx_pred WHERE ord % 2 = 0 GROUP BY image_id)
SELECT mask.image_id, mask.video_id, coalesce(a.m, CAST(0 AS DOUBLE)) AS max_a, coalesce(b.m, CAST(0 AS DOUBLE)) AS max_b
FROM mask LEFT JOIN a ON a.image_id = mask.image_id LEFT JOIN b ON b.image_id = mask.image_id
WHERE is_empty AND coalesce(a.m, 0) >= 0.7 AND coalesce(b.m, 0) < 0.3"""
)
def disagreement_mining(spark, sf_dir):
    v = views(spark, sf_dir)
    mask = prevalence.empty_mask(v.frames, v.gt)
    return prevalence.disagreement(mask, v.pred, v.pred.where("ord % 2 = 0"), 0.7, 0.3)


# --- boxes -------------------------------------------------------------------------------------


@query(f", hits AS (SELECT DISTINCT g.image_id, g.ord FROM vx_gt g JOIN vx_pred p ON g.image_id = p.image_id WHERE {iou_sql('g', 'p')} >= 0.5)\nSELECT * FROM hits")
def iou_any_hit(spark, sf_dir):
    v = views(spark, sf_dir)
    return matching.any_hit(v.gt, v.pred, IOU).select("image_id", "ord")


@query(
    """, hits AS (
  SELECT DISTINCT g.image_id, g.ord FROM vx_gt g JOIN vx_pred p ON g.image_id = p.image_id
  WHERE sqrt(((g.x + g.w / 2) - (p.x + p.w / 2)) ** 2 + ((g.y + g.h / 2) - (p.y + p.h / 2)) ** 2) <= 12.5
) SELECT * FROM hits"""
)
def center_any_hit(spark, sf_dir):
    v = views(spark, sf_dir)
    return matching.any_hit(v.gt, v.pred, None, center_px=12.5).select("image_id", "ord")


@query(
    f""", pairs AS (
  SELECT p.image_id, p.ord, {iou_sql('p', 'g')} AS v,
         ((p.x + p.w / 2) - (g.x + g.w / 2)) * ((p.x + p.w / 2) - (g.x + g.w / 2)) + ((p.y + p.h / 2) - (g.y + g.h / 2)) * ((p.y + p.h / 2) - (g.y + g.h / 2)) AS apart,
         greatest(p.x + p.w, g.x + g.w) - least(p.x, g.x) AS wide, greatest(p.y + p.h, g.y + g.h) - least(p.y, g.y) AS high, g.image_id AS has
  FROM vx_pred p LEFT JOIN vx_gt g ON p.image_id = g.image_id
)
SELECT image_id, ord, round(max(CASE WHEN has IS NOT NULL THEN v - apart / greatest(wide * wide + high * high, 1e-9) END), 9) AS best_diou
FROM pairs GROUP BY image_id, ord"""
)
def diou_pairs(spark, sf_dir):
    v = views(spark, sf_dir)
    return matching.best_overlap(v.gt, v.pred, B.diou, "best_diou").select("image_id", "ord", _r("best_diou"))


_SHIFTED = "x - 300 AS x, y - 100 AS y, w, h"


@query(
    f""", b AS (SELECT image_id, ord, {_SHIFTED} FROM vx_pred), c AS (
  SELECT *, greatest(0, least(x, 640)) AS x1, greatest(0, least(y, 360)) AS y1, greatest(0, least(x + w, 640)) AS x2, greatest(0, least(y + h, 360)) AS y2,
         least(greatest(x, 0), 640) AS sx, least(greatest(y, 0), 360) AS sy
  FROM b
)
SELECT image_id, ord, CAST(x1 AS DOUBLE) AS cx, CAST(y1 AS DOUBLE) AS cy, CAST(x2 - x1 AS DOUBLE) AS cw, CAST(y2 - y1 AS DOUBLE) AS ch,
       CAST(greatest(least(w, 640 - sx), 0) AS DOUBLE) AS sw, CAST(greatest(least(h, 360 - sy), 0) AS DOUBLE) AS sh,
       sx <> x OR sy <> y OR greatest(least(w, 640 - sx), 0) <> w OR greatest(least(h, 360 - sy), 0) <> h AS oob
FROM c"""
)
def clamp_boxes(spark, sf_dir):
    v = views(spark, sf_dir)
    b = B.Box(F.col("x") - F.lit(300.0), F.col("y") - F.lit(100.0), F.col("w"), F.col("h"))
    width, height = F.lit(float(adapt.WIDTH)), F.lit(float(adapt.HEIGHT))
    cut = B.clip_corners(b, width, height)
    shifted, oob = B.shift_clamp(b, width, height)
    return v.pred.select("image_id", "ord", cut.x.alias("cx"), cut.y.alias("cy"), cut.w.alias("cw"), cut.h.alias("ch"), shifted.w.alias("sw"), shifted.h.alias("sh"), oob.alias("oob"))


def _nms_sql(measure: str, thr: float, boxes: str = "vx_pred") -> str:
    """Greedy suppression: step k adds the k-th box of every image unless a kept one rivals it."""
    return f""", rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS k FROM {boxes}), rivals AS (
  SELECT b.image_id, b.k, list(a.k) AS ks FROM rk b JOIN rk a ON a.image_id = b.image_id AND a.k < b.k WHERE {measure} > {thr} GROUP BY ALL
), steps AS (SELECT rk.image_id, rk.k, coalesce(ks, []) AS ks FROM rk LEFT JOIN rivals r ON r.image_id = rk.image_id AND r.k = rk.k), fold AS (
  SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM {boxes}
  UNION ALL
  SELECT s.image_id, s.k, CASE WHEN list_has_any(f.kept, s.ks) THEN f.kept ELSE list_append(f.kept, s.k) END FROM fold f JOIN steps s ON s.image_id = f.image_id AND s.k = f.k + 1
), last AS (SELECT image_id, arg_max(kept, k) AS kept FROM fold GROUP BY image_id)
"""


@query(_nms_sql(iou_sql("a", "b"), 0.35) + """SELECT rk.image_id, CAST(list_position(kept, k) AS INTEGER) AS rank, ord, x, y, w, h, score FROM rk JOIN last USING (image_id) WHERE list_contains(kept, k)""")
def nms_greedy(spark, sf_dir):
    """Class-agnostic greedy suppression."""
    return matching.suppress(views(spark, sf_dir).pred, 0.35, ["image_id"])


_DIOU_SQL = (
    iou_sql("a", "b")
    + """ - (((a.x + a.w / 2) - (b.x + b.w / 2)) * ((a.x + a.w / 2) - (b.x + b.w / 2)) + ((a.y + a.h / 2) - (b.y + b.h / 2)) * ((a.y + a.h / 2) - (b.y + b.h / 2)))
 / greatest((greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x)) * (greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x)) + (greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y)) * (greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y)), 1e-9)"""
)


@query(_nms_sql(_DIOU_SQL, 0.35) + """SELECT rk.image_id, 14 AS category_id, CAST(list_position(kept, k) AS INTEGER) AS rank, ord, x, y, w, h, score FROM rk JOIN last USING (image_id) WHERE list_contains(kept, k)""")
def diou_nms(spark, sf_dir):
    return matching.suppress(views(spark, sf_dir).pred, 0.35, ["image_id", "category_id"], B.diou)


@query(
    """, cut AS (
  SELECT image_id, ord, score, greatest(CAST(0 AS DOUBLE), least(x, 640)) AS x, greatest(CAST(0 AS DOUBLE), least(y, 360)) AS y,
         greatest(CAST(0 AS DOUBLE), least(x + w, 640)) - greatest(CAST(0 AS DOUBLE), least(x, 640)) AS w, greatest(CAST(0 AS DOUBLE), least(y + h, 360)) - greatest(CAST(0 AS DOUBLE), least(y, 360)) AS h
  FROM vx_pred WHERE score >= 0.6
), pp AS (SELECT * FROM cut WHERE w > 0 AND h > 0)"""
    + _nms_sql(iou_sql("a", "b"), 0.35, "pp")
    + """, best AS (SELECT image_id, ord, x, y, w, h, score, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS INTEGER) AS rank FROM rk JOIN last USING (image_id) WHERE list_contains(kept, k))
SELECT image_id, ord, round(x, 9) AS x, round(y, 9) AS y, round(w, 9) AS w, round(h, 9) AS h, score, rank FROM best WHERE rank <= 100"""
)
def postprocess_preset(spark, sf_dir):
    v = views(spark, sf_dir)
    t = matching.postprocess(v.pred, v.frames)
    return t.select("image_id", "ord", *[_r(c) for c in "xywh"], "score", "rank")


def _greedy_sql(takers: str, taken: str, order: str, thr: float) -> str:
    """Each of `takers` in order takes its best free one of `taken`; last: image_id, used."""
    return f""", tk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS k FROM {takers}), cand AS (
  SELECT a.image_id, a.k, list(b.ord ORDER BY {iou_sql('a', 'b')} DESC, b.ord) AS gs FROM tk a JOIN {taken} b ON b.image_id = a.image_id
  WHERE {iou_sql('a', 'b')} >= {thr} AND {iou_sql('a', 'b')} > 0 GROUP BY ALL
), steps AS (SELECT tk.image_id, tk.k, coalesce(gs, []) AS gs FROM tk LEFT JOIN cand c ON c.image_id = tk.image_id AND c.k = tk.k), fold AS (
  SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS used FROM {takers}
  UNION ALL
  SELECT image_id, k, CASE WHEN len(free) > 0 THEN list_append(used, free[1]) ELSE used END FROM (
    SELECT s.image_id, s.k, f.used, list_filter(s.gs, lambda g: NOT list_contains(f.used, g)) AS free FROM fold f JOIN steps s ON s.image_id = f.image_id AND s.k = f.k + 1)
), last AS (SELECT image_id, len(arg_max(used, k)) AS used FROM fold GROUP BY image_id)
"""


_MATCHED = (
    ", sure AS (SELECT * FROM vx_pred WHERE score >= 0.25)"
    + _greedy_sql("sure", "vx_gt", "score DESC, ord", IOU)
    + """, np AS (SELECT image_id, count(*) AS n, max(score) AS top FROM sure GROUP BY image_id), fm AS (
  SELECT f.image_id, CAST(coalesce(l.used, 0) > 0 AS INTEGER) AS tp, CAST(coalesce(np.n, 0) - coalesce(l.used, 0) AS INTEGER) AS fp,
         CAST(EXISTS (SELECT 1 FROM vx_gt g WHERE g.image_id = f.image_id) AND coalesce(l.used, 0) = 0 AS INTEGER) AS fn, coalesce(np.top, CAST(0 AS DOUBLE)) AS max_conf
  FROM vx_frames f LEFT JOIN last l ON l.image_id = f.image_id LEFT JOIN np ON np.image_id = f.image_id
)
"""
)


@query(_MATCHED + "SELECT image_id, tp, fp, fn, max_conf FROM fm")
def greedy_match(spark, sf_dir):
    v = views(spark, sf_dir)
    return matching.frame_match(v.frames, v.gt, v.pred, IOU, CONF)


@query(_greedy_sql("vx_gt", "vx_pred", "ord", IOU) + "SELECT g.image_id, CAST(count(*) AS INTEGER) AS n_gt, CAST(any_value(l.used) AS INTEGER) AS matched FROM vx_gt g JOIN last l ON l.image_id = g.image_id GROUP BY g.image_id")
def gt_to_pred_match(spark, sf_dir):
    v = views(spark, sf_dir)
    return matching.gt_matches(v.gt, v.pred, IOU)


# --- projections, filters, ETL -----------------------------------------------------------------


@query(
    """, r AS (
  SELECT image_id, ord, score, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS INTEGER) AS rank FROM vx_pred WHERE score >= 0.25
) SELECT * FROM r WHERE rank <= 3"""
)
def slim_topk(spark, sf_dir):
    return splits.slim(views(spark, sf_dir).pred, CONF, 3, adapt.TARGET).select("image_id", "ord", "score", "rank")


@query(
    """, r AS (
  SELECT score, row_number() OVER (PARTITION BY image_id, score < 0.25 ORDER BY score DESC, ord) AS k FROM vx_pred
)
SELECT CASE WHEN score < 0.25 THEN 'score' WHEN k > 3 THEN 'topk' ELSE 'kept' END AS reason, count(*) AS n FROM r GROUP BY ALL"""
)
def slim_drop_counts(spark, sf_dir):
    return splits.slim_counts(views(spark, sf_dir).pred, CONF, 3, adapt.TARGET)


@query("SELECT image_id, ord, area FROM vx_gt WHERE area / CAST(230400 AS DOUBLE) <= 0.005")
def small_object_subset(spark, sf_dir):
    v = views(spark, sf_dir)
    return splits.small_subset(v.frames, v.gt, 0.005).select("image_id", "ord", "area")


@query("SELECT image_id, video_id FROM vx_frames WHERE image_id NOT IN (SELECT image_id FROM vx_gt)")
def target_absent_images(spark, sf_dir):
    v = views(spark, sf_dir)
    return splits.target_absent(v.frames, v.gt, adapt.TARGET).select("image_id", "video_id")


_PRESENCE = """, pos AS (SELECT DISTINCT image_id FROM vx_gt), clips AS (
  SELECT video_id, count(*) AS n_frames, count(pos.image_id) AS n_pos FROM vx_frames LEFT JOIN pos ON pos.image_id = vx_frames.image_id GROUP BY video_id
)
"""


@query(_PRESENCE + "SELECT video_id, n_frames, n_pos, round(n_pos / n_frames, 9) AS presence FROM clips WHERE n_frames >= 5 AND n_pos / n_frames <= 0.8")
def clip_presence(spark, sf_dir):
    v = views(spark, sf_dir)
    return splits.clip_presence(v.frames, v.gt, 5, 0.8).select("video_id", "n_frames", "n_pos", _r("presence"))


def _flags(v: adapt.Views) -> DataFrame:
    pos = v.gt.select("image_id").distinct().withColumn("_p", F.lit(1))
    return v.frames.join(pos, "image_id", "left").select("image_id", "video_id", "frame_idx", F.col("_p").isNotNull().alias("flag"))


_FLAGS = """, pos AS (SELECT DISTINCT image_id FROM vx_gt), flags AS (
  SELECT f.image_id, video_id, frame_idx, pos.image_id IS NOT NULL AS flag FROM vx_frames f LEFT JOIN pos ON pos.image_id = f.image_id
), seg AS (
  SELECT video_id, flag, min(frame_idx) AS s, max(frame_idx) AS e, count(*) AS length
  FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, flag ORDER BY frame_idx) AS island FROM flags) GROUP BY video_id, flag, island
)
"""

_META = """, meta AS (
  SELECT f.video_id, count(*) AS video_len, count(*) FILTER (flag) AS n_pos, any_value(ns) AS num_pos_segments, any_value(mp) AS max_pos_run, any_value(mn) AS max_neg_run
  FROM flags f LEFT JOIN (SELECT video_id, count(*) FILTER (flag) AS ns, coalesce(max(length) FILTER (flag), 0) AS mp, coalesce(max(length) FILTER (NOT flag), 0) AS mn FROM seg GROUP BY video_id) q
  ON q.video_id = f.video_id GROUP BY f.video_id
), binned AS (
  SELECT *, n_pos / video_len AS presence,
         CASE WHEN video_len <= 30 THEN 'L<=30' WHEN video_len <= 60 THEN '31-60' WHEN video_len <= 120 THEN '61-120' ELSE '>120' END AS len_bin,
         CASE WHEN num_pos_segments = 0 THEN '0' WHEN num_pos_segments = 1 THEN '1' ELSE '>=2' END AS seg_bin,
         CASE WHEN n_pos = 0 THEN '0' WHEN n_pos / video_len <= 0.1 THEN '(0,0.1]' WHEN n_pos / video_len <= 0.3 THEN '(0.1,0.3]' ELSE '>0.3' END AS ratio_bin
  FROM meta
)
"""


@query(_FLAGS + _META + "SELECT video_id, video_len, n_pos, num_pos_segments, max_pos_run, max_neg_run, round(presence, 9) AS presence, len_bin, seg_bin, ratio_bin FROM binned")
def video_meta_bins(spark, sf_dir):
    m = splits.bins(splits.video_meta(_flags(views(spark, sf_dir))))
    return m.select("video_id", "video_len", "n_pos", "num_pos_segments", "max_pos_run", "max_neg_run", _r("presence"), "len_bin", "seg_bin", "ratio_bin")


@query(
    _FLAGS
    + _META
    + """, ranked AS (
  SELECT video_id, len_bin, seg_bin, ratio_bin, count(*) OVER (PARTITION BY len_bin, seg_bin, ratio_bin) AS n,
         row_number() OVER (PARTITION BY len_bin, seg_bin, ratio_bin ORDER BY md5('7/' || video_id), video_id) AS k
  FROM binned
)
SELECT video_id, len_bin, seg_bin, ratio_bin,
       CASE WHEN k <= CASE WHEN n > 1 THEN least(greatest(1, CAST(round_even(n * CAST(0.4 AS DOUBLE), 0) AS INTEGER)), n - 1) ELSE 1 END THEN 'holdout' ELSE 'dev' END AS split
FROM ranked"""
)
def stratified_split(spark, sf_dir):
    meta = splits.bins(splits.video_meta(_flags(views(spark, sf_dir))))
    return splits.stratified_split(meta, ["len_bin", "seg_bin", "ratio_bin"], 0.4, 7).select("video_id", "len_bin", "seg_bin", "ratio_bin", "split")


@query(
    """, loc AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS location, count(*) AS n_frames FROM vx_frames JOIN customer ON c_custkey = video_id GROUP BY ALL
), ordered AS (
  SELECT *, coalesce(sum(n_frames) OVER (ORDER BY n_frames DESC, md5('3/' || location), location ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(n_frames) OVER () AS total FROM loc
)
SELECT location, n_frames, CASE WHEN before < floor(0.7 * total) THEN 'dev' ELSE 'holdout' END AS split FROM ordered"""
)
def leakfree_location_split(spark, sf_dir):
    v = views(spark, sf_dir)
    where = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("video_id"), F.col("c_nationkey").cast("string").alias("location"))
    per = v.frames.join(where, "video_id").groupBy("location").agg(F.count("*").alias("n_frames"))
    return splits.location_split(per, 0.7, 3)


@query(
    """, a AS (SELECT c_name AS file_name, 0 AS source_nr, c_custkey AS old_id FROM customer WHERE c_custkey % 3 <> 0), b AS (
  SELECT c_name AS file_name, 1 AS source_nr, c_custkey + 1000000 AS old_id FROM customer WHERE c_custkey % 2 = 0
), u AS (
  SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY source_nr) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
)
SELECT file_name, CAST(source_nr AS INTEGER) AS source_nr, old_id, row_number() OVER (ORDER BY file_name) AS id FROM u WHERE k = 1"""
)
def union_dedupe_reid(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    a = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("file_name"), F.col("c_custkey").alias("old_id"))
    b = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("file_name"), (F.col("c_custkey") + 1000000).alias("old_id"))
    return splits.union_dedupe([a, b], "file_name").select("file_name", "source_nr", "old_id", "id")


@query(
    _FLAGS
    + """, n AS (SELECT video_id, count(*) AS n FROM flags GROUP BY video_id), w AS (
  SELECT video_id, least(6, n) AS l, unnest(generate_series(0, n - least(6, n), 2)) AS start FROM n
), c AS (
  SELECT w.video_id, CAST(w.start AS INTEGER) AS start, CAST(w.start + l - 1 AS INTEGER) AS "end", count(*) FILTER (flag) AS pos_frames, l AS len_frames
  FROM w JOIN flags f ON f.video_id = w.video_id AND f.frame_idx BETWEEN w.start AND w.start + l - 1 GROUP BY ALL
)
SELECT video_id, start, "end", pos_frames, len_frames, round(pos_frames / len_frames, 9) AS pos_ratio FROM c WHERE pos_frames / len_frames <= 0.5"""
)
def neg_windows_slide(spark, sf_dir):
    w = runs.sliding_windows(_flags(views(spark, sf_dir)), 6, 2, 0.5)
    return w.select("video_id", "start", "end", "pos_frames", "len_frames", _r("pos_ratio"))


@query(
    _FLAGS
    + """, w AS (SELECT video_id, greatest(0, s - 1) AS start, e + 1 AS "end" FROM seg WHERE flag), o AS (
  SELECT *, max("end") OVER (PARTITION BY video_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM w
), r AS (
  SELECT *, sum(CASE WHEN seen IS NULL OR start > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM o
), m AS (
  SELECT video_id, CAST(run AS INTEGER) AS run, min(start) AS start, max("end") AS "end" FROM r GROUP BY ALL
)
SELECT video_id, run, start, "end", start - lag("end") OVER (PARTITION BY video_id ORDER BY run) - 1 AS gap FROM m"""
)
def interval_merge_gaps(spark, sf_dir):
    seg = runs.segments(_flags(views(spark, sf_dir)), F.col("flag"))
    windows = seg.select("video_id", F.greatest(F.lit(0), F.col("s") - 1).alias("start"), (F.col("e") + 1).alias("end"))
    return runs.merged_intervals(windows)


def _windows_sql(length: int, low: int, high: int, seed: int) -> str:
    """Windows around segments: a seeded number of frames before the start, kept inside the video, at the segment's end if it is longer."""
    return f""", sized AS (
  SELECT seg.video_id, s, e, n, least({length}, n) AS own, {low} + CAST('0x' || substr(md5('{seed}/' || seg.video_id || '/' || s), 1, 8) AS BIGINT) % {high - low + 1} AS back
  FROM seg JOIN (SELECT video_id, count(*) AS n FROM flags GROUP BY video_id) q ON q.video_id = seg.video_id WHERE flag
), placed_at AS (SELECT *, greatest(0, least(greatest(0, s - back), n - own)) AS a FROM sized
), windows AS (SELECT video_id, own, CASE WHEN e > a + own - 1 THEN greatest(0, e - own + 1) ELSE a END AS a FROM placed_at
), dealt AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY md5('{seed}/' || video_id || '/' || a), a) AS r FROM windows)
"""


@query(_FLAGS + _windows_sql(8, 1, 3, 5) + """SELECT video_id, CAST(a AS INTEGER) AS start, CAST(a + own - 1 AS INTEGER) AS "end", 'event' AS type FROM dealt WHERE r <= 2 ORDER BY r, md5('5/' || video_id), video_id LIMIT 500""")
def event_windows_balanced(spark, sf_dir):
    """Seeded windows around segments, then a round robin over videos (a report of 500 windows)."""
    return splits.balanced(splits.event_windows(_flags(views(spark, sf_dir)), 8, (1, 3), 5), 500, 2, 5)


# --- runs --------------------------------------------------------------------------------------


@query(_FLAGS + "SELECT video_id, s, e, CAST(length AS INTEGER) AS length FROM seg WHERE flag")
def segments(spark, sf_dir):
    s = runs.segments(_flags(views(spark, sf_dir)), F.col("flag"))
    return s.select("video_id", "s", "e", F.col("length").cast("int").alias("length"))


_TP = f""", hit AS (
  SELECT DISTINCT g.image_id FROM vx_gt g JOIN vx_pred p ON g.image_id = p.image_id WHERE p.score >= 0.25 AND {iou_sql('g', 'p')} >= 0.5
), tpf AS (
  SELECT f.*, CASE WHEN hit.image_id IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN flag AND hit.image_id IS NULL THEN 1 ELSE 0 END AS fn
  FROM flags f LEFT JOIN hit ON hit.image_id = f.image_id
)
"""


def _tp_flags(v: adapt.Views) -> DataFrame:
    """Frame-level tp and fn: the first match by score always finds its box free, so tp is the existence of an overlap."""
    hit = matching.any_hit(v.gt, v.pred.where(F.col("score") >= CONF), IOU).select("image_id").distinct().withColumn("_h", F.lit(1))
    f = _flags(v).join(hit, "image_id", "left")
    return f.withColumns({"tp": F.col("_h").isNotNull().cast("int"), "fn": (F.col("flag") & F.col("_h").isNull()).cast("int")}).drop("_h")


@query(
    _FLAGS
    + _TP
    + """, j AS (SELECT s.video_id, s.s, s.e, t.frame_idx, t.tp, t.fn FROM seg s JOIN tpf t ON s.flag AND t.video_id = s.video_id AND t.frame_idx BETWEEN s.s AND s.e),
i AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, s, fn ORDER BY frame_idx) AS island FROM j),
k AS (SELECT video_id, s, fn, island, count(*) AS l FROM i GROUP BY ALL),
m AS (SELECT video_id, s, coalesce(max(l) FILTER (fn = 1), 0) AS miss_streak FROM k GROUP BY ALL)
SELECT j.video_id, j.s, j.e, j.e - j.s + 1 AS length, coalesce(min(frame_idx) FILTER (tp = 1) - j.s, j.e - j.s + 1) AS delay, CAST(any_value(miss_streak) AS INTEGER) AS miss_streak
FROM j JOIN m ON m.video_id = j.video_id AND m.s = j.s GROUP BY j.video_id, j.s, j.e"""
)
def segments_delay(spark, sf_dir):
    out = runs.segment_delay_miss(_tp_flags(views(spark, sf_dir)), F.col("flag"))
    return out.select("video_id", "s", "e", "length", "delay", F.col("miss_streak").cast("int").alias("miss_streak"))


@query(
    """, ev AS (
  SELECT user_id, event_id, event_type <> 'error' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), l AS (SELECT *, max(CASE WHEN hit THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS last FROM ev)
SELECT user_id, event_id, CAST(n - coalesce(last, 0) AS INTEGER) AS streak,
       CASE WHEN n - coalesce(last, 0) <= 1 THEN '0_1' WHEN n - coalesce(last, 0) <= 5 THEN '2_5' ELSE '6p' END AS bucket
FROM l"""
)
def no_det_streak(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    out = runs.streak_since(ev, F.col("event_type") != "error", "user_id", ["ts", "event_id"])
    return out.select("user_id", "event_id", F.col("streak").cast("int").alias("streak"), runs.streak_bucket(F.col("streak")).alias("bucket"))


_RUNS = """, i AS (
  SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, tp ORDER BY frame_idx) AS island FROM tpf
), r AS (SELECT video_id, tp, island, count(*) AS l, min(frame_idx) AS s FROM i GROUP BY ALL)
"""


@query(_FLAGS + _TP + _RUNS + "SELECT video_id, coalesce(max(l) FILTER (tp = 1), 0) >= 3 AS locked FROM r GROUP BY video_id")
def sustained_lock(spark, sf_dir):
    return runs.sustained_lock(_tp_flags(views(spark, sf_dir)), F.col("tp") == 1, ["video_id"], "frame_idx", 3)


@query(_FLAGS + _TP + _RUNS + "SELECT video_id, min(s) FILTER (tp = 1 AND l >= 2) AS start FROM r GROUP BY video_id")
def first_run_start(spark, sf_dir):
    return runs.first_run_start(_tp_flags(views(spark, sf_dir)), F.col("tp") == 1, ["video_id"], "frame_idx", 2)


@query(_FLAGS + _TP + _RUNS.replace("tp ORDER", "fn ORDER").replace("tp, island, count", "fn AS tp, island, count") + "SELECT video_id, coalesce(max(l) FILTER (tp = 1), 0) AS longest FROM r GROUP BY video_id")
def miss_streak(spark, sf_dir):
    return runs.longest_run(_tp_flags(views(spark, sf_dir)), F.col("fn") == 1, ["video_id"], "frame_idx")


# --- tiles -------------------------------------------------------------------------------------

_SIZES = ((1920, 1080), (2150, 921), (640, 360), (300, 700))
_GRID = """, sizes AS (SELECT * FROM (VALUES (1920, 1080), (2150, 921), (640, 360), (300, 700)) t(width, height)), axis AS (
  SELECT length, unnest(CASE WHEN length <= 512 THEN [0] ELSE list_distinct(list_concat(generate_series(0, length - 512, 409), [length - 512])) END) AS start
  FROM (SELECT width AS length FROM sizes UNION SELECT height FROM sizes)
), ranked AS (SELECT length, start, row_number() OVER (PARTITION BY length ORDER BY start) - 1 AS k, count(*) OVER (PARTITION BY length) AS n FROM axis), grid AS (
  SELECT width, height, CAST(b.k * a.n + a.k AS INTEGER) AS tile_id, CAST(a.start AS INTEGER) AS x, CAST(b.start AS INTEGER) AS y,
         CAST(least(512, width - a.start) AS INTEGER) AS w, CAST(least(512, height - b.start) AS INTEGER) AS h, CAST(b.k AS INTEGER) AS "row", CAST(a.k AS INTEGER) AS col
  FROM sizes JOIN ranked a ON a.length = width JOIN ranked b ON b.length = height
)
"""


def _sizes(spark) -> DataFrame:
    return spark.createDataFrame(list(_SIZES), "width int, height int")


@query(_GRID + 'SELECT width, height, tile_id, x, y, w, h, "row", col FROM grid')
def tile_grid(spark, sf_dir):
    return tiles.grid(_sizes(spark))


@query(
    """, sizes AS (SELECT unnest(generate_series(100, 4000, 50)) AS width, 1080 AS height)
SELECT CAST(width AS INTEGER) AS width,
       CAST((CASE WHEN width <= 512 THEN 1 ELSE ceil((width - 512) / (512 * (1 - CAST(0.2 AS DOUBLE)))) + 1 END) * (ceil((1080 - 512) / (512 * (1 - CAST(0.2 AS DOUBLE)))) + 1) AS INTEGER) AS estimated
FROM sizes"""
)
def tile_estimate(spark, sf_dir):
    sizes = spark.range(100, 4001, 50).select(F.col("id").cast("int").alias("width"), F.lit(1080).alias("height"))
    return sizes.select("width", tiles.estimated_tiles(F.col("width"), F.col("height"), 512, 512, 0.2, 0.2).cast("int").alias("estimated"))


@query(
    _GRID
    + """SELECT a.width, a.height, a.tile_id, b.tile_id AS near_id FROM grid a JOIN grid b ON a.width = b.width AND a.height = b.height
AND abs(a."row" - b."row") + abs(a.col - b.col) BETWEEN 1 AND 2"""
)
def tile_neighbors(spark, sf_dir):
    return tiles.neighbours(tiles.grid(_sizes(spark)), hops=2)


@query(
    _GRID
    + """SELECT a.width, a.height, a.tile_id, b.tile_id AS near_id FROM grid a JOIN grid b ON a.width = b.width AND a.height = b.height
AND greatest(abs(a."row" - b."row"), abs(a.col - b.col)) <= 1"""
)
def tile_neighbors_diagonal(spark, sf_dir):
    return tiles.neighbours(tiles.grid(_sizes(spark)), hops=1, diagonal=True, with_self=True)


@query(
    _GRID
    + """, ad AS (SELECT width, height, CASE WHEN greatest(width, height) > 512 * (4 - 3 * CAST(0.15 AS DOUBLE)) + 1 THEN 12 ELSE 6 END AS patches FROM sizes),
ab AS (SELECT *, CASE WHEN width >= height THEN CASE WHEN patches = 12 THEN 4 ELSE 3 END ELSE CASE WHEN patches = 12 THEN 3 ELSE 2 END END AS a FROM ad),
pp AS (SELECT *, patches // a AS b, ceil(greatest(width / (a - (a - 1) * CAST(0.15 AS DOUBLE)), height / (patches // a - (patches // a - 1) * CAST(0.15 AS DOUBLE)))) AS p FROM ab),
ss AS (SELECT *, greatest(1, round_even(p * (1 - CAST(0.15 AS DOUBLE)), 0)) AS s FROM pp),
cells AS (SELECT ss.*, r.i AS r, c.i AS c FROM ss JOIN (SELECT unnest(range(0, 4)) AS i) r ON r.i < b JOIN (SELECT unnest(range(0, 4)) AS i) c ON c.i < a)
SELECT width, height, patches, CAST(r * a + c AS INTEGER) AS tile_id, CAST(CASE WHEN p >= width THEN 0 ELSE least(c * s, width - p) END AS INTEGER) AS x,
       CAST(CASE WHEN p >= height THEN 0 ELSE least(r * s, height - p) END AS INTEGER) AS y, CAST(p AS INTEGER) AS w, CAST(p AS INTEGER) AS h, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col
FROM cells"""
)
def adaptive_tile_grid(spark, sf_dir):
    return tiles.adaptive_grid(_sizes(spark))


_SMALLGRID = """, xs AS (SELECT unnest([0, 204, 408, 384]) AS x), tl AS (
  SELECT CAST(r * 4 + c AS INTEGER) AS tile_id, xv AS x, yv AS y, 256 AS w, 256 AS h
  FROM (VALUES (0, 0), (1, 204), (2, 384)) a(c, xv), (VALUES (0, 0), (1, 104)) b(r, yv)
), tls AS (SELECT CAST((tile_id // 4) * 3 + tile_id % 4 AS INTEGER) AS tile_id, x, y, w, h FROM tl), placed AS (
  SELECT b.image_id, b.ord, t.tile_id FROM vx_gt b JOIN tls t ON t.x <= b.x + b.w / 2 AND b.x + b.w / 2 < t.x + t.w AND t.y <= b.y + b.h / 2 AND b.y + b.h / 2 < t.y + t.h
), chosen AS (
  SELECT DISTINCT p.image_id, t.tile_id FROM vx_pred p JOIN tls t ON t.x <= p.x + p.w / 2 AND p.x + p.w / 2 < t.x + t.w AND t.y <= p.y + p.h / 2 AND p.y + p.h / 2 < t.y + t.h WHERE p.score >= 0.5
)
"""


def _small_grid(v: adapt.Views) -> DataFrame:
    return tiles.grid(v.frames.sparkSession.createDataFrame([(adapt.WIDTH, adapt.HEIGHT)], "width int, height int"), 256, 256)


@query(_SMALLGRID + "SELECT image_id, ord, tile_id FROM placed")
def box_in_tile(spark, sf_dir):
    v = views(spark, sf_dir)
    return tiles.boxes_in_tiles(v.gt, v.frames, _small_grid(v))


@query(
    _SMALLGRID
    + """, n AS (SELECT DISTINCT image_id, tile_id FROM placed)
SELECT n.image_id, count(*) AS n_needed, count(c.tile_id) AS n_hit, round(count(c.tile_id) / count(*), 9) AS covered, count(c.tile_id) < count(*) AS miss
FROM n LEFT JOIN chosen c ON c.image_id = n.image_id AND c.tile_id = n.tile_id GROUP BY n.image_id"""
)
def oracle_coverage(spark, sf_dir):
    v = views(spark, sf_dir)
    grid = _small_grid(v)
    needed = tiles.boxes_in_tiles(v.gt, v.frames, grid)
    chosen = tiles.boxes_in_tiles(v.pred.where("score >= 0.5"), v.frames, grid)
    return tiles.coverage(chosen, needed).select("image_id", "n_needed", "n_hit", _r("covered"), "miss")


@query(
    _SMALLGRID
    + """SELECT c.image_id, round(sum(w * h) / CAST(230400 AS DOUBLE), 9) AS area_ratio FROM chosen c JOIN tls USING (tile_id) GROUP BY c.image_id"""
)
def tile_area_ratio(spark, sf_dir):
    v = views(spark, sf_dir)
    grid = _small_grid(v)
    chosen = tiles.boxes_in_tiles(v.pred.where("score >= 0.5"), v.frames, grid).select("image_id", "tile_id").distinct()
    return tiles.area_ratio(chosen, v.frames, grid).select("image_id", _r("area_ratio"))


# --- need --------------------------------------------------------------------------------------

_RESCUED = f""", small AS (SELECT * FROM vx_gt WHERE area <= 1500), on_hit AS (
  SELECT DISTINCT g.image_id, g.ord FROM small g JOIN vx_pred p ON g.image_id = p.image_id WHERE p.score >= 0.25 AND {iou_sql('g', 'p')} >= 0.5
), off_hit AS (
  SELECT DISTINCT g.image_id, g.ord FROM small g JOIN vx_pred p ON g.image_id = p.image_id WHERE p.score >= 0.6 AND {iou_sql('g', 'p')} >= 0.5
), rescued AS (
  SELECT s.* FROM small s SEMI JOIN on_hit o ON o.image_id = s.image_id AND o.ord = s.ord ANTI JOIN off_hit f ON f.image_id = s.image_id AND f.ord = s.ord
), new_obj AS (
  SELECT r.image_id, r.ord FROM rescued r JOIN vx_frames a ON a.image_id = r.image_id WHERE NOT EXISTS (
    SELECT 1 FROM small s JOIN vx_frames b ON b.image_id = s.image_id
    WHERE b.video_id = a.video_id AND b.frame_idx < a.frame_idx AND b.frame_idx >= a.frame_idx - 5
      AND sqrt(((r.x + r.w / 2) - (s.x + s.w / 2)) ** 2 + ((r.y + r.h / 2) - (s.y + s.h / 2)) ** 2) <= 20.5)
)
"""


def _need(v: adapt.Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Small boxes, and predictions without and with the verifier (here: all, and the sure ones)."""
    return need.small_boxes(v.gt, SMALL), v.pred.where("score >= 0.6"), v.pred.where(F.col("score") >= CONF)


@query(_RESCUED + "SELECT image_id, ord FROM rescued")
def rescued_gt(spark, sf_dir):
    return need.rescued(*_need(views(spark, sf_dir)), IOU).select("image_id", "ord")


@query(_RESCUED + "SELECT image_id, ord FROM new_obj")
def new_object_lookback(spark, sf_dir):
    v = views(spark, sf_dir)
    small, off, on = _need(v)
    return need.new_objects(need.rescued(small, off, on, IOU), small, need.time_index(v.frames), 5, 20.5).select("image_id", "ord")


_FAIL = _RESCUED + """, loose AS (
  SELECT s.image_id, bool_or(o.ord IS NOT NULL) AS on_ok, bool_or(f.ord IS NOT NULL) AS off_ok
  FROM small s LEFT JOIN on_hit o ON o.image_id = s.image_id AND o.ord = s.ord LEFT JOIN off_hit f ON f.image_id = s.image_id AND f.ord = s.ord GROUP BY s.image_id
), fails AS (SELECT image_id, on_ok AND NOT off_ok AS failure FROM loose)
"""


@query(
    _FAIL
    + """SELECT count(*) AS eval_frames, count(*) FILTER (failure) AS failure_frames, round(count(*) FILTER (failure) / count(*), 9) AS ffr,
       (SELECT count(*) FROM rescued) AS rescued_total, (SELECT count(*) FROM new_obj) AS rescued_new,
       round((SELECT count(*) FROM new_obj) / (SELECT count(*) FROM rescued), 9) AS nodr
FROM fails"""
)
def need_ffr(spark, sf_dir):
    v = views(spark, sf_dir)
    small, off, on = _need(v)
    saved = need.rescued(small, off, on, IOU)
    new = need.new_objects(saved, small, need.time_index(v.frames), 5, 20.5)
    t = need.need_summary(need.failure_frames(small, off, on, IOU, strict=False), saved, new)
    return t.select("eval_frames", "failure_frames", _r("ffr"), "rescued_total", "rescued_new", _r("nodr"))


@query(
    _FAIL
    + """, tt AS (SELECT image_id, video_id, row_number() OVER (ORDER BY frame_idx, image_id) - 1 AS t FROM vx_frames),
d AS (SELECT t - lag(t) OVER (ORDER BY t) AS delta FROM fails JOIN tt USING (image_id) WHERE failure)
SELECT count(*) AS n_intervals, round(avg(delta), 9) AS mean_delta, round(quantile_cont(delta, 0.95), 9) AS p95_delta,
       round(1 / avg(delta), 9) AS csf_mean, round(1 / quantile_cont(delta, 0.95), 9) AS csf_p95
FROM d WHERE delta IS NOT NULL"""
)
def csf_intervals(spark, sf_dir):
    v = views(spark, sf_dir)
    small, off, on = _need(v)
    t = need.intervals(need.failure_frames(small, off, on, IOU, strict=False), need.time_index(v.frames, per_video=False))
    return t.select("n_intervals", *[_r(c) for c in ("mean_delta", "p95_delta", "csf_mean", "csf_p95")])


# --- KPI tables --------------------------------------------------------------------------------


def _facts(v: adapt.Views) -> DataFrame:
    return kpi.frame_facts(v.frames, v.gt, v.pred, v.cost, IOU, CONF)


_FACTS = (
    _MATCHED
    + """, sm AS (SELECT image_id, count(*) AS n_gt, max(CAST(area / CAST(230400 AS DOUBLE) <= 0.01 AS INTEGER)) AS s0, max(CAST(area / CAST(230400 AS DOUBLE) <= 0.02 AS INTEGER)) AS s1 FROM vx_gt GROUP BY image_id),
ge AS (SELECT image_id, count(*) FILTER (score >= 0.3) AS a, count(*) FILTER (score >= 0.5) AS b, count(*) FILTER (score >= 0.7) AS c FROM vx_pred GROUP BY image_id), facts AS (
  SELECT f.image_id, f.video_id, f.frame_idx, coalesce(n_gt, 0) AS n_gt, coalesce(s0, 0) AS has_small_0, coalesce(s1, 0) AS has_small_1, coalesce(n_gt, 0) > 0 AS is_pos, coalesce(n_gt, 0) = 0 AS is_empty,
         tp, fp, fn, max_conf, coalesce(np.n, 0) AS n_pred, coalesce(a, 0) AS n_ge_03, coalesce(b, 0) AS n_ge_05, coalesce(c, 0) AS n_ge_07, verifier_on, tiles_used, latency_ms
  FROM vx_frames f JOIN fm USING (image_id) JOIN vx_cost USING (image_id) LEFT JOIN sm ON sm.image_id = f.image_id LEFT JOIN ge ON ge.image_id = f.image_id LEFT JOIN np ON np.image_id = f.image_id
)
"""
)


@query(_FACTS + "SELECT * FROM facts")
def frame_facts(spark, sf_dir):
    """The frame-grain table."""
    f = _facts(views(spark, sf_dir)).drop("width", "height")
    taus = [F.col("n_ge")[i].alias(n) for i, n in enumerate(("n_ge_03", "n_ge_05", "n_ge_07"))]
    return f.select(*[c for c in f.columns if c != "n_ge"], *taus)


@query(
    _FACTS
    + """, isl AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, is_pos ORDER BY frame_idx) AS island FROM facts),
sg AS (SELECT video_id, island, min(frame_idx) AS s, max(frame_idx) AS e, coalesce(min(frame_idx) FILTER (tp = 1) - min(frame_idx), count(*)) AS delay FROM isl WHERE is_pos GROUP BY ALL),
ms AS (SELECT video_id, island, frame_idx - row_number() OVER (PARTITION BY video_id, island, fn ORDER BY frame_idx) AS miss_run, fn FROM isl WHERE is_pos),
mr AS (SELECT video_id, island, max(l) AS miss FROM (SELECT video_id, island, CASE WHEN fn = 1 THEN count(*) ELSE 0 END AS l FROM ms GROUP BY video_id, island, fn, miss_run) GROUP BY ALL),
sv AS (SELECT video_id, count(*) AS num_segments, avg(delay) AS dm, quantile_cont(delay, 0.5) AS d5, quantile_cont(delay, 0.9) AS d9, avg(miss) AS mm, quantile_cont(miss, 0.9) AS m9 FROM sg JOIN mr USING (video_id, island) GROUP BY video_id)
SELECT f.video_id, count(*) AS num_frames, count(*) FILTER (is_pos) AS num_pos_frames, count(*) FILTER (is_empty) AS num_empty_frames,
       round(avg(verifier_on), 9) AS verifier_on_ratio, round(avg(tiles_used), 9) AS avg_tiles, round(avg(latency_ms), 9) AS avg_latency_ms,
       round(avg(tiles_used) FILTER (is_empty), 9) AS empty_avg_tiles, round(avg(tiles_used) FILTER (NOT is_empty), 9) AS pos_avg_tiles, max(has_small_0) AS has_small,
       round(count(*) FILTER (is_pos) / count(*), 9) AS presence_ratio, round(1000 / avg(latency_ms), 9) AS fps,
       round(coalesce(count(*) FILTER (is_empty AND verifier_on = 1) / nullif(count(*) FILTER (is_empty), 0), 0), 9) AS empty_verifier_on_ratio,
       round(coalesce(count(*) FILTER (NOT is_empty AND verifier_on = 1) / nullif(count(*) FILTER (NOT is_empty), 0), 0), 9) AS pos_verifier_on_ratio,
       round(coalesce(count(*) FILTER (is_empty AND fp > 0) / nullif(count(*) FILTER (is_empty), 0), 0), 9) AS empty_fp_rate,
       coalesce(any_value(num_segments), 0) AS num_segments, round(any_value(dm), 9) AS delay_mean, round(any_value(d5), 9) AS delay_p50, round(any_value(d9), 9) AS delay_p90,
       round(any_value(mm), 9) AS miss_mean, round(any_value(m9), 9) AS miss_p90
FROM facts f LEFT JOIN sv ON sv.video_id = f.video_id GROUP BY f.video_id"""
)
def frame_kpi_video(spark, sf_dir):
    t = kpi.per_video(_facts(views(spark, sf_dir)))
    exact = ("video_id", "num_frames", "num_pos_frames", "num_empty_frames", "num_segments", "has_small")
    return t.select(*[c if c in exact else _r(c) for c in t.columns])


@query(
    _MATCHED
    + """, e AS (SELECT image_id, image_id NOT IN (SELECT image_id FROM vx_gt) AS empty FROM vx_frames), j AS (SELECT * FROM fm JOIN e USING (image_id) JOIN vx_cost USING (image_id) LEFT JOIN np USING (image_id))
SELECT count(*) AS num_frames, count(*) FILTER (empty) AS num_empty_frames, CAST(sum(tp) AS BIGINT) AS tp_frames, count(*) FILTER (fp > 0) AS fp_frames, CAST(sum(fn) AS BIGINT) AS fn_frames,
       CAST(sum(coalesce(n, 0)) AS BIGINT) AS num_pred_boxes, count(*) FILTER (verifier_on = 1) AS verifier_on_frames, CAST(sum(tiles_used) AS BIGINT) AS total_tiles, CAST(sum(tiles_used) FILTER (verifier_on = 1) AS BIGINT) AS tiles_on,
       count(*) FILTER (empty AND verifier_on = 1) AS empty_on_frames, count(*) FILTER (empty AND fp > 0) AS empty_fp_frames, CAST(sum(tiles_used) FILTER (empty) AS BIGINT) AS empty_tiles,
       round(avg(latency_ms), 9) AS avg_latency_ms, round(count(*) FILTER (verifier_on = 1) / count(*), 9) AS verifier_on_ratio, round(CAST(sum(tiles_used) AS DOUBLE) / count(*), 9) AS avg_tiles,
       round(CAST(sum(tiles_used) FILTER (verifier_on = 1) AS DOUBLE) / count(*) FILTER (verifier_on = 1), 9) AS avg_tiles_on,
       round(count(*) FILTER (empty AND fp > 0) / count(*) FILTER (empty), 9) AS empty_fp_rate, round(1000 / avg(latency_ms), 9) AS fps
FROM j"""
)
def kpi_summary(spark, sf_dir):
    t = kpi.summary(_facts(views(spark, sf_dir)))
    fractions = ("avg_latency_ms", "verifier_on_ratio", "avg_tiles", "avg_tiles_on", "empty_fp_rate", "fps")
    return t.select(*[_r(c) if c in fractions else c for c in t.columns])


@query(
    """, small AS (SELECT image_id, count(*) AS n, max(CAST(area / CAST(230400 AS DOUBLE) <= 0.01 AS INTEGER)) AS s0, max(CAST(area / CAST(230400 AS DOUBLE) <= 0.02 AS INTEGER)) AS s1 FROM vx_gt GROUP BY image_id)
SELECT f.image_id, coalesce(n, 0) AS n_gt, coalesce(s0, 0) AS has_small_0, coalesce(s1, 0) AS has_small_1, coalesce(n, 0) > 0 AS is_pos, coalesce(n, 0) = 0 AS is_empty
FROM vx_frames f LEFT JOIN small s ON s.image_id = f.image_id"""
)
def gt_index(spark, sf_dir):
    v = views(spark, sf_dir)
    return kpi.gt_index(v.frames, v.gt).select("image_id", "n_gt", "has_small_0", "has_small_1", "is_pos", "is_empty")


@query(
    """SELECT verifier_on, count(*) AS frames, round(avg(latency_ms), 9) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 9) AS p50_ms, round(quantile_cont(latency_ms, 0.9), 9) AS p90_ms,
       round(quantile_cont(latency_ms, 0.95), 9) AS p95_ms, round(1000 / avg(latency_ms), 9) AS fps
FROM vx_cost GROUP BY verifier_on"""
)
def latency_percentiles(spark, sf_dir):
    t = kpi.latency_stats(views(spark, sf_dir).cost, "verifier_on")
    return t.select("verifier_on", "frames", *[_r(c) for c in ("mean_ms", "p50_ms", "p90_ms", "p95_ms", "fps")])


@query("SELECT video_id, list_sort(list(latency_ms))[CAST(floor(0.9 * (count(*) - 1)) AS INTEGER) + 1] AS p90_truncated FROM vx_cost JOIN vx_frames USING (image_id) GROUP BY video_id")
def truncated_percentiles(spark, sf_dir):
    v = views(spark, sf_dir)
    return v.cost.join(v.frames, "image_id").groupBy("video_id").agg(kpi.truncated_percentile(F.col("latency_ms"), 0.9).alias("p90_truncated"))


@query("SELECT tiles_used, count(*) AS n, round(count(*) / (SELECT count(*) FROM vx_cost), 9) AS share FROM vx_cost GROUP BY tiles_used")
def mode_histogram(spark, sf_dir):
    return kpi.histogram(views(spark, sf_dir).cost, "tiles_used").select("tiles_used", "n", _r("share"))


_STREAK = _FLAGS + """, np AS (SELECT f.*, EXISTS (SELECT 1 FROM vx_pred p WHERE p.image_id = f.image_id AND p.score >= 0.5) AS det FROM flags f),
ns AS (SELECT *, frame_idx + 1 - coalesce(max(CASE WHEN det THEN frame_idx + 1 END) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0) AS streak FROM np)
"""


@query(
    _STREAK
    + """, tagged AS (
  SELECT unnest(['all', 'streak_' || CASE WHEN streak <= 1 THEN '0_1' WHEN streak <= 5 THEN '2_5' ELSE '6p' END, CASE WHEN det THEN 'not_seed_empty' ELSE 'seed_empty' END]) AS bucket, tiles_used
  FROM ns JOIN vx_cost USING (image_id)
)
SELECT bucket, count(*) AS frames, round(avg(tiles_used), 9) AS mean_value FROM tagged GROUP BY bucket"""
)
def coverage_buckets(spark, sf_dir):
    v = views(spark, sf_dir)
    det = v.pred.where("score >= 0.5").select("image_id").distinct().withColumn("_d", F.lit(1))
    rows = v.frames.join(det, "image_id", "left").join(v.cost, "image_id")
    rows = runs.streak_since(rows, F.col("_d").isNotNull(), "video_id", ["frame_idx"])
    return kpi.coverage_buckets(rows, F.col("streak"), F.col("_d").isNull(), F.col("tiles_used")).select("bucket", "frames", _r("mean_value"))


# --- tracks ------------------------------------------------------------------------------------


def _tracks(v: adapt.Views) -> DataFrame:
    return tracks.pseudo_tracks(v.frames, v.gt, 0.3)


@query()
def pseudo_tracks(spark, sf_dir):
    return tracks.global_ids(_tracks(views(spark, sf_dir))).select("track_id", "video_id", "image_id", "ord", "pos")


@query()
def track_kpis(spark, sf_dir):
    v = views(spark, sf_dir)
    facts = tracks.track_facts(tracks.track_hits(_tracks(v), v.pred.where(F.col("score") >= CONF), IOU), 2)
    return tracks.track_kpis(facts)


@query()
def track_motion_sets(spark, sf_dir):
    v = views(spark, sf_dir)
    return tracks.evaluation_sets(_tracks(v), v.frames, v.gt, max_len=1, gap=2)


# --- state machines ----------------------------------------------------------------------------


def _frame_boxes(v: adapt.Views, score_thr: float = 0.5) -> DataFrame:
    """frames with an array of their predictions by score."""
    item = F.struct((-F.col("score")).alias("_n"), "ord", "x", "y", "w", "h", "score", "category_id")
    boxes = v.pred.where(F.col("score") >= score_thr).groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("boxes"))
    return v.frames.join(boxes, "image_id", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)))


@query()
def tracker_fold(spark, sf_dir):
    return state.fold(_frame_boxes(views(spark, sf_dir)), state.tracker())


@query()
def confirmation_gate(spark, sf_dir):
    return state.fold(_frame_boxes(views(spark, sf_dir)), state.confirmation_gate())


@query()
def confirmation_times(spark, sf_dir):
    return state.fold(_frame_boxes(views(spark, sf_dir)), state.confirmation_times())


_EMA = """, m AS (
  SELECT user_id, event_id, CAST(value AS DOUBLE) AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
)"""


@query(
    _EMA
    + """, lists AS (SELECT user_id, list(g ORDER BY n) AS gs, list(event_id ORDER BY n) AS ids FROM m GROUP BY user_id)
, w AS (SELECT user_id, unnest(ids) AS event_id, unnest(list_transform(range(1, len(gs) + 1), lambda k: list_sum(list_transform(range(1, k + 1), lambda i: 0.02::DOUBLE * gs[i] * pow(0.98::DOUBLE, k - i))))) AS mu FROM lists)
SELECT user_id, event_id, round(mu, 6) AS mu FROM w"""
)
def ema_mean(spark, sf_dir):
    """The exponential mean of the motion z-score, in closed form in SQL."""
    return _ema(spark, sf_dir).select("user_id", "event_id", F.round("mu", 6).alias("mu"))


def _ema(spark, sf_dir) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", F.col("value").cast("double").alias("motion"))
    return state.fold(ev, state.motion_z(), "user_id", ["ts", "event_id"], ["event_id"])


@query(
    _EMA
    + """, fold AS (
  SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS mu, CAST(1 AS DOUBLE) AS dev, CAST(0 AS DOUBLE) AS z FROM m
  UNION ALL
  SELECT user_id, event_id, n, mu, dev, (g - mu) / (dev + CAST(0.001 AS DOUBLE)) AS z FROM (
    SELECT *, CAST(0.98 AS DOUBLE) * old_dev + (1 - CAST(0.98 AS DOUBLE)) * abs(g - mu) AS dev FROM (
      SELECT m.user_id, m.event_id, m.n, m.g, f.dev AS old_dev, CAST(0.98 AS DOUBLE) * f.mu + (1 - CAST(0.98 AS DOUBLE)) * m.g AS mu FROM fold f JOIN m ON m.user_id = f.user_id AND m.n = f.n + 1))
)
SELECT user_id, event_id, round(mu, 6) AS mu, round(dev, 6) AS dev, round(z, 6) AS z FROM fold WHERE n > 0"""
)
def ema_zscore(spark, sf_dir):
    return _ema(spark, sf_dir).select("user_id", "event_id", *[F.round(c, 6).alias(c) for c in ("mu", "dev", "z")])


@query(
    """, fr AS (SELECT video_id, frame_idx, verifier_on = 1 AS wants FROM vx_frames JOIN vx_cost USING (image_id)), fold AS (
  SELECT DISTINCT video_id, -1 AS frame_idx, FALSE AS spent, CAST(2 AS DOUBLE) AS tokens FROM vx_frames
  UNION ALL
  SELECT video_id, frame_idx, wants AND t >= 1 AS spent, CASE WHEN wants AND t >= 1 THEN t - 1 ELSE t END AS tokens FROM (
    SELECT r.video_id, r.frame_idx, r.wants, least(CAST(2 AS DOUBLE), f.tokens + CAST(0.2 AS DOUBLE)) AS t FROM fold f JOIN fr r ON r.video_id = f.video_id AND r.frame_idx = f.frame_idx + 1)
)
SELECT video_id, frame_idx, spent, round(tokens, 9) AS tokens FROM fold WHERE frame_idx >= 0"""
)
def token_bucket(spark, sf_dir):
    v = views(spark, sf_dir)
    wants = v.frames.join(v.cost.select("image_id", (F.col("verifier_on") == 1).alias("wants")), "image_id")
    return state.fold(wants, state.token_bucket(rate=0.2)).select("video_id", "frame_idx", "spent", _r("tokens"))


def _evidence(v: adapt.Views) -> DataFrame:
    """Evidence of each frame from scalar signals: detections, tracker and motion of the views."""
    rows = _frame_boxes(v)
    tracked = state.fold(rows.select("video_id", "frame_idx", "image_id", "boxes"), state.tracker(), carry=["frame_idx", "image_id"])
    det = rows.select("image_id", (F.size("boxes") > 0).alias("has_det"), F.size("boxes").alias("n_det"))
    out = tracked.join(det, "image_id").join(v.cost.select("image_id", "latency_ms"), "image_id")
    out = runs.streak_since(out, F.col("has_det"), "video_id", ["frame_idx"], "no_det_streak")
    return out.select(
        "video_id",
        "frame_idx",
        "image_id",
        "has_det",
        F.col("no_det_streak").cast("int").alias("no_det_streak"),
        "num_active",
        "max_miss_streak",
        "recent_lost",
        ((F.col("latency_ms") - 10) / F.lit(10.0)).alias("motion_z"),
        F.lit(0.0).alias("motion_peak"),
        (F.col("image_id") % 7).cast("double").alias("diff_gap"),
        F.lit(2.0).alias("diff_std"),
        F.col("has_det").alias("has_target"),
        F.greatest(F.col("n_det") - 1, F.lit(0)).alias("num_unconfirmed"),
        F.least(F.col("n_det"), F.lit(1)).alias("num_confirmed"),
    )


@query()
def policy_v7(spark, sf_dir):
    return state.fold(_evidence(views(spark, sf_dir)), state.policy(7))


@query()
def policy_v6(spark, sf_dir):
    return state.fold(_evidence(views(spark, sf_dir)), state.policy(6))


@query()
def keyframe_burst(spark, sf_dir):
    return state.fold(_evidence(views(spark, sf_dir)), state.keyframe_burst(61))


@query()
def controller_generations(spark, sf_dir):
    """The controllers of generations 3 to 5 over the same signals, side by side."""
    e = _evidence(views(spark, sf_dir)).withColumns(
        {
            "risk": F.col("no_det_streak") / F.lit(2.0) + F.when(F.col("motion_z") > 1, F.lit(1.0)).otherwise(F.lit(0.0)),
            "tracking_fail": F.col("max_miss_streak") >= 3,
            "escape_soft": ~F.col("has_det") & (F.col("no_det_streak") >= 2),
            "escape_hard": F.col("no_det_streak") >= 6,
            "strong_skip": ~F.col("has_det") & (F.col("motion_z") < 0),
            "escape_soft_streak": F.col("no_det_streak"),
            "subset_ok": F.col("has_det"),
        }
    )
    keys = ["video_id", "frame_idx"]
    v3 = state.fold(e, state.heartbeat_controller()).select(*keys, F.col("mode").alias("mode_v3"))
    v4 = state.fold(e, state.priority_controller()).select(*keys, F.col("mode").alias("mode_v4"))
    v5 = state.fold(e, state.subset_first_controller()).select(*keys, F.col("mode").alias("mode_v5"), "fail_streak")
    return v3.join(v4, keys).join(v5, keys)


@query(
    "SELECT image_id, video_id, frame_idx, CASE WHEN frame_idx % 4 = 0 THEN 1 ELSE 0 END AS verifier_on FROM vx_frames"
)
def keyframe_schedule(spark, sf_dir):
    return views(spark, sf_dir).frames.select("image_id", "video_id", "frame_idx", (F.col("frame_idx") % 4 == 0).cast("int").alias("verifier_on"))


# --- AP, bootstrap -----------------------------------------------------------------------------


# A frame's detections by score take their best free box at each threshold (all boxes of these views are of one category and no
# crowds): one step of the recursion for each rank.  %s: a box's and a detection's range.
_AP = f""", det AS (
  SELECT p.image_id, p.ord, p.score, p.w * p.h AS area, row_number() OVER (PARTITION BY p.image_id ORDER BY p.score DESC, p.ord) AS r FROM vx_pred p
), thr AS (
  SELECT t, CAST(50 + 5 * t AS DOUBLE) / 100 AS v FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS t)
), ov AS MATERIALIZED (
  SELECT image_id, r, list({{'g': -go, 'i': v, 'o': go, 'a': a}} ORDER BY a DESC, v DESC, go DESC) AS boxes
  FROM (SELECT d.image_id, d.r, g.ord AS go, CAST(g.area BETWEEN %(low)s AND %(high)s AS INTEGER) AS a, {iou_sql('p', 'g')} AS v
        FROM det d JOIN vx_pred p ON p.image_id = d.image_id AND p.ord = d.ord JOIN vx_gt g ON g.image_id = d.image_id)
  WHERE v >= 0.5 GROUP BY ALL
), ms AS (
  SELECT DISTINCT image_id, t, v, CAST(0 AS BIGINT) AS r, CAST([] AS INTEGER[]) AS used, CAST(NULL AS INTEGER) AS box, 0 AS a FROM det, thr
  UNION ALL
  SELECT image_id, t, v, r, CASE WHEN m IS NULL THEN used ELSE list_append(used, m.o) END, m.o, coalesce(m.a, 0)
  FROM (SELECT s.image_id, s.t, s.v, d.r, s.used, list_filter(coalesce(o.boxes, []), lambda b: b.i >= s.v AND NOT list_contains(s.used, b.o))[1] AS m
        FROM ms s JOIN det d ON d.image_id = s.image_id AND d.r = s.r + 1 LEFT JOIN ov o ON o.image_id = d.image_id AND o.r = d.r)
), dt AS (
  SELECT m.t, d.score, d.image_id, d.ord, CAST(m.box IS NOT NULL AND m.a = 1 AS INTEGER) AS tp
  FROM ms m JOIN det d ON d.image_id = m.image_id AND d.r = m.r
  WHERE CASE WHEN m.box IS NULL THEN d.area BETWEEN %(low)s AND %(high)s ELSE m.a = 1 END
), ng AS (
  SELECT count(*) AS n FROM vx_gt WHERE area BETWEEN %(low)s AND %(high)s
), cv AS (
  SELECT t, sum(tp) OVER w AS tps, row_number() OVER w AS k, tp FROM dt WINDOW w AS (PARTITION BY t ORDER BY score DESC, image_id, ord ROWS UNBOUNDED PRECEDING)
), ht AS (
  SELECT t, tps / n AS recall, max(tps / k) OVER (PARTITION BY t ORDER BY tps DESC ROWS UNBOUNDED PRECEDING) AS best FROM cv, ng WHERE tp = 1
), pt AS (
  SELECT t, max(best) AS q FROM ht, (SELECT CAST(unnest(range(101)) AS DOUBLE) / 100 AS p) WHERE recall >= p GROUP BY t, p
), ap AS (
  SELECT thr.t, coalesce((SELECT sum(q) FROM pt WHERE pt.t = thr.t), 0) / 101 AS ap, coalesce((SELECT max(recall) FROM ht WHERE ht.t = thr.t), 0) AS recall FROM thr
)
"""


@query(_AP % {"low": 0, "high": 1e10} + "SELECT round(avg(ap), 7) AS ap, round(avg(ap) FILTER (t = 0), 7) AS ap50, round(avg(ap) FILTER (t = 5), 7) AS ap75, round(avg(recall), 7) AS ar_100 FROM ap")
def coco_ap(spark, sf_dir):
    v = views(spark, sf_dir)
    t = coco.summary(v.gt, v.pred)
    return t.select(*[F.round(c, 7).alias(c) for c in ("ap", "ap50", "ap75", "ar_100")])


@query(_AP % {"low": 0, "high": SMALL} + "SELECT round(avg(ap), 7) AS ap_small, round(avg(recall), 7) AS ar_small FROM ap")
def coco_ap_small(spark, sf_dir):
    v = views(spark, sf_dir)
    return coco.summary(v.gt, v.pred, areas=coco.split_at(SMALL)).select(*[F.round(c, 7).alias(c) for c in ("ap_small", "ar_small")])


@query()
def coco_by_category(spark, sf_dir):
    """All ranges and numbers of detections, with three categories and some crowds."""
    v = views(spark, sf_dir)
    category = (F.col("ord") % 3).cast("int")
    gt = v.gt.withColumns({"category_id": category, "iscrowd": (F.col("image_id") % 11 == 0).cast("int")})
    return coco.by_category(gt, v.pred.withColumn("category_id", category))


@query()
def bootstrap_ci(spark, sf_dir):
    v = views(spark, sf_dir)
    clips = splits.clip_presence(v.frames, v.gt)
    return bootstrap.mean_ci(clips, "presence", ["video_id"])


@query()
def bootstrap_track_ci(spark, sf_dir):
    v = views(spark, sf_dir)
    facts = tracks.track_facts(tracks.track_hits(_tracks(v), v.pred.where(F.col("score") >= CONF), IOU), 2)
    return bootstrap.track_ci(facts)


@query(
    _FLAGS
    + _TP
    + """SELECT c.verifier_on, flag AS has_gt, count(*) AS frames, CAST(sum(tp) AS BIGINT) AS tp_frames, CAST(sum(fn) AS BIGINT) AS fn_frames, round(sum(fn) / (SELECT sum(fn) FROM tpf), 9) AS fn_share
FROM tpf JOIN vx_cost c USING (image_id) GROUP BY c.verifier_on, flag"""
)
def miss_breakdown(spark, sf_dir):
    """Misses by verifier and ground truth, with each cell's share of all misses."""
    v = views(spark, sf_dir)
    t = _tp_flags(v).join(v.cost, "image_id").groupBy("verifier_on", F.col("flag").alias("has_gt")).agg(F.count("*").alias("frames"), F.sum("tp").alias("tp_frames"), F.sum("fn").alias("fn_frames"))
    total = F.sum("fn_frames").over(Window.partitionBy())  # four rows at most
    return t.select("verifier_on", "has_gt", "frames", "tp_frames", "fn_frames", _r(F.col("fn_frames") / total, "fn_share"))


# --- reports and ETL ---------------------------------------------------------------------------

_LOCATIONS = """, im AS (SELECT image_id, CAST(c_nationkey AS VARCHAR) AS location FROM vx_frames JOIN customer ON c_custkey = video_id)
, an AS (SELECT image_id, CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END AS category_id FROM vx_pred)
"""


def _located(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = views(spark, sf_dir)
    where = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("video_id"), F.col("c_nationkey").cast("string").alias("location"))
    notes = v.pred.select("image_id", F.when(F.col("ord") % 3 == 0, F.lit(0)).otherwise(F.lit(1)).alias("category_id"))
    return v.frames.join(where, "video_id").select("image_id", "location"), notes


@query(_LOCATIONS + "SELECT location, count(*) AS num_images, count(*) FILTER (category_id = 0) AS num_empty, round(count(*) FILTER (category_id = 0) / count(*), 9) AS empty_ratio FROM an JOIN im USING (image_id) GROUP BY location")
def location_stats(spark, sf_dir):
    return reports.location_stats(*_located(spark, sf_dir)).select("location", "num_images", "num_empty", _r("empty_ratio"))


@query(_LOCATIONS + """, d AS (SELECT image_id, location, min(CASE WHEN category_id = 0 THEN 1 ELSE 0 END) AS e FROM an JOIN im USING (image_id) GROUP BY ALL)
SELECT location, count(*) AS num_images, count(*) FILTER (e = 1) AS num_empty, round(count(*) FILTER (e = 1) / count(*), 9) AS empty_ratio FROM d GROUP BY location""")
def location_stats_distinct(spark, sf_dir):
    return reports.location_stats(*_located(spark, sf_dir), distinct_images=True).select("location", "num_images", "num_empty", _r("empty_ratio"))


@query(_LOCATIONS + """, st AS (SELECT location, count(*) AS n, count(*) FILTER (category_id = 0) AS e FROM an JOIN im USING (image_id) GROUP BY location),
rk AS (SELECT *, row_number() OVER (ORDER BY e / n DESC, n DESC, location) AS k FROM st), sz AS (SELECT CAST(unnest([2, 5, 10]) AS INTEGER) AS bundle_size)
SELECT bundle_size, string_agg(location, ',' ORDER BY k) AS locations, CAST(sum(n) AS BIGINT) AS num_images, CAST(sum(e) AS BIGINT) AS num_empty, round(CAST(sum(e) AS DOUBLE) / sum(n), 9) AS empty_ratio
FROM sz JOIN rk ON k <= bundle_size GROUP BY bundle_size""")
def location_bundles(spark, sf_dir):
    t = reports.bundles(reports.location_stats(*_located(spark, sf_dir)), [2, 5, 10])
    return t.select("bundle_size", F.array_join("locations", ",").alias("locations"), "num_images", "num_empty", _r("empty_ratio"))


@query(""", un AS (SELECT image_id, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2 FROM (SELECT image_id, x, y, w, h FROM vx_gt UNION ALL SELECT image_id, x, y, w, h FROM vx_pred) GROUP BY image_id),
mg AS (SELECT image_id, greatest(0, x1 - 120) AS x1, greatest(0, y1 - 120) AS y1, least(640, x2 + 120) AS x2, least(360, y2 + 120) AS y2 FROM un),
wd AS (SELECT *, greatest(0, (240 - (x2 - x1)) / 2) AS mx, greatest(0, (220 - (y2 - y1)) / 2) AS my FROM mg)
SELECT f.image_id, round(coalesce(greatest(0, x1 - mx), CAST(0 AS DOUBLE)), 9) AS x1, round(coalesce(greatest(0, y1 - my), CAST(0 AS DOUBLE)), 9) AS y1,
       round(coalesce(least(640, x2 + mx), CAST(640 AS DOUBLE)), 9) AS x2, round(coalesce(least(360, y2 + my), CAST(360 AS DOUBLE)), 9) AS y2 FROM vx_frames f LEFT JOIN wd ON wd.image_id = f.image_id""")
def focus_windows(spark, sf_dir):
    v = views(spark, sf_dir)
    return reports.focus_windows(v.frames, v.gt, v.pred).select("image_id", *[_r(c) for c in ("x1", "y1", "x2", "y2")])


_CLIPS = _FLAGS + """, cl AS (SELECT f.video_id, CASE WHEN c_nationkey % 3 = 0 THEN 'holdout' ELSE 'dev' END AS split, c_nationkey AS location, count(*) AS n, count(*) FILTER (flag) / count(*) AS r
  FROM flags f JOIN customer ON c_custkey = f.video_id GROUP BY ALL),
li AS (SELECT split, count(DISTINCT location) AS num_locations, count(*) AS num_clips, CAST(sum(n) AS BIGINT) AS num_frames, sum(round_even(r * n, 0)) AS p, list_sort(list(r)) AS rs FROM cl GROUP BY split)
"""


@query(_CLIPS + """SELECT split, num_locations, num_clips, num_frames, round(p / num_frames, 9) AS overall_presence,
       round(rs[CAST(floor(0.25 * (len(rs) - 1)) AS INTEGER) + 1], 9) AS clip_presence_p25, round(rs[CAST(floor(0.5 * (len(rs) - 1)) AS INTEGER) + 1], 9) AS clip_presence_p50, round(rs[CAST(floor(0.75 * (len(rs) - 1)) AS INTEGER) + 1], 9) AS clip_presence_p75 FROM li""")
def split_report(spark, sf_dir):
    v = views(spark, sf_dir)
    where = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("video_id"), F.col("c_nationkey").alias("location"))
    clips = splits.clip_presence(v.frames, v.gt).join(where, "video_id").withColumn("split", F.when(F.col("location") % 3 == 0, F.lit("holdout")).otherwise(F.lit("dev")))
    t = reports.split_report(clips)
    return t.select("split", "num_locations", "num_clips", "num_frames", *[_r(c) for c in t.columns[4:]])


@query("""SELECT CASE WHEN video_id % 2 = 0 THEN video_id || '_val' ELSE CAST(video_id AS VARCHAR) END AS video_id, image_id FROM vx_frames WHERE frame_idx % 3 = 0
UNION ALL SELECT CAST(video_id AS VARCHAR), image_id FROM vx_frames WHERE video_id % 2 = 0 AND frame_idx % 3 = 1""")
def merged_sequences(spark, sf_dir):
    """Even videos stand in both lists."""
    f = views(spark, sf_dir).frames.select("video_id", "image_id", "frame_idx")
    even = f.where("video_id % 2 = 0")
    a, b = even.where("frame_idx % 3 = 1"), f.where("frame_idx % 3 = 0")
    known = even.select("video_id").distinct()
    a = a.drop("frame_idx").unionByName(known.withColumn("image_id", F.lit(None).cast("long")))  # a video without such a frame is known as well
    return splits.merge_sequences(a, b.drop("frame_idx")).where("image_id is not null")


@query(_LOCATIONS + """, bd AS (SELECT * FROM (VALUES (0.2, '1'), (0.2, '5'), (0.05, '5'), (0.05, '7')) AS t(ratio, location))
SELECT CASE WHEN ratio = 0.2 THEN 'target20' ELSE 'target05' END AS tag, image_id FROM im JOIN bd USING (location)""")
def target_subsets(spark, sf_dir):
    images, _ = _located(spark, sf_dir)
    bundles = spark.createDataFrame([(0.2, ["1", "5", "5"]), (0.05, ["5", "7"])], "target_empty_ratio double, locations array<string>")
    return splits.target_subsets(images, bundles).select("tag", "image_id")


@query("""SELECT 'score' AS "column", CAST(unnest([0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]) AS DOUBLE) AS q,
       round(unnest(quantile_cont(score, [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0])), 9) AS value FROM vx_pred""")
def score_quantiles(spark, sf_dir):
    return reports.quantile_table(views(spark, sf_dir).pred, ["score"]).select("column", "q", _r("value"))


@query()
def policy_log_summary(spark, sf_dir):
    plans = state.fold(_evidence(views(spark, sf_dir)), state.policy(7)).select("mode", F.col("k").alias("num_tiles"), "risk", (F.col("reason") == "seed_empty_skip").alias("seed_empty"))
    return reports.mode_log(plans, ["seed_empty"])


@query()
def budget_stats(spark, sf_dir):
    return reports.budget_stats(state.fold(_evidence(views(spark, sf_dir)), state.policy(7)))


@query()
def confirmation_stats(spark, sf_dir):
    rows = _frame_boxes(views(spark, sf_dir))
    gate = state.fold(rows, state.confirmation_gate())
    times = state.fold(rows, state.confirmation_times())
    return reports.confirmation_stats(gate.join(times, ["video_id", "frame_idx"]))


@query()
def tile_plans(spark, sf_dir):
    """Policy budgets turned into tiles: tracks protect, scores explore."""
    v = views(spark, sf_dir)
    grid = [(x, y, 256, 256) for y in (0, 104) for x in (0, 204, 384)]
    budget = state.fold(_evidence(v), state.policy(7, k_full=len(grid)), carry=["frame_idx", "image_id"])
    rows = budget.join(_frame_boxes(v).select("image_id", F.col("boxes").alias("tracks")), "image_id")
    score = lambda m: F.array(*[((F.col("image_id") * (i + m)) % 11).cast("double") for i in range(len(grid))])
    rows = rows.withColumns({"diff": score(3), "motion": score(5), "hard": F.col("reason").startswith("seed_empty")})
    return state.fold(rows, planner.tile_planner(grid, planner.PlannerConfig(memory_ttl=2)))


@query(_LOCATIONS + """, s AS (SELECT image_id, location, image_id % 5 = 0 OR location IN ('1', '3') AS keep FROM im)
SELECT image_id, location FROM s WHERE keep""")
def keep_by_either(spark, sf_dir):
    images, _ = _located(spark, sf_dir)
    rows = images.withColumnRenamed("location", "seq_id")
    kept = etl.keep_by_either(rows, rows.where("image_id % 5 = 0"), rows.where("seq_id in ('1', '3')"))
    return kept.select("image_id", F.col("seq_id").alias("location"))


@query("SELECT video_id, frame_idx AS t, image_id, 1 AS verifier_on, 15 AS tiles_used, CAST(0 AS DOUBLE) AS latency_ms FROM vx_frames")
def dense_cost_log(spark, sf_dir):
    return etl.static_cost_log(views(spark, sf_dir).frames, True, 15)


@query("""SELECT string_split(n, '/')[1] AS location, string_split(n, '/')[2] AS session, string_split(n, '/')[3] AS base_name, c_custkey
FROM (SELECT c_custkey, 'loc' || c_nationkey || '/' || c_mktsegment || '/' || c_name AS n FROM customer)""")
def parsed_file_names(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    names = c.select("c_custkey", F.concat(F.lit("loc"), "c_nationkey", F.lit("/"), "c_mktsegment", F.lit("/"), "c_name").alias("file_name"))
    return etl.parsed_names(names).select("location", "session", "base_name", "c_custkey")


@query(f""", best AS (SELECT p.image_id, p.ord, max({iou_sql('p', 'g')}) AS v FROM vx_pred p LEFT JOIN vx_gt g ON p.image_id = g.image_id GROUP BY ALL)
SELECT image_id, ord, round(coalesce(v, CAST(0 AS DOUBLE)), 9) AS best_iou FROM best""")
def best_iou(spark, sf_dir):
    v = views(spark, sf_dir)
    return matching.best_overlap(v.gt, v.pred, B.iou, "best_iou").select("image_id", "ord", _r(F.coalesce("best_iou", F.lit(0.0)), "best_iou"))


@query(_FAIL + """, lm AS (SELECT image_id, CASE WHEN image_id % 4 = 0 THEN 'full' WHEN image_id % 3 = 0 THEN 'subset' ELSE 'skip' END AS mode FROM vx_frames WHERE image_id % 7 <> 0),
j AS (SELECT f.image_id, mode FROM fails f LEFT JOIN lm ON lm.image_id = f.image_id WHERE failure)
SELECT count(*) AS num_failures, count(*) FILTER (mode IS NULL) AS missing, count(*) FILTER (mode = 'skip') AS n_skip, count(*) FILTER (mode = 'subset') AS n_subset,
       count(*) FILTER (mode = 'full') AS n_full, round(count(*) FILTER (mode = 'skip') / (count(*) - count(*) FILTER (mode IS NULL)), 9) AS skip_rate FROM j""")
def skipped_failures(spark, sf_dir):
    v = views(spark, sf_dir)
    fails = need.failure_frames(*_need(v), IOU, strict=False).where("failure")
    mode = F.when(F.col("image_id") % 4 == 0, F.lit("full")).when(F.col("image_id") % 3 == 0, F.lit("subset")).otherwise(F.lit("skip"))
    log = v.frames.where("image_id % 7 <> 0").select("image_id", F.lit(0).alias("ord"), mode.alias("mode"))
    t = reports.skipped_failures(fails, log)
    return t.select(*t.columns[:-1], _r("skip_rate"))


# --- signals -----------------------------------------------------------------------------------


@query(""", a AS (SELECT image_id, list(score ORDER BY ord) AS v FROM vx_pred GROUP BY image_id)
SELECT image_id, round(list_avg(v), 9) AS mean, round(list_stddev_pop(v), 9) AS std, round(list_aggregate(v, 'quantile_cont', 0.95), 9) AS p95, round(list_aggregate(v, 'quantile_cont', 0.99), 9) AS p99,
       round(list_reverse_sort(v)[1] - coalesce(list_reverse_sort(v)[2], CAST(0 AS DOUBLE)), 9) AS top1_gap FROM a""")
def score_array_stats(spark, sf_dir):
    rows = views(spark, sf_dir).pred.groupBy("image_id").agg(F.collect_list("score").alias("v"))
    return rows.select("image_id", *[_r(c, n) for n, c in signals.array_stats(F.col("v")).items()])


@query("""SELECT event_id, user_id, round(coalesce(abs(v - lag(v, 4) OVER w), CAST(0 AS DOUBLE)), 9) AS motion,
       round(avg(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS accumulated
FROM (SELECT *, CAST(value AS DOUBLE) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def motion_signals(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = ev.select("user_id", "event_id", F.col("value").cast("double").alias("v"), F.row_number().over(order).alias("n"))
    rows = signals.accumulated(signals.lagged_difference(ev, "v", 4, "user_id", "n"), "v", 5, "user_id", "n", "accumulated")
    return rows.select("event_id", "user_id", _r("motion"), _r("accumulated"))


@query(""", q AS (SELECT quantile_cont(latency_ms, 0.8) AS a, quantile_cont(tiles_used, 0.5) AS b FROM vx_cost)
SELECT 'overall' AS bucket, image_id FROM vx_cost
UNION ALL SELECT CASE WHEN latency_ms <= a THEN 'latency_ms_low' ELSE 'latency_ms_high' END, image_id FROM vx_cost, q
UNION ALL SELECT CASE WHEN tiles_used <= b THEN 'tiles_used_low' ELSE 'tiles_used_high' END, image_id FROM vx_cost, q""")
def percentile_buckets(spark, sf_dir):
    return signals.threshold_buckets(views(spark, sf_dir).cost, {"latency_ms": 0.8, "tiles_used": 0.5})


@query(""", s AS (SELECT image_id, count(*) AS n, max(score) AS top, max(score) - coalesce(list_reverse_sort(list(score))[2], CAST(0 AS DOUBLE)) AS margin FROM vx_pred GROUP BY image_id),
x AS (SELECT f.image_id, coalesce(n, 0) AS n, coalesce(top, CAST(0 AS DOUBLE)) AS top, coalesce(margin, CAST(0 AS DOUBLE)) AS margin, CAST(f.image_id % 3 AS DOUBLE) AS m, f.image_id % 5 = 0 AS fail FROM vx_frames f LEFT JOIN s ON s.image_id = f.image_id),
y AS (SELECT *, n > 0 AND (top < 0.15 OR margin < 0.05) AS u, m < 1 AS still FROM x)
SELECT image_id, still AS low_motion, u AS uncertain, CAST(CAST(still AND (u OR fail OR n = 0) AS INTEGER) + CAST(fail AS INTEGER) + CAST(u AS INTEGER) AS DOUBLE) AS risk FROM y""")
def additive_risk(spark, sf_dir):
    v = views(spark, sf_dir)
    s = v.pred.groupBy("image_id").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.sort_array(F.collect_list("score"), False).alias("_s"))
    zero = F.lit(0.0)
    rows = v.frames.join(s, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", zero).alias("top"), F.coalesce(F.get("_s", 0) - F.coalesce(F.get("_s", 1), zero), zero).alias("margin"))
    r = signals.additive_risk((F.col("image_id") % 3).cast("double"), F.lit(100.0), F.col("n"), F.col("top"), F.col("margin"), F.col("image_id") % 5 == 0)
    return rows.select("image_id", *[r[k].alias(k) for k in ("low_motion", "uncertain", "risk")])


@query(_STREAK + """SELECT image_id, soft AS escape_soft, soft AND streak >= 6 AS escape_hard, NOT det AND z < -1 AND streak >= 4 AS strong_skip
FROM (SELECT *, NOT det AND NOT z < -1 AND (z > 1.5 OR streak >= 3) AS soft FROM (SELECT *, CAST(image_id % 7 AS DOUBLE) - 3 AS z FROM ns))""")
def escape_rules(spark, sf_dir):
    v = views(spark, sf_dir)
    det = v.pred.where("score >= 0.5").select("image_id").distinct().withColumn("_d", F.lit(1))
    rows = runs.streak_since(v.frames.join(det, "image_id", "left"), F.col("_d").isNotNull(), "video_id", ["frame_idx"])
    n = F.coalesce("_d", F.lit(0))
    e = signals.escapes((F.col("image_id") % 7).cast("double") - F.lit(3.0), n, n, F.col("streak"), F.col("streak"), soft=3, hard=6, skip=4)
    return rows.select("image_id", *[c.alias(k) for k, c in e.items()])


@query()
def event_and_negative_windows(spark, sf_dir):
    """Windows around segments and negative windows, in numbers that bring the flagged share to 0.4."""
    flags = _flags(views(spark, sf_dir))
    neg = runs.sliding_windows(flags, 6, 2, 0.5).select("video_id", "start", "end", "pos_frames", "len_frames")
    marks = flags.select("video_id", "frame_idx", F.col("flag").cast("int").alias("f"))
    ev = splits.balanced(splits.event_windows(flags, 6, (1, 3), 5), 200, 2, 5).drop("type")
    pos = splits.window_frames(ev, flags).join(marks, ["video_id", "frame_idx"]).groupBy("video_id", "start").agg(F.sum("f").alias("pos_frames"), F.count("*").alias("len_frames"))
    return splits.with_negatives(ev.join(pos, ["video_id", "start"]), neg, 0.4, 0.01, 3)


@query(_SMALLGRID + """, n AS (SELECT DISTINCT image_id, tile_id FROM placed),
cov AS (SELECT n.image_id, count(c.tile_id) < count(*) AS miss FROM n LEFT JOIN chosen c ON c.image_id = n.image_id AND c.tile_id = n.tile_id GROUP BY n.image_id),
sg AS (SELECT miss, signal, v FROM (SELECT miss, latency_ms, CAST(tiles_used AS DOUBLE) AS tiles_used FROM cov JOIN vx_cost USING (image_id)) UNPIVOT (v FOR signal IN (latency_ms, tiles_used)))
SELECT signal, round(avg(v) FILTER (miss), 7) AS mean_miss, round(stddev_pop(v) FILTER (miss), 7) AS std_miss, round(avg(v), 7) AS mean_all, round(stddev_pop(v), 7) AS std_all FROM sg GROUP BY signal""")
def miss_signal_table(spark, sf_dir):
    v = views(spark, sf_dir)
    grid = _small_grid(v)
    miss = tiles.coverage(tiles.boxes_in_tiles(v.pred.where("score >= 0.5"), v.frames, grid), tiles.boxes_in_tiles(v.gt, v.frames, grid))
    t = signals.miss_signals(miss.join(v.cost, "image_id"), "miss", ["latency_ms", "tiles_used"])
    return t.select("signal", *[F.round(c, 7).alias(c) for c in t.columns[1:]])
