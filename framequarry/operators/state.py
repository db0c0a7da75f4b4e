"""State machines over a video's frames: pure steps (state, row) -> (state, output).

Each machine has `start()`, a `step` and the columns of its output.  `fold` runs one over every video of
a table in batch; framequarry.streaming runs the very same steps on streams.  States are plain tuples of
numbers and lists, so they can be kept in a state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Step = Callable[[dict, dict], tuple[dict, dict]]


def iou(a, b) -> float:
    """Boxes as (x, y, w, h)."""
    wide = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    high = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if wide <= 0 or high <= 0:
        return 0.0
    union = a[2] * a[3] + b[2] * b[3] - wide * high
    return wide * high / union if union > 0 else 0.0


@dataclass(frozen=True)
class Machine:
    """A named step with its start state and the types of what it returns for each frame."""

    name: str
    start: Callable[[], dict]
    step: Step
    output: tuple[tuple[str, T.DataType], ...]

    def run(self, rows: Iterator[dict]) -> Iterator[dict]:
        state = self.start()
        for row in rows:
            state, out = self.step(state, row)
            yield out


def fold(df: DataFrame, machine: Machine, key: str = "video_id", order: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Run the machine over each key's rows in order; returns key, the carried columns and its output.

    A video's frames are one sequence by definition, so its rows meet in one task.
    """
    order = order or ["frame_idx"]
    carry = carry or order
    names = list(dict.fromkeys([key, *carry]))
    schema = T.StructType([df.schema[n] for n in names] + [T.StructField(n, t) for n, t in machine.output])
    target = to_arrow_schema(schema)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, first = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            outputs = []
            for at in range(0, batch.num_rows, 256):  # rows as Python objects: a few at a time
                for row in batch.slice(at, 256).to_pylist():
                    if first or row[key] != current:
                        current, state, first = row[key], machine.start(), False
                    state, out = machine.step(state, row)
                    outputs.append(out)
            own = [pa.array([o[n] for o in outputs], target.field(n).type) for n, _ in machine.output]
            yield pa.RecordBatch.from_arrays([batch.column(n).cast(target.field(n).type) for n in names] + own, schema=target)

    # one shuffle by key; within a task the rows stream by, so memory holds a batch and one state
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(step, schema)


# --- motion z-score ----------------------------------------------------------------------------


def motion_z(alpha_mu: float = 0.98, alpha_dev: float = 0.98, eps: float = 1e-3, column: str = "motion") -> Machine:
    """Exponential mean and mean absolute deviation; z uses both after their update."""

    def step(s: dict, row: dict):
        g = float(row[column])
        mu = alpha_mu * s["mu"] + (1 - alpha_mu) * g
        dev = alpha_dev * s["dev"] + (1 - alpha_dev) * abs(g - mu)
        return {"mu": mu, "dev": dev}, {"mu": mu, "dev": dev, "z": (g - mu) / (dev + eps)}

    return Machine("motion_z", lambda: {"mu": 0.0, "dev": 1.0}, step, (("mu", T.DoubleType()), ("dev", T.DoubleType()), ("z", T.DoubleType())))


# --- tracker -----------------------------------------------------------------------------------


def tracker(iou_thr: float = 0.3, max_miss: int = 3, history: int = 5, lost_window: int = 5, column: str = "boxes") -> Machine:
    """Tracks in the order of their birth take their best free detection; those that miss too often end.

    Boxes: array of (x, y, w, h, score).  A frame reports active tracks, the largest miss streak, the mean
    instability (1 - IoU of a track's last two boxes) and whether a track was lost lately.
    """

    def step(s: dict, row: dict):
        found = [tuple(b[k] for k in ("x", "y", "w", "h", "score")) for b in row[column]]
        free, alive, ended = set(range(len(found))), [], 0
        for t in s["tracks"]:
            scores = {j: iou(t["box"], found[j]) for j in sorted(free)}
            j = max(scores, key=lambda k: (scores[k], -k), default=None)
            if j is not None and scores[j] > 0 and scores[j] >= iou_thr:
                free.discard(j)
                alive.append({"id": t["id"], "box": found[j][:4], "miss": 0, "age": t["age"] + 1, "past": [*t["past"], found[j][:4]][-history:]})
            elif t["miss"] < max_miss:
                alive.append({**t, "miss": t["miss"] + 1, "age": t["age"] + 1})
            else:
                ended += 1
        born = [{"id": s["next"] + k, "box": found[j][:4], "miss": 0, "age": 1, "past": [found[j][:4]]} for k, j in enumerate(sorted(free))]
        tracks = alive + born
        lost = lost_window if ended else max(0, s["lost"] - 1)
        shaky = [1.0 - min(1.0, max(0.0, iou(t["past"][-2], t["past"][-1]))) if len(t["past"]) > 1 else 0.0 for t in tracks]
        out = {"num_active": len(tracks), "max_miss_streak": max((t["miss"] for t in tracks), default=0), "instability": sum(shaky) / len(shaky) if shaky else 0.0, "recent_lost": lost > 0, "num_new": len(born), "num_ended": ended}
        return {"tracks": tracks, "next": s["next"] + len(born), "lost": lost}, out

    kinds = (("num_active", T.IntegerType()), ("max_miss_streak", T.IntegerType()), ("instability", T.DoubleType()), ("recent_lost", T.BooleanType()), ("num_new", T.IntegerType()), ("num_ended", T.IntegerType()))
    return Machine("tracker", lambda: {"tracks": [], "next": 1, "lost": 0}, step, kinds)


def stability_tracker(iou_thr: float = 0.3, max_miss: int = 2, column: str = "boxes") -> Machine:
    """Only how many tracks there are, how many ended, and whether two or more of at least two are gone at once."""
    inner = tracker(iou_thr, max_miss, history=2, column=column)

    def step(s: dict, row: dict):
        after, out = inner.step(s, row)
        before, now = len(s["tracks"]), out["num_active"]
        return after, {"num_tracks": now, "num_dropped": out["num_ended"], "tracking_fail": before >= 2 and now <= before - 2}

    return Machine("stability_tracker", inner.start, step, (("num_tracks", T.IntegerType()), ("num_dropped", T.IntegerType()), ("tracking_fail", T.BooleanType())))


# --- confirmation ------------------------------------------------------------------------------


def confirmation_gate(iou_thr: float = 0.4, confirm_len: int = 2, max_age: int = 2, column: str = "boxes") -> Machine:
    """A box is confirmed if a candidate of its class that overlaps it has been matched confirm_len times."""

    def step(s: dict, row: dict):
        boxes = [(tuple(b[k] for k in ("x", "y", "w", "h")), b["category_id"]) for b in row[column]]
        old = [{**c, "age": c["age"] + 1} for c in s["cands"]]
        taken: set[int] = set()
        new = []
        for b, cls in boxes:
            best = max(((iou(c["box"], b), -j) for j, c in enumerate(old) if j not in taken and c["cls"] == cls), default=(0.0, 0))
            if best[0] > 0 and best[0] >= iou_thr:
                j = -best[1]
                taken.add(j)
                old[j] = {"box": b, "cls": cls, "streak": old[j]["streak"] + 1, "age": 0}
            else:
                new.append({"box": b, "cls": cls, "streak": 1, "age": 0})
        cands = [c for c in old + new if c["age"] <= max_age]
        sure = lambda b, cls: any(c["cls"] == cls and c["streak"] >= confirm_len and iou(c["box"], b) >= iou_thr for c in cands)
        n = len(boxes) if confirm_len <= 1 else sum(sure(b, cls) for b, cls in boxes)
        return {"cands": cands}, {"num_in": len(boxes), "num_confirmed": n, "num_unconfirmed": len(boxes) - n, "num_candidates": len(cands)}

    kinds = tuple((n, T.IntegerType()) for n in ("num_in", "num_confirmed", "num_unconfirmed", "num_candidates"))
    return Machine("confirmation_gate", lambda: {"cands": []}, step, kinds)


def confirmation_times(iou_thr: float = 0.4, confirm_len: int = 2, max_age: int = 2, column: str = "boxes", t: str = "frame_idx") -> Machine:
    """Time to confirmation: candidates of any class that several boxes may share; hits count while frames follow each other."""

    def step(s: dict, row: dict):
        now = int(row[t])
        cands = [dict(c) for c in s["cands"] if now - c["last"] <= max_age]
        for b in row[column]:
            at = tuple(b[k] for k in ("x", "y", "w", "h"))
            best = max(((iou(c["box"], at), -j) for j, c in enumerate(cands)), default=(0.0, 0))
            if best[0] > 0 and best[0] >= iou_thr:
                c = cands[-best[1]]
                follows = c["last"] == now - 1
                c.update(box=at, hits=c["hits"] + 1 if follows else 1, first=c["first"] if follows else now, last=now)
            else:
                cands.append({"box": at, "first": now, "last": now, "hits": 1, "done": False})
        times = []
        for c in cands:
            if not c["done"] and c["hits"] >= confirm_len:
                c["done"] = True
                times.append(c["last"] - c["first"] + 1)
        return {"cands": cands}, {"newly_confirmed": len(times), "ttc_list": times}

    return Machine("confirmation_times", lambda: {"cands": []}, step, (("newly_confirmed", T.IntegerType()), ("ttc_list", T.ArrayType(T.IntegerType()))))


# --- budget and policies -----------------------------------------------------------------------


def token_bucket(rate: float = 0.1, cap: float = 2.0, cost: float = 1.0, column: str = "wants") -> Machine:
    """A bucket refilled once a frame; a frame that wants to spend does so if the tokens suffice."""

    def step(s: dict, row: dict):
        tokens = min(cap, s["tokens"] + rate)
        spend = bool(row[column]) and tokens >= cost
        tokens -= cost if spend else 0.0
        return {"tokens": tokens}, {"spent": spend, "tokens": tokens}

    return Machine("token_bucket", lambda: {"tokens": cap}, step, (("spent", T.BooleanType()), ("tokens", T.DoubleType())))


class Tier(NamedTuple):
    """Frames from this risk on get a budget of `low` to `high` tiles."""

    risk: float
    low: int
    high: int


class Bucket(NamedTuple):
    """Tokens a frame, most tokens, tokens that one exploration takes."""

    rate: float
    cap: float
    cost: float


class Verify(NamedTuple):
    """Full frames of a burst, frames between bursts, unconfirmed boxes that ask for one, and whether confirmed boxes forbid it."""

    burst: int
    cooldown: int
    unconfirmed: int
    without_confirmed: bool


#: Fixed values of the risk policies: terms of the risk (weight, scale); tiers; streaks of high risk and of failures that
#: force full frames, and how many; shares of the budget that protect, with and without tracks; verification; token buckets
#: of frames without a seed that look empty and that look positive; peak of motion and relative gap of the difference that
#: look positive.
RISK_TERMS = {"det": (0.45, 3.0), "track": (0.45, 3.0), "lost": (0.25, 1.0), "motion": (0.05, 3.0), "diff": (0.05, 5.0)}
MID, HIGH = Tier(0.33, 2, 3), Tier(0.66, 4, 6)
DEADLINE = (5, 2, 2)
PROTECT = (0.7, 0.1)
VERIFY = Verify(1, 5, 1, True)
EMPTY_BUCKET, POSITIVE_BUCKET = Bucket(0.1, 2.0, 1.0), Bucket(0.15, 2.0, 1.0)
LIKELY = (1e9, 1.5)


@dataclass(frozen=True)
class PolicyConfig:
    """Settings of the risk policies by part (generation 6 has no buckets and no verification). pos None: one bucket for all."""

    terms: dict = field(default_factory=lambda: dict(RISK_TERMS))
    motion_zero: float = 0.0
    tiers: tuple[Tier, Tier] = (MID, HIGH)
    deadline: tuple[int, int, int] = DEADLINE
    protect: tuple[float, float] = PROTECT
    verify: Verify | None = VERIFY
    empty: Bucket = EMPTY_BUCKET
    pos: Bucket | None = POSITIVE_BUCKET
    likely: tuple[float, float] = LIKELY


def risk_of(e: dict, c: PolicyConfig) -> float:
    """Weighted sum of clipped terms, clipped to [0, 1]."""
    clip = lambda v: min(1.0, max(0.0, v))
    raw = {"det": e["no_det_streak"], "track": e["max_miss_streak"], "lost": bool(e["recent_lost"]), "motion": e["motion_z"] - c.motion_zero, "diff": e["diff_gap"] / (e["diff_std"] + 1e-6)}
    return clip(sum(weight * clip(raw[name] / max(1e-6, scale)) for name, (weight, scale) in c.terms.items()))


def _cause(e: dict) -> str:
    causes = (("track_lost", e["recent_lost"]), ("track_miss", e["max_miss_streak"] > 0), ("no_det", e["no_det_streak"] > 0), ("motion", e["motion_z"] > 0))
    return next((name for name, holds in causes if holds), "risk")


def _between(low: int, high: int, at: float) -> int:
    """A budget between two limits; round() is half to even."""
    return max(low, min(high, round(low + at * max(high - low, 0))))


def policy(generation: int = 7, config: PolicyConfig = PolicyConfig(), k_full: int = 15) -> Machine:
    """Risk to tile budget.

    Rows carry the evidence: has_det, no_det_streak, num_active, max_miss_streak, recent_lost, motion_z,
    motion_peak, diff_gap, diff_std; and the feedback of the frame: has_target, num_unconfirmed, num_confirmed.
    Generation 6 explores every frame without a seed; 7 pays such frames from token buckets and verifies
    unconfirmed boxes with a burst of full frames.
    """
    c = config
    (mid_risk, *mid), (high_risk, *high) = ((t.risk, min(t.low, k_full), min(t.high, k_full)) for t in c.tiers)
    late_risk, late_fail, late_frames = c.deadline
    budgeted = generation >= 7
    buckets = {"empty": c.empty} | ({"pos": c.pos} if c.pos else {})
    some = "subset"

    def start() -> dict:
        return {"ttl": 0, "risk_streak": 0, "fail_streak": 0, "verify": 0, "cooldown": 0, "empty": c.empty.cap, "pos": c.pos.cap if c.pos else 0.0}

    def empty_frame(s: dict, e: dict, risk: float) -> tuple[str, int, str, str]:
        """mode, budget, reason, bucket of a frame without detections and tracks."""
        if not budgeted:
            k = max(high[0], mid[1])
            return (some if high[0] else "skip"), k, "seed_empty", "none"
        if risk < mid_risk:
            return "skip", 0, "seed_empty_skip", "none"
        likely = bool(c.pos) and (e["has_det"] or e["motion_peak"] >= c.likely[0] or e["diff_gap"] / max(1e-6, e["diff_std"]) >= c.likely[1])
        bucket = "pos" if likely else "empty"
        price = buckets[bucket].cost
        if s[bucket] < price:
            return "skip", 0, f"{bucket}_budget_skip", "none"
        s[bucket] -= price
        k = _between(*mid, (risk - mid_risk) / max(1e-6, high_risk - mid_risk))
        return (some if mid[0] else "skip"), k, "pos_budget_explore" if likely else "seed_empty_explore", bucket

    def plan(s: dict, e: dict, risk: float, empty: bool) -> tuple[str, int, str, str]:
        if s["ttl"] > 0:
            s["ttl"] -= 1
            return ("full" if k_full else "skip"), k_full, "ttl", "none"
        if k_full and s["risk_streak"] >= late_risk and s["fail_streak"] >= late_fail:
            s["ttl"] = max(0, late_frames - 1)
            return "full", k_full, "csf_deadline", "none"
        if empty:
            return empty_frame(s, e, risk)
        for least, most, (low, top) in ((high_risk, 1.0, high), (mid_risk, high_risk, mid)):
            if risk >= least:
                return (some if low else "skip"), _between(low, top, (risk - least) / max(1e-6, most - least)), _cause(e), "none"
        return "skip", 0, "low_risk", "none"

    def feedback(s: dict, e: dict, mode: str, risk: float, empty: bool) -> None:
        s["risk_streak"] = s["risk_streak"] + 1 if risk >= high_risk else 0
        looked = mode != "skip" and (empty or e["no_det_streak"] > 0)
        s["fail_streak"] = 0 if e["has_target"] else s["fail_streak"] + looked
        if budgeted and c.verify and c.verify.burst > 0 and s["cooldown"] == 0:
            if e["num_unconfirmed"] >= c.verify.unconfirmed and not (c.verify.without_confirmed and e["num_confirmed"] > 0):
                s["verify"], s["cooldown"] = c.verify.burst, c.verify.cooldown

    def step(state: dict, e: dict):
        s = dict(state)
        before = {b: s[b] for b in ("empty", "pos")}
        if budgeted:
            for name, bucket in buckets.items():
                s[name] = min(bucket.cap, s[name] + bucket.rate)
            s["verify"], s["cooldown"] = (s["verify"], max(0, s["cooldown"] - 1)) if c.verify else (0, 0)
        charged = {b: s[b] for b in before}
        own = risk_of(e, c)
        empty = e["num_active"] == 0 and not e["has_det"]
        tracked = c.protect[0 if e["num_active"] > 0 else 1]
        if s["verify"] > 0:
            s["verify"] -= 1
            mode, k, reason, bucket, shown, protect = ("full_burst" if k_full else "skip"), k_full, "verify_burst", "none", 1.0, tracked
        else:
            mode, k, reason, bucket = plan(s, e, own, empty)
            shown, protect = own, min(0.1, c.protect[1]) if empty else tracked
        feedback(s, e, mode, own, empty)
        out = {"mode": mode, "risk": float(shown), "k": int(k), "protect_frac": min(1.0, max(0.0, protect)), "reason": reason, "bucket_used": bucket, "empty_tokens": float(s["empty"]), "pos_tokens": float(s["pos"])}
        for name in before:  # the ledger: tokens before the frame, what it brought and what it spent
            out |= {f"{name}_before": float(before[name]), f"{name}_recharged": float(charged[name] - before[name]), f"{name}_spent": float(charged[name] - s[name])}
        return s, out

    ledger = tuple((f"{b}_{what}", T.DoubleType()) for b in ("empty", "pos") for what in ("before", "recharged", "spent"))
    kinds = (("mode", T.StringType()), ("risk", T.DoubleType()), ("k", T.IntegerType()), ("protect_frac", T.DoubleType()), ("reason", T.StringType()), ("bucket_used", T.StringType()), ("empty_tokens", T.DoubleType()), ("pos_tokens", T.DoubleType()), *ledger)
    return Machine(f"policy_v{generation}", start, step, kinds)


#: Tiles of a subset and the confidence threshold of hard frames in the burst experiments, by number.
BURST_PARAMETERS = {60: (3, 0.25), 61: (3, 0.15), 62: (4, 0.25)}
#: Frames without a detection from which an empty frame is hard.
HARD_STREAK = 6


def keyframe_burst(experiment: int = 60, k_full: int = 15, burst: int = 1, cooldown: int = 1, conf: float = 0.25) -> Machine:
    """Burst experiments: full frames on long empty stretches, `cooldown` frames apart, subsets at medium risk.

    Rules in order, the first that holds decides: name, mode, whether the hard threshold applies.
    """
    k_subset, hard_conf = BURST_PARAMETERS[experiment]
    tiles = {"skip": 0, "subset": k_subset, "full_burst": k_full}

    def step(state: dict, e: dict):
        wait = max(0, state["cool"] - 1)
        calm = e["has_det"] or 0 < e["num_active"] and e["max_miss_streak"] <= 1
        hard = not calm and e["num_active"] == 0 and e["no_det_streak"] >= HARD_STREAK
        opens = hard and wait == 0 and k_full > 0
        left = burst - 1 if opens else state["left"]
        goes_on = left > 0 and k_full > 0  # also in the frame that opened it
        rules = (
            (goes_on, "hard_case_full_cont", "full_burst", True),
            (opens, "hard_case_full", "full_burst", True),
            (calm, "low_risk", "skip", False),
            (hard, "hard_case_subset", "subset", True),
            (True, "mid_risk", "subset", False),
        )
        reason, mode, strict = next(rule[1:] for rule in rules if rule[0])
        return {"cool": cooldown if opens else wait, "left": left - goes_on}, {"mode": mode, "k": tiles[mode], "reason": reason, "conf_thr": hard_conf if strict else conf}

    kinds = (("mode", T.StringType()), ("k", T.IntegerType()), ("reason", T.StringType()), ("conf_thr", T.DoubleType()))
    return Machine(f"keyframe_burst_{experiment}", lambda: {"cool": 0, "left": 0}, step, kinds)


def heartbeat_controller(max_gap: int = 10, min_gap: int = 2, risk_tau: float = 1.0, t: str = "frame_idx") -> Machine:
    """Generation 3: a full frame at least every max_gap; between, subsets on risk or tracking failure, min_gap apart."""

    def step(s: dict, row: dict):
        gap = row[t] - s["last"] if s["last"] is not None else max_gap
        if gap >= max_gap:
            mode = "full"
        elif gap >= min_gap and (row["tracking_fail"] or row["risk"] >= risk_tau):
            mode = "subset"
        else:
            mode = "skip"
        return {"last": row[t] if mode != "skip" else s["last"]}, {"mode": mode, "is_anchor": mode == "full"}

    return Machine("controller_v3", lambda: {"last": None}, step, (("mode", T.StringType()), ("is_anchor", T.BooleanType())))


def priority_controller(max_gap: int = 10, min_gap: int = 2, risk_tau: float = 1.0, risk_full: float = 2.0, full_on_fail: bool = True, t: str = "frame_idx") -> Machine:
    """Generation 4: the first rule that holds decides (hard escape, anchor, gap, soft escape, strong skip, failure, risk)."""

    def step(s: dict, row: dict):
        gap = row[t] - s["last"] if s["last"] is not None else max(max_gap, min_gap)
        anchor = gap >= max_gap
        rules = (
            ("full", row["escape_hard"]),
            ("full", anchor),
            ("skip", gap < min_gap),
            ("subset", row["escape_soft"]),
            ("skip", row["strong_skip"]),
            ("full", row["tracking_fail"] and full_on_fail),
            ("full", row["risk"] >= risk_full),
            ("subset", row["risk"] >= risk_tau),
        )
        mode = next((m for m, holds in rules if holds), "skip")
        return {"last": row[t] if mode != "skip" else s["last"]}, {"mode": mode, "is_anchor": bool(anchor and not row["escape_hard"])}

    return Machine("controller_v4", lambda: {"last": None}, step, (("mode", T.StringType()), ("is_anchor", T.BooleanType())))


def subset_first_controller(soft_streak: int = 2, fail_full: int = 2, full_ttl: int = 3, min_interval: int = 0, t: str = "frame_idx") -> Machine:
    """Generation 5: subsets on soft-escape streaks; hard escapes and failed subsets give full frames for a while.

    Rows: escape_soft_streak, escape_hard, strong_skip and subset_ok, whether a subset of this frame succeeds.
    """

    def step(s: dict, row: dict):
        ttl, fails, last = s["ttl"], s["fails"], s["last"]
        was_full = s["mode"] == "full"
        forced = False
        if row["escape_hard"]:
            mode, ttl, fails = "full", full_ttl, fails if was_full else 0
        elif ttl > 0:
            mode, ttl, fails = "full", ttl - 1, fails if was_full else 0
        elif fails >= fail_full:
            mode, ttl, fails = "full", max(0, full_ttl - 1), 0
        elif was_full and not row["strong_skip"]:
            mode, forced = "subset", True
        elif row["escape_soft_streak"] >= soft_streak and (min_interval <= 0 or last is None or row[t] - last >= min_interval):
            mode, last = "subset", row[t]
        else:
            mode = "skip"
        if mode == "subset":
            fails = 0 if row["subset_ok"] else fails + 1
        return {"mode": mode, "ttl": ttl, "fails": fails, "last": last}, {"mode": mode, "fail_streak": fails, "ttl_left": ttl, "forced": forced}

    kinds = (("mode", T.StringType()), ("fail_streak", T.IntegerType()), ("ttl_left", T.IntegerType()), ("forced", T.BooleanType()))
    return Machine("controller_v5", lambda: {"mode": None, "ttl": 0, "fails": 0, "last": None}, step, kinds)


def explore_memory(ttl: int, column: str = "chosen") -> Machine:
    """Tiles stay remembered for `ttl` frames after they were chosen; a frame reports those still remembered."""

    def step(s: dict, row: dict):
        left = {k: v - 1 for k, v in s["left"].items() if v > 1}
        kept = sorted(int(k) for k in left)
        left.update({str(t): ttl for t in row[column]} if ttl > 0 else {})
        return {"left": left}, {"remembered": kept}

    return Machine("explore_memory", lambda: {"left": {}}, step, (("remembered", T.ArrayType(T.IntegerType())),))
