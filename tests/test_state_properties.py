"""State machines: naive versions on random input, and invariants that must hold for any evidence."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from framequarry.operators import state
from framequarry.operators.state import iou


def boxes(rng, n):
    return [{"x": float(rng.randint(0, 20)), "y": float(rng.randint(0, 20)), "w": float(rng.randint(5, 12)), "h": float(rng.randint(5, 12)), "score": rng.random(), "category_id": rng.randint(1, 2)} for _ in range(n)]


def xywh(b):
    return b["x"], b["y"], b["w"], b["h"]


def test_tracker_naive():
    for seed in range(20):
        rng = random.Random(seed)
        rows = [{"boxes": boxes(rng, rng.randint(0, 4))} for _ in range(40)]
        alive, born, lost = [], 0, 0  # alive: [box, misses]
        for row, out in zip(rows, state.tracker(0.3, 2, 5, 3).run(rows)):
            free, ended, new = list(range(len(row["boxes"]))), 0, 0
            for t in list(alive):
                best = None
                for j in free:
                    v = iou(t[0], xywh(row["boxes"][j]))
                    if v >= 0.3 and (best is None or v > best[0]):
                        best = (v, j)
                if best:
                    free.remove(best[1])
                    t[0], t[1] = xywh(row["boxes"][best[1]]), 0
                else:
                    t[1] += 1
                    if t[1] > 2:
                        alive.remove(t)
                        ended += 1
            for j in free:
                alive.append([xywh(row["boxes"][j]), 0])
                new += 1
            born += new
            lost = 3 if ended else max(0, lost - 1)
            assert (out["num_active"], out["num_new"], out["num_ended"], out["recent_lost"]) == (len(alive), new, ended, lost > 0)
            assert out["max_miss_streak"] == max((t[1] for t in alive), default=0) and 0 <= out["instability"] <= 1


def test_gate_naive():
    for seed in range(20):
        rng = random.Random(seed)
        rows = [{"boxes": boxes(rng, rng.randint(0, 4))} for _ in range(40)]
        cands = []  # [box, class, streak, age]
        for row, out in zip(rows, state.confirmation_gate(0.4, 3, 1).run(rows)):
            for c in cands:
                c[3] += 1
            used, fresh = [], []
            for b in row["boxes"]:
                best = None
                for c in cands:
                    if any(c is u for u in used) or c[1] != b["category_id"]:
                        continue
                    v = iou(c[0], xywh(b))
                    if v >= 0.4 and (best is None or v > best[0]):
                        best = (v, c)
                if best:
                    used.append(best[1])
                    best[1][0], best[1][2], best[1][3] = xywh(b), best[1][2] + 1, 0
                else:
                    fresh.append([xywh(b), b["category_id"], 1, 0])
            cands = [c for c in cands + fresh if c[3] <= 1]
            sure = sum(any(c[1] == b["category_id"] and c[2] >= 3 and iou(c[0], xywh(b)) >= 0.4 for c in cands) for b in row["boxes"])
            assert (out["num_confirmed"], out["num_unconfirmed"], out["num_candidates"]) == (sure, len(row["boxes"]) - sure, len(cands))


EVIDENCE = st.fixed_dictionaries(
    {
        "has_det": st.booleans(),
        "no_det_streak": st.integers(0, 12),
        "num_active": st.integers(0, 3),
        "max_miss_streak": st.integers(0, 4),
        "recent_lost": st.booleans(),
        "motion_z": st.floats(-3, 6),
        "motion_peak": st.floats(0, 10),
        "diff_gap": st.floats(0, 10),
        "diff_std": st.floats(0, 5),
        "has_target": st.booleans(),
        "num_unconfirmed": st.integers(0, 2),
        "num_confirmed": st.integers(0, 2),
    }
)


@settings(max_examples=150, deadline=None)
@given(st.lists(EVIDENCE, max_size=40), st.integers(0, 15))
def test_policy_invariants(rows, k_full):
    out = list(state.policy(7, k_full=k_full).run(rows))
    bursts = [t for t, o in enumerate(out) if o["mode"] == "full_burst"]
    assert all(b - a >= 5 for a, b in zip(bursts, bursts[1:]))  # the cooldown lies between bursts
    for t, (e, o) in enumerate(zip(rows, out)):
        assert 0 <= o["k"] <= k_full and 0 <= o["risk"] <= 1 and 0 <= o["empty_tokens"] <= 2 and 0 <= o["pos_tokens"] <= 2
        assert (o["mode"] == "skip") == (o["k"] == 0)
        if o["mode"] == "full_burst":
            assert rows[t - 1]["num_unconfirmed"] >= 1 and rows[t - 1]["num_confirmed"] == 0
        if o["bucket_used"] != "none":
            assert e["num_active"] == 0 and not e["has_det"] and o["risk"] >= 0.33
    spent = sum(o["bucket_used"] == "empty" for o in out)
    assert spent <= 2 + 0.1 * len(out) + 1e-9  # no more than the bucket ever held
    again = list(state.policy(7, k_full=k_full).run(rows))
    assert again == out


@settings(max_examples=100, deadline=None)
@given(st.lists(EVIDENCE, max_size=30))
def test_generation_6(rows):
    for e, o in zip(rows, state.policy(6).run(rows)):
        assert o["mode"] != "full_burst" and o["bucket_used"] == "none"
        if e["num_active"] == 0 and not e["has_det"] and o["reason"] not in ("ttl", "csf_deadline"):
            assert (o["mode"], o["k"], o["reason"]) == ("subset", 4, "seed_empty")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=30), st.integers(1, 4))
def test_explore_memory(choices, ttl):
    rows = [{"chosen": sorted(set(c))} for c in choices]
    last = {}
    for t, (row, out) in enumerate(zip(rows, state.explore_memory(ttl).run(rows))):
        assert out["remembered"] == sorted(k for k, s in last.items() if t - s < ttl)
        last.update(dict.fromkeys(row["chosen"], t))


def test_keyframe_burst():
    quiet = {"has_det": False, "num_active": 0, "max_miss_streak": 0}
    rows = [{**quiet, "no_det_streak": k} for k in (1, 6, 7, 8, 9)] + [{**quiet, "has_det": True, "no_det_streak": 0}]
    out = list(state.keyframe_burst(61, burst=2, cooldown=3).run(rows))
    assert [o["mode"] for o in out] == ["subset", "full_burst", "subset", "subset", "full_burst", "skip"]
    assert [o["reason"] for o in out][:3] == ["mid_risk", "hard_case_full_cont", "hard_case_subset"]
    assert out[1]["conf_thr"] == 0.15
