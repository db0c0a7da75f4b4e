"""Tile plans: tiles that protect tracks, tiles that explore, and their union within a budget.

Pure functions over one frame, and `tile_planner`, the state machine that remembers explored tiles.
Score ties go to the smaller tile id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

from .state import Machine

Tile = tuple[int, int, int, int]


def rows_and_columns(tiles: Sequence[Tile]) -> list[tuple[int, int]]:
    """Row and column of each tile: the ranks of its y and x."""
    ys, xs = sorted({t[1] for t in tiles}), sorted({t[0] for t in tiles})
    return [(ys.index(t[1]), xs.index(t[0])) for t in tiles]


def covering(tiles: Sequence[Tile], x: float, y: float) -> list[int]:
    return [i for i, (a, b, w, h) in enumerate(tiles) if a <= x < a + w and b <= y < b + h]


def around(tiles: Sequence[Tile], seeds: Sequence[int], hops: int, diagonal: bool = False) -> list[int]:
    """Tiles within `hops` steps of a seed, without the seeds."""
    place = rows_and_columns(tiles)
    far = (lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1]))) if diagonal else (lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1]))
    return [i for i in range(len(tiles)) if i not in seeds and any(far(place[i], place[s]) <= hops for s in seeds)]


def protected(tiles: Sequence[Tile], tracks: Sequence[tuple[float, float, float, float, float]], k: int, hops: int = 1) -> list[int]:
    """Up to k tiles: for tracks (x, y, w, h, score) by score, those under the centre, then their neighbours."""
    out: dict[int, None] = {}
    for x, y, w, h, _ in sorted(tracks, key=lambda t: -t[4]):
        seeds = covering(tiles, x + w / 2, y + h / 2)
        out.update(dict.fromkeys(seeds))
        out.update(dict.fromkeys(around(tiles, seeds, hops)))
        if len(out) >= k:
            break
    return list(out)[: max(0, k)]


def percentile(values: Sequence[float], q: float) -> float:
    s = sorted(values)
    at = q / 100 * (len(s) - 1)
    low = int(at)
    return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)


def peaks(scores: Sequence[float], q: float) -> list[float]:
    """Scores from the q-th percentile on count 1.1 times, others a tenth."""
    if not scores:
        return []
    limit = percentile(scores, q)
    return [s * ((s >= limit) + 0.1) for s in scores]


def scored(scores: Sequence[float], mode: str) -> list[float]:
    return peaks(scores, {"p95": 95.0, "p99": 99.0, "top1_gap": 95.0}[mode]) if mode in ("p95", "p99", "top1_gap") else list(scores)


def sized(values: Sequence[float], n: int) -> list[float]:
    """The first n values, then zeros."""
    return [*values, *[0.0] * n][:n]


def blended(diff: Sequence[float], motion: Sequence[float], source: str) -> list[float]:
    """The explore score of each tile: one signal, or both, each over its maximum where that is above 0; a shorter signal ends in zeros."""
    if source in ("diff", "motion"):
        return list(diff if source == "diff" else motion)

    def share(v: Sequence[float]) -> list[float]:
        top = max(v, default=0.0)
        return [x / (top + 1e-6) for x in v] if top > 0 else list(v)

    n = max(len(diff), len(motion))
    return [a + b for a, b in zip(share(sized(diff, n)), share(sized(motion, n)))]


def with_row_quota(ranked: Sequence[int], tiles: Sequence[Tile], k: int, both_ends: bool) -> list[int]:
    """The k best, but the best of the top row first and, with both_ends, then that of the bottom row (else of the middle)."""
    row = [r for r, _ in rows_and_columns(tiles)]
    last = max(row, default=0)
    if last == 0 or k <= 0:
        return list(ranked[: max(0, k)])
    best = lambda rows, gone: next((t for r in rows for t in ranked if row[t] == r and t not in gone), None)
    first = [t for t in [best([0], ())] if t is not None]
    if both_ends and k >= 2:
        second = best([last, 1 if last >= 2 else last], first)
        first += [second] if second is not None else []
    return [*first, *(t for t in ranked if t not in first)][:k]


@dataclass(frozen=True)
class PlannerConfig:
    extra: int = 6
    hops: int = 1
    score_mode: str = "mean"
    row_quota: bool = False
    both_ends: bool = False
    memory_ttl: int = 0
    source: str = "mixed"
    #: memory applies always, or where the row's `gap` (top1_gap) or `motion_z` (motion) is below this limit, if it is above 0
    memory_when: str = "always"
    memory_limit: float = 0.0


def tile_planner(tiles: Sequence[Tile], config: PlannerConfig = PlannerConfig()) -> Machine:
    """Rows: mode, k, protect_frac, tracks (array of x, y, w, h, score), diff and motion (score of each tile), hard, and what memory_when asks for.

    hard: no seed and no detection for long; only then quota and memory apply.
    """
    c = config

    def step(s: dict, row: dict):
        k = int(row["k"])
        if row["mode"] == "full_burst":
            every = list(range(len(tiles)))
            return s, {"tiles": every, "tiles_protect": [], "tiles_explore": every, "tile_mode": "full_burst"}
        if k <= 0:
            return s, {"tiles": [], "tiles_protect": [], "tiles_explore": [], "tile_mode": "off"}
        left = {t: n - 1 for t, n in s["left"].items() if n > 1}
        k_protect = max(0, min(k, round(row["protect_frac"] * k)))
        k_explore = k - k_protect
        tracks = [tuple(t[f] for f in ("x", "y", "w", "h", "score")) for t in row["tracks"]]
        protect = protected(tiles, tracks, k_protect, c.hops)
        scores = sized(scored(blended(row["diff"], row["motion"], c.source), c.score_mode), len(tiles))
        explore = []
        if k_explore:
            ranked = sorted(range(len(scores)), key=lambda i: (-scores[i], i))[: k_explore + c.extra]
            signal = {"top1_gap": "gap", "motion": "motion_z"}.get(c.memory_when)
            calm = signal is None or c.memory_limit <= 0 or row[signal] < c.memory_limit
            remembers = row["hard"] and c.memory_ttl > 0 and calm
            if remembers:
                ranked = list(dict.fromkeys([*map(int, left), *ranked]))
            explore = with_row_quota(ranked, tiles, k_explore, c.both_ends) if row["hard"] and c.row_quota else ranked[:k_explore]
            if remembers:
                left.update({str(t): c.memory_ttl for t in explore})
        both = list(dict.fromkeys([*protect, *explore]))[:k]
        mode = "off" if not both else "protect" if not explore else "explore" if not protect else "mixed"
        return {"left": left}, {"tiles": both, "tiles_protect": protect, "tiles_explore": explore, "tile_mode": mode}

    ids = T.ArrayType(T.IntegerType())
    return Machine("tile_planner", lambda: {"left": {}}, step, (("tiles", ids), ("tiles_protect", ids), ("tiles_explore", ids), ("tile_mode", T.StringType())))


def subset_tiles(tiles: Sequence[Tile], seeds: Sequence[tuple[float, float]], scores: Sequence[float], k_min: int = 2, k_max: int = 6, hops: int = 1, top: int = 2) -> list[int]:
    """Older selectors: tiles under seeds, their neighbours, then the best by score; between k_min and k_max."""
    under = sorted({t for x, y in seeds for t in covering(tiles, x, y)})
    ranked = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    out = list(dict.fromkeys([*under, *around(tiles, under, hops), *ranked[:top]]))
    out += [t for t in ranked if t not in out][: max(0, k_min - len(out))]
    return out[:k_max]


def round_robin(n_tiles: int, k: int, stride: int, cursor: int) -> tuple[list[int], int]:
    """k tiles from the cursor on, `stride` apart, and the next cursor."""
    if n_tiles <= 0 or k <= 0:
        return [], cursor
    return [(cursor + i * stride) % n_tiles for i in range(k)], (cursor + k * stride) % n_tiles


def budget_tiles(scores: Sequence[float], active: Sequence[int], k_max: int, k_min: int, threshold: float, keep_active: bool = True) -> list[int]:
    """Active tiles by id, then others by score from the threshold on, at least k_min; k_max at most (score ties: the smaller id)."""
    first = [t for t in sorted(active) if 0 <= t < len(scores)][:k_max] if keep_active else []
    if keep_active and len(first) >= k_max and first:
        return first
    rest = sorted((t for t in range(len(scores)) if t not in first), key=lambda t: (-scores[t], t))
    out = [*first, *[t for t in rest if scores[t] >= threshold][: max(0, k_max - len(first))]]
    out += [t for t in rest if t not in out][: max(0, k_min - len(out))]
    return out[:k_max]


def activity(k_max: int, k_min: int, threshold: float, lifetime: int) -> Machine:
    """A budget scheduler: tiles stay active for `lifetime` frames after a detection. Rows: scores (of each tile), hit_tiles (of this frame)."""

    def step(s: dict, row: dict):
        chosen = budget_tiles(row["scores"], [int(t) for t in s["left"]], k_max, k_min, threshold)
        left = {t: n - 1 for t, n in s["left"].items() if n > 1} | {str(t): lifetime for t in row["hit_tiles"]}
        return {"left": left}, {"tiles": chosen}

    return Machine("activity", lambda: {"left": {}}, step, (("tiles", T.ArrayType(T.IntegerType())),))
