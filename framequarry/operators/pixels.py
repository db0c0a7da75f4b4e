"""Signals from decoded frames: motion, differences and blur, as state machines over a video.

Decoding is the caller's: `decode` turns a row into an array (height, width) or (height, width, 3).  What a machine keeps
between frames are a few reduced gray pictures; `fold` runs it over a table.  A frame of another size starts a video anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import types as T

from .state import Machine

#: The weights of red, green and blue in gray.
GRAY = (0.2989, 0.5870, 0.1140)
Decode = Callable[[dict], np.ndarray]
Tile = tuple[int, int, int, int]


def gray(frame: np.ndarray, every: int = 1) -> np.ndarray:
    """The frame in gray; every n-th row and column of its whole n x n blocks."""
    picture = np.asarray(frame, dtype=np.float32)
    if picture.ndim == 3:
        picture = picture[..., :3] @ np.array(GRAY, dtype=np.float32)
    if every > 1:
        high, wide = (n // every * every for n in picture.shape)
        picture = picture[:high:every, :wide:every]
    return picture


def tile_means(picture: np.ndarray, tiles: Sequence[Tile], every: int = 1) -> list[float]:
    """The picture's mean under each tile (x, y, w, h of the full frame); 0 for tiles without a pixel. One pass over the picture for all."""
    high, wide = picture.shape
    sums = np.zeros((high + 1, wide + 1))
    sums[1:, 1:] = picture.cumsum(axis=0, dtype=float).cumsum(axis=1)
    x, y, w, h = np.array(tiles, dtype=np.int64).reshape(-1, 4).T
    left, right = (np.clip(v // every, 0, wide) for v in (x, x + w))
    top, bottom = (np.clip(v // every, 0, high) for v in (y, y + h))
    area = np.maximum(right - left, 0) * np.maximum(bottom - top, 0)
    total = sums[bottom, right] - sums[top, right] - sums[bottom, left] + sums[top, left]
    return np.where(area > 0, total / np.maximum(area, 1), 0.0).tolist()


SCORES = (("tile_scores", T.ArrayType(T.DoubleType())),)


def motion_tiles(tiles: Sequence[Tile], decode: Decode, every: int = 4, lag: int | None = 4, window: int = 5, keep: float = 0.8) -> Machine:
    """tile_scores: mean difference from `lag` frames before (as far back as there are frames), or, with lag None, the mean of
    the steps between the last `window` frames; motion: its moving average over the picture (`keep` of the old value)."""
    most = max((lag or 0) + 1, window + 1, 2)

    def step(s: dict, row: dict):
        now = gray(decode(row), every)
        seen = s["seen"]
        if seen and seen[-1].shape != now.shape:
            return {"seen": [now], "motion": 0.0}, {"tile_scores": [0.0] * len(tiles), "motion": 0.0}
        seen = [*seen, now][-most:]
        if len(seen) < 2:
            return {"seen": seen, "motion": s["motion"]}, {"tile_scores": [0.0] * len(tiles), "motion": 0.0}
        if lag is not None:
            change = np.abs(now - seen[-min(len(seen), max(1, lag) + 1)])
        else:
            last = seen[-max(2, window) :]
            change = sum(np.abs(b - a) for a, b in zip(last, last[1:])) / (len(last) - 1)
        motion = keep * s["motion"] + (1 - keep) * float(change.mean())
        return {"seen": seen, "motion": motion}, {"tile_scores": tile_means(change, tiles, every), "motion": motion}

    return Machine("motion_tiles", lambda: {"seen": [], "motion": 0.0}, step, (*SCORES, ("motion", T.DoubleType())))


def difference_tiles(tiles: Sequence[Tile], decode: Decode, every: int = 4, background: float | None = None, keep: float = 0.0) -> Machine:
    """tile_scores: mean difference from the frame before, or from a moving background that takes the share `background` of
    each frame first; kept to the share `keep` from frame to frame.  difference: the mean over the picture."""

    def step(s: dict, row: dict):
        now = gray(decode(row), every)
        old = s["old"]
        if old is None or old.shape != now.shape:
            old, change = now, np.zeros_like(now)
        elif background is None:
            change, old = np.abs(now - old), now
        else:
            old = (1 - background) * old + background * now
            change = np.abs(now - old)
        scores = np.array(tile_means(change, tiles, every))
        if keep > 0 and s["scores"] is not None:
            scores = keep * s["scores"] + (1 - keep) * scores
        return {"old": old, "scores": scores}, {"tile_scores": scores.tolist(), "difference": float(change.mean()) if change.size else 0.0}

    return Machine("difference_tiles", lambda: {"old": None, "scores": None}, step, (*SCORES, ("difference", T.DoubleType())))


def picture_signals(decode: Decode, keep: float = 0.8) -> Machine:
    """motion: moving average of the mean difference from the frame before; blur: variance of the picture's Laplacian (wrapped at its edges)."""

    def step(s: dict, row: dict):
        now = gray(decode(row))
        around = sum(np.roll(now, by, axis=axis) for axis in (0, 1) for by in (1, -1))
        blur = float((around - 4 * now).var())
        if s["old"] is None or s["old"].shape != now.shape:
            return {"old": now, "motion": s["motion"]}, {"motion": 0.0, "blur": blur}
        motion = keep * s["motion"] + (1 - keep) * float(np.abs(now - s["old"]).mean())
        return {"old": now, "motion": motion}, {"motion": motion, "blur": blur}

    return Machine("picture_signals", lambda: {"old": None, "motion": 0.0}, step, (("motion", T.DoubleType()), ("blur", T.DoubleType())))
