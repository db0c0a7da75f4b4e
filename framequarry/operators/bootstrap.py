"""Bootstrap confidence intervals.

A trial draws n of n items with replacement.  Items are dealt to blocks by a hash of their key; in each
trial a multinomial draw, the same in every task, says how many draws fall to each block, and the block
deals its draws to its items.  Items get weights where they are: no slot of a trial is ever a row, and
only sums by trial are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a block, about.
BLOCK = 50_000


def _blocks(items: DataFrame, key: list[str], block: int) -> tuple[DataFrame, list[int]]:
    """items with _block, and the blocks' sizes (one number for each block reaches the driver)."""
    n = items.count()
    count = max(1, -(-n // block))
    dealt = items.withColumn("_block", F.pmod(F.xxhash64(*key), F.lit(count)).cast("int"))
    sizes = dict(map(tuple, dealt.groupBy("_block").agg(F.count("*")).collect()))
    return dealt, [sizes.get(b, 0) for b in range(count)]


def weights(sizes: list[int], block: int, trials: int, seed: int) -> np.ndarray:
    """How often each trial draws each item of one block: trials x items."""
    n = sum(sizes)
    share = np.random.default_rng([seed, 0]).multinomial(n, np.array(sizes) / n, size=trials)[:, block]
    rng = np.random.default_rng([seed, 1, block])
    out = np.zeros((trials, sizes[block]), np.int32)
    for t, k in enumerate(share.tolist()):
        out[t] = np.bincount(rng.integers(0, sizes[block], k), minlength=sizes[block])
    return out


def summed(items: DataFrame, key: list[str], columns: list[str], trials: int, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """trial, n (draws) and the sum of each of `columns` over the draws; key names an item and orders it."""
    dealt, sizes = _blocks(items.select(*key, *[F.col(c).cast("double").alias(c) for c in columns if c not in key]), key, block)

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable")
        w = weights(sizes, int(rows["_block"].iloc[0]), trials, seed)
        return pd.DataFrame({"trial": np.arange(trials), "n": w.sum(axis=1)} | {c: w @ rows[c].to_numpy(dtype=float) for c in columns})

    schema = "trial int, n long" + "".join(f", `{c}` double" for c in columns)
    return dealt.groupBy("_block").applyInPandas(step, schema).groupBy("trial").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns])


def counted(items: DataFrame, key: list[str], value: str, trials: int, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """trial, value, weight: how often each trial draws each value that is not null."""
    dealt, sizes = _blocks(items.select(*key, F.col(value).cast("double").alias("_v")), key, block)

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
        w = weights(sizes, int(rows["_block"].iloc[0]), trials, seed)
        full = np.flatnonzero(rows["_v"].notna())
        values, code = np.unique(rows["_v"].to_numpy()[full], return_inverse=True)
        sums = np.zeros((trials, len(values)), np.int64)
        np.add.at(sums.T, code, w[:, full].T)
        t, k = np.nonzero(sums)
        return pd.DataFrame({"trial": t, "value": values[k], "weight": sums[t, k]})

    out = dealt.groupBy("_block").applyInPandas(step, "trial int, value double, weight long")
    return out.groupBy("trial", "value").agg(F.sum("weight").alias("weight"))


def mean_ci(items: DataFrame, value: str, key: list[str], trials: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: mean of the trials' means and their percentile interval (nulls in value don't count)."""
    rows = summed(items.where(F.col(value).isNotNull()), key, [value], trials, seed)
    return interval(rows.select((F.col(value) / F.col("n")).alias("m")), "m", level)


def interval(samples: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """mean, ci_low, ci_high and the number of samples."""
    tail = (1 - level) / 2
    return samples.agg(F.count(value).alias("n_boot"), F.avg(value).alias("mean"), F.percentile(value, tail).alias("ci_low"), F.percentile(value, 1 - tail).alias("ci_high"))


def track_ci(facts: DataFrame, trials: int = 1000, seed: int = 42) -> DataFrame:
    """Rows `recall` and `median_ttd`: intervals over resampled tracks. facts: video_id, local_id, first_hit."""
    key = ["video_id", "local_id"]
    found = facts.withColumn("_f", F.col("first_hit").isNotNull().cast("int"))
    recall = interval(summed(found, key, ["_f"], trials, seed).select((F.col("_f") / F.col("n")).alias("recall")), "recall")
    medians = counted(facts, key, "first_hit", trials, seed).groupBy("trial").agg(F.percentile("value", 0.5, F.col("weight")).alias("median_ttd"))
    ttd = interval(medians, "median_ttd")
    return recall.withColumn("metric", F.lit("recall")).unionByName(ttd.withColumn("metric", F.lit("median_ttd")))
