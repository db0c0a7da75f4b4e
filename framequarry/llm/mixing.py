"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a target number of words.  The ratio of target to size gives every document of
the source whole copies and an inclusion probability for one more.  The cube method's flight phase
moves these probabilities along directions that leave the sums of documents and of words as they
are, until each is 0 or 1.  Blocks of bounded size fly apart from each other; what stays undecided
(two documents a block at most) flies again, block by block, until one block for each source is
left.  The landing keeps the words only: its last document is cut to the words still missing
(`split`), or drawn as a whole.

Defined cases: a null text has no words; null is a source of its own, last in order; a source
without words has target 0; weights repeat over the sources in order; repeated rows are documents
of their own; an empty table gives an empty one; random numbers come from the seed, the source and
the block only, so reruns agree; input columns with a result's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, without, written

#: Fixed values of the registered mix.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
#: Documents that fly together.
BLOCK = 4096
SEED = 17

RESULTS = ["size", "source_size", "target", "taken"]


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> list[float]:
    """Shares of `share` times all words by weight; what exceeds `most` times a size is shared anew by weight."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))])
    cap = most * np.array(sizes, dtype=float)
    out, free, left = np.zeros(len(sizes)), np.array(sizes) > 0, share * float(sum(sizes))
    while free.any():
        part = np.where(free, left * w / w[free].sum(), 0.0)
        over = free & (part > cap)
        if not over.any():
            out[free] = part[free]
            break
        out[over] = cap[over]
        left -= cap[over].sum()
        free &= ~over
    return out.tolist()


def fly(size: np.ndarray, pi: np.ndarray, rng, land: bool = False, split: bool = True) -> np.ndarray:
    """Flight phase over the documents in order: two constraints, so three undecided ones at a time.

    At its end two probabilities at most are neither 0 nor 1.  With `land`, the number of documents is given up:
    one direction keeps the words of two documents; the last one keeps its fraction (`split`) or is drawn.
    """
    pi = pi.astype(float).copy()
    size = size.astype(float)

    def move(ids: list[int], u: list[float]) -> None:
        up = min(((1 - pi[i]) / d if d > 0 else -pi[i] / d) for i, d in zip(ids, u) if d)
        down = min((pi[i] / d if d > 0 else (pi[i] - 1) / d) for i, d in zip(ids, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(ids, u):
            pi[i] += step * d
            if pi[i] < 1e-9:
                pi[i] = 0.0
            elif pi[i] > 1 - 1e-9:
                pi[i] = 1.0

    held: list[int] = []
    for k in np.flatnonzero((pi > 0) & (pi < 1)).tolist():
        held.append(k)
        if len(held) == 3:
            a, b, c = size[held]
            u = [c - b, a - c, b - a]  # sums to 0, also weighted by size
            if not any(u):
                u = [1.0, -1.0, 0.0]
            while len(held) == 3:  # a rounding step may leave all three open
                move(held, u)
                held = [i for i in held if 0 < pi[i] < 1]
    if land:
        while len(held) == 2:
            a, b = size[held]
            u = [1.0, -1.0] if a == b else [b, -a]
            move(held, u)
            held = [i for i in held if 0 < pi[i] < 1]
        if held and not split:
            pi[held[0]] = float(rng.random() < pi[held[0]])
    return pi


def _flown(units: DataFrame, blocks, round_nr: int, seed: int, land: bool, split: bool) -> DataFrame:
    """One round: units (id, source, size, pi, ...) with their new pi; blocks: column with the source's number of blocks."""
    dealt = units.withColumn("_block", F.pmod(F.xxhash64(F.lit(round_nr), "_uid", "_row"), blocks).cast("int"))

    def flight(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_uid", "size", "_row"], kind="stable")
        name = f"{seed}/{round_nr}/{group['_nr'].iloc[0]}/{group['_block'].iloc[0]}"
        rng = np.random.default_rng(xxhash.xxh64_intdigest(name))
        pi = fly(group["size"].to_numpy(), group["pi"].to_numpy(), rng, land, split)
        return group.drop(columns="_block").assign(pi=pi)

    return dealt.groupBy("_nr", "_block").applyInPandas(flight, units.schema)


def _row_key(df: DataFrame):
    """128 bits of all columns: equal for equal rows only."""
    names = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.concat_ws("/", F.xxhash64(F.lit(1), *names), F.xxhash64(F.lit(2), *reversed(names)))


def mix(df: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_REPEATS, split: bool = True, text: str = "text", doc_id: str = "doc_id", source: str = "source", block: int = BLOCK, seed: int = SEED, key=None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) of each row of df; key: a column that names the row.

    The driver gets one row for each source, as the weights are set by source.
    """
    spark = df.sparkSession
    text_col, id_col, source_col = F.col(text), F.col(doc_id), F.col(source)
    # the row's own number decides ties among equal ids; equal rows may change places
    rows = df.select(id_col.alias("doc_id"), source_col.alias("source"), n_words(text_col).alias("size"), F.xxhash64(id_col, source_col, text_col).alias("_uid"), (F.lit("") if key is None else key).alias("_row"))
    rows = written(rows, "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # str compares by code points
    goal = targets([r["n"] for r in sums], weights, share, most)
    ratio = [g / r["n"] if r["n"] else 0.0 for g, r in zip(goal, sums)]
    plan = [(i, r["source"], r["n"], g, int(x), min(1.0, x - int(x)), r["docs"]) for i, (r, g, x) in enumerate(zip(sums, goal, ratio))]
    plan = spark.createDataFrame(plan, "_nr int, _source string, source_size long, target double, _whole int, pi double, _docs long")
    units = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).drop("_source")

    done, undecided, nr = [], units, 0
    # documents of the largest source that may be undecided, and the same for each row's source
    most_docs, docs = max((r["docs"] for r in sums), default=0), F.col("_docs")
    while True:
        count, many = -(-most_docs // block), F.greatest(F.lit(1), F.ceil(docs / block))
        last = count <= 1
        flown = written(_flown(undecided, many, nr, seed, last, split), f"mix-round{nr}")
        if last:
            done.append(flown)
            break
        open_ = "pi > 0 and pi < 1"
        done.append(flown.where(f"not ({open_})"))
        undecided = flown.where(open_)
        most_docs, docs = min(most_docs, 2 * count), F.least(docs, 2 * many)
        nr += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    taken = F.col("_whole") * F.col("size") + F.round(F.col("pi") * F.col("size")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "_row", "_whole", F.col("pi").alias("_part"))


def mixed(df: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_REPEATS, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """df's rows as often as the mix takes them: none, once or more; whole documents only.

    Rows are told apart by all their columns.  Rows equal in all columns share their copies: any of them stands for all.
    """
    plan = mix(df, weights, share, most, split=False, text=text, doc_id=doc_id, source=source, key=_row_key(df))
    copies = plan.select(F.col("_row").alias("_key"), (F.col("_whole") + F.col("_part")).cast("int").alias("_copies"))
    copies = copies.groupBy("_key").agg(F.sum("_copies").cast("int").alias("_copies"), F.count("*").alias("_same")).where("_copies > 0")
    copies = written(copies, "mix-copies")
    out = df.withColumn("_row", _row_key(df)).join(copies, F.col("_row") == F.col("_key"))
    repeated = lambda x: x.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col(f"`{c}`") for c in df.columns])
    if copies.where("_same > 1").isEmpty():
        return repeated(out)
    same = out.where("_same > 1").dropDuplicates(["_row"])
    return repeated(out.where("_same = 1")).unionByName(repeated(same))
