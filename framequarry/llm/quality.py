"""Quality rules: an isolation forest over rule statistics.

Whole texts give base statistics and two base rules.  The forest's rows are the statistics'
ratios as they are (shares on a logarithmic scale); no limit is set by hand.  Its trees hold good
labelled rows, but their random splits fall anywhere in the range of all labelled rows, so a place
where no good row lies is cut off early: short mean paths are anomalous.  The threshold lies
half-way between the score that all but GOOD_LOSS of the sample's good rows keep within and the
nearest scores of bad rows beyond it.  Forest and threshold come from a sample of labelled rows
(TRAIN_ROWS ids at most, and TRAIN_ROWS rows); statistics and verdicts cover all rows.

Defined cases: a null text has no words and fails the base rules; without labelled rows of both
kinds no threshold can be set and the verdict is the base rules'; a document labelled several
times counts as good only if all its labels do; labels null in quality are left out; repeated
rows are judged alike; an empty table gives an empty one; input columns with a result's name are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_SPACE, without

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
#: The forest: its bound on labelled rows, trees, rows a tree, and the share of good rows it may lose.
TRAIN_ROWS = 8192
TREES = 200
TREE_ROWS = 1024
GOOD_LOSS = 0.005
SEED = 11

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_exclaim"]
RESULTS = STATS + ["base_failed", "anomaly", "kept"]


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text the number of words in WINDOW-word windows that occur twice or more in it."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    total = int(sizes.sum())
    out = np.zeros(len(words), dtype=np.int64)
    if total < WINDOW:
        return out
    h = np.fromiter((hash(x) for w in words for x in w), dtype=np.int64, count=total).view(np.uint64)
    doc = np.repeat(np.arange(len(words)), sizes)
    n = total - WINDOW + 1
    key = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(WINDOW):
        key = (key ^ h[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    keys = key[inside]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return out
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    starts = inside[twice[at] == keys]
    covered = np.zeros(total, dtype=bool)
    for i in range(WINDOW):
        covered[starts + i] = True
    return np.bincount(doc[covered], minlength=len(words))


def text_stats(texts: list[str | None]) -> dict[str, np.ndarray]:
    """STATS and EXTRA of whole texts."""
    rows, words = [], []
    for t in texts:
        t = t or ""
        raw = t.encode()
        w = raw.split()
        words.append(w)
        lines = [x for x in t.split("\n") if x.strip(WORD_SPACE)]
        b = np.frombuffer(raw, np.uint8)
        upper = int(np.count_nonzero((b >= 65) & (b <= 90)))
        rows.append((len(w), len(t) - sum(map(t.count, WORD_SPACE)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), 0, len(lines), upper, t.count("!")))
    table = np.array(rows, dtype=np.int64).reshape(-1, len(STATS) + len(EXTRA))
    table[:, 4] = repeated_words(words)
    return dict(zip(STATS + EXTRA, table.T))


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Characters a word, and shares of symbols, repeated lines, repeated words, capitals and exclamation marks; none depends on a text's length."""
    words = np.maximum(s["n_words"], 1)
    chars = np.maximum(s["word_chars"], 1)
    lines = np.maximum(s["n_lines"], 1)
    shares = [s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / chars, s["n_exclaim"] / words]
    return np.stack([s["word_chars"] / words, *(np.log1p(100 * x) for x in shares)], axis=1)


def _expected(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees of random splits over rows x, drawn from the range of `around` (x itself if not given); score() is near 1 for rows that few splits isolate."""

    def __init__(self, x: np.ndarray, around: np.ndarray | None = None, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        around = x if around is None else around
        rows = min(rows, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
        width = 2 ** (self.depth + 1)
        self.feature = np.zeros((trees, width), dtype=np.int64)
        self.cut = np.full((trees, width), np.inf)  # a leaf: all rows stay at its left end
        self.length = np.zeros((trees, width))
        self.norm = float(_expected(rows)) or 1.0
        for t in range(trees):
            self._grow(t, 1, x[rng.choice(len(x), rows, replace=False)], around.min(axis=0), around.max(axis=0), 0, rng)

    def _grow(self, t: int, node: int, x: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng) -> None:
        """low, high: the corners of the node's box."""
        able = np.flatnonzero(high > low)
        if depth == self.depth or len(x) <= 1 or not len(able):
            while node < self.cut.shape[1]:
                self.length[t, node] = depth + float(_expected(len(x)))
                node *= 2
            return
        f = rng.choice(able)
        cut = rng.uniform(low[f], high[f])
        left = x[:, f] <= cut
        self.feature[t, node], self.cut[t, node] = f, cut
        middle_high, middle_low = high.copy(), low.copy()
        middle_high[f] = middle_low[f] = cut
        self._grow(t, 2 * node, x[left], low, middle_high, depth + 1, rng)
        self._grow(t, 2 * node + 1, x[~left], middle_low, high, depth + 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.cut))[:, None]
        rows = np.arange(len(x))[None, :]
        node = np.ones((len(self.cut), len(x)), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return 2.0 ** (-self.length[trees, node].mean(axis=0) / self.norm)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def calibrated(s: dict[str, np.ndarray], good: np.ndarray, good_loss: float = GOOD_LOSS) -> tuple[Forest, float] | None:
    """Forest and threshold from the labelled rows that pass the base rules; None if a kind of label is missing."""
    use = ~base_failed(s)
    x, good = features(s)[use], good[use]
    if good.all() or not good.any():
        return None
    forest = Forest(x[good], around=x)
    own, other = np.sort(forest.score(x[good])), forest.score(x[~good])
    cut = own[len(own) - 1 - int(good_loss * len(own))]
    beyond = other[other > cut]
    return forest, float((cut + np.quantile(beyond, 0.01)) / 2 if len(beyond) else cut)


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, rows: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and labels of at most `rows` labelled ids and rows, picked by a hash of the id (and, of more rows, the statistics)."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "_marked")
    picked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(marks), F.col("_id") == F.col("_marked")).select("_id", "_text", "_quality")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = text_stats(batch.column("_text").to_pylist())
            cols = [batch.column("_id").cast(pa.int64()), batch.column("_quality").cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(s[k]) for k in STATS + EXTRA], ["_id", "_quality", *STATS, *EXTRA])

    schema = "_id long, _quality int, " + ", ".join(f"{k} long" for k in STATS + EXTRA)
    # a labelled id may stand on many rows: the bound holds for rows, too
    got = picked.mapInArrow(step, schema).orderBy(F.xxhash64("_id", *STATS), "_id", *STATS, *EXTRA).limit(rows)
    got = got.toPandas().sort_values(["_id", "_quality", *STATS], kind="stable")
    return {k: got[k].to_numpy(dtype=np.int64) for k in STATS + EXTRA}, (got["_quality"] == 1).to_numpy()


def judge(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Adds the statistics, base_failed, anomaly (null: base_failed or no forest) and kept."""
    df = without(df, RESULTS)
    model = df.sparkSession.sparkContext.broadcast(calibrated(*labelled_sample(df, labels, text, doc_id, train_rows)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = text_stats(part.column(text).to_pylist())
                failed = base_failed(s)
                kept, score, none = ~failed, np.zeros(len(failed)), np.ones(len(failed), dtype=bool)
                if fitted and kept.any():
                    score[kept] = fitted[0].score(features(s)[kept])
                    none = failed
                    kept = kept & (score <= fitted[1])
                out = part
                for k in STATS:
                    out = out.append_column(k, pa.array(s[k], pa.int64()))
                out = out.append_column("base_failed", pa.array(failed))
                out = out.append_column("anomaly", pa.array(score, pa.float64(), mask=none))
                yield out.append_column("kept", pa.array(kept))

    fields = [T.StructField(k, T.LongType()) for k in STATS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return df.mapInArrow(step, T.StructType(list(df.schema.fields) + fields))
