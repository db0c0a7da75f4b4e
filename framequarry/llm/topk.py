"""Exact top-k search: exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows (floor(scale * component)).  Candidates are packed into blocks of
postings (for each term the rows that have it and their weights), queries into blocks of sparse rows.
Each query block meets each candidate block once: term by term, the weighted postings are scattered
into dense score arrays, of which a partition selection keeps the k best; the kept are merged.

Defined cases: vectors that are null or hold a null or non-finite component take no part, neither as
query nor as candidate; missing components of shorter vectors count 0; a query never finds rows with
its own id; rows that repeat an id are candidates each, and queries each (their rows then repeat);
equal scores rank by id; a null id is no query, and as a candidate no row; a component so large that
scores might exceed 64 bits is an error; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
#: Rows of a candidate block and of a query block.
CANDIDATES = 4096
QUERIES = 256


def integer_rows(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id, items (array of long) of the rows that take part."""
    v = F.col(embedding)
    usable = F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    # two vectors within these limits have a product within 64 bits: n terms of at most sqrt(2**63 / n)**2
    too_large = F.exists(v, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) + 1 > F.sqrt(F.lit(2.0**63) / F.size(v)))
    error = F.raise_error(F.concat(F.lit("vec_id "), F.col(vec_id).cast("string"), F.lit(": scores may exceed 64 bits")))
    items = F.when(usable & too_large, error.cast("array<long>")).otherwise(scaled.cast("array<long>"))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), items.alias("items"), usable.alias("_use")).where("_use").drop("_use")


def _packed(rows: DataFrame, size: int, by_term: bool) -> DataFrame:
    """Blocks of at most `size` rows: ids, then a sparse matrix (pointers, places, weights), by term or by row."""

    def pack(ids: list[int], items: list[np.ndarray]) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(items)), [len(x) for x in items])
        term = np.concatenate([np.arange(len(x)) for x in items]) if items else row
        weight = np.concatenate(items) if items else row
        keep = np.flatnonzero(weight)
        row, term, weight = row[keep], term[keep], weight[keep]
        outer, inner = (term, row) if by_term else (row, term)
        order = np.argsort(outer, kind="stable")
        n = int(outer.max()) + 1 if len(outer) else 0
        ends = np.concatenate([[0], np.cumsum(np.bincount(outer, minlength=n))])
        parts = [np.array(ids), ends, inner[order].astype(np.int32), weight[order]]
        kinds = ["<i8", "<i8", "<i4", "<i8"]
        return pa.RecordBatch.from_arrays([pa.array([p.astype(k).tobytes()], pa.binary()) for p, k in zip(parts, kinds)], ["ids", "ends", "places", "weights"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items = [], []
        for batch in batches:
            values = batch.column("items")
            flat, offsets = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64), values.offsets.to_numpy()
            first = offsets[0] if len(offsets) else 0
            for i, d in enumerate(batch.column("vec_id").to_pylist()):
                ids.append(d)
                items.append(flat[offsets[i] - first : offsets[i + 1] - first])
                if len(ids) >= size:
                    yield pack(ids, items)
                    ids, items = [], []
        if ids:
            yield pack(ids, items)

    return rows.mapInArrow(step, "ids binary, ends binary, places binary, weights binary")


PARTS = ("ids", "ends", "places", "weights")


def _numbered(blocks: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The blocks, written, with numbers 0, 1, ... and how many there are; one small row for each is numbered in order."""
    path_order = written(written(blocks, "topk-blocks").withColumn("_part", F.monotonically_increasing_id()), "topk-marked")
    numbers = path_order.select("_part").withColumn(name, F.row_number().over(Window.orderBy("_part")).cast("int") - 1)
    return path_order.join(numbers, "_part").drop("_part"), path_order.count()


def accumulate(queries, candidates, k: int) -> list[tuple[int, int, int, int]]:
    """(query's place, query id, candidate id, score) of the k best of one candidate block for each query of a block."""
    q_ids, q_ends, q_terms, q_weights = queries
    c_ids, c_ends, c_rows, c_weights = candidates
    scores = np.zeros((len(q_ids), len(c_ids)), np.int64)
    q_row = np.repeat(np.arange(len(q_ends) - 1), np.diff(q_ends))
    order = np.argsort(q_terms, kind="stable")
    cuts = np.searchsorted(q_terms[order], np.arange(len(c_ends)))
    for term in range(len(c_ends) - 1):
        asked = order[cuts[term] : cuts[term + 1]]
        rows, weights = c_rows[c_ends[term] : c_ends[term + 1]], c_weights[c_ends[term] : c_ends[term + 1]]
        if len(asked) and len(rows):
            if len(rows) == len(c_ids):
                for i in asked.tolist():
                    scores[q_row[i]] += q_weights[i] * weights
            else:
                for i in asked.tolist():
                    scores[q_row[i], rows] += q_weights[i] * weights
    out = []
    for i, q in enumerate(q_ids.tolist()):
        others = np.flatnonzero(c_ids != q)
        own = scores[i, others]
        if len(own) > k:
            least = np.partition(own, len(own) - k)[len(own) - k]
            at = np.flatnonzero(own >= least)
            others, own = others[at], own[at]
        best = np.lexsort((c_ids[others], -own))[:k]
        out += [(i, q, int(c_ids[others[b]]), int(own[b])) for b in best]
    return out


def search(df: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of df for each row that `is_query` (over vec_id) picks."""
    rows = integer_rows(df, vec_id, embedding, scale)
    asked, _ = _numbered(_packed(rows.where(is_query), QUERIES, False), "q")
    given, n = _numbered(_packed(rows, CANDIDATES, True), "c")
    # a query block is a small part of a candidate block: it is what travels to each of them
    everywhere = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    pairs = asked.withColumnsRenamed({c: f"q_{c}" for c in PARTS}).withColumn("c", F.explode(everywhere)).join(given, "c")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ["<i8", "<i8", "<i4", "<i8"]
        for batch in batches:
            for r in batch.to_pylist():
                q, c = ([np.frombuffer(r[p + name], kind) for name, kind in zip(("ids", "ends", "places", "weights"), kinds)] for p in ("q_", ""))
                found = accumulate(q, c, k)
                cols = [pa.array([r["q"]] * len(found), pa.int32())] + [pa.array([x[i] for x in found], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays(cols, ["q", "place", "query_id", "vec_id", "score"])

    found = pairs.mapInArrow(step, "q int, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q", "place", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
