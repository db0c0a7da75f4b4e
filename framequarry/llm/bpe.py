"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens
themselves.  Tier two: the others are merged with a heap of ranked pairs over linked bytes
(lowest rank first, leftmost among equals).  Distinct pre-tokens are resolved once and kept in
a bounded table of each worker.

Defined cases: a null text is an empty one (no ids, empty decoding); texts of any length are
encoded whole; repeated rows give repeated results; an empty table gives an empty one; input
columns with a result's name are replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import without

#: Pre-tokens a worker keeps resolved; the table is emptied when it is full.
KEEP = 600_000
MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings (hash and displace): n keys to 0..n-1."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 4)
        slots: list[int] = [-1] * n
        self.shift = [0] * self.buckets
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            groups[h % self.buckets].append((h, i))
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        free = 0
        for b in order:
            group = groups[b]
            if len(group) > 1:
                d = 0
                while True:
                    at = [self._slot(h, d) for h, _ in group]
                    if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                        break
                    d += 1
                self.shift[b] = d
                for s, (_, i) in zip(at, group):
                    slots[s] = i
            elif group:
                while slots[free] >= 0:
                    free += 1
                slots[free] = group[0][1]
                self.shift[b] = -free - 1  # single keys name their slot
        self.keys = [keys[i] if i >= 0 else b"" for i in slots]
        self.values = slots

    def _slot(self, h: int, d: int) -> int:
        x = ((h >> 20) ^ (d * 0x9E3779B97F4A7C15)) & MASK
        x = (x * 0xBF58476D1CE4E5B9) & MASK
        return (x ^ (x >> 31)) % self.n

    def get(self, key: bytes) -> int:
        """The key's number, or -1 if it is not one of the keys."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 tokens and ranks."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    out = [b""] * (1 + max(int(r) for _, r in pairs))
    for t, r in pairs:
        out[int(r)] = base64.b64decode(t)
    return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.tokens = tokens
        ids = [i for i, t in enumerate(tokens) if t]
        self.ids = ids
        self.hash = PerfectHash([tokens[i] for i in ids])
        self.ranks = {tokens[i]: i for i in ids}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Heap of pairs over a doubly linked list of bytes."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # the part that starts at i ends at end[i]; 0: no longer a start
        left = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the two parts has changed
            end[i], end[mid] = stop, 0
            if stop < n:
                left[stop] = i
                x = ranks.get(piece[i : end[stop]])
                if x is not None:
                    heapq.heappush(heap, (x, i, end[stop]))
            j = left[i]
            if j >= 0:
                x = ranks.get(piece[j:stop])
                if x is not None:
                    heapq.heappush(heap, (x, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def resolve(self, piece: str) -> bytes:
        raw = piece.encode()
        at = self.hash.get(raw)
        out = np.array([self.ids[at]] if at >= 0 else self.merge(raw), dtype="<u4").tobytes()
        if len(self.known) >= KEEP:
            self.known.clear()
        if len(piece) <= 64:
            self.known[piece] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known, resolve = self.known, self.resolve
        return b"".join([known.get(p) or resolve(p) for p in self.split(text)])

    def decode(self, ids: bytes | None) -> bytes:
        if not ids:
            return b""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a vocabulary file; built once in each process."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(load_ranks(path), pattern)
    return _CODECS[key]


def _mapped(df: DataFrame, extra: list[T.StructField], step) -> DataFrame:
    schema = T.StructType(list(df.schema.fields) + extra)
    return df.mapInArrow(step, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Adds `ids` (binary, little-endian unsigned 32-bit) and, if named, `decoded` (binary: those ids decoded)."""
    names = [ids] + ([decoded] if decoded else [])
    df = without(df, names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = [c.encode(t) for t in part.column(text).to_pylist()]
                out = part.append_column(ids, pa.array(coded, pa.binary()))
                if decoded:
                    out = out.append_column(decoded, pa.array([c.decode(x) for x in coded], pa.binary()))
                yield out

    return _mapped(df, [T.StructField(n, T.BinaryType()) for n in names], step)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds `decoded` (binary) for the binary column of ids; null ids decode to nothing."""
    df = without(df, [decoded])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.append_column(decoded, pa.array([c.decode(x) for x in part.column(ids).to_pylist()], pa.binary()))

    return _mapped(df, [T.StructField(decoded, T.BinaryType())], step)
