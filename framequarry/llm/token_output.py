"""Token ids in files: tokenized documents in order, range-coded in reset, checksummed blocks.

A file holds a header, its blocks, each with its length, number of ids and CRC-32 (of the ids as
little-endian unsigned 32-bit integers), the table of its documents (id, tokens) and a footer.
Files are numbered in the order of the documents; a manifest has their names and numbers of ids,
whose running sums are the files' first positions.

Defined cases: a null text is an empty one (the end id alone); documents stand in ascending doc_id
order, nulls first, rows that repeat a doc_id in the order of their texts; texts of any length are
encoded whole; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import range_coder
from .common import written

MAGIC = b"FQTOK002"
#: Ids of a block and of a file; bits of an id.
BLOCK_IDS = 2048
FILE_IDS = 8_000_000
WIDTH = 16
#: Distinct words a worker keeps encoded (some 50 bytes each); the table is emptied when it is full.
KEEP = 3_000_000
#: New words that are looked for one by one before the index takes them in.
RECENT = 100_000
#: Words that one call of the library encodes as one text.
TOGETHER = 256
#: Bytes of text that are split and looked up together.
CHUNK_BYTES = 3 << 20

_ENCODERS: dict[str, WordEncoder] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: masks of the first n bytes of a little-endian 64-bit number
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _digests(eights: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each word; eights[i]: the eight bytes from i on."""
    h = _mixed((eights[first] & _FIRST[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    at, k = np.flatnonzero(size > 8), 8
    while len(at):
        h[at] = _mixed((h[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (eights[first[at] + k] & _FIRST[np.minimum(size[at] - k, 8)]))
        k += 8
        at = at[size[at] > k]
    return h


class _Collision(Exception):
    """Two words share a digest."""


def _eights(data) -> np.ndarray:
    """Item i: the eight bytes from i on."""
    return np.ndarray((len(data) - 7,), np.dtype("<u8"), data, 0, (1,))


def _differ(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> bool:
    """Whether some words differ: in a from `at`, in b from `bt`, of equal sizes."""
    k = 0
    while len(size):
        if ((a[at + k] ^ b[bt + k]) & _FIRST[np.minimum(size - k, 8)]).any():
            return True
        k += 8
        more = np.flatnonzero(size > k)
        at, bt, size = at[more], bt[more], size[more]
    return False


class _Pool:
    """Ids of words by digest: arrays that grow, an index over most digests and a dictionary of recent ones. The words' bytes are kept and compared."""

    def __init__(self):
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0
        self.starts, self.lengths, self.count = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int32), 0
        self.keys = np.empty(1 << 18, np.uint64)
        self.text, self.text_used = np.zeros(1 << 21, np.uint8), 0
        self.at, self.sizes = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int32)
        self.index, self.indexed = pd.Index(np.empty(0, np.uint64)), 0
        self.recent: dict[int, int] = {}

    def places(self, digests: np.ndarray, eights: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The words' places; -1: unknown."""
        out = self.index.get_indexer(digests).astype(np.int64)
        if self.recent:
            open_ = np.flatnonzero(out < 0)
            out[open_] = [self.recent.get(d, -1) for d in digests[open_].tolist()]
        known = np.flatnonzero(out >= 0)
        self.compare(out[known], eights, first[known], size[known])
        return out

    def compare(self, places: np.ndarray, eights: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        if (self.sizes[places] != size).any() or _differ(eights, first, _eights(self.text), self.at[places], size):
            raise _Collision

    def add(self, digests: np.ndarray, ids: np.ndarray, lengths: np.ndarray, words: list[bytes]) -> None:
        """Words whose ids follow each other."""
        n, m = len(digests), len(ids)
        text = b"".join(words)
        while self.used + m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.text_used + len(text) + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while self.count + n > len(self.keys):
            self.keys, self.starts, self.lengths, self.at, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.keys, self.starts, self.lengths, self.at, self.sizes))
        self.ids[self.used : self.used + m] = ids
        self.text[self.text_used : self.text_used + len(text)] = np.frombuffer(text, np.uint8)
        new = slice(self.count, self.count + n)
        self.keys[new], self.lengths[new] = digests, lengths
        self.starts[new] = self.used + np.cumsum(lengths) - lengths
        self.sizes[new] = [len(w) for w in words]
        self.at[new] = self.text_used + np.cumsum(self.sizes[new]) - self.sizes[new]
        self.recent.update(zip(digests.tolist(), range(self.count, self.count + n)))
        self.used, self.text_used, self.count = self.used + m, self.text_used + len(text), self.count + n
        if len(self.recent) > RECENT:
            self.index = pd.Index(self.keys[: self.count].copy())
            self.recent.clear()

    def of(self, places: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other."""
        lengths = self.lengths[places].astype(np.int64)
        ends = np.cumsum(lengths)
        return self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[places] - (ends - lengths), lengths)]


#: The normalizers and the split that let stretches without white space be encoded apart, in lower case.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Words of lower-case Latin-1 letters alone: WORD_NORMALIZERS leave them as they are, WORD_SPLIT takes them whole.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def words_apart(path: str) -> bool:
    """Whether the vocabulary file says that texts may be encoded word by word: its normalizer, pre-tokenizer, model and special tokens are of the known kind."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    normal, split = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}
    parts = split.get("pretokenizers") or [{}, {}]
    return (
        normal.get("type") == "Sequence"
        and normal.get("normalizers") == WORD_NORMALIZERS
        and split.get("type") == "Sequence"
        and len(parts) == 2
        and parts[0] == {"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed", "invert": True}
        and parts[1].get("type") == "ByteLevel"
        and not parts[1].get("add_prefix_space")
        and not parts[1].get("use_regex")
        and said["model"].get("type") == "BPE"
        and not said["model"].get("dropout")
        and said.get("post_processor") is None
        and bool(said.get("added_tokens"))
        and all(t["special"] and "<" in t["content"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"]))) for t in said["added_tokens"])
    )


class WordEncoder:
    """From texts to the library's ids.

    Where the vocabulary file allows it (words_apart), the library encodes each distinct stretch without ASCII white
    space once.  Stretches are found and looked up (by a 64-bit digest, then by their bytes) with array operations over
    many texts at once; new ones go to the library many at a time, with a special token between them, which it splits
    off before all else.  Words of plain letters (PLAIN) need neither: the library's model takes them divided by white
    space, and their last tokens are known by the model's suffix.  Other vocabularies, and texts of which two words share a digest, take the library's way as
    they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.apart = words_apart(path)
        marks = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word) and not any(map(str.isspace, t.content))]
        self.mark, self.mark_id = marks[0] if marks else (None, None)
        self.specials = [m.encode() for m, _ in marks]
        self.pool = _Pool()
        self.plain, suffix = None, getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if self.apart and suffix:
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            self.last[[i for t, i in self.plain.get_vocab().items() if t.endswith(suffix)]] = True

    def _library(self, words: list[bytes], digests: np.ndarray) -> None:
        """Encode and keep words that aren't known."""
        if self.plain is not None:
            plain = np.array([PLAIN.fullmatch(w) is not None for w in words], bool)
            at = np.flatnonzero(plain)
            groups = [at[i : i + TOGETHER] for i in range(0, len(at), TOGETHER)]
            texts = [b" ".join([words[i] for i in g]).decode() for g in groups]
            for g, e in zip(groups, self.plain.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                stops = np.flatnonzero(self.last[ids])
                if len(stops) == len(g) and stops[-1] == len(ids) - 1:
                    self.pool.add(digests[g], ids, np.diff(stops, prepend=-1), [words[i] for i in g])
                else:
                    plain[g] = False  # words without an end
            words, digests = [w for w, p in zip(words, plain.tolist()) if not p], digests[~plain]
        alone = np.array([self.mark is None or (b"<" in w and any(m in w for m in self.specials)) for w in words], bool)
        for i in np.flatnonzero(alone).tolist():
            ids = np.array(self.tokenizer.encode(words[i].decode(), add_special_tokens=False).ids, np.uint32)
            self.pool.add(digests[i : i + 1], ids, np.array([len(ids)]), words[i : i + 1])
        rest = np.flatnonzero(~alone)
        groups = [rest[i : i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
        texts = [self.mark.join([words[i].decode() for i in g]) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(g) - 1:
                raise ValueError("the tokenizer doesn't keep its special token apart")
            self.pool.add(digests[g], ids[ids != self.mark_id], np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1, [words[i] for i in g])

    def _learn(self, data: bytes, text: np.ndarray, eights: np.ndarray, first: np.ndarray, size: np.ndarray, digests: np.ndarray) -> None:
        """Make new distinct words known."""
        last = first + size - 1
        # a full stop or comma after a letter is a pre-token of its own
        ended = (size > 1) & ((text[last] == 46) | (text[last] == 44)) & _LETTER[text[last - 1]]
        e = np.flatnonzero(ended)
        stems = _digests(eights, first[e], size[e] - 1)
        marks = _digests(eights, last[e], np.ones(len(e), np.int64))
        keys = np.concatenate([digests[~ended], stems, marks])
        starts, sizes = np.concatenate([first[~ended], first[e], last[e]]), np.concatenate([size[~ended], size[e] - 1, np.ones(len(e), np.int64)])
        keys, at = np.unique(keys, return_index=True)
        fresh = self.pool.places(keys, eights, starts[at], sizes[at]) < 0
        at = at[fresh]
        self._library([data[a : a + n] for a, n in zip(starts[at].tolist(), sizes[at].tolist())], keys[fresh])
        if len(e):
            parts = np.stack([self.pool.places(stems, eights, first[e], size[e] - 1), self.pool.places(marks, eights, last[e], np.ones(len(e), np.int64))], axis=1)
            self.pool.add(digests[e], self.pool.of(parts.ravel()), self.pool.lengths[parts].sum(axis=1), [data[a : a + n] for a, n in zip(first[e].tolist(), size[e].tolist())])

    def _chunk(self, raws: list[bytes], end: np.uint32) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, each followed by `end`, and their numbers."""
        if self.pool.count > KEEP:
            self.pool = _Pool()
        limits = np.cumsum([len(r) + 1 for r in raws])
        text = np.frombuffer(b" ".join(raws) + b" " * 40, np.uint8)
        if not (text == 60).any():
            text = _LOWER[text]  # A-Z may be lower-cased beforehand, unless that could make a special token
        edge = np.diff(_SPACE[text].view(np.int8), prepend=np.int8(1))
        first, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # the joined text ends with white space
        size = stop - first
        data = text.tobytes()
        eights = _eights(data)
        code, distinct = pd.factorize(_digests(eights, first, size))
        sample = np.empty(len(distinct), np.int64)
        sample[code] = np.arange(len(code))
        places = self.pool.places(distinct, eights, first[sample], size[sample])
        new = np.flatnonzero(places < 0)
        if len(new):
            where = sample[new]
            self._learn(data, text, eights, first[where], size[where], distinct[new])
            places[new] = self.pool.places(distinct[new], eights, first[where], size[where])
        self.pool.compare(places[code], eights, first, size)
        # the words of a text stand before its end; -1 marks the ends
        words = np.insert(places[code], np.searchsorted(first, limits), -1)
        stops = np.flatnonzero(words < 0)
        lengths = np.where(words < 0, 1, self.pool.lengths[words]).astype(np.int64)
        starts = self.pool.starts[words]
        ends = np.cumsum(lengths)
        last = ends[stops] - 1
        at = np.arange(int(ends[-1])) + np.repeat(starts - (ends - lengths), lengths)
        at[last] = 0
        ids = self.pool.ids[at]
        ids[last] = end
        return ids, np.diff(last, prepend=-1)

    def _whole(self, texts: list[str], end: np.uint32) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library alone."""
        found = [np.array([*e.ids, end], np.uint32) for k in range(0, len(texts), TOGETHER) for e in self.tokenizer.encode_batch_fast(texts[k : k + TOGETHER], add_special_tokens=False)]
        return (np.concatenate(found) if found else np.empty(0, np.uint32)), np.array([len(x) for x in found], np.int64)

    def __call__(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, `end` after each, and how many each text has."""
        if not self.apart:
            return self._whole([t or "" for t in texts], np.uint32(end))
        raws = [(t or "").encode() for t in texts]
        out, k = [], 0
        while k < len(raws):
            stop, size = k, 0
            while stop < len(raws) and (stop == k or size + len(raws[stop]) <= CHUNK_BYTES):
                size += len(raws[stop])
                stop += 1
            try:
                out.append(self._chunk(raws[k:stop], np.uint32(end)))
            except _Collision:
                out.append(self._whole([r.decode() for r in raws[k:stop]], np.uint32(end)))
            k = stop
        if not out:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file; built once in each process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def file_bytes(docs: list[tuple[int | None, int]], ids: np.ndarray, block: int = BLOCK_IDS, width: int = WIDTH) -> bytes:
    """A file of documents (id, number of ids) and their ids."""
    if len(ids) and int(ids.max()) >= 1 << width:
        raise ValueError(f"an id needs more than {width} bits")
    out = [MAGIC, struct.pack("<IIQQ", block, width, len(ids), len(docs))]
    for i, coded in enumerate(range_coder.encode(ids, block, width)):
        own = ids[i * block : (i + 1) * block].astype("<u4").tobytes()
        out += [struct.pack("<III", len(coded), len(own) // 4, zlib.crc32(own)), coded]
    table = b"".join(struct.pack("<?qQ", d is None, d or 0, n) for d, n in docs)
    return b"".join([*out, table, struct.pack("<QI", len(table), zlib.crc32(table)), MAGIC])


def parse_file(raw: bytes) -> tuple[list[tuple[int | None, int]], np.ndarray]:
    """Documents and ids of a file; raises ValueError if a checksum differs."""
    if raw[:8] != MAGIC or raw[-8:] != MAGIC:
        raise ValueError("no token file")
    block, width, n, _ = struct.unpack_from("<IIQQ", raw, 8)
    at, coded, sums = 32, [], []
    for _ in range(-(-n // block)):
        size, count, crc = struct.unpack_from("<III", raw, at)
        coded.append(raw[at + 12 : at + 12 + size])
        sums.append((count, crc))
        at += 12 + size
    ids = range_coder.decode(coded, n, block, width)
    plain = memoryview(ids.astype("<u4", copy=False)).cast("B") if len(ids) else memoryview(b"")
    for i, (count, crc) in enumerate(sums):
        if zlib.crc32(plain[4 * i * block : 4 * (i * block + count)]) != crc:
            raise ValueError(f"block {i}: the checksum differs")
    size, crc = struct.unpack_from("<QI", raw, len(raw) - 20)
    table = raw[len(raw) - 20 - size : len(raw) - 20]
    if zlib.crc32(table) != crc:
        raise ValueError("the documents' table has another checksum")
    return [(None if null else d, k) for null, d, k in struct.iter_unpack("<?qQ", table)], ids


def write(df: DataFrame, tokenizer_path: str, end_id: int, folder: str, text: str = "text", doc_id: str = "doc_id", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the token files to `folder` (a URI that all executors share); returns the manifest.

    A repeated task writes its files anew under other names; the manifest names those of tasks that succeeded.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.repartitionByRange("_id").sortWithinPartitions("_id", "_text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path)
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        docs, parts, n, nr = [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal docs, parts, n, nr
            ids = np.concatenate(parts)
            parts = []
            raw = file_bytes(docs, ids)
            name = f"{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(raw)
            cols = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([nr], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([len(raw)], pa.int64())]
            docs, parts, n, nr = [], [], 0, nr + 1
            return pa.RecordBatch.from_arrays(cols, ["part", "nr", "file", "n_ids", "n_docs", "n_bytes"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, sizes = encode(part.column("_text").to_pylist(), end_id)
                names, stops, begun, k = part.column("_id").to_pylist(), np.cumsum(sizes), 0, 0
                while k < len(names):
                    # documents up to the file's size, at least one
                    stop = max(k + 1, int(np.searchsorted(stops, begun + file_ids - n, side="right")))
                    stop = min(stop, len(names))
                    docs += list(zip(names[k:stop], sizes[k:stop].tolist()))
                    parts.append(ids[begun : stops[stop - 1]])
                    n += int(stops[stop - 1]) - begun
                    begun, k = int(stops[stop - 1]), stop
                    if n >= file_ids or k < len(names):
                        yield close()
        if docs:
            yield close()

    files = written(rows.mapInArrow(step, "part int, nr int, file string, n_ids long, n_docs long, n_bytes long"), "token-manifest")
    # one row for each file
    before = F.sum("n_ids").over(Window.orderBy("part", "nr").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def read(manifest: DataFrame, folder: str, ids: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document and, if named, its ids (binary, little-endian unsigned 32-bit)."""
    named = [ids] if ids else []

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as f:
                    docs, values = parse_file(f.read())
                plain, at = (memoryview(values.astype("<u4", copy=False)).cast("B") if len(values) else memoryview(b"")), 0
                for k in range(0, len(docs), 4096):
                    out = []
                    for d, n in docs[k : k + 4096]:
                        own = plain[4 * at : 4 * (at + n)]
                        out.append((d, row["start"] + at, n, zlib.crc32(own), bytes(own) if named else None))
                        at += n
                    kinds = [pa.int64()] * 4 + [pa.binary()] * len(named)
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", *named])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + "".join(f", `{x}` binary" for x in named)
    return manifest.select("file", "start").mapInArrow(step, schema)


#: Reading tasks at most; beyond, a task reads several files one after the other.
MOST_TASKS = 20_000


def round_trip(df: DataFrame, tokenizer_path: str, end_id: int, folder: str, **names) -> DataFrame:
    """Write the files, then read all their documents back."""
    manifest = written(write(df, tokenizer_path, end_id, folder, **names), "token-starts")
    tasks = min(max(1, manifest.count()), MOST_TASKS)
    return read(manifest.repartitionByRange(tasks, "start"), folder)
