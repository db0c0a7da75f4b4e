"""Near-duplicates: a multi-index Hamming join over b-bit MinHash signatures.

Documents with equal shingle sets form one class; everything after works on classes.  A class has
a signature of SYMBOLS b-bit MinHash values, cut into chunks.  If two signatures differ in at most
DISTANCE symbols, the pigeonhole principle gives a chunk with at most ERRORS differing symbols, so
every class is filed under each chunk with every choice of ERRORS symbols left out: all pairs of
signatures within DISTANCE share a key.  Pairs within DISTANCE are confirmed on the full sets.

Large groups of near copies: the members of a key are first confirmed against the key's first
class only (a star, linear in the rows); links found so join classes to components.  Then only
pairs of *different* components that share a key are compared, in blocks, so that no key's members
meet in one task.  No pair within DISTANCE is skipped: either it is compared or its two classes
are in one component already.

Defined cases: a document without words (or null) has no shingles, is linked with nothing and
forms its own component; with fewer words than a shingle takes, the whole sequence is its one
shingle; in `kept` rows that repeat a doc_id of one component share its fate, without_duplicates
keeps one row of each component; a null doc_id is no component's smallest id unless all its ids are
null; an empty table gives an empty one; input columns with a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, written

#: Signature: symbols of 16 bits, in chunks of CHUNK, each matched with ERRORS symbols left out.
SYMBOLS = 48
CHUNK = 4
ERRORS = 1
#: Guaranteed by pigeonhole: (chunks) * (ERRORS + 1) - 1.  A pair with similarity 0.8 differs in
#: 9.6 symbols on average (standard deviation 2.8), so 23 is beyond 4.8 deviations.
DISTANCE = SYMBOLS // CHUNK * (ERRORS + 1) - 1
#: A block's members and shingles; two blocks are compared in one task.
BLOCK = 512
BLOCK_ITEMS = 4_000_000

RESULTS = ["n_shingles", "component_id", "kept"]
_MULT = np.random.default_rng(7).integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(8).integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles."""
    words = (text or "").encode().lower().split()  # bytes: lower() changes A-Z only, split() ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - width + 1 + i]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SYMBOLS 16-bit values for each non-empty set."""
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    flat = np.concatenate(sets)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat(flat * _MULT[k] + _ADD[k], starts)
        out[:, k] = (least * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)
    return out


def _row_key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _sketched(df: DataFrame, text: str, doc_id: str, n: int, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, cls (128-bit digest of the set; null: empty), sig; keyed: `digest` of the text as well."""
    extra = ["digest"] if keyed else []

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, n) for t in part.column("_text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                cls, sig = [None] * len(sets), [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full])):
                        cls[i], sig[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary()), *map(part.column, extra)], ["doc_id", "n_shingles", "cls", "sig", *extra])

    rows = df.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), *[_row_key(text).alias(c) for c in extra])
    return rows.mapInArrow(step, "doc_id long, n_shingles long, cls binary, sig binary" + "".join(f", {c} binary" for c in extra))


def _keys(classes: DataFrame) -> DataFrame:
    """key, node: each class under every chunk with each of its symbols left out."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
            keys = []
            for c in range(SYMBOLS // CHUNK):
                for gone in range(CHUNK):
                    k = np.full(len(sig), c * CHUNK + gone + 1, np.uint64)
                    for s in range(CHUNK):
                        if s != gone:
                            k = (k << np.uint64(16)) | sig[:, c * CHUNK + s]
                    keys.append(k)
            # the symbols take 48 bits, the place above them 6
            key = np.concatenate(keys).astype(np.int64)
            both = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(node, len(keys)))], ["key", "node"])
            for at in range(0, both.num_rows, 100_000):
                yield both.slice(at, 100_000)

    return classes.select("node", "sig").mapInArrow(step, "key long, node long")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most DISTANCE symbols."""
    sig = classes.select("node", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sig_a", "sig_b"))
                fits = (x != y).sum(axis=1) <= DISTANCE
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(fits)) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(step, "a long, b long")


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """node, items: the full sets of some classes, made anew from the texts of their smallest doc_ids."""
    need = nodes.join(classes.select("node", "cls", F.col("doc_id").alias("_rep")), "node")
    # the same plan at every size: one shuffle of the texts by id
    texts = docs.join(need.hint("merge"), F.col("_id").eqNullSafe(F.col("_rep"))).select("node", "cls", "_text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, n) for t in part.column("_text").to_pylist()]
                # other rows may carry the same doc_id with another text
                own = [i for i, (s, c) in enumerate(zip(sets, part.column("cls").to_pylist())) if xxhash.xxh3_128_digest(s.tobytes()) == c]
                values = pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(own, pa.int64())), values], ["node", "items"])

    return written(texts.mapInArrow(step, "node long, items array<long>").dropDuplicates(["node"]), "dedup-sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(nodes, classes, docs, n)
    both = pairs.join(sets.toDF("a", "_x"), "a").join(sets.toDF("b", "_y"), "b")
    shared = F.size(F.array_intersect("_x", "_y"))
    both = both.select("a", "b", shared.alias("_i"), (F.size("_x") + F.size("_y")).alias("_n"))
    return both.where(F.lit(100) * F.col("_i") >= F.lit(percent) * (F.col("_n") - F.col("_i"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, root for all nodes of `links` (a, b) that aren't their component's smallest: large and small stars by turns."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "dedup-edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "dedup-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "dedup-edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.toDF("node", "root")
        state = now


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int, columns: list[str]) -> Iterator[list]:
    """Column lists of each run of equal keys in sorted batches; the first n_keys columns are the keys.

    Binary signatures become one matrix, lists of items stay Python lists of arrays.
    """
    held = None

    def opened(batch):
        out = []
        for c in columns:
            col = batch.column(c)
            if c == "sig":
                out.append(np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, SYMBOLS))
            elif c == "items":
                flat, ends = col.flatten().to_numpy(), col.offsets.to_numpy()
                rows = np.empty(len(col), object)
                for i in range(len(col)):
                    rows[i] = flat[ends[i] - ends[0] : ends[i + 1] - ends[0]]
                out.append(rows)
            else:
                out.append(col.to_numpy())
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = opened(batch)
        if held is not None:  # the last group may go on in this batch
            cols = [np.concatenate(x) for x in zip(held, cols)]
        change = np.zeros(len(cols[0]) - 1, bool)
        for k in cols[:n_keys]:
            change |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield [x[a:b] for x in cols]
        held = [x[cuts[-1] :] for x in cols]
    if held is not None:
        yield held


def _joined_labels(label: np.ndarray, sig: np.ndarray, linked) -> list[tuple[int, int]]:
    """Merges of labels over rows with different labels within DISTANCE for which linked(i, others) holds.

    A pair whose labels have been merged isn't looked at again: what comes out is a forest.
    """
    label, out = label.copy(), []
    for i in range(len(label) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(rest):
            continue
        rest = rest[(sig[rest] != sig[i]).sum(axis=1) <= DISTANCE]
        if len(rest):
            rest = rest[linked(i, rest)]
        for other in np.unique(label[rest]).tolist():
            out.append((min(other, int(label[i])), max(other, int(label[i]))))
            label[label == other] = label[i]
    return out


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _in_blocks(rows: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Deal a key's rows to blocks by a hash of their node, and each pair of blocks (i, j) to one group.

    blocks: key and `blocks`, their number for the key; no task has more than two blocks at once.
    """
    rows = rows.join(blocks, key)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "own", "other")
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "node")


def _near_components(busy: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of components that hold signatures within DISTANCE under a common key; busy: key, node, comp.

    For each key and task a forest of such pairs: as many rows as components at most.
    """
    mixed = busy.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("n")).where("c1 < c2")
    mixed = mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = busy.join(classes.select("node", "sig"), "node")
    rows = _in_blocks(rows.select("key", "node", "comp", "sig"), mixed, "key")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, _, _, comp, sig in _grouped(batches, 3, ["key", "i", "j", "comp", "sig"]):
            out += _joined_labels(comp, sig, lambda i, others: slice(None))
            if len(out) >= 10_000:
                yield _pairs_batch(out)
                out = []
        if out:
            yield _pairs_batch(out)

    return rows.mapInArrow(step, "a long, b long").distinct()


def _links_within(groups: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between components of one group, confirmed on full sets; groups: node, comp, grp.

    All pairs within DISTANCE of a group whose components aren't linked yet are compared, two blocks a task.
    """
    sets = _sets(groups.select("node"), classes, docs, n)
    sizes = groups.join(sets.select("node", F.size("items").alias("n")), "node").groupBy("grp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    blocks = sizes.select("grp", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("n") / BLOCK_ITEMS)).cast("int").alias("blocks"))
    rows = groups.join(classes.select("node", "sig"), "node").join(sets, "node")
    rows = _in_blocks(rows.select("grp", "node", "comp", "sig", "items"), blocks, "grp")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, comp, sig, items in _grouped(batches, 3, ["grp", "i", "j", "comp", "sig", "items"]):
            size = np.array([len(x) for x in items])
            ends = np.concatenate([[0], np.cumsum(size)])
            local = np.unique(np.concatenate(items), return_inverse=True)[1]
            mark = np.zeros(int(local.max()) + 1, bool)

            def linked(i: int, others: np.ndarray) -> np.ndarray:
                own = local[ends[i] : ends[i + 1]]
                mark[own] = True
                shared = np.array([np.count_nonzero(mark[local[ends[o] : ends[o + 1]]]) for o in others.tolist()])
                mark[own] = False
                return 100 * shared >= percent * (size[i] + size[others] - shared)

            if found := _joined_labels(comp, sig, linked):
                yield _pairs_batch(found)

    return rows.mapInArrow(step, "a long, b long")


def _rooted(df: DataFrame, shingle: int, percent: int, text: str, doc_id: str, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sketched rows; cls, doc_id (the smallest) and root (a number of the component) of each class."""
    docs = df.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = written(_sketched(df, text, doc_id, shingle, keyed), "dedup-rows")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "dedup-classes")

    # keys of two classes or more
    shared = _keys(classes).groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("key", "lead")
    shared = written(shared, "dedup-shared")
    busy = written(_keys(classes).join(shared, "key"), "dedup-busy")

    star = busy.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    star = written(_near(star, classes), "dedup-star")
    links = written(_confirmed(star, classes, docs, shingle, percent), "dedup-links")
    first = components(links)

    # what the stars left apart: components with near signatures form groups, and their links are sought within these
    labelled = busy.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    labelled = written(labelled, "dedup-labelled")
    near = written(_near_components(labelled, classes), "dedup-near")
    group = components(near)
    group = group.union(group.select("root", "root").distinct()).toDF("comp", "grp")
    members = written(labelled.select("node", "comp").distinct().join(group, "comp"), "dedup-members")
    links = first.toDF("a", "b").union(_links_within(members, classes, docs, shingle, percent))
    roots = components(links)

    return rows, classes.join(roots, "node", "left").select("cls", "doc_id", F.coalesce("root", "node").alias("root"))


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, one row per row of df."""
    rows, of_class = _rooted(df, shingle, percent, text, doc_id)
    # classes of one component, and rows of one class, may be many: their counts deal the hot ones evenly
    of_class = written(of_class.join(rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("_rows")), "cls"), "dedup-classed")
    total = rows.count()
    smallest = of_class.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_n"))
    of_class = joined(of_class.select("cls", "root", "_rows"), smallest, "root", "_n", total).select("cls", "component_id", "_rows")
    out = joined(rows.select("doc_id", "n_shingles", "cls"), of_class, "cls", "_rows", total)
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with one row of each near-duplicate component: of the smallest doc_id (null last), then the smallest digest of the text.

    Rows without shingles all stay.  Of rows equal in doc_id and text any one stays.
    """
    rows, of_class = _rooted(df, shingle, percent, text, doc_id, keyed=True)
    keys = rows.where("cls is not null").groupBy("cls", "doc_id", "digest").agg((F.count("*") > 1).alias("_many"))
    keys = written(keys.join(of_class.select("cls", "root"), "cls").select("root", "doc_id", "digest", "_many"), "dedup-rooted")
    lead = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("lead"), F.count("*").alias("_n"))
    keys = joined(keys, lead, "root", "_n", keys.count()).select("doc_id", "digest", "_many", (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("digest") == F.col("lead.digest"))).alias("_led"))
    # True: all rows of the key go; False: all but one
    odd = keys.where("not _led or _many").select(F.col("doc_id").alias("_odd"), F.col("digest").alias("_odd_digest"), (~F.col("_led")).alias("_gone"))
    odd = written(odd, "dedup-odd")

    # one shuffle of the texts, by id and digest; null ids have a key of their own
    keyed = df.withColumns({"__dup_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")), "__dup_none": F.col(doc_id).isNull(), "__dup_digest": _row_key(text)})
    odd = odd.select(F.coalesce("_odd", F.lit(0).cast("long")).alias("__dup_id"), F.col("_odd").isNull().alias("__dup_none"), F.col("_odd_digest").alias("__dup_digest"), F.col("_gone").alias("__dup_gone"))
    marked = keyed.join(odd.hint("merge"), ["__dup_id", "__dup_none", "__dup_digest"], "left")
    nr = F.row_number().over(Window.partitionBy("__dup_id", "__dup_none", "__dup_digest").orderBy("__dup_id"))
    kept = marked.withColumn("__dup_nr", nr).where("__dup_gone is null or (not __dup_gone and __dup_nr = 1)")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
