"""Operators against brute force, exact round trips, held-out accuracy; nulls, ties, empty tables, clashing names."""

import base64
import gzip
import hashlib
import io
import json
import os
import random
import re
import zipfile
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framequarry.llm import bpe, dedup, mixing, pii, quality, queries, range_coder, token_counts, token_output, topk, url_filter, warc
from framequarry.llm.common import scratch_path

from .test_findings import weights

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "ab" * 30000, "The the THE\u00a0x\u2003y", "日本語 😀 <|endoftext|> <|startoftext|>  \n\n x", "İstanbul ΣΣ ǅ 'll 've's 123456", "a\x1cb\x85c"]


def frame(spark, rows):
    """Documents of (id, text, source), with columns whose names clash with results."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, DOCS).repartition(3)
    for c in ("N_TOKENS", "spans", "kept", "target", "token_ids", "n_words", "taken"):
        df = df.withColumn(c, F.lit("old"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "s") for i, t in enumerate(ODD)] + [(None, "null id", "s"), (3, "one", "s"), (3, "one", "s")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())


# --- 1 ----------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 166.6666667, 83.3333333])
    assert mixing.targets([0, 10]) == pytest.approx([0, 15])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    size = rng.integers(0, 500, 400)
    for pi in (np.full(400, 0.3), rng.random(400)):
        end = mixing.fly(size, pi, rng)
        assert ((end > 0) & (end < 1)).sum() <= 2
        assert end.sum() == pytest.approx(pi.sum()) and (end * size).sum() == pytest.approx((pi * size).sum())
    hits = sum(mixing.fly(size[:20], np.full(20, 0.25), np.random.default_rng(s)) for s in range(800)) / 800
    assert abs(hits.mean() - 0.25) < 0.01 and np.abs(hits - 0.25).max() < 0.08  # inclusion probabilities hold


def test_mix(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for block in (16, 4096):
        rows = mixing.mix(docs, block=block).collect()
        assert len(rows) == docs.count()
        goal, got = {}, Counter()
        for r in rows:
            goal[r.source] = r.target
            got[r.source] += r.taken
            assert 0 <= r.taken <= 2 * r.size
        for s, t in goal.items():
            assert abs(got[s] - t) <= 2
    key = lambda rows: sorted((r.doc_id, r.taken) for r in rows)
    assert key(rows) == key(mixing.mix(docs.repartition(5)).collect())
    few = mixing.mix(odd).collect()
    assert len(few) == odd.count() and all(r.taken == 0 for r in few if r.size == 0)
    assert mixing.mix(odd.limit(0)).count() == 0
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    assert abs(copies.count() / docs.count() - 1.5) < 0.2
    again = mixing.mixed(odd)
    assert again.columns == odd.columns and again.where("text is null").count() <= 2


# --- 2 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("zip64", [False, True])
def test_zip(zip64):
    members = [("a/b.txt", b"hello" * 100), ("empty", b""), ("x.bin", os.urandom(1000))]
    raw = b"".join(warc.zip_bytes(members, zip64))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.comment = b"PK\x05\x06 a comment with a signature"
        for n, d in members:
            with z.open(zipfile.ZipInfo(n), "w", force_zip64=zip64) as f:
                f.write(d)
        z.writestr("packed", "a" * 100, zipfile.ZIP_DEFLATED)
    for data in (raw, made.getvalue()):
        found = warc.zip_members(lambda at, n: data[at : at + n], len(data))  # noqa: B023
        assert {n: data[a : a + k] for n, (a, k) in found.items()} == dict(members)


def test_record_round_trip():
    body = "<html>ü\r\n\r\n</html>".encode()
    digest = hashlib.sha1(body).hexdigest()
    raw = warc.warc_record(7, "http://a/\nx", body, digest, None)
    assert warc.parse_record(raw) == (7, len(body), digest, "response", None, "http://a/\nx", body)
    assert warc.parse_record(warc.warc_record(None, None, body, digest, 9)) == (None, len(body), digest, "revisit", 9, None, None)
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace("ü".encode(), b"uu"))


def test_warc(spark):
    big, small = "x" * 1000, "y" * 999
    rows = [(1, "u", big), (5, "v", big), (3, None, big), (2, "w", small), (4, "w", small), (6, "n", None), (7, "e", ""), (None, "z", big), (8, "é", "é" * 500), (9, "é", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    for options in ({}, {"zip64": True, "package_bytes": 10}):
        got = {r.page_id: r for r in warc.round_trip(spark, pages, scratch_path(spark, "w"), **options).collect()}
        assert len(got) == len(rows)
        assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 5), 3: ("revisit", 5), None: ("revisit", 5), 5: ("response", None), 2: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("revisit", 9), 9: ("response", None)}
        for i, _, html in rows:
            body = (html or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert warc.round_trip(spark, pages.limit(0), scratch_path(spark, "w")).count() == 0


# --- 3 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("block,width", [(4096, 16), (64, 16), (64, 20)])
def test_range_coder(block, width):
    rng = np.random.default_rng(0)
    cases = [np.array([], int), np.array([5]), rng.integers(0, 2**width, 3001), np.zeros(500, int), np.tile(np.arange(50), 20), np.full(100, 2**width - 1), rng.zipf(1.3, 5000) % 2**width, rng.zipf(1.1, 40000) % 2**width]
    for ids in cases:
        assert (range_coder.decode(range_coder.encode(ids, block, width), len(ids), block, width) == ids).all()
    text = np.tile(rng.integers(0, 40000, 300), 40)
    assert sum(map(len, range_coder.encode(text, 4096, 16))) < len(text)  # repeats cost less than half


def test_token_file_checks():
    ids = np.arange(3000) % 700
    docs = [(None, 1000), (4, 2000)]
    raw = token_output.file_bytes(docs, ids, 256)
    back, again = token_output.parse_file(raw)
    assert back == docs and (again == ids).all()
    broken = bytearray(raw)
    broken[60] ^= 1
    with pytest.raises(ValueError):
        token_output.parse_file(bytes(broken))
    with pytest.raises(ValueError):
        token_output.file_bytes([(1, 1)], np.array([70000]))


def test_token_files(spark, sf_dir, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        folder = scratch_path(spark, "t")
        manifest = token_output.write(df, path, 2, folder, file_ids=5000)
        got = sorted(map(tuple, token_output.read(manifest, folder).collect()), key=lambda r: r[1])
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        at = 0
        for (doc_id, start, n, crc), (want_id, text) in zip(got, rows, strict=True):
            ids = t.encode(text, add_special_tokens=False).ids + [2]
            assert (doc_id, start, n, crc) == (want_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += n
    assert token_output.round_trip(odd.limit(0), path, 2, scratch_path(spark, "t")).count() == 0


# --- 4 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, odd, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(m.encode(x))
    cache = scratch_path(spark, "cache")
    out = token_counts.count_tokens(odd, path, cache)
    assert [c for c in out.columns if c.lower() == "n_tokens"] == ["n_tokens"]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in out.collect())
    rows = odd.collect()
    assert got == sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), count(r.text or "")) for r in rows)
    stored = spark.read.parquet(cache).count()
    assert token_counts.count_tokens(odd, path, cache).count() == len(rows)
    assert spark.read.parquet(cache).count() == stored  # nothing was a miss
    more = odd.unionByName(odd.limit(1).withColumn("text", F.lit("a new text")))
    assert token_counts.count_tokens(more, path, cache).count() == len(rows) + 1
    assert spark.read.parquet(cache).count() == stored + 1
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0


# --- 5 ----------------------------------------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(PATTERNS[0], t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(PATTERNS[1], t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(PATTERNS[2], t):
        d = [int(c) for c in m.group() if c in "0123456789"]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(PATTERNS[3], t) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out)


def test_base_spans(texts):
    rng = random.Random(5)
    parts = ["a@b.c", "@", ".", "x", " ", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "256.1.1.1", "+1 (555) 010-9999", "+", "7", "-", "12.", "a.b@c-d.e.f", "00", "+44.20.7946.0958 ", "\n", "é@x.y", "%"]
    cases = [*map("".join, (rng.choices(parts, k=rng.randint(1, 14)) for _ in range(4000))), *texts.values(), "1" * 5000, "1.2.3." + "0" * 4000]
    for t in cases:
        assert pii.base_spans(t or "") == brute_pii(t or ""), t[:200]


def test_pii_field(spark, odd):
    w = weights()
    t = "Call +1 (017) 555-7713 now. Not 555-7712, but 555-7713x or a@b.cd; also 1.2.3.4 and 4111 1111 1111 1111."
    spans = pii.find([t, "no data 555-7713", None, ""], w)
    assert [s for s in spans[0] if not s[3]] == [(*s, False) for s in brute_pii(t)]
    assert spans[1:] == [[], [], []]
    twice = "Mail to +1 (017) 5557713 or ask 0175557713 and (017)5557713 again 0175557713"
    base = brute_pii(twice)
    found = pii.find([twice], w)[0]
    assert [s[:3] for s in found if not s[3]] == base
    same = "Id +1-017-555-7713 here; later 1.017.555.7713 there and 1-017-555-7713 too."
    added = [same[a:b] for a, k, b, x in pii.find([same], w)[0] if x]
    assert added == ["1.017.555.7713", "1-017-555-7713"]
    out = pii.detect(odd, clean="text")
    assert len([c for c in out.columns if c == "spans"]) == 1 and out.count() == odd.count()
    assert pii.detect(odd.limit(0)).count() == 0
    assert pii.redacted(t, spans[0]).startswith("Call <phone> now. Not 555-7712") and "4111" not in pii.redacted(t, spans[0])


def test_beliefs_on_a_tree():
    """On a graph without loops the messages give exact marginals."""
    rng = np.random.default_rng(3)
    g = pii.Graph([], [])
    g.doc, g.masks, g.seen = [0] * 4, [1, 2, 4, 9], [0, 0, 2, 0]
    g.chain, g.skip = np.array([[0, 1], [1, 2]]), np.array([[1, 3, 1]])
    chain = rng.normal(size=(pii.LABELS, pii.LABELS))
    w = pii.Weights(rng.normal(size=(pii.FEATURES, pii.LABELS)), chain + chain.T, rng.normal(size=(pii.LINKS, pii.LABELS)))
    unary = pii.feature_rows(g.masks) @ w.unary
    total = np.zeros((4, pii.LABELS))
    for y in np.ndindex(*[pii.LABELS] * 4):
        if y[2] != 2:
            continue
        e = sum(unary[i, y[i]] for i in (0, 1, 3)) + w.chain[y[0], y[1]] + w.chain[y[1], y[2]] + (w.skip[1, y[1]] if y[1] == y[3] else 0)
        for i in range(4):
            total[i, y[i]] += np.exp(e)
    want = total / total.sum(axis=1, keepdims=True)
    old, pii.ROUNDS = pii.ROUNDS, 60
    try:
        assert np.allclose(pii.beliefs(g, w), want, atol=1e-6)
    finally:
        pii.ROUNDS = old


# --- 6 ----------------------------------------------------------------------------------------


def brute_stats(t):
    w = WORD.findall(t or "")
    c = Counter(zip(w, w[1:], w[2:]))
    cover = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), len(cover)


def test_stats(texts):
    cases = [*texts.values(), *ODD, "a b c a b c", "a a a a", "x\n \nx\nx y\n\n"]
    s = quality.text_stats(cases)
    for i, t in enumerate(cases):
        assert tuple(int(s[k][i]) for k in quality.STATS) == brute_stats(t)


def test_quality_holdout():
    rows = duckdb.sql("select text, quality from '/root/testdata/sf0.1/documents.parquet' join '/root/testdata/sf0.1/labels.parquet' using (doc_id) order by doc_id").fetchall()
    s = quality.text_stats([r[0] for r in rows])
    good = np.array([r[1] == 1 for r in rows])
    half = len(rows) // 2
    forest, cut = quality.calibrated({k: v[:half] for k, v in s.items()}, good[:half])
    rest = {k: v[half:] for k, v in s.items()}
    base = quality.base_failed(rest)
    kept = ~base & (forest.score(quality.features(rest)) <= cut)
    g = good[half:]
    assert (g & ~base & ~kept).sum() <= 0.005 * g.sum()
    assert (~g & kept).sum() <= 0.05 * (~g).sum()


def test_quality_cases(spark, odd):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (3, None), (3, 1), (3, 0)], "doc_id long, quality int")
    out = quality.judge(odd, labels)
    assert out.count() == odd.count() and out.where("kept").count() == 0 and out.where("not base_failed").count() == 0
    assert quality.judge(odd.limit(0), labels.limit(0)).count() == 0
    long = frame(spark, [(1, " ".join(f"w{i}" for i in range(60)), "s"), (2, " ".join("ab" for i in range(60)), "s")])
    assert {r.doc_id: r.kept for r in quality.judge(long, labels.limit(0)).collect()} == {1: True, 2: False}


# --- 7 ----------------------------------------------------------------------------------------


def brute_url(url, rules=(("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [None, "", "nothing", "http://EXAMPLE.net/en/x", "http://example.net/EN/x", "https://a.b.net", "https://a.b.net/", "x://net/?q=/", "http://xnet/", "http://foo.example.com/de/1", "http://org/fr/", "http://o.org/fr", "http://a?://b.net/", "http://\u00e9.net/a\nb", "http://casino-win.example.com/", "http://h.net:80/", "a://b://c.net/"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("HOST", F.lit(1)).withColumn("rule", F.lit(2))
    for rows in (url_filter.judge(df).collect(),):
        for r in rows:
            host, path, rule, verdict = brute_url(r.url)
            assert (r.host, r.path, r.rule) == (host, path, rule), r.url
            assert r.verdict == (verdict or ("block" if "casino-" in host else "allow"))
    assert url_filter.judge(df.limit(0)).count() == 0
    old, url_filter.INLINE_RULES = url_filter.INLINE_RULES, 0
    try:
        joined = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    finally:
        url_filter.INLINE_RULES = old
    assert joined == {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    loose = (url_filter.pattern_rule("block", "[0-9]{2}", ()), url_filter.site_rule("allow", "b.net", "/"))
    got = {r.url: r.verdict for r in url_filter.judge(df, loose, default="none").collect()}
    assert got["http://h.net:80/"] == "block" and got["https://a.b.net/"] == "allow" and got["nothing"] == "none"
    assert {r.verdict for r in url_filter.judge(df, ()).collect()} == {"allow"}


# --- 8 ----------------------------------------------------------------------------------------


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 100]) for i in range(300)]
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")]), (450, [float("inf")]), (500, []), (550, [0.5]), (None, [1.0]), (551, [0.5]), (551, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(9)).repartition(3)
    usable = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))
    want = []
    for q, v in usable:
        if q % 50 == 0:
            best = sorted((-dot(v, w), c) for c, w in usable if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    old = topk.CANDIDATES, topk.QUERIES
    for sizes in (old, (17, 2)):
        topk.CANDIDATES, topk.QUERIES = sizes
        got = topk.search(df, F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    topk.CANDIDATES, topk.QUERIES = old
    two = df.where("vec_id in (0, 1)")
    assert topk.search(two, F.col("vec_id") == 0).count() == 1
    assert topk.search(df.limit(0), F.col("vec_id") == 0).count() == 0


# --- 9 ----------------------------------------------------------------------------------------


def brute_components(rows, n, percent):
    """rows: (id, text). Links by full sets, components by search."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    ids = sorted(sets)
    root = {i: i for i in ids}
    for x in ids:
        for y in ids:
            if x < y and sets[x] and root[x] != root[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((root[x], root[y]))
                    root = {k: a if v == b else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in ids}


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, nr = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(3, 150))
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((nr, " ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy)))
            nr += 1
    rng.shuffle(rows)
    df = frame(spark, [(i, t, "s") for i, t in rows])
    for n, percent in ((4, 80), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(df, n, percent).collect()}
        assert got == brute_components(rows, n, percent)
        assert {r.doc_id for r in dedup.without_duplicates(df, n, percent).collect()} == {c for _, c in got.values()}


def test_large_near_group(spark):
    """One chain of near copies larger than two blocks: links only between neighbours, none to the first."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(260):
        words[(i * 7) % 60] = f"n{i}"
        rows.append((i, " ".join(words)))
    old, dedup.BLOCK = dedup.BLOCK, 16
    try:
        got = {r.doc_id: r.component_id for r in dedup.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows]), 4, 80).collect()}
    finally:
        dedup.BLOCK = old
    assert got == {i: c for i, (_, c) in brute_components(rows, 4, 80).items()}


def test_dedup_cases(spark, odd):
    got = dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.n_shingles == 0)
    assert dedup.near_duplicates(odd.limit(0)).count() == 0
    unnamed = frame(spark, [(None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (7, "a b c d e f", "s")])
    assert {(r.doc_id, r.component_id, r.kept) for r in dedup.near_duplicates(unnamed).collect()} == {(None, 7, False), (7, 7, True)}


def test_pigeonhole():
    """All signature pairs within DISTANCE share a key."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 65536, dedup.SYMBOLS)
        b = a.copy()
        at = rng.choice(dedup.SYMBOLS, dedup.DISTANCE, replace=False)
        b[at] = (b[at] + 1) % 65536
        wrong = (a != b).reshape(-1, dedup.CHUNK).sum(axis=1)
        assert wrong.min() <= dedup.ERRORS


# --- 10 ---------------------------------------------------------------------------------------


def test_perfect_hash():
    keys = [os.urandom(random.Random(i).randint(1, 12)) + str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(5000))
    assert h.get(b"not there") == -1 and bpe.PerfectHash([]).get(b"x") == -1
    assert len(set(h.values)) == h.n == 5000  # minimal


def test_bpe(spark, odd, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.codec(path, public_tokenizers.PATTERN)
    rng = random.Random(1)
    noise = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x24F), rng.randint(0x4E00, 0x4F00), 10, 32])) for _ in range(60)) for _ in range(200)]
    for x in [*texts.values(), *noise, *ODD]:
        ids = c.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == t.encode_ordinary(x or "")
        assert c.decode(ids) == (x or "").encode()
    out = bpe.encode(odd, path, public_tokenizers.PATTERN, decoded="decoded")
    assert out.count() == odd.count()
    again = bpe.decode(out.select("doc_id", "token_ids", F.lit(1).alias("decoded")), path, public_tokenizers.PATTERN)
    key = lambda rows: sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.decoded)) for r in rows)
    assert key(again.collect()) == key(out.collect())
    assert bpe.encode(odd.limit(0), path, public_tokenizers.PATTERN).count() == 0


# --- queries ----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = c.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert sorted(str([r[k] for k in columns]) for r in df.collect()) == sorted(str([r[k] for k in columns]) for r in rows)


def test_query_digests(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op5_pii(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = brute_pii(t or "")
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == j for s in base) for j in range(4)]
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))
    for r in queries.op10_byte_bpe(spark, sf_dir).collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_index_lines(spark, sf_dir):
    folder = scratch_path(spark, "w")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(20)
    name = warc.write(pages, folder).first().package
    raw = open(f"{folder.removeprefix('file://')}/{name}", "rb").read()
    members = warc.zip_members(lambda at, n: raw[at : at + n], len(raw))
    at, n = members[warc.INDEX_NAME]
    for line in raw[at : at + n].decode().splitlines():
        place = json.loads(line.split(" ", 1)[1])
        start = members[warc.DATA_NAME][0] + place["offset"]
        assert gzip.decompress(raw[start : start + place["length"]]).startswith(b"WARC/1.1\r\n")
