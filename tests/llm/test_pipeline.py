"""The pipeline's stages against brute-force versions, and on odd tables."""

import base64

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framequarry.llm import dedup, quality
from framequarry.llm.common import written

from .test_llm import brute_components, brute_pii, brute_stats


def stages():
    return dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 <> 1")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, written(stage(spark, out[-1][1], sf_dir), name)))
    return dict(out)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf_dir, kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "byte_bpe"]
    for name in list(stages())[:-1]:
        assert kept[name].columns == kept["documents"].columns
    start, good = by_id(kept["documents"]), by_id(kept["quality_rules"])
    for i, r in start.items():
        n, _, _, _, repeats = brute_stats(r.text)
        if n < 50 or 100 * repeats > 50 * n:
            assert i not in good
    quality_one = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    clean = [i for i, r in start.items() if i in quality_one and not quality.base_failed(quality.text_stats([r.text]))[0]]
    assert sum(i in good for i in clean) >= 0.98 * len(clean)
    single = by_id(kept["near_duplicates"])
    comp = brute_components([(i, r.text) for i, r in good.items()], 5, 80)
    assert set(single) == {c for _, c in comp.values()}
    clean = by_id(kept["personal_data"])
    assert set(clean) == set(single)
    for i, r in clean.items():
        assert not brute_pii(r.text) and r.n_chars == len(r.text)
        if not brute_pii(single[i].text):
            assert r.text == single[i].text
    mixed = kept["source_mix"].collect()
    assert {r.doc_id for r in mixed} <= set(clean) and all(r.text == clean[r.doc_id].text for r in mixed)
    words = lambda rows: sum(len((r.text or "").encode().split()) for r in rows)
    assert 1.2 < words(mixed) / words(clean.values()) < 1.8
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = kept["byte_bpe"].collect()
    assert sorted(r.doc_id for r in coded) == sorted(r.doc_id for r in mixed)
    for r in coded:
        assert r.decoded_text == clean[r.doc_id].text
        assert np.frombuffer(r.token_ids, "<u4").tolist() == t.encode_ordinary(r.decoded_text) and r.n_tokens == len(r.token_ids) // 4


def test_odd_tables(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "a", 3, 7, "k"), (2, text + " a@b.cd", "en", None, None, 8, None), (2, text + " a@b.cd", "en", None, None, 8, None), (None, text + " zz " * 30, None, "a", 1, 9, "s"), (4, None, "en", "a", None, 1, "x"), (5, "", None, None, 0, 2, "y"), (6, "b " * 200000, "en", "b", 1, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, KEPT int, spans string")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf_dir)
            assert out.columns == docs.columns
            assert out.count() <= 3 * df.count()
        assert corpus_pipeline.byte_bpe(spark, df, sf_dir).count() == df.count()
    tagged = corpus_pipeline.personal_data(spark, docs, sf_dir).where("doc_id = 2").collect()
    assert len(tagged) == 2 and all(r.text.endswith(" <email>") and r.KEPT == 8 and r.spans is None for r in tagged)
    assert corpus_pipeline.quality_rules(spark, docs, sf_dir).where(F.col("text").isNull()).count() == 0
    assert dedup.without_duplicates(docs).where("doc_id = 1").count() == 1
