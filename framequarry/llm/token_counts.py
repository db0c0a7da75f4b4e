"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer version digest, content digest, count).  Texts are
normalised (null: empty; otherwise unchanged, as counts depend on every byte), digested and
joined to the stored counts of the same tokenizer version; of the distinct misses one copy each
is encoded, and the new counts are appended to the cache.

Defined cases: a null text counts as an empty one; repeated texts are encoded once and all rows
get the count; rows that repeat a doc_id are all returned; an empty table gives an empty one;
input columns with a result's name are replaced.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, scratch_path, without, written

RESULTS = ["n_bytes", "n_tokens"]
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"

_LOADED: dict[str, object] = {}


def load_counter(path: str):
    """A function from texts to token counts: tokenizers for .json, sentencepiece for .model files."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _LOADED[path] = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    return _LOADED[path]


def version_digest(path: str) -> str:
    """Digest of the library's version and the vocabulary file: what a stored count depends on."""
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    with open(path, "rb") as f:
        return hashlib.sha256(f"{lib.__name__} {lib.__version__}\n".encode() + f.read()).hexdigest()


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored(spark, cache_path: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; a digest that two runs have appended appears once."""
    if _exists(spark, cache_path):
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    else:
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, tokenizer_path: str, cache_path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds n_bytes (UTF-8) and n_tokens; missing counts are appended to the table at cache_path (None: a new one)."""
    spark = df.sparkSession
    df = without(df, RESULTS)
    version = version_digest(tokenizer_path)
    cache_path = cache_path or scratch_path(spark, "token-counts")
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))

    rows = df.select(F.col(doc_id).alias("_id"), content.alias("_text"), digest.alias("_digest"))
    # one row of each distinct missing text is encoded: the smallest id's
    distinct = written(rows.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")), "token-digests")
    known = stored(spark, cache_path, version).select(F.col("digest").alias("_digest"))
    first = distinct.join(known, "_digest", "left_anti").select(F.col("_digest").alias("_want"), "_first")
    # the id is part of the key, so that copies of one text are not dealt to one task
    misses = rows.join(first, (F.col("_digest") == F.col("_want")) & F.col("_id").eqNullSafe(F.col("_first"))).select("_digest", "_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                n = count(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(n)), part.column("_digest"), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = stored(spark, cache_path, version).withColumnRenamed("digest", "_digest").join(distinct.select("_digest", "_n"), "_digest")
    total = distinct.agg(F.sum("_n")).first()[0] or 0
    keep = df.columns
    keyed = df.withColumns({"n_bytes": F.octet_length(content).cast("long"), "_digest": digest})
    return joined(keyed, counts, "_digest", "_n", total).select(*[F.col(f"`{c}`") for c in keep], "n_bytes", "n_tokens")
