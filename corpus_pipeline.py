"""The corpus pipeline: quality rules, near-duplicates, personal data, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  run() writes every stage's rows to the shared folder and hands the reread table on.

In every stage null ids, texts and sources are values like others, extra columns may have any name and pass
unchanged, repeated rows are rows of their own unless said otherwise, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm import bpe, dedup, mixing, pii, quality
from framequarry.llm.common import written


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with names that no result of an operator clashes with, and the new names by the old."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(rows: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*names.values()).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the calibrated forest reject go.

    A null or empty text has no words and goes.  Repeated rows are judged alike.  Without labels of both kinds only the
    base rules decide.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, names = _renamed(docs)
    return _back(quality.judge(rows, labels, text=names["text"], doc_id=names["doc_id"]).where("kept"), docs, names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays (five-word shingles, similarity 0.8 or more).

    It is the one with the smallest doc_id (null last), then with the smallest digest of its text; of rows equal in both
    any one.  Texts without words are near to nothing: all of them stay.
    """
    rows, names = _renamed(docs)
    return _back(dedup.without_duplicates(rows, text=names["text"], doc_id=names["doc_id"]), docs, names)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind, as in <email>; n_chars follows the new text.

    Overlapping spans become the first one's kind (ties of start: in the order of kinds).  A null text stays null, with a
    null n_chars; texts without spans stay as they are.
    """
    rows, names = _renamed(docs)
    out = pii.detect(rows, text=names["text"], doc_id=names["doc_id"], clean=names["text"])
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.length(names["text"]).cast(docs.schema["n_chars"].dataType))
    return _back(out, docs, names)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stand in the result as often as the mix takes them: none, once or more.

    Rows are told apart by all columns; rows equal in all share their copies.  A text without words adds nothing to its
    source's total; null is a source of its own.
    """
    rows, names = _renamed(docs)
    return _back(mixing.mixed(rows, text=names["text"], doc_id=names["doc_id"], source=names["source"]), docs, names)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (little-endian unsigned 32-bit) and the text decoded from them; other columns end here.

    A null text counts as an empty one: no ids, an empty decoding.
    """
    coded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", F.col("decoded").cast("string").alias("decoded_text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The forest, the random field, the mix and BPE can't be said in SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
