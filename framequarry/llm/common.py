"""Helpers shared by the operators: shared scratch space, clash-free columns, words."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: \x20 and \x09-\x0D (what bytes.split() splits on).
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: A key that more than one in MOST_HOT rows share is hot: there are fewer than MOST_HOT such keys.
MOST_HOT = 4000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="framequarry-")
        sc.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder; it is removed when the driver's JVM ends."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows left joined with `table` (one row for each key), however many rows share a key; `n` (dropped): table's count of its key's rows.

    Keys of more than total / MOST_HOT rows, fewer than MOST_HOT, are broadcast; their rows are dealt evenly to the
    join of the other keys, where they find nothing.
    """
    names = [c for c in table.columns if c not in (key, n)]
    hot = F.col(n) * MOST_HOT > total
    often = table.where(hot).select(F.col(key).alias("_hot"), F.struct(*names).alias("_given"))
    rest = table.where(~hot).select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_deal"), F.struct(*names).alias("_found"))
    out = rows.join(F.broadcast(often), F.col(key) == F.col("_hot"), "left")
    # rows without a key find nothing either
    alone = F.col("_hot").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_at", F.when(alone, F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long")))
    out = out.join(rest, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_deal")), "left")
    got = F.coalesce("_given", "_found")
    return out.withColumns({c: got[c] for c in names}).drop("_hot", "_given", "_key", "_deal", "_found", "_at")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns whose names clash (ignoring case) with the result columns in `names`."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    return df.drop(*clash) if clash else df


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(col):
    """Number of maximal runs without ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
