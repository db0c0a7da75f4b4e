"""Writers: JSON documents and lines, CSV, COCO exports, Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl_gz(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines, gzip; as many files as tasks."""
    df.write.mode(mode).option("compression", "gzip").option("ignoreNullFields", False).json(path)


def report_csv(df: DataFrame, path: str, first: list[str], mode: str = "error") -> None:
    """A small report as one CSV file: the columns in `first`, then the others by name."""
    rest = sorted(c for c in df.columns if c not in first)
    df.select(*[F.col(f"`{c}`") for c in [*first, *rest]]).coalesce(1).write.mode(mode).option("header", True).csv(path)


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, mode: str = "error") -> None:
    """images (one row for each id), annotations (x, y, w, h) and categories as one JSON document."""
    box = F.array("x", "y", "w", "h").alias("bbox")
    own = images.dropDuplicates(["image_id"]).withColumnRenamed("image_id", "id")
    notes = annotations.withColumnRenamed("ann_id", "id")
    notes = notes.select(*[c for c in notes.columns if c not in ("x", "y", "w", "h", "ord")], box)
    listed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in df.columns if c != "id"]))).alias(name))
    doc = listed(own, "images").join(listed(notes, "annotations")).join(listed(categories, "categories"))  # one row each
    doc.coalesce(1).write.mode(mode).json(path)


def sequence_list(frames: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON line for each video with its frames in order."""
    item = F.struct("frame_idx", "image_id", "file_name")
    rows = frames.groupBy("video_id").agg(F.sort_array(F.collect_list(item)).alias("f"))
    rows.select("video_id", F.transform("f", lambda x: x["image_id"]).alias("frame_ids"), F.transform("f", lambda x: x["file_name"]).alias("frame_files")).write.mode(mode).json(path)


def markdown(df: DataFrame, digits: int = 4, rows: int = 1000) -> str:
    """A report as a Markdown table; null is NA. More than `rows` rows are an error: such a table is no report."""

    def cell(v) -> str:
        return "NA" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows for a Markdown table")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in found)])
