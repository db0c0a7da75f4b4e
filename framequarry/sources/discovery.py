"""Finding inputs: single files, splits, flat settings, lists of videos. Driver-side, over a file system's listing."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def listing(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that match a glob, on any file system Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return sorted(str(s.getPath()) for s in found) if found else []


def single_file(spark: SparkSession, patterns: list[str]) -> str | None:
    """The first path of the first pattern with a match."""
    return next((paths[0] for pattern in patterns if (paths := listing(spark, pattern))), None)


def available_splits(spark: SparkSession, folder: str, pattern: str = r"annotations_(.+)\.json$") -> list[str]:
    names = (path.rsplit("/", 1)[-1] for path in listing(spark, f"{folder}/*"))
    return sorted({m[1] for n in names if (m := re.search(pattern, n))})


def resolved_paths(spark: SparkSession, folder: str, split: str) -> tuple[str, str]:
    """Annotation and sequence files of a split; raises with the splits there are."""
    gt, seq = single_file(spark, [f"{folder}/annotations_{split}.json"]), single_file(spark, [f"{folder}/sequences_{split}.json"])
    if not gt or not seq:
        raise FileNotFoundError(f"split {split!r} is incomplete in {folder}; splits with annotations: {available_splits(spark, folder)}")
    return gt, seq


def flat_settings(text: str) -> dict[str, object]:
    """`key: value` lines; # starts a comment; numbers, booleans and null are read as such."""
    words = {"true": True, "false": False, "null": None, "none": None, "": None}
    out: dict[str, object] = {}
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        if colon and key.strip():
            v = value.strip().strip("'\"")
            if v.lower() in words:
                out[key.strip()] = words[v.lower()]
            else:
                out[key.strip()] = int(v) if re.fullmatch(r"[+-]?\d+", v) else float(v) if re.fullmatch(r"[+-]?(\d+\.\d*|\.?\d+)([eE][+-]?\d+)?", v) else v
    return out


def listed_ids(doc, preferred: tuple[str, ...] = ("video_ids", "videos", "dev_videos", "holdout_videos")) -> list[str]:
    """Ids of a list, or of the first list-valued key, preferred names first; items may be objects with video_id or id."""
    if isinstance(doc, dict):
        names = [k for k in preferred if isinstance(doc.get(k), list)] + [k for k, v in doc.items() if isinstance(v, list)]
        if not names:
            raise ValueError("no list of videos")
        doc = doc[names[0]]
    return [str(x.get("video_id", x.get("id"))) if isinstance(x, dict) else str(x) for x in doc]


def split_map(doc: dict) -> dict[str, list[str]]:
    """Split -> locations, from a document that may wrap it in `splits` and hold other keys."""
    inner = doc.get("splits", doc)
    return {str(k): [str(x) for x in v] for k, v in inner.items() if isinstance(v, list)}
