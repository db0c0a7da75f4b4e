"""Readers, writers and streams."""

import gzip
import json
import zipfile

from pyspark.sql import functions as F

from framequarry.operators import state
from framequarry.sources import readers, writers
from framequarry.streaming import runner


def test_predictions(spark, tmp_path):
    rows = [{"image_id": 1, "category_id": 2, "bbox": [0, 1, 2, 3], "score": 0.5}, {"image_id": 1, "category_id": 2, "bbox": [0, 1], "score": 0.5}, {"image_id": 2, "bbox": [1, 1, 1, 1]}]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    with gzip.open(tmp_path / "p.jsonl.gz", "wt") as f:
        f.write("\n".join([json.dumps(rows[0]), "", "[1]", "oops", json.dumps(rows[2])]))
    a = readers.predictions(spark, str(tmp_path / "p.json")).orderBy("ord").collect()
    b = readers.predictions(spark, str(tmp_path / "p.jsonl.gz")).orderBy("ord").collect()
    assert [(r.image_id, r.x, r.h, r.score) for r in a] == [(r.image_id, r.x, r.h, r.score) for r in b] == [(1, 0.0, 3.0, 0.5), (2, 1.0, 1.0, 0.0)]
    (tmp_path / "bad.json").write_text("{}")
    try:
        readers.predictions(spark, str(tmp_path / "bad.json"))
        raise AssertionError("a document that is no list must raise")
    except ValueError:
        pass


def test_coco_and_sequences(spark, tmp_path):
    doc = {"images": [{"id": 5, "file_name": "a.jpg", "width": 10, "height": 20}], "annotations": [{"id": 1, "image_id": 5, "category_id": 3, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 3, "name": "bird"}]}
    (tmp_path / "gt.json").write_text(json.dumps(doc))
    images, notes, cats = readers.coco(spark, str(tmp_path / "gt.json"))
    assert images.first().image_id == 5 and notes.first().area == 12.0 and notes.first().track_id == -1 and cats.first().name == "bird"
    out = str(tmp_path / "out")
    writers.coco_document(images, notes, cats, out)
    again = spark.read.json(out).first()
    assert again.annotations[0].bbox == [1.0, 2.0, 3.0, 4.0]
    (tmp_path / "s.json").write_text(json.dumps([{"video_id": "v", "frame_ids": [4, 5], "frame_files": ["a", "b"]}, {"seq_id": "w", "location": "x", "frames": [{"image_id": 9, "rel_path": "c"}]}]))
    got = readers.sequences(spark, str(tmp_path / "s.json")).orderBy("image_id").collect()
    assert [(r.video_id, r.frame_idx, r.image_id, r.file_name) for r in got] == [("v", 0, 4, "a"), ("v", 1, 5, "b"), ("w", 0, 9, "c")]


def test_cost_ids_zip_csv_xml(spark, tmp_path):
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps(r) for r in [{"image_id": 1, "latency_ms": 1.0}, {"image_id": -1}, {"image_id": 1, "latency_ms": 2.0}]))
    cost = readers.cost_log(spark, str(tmp_path / "c.jsonl.gz")).collect()
    assert [(r.image_id, r.latency_ms) for r in cost] == [(1, 2.0)]
    assert readers.cost_log(spark, "/dev/null") is None
    (tmp_path / "ids.json").write_text("[3, 1]")
    (tmp_path / "ids2.json").write_text('{"image_ids": [7]}')
    assert sorted(r.image_id for r in readers.image_ids(spark, str(tmp_path / "ids.json")).collect()) == [1, 3]
    assert [r.image_id for r in readers.image_ids(spark, str(tmp_path / "ids2.json")).collect()] == [7]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.json", '{"a": 4}')
    assert readers.zipped_json(spark, str(tmp_path / "z.zip"), "a int").first().a == 4
    (tmp_path / "r.csv").write_text("a,b\n1,\n")
    r = readers.csv_rows(spark, str(tmp_path / "r.csv")).first()
    assert (r.a, r.b) == ("1", None)
    (tmp_path / "v.xml").write_text("<annotation><size><width>100</width><height>50</height></size><object><name>bird</name><trackid>3</trackid><bndbox><xmin>-4</xmin><ymin>2</ymin><xmax>10</xmax><ymax>9</ymax></bndbox></object></annotation>")
    x = readers.voc_xml(spark, str(tmp_path / "v.xml")).first()
    assert (x.width, x.track_id, x.x, x.w, x.h) == (100, 3, 0.0, 10.0, 7.0)


def test_markdown(spark):
    text = writers.markdown(spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double"))
    assert text.splitlines()[2:] == ["| 1 | 0.5000 |", "| 2 | NA |"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(v, t, float((v * 5 + t) % 7)) for v in range(3) for t in range(20)]
    df = spark.createDataFrame(rows, "video_id int, frame_idx int, motion double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_idx")))
    late = spark.createDataFrame([(9, 0, 0.0)], "video_id int, frame_idx int, motion double").withColumn("ts", F.timestamp_seconds(F.lit(1_800_000_000)))
    src = str(tmp_path / "in")
    df.orderBy(F.rand(1)).repartition(3).write.parquet(src)
    late.write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = runner.run_machine(stream, state.motion_z(), ["motion"], delay="1000 seconds")
    q = out.writeStream.format("memory").queryName("machine_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.video_id, r.frame_idx): round(r.z, 9) for r in spark.table("machine_out").collect() if r.video_id < 9}
    want = {(r.video_id, r.frame_idx): round(r.z, 9) for r in state.fold(df, state.motion_z()).collect()}
    assert got == want
