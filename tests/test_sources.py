"""Readers and writers on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from driftline.operators import dataset as ds
from driftline.operators import reconcile as rc
from driftline.sources import annotations as an
from driftline.sources import files as fl
from driftline.sources import tables as tb


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


def test_csv_keeps_leading_zeros_and_drops_the_mark(spark, tmp_path):
    p = write(tmp_path / "roster.csv", "﻿dataset_index,image_id,stratum,inclusion_probability,sampling_weight\n3,0007,a,0.5,2\n")
    r = tb.read_table(spark, p, tb.SELECTED_IMAGES).first()
    assert (r["image_id"], r["dataset_index"], r["sampling_weight"]) == ("0007", 3, 2.0)
    with pytest.raises(ValueError, match="lacks columns"):
        tb.read_table(spark, write(tmp_path / "bad.csv", "image_id\n1\n"), tb.SELECTED_IMAGES)


def test_full_event_and_curve_schemas_read_empty_cells_as_null(spark, tmp_path):
    for schema in (tb.BOUNDARY_EVENTS, tb.RADIUS_CURVE):
        names = schema.fieldNames()
        row = ["0012" if n == "image_id" else "" for n in names]
        p = write(tmp_path / f"{len(names)}.csv", ",".join(names) + "\n" + ",".join(row) + "\n")
        r = tb.read_table(spark, p, schema).first()
        assert r["image_id"] == "0012" and r[names[5]] is None


def test_shards_follow_the_roster(spark, tmp_path):
    schema = StructType([StructField("image_id", StringType()), StructField("v", StringType())])
    for s in ("s1", "s2", "s3"):
        write(tmp_path / s / "out.csv", f"image_id,v\n{s},1\n")
    roster = spark.createDataFrame([("s3", 0), ("s1", 1)], "shard string, position int")
    got = tb.read_shards(spark, str(tmp_path), "out.csv", schema, roster).orderBy("position").collect()
    assert [r["image_id"] for r in got] == ["s3", "s1"]


def test_ledger_and_missing_keys(spark, tmp_path):
    p = write(tmp_path / "l.json", json.dumps({"entries": [{"id": "a", "h": "x"}, {"id": "b", "h": "y"}]}))
    assert [r["id"] for r in tb.read_ledger(spark, p).orderBy("position").collect()] == ["a", "b"]


def test_sinks_refuse_to_overwrite_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    tb.write_bundle({"t": df}, str(tmp_path / "out"))
    with pytest.raises(Exception):
        tb.write_table(df, str(tmp_path / "out" / "t"))
    m = spark.read.json(str(tmp_path / "out" / "manifest")).first()
    assert m["n_rows"] == 2 and m["content_hash"] == tb.bundle_manifest({"t": df.orderBy(F.desc("k"))}).first()["content_hash"]
    assert spark.read.json(str(tmp_path / "out" / "records")).count() == 2


def test_partitioned_output_resumes(spark, tmp_path):
    path = str(tmp_path / "p")
    roster = spark.createDataFrame([("1",), ("2",), ("3",)], "image_id string")
    tb.write_partitioned(spark.createDataFrame([("1", 1), ("2", 2)], "image_id string, v int"), path)
    tb.write_partitioned(spark.createDataFrame([("2", 5), ("2", 6)], "image_id string, v int"), path)
    done = tb.completed(spark, path)
    assert {r["image_id"]: r["n_rows"] for r in done.collect()} == {"1": 1, "2": 2}
    assert [r[0] for r in tb.pending(roster, done).collect()] == ["3"]


def test_files_and_fixity(spark, tmp_path):
    write(tmp_path / "d" / "a.txt", "one")
    write(tmp_path / "d" / "x" / "b.txt", "two")
    found = fl.scan_files(spark, str(tmp_path / "d"))
    got = {r["path"]: (r["size"], r["sha256"]) for r in found.collect()}
    assert got["x/b.txt"] == (3, hashlib.sha256(b"two").hexdigest())
    manifest = spark.createDataFrame([("a.txt", 3, "0" * 64), ("c.txt", 1, "0" * 64)], "path string, size long, sha256 string")
    assert {r["path"]: r["status"] for r in rc.fixity(manifest, found).collect()} == {"a.txt": "hash_differs", "c.txt": "missing", "x/b.txt": "unlisted"}
    assert ds.dataset_digest(fl.list_files(spark, str(tmp_path / "d"))).first()["total_size"] == 6


def test_ndjson(spark, tmp_path):
    lines = [{"type": "dataset", "task": "detect"}, {"type": "image", "file": "a.jpg", "split": "train", "url": "u1"}, {"type": "image", "file": "b.jpg", "split": "val", "url": "u2"}]
    p = write(tmp_path / "d.ndjson", "\n".join(json.dumps(x) for x in lines) + "\n\n")
    header, images = an.read_ndjson_dataset(spark, p, "file STRING, split STRING, url STRING")
    assert header.count() == 1 and images.count() == 2
    assert {r[0] for r in an.ndjson_splits(images).collect()} == {"train", "val"}
    for x in lines[1:]:
        x["url"] += "?sig=2"
    q = write(tmp_path / "e.ndjson", "\n".join(json.dumps(x) for x in lines))
    assert an.ndjson_digest(spark, p).first() == an.ndjson_digest(spark, q).first()


COCO = {
    "images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50, "caption": "A red Car and a tree"}],
    "annotations": [
        {"id": 1, "image_id": 1, "category_id": 1, "iscrowd": 0, "bbox": [10, 10, 20, 10], "tokens_positive": [[2, 5], [6, 9]], "segmentation": [[0, 0, 50, 0, 50, 25]], "keypoints": [10, 25, 2]},
        {"id": 2, "image_id": 1, "category_id": 90, "iscrowd": 0, "bbox": [0, 0, 10, 10], "tokens_positive": [[16, 20]], "segmentation": [], "keypoints": [50, 5, 0]},
        {"id": 3, "image_id": 1, "category_id": 2, "iscrowd": 1, "bbox": [0, 0, 10, 10], "tokens_positive": [[16, 20]]},
        {"id": 4, "image_id": 1, "category_id": 2, "iscrowd": 0, "bbox": [0, 0, 0, 10], "tokens_positive": [[16, 20]]},
        {"id": 5, "image_id": 1, "category_id": 90, "iscrowd": 0, "bbox": [0, 0, 10, 10], "tokens_positive": [[16, 20]]},
    ],
}


def test_coco_and_grounding(spark, tmp_path):
    p = write(tmp_path / "c.json", json.dumps(COCO, indent=1))
    images, notes = an.read_coco(spark, p)
    rows = {(r["cls"], r["cx"], r["cy"]) for r in ds.coco_to_labels(images, notes).collect()}
    assert rows == {(0, 0.2, 0.3), (79, 0.05, 0.1)}
    g = {(r["text"], r["cls"]) for r in an.read_grounding(spark, p).collect()}
    assert g == {("red car", 0), ("tree", 1)}
    seg = ds.segment_labels(notes.filter("id = 1"), images).first()
    assert seg["polygon"] == [0.0, 0.0, 0.5, 0.0, 0.5, 0.5]
    kp = ds.keypoint_labels(notes.filter("id = 1"), images).first()
    assert kp["keypoints"] == [0.1, 0.5, 2.0]
    shape = ds.keypoint_shape(notes.filter("keypoints is not null")).first()
    assert (shape["consistent"], shape["n_keypoints"], shape["n_dims"]) == (True, 1, 3)


def test_label_text(spark, tmp_path):
    write(tmp_path / "l" / "a.txt", "0 0.5 0.5 0.2 0.2\n1 0.1 0.1 0.1 0.1\n")
    write(tmp_path / "l" / "b.txt", "2 0.1 0.2 0.5 0.2 0.5 0.6\n")
    rows = {r["file"].split("/")[-1] + str(r["cls"]): r for r in an.read_labels(spark, str(tmp_path / "l")).collect()}
    assert rows["a.txt0"]["cx"] == 0.5 and rows["a.txt0"]["polygon"] is None
    b = rows["b.txt2"]
    assert [round(b[c], 9) for c in ("cx", "cy", "w", "h")] == [0.3, 0.4, 0.4, 0.4]
    write(tmp_path / "k" / "a.txt", "0 0.5 0.5 0.2 0.2 0.1 0.2 -1 0.3\n")
    k = an.read_labels(spark, str(tmp_path / "k"), keypoints=2, dims=2).first()
    assert k["keypoints"] == [[0.1, 0.2, 1.0], [-1.0, 0.3, 0.0]]


def test_general_number_matches_printf(spark):
    values = [0.0, 0.5, 1 / 3, 123456.7, 1234567.0, 1e-5, 0.00012345678, 12.0, -0.25, 2e-7]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(an.general_number(F.col("v"))).collect()] == ["%g" % v for v in values]


def test_label_sink(spark, tmp_path):
    df = spark.createDataFrame([("im1", 2, 0.5, 0.25)], "image_id string, cls int, a double, b double")
    an.write_label_text(df, str(tmp_path / "o"), F.array("a", "b"))
    assert spark.read.text(str(tmp_path / "o")).first()["value"] == "2 0.5 0.25"


def test_paths_and_exports(spark):
    df = spark.createDataFrame([("d/images/x/images/a.b.jpg",)], "p string")
    assert df.select(an.image_to_label(F.col("p"))).first()[0] == "d/images/x/labels/a.b.txt"
    det = spark.createDataFrame([("i", "0042.jpg", 1, 0.123456789, 200.0, 100.0, (10.0, 20.0, 30.5, 40.0))], "image_id string, file_name string, cls int, conf double, width double, height double, box struct<x1:double,y1:double,x2:double,y2:double>")
    r = an.export_detections(det, {0: "a", 1: "b"}, normalize=True).first()
    assert (r["name"], r["confidence"], r["box"]["x1"], r["box"]["y2"]) == ("b", 0.12346, 0.05, 0.4)
    c = an.coco_predictions(det).first()
    assert (c["image_id"], c["bbox"], c["score"]) == ("42", [10.0, 20.0, 20.5, 20.0], 0.12346)
