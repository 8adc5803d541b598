"""Round trips through every source and sink: a derived table is written to a shared folder and read by the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bins import rounded
from ..functions.boxes import xyxy_to_xywhn
from ..sources import annotations as an
from ..sources import files as fs
from ..sources import tables as tb
from ..session import work_folder
from .fixtures import gt_boxes, roster, table
from .oracle import rnd, with_tables
from .registry import query

ROSTER = with_tables(f"SELECT dataset_index, image_id, stratum, {rnd('inclusion_probability', 9, 'p')}, {rnd('sampling_weight', 9, 'weight')} FROM fx_roster")


def _roster_rows(df):
    return df.select("dataset_index", "image_id", "stratum", rounded(F.col("inclusion_probability")).alias("p"), rounded(F.col("sampling_weight")).alias("weight"))


@query("csv_round_trip", ROSTER)
def csv_round_trip(spark, sf):
    """The roster as CSV in key order, read back with text keys and declared types."""
    folder = work_folder(spark)
    tb.write_table(roster(spark, sf), folder, order=["dataset_index"])
    return _roster_rows(tb.read_table(spark, folder, tb.SELECTED_IMAGES, label="roster"))


@query("shard_round_trip", with_tables("SELECT dataset_index, image_id, 'shard=' || CAST(dataset_index % 4 AS VARCHAR) AS shard, dataset_index % 4 + 1 AS place FROM fx_roster WHERE dataset_index % 4 <> 3"))
def shard_round_trip(spark, sf):
    """The roster in four shards; a list of shards names three of them and their order."""
    folder = work_folder(spark)
    r = roster(spark, sf).select("dataset_index", "image_id", "stratum", "inclusion_probability", "sampling_weight")
    r.withColumn("shard", F.col("dataset_index") % 4).write.partitionBy("shard").option("header", True).csv(folder)
    listed = spark.range(3).select(F.concat(F.lit("shard="), F.col("id")).alias("shard"), (F.col("id") + 1).alias("place"))
    return tb.read_shards(spark, folder, "*.csv", tb.SELECTED_IMAGES, listed).select("dataset_index", "image_id", "shard", "place")


@query("ledger_round_trip", with_tables("SELECT stratum, COUNT(*) AS n, MAX(dataset_index) AS last, CAST(ROW_NUMBER() OVER (ORDER BY stratum) - 1 AS INTEGER) AS position FROM fx_roster GROUP BY stratum"))
def ledger_round_trip(spark, sf):
    """One ledger document with an entry for each stratum, read in document order."""
    folder = work_folder(spark)
    entries = roster(spark, sf).groupBy("stratum").agg(F.count("*").alias("n"), F.max("dataset_index").alias("last"))
    entries.agg(F.array_sort(F.collect_list(F.struct("stratum", "n", "last"))).alias("entries")).coalesce(1).write.json(folder)
    return tb.read_ledger(spark, folder).select("stratum", "n", "last", "position")


@query("bundle_round_trip", with_tables("SELECT 'roster' AS \"table\", COUNT(*) AS n_rows, COUNT(*) AS n_records FROM fx_roster UNION ALL SELECT 'objects', COUNT(*), COUNT(*) FROM fx_gt"))
def bundle_round_trip(spark, sf):
    """A bundle of two tables: rows of the manifest and of the combined records."""
    folder = work_folder(spark)
    tb.write_bundle({"roster": roster(spark, sf), "objects": gt_boxes(spark, sf).select("gt_id", "image_id", "w", "h")}, folder)
    records = spark.read.json(f"{folder}/records").groupBy("table").agg(F.count("*").alias("n_records"))
    return spark.read.json(f"{folder}/manifest").select("table", "n_rows").join(records, "table")


@query(
    "shard_resume",
    with_tables("SELECT dataset_index % 8 AS shard, COUNT(*) AS n_pending FROM fx_roster WHERE dataset_index % 8 >= 3 GROUP BY 1"),
)
def shard_resume(spark, sf):
    """Shards written in two passes; what the completed ones leave pending."""
    folder = work_folder(spark)
    r = roster(spark, sf).withColumn("shard", F.col("dataset_index") % 8)
    for part in ("shard < 2", "shard >= 1 AND shard < 3"):
        tb.write_partitioned(r.filter(part), folder, "shard")
    left = tb.pending(r.withColumn("shard", F.col("shard").cast("string")), tb.completed(spark, folder, "shard"), "shard")
    return left.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n_pending"))


@query(
    "label_round_trip",
    with_tables(f"SELECT gt_id % 3 AS cls, COUNT(*) AS n, {rnd('SUM(w / 640e0)', 3, 'w')}, {rnd('SUM(h / 640e0)', 3, 'h')} FROM (SELECT DISTINCT gt_id % 3 AS gt_id, w, h, gx1, gy1, gt_id % 5 AS f FROM fx_box) q GROUP BY 1"),
)
def label_round_trip(spark, sf):
    """Label text of all objects in five folders, read back by row width; equal lines of a file are one object."""
    folder = work_folder(spark)
    n = xyxy_to_xywhn(F.col("box"), 640, 640)
    g = gt_boxes(spark, sf).select((F.col("gt_id") % 3).cast("int").alias("cls"), (F.col("gt_id") % 5).alias("part"), n.alias("n"))
    an.write_label_text(g, folder, F.array(*[F.col(f"n.{c}") for c in ("cx", "cy", "w", "h")]), by="part")
    rows = an.read_labels(spark, folder).withColumn("part", F.regexp_extract("file", "part=([0-9]+)", 1))
    rows = rows.select("cls", "part", "cx", "cy", "w", "h").distinct()
    return rows.groupBy(F.col("cls").cast("long").alias("cls")).agg(F.count("*").alias("n"), rounded(F.sum("w"), 3).alias("w"), rounded(F.sum("h"), 3).alias("h"))


@query(
    "coco_round_trip",
    with_tables("SELECT img AS image_id, '/x/labels/' || CAST(img AS VARCHAR) || '.txt' AS label, COUNT(*) AS n, CAST(SUM(w * h) AS DOUBLE) AS area FROM fx_gt GROUP BY img"),
)
def coco_round_trip(spark, sf):
    """Images and annotations as documents of one image each, read, joined and summed, with the label path."""
    folder = work_folder(spark)
    g = gt_boxes(spark, sf)
    note = F.struct(F.col("gt_id").alias("id"), F.col("img").alias("image_id"), F.lit(1).alias("category_id"), F.lit(0).alias("iscrowd"), (F.col("w") * F.col("h")).cast("double").alias("area"))
    image = F.struct(F.col("img").alias("id"), F.concat(F.lit("/x/images/"), "image_id", F.lit(".jpg")).alias("file_name"), F.lit(640.0).alias("width"), F.lit(640.0).alias("height"))
    docs = g.groupBy((F.col("img") % 16).alias("d")).agg(F.collect_set(image).alias("images"), F.collect_list(note).alias("annotations"))  # 16 documents
    docs.select("images", "annotations").repartition(16, "images").write.option("maxRecordsPerFile", 1).json(folder)
    joined = an.coco_join(*an.read_coco(spark, folder))
    return joined.groupBy("image_id", an.image_to_label(F.col("file_name")).alias("label")).agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query("ndjson_round_trip", "SELECT CAST(o_orderkey AS VARCHAR) AS file, CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, 1::BIGINT AS n_headers FROM orders")
def ndjson_round_trip(spark, sf):
    """A dataset record and one image record for each order."""
    folder = work_folder(spark)
    head = spark.range(1).select(F.lit('{"type": "dataset", "name": "x"}').alias("value"))
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.to_json(F.struct(F.lit("image").alias("type"), k.cast("string").alias("file"), F.when(k % 5 == 0, "val").otherwise("train").alias("split"))).alias("value"))
    head.unionByName(rows).write.text(folder)
    header, images = an.read_ndjson_dataset(spark, folder, "type string, file string, split string")
    return images.select("file", "split").withColumn("n_headers", header.agg(F.count("*").alias("n")).scalar())


@query("file_scan", "SELECT COUNT(DISTINCT o_orderkey % 6) AS n_files, SUM(LENGTH(CAST(o_orderkey AS VARCHAR)) + 1)::BIGINT AS total, TRUE AS hashed FROM orders")
def file_scan(spark, sf):
    """Six text files of all order keys: their number, total size and hash form."""
    folder = work_folder(spark)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value"), (F.col("o_orderkey") % 6).alias("f"))
    o.repartition("f").write.partitionBy("f").text(folder)  # one task a file, not one for all
    return fs.scan_files(spark, folder, "*.txt").agg(F.count("*").alias("n_files"), F.sum("size").alias("total"), F.bool_and(F.length("sha256") == 64).alias("hashed"))


@query(
    "prediction_exports",
    with_tables(
        f"""SELECT gt_id, CASE gt_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS name, gt_id % 3 AS class, {rnd('gt_id % 1000 / 1000e0', 5, 'confidence')}, {rnd('gx1 / 600', 5, 'x1')},
 CAST(img AS VARCHAR) AS stem, {rnd('gx1', 3, 'l')}, {rnd('gx2 - gx1', 3, 'bw')} FROM fx_box"""
    ),
)
def prediction_exports(spark, sf):
    """All objects as detections in both export forms."""
    g = gt_boxes(spark, sf).select(
        "gt_id", "image_id", F.concat("image_id", F.lit(".jpg")).alias("file_name"), (F.col("gt_id") % 3).cast("int").alias("cls"), (F.col("gt_id") % 1000 / 1000.0).alias("conf"),
        "box", F.lit(600.0).alias("width"), F.lit(600.0).alias("height"), F.col("gt_id").alias("track_id"),
    )
    a = an.export_detections(g, {0: "a", 1: "b", 2: "c"}, normalize=True).select(F.col("track_id").alias("gt_id"), "name", F.col("class").cast("long").alias("class"), rounded(F.col("confidence"), 5).alias("confidence"), rounded(F.col("box.x1"), 5).alias("x1"))
    b = an.coco_predictions(g, category=F.col("gt_id")).select(F.col("category_id").alias("gt_id"), F.col("image_id").alias("stem"), rounded(F.col("bbox")[0], 3).alias("l"), rounded(F.col("bbox")[2], 3).alias("bw"))
    return a.join(b, "gt_id")
