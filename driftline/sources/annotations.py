"""Annotation formats: NDJSON datasets, COCO, label text, grounding documents, and detection exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import points_box, xyxy_to_ltwh

COCO_SCHEMA = """images ARRAY<STRUCT<id: BIGINT, file_name: STRING, width: DOUBLE, height: DOUBLE, caption: STRING>>,
 annotations ARRAY<STRUCT<id: BIGINT, image_id: BIGINT, category_id: INT, iscrowd: INT, area: DOUBLE, bbox: ARRAY<DOUBLE>,
 segmentation: ARRAY<ARRAY<DOUBLE>>, keypoints: ARRAY<DOUBLE>, tokens_positive: ARRAY<ARRAY<INT>>>>"""


def read_ndjson_dataset(spark: SparkSession, path: str, record_schema: str) -> tuple[DataFrame, DataFrame]:
    """Dataset record and image records of an NDJSON dataset. Lines are told apart by their ``type`` field."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    kind = F.get_json_object("value", "$.type")
    header = lines.filter(kind == "dataset").select(F.col("value").alias("record"))
    images = lines.filter(~kind.eqNullSafe(F.lit("dataset"))).select(F.from_json("value", record_schema).alias("_r"), F.col("value").alias("_line"))
    return header, images.select("_r.*", "_line")


def ndjson_splits(images: DataFrame) -> DataFrame:
    return images.select("split").distinct()


def ndjson_digest(spark: SparkSession, path: str) -> DataFrame:
    """Content hash of a dataset whose signed urls change with every export: lines without their ``url``, any order."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    bare = F.regexp_replace("value", r'"url"\s*:\s*"(?:[^"\\]|\\.)*"\s*,?\s*', "")
    part = F.conv(F.substring(F.sha2(bare, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    one = lines.agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("s"))
    return one.select(F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), "s"), 256), 1, 8).alias("digest"), F.col("n").alias("n_lines"))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of COCO documents (many files are read in parallel, one task per document)."""
    doc = spark.read.option("multiLine", True).schema(COCO_SCHEMA).json(path)
    images = doc.select(F.explode("images").alias("_i")).select("_i.*").withColumnRenamed("id", "image_id")
    notes = doc.select(F.explode("annotations").alias("_a")).select("_a.*")
    return images, notes


def coco_join(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return annotations.join(images, "image_id")


def image_to_label(path: Column) -> Column:
    """Label path of an image path: the last ``/images/`` becomes ``/labels/`` and the suffix ``.txt``."""
    return F.regexp_replace(F.regexp_replace(path, r"^(.*)/images/", "$1/labels/"), r"\.[^./]*$", ".txt")


def read_labels(spark: SparkSession, path: str, keypoints: int = 0, dims: int = 3) -> DataFrame:
    """Label rows of text files: class, box (cx, cy, w, h), polygon or keypoints by row width.

    A file with any row of more than six values is a polygon file: all of its rows are then polygons, turned to boxes.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    parts = F.transform(F.split("line", r"\s+"), lambda s: s.cast("double"))
    rows = lines.filter("line <> ''").select("file", F.md5("line").alias("_id"), parts.alias("v"))
    cls, rest = F.col("v")[0].cast("int"), F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0)))
    if keypoints:
        width = 5 + keypoints * dims
        checked = F.when(F.size("v") == width, F.col("v")).otherwise(F.raise_error(F.lit(f"labels require {width} columns")).cast("array<double>"))
        pts = F.transform(F.sequence(F.lit(0), F.lit(keypoints - 1)), lambda i: F.slice(F.slice(F.col("v"), 6, keypoints * dims), i * dims + 1, dims))
        if dims == 2:
            pts = F.transform(pts, lambda p: F.concat(p, F.array(F.when((p[0] < 0) | (p[1] < 0), 0.0).otherwise(1.0))))
        rows = rows.withColumn("v", checked)
        return rows.select("file", cls.alias("cls"), *[F.col("v")[i + 1].alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))], pts.alias("keypoints"))
    kinds = rows.groupBy("file").agg((F.max(F.size("v")) > 6).alias("_polygon"))
    rows = rows.join(kinds, "file")
    points = F.transform(F.sequence(F.lit(0), (F.size(rest) / 2).cast("int") - 1), lambda i: F.struct(F.element_at(rest, i * 2 + 1).alias("x"), F.element_at(rest, i * 2 + 2).alias("y")))
    b = points_box(points)
    poly = F.col("_polygon")
    return rows.select(
        "file", cls.alias("cls"),
        F.when(poly, (b["x1"] + b["x2"]) / 2).otherwise(F.col("v")[1]).alias("cx"),
        F.when(poly, (b["y1"] + b["y2"]) / 2).otherwise(F.col("v")[2]).alias("cy"),
        F.when(poly, b["x2"] - b["x1"]).otherwise(F.col("v")[3]).alias("w"),
        F.when(poly, b["y2"] - b["y1"]).otherwise(F.col("v")[4]).alias("h"),
        F.when(poly, rest).alias("polygon"),
    )


def read_grounding(spark: SparkSession, path: str) -> DataFrame:
    """Grounded boxes: class text cut from the caption by token spans, class ids per image by first appearance.

    Crowds, empty boxes and empty texts leave, and duplicates are removed. Returns (image_id, file_name, cls, text, cx, cy, w, h).
    """
    images, notes = read_coco(spark, path)
    return grounding_rows(images, notes)


def grounding_rows(images: DataFrame, notes: DataFrame) -> DataFrame:
    """See :func:`read_grounding`; the annotation id gives the order of appearance."""
    spans = F.transform("tokens_positive", lambda t: F.substring(F.col("caption"), t[0] + 1, t[1] - t[0]))
    text = F.trim(F.lower(F.array_join(spans, " ")))
    left, top, w, h = (F.col("bbox")[i] for i in range(4))
    rows = notes.filter("coalesce(iscrowd, 0) = 0").join(images.select("image_id", "file_name", "width", "height", "caption"), "image_id")
    rows = rows.select(
        "image_id", "file_name", "id", text.alias("text"), ((left + w / 2) / F.col("width")).alias("cx"), ((top + h / 2) / F.col("height")).alias("cy"),
        (w / F.col("width")).alias("w"), (h / F.col("height")).alias("h"),
    ).filter("w > 0 AND h > 0 AND text <> ''")
    seen = rows.groupBy("image_id", "text").agg(F.min("id").alias("_first"))
    order = seen.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", "text"))), lambda s: s["text"]).alias("_texts"))
    out = rows.join(order, "image_id").withColumn("cls", (F.array_position("_texts", F.col("text")) - 1).cast("int"))
    return out.groupBy("image_id", "file_name", "cls", "text", "cx", "cy", "w", "h").agg(F.min("id").alias("_id")).drop("_id")


def general_number(x: Column) -> Column:
    """Text of a number as ``%g`` writes it: six significant digits without trailing zeros."""
    six = F.format_string("%.5e", x.cast("double"))
    sci = F.regexp_replace(F.regexp_replace(six, r"(\.\d*?)0+e", "$1e"), r"\.e", "e")
    plain = F.regexp_replace(F.regexp_replace(six.cast("double").cast("decimal(30,14)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(x == 0, "0").when((F.abs(x) < 1e-4) | (F.abs(x) >= 1e6), sci).otherwise(plain)


def label_lines(df: DataFrame, values: Column) -> DataFrame:
    """Label text line of each object: class and numbers."""
    return df.withColumn("line", F.concat_ws(" ", F.col("cls").cast("string"), F.array_join(F.transform(values, general_number), " ")))


def write_label_text(df: DataFrame, path: str, values: Column, by: str = "image_id") -> None:
    """One folder per image with its label lines."""
    lines = label_lines(df, values).select(by, "line")
    lines.repartition(by).write.mode("errorifexists").partitionBy(by).text(path)


def export_detections(df: DataFrame, names: Mapping[int, str], *, normalize: bool = False, decimals: int = 5) -> DataFrame:
    """Detections as (name, class, confidence, box), rounded, optionally over the image size."""
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    w, h = (F.col("width"), F.col("height")) if normalize else (F.lit(1.0), F.lit(1.0))
    corners = [F.round(F.col(f"box.{c}") / (w if c[0] == "x" else h), decimals).alias(c) for c in ("x1", "y1", "x2", "y2")]
    extra = [F.col("track_id")] if "track_id" in df.columns else []
    return df.select(
        "image_id", lookup[F.col("cls")].alias("name"), F.col("cls").alias("class"), F.round("conf", decimals).alias("confidence"), F.struct(*corners).alias("box"), *extra
    )


def coco_predictions(df: DataFrame, *, category: Column | None = None) -> DataFrame:
    """COCO-style result rows: top-left box to three decimals, score to five; numeric file stems become numbers."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    b = xyxy_to_ltwh(F.col("box"))
    return df.select(
        F.coalesce(F.when(stem.rlike(r"^\d+$"), stem.cast("long").cast("string")), stem).alias("image_id"), "file_name",
        (F.col("cls") if category is None else category).alias("category_id"),
        F.array(*[F.round(b[c], 3) for c in ("l", "t", "w", "h")]).alias("bbox"), F.round("conf", 5).alias("score"),
    )


def write_coco_predictions(df: DataFrame, path: str, **how) -> None:
    coco_predictions(df, **how).write.mode("errorifexists").json(path)


