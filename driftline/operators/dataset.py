"""Annotation data: label checks, conversions, statistics, tiles and dataset identity."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import compact_category
from ..functions.boxes import area, intersection
from ..functions.polygons import quad_foreground


def label_faults(cls: Column, cx: Column, cy: Column, w: Column, h: Column, n_classes: int) -> Column:
    """Name of the first rule a normalised label row breaks, null if it is sound."""
    return (
        F.when(F.greatest(cx, cy, w, h) > 1.01, "out_of_bounds")
        .when(F.least(cls.cast("double"), cx, cy, w, h) < -0.01, "negative")
        .when(cls >= n_classes, "class_out_of_range")
    )


def label_qa(images: DataFrame, labels: DataFrame, image: str, n_classes: int) -> DataFrame:
    """State of each image's label file: missing, empty, found or corrupt, with duplicate rows removed.

    One faulty row makes its file corrupt. ``labels`` holds (image, cls, cx, cy, w, h); an empty file has one row of nulls.
    """
    row = [F.col(c) for c in ("cls", "cx", "cy", "w", "h")]
    counted = labels.groupBy(image, *row).agg(F.count("*").alias("_copies"))
    fault = label_faults(*row, n_classes)
    per = counted.groupBy(image).agg(
        F.sum(F.when(F.col("cls").isNotNull(), F.col("_copies")).otherwise(0)).alias("n_rows"),
        F.count("cls").alias("n_distinct"),
        F.min(fault).alias("fault"),
    )
    joined = images.select(image).join(per, image, "left")
    status = F.when(F.col("n_rows").isNull(), "missing").when(F.col("fault").isNotNull(), "corrupt").when(F.col("n_rows") == 0, "empty").otherwise("found")
    return joined.select(
        image, status.alias("status"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce(F.col("n_rows") - F.col("n_distinct"), F.lit(0)).alias("n_duplicates"), "fault",
    )


def class_statistics(labels: DataFrame, split: str, cls: str, image: str) -> DataFrame:
    """Instances and images per split and class. Two levels, so that a frequent class is counted in many tasks."""
    per = labels.groupBy(split, cls, image).agg(F.count("*").alias("_n"))
    return per.groupBy(split, cls).agg(F.sum("_n").alias("instances"), F.count("*").alias("images"))


def split_statistics(images: DataFrame, labels: DataFrame, split: str, image: str) -> DataFrame:
    """Images and unlabelled images per split."""
    held = labels.select(image).distinct().withColumn("_l", F.lit(1))
    return images.join(held, image, "left").groupBy(split).agg(F.count("*").alias("images"), F.count_if(F.col("_l").isNull()).alias("unlabelled"))


def category_frequency(names: DataFrame, column: str, at_least: int = 0) -> DataFrame:
    """Frequency of each name in slash-separated class texts."""
    words = names.select(F.explode(F.split(column, "/")).alias("name")).withColumn("name", F.trim("name"))
    return words.groupBy("name").agg(F.count("*").alias("frequency")).filter(F.col("frequency") >= at_least)


def coco_to_labels(images: DataFrame, annotations: DataFrame, *, remap: bool = True) -> DataFrame:
    """Normalised label rows of COCO annotations: crowds and empty boxes leave, duplicates are removed.

    ``images``: (image_id, width, height); ``annotations``: (image_id, category_id, iscrowd, bbox ARRAY ltwh).
    """
    joined = annotations.filter("coalesce(iscrowd, 0) = 0").join(images.select("image_id", "width", "height"), "image_id")
    left, top, w, h = (F.col("bbox")[i] for i in range(4))
    cls = compact_category(F.col("category_id")) if remap else F.col("category_id") - 1
    rows = joined.select(
        "image_id", cls.alias("cls"), ((left + w / 2) / F.col("width")).alias("cx"), ((top + h / 2) / F.col("height")).alias("cy"),
        (w / F.col("width")).alias("w"), (h / F.col("height")).alias("h"),
    )
    return rows.filter("w > 0 AND h > 0").dropDuplicates()


def segment_labels(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Polygon label rows: vertices of a single-part segmentation divided by the image size."""
    joined = annotations.filter("coalesce(iscrowd, 0) = 0").join(images.select("image_id", "width", "height"), "image_id")
    flat = F.flatten("segmentation")
    scaled = F.transform(flat, lambda v, i: v / F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")))
    return joined.select("image_id", compact_category(F.col("category_id")).alias("cls"), scaled.alias("polygon"))


def keypoint_labels(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Keypoint label values: x and y divided by the image size, visibility kept."""
    joined = annotations.join(images.select("image_id", "width", "height"), "image_id")
    scaled = F.transform("keypoints", lambda v, i: F.when(i % 3 == 0, v / F.col("width")).when(i % 3 == 1, v / F.col("height")).otherwise(v))
    return joined.select("image_id", compact_category(F.col("category_id")).alias("cls"), scaled.alias("keypoints"))


def keypoint_shape(annotations: DataFrame, keypoints: str = "keypoints") -> DataFrame:
    """Keypoint count and dimension implied by annotation lengths and visibility values. One row."""
    lengths = annotations.groupBy(F.size(keypoints).alias("_n")).agg(
        F.bool_and(F.forall(F.filter(keypoints, lambda v, i: i % 3 == 2), lambda v: v.isin(0.0, 1.0, 2.0))).alias("_third")
    )
    agg = lengths.filter("_n > 0").agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"), F.bool_and("_third").alias("third"))
    triple = (F.col("lo") % 3 == 0) & F.col("third")
    return agg.select(
        (F.col("lo") == F.col("hi")).alias("consistent"),
        F.when(triple, F.col("lo") / 3).otherwise(F.col("lo") / 2).cast("int").alias("n_keypoints"),
        F.when(triple, 3).otherwise(2).alias("n_dims"),
    )


def rotated_labels(rows: DataFrame, text: str, width: Column, height: Column, classes: Sequence[str]) -> DataFrame:
    """Rotated-box labels from lines of eight coordinates, a class name and a difficulty."""
    parts = F.split(F.trim(text), r"\s+")
    xy = F.transform(F.slice(parts, 1, 8), lambda s: s.cast("double"))
    scaled = F.transform(xy, lambda v, i: v / F.when(i % 2 == 0, width).otherwise(height))
    cls = F.array_position(F.array(*[F.lit(c) for c in classes]), parts[8]) - 1
    return rows.filter(F.size(parts) >= 9).withColumns({"cls": cls, "corners": scaled, "difficult": F.get(parts, F.lit(9)).cast("int")})


def windows(images: DataFrame, crop: int = 1024, gap: int = 200, rate: float = 0.6, eps: float = 0.01) -> DataFrame:
    """Sliding crop windows per image, snapped to the far edges, filtered by the share of image area in the window.

    If no window of an image passes, those with the best share are kept. ``images``: (image_id, width, height).
    """
    step = crop - gap

    def starts(size):
        n = F.when(size <= crop, 1).otherwise(F.ceil((size - crop) / step + 1)).cast("int")
        last = F.when((n > 1) & ((n - 1) * step + crop > size), size - crop).otherwise((n - 1) * step)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == n - 1, last).otherwise(i * step).cast("int"))

    grid = images.withColumn("x_start", F.explode(starts(F.col("width")))).withColumn("y_start", F.explode(starts(F.col("height"))))
    grid = grid.withColumns({"x_stop": F.col("x_start") + crop, "y_stop": F.col("y_start") + crop})
    inside = (F.least("x_stop", "width") - F.col("x_start")) * (F.least("y_stop", "height") - F.col("y_start"))
    grid = grid.withColumn("rate", inside / float(crop * crop))
    best = F.max("rate").over(Window.partitionBy("image_id"))
    grid = grid.withColumn("_best", best)
    keep = F.when(F.col("_best") > rate, F.col("rate") > rate).otherwise(F.abs(F.col("rate") - F.col("_best")) < eps)
    return grid.filter(keep).select("image_id", "x_start", "y_start", "x_stop", "y_stop", "rate")


def window_objects(objects: DataFrame, wins: DataFrame, crop: int, threshold: float = 0.7) -> DataFrame:
    """Objects of each window with at least ``threshold`` of their area inside, re-based to the window.

    Range join by crop-sized cell: windows are put in every cell that can hold the corner of such an object, an object's
    top-left corner has one cell. A share of t limits a box to crop / t, so it begins at most (1 - t) / t crops before.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    reach = max(1, ceil((1 - threshold) / threshold))
    w = wins.withColumn("win", F.struct(*[F.col(a).cast("double").alias(b) for a, b in (("x_start", "x1"), ("y_start", "y1"), ("x_stop", "x2"), ("y_stop", "y2"))]))
    cell = lambda c: F.floor(c / float(crop))
    w = w.withColumn("_cx", F.explode(F.sequence(cell(F.col("x_start")) - reach, cell(F.col("x_stop"))))).withColumn(
        "_cy", F.explode(F.sequence(cell(F.col("y_start")) - reach, cell(F.col("y_stop"))))
    )
    o = objects.withColumns({"_cx": cell(F.col("box.x1")), "_cy": cell(F.col("box.y1"))})
    joined = o.join(w.drop("rate"), ["image_id", "_cx", "_cy"])
    share = intersection(F.col("box"), F.col("win")) / F.greatest(area(F.col("box")), F.lit(1e-6))
    out = joined.withColumn("share", share).filter(F.col("share") >= threshold)
    return out.select(
        "image_id", "gt_id", "x_start", "y_start", "share",
        *[(F.col(f"box.{c}") - F.col(s)).alias(c) for c, s in (("x1", "x_start"), ("y1", "y_start"), ("x2", "x_start"), ("y2", "y_start"))],
    )


def window_quads(objects: DataFrame, wins: DataFrame, crop: int, threshold: float = 0.7) -> DataFrame:
    """Quadrilaterals (``corners``, 8 numbers) of each window with at least ``threshold`` of their area inside, re-based to it.

    A range join of the corners' bounding box with the window by crop-sized cells, whatever the object's size or turn.
    """
    from .detection import near_pairs

    win = F.struct(*[F.col(a).cast("double").alias(b) for a, b in (("x_start", "x1"), ("y_start", "y1"), ("x_stop", "x2"), ("y_stop", "y2"))])
    xs, ys = (F.array(*[F.col("corners")[2 * i + d] for i in range(4)]) for d in (0, 1))
    around = F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    near = near_pairs(objects.withColumn("_box", around), wins.drop("rate").withColumn("win", win), ["image_id"], "_box", "win", float(crop))
    out = near.withColumn("share", quad_foreground("corners", F.array(*[F.col("win")[c] for c in ("x1", "y1", "x2", "y2")]))).filter(F.col("share") >= threshold)
    moved = F.transform("corners", lambda v, i: v - F.when(i % 2 == 0, F.col("x_start")).otherwise(F.col("y_start")))
    return out.select("image_id", "gt_id", "x_start", "y_start", "share", moved.alias("corners"))


def dataset_digest(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Dataset identity: total size and a hash over the ordered paths, built from per-folder hashes.

    Paths are hashed per bucket of their own hash first, so that no task holds all of them.
    """
    leaf = files.groupBy(F.substring(F.sha2(F.col(path), 256), 1, 3).alias("_b")).agg(
        F.sum(size).alias("_s"), F.sha2(F.array_join(F.array_sort(F.collect_list(path)), ""), 256).alias("_h")
    )
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda s: s["_h"])
    one = leaf.agg(F.sum("_s").alias("total_size"), F.sha2(F.array_join(hashes, ""), 256).alias("_p"))
    return one.select("total_size", F.sha2(F.concat(F.col("total_size").cast("string"), F.col("_p")), 256).alias("digest"))


def rounded_labels(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    return df.withColumn(column, F.transform(column, lambda v: F.round(v, digits)))
