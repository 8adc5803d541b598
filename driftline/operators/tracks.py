"""Track analytics in batch. Points: (video_id, track_id, frame, cls, cx, cy).

Long tracks are worked in frame blocks, and per-track states come from aggregations where order is not needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.polygons import Point, contains, covers, segments_cross
from .ordered import previous_row

TRACK = ["video_id", "track_id"]
BLOCK = 4096


def frame_block(size: int = BLOCK) -> Column:
    return F.floor(F.col("frame") / size)


def crossing_direction(region: Sequence[Point], px: Column, py: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """(hit, direction) of a step against a line (two points) or a polygon. The longer side of the region sets the axis."""
    xs, ys = [p[0] for p in region], [p[1] for p in region]
    wide, tall = max(xs) - min(xs), max(ys) - min(ys)
    vertical = wide < tall
    forward = (cx > px) if vertical else (cy > py)
    hit = segments_cross(px, py, cx, cy, region) if len(region) == 2 else contains(cx, cy, region)
    return hit, F.when(forward, "IN").otherwise("OUT")


def line_crossings(points: DataFrame, region: Sequence[Point], *, block: Column | None = None) -> DataFrame:
    """First crossing of each track: (video, track, frame, cls, direction). A track counts once."""
    stepped = previous_row(points, TRACK, "frame", ["cx", "cy"], block=frame_block() if block is None else block)
    hit, direction = crossing_direction(region, F.col("prev_cx"), F.col("prev_cy"), F.col("cx"), F.col("cy"))
    crossed = stepped.filter(F.col("prev_cx").isNotNull() & hit).withColumn("direction", direction)
    first = crossed.groupBy(*TRACK).agg(F.min_by(F.struct("frame", "cls", "direction"), "frame").alias("_c"))
    return first.select(*TRACK, "_c.*")


def crossing_counts(crossings: DataFrame, by: Sequence[str] = ("cls",)) -> DataFrame:
    return crossings.groupBy(*by).agg(
        F.count_if(F.col("direction") == "IN").alias("n_in"), F.count_if(F.col("direction") == "OUT").alias("n_out")
    )


def in_regions(points: DataFrame, regions: Mapping[str, Sequence[Point]], *, edge: bool = False) -> DataFrame:
    """One row per (point, region that holds it). Regions are a short literal list, tested in one projection."""
    test = covers if edge else contains
    names = F.filter(F.array(*[F.when(test(F.col("cx"), F.col("cy"), poly), F.lit(n)) for n, poly in regions.items()]), lambda n: n.isNotNull())
    return points.withColumn("region", F.explode(names))


def region_counts(points: DataFrame, regions: Mapping[str, Sequence[Point]]) -> DataFrame:
    """Objects per region and frame."""
    return in_regions(points, regions).groupBy("video_id", "frame", "region").agg(F.count("*").alias("n"))


def queue_length(points: DataFrame, polygon: Sequence[Point]) -> DataFrame:
    """Tracks inside the polygon that have been seen before, per frame. "Seen before" is a frame after the track's first."""
    start = points.groupBy(*TRACK).agg(F.min("frame").alias("_start"))
    inside = points.filter(contains(F.col("cx"), F.col("cy"), polygon)).join(start, TRACK).filter(F.col("frame") > F.col("_start"))
    return inside.groupBy("video_id", "frame").agg(F.count("*").alias("queue"))


def first_points(points: DataFrame, n: int) -> DataFrame:
    """The first n points of each track; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    return points.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)


def track_speed(points: DataFrame, *, fps: float, meter_per_pixel: float, max_hist: int = 5, max_speed: float = 120.0) -> DataFrame:
    """Speed in km/h over the first ``max_hist`` points, capped and truncated; locked once per track."""
    at = lambda i: F.max(F.when(F.col("_r") == i, F.struct("frame", "cx", "cy")))
    ends = first_points(points, max_hist).groupBy(*TRACK).agg(at(1).alias("a"), at(max_hist).alias("b")).filter("b IS NOT NULL")
    dt = (F.col("b.frame") - F.col("a.frame")) / F.lit(float(fps))
    distance = F.hypot(F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy")) * F.lit(float(meter_per_pixel))
    speed = F.least(distance / dt * F.lit(3.6), F.lit(float(max_speed))).cast("int")
    return ends.filter(dt > 0).select(*TRACK, speed.alias("speed"))


def class_timeline(points: DataFrame, every: int, max_points: int) -> DataFrame:
    """Class counts at every n-th frame, the last ``max_points`` updates of each video."""
    counts = points.filter(F.col("frame") % every == 0).groupBy("video_id", "frame", "cls").agg(F.count("*").alias("n"))
    frames = counts.select("video_id", "frame").distinct()
    w = Window.partitionBy("video_id").orderBy(F.desc("frame"))
    kept = frames.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_points).drop("_r")
    return counts.join(kept, ["video_id", "frame"], "left_semi")


def heat_grid(boxes: DataFrame, by: Sequence[str], cell: int = 1, gain: int = 2) -> DataFrame:
    """Heat per grid cell: ``gain`` for every pixel inside the inscribed circle of each box.

    Equal boxes are counted first, so a box that recurs a million times is expanded once. Boxes: x0, y0, x1, y1 integers.
    """
    counted = boxes.groupBy(*by, "x0", "y0", "x1", "y1").agg(F.count("*").alias("_n"))
    c = F.col
    radius = F.floor(F.least(c("x1") - c("x0"), c("y1") - c("y0")) / 2)
    counted = counted.withColumns({"_r2": radius * radius, "_mx": F.floor((c("x0") + c("x1")) / 2), "_my": F.floor((c("y0") + c("y1")) / 2)})
    span = lambda a, b: F.when(c(b) > c(a), F.sequence(c(a), c(b) - 1)).otherwise(F.array().cast("array<bigint>"))
    pixels = counted.withColumn("x", F.explode(span("x0", "x1"))).withColumn("y", F.explode(span("y0", "y1")))
    dx, dy = c("x") - c("_mx"), c("y") - c("_my")
    inside = pixels.filter(dx * dx + dy * dy <= c("_r2"))
    return inside.groupBy(*by, F.floor(c("x") / cell).alias("gx"), F.floor(c("y") / cell).alias("gy")).agg((F.sum("_n") * gain).alias("heat"))


def pair_distance(points: DataFrame, first: int, second: int) -> DataFrame:
    """Distance of two chosen tracks in the frames that have both."""
    at = lambda t: F.max(F.when(F.col("track_id") == t, F.struct("cx", "cy")))
    both = points.filter(F.col("track_id").isin(first, second)).groupBy("video_id", "frame").agg(at(first).alias("a"), at(second).alias("b"))
    both = both.filter("a IS NOT NULL AND b IS NOT NULL")
    return both.select("video_id", "frame", F.hypot(F.col("a.cx") - F.col("b.cx"), F.col("a.cy") - F.col("b.cy")).alias("distance"))


def occupancy(points: DataFrame, slots: Mapping[str, Sequence[Point]]) -> DataFrame:
    """Occupied and available slots per frame; a centroid on the edge occupies."""
    spots = points.withColumns({"cx": F.col("cx").cast("int"), "cy": F.col("cy").cast("int")})
    frames = points.select("video_id", "frame").distinct()
    taken = in_regions(spots, slots, edge=True).groupBy("video_id", "frame").agg(F.count_distinct(F.col("region")).alias("occupied"))
    out = frames.join(taken, ["video_id", "frame"], "left").na.fill(0, ["occupied"])
    return out.withColumn("available", F.lit(len(slots)) - F.col("occupied"))


def alarms(points: DataFrame, threshold: int) -> DataFrame:
    """First frame of each video with at least ``threshold`` detections."""
    counts = points.groupBy("video_id", "frame").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)
    return counts.groupBy("video_id").agg(F.min("frame").alias("frame"), F.min_by("n", "frame").alias("n"))


def repetitions(angles: DataFrame, angle: str, down: float, up: float, *, block: Column | None = None) -> DataFrame:
    """Repetitions per track: a fall below ``down`` counts if the last stage was up. Also the final stage."""
    stage = F.when(F.col(angle) < down, "down").when(F.col(angle) > up, "up")
    marked = angles.withColumn("stage", stage).filter("stage IS NOT NULL")
    stepped = previous_row(marked, TRACK, "frame", ["stage"], block=frame_block() if block is None else block)
    return stepped.groupBy(*TRACK).agg(
        F.count_if((F.col("stage") == "down") & (F.col("prev_stage") == "up")).alias("count"), F.max_by("stage", "frame").alias("stage")
    )


def zone_filter(points: DataFrame, polygon: Sequence[Point]) -> DataFrame:
    return points.filter(contains(F.col("cx"), F.col("cy"), polygon))


def history(points: DataFrame, n: int = 30) -> DataFrame:
    """The last n points of each track in frame order; the group limit bounds every list."""
    w = Window.partitionBy(*TRACK).orderBy(F.desc("frame"))
    last = points.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    rows = F.sort_array(F.collect_list(F.struct("frame", "cx", "cy")))
    return last.groupBy(*TRACK).agg(F.transform(rows, lambda p: F.struct(p["cx"].alias("cx"), p["cy"].alias("cy"))).alias("points"))
