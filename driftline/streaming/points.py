"""Streams of track points: (video_id, track_id, frame, cls, cx, cy, ts).

Counts and heat use windowed aggregation with a watermark. Crossings, repetitions, alarms and linking keep a small state
per track or video, expire it by event time, and drop rows that arrive later than the watermark.
"""

from __future__ import annotations

import pickle
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.polygons import Point, array_contains, array_segments_cross
from ..operators import linking as lk
from ..operators.tracks import in_regions

POINTS = "video_id LONG, track_id LONG, frame LONG, cls STRING, cx DOUBLE, cy DOUBLE, ts TIMESTAMP"


def read_points(spark: SparkSession, path: str, schema: str = POINTS, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def region_counts(points: DataFrame, regions: Mapping[str, Sequence[Point]], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Objects per region and tumbling window."""
    held = in_regions(points.withWatermark("ts", late), regions)
    return held.groupBy(F.window("ts", window), "video_id", "region").agg(F.count("*").alias("n"))


def class_timeline(points: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Class counts per (sliding) window."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return points.withWatermark("ts", late).groupBy(w, "video_id", "cls").agg(F.count("*").alias("n"))


def heat(points: DataFrame, cell: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Point heat per grid cell and window."""
    return points.withWatermark("ts", late).groupBy(
        F.window("ts", window), "video_id", F.floor(F.col("cx") / cell).alias("gx"), F.floor(F.col("cy") / cell).alias("gy")
    ).agg((F.count("*") * 2).alias("heat"))


def occupancy(points: DataFrame, slots: Mapping[str, Sequence[Point]], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Distinct occupied slots per window, as a set of slot names (bounded by the slot list)."""
    held = in_regions(points.withWatermark("ts", late), slots, edge=True)
    taken = held.groupBy(F.window("ts", window), "video_id").agg(F.size(F.collect_set("region")).alias("occupied"))
    return taken.withColumn("available", F.lit(len(slots)) - F.col("occupied"))


def _expire(state, pdf: pd.DataFrame | None, ttl_ms: int) -> bool:
    """Remove a timed-out state; otherwise set its next expiry. True if it was removed."""
    if state.hasTimedOut:
        state.remove()
        return True
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(pdf["ts"].max().timestamp() * 1000)) + ttl_ms)
    return False


def line_crossings(points: DataFrame, region: Sequence[Point], late: str = "10 minutes", ttl_ms: int = 86_400_000) -> DataFrame:
    """First crossing of each track, emitted once. State: last point and whether the track was counted; it expires.

    Points not after the last one taken are late and dropped. The step test is that of the batch form on arrays.
    """
    xs, ys = [p[0] for p in region], [p[1] for p in region]
    vertical = max(xs) - min(xs) < max(ys) - min(ys)

    def steps(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        frame, x, y, counted = state.get if state.exists else (None, None, None, False)
        rows = pd.concat(list(frames)).sort_values("frame")
        _expire(state, rows, ttl_ms)
        rows = rows if frame is None else rows[rows["frame"] > frame]
        if not len(rows):
            return
        cx, cy = rows["cx"].to_numpy(float), rows["cy"].to_numpy(float)
        px, py = np.r_[np.nan if x is None else x, cx[:-1]], np.r_[np.nan if y is None else y, cy[:-1]]
        hit = array_segments_cross(px, py, cx, cy, region) if len(region) == 2 else array_contains(cx, cy, region)
        hit &= ~np.isnan(px)
        first = np.flatnonzero(hit)[:1]
        state.update((int(rows["frame"].iloc[-1]), float(cx[-1]), float(cy[-1]), bool(counted or len(first))))
        if not counted and len(first):
            forward = cx > px if vertical else cy > py
            yield rows.iloc[first][["video_id", "track_id", "frame", "cls"]].assign(direction=np.where(forward[first], "IN", "OUT"), ts=rows["ts"].iloc[first])

    return points.withWatermark("ts", late).groupBy("video_id", "track_id").applyInPandasWithState(
        steps, "video_id LONG, track_id LONG, frame LONG, cls STRING, direction STRING, ts TIMESTAMP", "frame LONG, cx DOUBLE, cy DOUBLE, counted BOOLEAN", "append", GroupStateTimeout.EventTimeTimeout
    )


def repetitions(points: DataFrame, angle: str, down: float, up: float, late: str = "10 minutes", ttl_ms: int = 86_400_000) -> DataFrame:
    """Running repetition count per track after each micro-batch. State: last frame, stage and count; late points are dropped."""

    def count(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, stage, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(frames)).sort_values("frame")
        _expire(state, rows, ttl_ms)
        rows = rows if last is None else rows[rows["frame"] > last]
        if not len(rows):
            return
        values = rows[angle].to_numpy()
        marks = np.where(values < down, "down", np.where(values > up, "up", ""))
        marks = marks[marks != ""]
        if len(marks):
            chain = np.concatenate([[stage or ""], marks])
            n += int(((chain[1:] == "down") & (chain[:-1] == "up")).sum())
            stage = str(marks[-1])
        state.update((int(rows["frame"].max()), stage, n))
        yield pd.DataFrame({"video_id": [key[0]], "track_id": [key[1]], "frame": [int(rows["frame"].max())], "count": [n], "stage": [stage]})

    return points.withWatermark("ts", late).groupBy("video_id", "track_id").applyInPandasWithState(
        count, "video_id LONG, track_id LONG, frame LONG, count LONG, stage STRING", "last LONG, stage STRING, n LONG", "update", GroupStateTimeout.EventTimeTimeout
    )


def alarms(points: DataFrame, threshold: int, late: str = "10 minutes") -> DataFrame:
    """One alarm per video: the first finished frame with enough detections. State after the window: one row per video."""
    frames = points.withWatermark("ts", late).groupBy(F.window("ts", "1 second"), "video_id", "frame").agg(F.count("*").alias("n"))
    return frames.filter(F.col("n") >= threshold).select("video_id", "frame", "n", F.col("window.end").alias("ts")).dropDuplicates(["video_id"])


def history(points: DataFrame, n: int = 30, late: str = "10 minutes", ttl_ms: int = 3_600_000) -> DataFrame:
    """The last n points of each track after each micro-batch. State: the points, dropped after the time to live."""

    def keep(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        xs, ys = state.get if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values("frame")
        _expire(state, rows, ttl_ms)
        xs, ys = ([*xs, *rows["cx"].tolist()])[-n:], ([*ys, *rows["cy"].tolist()])[-n:]
        state.update((xs, ys))
        yield pd.DataFrame({"video_id": [key[0]], "track_id": [key[1]], "xs": [xs], "ys": [ys]})

    return points.withWatermark("ts", late).groupBy("video_id", "track_id").applyInPandasWithState(
        keep, "video_id LONG, track_id LONG, xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>", "xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>", "update", GroupStateTimeout.EventTimeTimeout
    )


def link_tracks(dets: DataFrame, rules: lk.Rules | None = None, late: str = "10 minutes", ttl_ms: int = 3_600_000) -> DataFrame:
    """Track ids for a stream of detections. State per video: the open tracks; frames are taken in order within a batch.

    Frames not after the last one taken are late and dropped.
    """
    rules = rules or lk.Rules()

    def link(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, tracks = (state.get[0], pickle.loads(state.get[1])) if state.exists else (-1, lk.Tracks())
        rows = pd.concat(list(frames)).sort_values(["frame", "det"])
        _expire(state, rows, ttl_ms)
        out = []
        for frame, g in rows[rows["frame"] > last].groupby("frame", sort=True):
            linked = lk.advance(tracks, int(frame), g[["cx", "cy", "w", "h"]].to_numpy(float), g["conf"].to_numpy(float), g["cls"].to_numpy(), rules)
            ids = g["det"].to_numpy()
            out += [(key[0], int(frame), int(ids[j]), t) for j, t in linked]
            last = int(frame)
        state.update((last, pickle.dumps(tracks)))
        yield pd.DataFrame(out, columns=["video_id", "frame", "det", "link_id"])

    return dets.withWatermark("ts", late).groupBy("video_id").applyInPandasWithState(
        link, "video_id LONG, frame LONG, det LONG, link_id LONG", "last LONG, tracks BINARY", "append", GroupStateTimeout.EventTimeTimeout
    )
