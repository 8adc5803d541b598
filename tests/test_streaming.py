"""Streams against their batch twins, replayed file by file with availableNow."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import linking as lk
from driftline.operators import tracks as tk
from driftline.plans.fixtures import tracks
from driftline.plans.track_queries import LINE, SQUARES
from driftline.streaming import points as st


@pytest.fixture(scope="module")
def source(spark, sf, tmp_path_factory):
    """Track points as a few files in time order."""
    path = str(tmp_path_factory.mktemp("points"))
    df = tracks(spark, sf).select("video_id", "track_id", F.col("frame").cast("long").alias("frame"), "cls", "cx", "cy", F.col("ts").cast("timestamp").alias("ts"))
    n = 4
    parts = df.withColumn("part", F.ntile(n).over(__import__("pyspark").sql.Window.orderBy("ts"))).cache()
    for i in range(1, n + 1):
        parts.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path, parts.drop("part")


def run(spark, stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_region_counts(spark, source, tmp_path):
    path, batch = source
    got = run(spark, st.region_counts(st.read_points(spark, path, files_per_trigger=1), SQUARES, "1 day", "30 days"), "regions", tmp_path, "complete")
    want = tk.in_regions(batch, SQUARES).groupBy(F.window("ts", "1 day"), "video_id", "region").agg(F.count("*").alias("n"))
    assert rows(got, "window.start", "video_id", "region", "n") == rows(want, "window.start", "video_id", "region", "n")


def test_class_timeline_and_heat(spark, source, tmp_path):
    path, batch = source
    got = run(spark, st.class_timeline(st.read_points(spark, path, files_per_trigger=1), "1 day", late="30 days"), "classes", tmp_path, "complete")
    want = batch.groupBy(F.window("ts", "1 day"), "video_id", "cls").agg(F.count("*").alias("n"))
    assert rows(got, "window.start", "video_id", "cls", "n") == rows(want, "window.start", "video_id", "cls", "n")
    heat = run(spark, st.heat(st.read_points(spark, path), 10, "1 day", "30 days"), "heat", tmp_path, "complete")
    assert heat.agg(F.sum("heat")).first()[0] == 2 * batch.count()


def test_crossings(spark, source, tmp_path):
    path, batch = source
    got = run(spark, st.line_crossings(st.read_points(spark, path, files_per_trigger=1), LINE, "1 hour", 10**12), "crossings", tmp_path)
    want = tk.line_crossings(batch, LINE)
    assert rows(got, "video_id", "track_id", "frame", "direction") == rows(want, "video_id", "track_id", "frame", "direction")


def test_repetitions(spark, source, tmp_path):
    path, batch = source
    got = run(spark, st.repetitions(st.read_points(spark, path, files_per_trigger=1), "cy", 30, 70, "1 hour", 10**12), "reps", tmp_path, "update")
    last = got.groupBy("video_id", "track_id").agg(F.max_by("count", "frame").alias("count"), F.max_by("stage", "frame").alias("stage"))
    want = tk.repetitions(batch, "cy", 30, 70)
    assert rows(last.filter("stage IS NOT NULL"), "video_id", "track_id", "count", "stage") == rows(want, "video_id", "track_id", "count", "stage")


def test_history(spark, source, tmp_path):
    path, batch = source
    got = run(spark, st.history(st.read_points(spark, path, files_per_trigger=2), 5, "1 hour", 10**12), "history", tmp_path, "update")
    sizes = got.groupBy("video_id", "track_id").agg(F.max(F.size("xs")).alias("n"))
    want = tk.history(batch, 5).select("video_id", "track_id", F.size("points").alias("n"))
    assert rows(sizes, "video_id", "track_id", "n") == rows(want, "video_id", "track_id", "n")


def boxes(spark, n_frames, gap_at=None):
    """Two objects moving apart, one flickering in score."""
    out = []
    for f in range(1, n_frames + 1):
        frame = f if gap_at is None or f <= gap_at else f + 100
        for d, (x, y) in enumerate(((10 + 2 * f, 20), (200 - 2 * f, 120))):
            out.append((1, frame, d, float(x), float(y), 20.0, 20.0, 0.2 if d == 1 and f % 3 == 0 else 0.9, "a"))
    return spark.createDataFrame(out, "video_id long, frame long, det long, cx double, cy double, w double, h double, conf double, cls string")


def test_links_follow_the_objects(spark):
    out = lk.link_tracks(boxes(spark, 12))
    ids = {r["det"]: r["n"] for r in out.groupBy("det").agg(F.count_distinct("link_id").alias("n")).collect()}
    # Costs are fused with the score, so a weak detection (score 0.2) stays over the second limit and is not linked.
    assert ids == {0: 1, 1: 1} and out.count() == 20


def test_long_gap_starts_new_tracks(spark):
    out = lk.link_tracks(boxes(spark, 12, gap_at=6))
    assert out.select("segment").distinct().count() == 2


def test_linking_stream_equals_batch(spark, tmp_path):
    dets = boxes(spark, 12).withColumn("ts", F.timestamp_seconds(F.col("frame")))
    path = str(tmp_path / "dets")
    for lo in (0, 4, 8):
        dets.filter((F.col("frame") > lo) & (F.col("frame") <= lo + 4)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(dets.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(spark, st.link_tracks(stream, late="1 hour"), "links", tmp_path)
    want = lk.link_tracks(dets.drop("ts"))
    assert rows(got, "frame", "det", "link_id") == rows(want, "frame", "det", "link_id")


def test_optimal_pairs_beat_greedy():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for n, m in ((3, 4), (4, 3), (5, 5)):
        g = np.maximum(rng.uniform(-0.3, 1, (n, m)), 0)
        got = sum(g[a, b] for a, b in lk.optimal_pairs(g))
        small, big = min(n, m), max(n, m)
        gg = g if n <= m else g.T
        best = max(sum(gg[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert got == pytest.approx(best)


def test_alarm_once(spark, source, tmp_path):
    path, batch = source
    got = run(spark, st.alarms(st.read_points(spark, path), 1, "1 second"), "alarm", tmp_path)
    assert got.count() <= batch.select("video_id").distinct().count() and got.groupBy("video_id").count().filter("count > 1").count() == 0
