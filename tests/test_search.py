"""Searching on a smaller copy, smoothed references, progress, and the worker's loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from rastrel.config import PRESETS, Config
from rastrel.kernels import contours, document, edges, paint, regions
from rastrel.operators import raster
from rastrel.plans import trace
from rastrel.sources import scenes
from rastrel.streaming import requests


def rectangles(scale: int = 1) -> np.ndarray:
    image = np.ones((30, 40, 4))
    image[5:20, 5:25, :3] = 30 / 255, 60 / 255, 180 / 255
    image[12:25, 17:35, :3] = 220 / 255, 60 / 255, 40 / 255
    return np.kron(image, np.ones((scale, scale, 1)))


def test_a_smaller_copy_is_searched_and_the_best_measured_whole():
    image, seen = rectangles(3), []
    found = trace.search(image, max_seeds=3, refine_top=1, rounds=1, max_side=40, progress=lambda done, total: seen.append((done, total)))
    assert 1 <= len(found) <= trace.RESCORED
    for c in found:
        metrics, points, size = trace.evaluate(image, Config.from_json(c["config"]))
        assert (c["points"], c["bytes"], c["match_pct"]) == (points, size, metrics["match_pct"])
    most = trace.budget(120, 90)
    assert all(trace.better(a, b, 99.0, most) <= 0 for a, b in zip(found, found[1:])) and found[0]["match_pct"] == 100.0
    assert [d for d, _ in seen] == sorted(d for d, _ in seen) and all(d <= t for d, t in seen) and seen[0] == (1, 3 + 12)
    assert len(trace.search(image, max_seeds=2, refine_top=1, rounds=1)) > 2  # at full size nothing is left out


def test_keyed_colours_are_in_every_candidate():
    found = trace.search(rectangles(), max_seeds=2, refine_top=1, rounds=1, transparent=("#ffffff",))
    assert all(Config.from_json(c["config"]).segment.transparent == ("#ffffff",) for c in found)


def test_progress_across_tasks(spark):
    done = spark.sparkContext.accumulator(0)
    image = np.floor(rectangles() * 255 + 0.5).astype(np.uint8)
    images = spark.createDataFrame([(i, 40, 30, bytearray(image.tobytes())) for i in range(2)], trace.IMAGES)
    got = trace.auto_select(images, done=done, max_seeds=2, refine_top=1, rounds=1, max_side=20).collect()
    assert {r["image_id"] for r in got} == {0, 1} and done.value >= 2 * 10


def test_smoothing_equals_the_relational_filter(spark):
    rng = np.random.default_rng(0)
    image = np.dstack([rng.random((5, 7, 3)), np.ones((5, 7))])
    rows = [(0, y, x, *map(float, image[y, x])) for y in range(5) for x in range(7)]
    table = spark.createDataFrame(rows, "image_id long, y int, x int, r double, g double, b double, a double")
    got = raster.bilateral(table, 2, 6.0).orderBy("y", "x").select(*"rgba").toPandas().to_numpy().reshape(5, 7, 4)
    assert np.allclose(got, paint.bilateral(image, 2, 6.0), atol=1e-9)
    assert paint.bilateral(image, 0) is image


def test_smoothing_forgives_block_damage_and_leaves_clean_images():
    clean = next(s for s in scenes.SUITE if s.name == "hard-rects").make()
    damaged = scenes.add_noise(scenes.add_block_artifacts(clean, 0.35), 0.02, 7)
    cfg = PRESETS["logo"]
    match = lambda image, smooth: trace.evaluate(image, cfg, smooth=smooth)[0]["match_pct"]
    assert match(damaged, (3, 4.0)) > match(damaged, None) + 1
    assert abs(match(clean, (3, 4.0)) - match(clean, None)) <= 0.1


def test_fit_within_is_the_relational_resize(spark):
    image = np.random.default_rng(1).random((9, 13, 4))
    rows = [(0, y, x, *map(float, image[y, x])) for y in range(9) for x in range(13)]
    table = spark.createDataFrame(rows, "image_id long, y int, x int, r double, g double, b double, a double")
    got = raster.fit_within(table, 6).orderBy("y", "x").select(*"rgba").toPandas().to_numpy()
    small = paint.fit_within(image, 6)
    assert max(small.shape[:2]) == 6 and np.allclose(got.reshape(small.shape), small, atol=1e-9)
    assert paint.fit_within(image, 0) is image and paint.fit_within(image, 13) is image


def test_grids_of_many_sizes_are_numbered_as_each_alone():
    rng = np.random.default_rng(2)
    grids = [rng.integers(-1, 3, (rng.integers(1, 9), rng.integers(1, 5))) for _ in range(60)]
    got = regions.components_of_many(np.concatenate([g.ravel() for g in grids]), np.array([g.size for g in grids]), np.array([g.shape[1] for g in grids]))
    assert (got == np.concatenate([regions.components(g).ravel() for g in grids])).all()


def test_scene_bands_equal_the_plan(spark):
    scene = next(s for s in scenes.SUITE if s.name == "alpha")
    got = scenes.render(spark, scene).orderBy("y", "x").select(*"rgba").toPandas().to_numpy().reshape(140, 140, 4)
    assert np.allclose(got, np.concatenate([scene.make(0, 50), scene.make(50)]), atol=1e-9)


def test_worker_handles_the_latest_request(spark, tmp_path):
    schema, seen = "image_id long, generation long, what string", []
    put = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, 1, "old"), (1, 3, "new"), (2, 1, "only"), (1, 2, "between")], "a")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    worker = requests.Worker(stream, lambda df: df.selectExpr("*", "upper(what) AS done"), lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "checkpoint"))
    try:
        worker.drain()
        assert sorted(seen) == [(1, 3, "new", "NEW"), (2, 1, "only", "ONLY")]
        put([(2, 2, "again")], "b")
        worker.drain()
        assert seen[-1] == (2, 2, "again", "AGAIN") and len(seen) == 3 and worker.busy() in (True, False)
    finally:
        worker.stop()
    with pytest.raises(Exception, match="nope"):
        failing = requests.Worker(stream, lambda df: df.selectExpr("nope"), lambda df, n: df.collect(), str(tmp_path / "other"))
        try:
            failing.drain()
        finally:
            failing.stop()


def test_a_search_of_many_small_images_takes_many_tasks(spark):
    """Images that come from an exchange by image_id are dealt out again; else their few bytes make one task."""
    from rastrel.sources import pixels

    rows = [(i, [float((i * j) % 7 < 3) - 0.5 for j in range(64)]) for i in range(12)]
    tiles = pixels.tiles(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), True)
    searched = trace.auto_select(trace.dense(tiles), max_seeds=1, refine_top=0)
    got = searched.withColumn("task", F.spark_partition_id()).collect()
    assert {r["image_id"] for r in got} == set(range(12)) and len({r["task"] for r in got}) > 1


def test_what_a_search_keeps_makes_no_difference():
    """Each candidate by itself against one search's memory of planes, fits and documents; edges of all arcs at once against each arc alone."""
    rng = np.random.default_rng(8)
    image = np.dstack([np.kron(rng.integers(0, 256, (4, 4)), np.ones((2, 2))) / 255] * 3 + [np.ones((8, 8))])
    for c in trace.search(image, max_seeds=4, refine_top=1, rounds=1):
        metrics, points, size = trace.evaluate(image, Config.from_json(c["config"]))
        assert (c["points"], c["bytes"]) == (points, size) and all(c[k] == v or v != v for k, v in metrics.items())
    cfg = PRESETS["clipart"].with_(segment__despeckle_area=0)
    seg = document.segment(image, cfg)
    plane = contours.subdivide(seg.regions)
    inner = [a for a in plane.arcs if not a.border]
    pre, tint = image, seg.colours
    together = edges._moved(inner, pre, tint, cfg.subpixel)
    assert len(inner) > 5 and all(np.array_equal(edges._moved([a], pre, tint, cfg.subpixel)[0], p) for a, p in zip(inner, together))


def test_images_searched_side_by_side_are_as_each_alone(monkeypatch):
    """Sizes mixed, fewer at once than there are, one that is large; and few array calls for each trace, whose count made 10,000 tiles too slow."""
    rng = np.random.default_rng(9)
    sizes = [(8, 8), (8, 8), (5, 9), (1, 1), (8, 8), (9, 5), (30, 20)]
    images = [np.dstack([*(rng.integers(0, 4, (h, w)) / 3 for _ in range(3)), rng.integers(0, 5, (h, w)) > 0]) for h, w in sizes]
    limits = {"max_seeds": 2, "refine_top": 1, "rounds": 1}
    monkeypatch.setattr(trace, "AT_ONCE", 4)
    monkeypatch.setattr(trace, "SMALL", 500)
    found = dict(trace.searches(images, **limits))
    assert sorted(found) == list(range(len(images)))
    plain = lambda c: {k: v for k, v in c.items() if v == v}
    for i, image in enumerate(images):
        assert [plain(c) for c in found[i]] == [plain(c) for c in trace.search(image, **limits)]
        for c in found[i][:6]:
            metrics, points, size = trace.evaluate(image, Config.from_json(c["config"]))
            assert plain(metrics | {"points": points, "bytes": size}).items() <= c.items()
    tiles, measured = [np.dstack([rng.random((8, 8))] * 3 + [np.ones((8, 8))]) for _ in range(4)], []
    one = edges._moved_of_many
    monkeypatch.setattr(edges, "_moved_of_many", lambda *a: measured.append(1) or one(*a))
    dict(trace.searches(tiles, **limits))
    together = len(measured)
    for tile in tiles:
        trace.search(tile, **limits)
    assert 0 < together <= (len(measured) - together) / 2
