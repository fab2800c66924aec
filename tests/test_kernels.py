"""Hand-computed cases of the kernels and of order-dependent operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.operators import borders, color, mesh, polygon, polyline, regions, spatial, stencil
from pixelweft.sources.images import Options, default_output, png


def grid(spark, rows):
    return spark.createDataFrame([(0, y, x, v) for y, r in enumerate(rows) for x, v in enumerate(r)], "image_id int, y int, x int, value int")


def test_checkerboard_components(spark):
    g = grid(spark, [[1, 2, 1], [2, 1, 2], [1, 2, 1]])
    for label in (regions.label_kernel, regions.label_relational):
        assert label(g, True).select("region_id").distinct().count() == 2
        assert label(g, False).select("region_id").distinct().count() == 9


def test_both_labellings_agree_on_noise(spark):
    rng = np.random.default_rng(3)
    g = grid(spark, rng.integers(0, 3, (20, 23)).tolist())
    for diagonals in (True, False):
        a = {tuple(r) for r in regions.label_kernel(g, diagonals).select("y", "x", "region_id").collect()}
        b = {tuple(r) for r in regions.label_relational(g, diagonals).select("y", "x", "region_id").collect()}
        assert a == b


def test_rasterised_lines(spark):
    e = spark.createDataFrame([(1, 0, 0, 2, 4), (2, 3, 3, 3, 3)], "id int, y0 int, x0 int, y1 int, x1 int")
    got = [tuple(r) for r in polyline.rasterize(e, ["id"]).orderBy("id", "i").select("id", "y", "x").collect()]
    assert got == [(1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 1, 3), (1, 2, 4), (2, 3, 3)]


def test_simplification_keeps_its_quirk_unless_strict():
    p = np.array([(0, 0), (9, 1), (0, 2), (0, 3)], float)
    assert polyline.keep_points(p, 1.0, False) == [1, 3]
    assert polyline.keep_points(p, 1.0, True)[0] == 0 and 1 in polyline.keep_points(p, 1.0, True)


def test_walk_orders_a_disc():
    disc = {(y, x) for y in range(21) for x in range(21) if (y - 10) ** 2 + (x - 10) ** 2 <= 64}
    rim = [p for p in disc if any((p[0] + a, p[1] + b) not in disc for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
    path = borders.walk(rim, disc)
    assert len(path) == len(set(path)) and len(path) >= len(rim) - 2
    assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))


def test_tour_and_cuts():
    steps = borders.tour([((0, 0), (0, 5)), ((5, 5), (0, 6)), ((5, 0), (5, 4))])
    assert [s[0] for s in steps] == [0, 1, 2] and steps[0] == (0, 1, 1, 1)
    a, b = polygon.cut(list("abcdef"), 1, 4)
    assert a == list("bcde") and b == list("efab")


def test_polygon_parts_cover_their_polygon():
    area = lambda p: abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(p, [*p[1:], p[0]], strict=True))) / 2
    star = [(32 + dy * r, 32 + dx * r) for (dy, dx), r in zip([(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)], [12, 4, 11, 5, 10, 4, 12, 6], strict=True)]
    parts = polygon.convex_parts(star)
    assert sum(map(area, parts)) == area(star) and len(parts) > 1
    assert all(len(q) <= 4 for p in parts for q in polygon.peel_quads(p))


def test_subdivided_square(spark):
    q = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 4), (1, 2, 4, 4), (1, 3, 4, 0)], "polygon_id int, pos int, y int, x int")
    rows = polygon.subdivide(q, 2).collect()
    assert len(rows) == 16 and sum((r.y, r.x) == (2, 2) for r in rows) == 4


def test_smoothing_moves_inner_points_only():
    polys = [[(0, 0), (0, 10), (7, 7), (10, 0)], [(0, 10), (0, 20), (10, 20), (7, 7)], [(10, 0), (7, 7), (20, 10), (20, 0)], [(7, 7), (10, 20), (20, 20), (20, 10)]]
    to = mesh.smooth_points(polys)
    assert to[(0, 0)] == (0, 0) and to[(7, 7)] == (10, 10)


def test_triangles_become_quads():
    tri = [[(0, 0), (0, 10), (10, 0)], [(0, 10), (10, 10), (10, 0)]]
    assert all(len(p) == 4 for p in mesh.triangles_to_quads(tri))
    strip = [[(0, 10 * k), (0, 10 * k + 10), (10, 10 * k + 10), (10, 10 * k)] for k in range(3)]
    strip[0] = [(0, 0), (0, 10), (10, 10)]
    assert all(len(p) == 4 for p in mesh.triangles_to_quads(strip))


def test_quads_of_pieces_cover_triangles():
    area = lambda p: abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(p, [*p[1:], p[0]], strict=True))) / 2
    ring = [(0, 0), (0, 40), (0, 80), (40, 80), (80, 80), (80, 40), (80, 0), (40, 0)]
    fan = [[(41, 43), a, b] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    inner = [[(20, 20), (20, 60), (60, 60)], [(20, 20), (60, 60), (60, 20)]]
    rim = [[(0, 0), (0, 80), (20, 60), (20, 20)], [(0, 80), (80, 80), (60, 60), (20, 60)], [(80, 80), (80, 0), (60, 20), (60, 60)], [(80, 0), (0, 0), (20, 20), (60, 20)]]
    short = [[(0, 0), (0, 1), (1, 0)], [(0, 1), (1, 1), (1, 0)]]
    for pieces, whole in ((fan, 6400), (inner + rim, 6400), (inner[:1] + [[(20, 20), (60, 60), (60, 20)]] + rim, 6400), (short, 1)):
        got = mesh.quads_of_pieces(pieces)
        assert all(len(q) == 4 for _, q in got) and {k for k, _ in got} == set(range(len(pieces)))
        assert sum(area(q) for _, q in got) == pytest.approx(whole, abs=2)


def test_mesh_covers_the_region_polygons(spark):
    from pixelweft.plans import pipeline
    from pixelweft.sources import fixtures

    px = fixtures.pixels(spark, "/root/testdata/sf0.001")
    polys = pipeline.settle(pipeline.region_polygons(px))
    area = lambda df, keys: {r.k: r.a for r in polygon.measures(df.withColumn("polygon_id", F.concat_ws("/", *keys))).where("n > 2").groupBy(F.expr("concat_ws('/', slice(split(polygon_id, '/'), 1, 2))").alias("k")).agg((F.sum(F.abs("area2")) / 2).alias("a")).collect()}
    whole = area(polys.join(polygon.measures(polys).where("valid").select("polygon_id"), "polygon_id", "left_semi"), ["polygon_id"])
    quads = pipeline.settle(pipeline.mesh_quads(px))
    got = area(quads, ["polygon_id", "ti", "bi"])
    assert {r["count"] for r in quads.groupBy("polygon_id", "ti", "bi").count().collect()} == {4}
    assert set(got) == set(whole) and sum(got.values()) == pytest.approx(sum(whole.values()), rel=0.05)


def test_rare_values_fold_in_order(spark):
    rows = [(0, 1 + i // 10, i % 10, v, v, v, 255) for i, v in enumerate([10] * 50 + [20] + [23] + [30] * 48)]
    p = spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int, a int")
    assert {(r.value, r.target) for r in color.fold_sequential(p, 0.05).collect()} == {(30, 30), (60, 90), (69, 90), (90, 90)}
    assert {(r.value, r.target) for r in color.fold_independent(p, 0.05).collect()} == {(30, 30), (60, 30), (69, 90), (90, 90)}


def test_tiny_regions_merge_into_the_nearest_value(spark):
    g = grid(spark, [[1, 1, 1, 1], [1, 5, 9, 9], [1, 1, 9, 9]])
    out = regions.merge_tiny(regions.label_kernel(g), 1)
    assert {(r.y, r.x): r.value for r in out.collect()}[1, 1] == 1
    assert out.select("region_id").distinct().count() == 2


def test_ring_components_and_issues(spark):
    assert stencil.ring_components(0) == 1 and stencil.ring_components(0b11) == 2 and stencil.ring_components(0b10001) == 4
    line = grid(spark, [[1] * 5, [1, 1, 2, 1, 1], [1, 1, 2, 1, 1], [1, 1, 2, 1, 1], [1] * 5])
    got = {(r.y, r.x): r.reason for r in stencil.geometry_issues(line).where("x = 2 AND y BETWEEN 1 AND 3").collect()}
    assert got == {(1, 2): "tip", (2, 2): "line", (3, 2): "tip"}


def test_empty_tables(spark):
    g = spark.createDataFrame([], "image_id int, y int, x int, value int")
    assert regions.label_kernel(g).count() == 0 and regions.label_relational(g).count() == 0
    assert stencil.geometry_issues(g).count() == 0 and spatial.nearest_pairs(g, ["image_id"], "value").count() == 0


def test_options_and_names(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"region_defuzz_threshold": 3, "unknown": 1}')
    assert Options.load(str(path)).region_defuzz_threshold == 3 and Options.load(str(tmp_path / "none")) == Options()
    assert default_output("a/b.png", "_filled") == "a/b_filled.png"
    assert png(np.zeros((2, 3, 4), np.uint8))[:4] == b"\x89PNG"


def test_image_round_trip(spark, tmp_path):
    from pixelweft.sources.images import read_images

    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (5, 7, 4))
    a[..., 3] = 255
    (tmp_path / "x.png").write_bytes(png(a))
    got = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in read_images(spark, str(tmp_path)).collect()}
    assert got == {(y, x): tuple(int(v) for v in a[y, x]) for y in range(5) for x in range(7)}


def test_stream_counts_match_batch(spark, tmp_path):
    from pixelweft.streaming.arrivals import pixel_stream, running_histogram

    p = spark.createDataFrame([(0, 1, x, x % 3, 0, 0, 255) for x in range(30)], "image_id int, y int, x int, r int, g int, b int, a int")
    p.write.parquet(str(tmp_path / "in"))
    q = running_histogram(pixel_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("hist").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.value, r["count"]) for r in spark.table("hist").collect()} == {(0, 10), (1, 10), (2, 10)}


@pytest.mark.parametrize("n", [5, 6])
def test_walk_start(n):
    assert (0, n // 2) in borders.walk([(0, k) for k in range(n)], set())
