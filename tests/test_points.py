"""Hole cuts, orders of borders, patterns, thinning and mesh edits on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.operators import borders, graphs, holes, mesh, patterns, points, polygon, regions, spatial, thinning
from pixelweft.schema import CROSS, RING
from pixelweft.sources.images import png

from .test_kernels import grid


def rings(height, width, *boxes):
    """A full mask with boxes (y0, x0, y1, x1) taken out."""
    m = np.ones((height, width), bool)
    for y0, x0, y1, x1 in boxes:
        m[y0:y1, x0:x1] = False
    return m


@pytest.mark.parametrize("boxes", [((4, 4, 6, 6),), ((2, 2, 5, 6), (9, 9, 14, 12)), ((3, 3, 4, 4), (3, 8, 4, 9), (10, 5, 12, 14)), ((1, 1, 15, 2), (1, 6, 15, 9))])
def test_cuts_leave_no_hole(boxes):
    m = rings(17, 19, *boxes)
    p = np.argwhere(m)
    label = holes.all_parts(p, 17, 19, 100.0)
    assert len(label) == len(p) and label.min() == 0 and len(np.unique(label)) > 1
    for k in np.unique(label):
        part = np.zeros(m.shape, bool)
        part[tuple(p[label == k].T)] = True
        rest = holes.label_mask(np.pad(~part, 1, constant_values=True), RING)
        assert rest.max() == 0, "what a part leaves hangs together around the image"


def test_regions_without_holes_stay_whole():
    p = np.argwhere(rings(9, 9, (0, 0, 4, 4)))
    assert (holes.all_parts(p, 9, 9, 100.0) == 0).all()
    stripe = np.argwhere(rings(9, 9, (0, 0, 9, 3), (0, 6, 9, 9)))
    assert (holes.all_parts(stripe, 9, 9, 100.0) == 0).all()


def test_cut_table_covers_the_image(spark):
    values = np.full((16, 16), 5)
    values[3:6, 3:6] = 7
    values[9:12, 8:13] = -1
    rp = regions.label_kernel(grid(spark, values.tolist()))
    done = holes.cut_holes(rp)
    assert regions.coverage_faults(grid(spark, values.tolist()), done).count() == 0
    assert {r.value for r in done.collect()} == {5, 7, -1}
    assert done.where("value = 5").select("region_id").distinct().count() > 1
    assert holes.cut_holes(rp.limit(0)).count() == 0


def test_mask_labels_match_components():
    rng = np.random.default_rng(4)
    for steps in (RING, CROSS):
        m = rng.random((20, 23)) < 0.5
        label = holes.label_mask(m, steps)
        for y, x in np.argwhere(m):
            for dy, dx in steps:
                if 0 <= y + dy < 20 and 0 <= x + dx < 23 and m[y + dy, x + dx]:
                    assert label[y, x] == label[y + dy, x + dx]
        seen = []
        for k in range(label.max() + 1):
            part = {tuple(p) for p in np.argwhere(label == k)}
            todo = [min(part)]
            reach = set(todo)
            while todo:
                y, x = todo.pop()
                new = {(y + dy, x + dx) for dy, dx in steps} & part - reach
                reach |= new
                todo += new
            assert reach == part
            seen.append(min(part))
        assert seen == sorted(seen)


def test_weight_goes_through_its_points():
    a, b, f = points.weight_shape(100.0)
    curve = lambda t: a + b * math.exp(f * t)
    assert curve(1) == pytest.approx(1) and curve(0.5) == pytest.approx(5) and curve(0) == pytest.approx(99.5)
    assert points.weight_shape(9.5)[2] == 0.0 and points.weight_shape(5.5)[2] == 0.0


def circle(r):
    return sorted({(round(r * math.sin(k / 200 * math.tau)), round(r * math.cos(k / 200 * math.tau))) for k in range(200)})


def steps(path):
    return [max(abs(a - c), abs(b - d)) for (a, b), (c, d) in zip(path, path[1:], strict=False)]


def test_farthest_order():
    line = [(0, k) for k in range(9)] + [(k, 9) for k in range(9)]
    path, loop = graphs.farthest_order(line[::2] + line[1::2])
    assert not loop and max(steps(path)) <= 2 and len(path) == len(line)
    path, loop = graphs.farthest_order(circle(12))
    assert loop and sorted(path) == circle(12) and max(steps(path)) <= 2
    assert graphs.farthest_order([]) == ([], False) and graphs.farthest_order([(1, 1)]) == ([(1, 1)], False)


def test_chunked_walk_and_shortest_path():
    line = [(k // 3, k) for k in range(60)]
    path = graphs.chunked_walk(line, 8)
    assert sorted(path) == line and max(steps(path)) == 1
    assert sorted(graphs.chunked_walk(circle(10), 8)) == circle(10)
    way = graphs.shortest_path(circle(10), circle(10)[0], circle(10)[-1])
    assert max(steps(way)) == 1 and way[0] == circle(10)[0] and way[-1] == circle(10)[-1] and len(way) <= len(circle(10)) // 2 + 2
    assert graphs.shortest_path([(0, 0), (5, 5)], (0, 0), (5, 5)) == []


def test_orientations_are_the_symmetries_of_the_square():
    own = patterns.orientations()
    assert len({tuple(o) for o in own}) == 8 and all(sorted(o) == list(range(25)) and o[12] == 12 for o in own)
    near = lambda i, j: abs(i // 5 - j // 5) + abs(i % 5 - j % 5) == 1
    assert all(near(o[i], o[j]) for o in own for i in range(25) for j in range(25) if near(i, j))


def test_patterns_from_a_picture(spark, tmp_path):
    sheet = np.zeros((10, 15, 4), np.uint8)
    sheet[..., 3] = 255
    sheet[2, 2, :3] = sheet[1, 2, :3] = 255  # cells of the first pattern
    sheet[0, 5, :3] = 255  # its free cell
    sheet[1, 12, :3] = 255  # its false connection
    sheet[7, 2, :3] = 255
    (tmp_path / "filters.png").write_bytes(png(sheet))
    got = {tuple(r) for r in patterns.read_patterns(spark, str(tmp_path / "filters.png")).collect()}
    assert got == {(0, 1 << 12 | 1 << 7, 1, 1 << 7), (1, 1 << 12, 0, 0)}
    assert patterns.read_patterns(spark, str(tmp_path / "none.png")).count() == 0
    full = patterns.oriented(patterns.read_patterns(spark, str(tmp_path / "filters.png")))
    assert full.where("pattern_id = 0").count() == 4 + 8 and full.where("pattern_id = 1").count() == 1


def test_thinning_by_direction():
    p = np.array([(0, k) for k in range(20)] + [(k, 20) for k in range(20)], float)
    kept = thinning.past_angle(p, 5, math.pi / 6)
    assert kept[0] == 0 and kept[-1] == 39 and 2 < len(kept) < 8 and any(18 <= k <= 34 for k in kept[1:-1])
    assert thinning.past_angle(p[:20], 5, math.pi / 6) == [0, 19]
    kept = thinning.follow(p, 8, math.pi / 6)
    assert kept[0] == 0 and kept[-1] == 39 and len(kept) < 15 and kept == sorted(set(kept))
    for f in (thinning.past_angle, thinning.follow):
        assert f(np.zeros((0, 2)), 5, 0.5) == [] and f(np.zeros((1, 2)), 5, 0.5) == [0] and f(np.zeros((3, 2)), 5, 0.5)[-1] == 2


def test_loops_lose_short_lines():
    loop = [[(0, 0), (0, 10)], [(0, 10), (0, 12)], [(0, 12), (10, 12)], [(10, 12), (0, 0)]]
    assert thinning.without_short(loop, 3.0) == [[(0, 0), (0, 11)], [(0, 11), (10, 12)], [(10, 12), (0, 0)]]
    assert thinning.without_short(loop[1:2], 3.0) == loop[1:2]


def test_cinched_ends_meet(spark):
    lines = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 0.0, 9.0), ("b", 0, 3.0, 10.0), ("b", 1, 9.0, 9.0), ("c", 0, 4.0, 12.0), ("c", 1, 20.0, 20.0)], "line_id string, pos int, y double, x double")
    linked = spark.createDataFrame([("a", 1, "b", 0), ("c", 0, "b", 0)], "line_a string, end_a int, line_b string, end_b int")
    got = {(r.line_id, r.pos): (r.y, r.x) for r in borders.cinched(lines, linked).collect()}
    assert got["a", 1] == got["b", 0] == got["c", 0] == (2.0, 10.0) and got["a", 0] == (0.0, 0.0) and got["c", 1] == (20.0, 20.0)


def test_failed_walks_stop_the_plan(spark):
    seg = spark.createDataFrame([(0, 1, 2, 0, 0, k) for k in range(10)], "image_id int, region_id int, other_id int, segment int, y int, x int")
    walk = seg.where("x < 3").withColumn("pos", F.col("x"))
    with pytest.raises(borders.TraversalError, match="image 0, regions 1 and 2"):
        borders.check_traversal(seg, walk, 5)
    borders.check_traversal(seg, walk, 7)
    assert [tuple(r) for r in borders.failed_images(seg, walk, 5).collect()] == [(0, True)]


def test_halved_edges_reach_the_neighbour():
    halved = {frozenset(((0, 0), (0, 8))): (0, 4), frozenset(((0, 0), (0, 4))): (0, 2)}
    assert polygon.with_middles([(0, 8), (0, 0), (9, 4)], halved) == [(0, 8), (0, 4), (0, 2), (0, 0), (9, 4)]
    assert polygon.with_middles([(1, 1), (2, 2), (3, 1)], halved) == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("n", range(5, 13))
def test_peeled_quads_cover_a_convex_ring(n):
    ring = [(round(1000 * math.sin(k / n * math.tau)), round(1000 * math.cos(k / n * math.tau))) for k in range(n)]
    area = lambda p: abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, [*p[1:], p[0]], strict=True)))
    for points_ in (ring, ring[::-1], [*ring, ((ring[-1][0] + ring[0][0]) // 2, (ring[-1][1] + ring[0][1]) // 2)]):
        parts = polygon.peel_quads(points_)
        assert all(3 <= len(p) <= 4 for p in parts) and abs(sum(map(area, parts)) - area(points_)) <= area(points_) * 1e-9


def test_mesh_partition_meets_edge_to_edge(spark):
    """An edge that is halved on one side is halved on the other side too: the rim is the only place with one owner."""
    comb = [(0, 0), (0, 40), (30, 40), (2, 20), (30, 0)]
    flat = [(0, 40), (0, 0), (-9, 0), (-9, 40)]
    rows = [("m", name, k, y, x) for name, p in (("a", comb), ("b", flat)) for k, (y, x) in enumerate(p)]
    parts = polygon.mesh_partition(spark.createDataFrame(rows, "group_id string, polygon_id string, pos int, y int, x int"), "group_id", 1.1)
    named = parts.select(F.concat_ws("/", "polygon_id", "part").alias("polygon_id"), "pos", "y", "x")
    assert parts.groupBy("polygon_id", "part").count().agg(F.max("count")).first()[0] <= 4
    e = mesh.edges(named).collect()
    v = {r.vertex_id: (r.y, r.x) for r in mesh.vertices(named).collect()}
    for r in e:
        (ay, ax), (by, bx) = v[r.v_lo], v[r.v_hi]
        if ay == by == 0:
            assert r.degree == 2, "the border between both polygons"


def test_nearest_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    p = sorted({(int(k), int(y), int(x)) for k, y, x in zip(rng.integers(0, 4, 300), rng.integers(0, 200, 300), rng.integers(0, 200, 300), strict=True)})
    got = {(r.a, r.b): (r.d2, r.ay, r.ax, r.by, r.bx) for r in spatial.nearest_pairs(spark.createDataFrame([(0, *r) for r in p], "image_id int, k int, y int, x int"), ["image_id"], "k").collect()}
    want = {(a, b): min(((y - v) ** 2 + (x - w) ** 2, y, x, v, w) for k, y, x in p if k == a for m, v, w in p if m == b) for a in range(4) for b in range(a + 1, 4)}
    assert got == want


def test_direction_choices(spark):
    rays = spark.createDataFrame([(0, 0, 0, 0, 4)], "image_id int, y0 int, x0 int, y1 int, x1 int")
    targets = spark.createDataFrame([(0, 0, 12), (0, 5, 4), (0, 3, 5), (0, 0, 1)], "image_id int, y int, x int")
    got = points.forward_nearest(rays, targets, ["image_id"], 100.0).collect()
    assert [(r.y, r.x) for r in got] == [(0, 12)]
    assert points.forward_nearest(rays, targets.where("x = 1"), ["image_id"], 100.0).count() == 0
