"""Joins of tables that grow with the input: none has the driver gather a side of them."""

import pytest
from pyspark.sql import functions as F

from pixelweft.operators import borders, graphs, holes, mesh, points, polygon, regions, stencil
from pixelweft.plans import fixpoint
from pixelweft.plans.fixpoint import settle
from pixelweft.sources import fixtures

from .test_kernels import grid

IMAGE = [[5, 5, 5, 5, 5, 5], [5, 7, 7, 5, 5, 5], [5, 7, 7, 5, 9, 9], [5, 5, 5, 5, 9, 9], [5, 5, 5, 5, -1, -1]]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raster(spark):
    """Regions, drawn border, segments and walks of one image, as tables that Spark takes for a few bytes."""
    rp = settle(regions.label_kernel(grid(spark, IMAGE)), "regions")
    border = settle(stencil.drawn_border(rp), "border")
    seg = settle(borders.segments(border, stencil.border_adjacency(border, rp)), "segments")
    return rp, border, seg, settle(borders.walks(seg, rp), "walks")


RASTERS = {
    "drawn_border": lambda rp, b, s, w: stencil.drawn_border(rp),
    "outward_border": lambda rp, b, s, w: stencil.outward_border(rp),
    "adjacency": lambda rp, b, s, w: stencil.adjacency(b, borders.PAIR),
    "border_adjacency": lambda rp, b, s, w: stencil.border_adjacency(b, rp),
    "walks": lambda rp, b, s, w: borders.walks(s, rp),
    "traversal_failures": lambda rp, b, s, w: borders.traversal_failures(s, w.where("pos < 1"), 0),
    "failed_images": lambda rp, b, s, w: borders.failed_images(s, w.where("pos < 1"), 0),
    "picture": lambda rp, b, s, w: points.picture(points.sizes_of(rp), b),
    "exterior_links": lambda rp, b, s, w: graphs.exterior_links(points.border_pixels(rp), rp),
    "holed": lambda rp, b, s, w: regions.holed(rp),
    "cut_holes": lambda rp, b, s, w: holes.cut_holes(rp),
    "complement_parts": lambda rp, b, s, w: regions.complement_parts(rp),
}
POLYGONS = {
    "crossing": lambda p: polygon.crossing(polygon.candidate_cuts(p), p),
    "inside_within": lambda p: polygon.inside_within(polygon.candidate_cuts(p), p, 1.5),
    "cut_scores": polygon.cut_scores,
    "cut_order": polygon.cut_order,
    "corner_vertices": polygon.corner_vertices,
}


def shuffled(df):
    """Whether the plan, as made and as run, has joins, and none by broadcast; there are rows."""
    before = df._jdf.queryExecution().executedPlan().toString()
    rows = df.count() if "Join" in before else 0
    again = df.agg(F.count(F.lit(1)))
    again.collect()
    plans = before + again._jdf.queryExecution().executedPlan().toString()
    return rows > 0 and "SortMergeJoin" in plans and "Broadcast" not in plans


@pytest.mark.parametrize("name", RASTERS)
def test_pixels_are_joined_by_shuffle(raster, name):
    assert shuffled(RASTERS[name](*raster))


@pytest.mark.parametrize("name", POLYGONS)
def test_corners_are_joined_by_shuffle(spark, name):
    assert shuffled(POLYGONS[name](settle(fixtures.polygons(spark, SMALL), "polygons")))


def test_mesh_edges_are_joined_by_shuffle(spark):
    assert shuffled(mesh.neighbors(settle(fixtures.quads(spark, SMALL), "quads")))


def test_rounds_of_small_tables_have_few_files_and_no_markers(spark, monkeypatch):
    held, n = [], 3000

    def noted(df, *args, **more):
        out = settle(df, *args, **more)
        where, fs = fixpoint._folder(spark, out.scratch + "/table")
        held.append([f.getPath().getName() for f in fs.listStatus(where)])
        return out

    monkeypatch.setattr(fixpoint, "settle", noted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(n).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 2).alias("b"))
        roots = {r.node: r.root for r in fixpoint.connected_components(edges, files=24).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert roots == {2 * k: 0 for k in range(n + 1)}
    assert len(held) > 2
    assert max(map(len, held)) <= 24
    assert not [f for names in held for f in names if not f.startswith("part-")]
