"""The two end-to-end plans: gradient fill and mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.operators import borders, color, gradient, holes, mesh, polygon, polyline, regions, stencil
from pixelweft.plans.fixpoint import settle
from pixelweft.sources.images import Options


def gradient_fill(pixels: DataFrame, options: Options | None = None) -> DataFrame:
    """Pixels with r, g, b, a after the fill."""
    o = options or Options()
    grid = color.value_grid(pixels, color.fold_sequential(pixels, o.region_proportion_threshold))
    return color.grey(gradient.fill(grid).withColumn("value", F.col("filled") / 3)).drop("filled")


def region_pixels(pixels: DataFrame, options: Options | None = None) -> DataFrame:
    """Pixels with region ids: rare values folded, tiny regions merged, regions with holes cut open."""
    o = options or Options()
    grid = color.value_grid(pixels, color.fold_sequential(pixels, o.region_proportion_threshold))
    merged = settle(regions.merge_tiny(regions.label_kernel(grid), o.region_defuzz_threshold), "merged-regions")
    return holes.cut_holes(merged, o.sideways_cut_penalty)


def region_polygons(pixels: DataFrame, options: Options | None = None) -> DataFrame:
    """(polygon_id, pos, y, x): simplified borders of each region, joined end to end; ends that follow each other are
    drawn together. Raises `TraversalError` if a walk leaves out more pixels than options tolerate."""
    o = options or Options()
    rp = settle(region_pixels(pixels, o), "regions")
    border = settle(stencil.drawn_border(rp), "border")
    seg = settle(borders.segments(border, stencil.border_adjacency(border, rp)), "segments")
    inner = rp.withColumnRenamed("region_id", "rid")
    inner = inner.select("image_id", F.col("rid").alias("region_id"), "y", "x", "value")
    walked = settle(borders.walks(seg, inner), "walks")
    borders.check_traversal(seg, walked, o.border_traversal_failure_tolerance)
    lines = walked.select(F.concat_ws("/", *borders.PAIR, "segment").alias("line_id"), "pos", "y", "x")
    kept = polyline.simplify(lines, o.decimate_deviation_cutoff, strict=True)
    tours = borders.region_loops(walked, o.border_defuzz_threshold)
    side = tours.select("image_id", "region_id", "step", "end", F.explode(F.array(F.concat_ws("/", "image_id", "region_id", "other_id", "segment"), F.concat_ws("/", "image_id", "other_id", "region_id", "segment"))).alias("line_id"))
    side = settle(side.join(lines.select("line_id").distinct(), "line_id", "left_semi"), "tours")
    joined = side.join(borders.cinched(settle(kept, "simplified"), borders.links(side)), "line_id")
    order = F.struct("step", F.when(F.col("end") == 0, -F.col("pos")).otherwise(F.col("pos")).alias("p"), "line_id")
    named = joined.withColumn("polygon_id", F.concat_ws("/", "image_id", "region_id"))
    ranked = named.withColumn("pos", F.row_number().over(Window.partitionBy("polygon_id").orderBy(order)))
    return polygon.first_occurrences(ranked.select("polygon_id", "pos", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")))


def mesh_quads(pixels: DataFrame, options: Options | None = None) -> DataFrame:
    """(polygon_id, ti, bi, pos, y, x): quads of all regions, subdivided; polygon_id names the image, region and part.

    Each image is one mesh: pieces of at most four corners, smoothed; triangles turned into quads; subdivided; smoothed.
    """
    o = options or Options()
    polys = settle(region_polygons(pixels, o), "region-polygons")
    good = polygon.measures(polys).where("valid").select("polygon_id")
    named = settle(polys.join(good, "polygon_id", "left_semi"), "polygons").withColumn("group_id", F.regexp_replace("polygon_id", "/[^/]*$", ""))
    parts = polygon.mesh_partition(named, "group_id", o.edge_subdivide_ratio)
    quads = settle(mesh.quad_mesh(parts, "group_id", o.mesh_smooth_convergence_ratio), "quads")
    named = quads.select(F.concat_ws("/", "polygon_id", "part").alias("polygon_id"), "pos", "y", "x")
    fine = polygon.subdivide(named, o.polygon_subdivisions).withColumn("polygon_id", F.concat_ws("/", "polygon_id", "ti", "bi")).drop("ti", "bi")
    fine = mesh.smooth(fine.withColumn("group_id", F.regexp_replace("polygon_id", "(/[^/]*){4}$", "")), "group_id", o.mesh_smooth_convergence_ratio)
    at = lambda k: F.substring_index(F.substring_index("polygon_id", "/", -k), "/", 1).cast("int")
    return fine.select(F.regexp_replace("polygon_id", "(/[^/]*){2}$", "").alias("polygon_id"), at(2).alias("ti"), at(1).alias("bi"), "pos", "y", "x")


def void_edges(polygons: DataFrame) -> DataFrame:
    return mesh.edges(polygons).where("degree = 1")
