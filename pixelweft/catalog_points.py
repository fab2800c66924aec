"""Registered queries over point tables, pixel graphs, patterns, hole cuts and mesh edits, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.catalog import AROUND, CUTS, DRAWN, GRID, LINES, MESH, OFF4, OFF8, PIXELS, POLYGONS, POLYLINES, QUADS, RASTER, REGIONS, _s, drawn, grid, labelled, register, walked
from pixelweft.operators import borders, graphs, holes, mesh, patterns, points, polygon, regions, stencil, thinning
from pixelweft.plans import pipeline
from pixelweft.plans.fixpoint import settle
from pixelweft.schema import dealt
from pixelweft.sources import fixtures

IMAGE = ["image_id"]
WITH = "WITH RECURSIVE " + GRID.lstrip()


def ring(s: SparkSession, d: str) -> DataFrame:
    """The pixels of the outer disc."""
    return grid(s, d).where("value = 600").select("image_id", "y", "x")


def rows(s: SparkSession, names: str, *values: tuple) -> DataFrame:
    return s.createDataFrame(list(values), names)


# --- grids and pictures ------------------------------------------------------------------------------------------------

register("full_grid", lambda s, d: points.full_grid(points.sizes_of(fixtures.pixels(s, d))), f"WITH {PIXELS}, z AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM pixels GROUP BY 1) SELECT image_id, CAST(y AS INT) AS y, CAST(unnest(range(w)) AS INT) AS x FROM (SELECT image_id, w, unnest(range(h)) AS y FROM z)")
register("scatter_default", lambda s, d: points.scatter(points.sizes_of(grid(s, d)), grid(s, d).where("value = 600"), "value"), f"WITH {GRID} SELECT image_id, y, x, CASE WHEN value = 600 THEN value ELSE -1 END AS value FROM grid")
PAINT = "CASE WHEN m.y IS NULL THEN 0 ELSE 255 END AS r, CASE WHEN m.y IS NULL THEN 0 ELSE 255 END AS g, CASE WHEN m.y IS NULL THEN 0 ELSE 255 END AS b, 255 AS a"
register("border_picture", lambda s, d: points.picture(points.sizes_of(grid(s, d)), drawn(s, d)[0]), REGIONS + DRAWN + f", m AS (SELECT DISTINCT image_id, y, x FROM drawn) SELECT g.image_id, g.y, g.x, {PAINT} FROM grid g LEFT JOIN m USING (image_id, y, x)")
register("traversal_failure_picture", lambda s, d: points.picture(points.sizes_of(grid(s, d)), borders.traversal_failures(*walked(s, d))))


def _masks(s: SparkSession, d: str) -> DataFrame:
    outline = polygon.outlines(fixtures.polygons(s, d)).select((F.col("polygon_id") % 16).cast("int").alias("image_id"), "y", "x")
    return points.picture(points.sizes_of(outline), outline)


register("polygon_mask", _masks, f"""WITH {POLYGONS}{AROUND}{LINES}, m AS (SELECT DISTINCT CAST(polygon_id % 16 AS INT) AS image_id, {RASTER.format(a='y')}, {RASTER.format(a='x')} FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM e)),
z AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM m GROUP BY 1), g AS (SELECT image_id, CAST(y AS INT) AS y, CAST(unnest(range(w)) AS INT) AS x FROM (SELECT image_id, w, unnest(range(h)) AS y FROM z))
SELECT g.image_id, g.y, g.x, {PAINT} FROM g LEFT JOIN m USING (image_id, y, x)""")

# --- filters and choices -----------------------------------------------------------------------------------------------

register("border_pixels", lambda s, d: points.border_pixels(labelled(s, d)), REGIONS + f" SELECT DISTINCT p.image_id, p.region_id, p.y, p.x FROM rp p CROSS JOIN {OFF4} LEFT JOIN rp q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE coalesce(q.region_id, -1) <> p.region_id")
register("cell_edge_mask", lambda s, d: points.cell_edges(grid(s, d), 8), f"WITH {GRID} SELECT * FROM grid WHERE y % 8 IN (0, 7) OR x % 8 IN (0, 7)")
register("cell_crossings", lambda s, d: points.cell_crossings(ring(s, d), IMAGE, 8), f"WITH {GRID}, p AS (SELECT * FROM grid WHERE value = 600) SELECT DISTINCT p.image_id, p.y, p.x FROM p CROSS JOIN {OFF8} JOIN p q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.y // 8 <> q.y // 8 OR p.x // 8 <> q.x // 8")


def _turned(s: SparkSession, d: str) -> DataFrame:
    lines = fixtures.polylines(s, d)
    ends = lines.groupBy("line_id").agg(F.min_by(F.struct("y", "x"), "pos").alias("a"), F.max_by(F.struct("y", "x"), "pos").alias("b"))
    way = ends.select("line_id", "a", (F.col("b.y") - F.col("a.y")).alias("wy"), (F.col("b.x") - F.col("a.x")).alias("wx"))
    far = F.sqrt(F.col("wy") * F.col("wy") + F.col("wx") * F.col("wx"))
    way = way.where(far > 0).select("line_id", "a", (F.col("wy") / far).alias("uy"), (F.col("wx") / far).alias("ux"))
    from_start = lines.join(way.select("line_id", "a"), "line_id").select("line_id", "pos", (F.col("y") - F.col("a.y")).alias("dy"), (F.col("x") - F.col("a.x")).alias("dx"))
    return points.beyond_angle(from_start, ["line_id"], way.select("line_id", "uy", "ux"), math.pi / 6).select("line_id", "pos")


register("angle_outliers", _turned, f"""WITH {POLYLINES}, e AS (SELECT line_id, arg_min(y, pos) AS ay, arg_min(x, pos) AS ax, arg_max(y, pos) - arg_min(y, pos) AS wy, arg_max(x, pos) - arg_min(x, pos) AS wx FROM lines GROUP BY 1),
u AS (SELECT line_id, pos, y - ay AS dy, x - ax AS dx, wy / sqrt(wy*wy+wx*wx) AS uy, wx / sqrt(wy*wy+wx*wx) AS ux FROM lines JOIN e USING (line_id) WHERE wy*wy+wx*wx > 0)
SELECT line_id, pos FROM u WHERE dy*dy+dx*dx > 0 AND round((dy*uy + dx*ux) / sqrt(dy*dy+dx*dx), 9) < round(cos(pi() / 6), 9)""")
register("unsearched_points", lambda s, d: points.unsearched(ring(s, d), grid(s, d).where("y > 15"), IMAGE), f"WITH {GRID} SELECT image_id, y, x FROM grid WHERE value = 600 AND y <= 15")
register("direction_weights", lambda s, d: s.range(101).select("id", F.round(points.direction_weight(1 - F.col("id") / 50, 100.0), 9).alias("weight")), "WITH k AS (SELECT 99.5::DOUBLE AS e, 5.0::DOUBLE AS d), c AS (SELECT e, pow((1 - d) / (d - e), 2) AS c FROM k), b AS (SELECT e, c, (e - 1) / (1 - c) AS b FROM c) SELECT id, round((1 - (1 - id / 50.0::DOUBLE)) / 2 + (e - b) + b * exp((1 - id / 50.0::DOUBLE) * ln(c)), 9) AS weight FROM range(101) r(id), b")


def _forward(s: SparkSession, d: str) -> DataFrame:
    ray = grid(s, d).select("image_id").distinct().select("image_id", F.lit(4).alias("y0"), F.lit(2).alias("x0"), (5 + F.col("image_id") % 3).alias("y1"), F.lit(6).alias("x1"))
    return points.forward_nearest(ray, ring(s, d), IMAGE, 100.0)


register("forward_nearest", _forward, f"""WITH {GRID}, r AS (SELECT DISTINCT image_id, 4 AS y0, 2 AS x0, CAST(5 + image_id % 3 AS INT) AS y1, 6 AS x1 FROM grid),
t AS (SELECT r.*, y, x, (y1-y0)*(y-y1)+(x1-x0)*(x-x1) AS dot, sqrt((y-y1)*(y-y1)+(x-x1)*(x-x1)) AS far, sqrt((y1-y0)*(y1-y0)+(x1-x0)*(x1-x0)) AS ray FROM r JOIN grid USING (image_id) WHERE value = 600),
m AS (SELECT image_id, y0, x0, y1, x1, min((round(far * exp(-dot / (far * ray) * ln(100.0::DOUBLE)), 9), y, x)) AS m FROM t WHERE dot > 0 GROUP BY 1, 2, 3, 4, 5) SELECT image_id, y0, x0, y1, x1, m[2] AS y, m[3] AS x, m[1] AS cost FROM m""")

# --- lookups, ranks, lists ---------------------------------------------------------------------------------------------

register("sublist_of_point", lambda s, d: points.sublist_of(fixtures.quads(s, d).groupBy(F.col("polygon_id").alias("list_id")).agg(F.collect_list(F.struct("y", "x")).alias("points"))), f"WITH {QUADS} SELECT y, x, min(polygon_id) AS list_id FROM polygons GROUP BY 1, 2")
register("vertex_lookup_unknown", lambda s, d: mesh.polygon_vertices(fixtures.polygons(s, d), mesh.vertices(fixtures.quads(s, d))), f"WITH {QUADS}{MESH}, {POLYGONS.replace('polygons AS', 'stars AS')} SELECT polygon_id, pos, coalesce(vertex_id, -1) AS vertex_id FROM stars LEFT JOIN vertices USING (y, x)")


def _induced(s: SparkSession, d: str) -> DataFrame:
    v = mesh.vertices(fixtures.quads(s, d))
    kept = points.rank_of(v.where("vertex_id % 3 <> 0").withColumn("g", F.floor(F.col("vertex_id") / 300)), ["g"], ["vertex_id"]).select(F.col("vertex_id").alias("node"), "rank")
    return points.induced_subgraph(mesh.edges(fixtures.quads(s, d)).select(F.col("v_lo").alias("a"), F.col("v_hi").alias("b")), kept)


register("induced_subgraph", _induced, f"WITH {QUADS}{MESH}, kept AS (SELECT vertex_id, CAST(row_number() OVER (PARTITION BY vertex_id // 300 ORDER BY vertex_id) - 1 AS INT) AS rank FROM vertices WHERE vertex_id % 3 <> 0) SELECT p.rank AS a, q.rank AS b FROM edges JOIN kept p ON p.vertex_id = v_lo JOIN kept q ON q.vertex_id = v_hi")
register("junctions", lambda s, d: points.junctions(labelled(s, d)), REGIONS + f" SELECT image_id, y, x, count(DISTINCT o) AS others FROM (SELECT p.image_id, p.y, p.x, p.region_id, coalesce(q.region_id, -1) AS o FROM rp p CROSS JOIN {OFF8} LEFT JOIN rp q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx) WHERE o <> region_id GROUP BY 1, 2, 3 HAVING count(DISTINCT o) > 1")
register("value_rank", lambda s, d: points.rank_of(fixtures.polylines(s, d), ["line_id"], ["y", "pos"]).select("line_id", "pos", "rank"), f"WITH {POLYLINES} SELECT line_id, pos, CAST(row_number() OVER (PARTITION BY line_id ORDER BY y, pos) - 1 AS INT) AS rank FROM lines")
register("least_per_distance", lambda s, d: points.least_per(fixtures.polylines(s, d).withColumn("k", F.floor(F.col("pos") / 5).cast("int")), ["line_id", "k"], "y", ["pos"]).select("line_id", "k", "pos"), f"WITH {POLYLINES} SELECT line_id, CAST(pos // 5 AS INT) AS k, arg_min(pos, (y, pos)) AS pos FROM lines GROUP BY line_id, pos // 5")
register("valid_first", lambda s, d: points.valid_first(fixtures.polylines(s, d), ["line_id"], F.col("y") > 50, 5).select("line_id", "pos", "valid", "place"), f"WITH {POLYLINES}, r AS (SELECT line_id, pos, y > 50 AS valid, CAST(row_number() OVER (PARTITION BY line_id ORDER BY y > 50 DESC, pos) - 1 AS INT) AS place FROM lines) SELECT * FROM r WHERE place < 5")
register("list_insert", lambda s, d: points.insert_after(fixtures.polygons(s, d), "polygon_id", fixtures.polygons(s, d).where("pos = 3").select("polygon_id", "pos", F.lit(32).alias("y"), F.lit(32).alias("x"))), f"WITH {POLYGONS} SELECT polygon_id, CASE WHEN pos > 3 THEN pos + 1 ELSE pos END AS pos, y, x FROM polygons UNION ALL SELECT DISTINCT polygon_id, 4, 32, 32 FROM polygons")
register("list_delete", lambda s, d: points.delete_at(fixtures.polygons(s, d), "polygon_id", fixtures.polygons(s, d).where("pos IN (0, 4)")), f"WITH {POLYGONS} SELECT polygon_id, CAST(CASE WHEN pos > 4 THEN pos - 2 ELSE pos - 1 END AS INT) AS pos, y, x FROM polygons WHERE pos NOT IN (0, 4)")
register("sorted_insert", lambda s, d: points.sorted_insert(fixtures.quads(s, d), fixtures.polygons(s, d)), f"WITH {QUADS}, {POLYGONS.replace('polygons AS', 'stars AS')} SELECT CAST(row_number() OVER (ORDER BY y, x) - 1 AS INT) AS rank, y, x FROM (SELECT y, x FROM polygons UNION SELECT y, x FROM stars)")
register("list_edits", lambda s, d: points.list_edits(fixtures.polygons(s, d), "polygon_id"), f"""WITH {POLYGONS}, t AS (SELECT *, y || ',' || x AS t FROM polygons),
m AS (SELECT polygon_id, trunc((max(CASE WHEN pos = 0 THEN y END) + max(CASE WHEN pos = 1 THEN y END)) / 2.0)::INT || ',' || trunc((max(CASE WHEN pos = 0 THEN x END) + max(CASE WHEN pos = 1 THEN x END)) / 2.0)::INT AS mid FROM polygons GROUP BY 1)
SELECT polygon_id, string_agg(t, ' ' ORDER BY (pos + 1) % 8) AS rolled, string_agg(t, ' ' ORDER BY pos) FILTER (WHERE pos BETWEEN 1 AND 3) AS sliced, string_agg(t, ' ' ORDER BY pos DESC) AS flipped,
  max(CASE WHEN pos = 0 THEN t END) || ' ' || any_value(mid) || ' ' || string_agg(t, ' ' ORDER BY pos) FILTER (WHERE pos > 0) AS inserted FROM t JOIN m USING (polygon_id) GROUP BY polygon_id""")
register("integer_sum", lambda s, d: grid(s, d).groupBy("image_id").agg(F.sum("value").alias("total")), f"WITH {GRID} SELECT image_id, sum(value) AS total FROM grid GROUP BY 1")
register("vertex_count", lambda s, d: mesh.vertices(fixtures.quads(s, d)).agg(F.count(F.lit(1)).alias("n")), f"WITH {QUADS} SELECT count(DISTINCT (y, x)) AS n FROM polygons")

# --- pixel graphs ------------------------------------------------------------------------------------------------------

PADJ = f", p AS (SELECT image_id, y, x FROM grid WHERE value = 600), e AS (SELECT p.image_id, p.y, p.x, q.y AS ny, q.x AS nx FROM p CROSS JOIN {OFF8} JOIN p q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx)"


def ring_edges(s: SparkSession, d: str) -> DataFrame:
    return stencil.adjacency(ring(s, d), IMAGE)


def _distances(s: SparkSession, d: str) -> DataFrame:
    start = ring(s, d).groupBy("image_id").agg(F.min(F.struct("y", "x")).alias("p")).select("image_id", "p.y", "p.x")
    return graphs.distances(settle(ring_edges(s, d), "edges"), start, IMAGE)


register("tiled_adjacency", lambda s, d: stencil.tiled_adjacency(ring(s, d), IMAGE), f"WITH {GRID}{PADJ} SELECT * FROM e")
register("branch_points", lambda s, d: graphs.branches(ring_edges(s, d), IMAGE), f"WITH {GRID}{PADJ} SELECT image_id, y, x, count(*) AS degree FROM e GROUP BY 1, 2, 3 HAVING count(*) > 2")
DIST = WITH + PADJ + """, w(image_id, y, x, k) AS (SELECT image_id, m[1], m[2], 0 FROM (SELECT image_id, min([y, x]) AS m FROM p GROUP BY 1)
  UNION SELECT w.image_id, ny, nx, k + 1 FROM w JOIN e USING (image_id, y, x) WHERE k < 64), far AS (SELECT image_id, y, x, CAST(min(k) AS INT) AS distance FROM w GROUP BY 1, 2, 3)"""
register("graph_distance", _distances, DIST + " SELECT * FROM far")
register("graph_order", lambda s, d: graphs.graph_order(_distances(s, d), IMAGE), DIST + " SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY distance, y, x) - 1 AS INT) AS pos, y, x FROM far")
register("exterior_links", lambda s, d: graphs.exterior_links(points.border_pixels(settle(labelled(s, d), "regions")), labelled(s, d)), REGIONS + f""",
bp AS (SELECT DISTINCT p.image_id, p.region_id, p.y, p.x FROM rp p CROSS JOIN {OFF4} LEFT JOIN rp q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE coalesce(q.region_id, -1) <> p.region_id),
ck AS (SELECT b.image_id, b.region_id, b.y, b.x, i, CASE WHEN c.y IS NOT NULL THEN 2 WHEN q.y IS NOT NULL THEN 1 ELSE 0 END AS k FROM bp b CROSS JOIN {OFF8}
  LEFT JOIN bp c ON c.image_id = b.image_id AND c.region_id = b.region_id AND c.y = b.y + dy AND c.x = b.x + dx LEFT JOIN rp q ON q.image_id = b.image_id AND q.region_id = b.region_id AND q.y = b.y + dy AND q.x = b.x + dx),
nx AS (SELECT a.image_id, a.region_id, a.y, a.x, a.i, min(((b.i - a.i + 8) % 8) * 4 + b.k) AS m FROM ck a JOIN ck b USING (image_id, region_id, y, x) WHERE a.k = 2 AND b.k > 0 AND b.i <> a.i GROUP BY 1, 2, 3, 4, 5)
SELECT image_id, region_id, y, x, i, CAST((i + m // 4) % 8 AS INT) AS j FROM nx WHERE m % 4 = 2 AND m // 4 > 1""")
register("farthest_order", lambda s, d: graphs.farthest_orders(walked(s, d)[0], [*borders.PAIR, "segment"]))
register("chunked_walk", lambda s, d: graphs.chunked_walks(walked(s, d)[0], [*borders.PAIR, "segment"]))
register("quadtree_regions", lambda s, d: regions.label_quadtree(grid(s, d)), REGIONS + " SELECT * FROM rp")
register("seeded_regions", lambda s, d: regions.label_seeded(grid(s, d)), REGIONS + " SELECT * FROM rp")

# --- patterns ----------------------------------------------------------------------------------------------------------

#: (pattern_id, cells, free, false_cells): a corner of a thick line, with two free cells; a full block.
PATTERNS = ((0, 0b00000_00111_00111_00111_00000 | 1 << 12, 0b00000_00000_00000_11000_00000, 1 << 6 | 1 << 18), (1, (1 << 25) - 1, 0, 1 << 11 | 1 << 13))


def given(s: SparkSession) -> DataFrame:
    return rows(s, "pattern_id int, cells int, free int, false_cells int", *PATTERNS)


SYMMETRIES = [(o, i, j) for o, to in enumerate(patterns.orientations()) for i, j in enumerate(to)]
TABLE = f"""pat(pattern_id, cells, free, false_cells) AS (VALUES {", ".join(map(str, PATTERNS))}), sym(o, i, j) AS (VALUES {", ".join(map(str, SYMMETRIES))}),
bits AS (SELECT pattern_id, i, row_number() OVER (PARTITION BY pattern_id ORDER BY i) - 1 AS k FROM pat, range(25) r(i) WHERE (free >> i) & 1 = 1),
pick AS (SELECT p.pattern_id, p.false_cells, p.cells, n, coalesce((SELECT sum(CASE WHEN (n >> k) & 1 = 1 THEN 1 << i ELSE 0 END) FROM bits b WHERE b.pattern_id = p.pattern_id), 0) AS extra FROM pat p, range(64) r(n) WHERE n < (1 << bit_count(free))),
full_ AS (SELECT pattern_id, n, cells | extra::INT AS code, false_cells FROM pick),
ori AS (SELECT DISTINCT pattern_id, code, false_cells FROM (SELECT pattern_id, n, o, CAST(sum(CASE WHEN (code >> i) & 1 = 1 THEN 1 << j ELSE 0 END) AS INT) AS code, CAST(sum(CASE WHEN (false_cells >> i) & 1 = 1 THEN 1 << j ELSE 0 END) AS INT) AS false_cells FROM full_, sym GROUP BY 1, 2, 3))"""
register("pattern_orientations", lambda s, d: patterns.oriented(given(s)), f"WITH {TABLE} SELECT * FROM ori")
MATCH = WITH + PADJ + f""", {TABLE}, f5 AS (SELECT row_number() OVER (ORDER BY dy, dx) - 1 AS c, dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx)),
sur AS (SELECT p.image_id, p.y, p.x, CAST(sum(1 << c) AS INT) AS code FROM p CROSS JOIN f5 JOIN p q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3),
br AS (SELECT image_id, y, x FROM e GROUP BY 1, 2, 3 HAVING count(*) > 2),
fe AS (SELECT image_id, y, x, y + dy AS ny, x + dx AS nx FROM sur JOIN br USING (image_id, y, x) JOIN ori USING (code) JOIN f5 ON (false_cells >> c) & 1 = 1),
te AS (SELECT * FROM e EXCEPT (SELECT * FROM fe UNION SELECT image_id, ny, nx, y, x FROM fe)),
un AS (SELECT DISTINCT code FROM sur JOIN (SELECT image_id, y, x FROM te GROUP BY 1, 2, 3 HAVING count(*) > 2) USING (image_id, y, x))"""
register("pattern_true_edges", lambda s, d: patterns.true_edges(ring(s, d), ring_edges(s, d), given(s), IMAGE), MATCH + " SELECT * FROM te")
register("pattern_unmatched", lambda s, d: patterns.unmatched(ring(s, d), patterns.true_edges(ring(s, d), ring_edges(s, d), given(s), IMAGE), IMAGE), MATCH + " SELECT * FROM un")
register("pattern_sample_sheet", lambda s, d: patterns.sample_sheet(patterns.unmatched(ring(s, d), patterns.true_edges(ring(s, d), ring_edges(s, d), given(s), IMAGE), IMAGE)), MATCH + ", ro AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS k FROM un) SELECT 0 AS image_id, CAST(k * 5 + c // 5 AS INT) AS y, CAST(c % 5 AS INT) AS x, CAST(255 * ((code >> c) & 1) AS INT) AS r, CAST(255 * ((code >> c) & 1) AS INT) AS g, CAST(255 * ((code >> c) & 1) AS INT) AS b, 255 AS a FROM ro, range(25) q(c)")

# --- holes -------------------------------------------------------------------------------------------------------------


def cut(s: SparkSession, d: str) -> DataFrame:
    return holes.cut_holes(settle(labelled(s, d), "regions"))


register("hole_cuts", cut)
register("hole_cut_values", lambda s, d: cut(s, d).groupBy("image_id", "value").agg(F.count(F.lit(1)).alias("n")), f"WITH {GRID} SELECT image_id, value, count(*) AS n FROM grid GROUP BY 1, 2")


def _holes_left(s: SparkSession, d: str) -> DataFrame:
    done = settle(cut(s, d), "cut-regions")
    solid = done.where("value <> -1").select("image_id", "region_id").distinct()
    inner = regions.complement_parts(done).where("NOT exterior").join(dealt(solid), ["image_id", "region_id"]).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return done.select("image_id").distinct().join(dealt(inner), "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).cast("int").alias("n"))


register("holes_left", _holes_left, f"WITH {GRID} SELECT DISTINCT image_id, 0 AS n FROM grid")
RGRAPH = REGIONS + f""", rg AS MATERIALIZED (SELECT DISTINCT p.image_id, p.region_id AS a, q.region_id AS b FROM rp p CROSS JOIN {OFF8} JOIN rp q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.region_id <> q.region_id),
rn AS MATERIALIZED (SELECT image_id, region_id, count(*) AS n, bool_or(y IN (0, 31) OR x IN (0, 31)) AS exterior FROM rp GROUP BY 1, 2),
go(image_id, r, s, k) AS (SELECT o.image_id, r.region_id, o.region_id, o.region_id FROM rn o JOIN rn r ON r.image_id = o.image_id AND r.region_id <> o.region_id
  UNION SELECT go.image_id, r, s, rg.b FROM go JOIN rg ON rg.image_id = go.image_id AND rg.a = k WHERE rg.b <> r),
pt AS (SELECT image_id, r, k, min(s) AS head FROM go GROUP BY 1, 2, 3)"""
register("complement_parts", lambda s, d: regions.complement_parts(settle(labelled(s, d), "regions")), RGRAPH + " SELECT pt.image_id, r AS region_id, CAST(sum(n) AS BIGINT) AS n, bool_or(exterior) AS exterior FROM pt JOIN rn ON rn.image_id = pt.image_id AND rn.region_id = k GROUP BY pt.image_id, r, head")
register("region_graph", lambda s, d: regions.region_graph(labelled(s, d)), RGRAPH + " SELECT * FROM rg")

# --- lines and loops ---------------------------------------------------------------------------------------------------

register("angle_thinning", lambda s, d: thinning.thin(fixtures.polylines(s, d)))
register("window_thinning", lambda s, d: thinning.thin(fixtures.polylines(s, d), "window", 8))
register("loop_defuzz", lambda s, d: thinning.loops_without_short(_edge_lines(s, d), 9.0))


def _edge_lines(s: SparkSession, d: str) -> DataFrame:
    e = polygon.edges(fixtures.polygons(s, d))
    return e.select(F.col("polygon_id").alias("loop_id"), F.col("pos").alias("step"), F.posexplode(F.array(F.struct(F.col("y0").alias("y"), F.col("x0").alias("x")), F.struct(F.col("y1").alias("y"), F.col("x1").alias("x")))).alias("pos", "p")).select("loop_id", "step", "pos", "p.y", "p.x")


ENDS = f"WITH {POLYLINES}, t AS (SELECT line_id, arg_min(y, pos) AS y0, arg_min(x, pos) AS x0, arg_max(y, pos) AS y1, arg_max(x, pos) AS x1 FROM lines GROUP BY 1), ends AS (SELECT line_id, 0 AS e, y0 AS y, x0 AS x FROM t UNION ALL SELECT line_id, 1, y1, x1 FROM t)"
register("endpoint_distances", lambda s, d: borders.end_distances(fixtures.polylines(s, d).withColumn("region", F.floor(F.col("line_id") / 8).cast("int")), ["region"]).withColumn("d2", F.round("d2", 6)), ENDS + " SELECT CAST(a.line_id // 8 AS INT) AS region, a.line_id AS a, a.e AS end_a, b.line_id AS b, b.e AS end_b, round((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x), 6) AS d2 FROM ends a JOIN ends b ON a.line_id // 8 = b.line_id // 8 AND a.line_id < b.line_id")


def _cinched(s: SparkSession, d: str) -> DataFrame:
    lines = fixtures.polylines(s, d).withColumn("line_id", F.col("line_id").cast("string"))
    own = lines.select("line_id").distinct().withColumn("k", F.col("line_id").cast("long"))
    linked = own.where("k % 2 = 0").join(own.select(F.col("line_id").alias("line_b"), (F.col("k") - 1).alias("k")), "k").select(F.col("line_id").alias("line_a"), F.lit(1).alias("end_a"), "line_b", F.lit(0).alias("end_b"))
    return borders.cinched(lines, linked).select(F.col("line_id").cast("long").alias("line_id"), "pos", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"))


register("cinched_lines", _cinched, f"""WITH {POLYLINES}, t AS (SELECT line_id, min(pos) AS p0, max(pos) AS p1 FROM lines GROUP BY 1),
l AS (SELECT lines.*, CASE WHEN line_id % 2 = 0 AND pos = p1 AND p1 > p0 THEN line_id WHEN line_id % 2 = 1 AND pos = p0 THEN line_id - 1 END AS k FROM lines JOIN t USING (line_id)),
c AS (SELECT k, trunc(avg(y)) AS cy, trunc(avg(x)) AS cx FROM l WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) = 2)
SELECT line_id, pos, round(coalesce(cy, y), 6) AS y, round(coalesce(cx, x), 6) AS x FROM l LEFT JOIN c USING (k)""")
register("traversal_failed", lambda s, d: borders.failed_images(*walked(s, d)))

# --- polygons and meshes -----------------------------------------------------------------------------------------------

SCORES = CUTS + """,
u AS (SELECT polygon_id, pos, (ay / sqrt(ay*ay+ax*ax) - by_ / sqrt(by_*by_+bx*bx)) / 2 AS sy, (ax / sqrt(ay*ay+ax*ax) - bx / sqrt(by_*by_+bx*bx)) / 2 AS sx, round((ay * bx - ax * by_) / (sqrt(ay*ay+ax*ax) * sqrt(by_*by_+bx*bx)), 6) AS z
  FROM (SELECT *, (y - py) AS ay, (x - px) AS ax, (ny - y) AS by_, (nx - x) AS bx FROM an)),
two AS (SELECT * FROM cuts UNION ALL SELECT polygon_id, b, a, y1, x1, y0, x0 FROM cuts),
sc AS (SELECT two.polygon_id, a, b, z, round(sqrt((y1-y0)*(y1-y0)+(x1-x0)*(x1-x0)) * (1 - (sy / sqrt(sy*sy+sx*sx) * (y1-y0) + sx / sqrt(sy*sy+sx*sx) * (x1-x0)) / sqrt((y1-y0)*(y1-y0)+(x1-x0)*(x1-x0))), 6) AS score FROM two JOIN u ON u.polygon_id = two.polygon_id AND u.pos = a WHERE sqrt(sy*sy+sx*sx) > 1e-9),
rk AS (SELECT *, row_number() OVER (PARTITION BY polygon_id, a ORDER BY score, b) AS rank FROM sc)"""
register("cut_scores", lambda s, d: polygon.cut_scores(fixtures.polygons(s, d)), f"WITH {POLYGONS}{SCORES} SELECT polygon_id, a, b, score, CAST(rank AS INT) AS rank FROM rk")
register("cut_order", lambda s, d: polygon.cut_order(fixtures.polygons(s, d)), f"WITH {POLYGONS}{SCORES}, ne AS (SELECT polygon_id, a, b, ((b - a + 8) % 8 + 1) % 2 = 0 AS even, CAST(row_number() OVER (PARTITION BY polygon_id ORDER BY z, a, rank) - 1 AS INT) AS nested FROM rk) SELECT *, CAST(row_number() OVER (PARTITION BY polygon_id ORDER BY even DESC, nested) - 1 AS INT) AS place FROM ne")
register("cut_halves", lambda s, d: polygon.cut_all(fixtures.polygons(s, d), fixtures.polygons(s, d).select("polygon_id").distinct().select("polygon_id", F.lit(1).alias("a"), F.lit(6).alias("b"))), f"WITH {POLYGONS} SELECT polygon_id, 0 AS half, CAST(pos - 1 AS INT) AS pos, y, x FROM polygons WHERE pos BETWEEN 1 AND 6 UNION ALL SELECT polygon_id, 1, CAST((pos + 2) % 8 AS INT), y, x FROM polygons WHERE pos >= 6 OR pos <= 1")


def _paired(s: SparkSession, d: str) -> DataFrame:
    e = polygon.edges(fixtures.quads(s, d))
    a = e.select("polygon_id", "pos", *[F.col(f"{k}{i}").alias(f"a{k}{i}") for k in "yx" for i in "01"])
    b = e.select((F.col("polygon_id") - 1).alias("polygon_id"), ((F.col("pos") + 1) % 4).alias("pos"), *[F.col(f"{k}{i}").alias(f"b{k}{i}") for k in "yx" for i in "01"])
    return polygon.paired_crossing(a.join(b, ["polygon_id", "pos"])).select("polygon_id", "pos", "hit")


_TURN = "sign(({q}y{j} - {p}y{i}) * ({r}x{k} - {p}x{i}) - ({q}x{j} - {p}x{i}) * ({r}y{k} - {p}y{i}))"
_t = lambda p, q, r: _TURN.format(p=p[0], i=p[1], q=q[0], j=q[1], r=r[0], k=r[1])
register("paired_segments", _paired, f"""WITH {QUADS}{AROUND}, e AS (SELECT polygon_id, pos, y AS y0, x AS x0, ny AS y1, nx AS x1 FROM an),
p AS (SELECT a.polygon_id, a.pos, a.y0 AS ay0, a.x0 AS ax0, a.y1 AS ay1, a.x1 AS ax1, b.y0 AS by0, b.x0 AS bx0, b.y1 AS by1, b.x1 AS bx1 FROM e a JOIN e b ON b.polygon_id = a.polygon_id + 1 AND (b.pos + 1) % 4 = a.pos)
SELECT polygon_id, pos, NOT ({_t('a0', 'a1', 'b0')} * {_t('a0', 'a1', 'b1')} > 0 OR {_t('b0', 'b1', 'a0')} * {_t('b0', 'b1', 'a1')} > 0) AND least(ay0, ay1) <= greatest(by0, by1) AND least(by0, by1) <= greatest(ay0, ay1) AND least(ax0, ax1) <= greatest(bx0, bx1) AND least(bx0, bx1) <= greatest(ax0, ax1) AS hit FROM p""")
register("segment_intersections_slanted", lambda s, d: polygon.parallel_crossing(polygon.candidate_cuts(fixtures.polygons(s, d)), fixtures.polygons(s, d), 0.9), f"""WITH {POLYGONS}{CUTS} SELECT c.polygon_id, a, b, sum(CASE WHEN {_s('y0', 'x0', 'y1', 'x1', 'y', 'x')} * {_s('y0', 'x0', 'y1', 'x1', 'ny', 'nx')} < 0 AND {_s('y', 'x', 'ny', 'nx', 'y0', 'x0')} * {_s('y', 'x', 'ny', 'nx', 'y1', 'x1')} < 0
  AND pow((y1-y0)*(ny-y)+(x1-x0)*(nx-x), 2) < 0.9::DOUBLE * 0.9::DOUBLE * (((y1-y0)*(y1-y0)+(x1-x0)*(x1-x0)) * ((ny-y)*(ny-y)+(nx-x)*(nx-x)))::DOUBLE THEN 1 ELSE 0 END) AS crossings FROM cuts c JOIN an ON an.polygon_id = c.polygon_id GROUP BY 1, 2, 3""")
register("point_in_polygon_within", lambda s, d: polygon.inside_within(polygon.candidate_cuts(fixtures.polygons(s, d)), fixtures.polygons(s, d), 1.5), f"""WITH {POLYGONS}{CUTS},
j AS (SELECT c.polygon_id, a, b, (y0+y1)/2.0::DOUBLE AS my, (x0+x1)/2.0::DOUBLE AS mx, y, x, (ny-y) AS ey, (nx-x) AS ex, (2*y > y0+y1) <> (2*ny > y0+y1) AND x0 + x1 < (2*nx - 2*x) * (y0+y1 - 2*y) / (2*ny - 2*y)::DOUBLE + 2*x AS odd FROM cuts c JOIN an ON an.polygon_id = c.polygon_id),
t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((my-y)*ey + (mx-x)*ex) / (ey*ey+ex*ex)::DOUBLE)) AS t FROM j)
SELECT polygon_id, a, b, sum(odd::INT) % 2 = 1 OR min(round(pow(my-y-t*ey, 2) + pow(mx-x-t*ex, 2), 9)) <= 2.25 AS inside FROM t GROUP BY 1, 2, 3""")
register("corner_vertices", lambda s, d: polygon.corner_vertices(fixtures.polygons(s, d)), f"""WITH {POLYGONS}, bx AS (SELECT polygon_id, min(y) AS a, min(x) AS b, max(y) AS c, max(x) AS d FROM polygons GROUP BY 1),
k AS (SELECT polygon_id, 0 AS corner, a AS cy, b AS cx FROM bx UNION ALL SELECT polygon_id, 1, a, d FROM bx UNION ALL SELECT polygon_id, 2, c, d FROM bx UNION ALL SELECT polygon_id, 3, c, b FROM bx),
m AS (SELECT polygon_id, corner, min([(y-cy)*(y-cy)+(x-cx)*(x-cx), pos, y, x]) AS m FROM k JOIN polygons USING (polygon_id) GROUP BY 1, 2) SELECT polygon_id, corner, m[2] AS pos, m[3] AS y, m[4] AS x FROM m""")
register("polygon_centroids", lambda s, d: polygon.centroids(fixtures.polygons(s, d)), f"WITH {POLYGONS} SELECT polygon_id, CAST(floor(sum(y) / 8.0) AS INT) AS y, CAST(floor(sum(x) / 8.0) AS INT) AS x FROM polygons GROUP BY 1")
register("edge_owners", lambda s, d: mesh.owners(fixtures.quads(s, d), s.range(200).select(F.col("id").cast("int").alias("a"), (F.col("id") + 1).cast("int").alias("b"))), f"WITH {QUADS}{MESH}, f AS (SELECT v_lo, v_hi, min([polygon_id, pos]) AS f FROM pe GROUP BY 1, 2) SELECT CAST(i AS INT) AS v_lo, CAST(i + 1 AS INT) AS v_hi, coalesce(edge_id, -1) AS edge_id, coalesce(f[1], -1) AS polygon_id, CAST(coalesce(f[2], -1) AS INT) AS pos FROM range(200) r(i) LEFT JOIN edges e ON e.v_lo = i AND e.v_hi = i + 1 LEFT JOIN f ON f.v_lo = i AND f.v_hi = i + 1")
_STRIP = {
    "opposite": (0, 2, "[[m0,c1,c2,m2],[m2,c3,c0,m0]]"),
    "adjacent": (0, 1, "[[m0,c1,m1,z],[m1,c2,c3,z],[z,c3,c0,m0]]"),
}
for _name, (_a, _b, _p) in _STRIP.items():
    register(f"quad_strip_{_name}", lambda s, d, a=_a, b=_b: mesh.quad_strip_cut(fixtures.quads(s, d), a, b), f"""WITH {QUADS}, w AS (SELECT polygon_id, {", ".join(f"max(CASE WHEN pos = {k} THEN [y, x] END) AS c{k}" for k in range(4))} FROM polygons GROUP BY 1),
v AS (SELECT *, {", ".join(f"[floor((c{k}[1]+c{(k + 1) % 4}[1])/2.0), floor((c{k}[2]+c{(k + 1) % 4}[2])/2.0)] AS m{k}" for k in range(4))}, [floor((c0[1]+c1[1]+c2[1]+c3[1])/4.0), floor((c0[2]+c1[2]+c2[2]+c3[2])/4.0)] AS z FROM w),
p AS (SELECT polygon_id, unnest({_p}) AS p, generate_subscripts({_p}, 1) - 1 AS part FROM v)
SELECT polygon_id, CAST(part AS INT) AS part, CAST(k AS INT) AS pos, CAST(p[k + 1][1] AS INT) AS y, CAST(p[k + 1][2] AS INT) AS x FROM p, range(4) r(k)""")


def _edited(s: SparkSession, d: str) -> DataFrame:
    q = fixtures.quads(s, d)
    return mesh.edges(settle(mesh.replaced(q, mesh.quad_strip_cut(q.where("polygon_id % 10 = 3"), 0, 2).withColumnRenamed("polygon_id", "of")), "edited"))


register("mesh_after_edit", _edited, f"""WITH {QUADS.replace('polygons AS', 'old AS')}, w AS (SELECT polygon_id, {", ".join(f"max(CASE WHEN pos = {k} THEN y END) AS y{k}, max(CASE WHEN pos = {k} THEN x END) AS x{k}" for k in range(4))} FROM old WHERE polygon_id % 10 = 3 GROUP BY 1),
v AS (SELECT *, floor((y0+y1)/2.0) AS my0, floor((x0+x1)/2.0) AS mx0, floor((y2+y3)/2.0) AS my2, floor((x2+x3)/2.0) AS mx2 FROM w),
cut AS (SELECT polygon_id AS o, part, pos, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (
  {" UNION ALL ".join(f"SELECT polygon_id, {part} AS part, {k} AS pos, {y} AS y, {x} AS x FROM v" for part, p in enumerate(((("my0", "mx0"), ("y1", "x1"), ("y2", "x2"), ("my2", "mx2")), (("my2", "mx2"), ("y3", "x3"), ("y0", "x0"), ("my0", "mx0")))) for k, (y, x) in enumerate(p))})
  UNION ALL SELECT polygon_id, 0, pos, y, x FROM old WHERE polygon_id % 10 <> 3),
polygons AS (SELECT dense_rank() OVER (ORDER BY o, part) - 1 AS polygon_id, pos, y, x FROM cut){MESH} SELECT * FROM edges""")
JAC = MESH + """, b AS (SELECT v_lo AS v, v_hi AS o, degree FROM edges UNION ALL SELECT v_hi, v_lo, degree FROM edges),
mv AS (SELECT m.vertex_id, min(degree) > 1 AS free, any_value(m.y) AS y, any_value(m.x) AS x, sum(n.y) / count(*)::DOUBLE AS ny, sum(n.x) / count(*)::DOUBLE AS nx FROM b JOIN vertices m ON m.vertex_id = v JOIN vertices n ON n.vertex_id = o GROUP BY 1)"""
register("smooth_displacements", lambda s, d: mesh.displacements(fixtures.quads(s, d)).select(F.round("mean", 6).alias("mean"), F.round("largest", 6).alias("largest")), f"WITH {QUADS}{JAC} SELECT round(sum(CASE WHEN free THEN pow(ny-y, 2) + pow(nx-x, 2) ELSE 0 END) / count(*), 6) AS mean, round(max(CASE WHEN free THEN pow(ny-y, 2) + pow(nx-x, 2) ELSE 0 END), 6) AS largest FROM mv")
register("polygons_of_region", lambda s, d: mesh.gathered(fixtures.quads(s, d).withColumn("region", F.floor(F.col("polygon_id") / 10).cast("int")), "region"), f"WITH {QUADS} SELECT CAST(polygon_id // 10 AS INT) AS region, count(DISTINCT polygon_id) AS n, string_agg(DISTINCT polygon_id::VARCHAR, ',' ORDER BY polygon_id::VARCHAR) AS polygons FROM polygons GROUP BY 1")
register("triangles_to_quads", lambda s, d: mesh.quad_mesh(_pieces(s, d), "group_id"))


def _pieces(s: SparkSession, d: str) -> DataFrame:
    """The mesh of quads, every third of them cut into two triangles."""
    q = fixtures.quads(s, d).withColumn("group_id", F.floor(F.col("polygon_id") / 50).cast("int"))
    halves = q.where("polygon_id % 3 = 0").withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))).where("(part = 0 AND pos <> 3) OR (part = 1 AND pos <> 1)")
    return q.where("polygon_id % 3 <> 0").withColumn("part", F.lit(0)).unionByName(halves)


register("triangles_left", lambda s, d: mesh.quad_mesh(_pieces(s, d), "group_id").groupBy("polygon_id", "part").count().agg(F.sum((F.col("count") != 4).cast("int")).alias("n")), "SELECT 0::BIGINT AS n")
register("mesh_partition", lambda s, d: polygon.mesh_partition(fixtures.polygons(s, d).withColumn("group_id", F.col("polygon_id")), "group_id", 2.0))
register("mesh_rim", lambda s, d: pipeline.void_edges(fixtures.quads(s, d).where("polygon_id % 7 <> 0")), f"WITH {QUADS.replace('polygons AS', 'every AS')}, polygons AS (SELECT * FROM every WHERE polygon_id % 7 <> 0){MESH} SELECT * FROM edges WHERE degree = 1")

# --- what kernels leave true -------------------------------------------------------------------------------------------


def _path_lengths(s: SparkSession, d: str) -> DataFrame:
    """Points on a shortest path from the first to the last pixel of the outer disc."""
    ends = ring(s, d).groupBy("image_id").agg(F.min(F.struct("y", "x")).alias("a"), F.max(F.struct("y", "x")).alias("b"))
    both = ring(s, d).join(ends.select("image_id", F.col("a.y").alias("ay"), F.col("a.x").alias("ax"), F.col("b.y").alias("by"), F.col("b.x").alias("bx")), "image_id")
    return graphs.shortest_paths(both, IMAGE).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


register("shortest_path_length", _path_lengths, DIST + " SELECT image_id, CAST(arg_max(distance, [y, x]) + 1 AS BIGINT) AS n FROM far GROUP BY 1")
register("region_pairs", lambda s, d: regions.region_graph(labelled(s, d)).where("a < b"), RGRAPH + " SELECT * FROM rg WHERE a < b")
register("long_lines", lambda s, d: borders.longer(fixtures.polylines(s, d), 300.0), f"WITH {POLYLINES}, n AS (SELECT line_id, pos, y, x, sqrt(pow(y - lag(y) OVER w, 2) + pow(x - lag(x) OVER w, 2)) AS d FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY pos)) SELECT lines.* FROM lines JOIN (SELECT line_id FROM n GROUP BY 1 HAVING round(coalesce(sum(d), 0), 6) > 300) USING (line_id)")


def _centred(s: SparkSession, d: str) -> DataFrame:
    p = fixtures.polygons(s, d)
    return p.withColumn("y", F.col("y") - 32).withColumn("x", F.col("x") - 32)


register("rasterize_signed", lambda s, d: polygon.outlines(_centred(s, d)), f"WITH {POLYGONS.replace('32 +', '0 +')}{AROUND}{LINES} SELECT DISTINCT polygon_id, {RASTER.format(a='y')}, {RASTER.format(a='x')} FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM e)")


def _areas(into: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        parts = polygon.partition(fixtures.polygons(s, d), into).withColumn("of", F.col("polygon_id"))
        m = polygon.measures(parts.select(F.concat_ws("/", "of", "part").alias("polygon_id"), "pos", "y", "x"))
        m = m.withColumn("of", F.substring_index("polygon_id", "/", 1).cast("long"))
        return m.groupBy("of").agg(F.sum(F.abs("area2")).alias("area2"), F.sum((~F.col("convex")).cast("int")).alias("bent"), F.max("n").alias("corners") if into == "quads" else F.lit(0).alias("corners"))

    return query


AREA = f"WITH {POLYGONS}{AROUND} SELECT polygon_id AS of, abs(sum(x * ny - nx * y)) AS area2, 0 AS bent, {{}} AS corners FROM an GROUP BY 1"
register("convex_parts_area", _areas("convex"), AREA.format(0))
register("quad_parts_area", _areas("quads"), AREA.format(4))
register("tiny_regions_left", lambda s, d: regions.stats(regions.merge_tiny(labelled(s, d))).groupBy("image_id").agg(F.sum((F.col("n") <= 10).cast("int")).alias("n")), f"WITH {GRID} SELECT image_id, 0 AS n FROM grid GROUP BY 1")
register("mesh_pipeline_faults", lambda s, d: pipeline.mesh_quads(fixtures.pixels(s, d)).groupBy("polygon_id", "ti", "bi").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("pos").alias("p")).agg(F.sum(((F.col("k") != 4) | (F.col("p") != 4)).cast("int")).alias("n")), "SELECT 0 AS n")
