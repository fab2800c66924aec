"""Registered queries over the raster and geometry operators, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.operators import borders, color, gradient, mesh, polygon, polyline, regions, sets, spatial, stencil
from pixelweft.plans import pipeline
from pixelweft.plans.fixpoint import settle
from pixelweft.sources import fixtures, images

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# --- fixtures in SQL ---------------------------------------------------------------------------------------------------

PIXELS = """
orders_n AS (SELECT CAST(FLOOR(COUNT(*) / 1024.0) AS INT) AS n FROM orders),
pixels AS (SELECT image_id, y, x, v AS r, v AS g, v AS b, CASE WHEN y >= 28 AND x >= 28 THEN 0 ELSE 255 END AS a FROM (
  SELECT image_id, y, x, CAST(CASE WHEN c % 211 = 0 THEN 1 WHEN (y-16)*(y-16)+(x-16)*(x-16) < 16 THEN 80
    WHEN (y-16)*(y-16)+(x-16)*(x-16) < 90 THEN 200 WHEN x < 10 + image_id % 5 THEN 140 ELSE 110 END AS INT) AS v
  FROM (SELECT CAST(FLOOR(o_orderkey / 1024.0) AS INT) AS image_id, CAST(FLOOR((o_orderkey % 1024) / 32.0) AS INT) AS y,
    CAST(o_orderkey % 32 AS INT) AS x, o_custkey AS c FROM orders) k, orders_n WHERE image_id < n) t)"""
HIST = PIXELS + """,
op AS (SELECT image_id, y, x, r + g + b AS value FROM pixels WHERE a > 10),
hist AS (SELECT image_id, value, count(*) AS n, min(y * 32 + x) AS f FROM op WHERE y <> 0 GROUP BY 1, 2),
least AS (SELECT image_id, count(*) * 0.01 AS t FROM op GROUP BY 1),
often AS (SELECT h.* FROM hist h JOIN least USING (image_id) WHERE n >= t),
fold AS (SELECT h.image_id, h.value, coalesce(CASE WHEN h.n < t THEN arg_min(o.value, ((h.value - o.value) * (h.value - o.value), o.f)) END, h.value) AS target
  FROM hist h JOIN least USING (image_id) LEFT JOIN often o ON o.image_id = h.image_id GROUP BY h.image_id, h.value, h.n, t)"""
GRID = HIST + """,
grid AS (SELECT p.image_id, p.y, p.x, CAST(CASE WHEN a > 10 AND p.y <> 0 THEN target ELSE -1 END AS INT) AS value
  FROM pixels p LEFT JOIN fold f ON f.image_id = p.image_id AND f.value = p.r + p.g + p.b)"""


def _regions(reach: int, name: str = "rp") -> str:
    return f""",
runs AS (SELECT image_id, value, y, min(x) AS x0, max(x) AS x1, image_id * 1024 + y * 32 + min(x) AS id
  FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y, value ORDER BY x) AS g FROM grid) GROUP BY image_id, value, y, g),
adj AS (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.image_id = b.image_id AND a.value = b.value AND abs(a.y - b.y) = 1
  AND a.x0 <= b.x1 + {reach} AND b.x0 <= a.x1 + {reach}),
reach(a, b) AS (SELECT id, id FROM runs UNION SELECT r.a, adj.b FROM reach r JOIN adj ON adj.a = r.b),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
{name} AS (SELECT r.image_id, r.y, CAST(x AS INT) AS x, CAST(dense_rank() OVER (PARTITION BY r.image_id ORDER BY root) - 1 AS INT) AS region_id, value
  FROM runs r JOIN root USING (id), LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x))"""


OFF8 = "(VALUES (0,1,0),(1,1,1),(2,0,1),(3,-1,1),(4,-1,0),(5,-1,-1),(6,0,-1),(7,1,-1)) o(i,dy,dx)"
OFF4 = "(VALUES (0,1,0),(1,0,1),(2,-1,0),(3,0,-1)) o(i,dy,dx)"
REGIONS = "WITH RECURSIVE " + GRID.lstrip() + _regions(1)
PAIRS4 = f""",
nb AS (SELECT p.image_id, p.y, p.x, p.region_id AS o, p.value AS vo, q.region_id AS m, q.value AS vm, q.y AS ny, q.x AS nx
  FROM rp p CROSS JOIN {OFF4} JOIN rp q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.region_id <> q.region_id)"""
DRAWN = PAIRS4 + """,
drawn AS (SELECT DISTINCT image_id, o AS region_id, m AS other_id, y, x FROM nb WHERE CASE WHEN vo <> -1 AND vm <> -1 THEN o > m ELSE vo <> -1 AND vm = -1 END)"""
POLYLINES = "lines AS (SELECT user_id AS line_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS pos, value AS y, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS x FROM events)"
POLYGONS = """polygons AS (SELECT p_partkey AS polygon_id, pos, CAST(32 + dy * (4 + (p_partkey * 7 + pos * 5) % 9) AS INT) AS y,
  CAST(32 + dx * (4 + (p_partkey * 7 + pos * 5) % 9) AS INT) AS x
  FROM part CROSS JOIN (VALUES (0,0,1),(1,1,1),(2,1,0),(3,1,-1),(4,0,-1),(5,-1,-1),(6,-1,0),(7,-1,1)) d(pos, dy, dx))"""
QUADS = """polygons AS (SELECT q AS polygon_id, pos, CAST(8*gy + (gy*7+gx*3) % 3 AS INT) AS y, CAST(8*gx + (gy*5+gx*2) % 3 AS INT) AS x
  FROM (SELECT p_partkey AS q, pos, CAST(FLOOR(p_partkey/10.0) AS INT) + oy AS gy, CAST(p_partkey % 10 AS INT) + ox AS gx
  FROM part CROSS JOIN (VALUES (0,0,0),(1,0,1),(2,1,1),(3,1,0)) d(pos, oy, ox)) g)"""
AROUND = """,
an AS (SELECT polygon_id, pos, y, x, coalesce(lag(y) OVER w, last_value(y) OVER u) AS py, coalesce(lag(x) OVER w, last_value(x) OVER u) AS px,
  coalesce(lead(y) OVER w, first_value(y) OVER u) AS ny, coalesce(lead(x) OVER w, first_value(x) OVER u) AS nx FROM polygons
  WINDOW w AS (PARTITION BY polygon_id ORDER BY pos), u AS (PARTITION BY polygon_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
MESH = AROUND + """,
vertices AS (SELECT CAST(row_number() OVER (ORDER BY y, x) - 1 AS INT) AS vertex_id, y, x FROM (SELECT DISTINCT y, x FROM polygons)),
pe AS (SELECT polygon_id, pos, least(a.vertex_id, b.vertex_id) AS v_lo, greatest(a.vertex_id, b.vertex_id) AS v_hi FROM an
  JOIN vertices a ON a.y = an.y AND a.x = an.x JOIN vertices b ON b.y = an.ny AND b.x = an.nx),
edges AS (SELECT CAST(row_number() OVER (ORDER BY v_hi, v_lo) - 1 AS INT) AS edge_id, v_lo, v_hi, degree FROM (SELECT v_lo, v_hi, CAST(count(DISTINCT polygon_id) AS INT) AS degree FROM pe GROUP BY 1, 2)),
inc AS (SELECT polygon_id, pos, edge_id, degree FROM pe JOIN edges USING (v_lo, v_hi))"""


def register(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def grid(spark: SparkSession, d: str) -> DataFrame:
    return color.value_grid(fixtures.pixels(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return regions.label_kernel(grid(spark, d))


def drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rp = settle(labelled(spark, d), "regions")
    return stencil.drawn_border(rp), rp


# --- colour and regions ------------------------------------------------------------------------------------------------

register("brightness_histogram", lambda s, d: color.histogram(fixtures.pixels(s, d)), f"WITH {HIST} SELECT image_id, value, n, CAST(f // 32 AS INT) AS first_y, CAST(f % 32 AS INT) AS first_x FROM hist")
register("rare_value_fold", lambda s, d: color.fold_independent(fixtures.pixels(s, d)), f"WITH {HIST} SELECT * FROM fold")
# One value of these images is rare, so the order of folds doesn't matter here; tests/test_kernels.py has cases where it does.
register("rare_value_fold_sequential", lambda s, d: color.fold_sequential(fixtures.pixels(s, d)), f"WITH {HIST} SELECT * FROM fold")
register("value_grid", grid, f"WITH {GRID} SELECT * FROM grid")
register("grey_levels", lambda s, d: color.levels(grid(s, d)), f"WITH {GRID} SELECT *, CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) * 255.0::DOUBLE / (max(value) OVER w - min(value) OVER w) ELSE 0.0::DOUBLE END AS level FROM grid WINDOW w AS (PARTITION BY image_id)")
register("regions_cc8", lambda s, d: regions.label_relational(grid(s, d)), REGIONS + " SELECT * FROM rp")
register("regions_cc4", lambda s, d: regions.label_kernel(grid(s, d), False), "WITH RECURSIVE " + GRID.lstrip() + _regions(0) + " SELECT * FROM rp")
register("region_stats", lambda s, d: regions.stats(labelled(s, d)), REGIONS + " SELECT image_id, region_id, value, count(*) AS n, min(y) AS y_min, min(x) AS x_min, max(y) AS y_max, max(x) AS x_max FROM rp GROUP BY 1, 2, 3")
register("region_modes", lambda s, d: regions.modes(labelled(s, d), color.opaque(fixtures.pixels(s, d))), REGIONS + ", c AS (SELECT image_id, region_id, op.value, count(*) AS k FROM rp JOIN op USING (image_id, y, x) GROUP BY 1, 2, 3) SELECT image_id, region_id, arg_min(value, (-k, value)) AS mode FROM c GROUP BY 1, 2")
register("region_coverage", lambda s, d: regions.coverage_faults(grid(s, d), labelled(s, d)), REGIONS + " SELECT g.image_id, g.y, g.x, count(rp.region_id) AS n FROM grid g LEFT JOIN rp USING (image_id, y, x) GROUP BY 1, 2, 3 HAVING count(rp.region_id) <> 1")


def _torn(s: SparkSession, d: str) -> DataFrame:
    """Regions with pixels missing and a row twice."""
    rp = settle(labelled(s, d), "regions")
    return regions.coverage_faults(grid(s, d), rp.where("(y + x) % 7 <> 0").union(rp.where("y = 3")))


register("region_coverage_faults", _torn, REGIONS + ", t AS (SELECT * FROM rp WHERE (y + x) % 7 <> 0 UNION ALL SELECT * FROM rp WHERE y = 3) SELECT g.image_id, g.y, g.x, count(t.region_id) AS n FROM grid g LEFT JOIN t USING (image_id, y, x) GROUP BY 1, 2, 3 HAVING count(t.region_id) <> 1")
register("merge_tiny_regions", lambda s, d: regions.merge_tiny(labelled(s, d)))
PARTS = """
pts AS ({points}),
ladj AS (SELECT a.k, a.y AS y, a.x AS x, b.y AS ny, b.x AS nx FROM pts a JOIN pts b ON a.k = b.k AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
grow(k, y, x, ry, rx) AS (SELECT k, y, x, y, x FROM pts UNION SELECT g.k, l.ny, l.nx, g.ry, g.rx FROM grow g JOIN ladj l ON l.k = g.k AND l.y = g.y AND l.x = g.x),
heads AS (SELECT k, y, x, min((ry, rx)) AS head FROM grow GROUP BY 1, 2, 3)"""
register("holes", lambda s, d: regions.holed(settle(labelled(s, d), "regions")), REGIONS + PAIRS4 + "," + PARTS.format(points="SELECT DISTINCT image_id * 100000 + o AS k, ny AS y, nx AS x FROM nb") + " SELECT CAST(k // 100000 AS INT) AS image_id, CAST(k % 100000 AS INT) AS region_id, CAST(count(DISTINCT head) AS INT) AS parts FROM heads GROUP BY k HAVING count(DISTINCT head) > 1")
register("quadtree_cells", lambda s, d: regions.quadtree(grid(s, d)), f"WITH {GRID}, " + ", ".join([f"l{k} AS (SELECT g.image_id, y, x, value FROM {'grid' if not k else f'c{k - 1}'} g {'' if not k else 'WHERE NOT one'}), c{k} AS (SELECT *, y // {32 >> k} AS cy, x // {32 >> k} AS cx, min(value) OVER w = max(value) OVER w AS one FROM l{k} WINDOW w AS (PARTITION BY image_id, y // {32 >> k}, x // {32 >> k}))" for k in range(6)]) + " " + " UNION ALL ".join(f"SELECT image_id, {k} AS level, cy, cx, {32 >> k} AS size, count(*) AS n, min(value) AS value FROM c{k} WHERE one GROUP BY image_id, cy, cx" for k in range(6)))

# --- stencils and borders ----------------------------------------------------------------------------------------------

register("neighbor_values", lambda s, d: stencil.neighbor_values(grid(s, d)), f"WITH {GRID} SELECT g.image_id, g.y, g.x, g.value, i, g.y + dy AS ny, g.x + dx AS nx, coalesce(n.value, -1) AS nvalue FROM grid g CROSS JOIN {OFF8} LEFT JOIN grid n ON n.image_id = g.image_id AND n.y = g.y + dy AND n.x = g.x + dx")
register("neighbor_match_count", lambda s, d: stencil.match_counts(grid(s, d)), f"WITH {GRID} SELECT g.image_id, g.y, g.x, count(n.value) AS n FROM grid g CROSS JOIN {OFF8} LEFT JOIN grid n ON n.image_id = g.image_id AND n.y = g.y + dy AND n.x = g.x + dx AND n.value = g.value WHERE g.value <> -1 GROUP BY 1, 2, 3")
_BAD = [m for m in range(256) if bin(m).count("1") == 2 and stencil.ring_components(m) != 2]
ISSUES = f"""masks AS (SELECT g.image_id, g.y, g.x, CAST(sum(CASE WHEN n.value = g.value THEN 1 << i ELSE 0 END) AS INT) AS mask FROM grid g CROSS JOIN {OFF8}
  LEFT JOIN grid n ON n.image_id = g.image_id AND n.y = g.y + dy AND n.x = g.x + dx WHERE g.value <> -1 GROUP BY 1, 2, 3),
issues AS (SELECT image_id, y, x, CASE WHEN bit_count(mask) = 1 THEN 'tip' ELSE 'line' END AS reason FROM masks WHERE bit_count(mask) = 1 OR mask IN ({", ".join(map(str, _BAD))}))"""
register("geometry_issues", lambda s, d: stencil.geometry_issues(grid(s, d)), f"WITH {GRID}, {ISSUES} SELECT * FROM issues")
register("issue_highlight", lambda s, d: stencil.highlight(fixtures.pixels(s, d), stencil.geometry_issues(grid(s, d))), f"WITH {GRID}, {ISSUES} SELECT p.image_id, p.y, p.x, CASE WHEN reason IS NULL THEN r ELSE 255 END AS r, CASE WHEN reason IS NULL THEN g ELSE 0 END AS g, CASE WHEN reason IS NULL THEN b ELSE 0 END AS b, CASE WHEN reason IS NULL THEN a ELSE 255 END AS a FROM pixels p LEFT JOIN issues i USING (image_id, y, x)")
register("issue_lines", lambda s, d: images.issue_lines(stencil.geometry_issues(grid(s, d))), f"WITH {GRID}, {ISSUES} SELECT y || ', ' || x AS value FROM issues")
register("matrix_csv", lambda s, d: images.matrix_csv(grid(s, d)), f"WITH {GRID} SELECT image_id, y, string_agg(value, ',' ORDER BY x) AS line FROM grid GROUP BY 1, 2")
register("drawn_border", lambda s, d: drawn(s, d)[0], REGIONS + DRAWN + " SELECT * FROM drawn")
register("owned_border", lambda s, d: stencil.owned_border(labelled(s, d)), REGIONS + PAIRS4 + " SELECT image_id, region_id, other_id, y, x, count(*) AS n FROM (SELECT image_id, CASE WHEN m > o AND vo >= 0 AND vm >= 0 THEN o ELSE m END AS region_id, CASE WHEN m > o AND vo >= 0 AND vm >= 0 THEN m ELSE o END AS other_id, ny AS y, nx AS x FROM nb WHERE (m > o AND vo >= 0 AND vm >= 0) OR (vo = -1 AND vm <> -1) UNION ALL SELECT image_id, region_id, -1, y, x FROM rp WHERE y = 0 OR x = 0) GROUP BY 1, 2, 3, 4, 5")
register("outward_border_bag", lambda s, d: stencil.outward_border(labelled(s, d)), REGIONS + PAIRS4 + " SELECT image_id, o AS region_id, ny AS y, nx AS x, count(*) AS n FROM nb GROUP BY 1, 2, 3, 4")
ADJ = """, badj AS (SELECT a.image_id, a.region_id, a.other_id, a.y, a.x, b.y AS ny, b.x AS nx FROM drawn a JOIN drawn b ON a.image_id = b.image_id AND a.region_id = b.region_id AND a.other_id = b.other_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y, a.x) <> (b.y, b.x))"""
SHARE = """, madj AS (SELECT DISTINCT a.* FROM badj a JOIN rp c ON c.image_id = a.image_id AND c.region_id = a.other_id AND abs(c.y - a.y) <= 1 AND abs(c.x - a.x) <= 1 AND abs(c.y - a.ny) <= 1 AND abs(c.x - a.nx) <= 1)"""
register("pixel_adjacency", lambda s, d: stencil.adjacency(drawn(s, d)[0], borders.PAIR), REGIONS + DRAWN + ADJ + " SELECT * FROM badj")
register("border_adjacency", lambda s, d: stencil.border_adjacency(*drawn(s, d)), REGIONS + DRAWN + ADJ + SHARE + " SELECT * FROM madj")


def _segments(s: SparkSession, d: str) -> DataFrame:
    b, rp = drawn(s, d)
    return borders.segments(b, stencil.border_adjacency(b, rp))


def walked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b, rp = drawn(s, d)
    seg = settle(borders.segments(b, stencil.border_adjacency(b, rp)), "segments")
    return seg, settle(borders.walks(seg, rp), "walks")


register("border_segments", _segments, REGIONS + DRAWN + ADJ + SHARE + """, walkg(image_id, region_id, other_id, y, x, ry, rx) AS (SELECT image_id, region_id, other_id, y, x, y, x FROM drawn
  UNION SELECT g.image_id, g.region_id, g.other_id, a.ny, a.nx, g.ry, g.rx FROM walkg g JOIN madj a USING (image_id, region_id, other_id, y, x)),
wh AS (SELECT image_id, region_id, other_id, y, x, min((ry, rx)) AS head FROM walkg GROUP BY 1, 2, 3, 4, 5)
SELECT image_id, region_id, other_id, CAST(dense_rank() OVER (PARTITION BY image_id, region_id, other_id ORDER BY head) - 1 AS INT) AS segment, y, x FROM wh""")
register("border_walks", lambda s, d: walked(s, d)[1])
register("border_loops", lambda s, d: borders.loops(walked(s, d)[1]))
register("traversal_failures", lambda s, d: borders.traversal_failures(*walked(s, d)))
register("region_loops", lambda s, d: borders.region_loops(walked(s, d)[1]))
register("region_polygons", lambda s, d: pipeline.region_polygons(fixtures.pixels(s, d)))
register("mesh_pipeline", lambda s, d: pipeline.mesh_quads(fixtures.pixels(s, d)))
register("contact_pixels", lambda s, d: stencil.contact(grid(s, d).where("value = 600"), grid(s, d).where("value = 240")), f"WITH {GRID} SELECT DISTINCT a.* FROM grid a JOIN grid b ON b.image_id = a.image_id AND b.value = 240 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.value = 600")
register("stripe_sample", lambda s, d: stencil.stripes(grid(s, d), 5, 2, 3), f"WITH {GRID} SELECT * FROM grid WHERE y % 5 = 2 AND x % 5 = 3")
register("image_frame", lambda s, d: stencil.frame(grid(s, d)), f"WITH {GRID} SELECT * FROM grid WHERE y IN (0, 31) OR x IN (0, 31)")
register("window_slice", lambda s, d: stencil.window(grid(s, d), 16, 16, 5), f"WITH {GRID} SELECT * FROM grid WHERE y BETWEEN 11 AND 21 AND x BETWEEN 11 AND 21")

# --- gradient and nearest joins ----------------------------------------------------------------------------------------

BORDERS = GRID + f""",
vb AS (SELECT DISTINCT g.image_id, g.value, n.value AS bvalue, n.y AS by_, n.x AS bx FROM grid g CROSS JOIN {OFF4} JOIN grid n ON n.image_id = g.image_id AND n.y = g.y + dy AND n.x = g.x + dx WHERE g.value <> -1 AND n.value <> -1 AND g.value <> n.value)"""
NEAR = BORDERS + """,
nr AS (SELECT g.image_id, g.y, g.x, g.value, min(((g.y-by_)*(g.y-by_)+(g.x-bx)*(g.x-bx), bvalue, by_, bx)) AS c FROM grid g JOIN vb USING (image_id, value) WHERE g.value <> -1 GROUP BY 1, 2, 3, 4),
near AS (SELECT image_id, y, x, value, c[2] AS cvalue, c[3] AS cy, c[4] AS cx FROM nr)"""
register("nearest_border", lambda s, d: gradient.nearest_borders(grid(s, d)), f"WITH {NEAR} SELECT * FROM near")
register("gradient_fill", lambda s, d: gradient.fill(grid(s, d)), f"""WITH {NEAR},
ray AS (SELECT n.*, bvalue, by_, bx, ((by_-y)*(by_-y)+(bx-x)*(bx-x)) AS d2, ((cy-y)*(cy-y)+(cx-x)*(cx-x)) AS c2, -((cy-y)*(by_-y)+(cx-x)*(bx-x)) AS dot FROM near n JOIN vb USING (image_id, value)),
opp AS (SELECT image_id, y, x, value, cvalue, cy, cx, min(((d2 - 4) * c2 > dot * dot OR dot < 0, d2, bvalue, by_, bx)) AS o FROM ray GROUP BY 1, 2, 3, 4, 5, 6, 7),
anc AS (SELECT *, (cvalue > value AND o[3] > value) OR (cvalue < value AND o[3] < value) AS mid FROM opp),
two AS (SELECT image_id, y, x, value, (cvalue + value) / 2.0::DOUBLE AS v1, CASE WHEN mid THEN value::DOUBLE ELSE (o[3] + value) / 2.0::DOUBLE END AS v2,
  sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) AS d1, CASE WHEN mid THEN (cy + o[4]) / 2.0::DOUBLE ELSE o[4]::DOUBLE END AS oy, CASE WHEN mid THEN (cx + o[5]) / 2.0::DOUBLE ELSE o[5]::DOUBLE END AS ox FROM anc),
dis AS (SELECT *, sqrt((y - oy) * (y - oy) + (x - ox) * (x - ox)) AS d2 FROM two)
SELECT image_id, y, x, value, round(v1 * (1 - d1 / (d1 + d2)) + v2 * (1 - d2 / (d1 + d2)), 6) AS filled FROM dis""")
_GREY = "greatest(0, least(255, CAST(trunc(filled / 3) AS INT)))"
register("gradient_pixels", lambda s, d: pipeline.gradient_fill(fixtures.pixels(s, d)), _SQL["gradient_fill"].replace("SELECT image_id, y, x, value, round(v1", "SELECT image_id, y, x, filled / 3 AS value, " + ", ".join(f"{_GREY} AS {c}" for c in "rgb") + ", 255 AS a FROM (SELECT image_id, y, x, round(v1") + ")")
register("nearest_pair", lambda s, d: spatial.nearest_pairs(grid(s, d).where("value <> -1 AND (y + x) % 2 = 0"), ["image_id"], "value"), f"WITH {GRID}, g AS (SELECT * FROM grid WHERE value <> -1 AND (y + x) % 2 = 0), m AS (SELECT a.image_id, a.value AS a, b.value AS b, min(((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x), a.y, a.x, b.y, b.x)) AS m FROM g a JOIN g b ON a.image_id = b.image_id AND a.value < b.value GROUP BY 1, 2, 3) SELECT image_id, a, b, m[1] AS d2, m[2] AS ay, m[3] AS ax, m[4] AS \"by\", m[5] AS bx FROM m")


def _rects(s: SparkSession, d: str) -> DataFrame:
    q = regions.quadtree(grid(s, d))
    top, left = F.col("cy") * F.col("size"), F.col("cx") * F.col("size")
    return q.select("image_id", (top * 32 + left).alias("rect_id"), top.alias("top"), left.alias("left"), (top + F.col("size") - 1).alias("bottom"), (left + F.col("size") - 1).alias("right"))


_RECTS = f"WITH {GRID}, " + _SQL["quadtree_cells"].split(GRID + ", ")[1].split(" SELECT image_id, 0 AS level")[0] + ", rects AS (SELECT image_id, cy * size * 32 + cx * size AS rect_id, cy * size AS top, cx * size AS \"left\", cy * size + size - 1 AS bottom, cx * size + size - 1 AS \"right\" FROM (SELECT image_id, 0 AS level" + _SQL["quadtree_cells"].split(" SELECT image_id, 0 AS level")[1] + "))"
_RECTS = re.sub(r"\b([lc]\d|rects) AS \(", r"\1 AS MATERIALIZED (", _RECTS)
register("rect_contacts", lambda s, d: spatial.rect_contacts(_rects(s, d), ["image_id"]), _RECTS + """ SELECT a.image_id, a.rect_id AS a, b.rect_id AS b FROM rects a JOIN rects b ON a.image_id = b.image_id AND a.rect_id < b.rect_id
  AND a.top <= b.bottom + 1 AND b.top <= a.bottom + 1 AND a."left" <= b."right" + 1 AND b."left" <= a."right" + 1""")
register("rects_in_window", lambda s, d: spatial.rects_in_window(_rects(s, d), 8, 8, 20, 20), _RECTS + ' SELECT * FROM rects WHERE top <= 20 AND bottom >= 8 AND "left" <= 20 AND "right" >= 8')
register("pattern_codes", lambda s, d: spatial.pattern_codes(grid(s, d).where("value = 600"), ["image_id"]), f"WITH {GRID}, p AS (SELECT * FROM grid WHERE value = 600), f AS (SELECT row_number() OVER (ORDER BY dy, dx) - 1 AS i, dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy <> 0 OR dx <> 0) SELECT p.image_id, p.y, p.x, CAST(coalesce(sum(CASE WHEN q.y IS NOT NULL THEN 1 << i::INT END), 0) AS INT) AS code FROM p CROSS JOIN f LEFT JOIN p q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3")
register("substitute_values", lambda s, d: spatial.substitute(grid(s, d), "value", s.createDataFrame([(600, 6), (240, 2)], "source int, target int")), f"WITH {GRID} SELECT image_id, y, x, CASE value WHEN 600 THEN 6 WHEN 240 THEN 2 ELSE value END AS value FROM grid")

# --- polylines ---------------------------------------------------------------------------------------------------------

register("polyline_length", lambda s, d: polyline.lengths(fixtures.polylines(s, d)).withColumn("length", F.round("length", 6)), f"WITH {POLYLINES}, n AS (SELECT line_id, sqrt(pow(y - lag(y) OVER w, 2) + pow(x - lag(x) OVER w, 2)) AS d FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY pos)) SELECT line_id, round(coalesce(sum(d), 0.0), 6) AS length FROM n GROUP BY 1")
register("polyline_displacements", lambda s, d: polyline.displacements(fixtures.polylines(s, d)), f"WITH {POLYLINES}, n AS (SELECT line_id, pos, lead(y) OVER w - y AS dy, lead(x) OVER w - x AS dx FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY pos)) SELECT * FROM n WHERE dy IS NOT NULL")
register("polyline_offset", lambda s, d: polyline.offset(fixtures.polylines(s, d), 2.0).withColumn("y", F.round("y", 6)).withColumn("x", F.round("x", 6)), f"WITH {POLYLINES}, e AS (SELECT line_id, arg_max(y, pos) - arg_min(y, pos) AS cy, arg_max(x, pos) - arg_min(x, pos) AS cx FROM lines GROUP BY 1) SELECT line_id, pos, round(y + 2.0 * cx / sqrt(cy * cy + cx * cx), 6) AS y, round(x - 2.0 * cy / sqrt(cy * cy + cx * cx), 6) AS x FROM lines JOIN e USING (line_id) WHERE cy * cy + cx * cx > 0")
register("line_fit", lambda s, d: polyline.fits(fixtures.polylines(s, d)).select("line_id", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")]), f"WITH {POLYLINES} SELECT line_id, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM lines GROUP BY 1")
register("straight_prefix", lambda s, d: polyline.straight_prefix(fixtures.polylines(s, d)), f"WITH {POLYLINES}, r AS (SELECT line_id, count(*) OVER w AS n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x*y) OVER w AS sxy, sum(x*x) OVER w AS sxx, sum(y*y) OVER w AS syy FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY pos)), v AS (SELECT line_id, n, n*sxy - sx*sy AS c, (n*sxx - sx*sx) * (n*syy - sy*sy) AS v FROM r) SELECT line_id, max(n) AS n FROM v WHERE n <= 2 OR v <= 0 OR c * c >= 0.5 * v GROUP BY 1")
register("rdp_simplify", lambda s, d: polyline.simplify(fixtures.polylines(s, d)))
register("rdp_simplify_strict", lambda s, d: polyline.simplify(fixtures.polylines(s, d), strict=True))
RASTER = "CAST(CASE WHEN n = 0 THEN {a}0 ELSE trunc({a}0 + i * ({a}1 - {a}0) / n::DOUBLE) END AS INT) AS {a}"
LINES = ", e AS (SELECT polygon_id, pos, y AS y0, x AS x0, ny AS y1, nx AS x1, greatest(abs(ny - y), abs(nx - x)) AS n FROM an)"
register("rasterize_lines", lambda s, d: polyline.rasterize(polygon.edges(fixtures.polygons(s, d)), ["polygon_id", "pos"]), f"WITH {POLYGONS}{AROUND}{LINES} SELECT polygon_id, pos, CAST(i AS INT) AS i, {RASTER.format(a='y')}, {RASTER.format(a='x')} FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM e)")
register("rasterize_polygons", lambda s, d: polygon.outlines(fixtures.polygons(s, d)), f"WITH {POLYGONS}{AROUND}{LINES} SELECT DISTINCT polygon_id, {RASTER.format(a='y')}, {RASTER.format(a='x')} FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM e)")

# --- polygons and meshes -----------------------------------------------------------------------------------------------

AB = "(y - py) AS ay, (x - px) AS ax, (ny - y) AS by_, (nx - x) AS bx"
register("corner_cross", lambda s, d: polygon.corner_cross(fixtures.polygons(s, d)).withColumn("z", F.round("z", 6)), f"WITH {POLYGONS}{AROUND} SELECT polygon_id, pos, round((ay * bx - ax * by_) / (sqrt(ay*ay+ax*ax) * sqrt(by_*by_+bx*bx)), 6) AS z FROM (SELECT *, {AB} FROM an)")
register("ideal_cut", lambda s, d: polygon.ideal_cuts(fixtures.polygons(s, d)).select("polygon_id", "pos", F.round("cy", 6).alias("cy"), F.round("cx", 6).alias("cx")), f"WITH {POLYGONS}{AROUND}, u AS (SELECT polygon_id, pos, (ay / sqrt(ay*ay+ax*ax) - by_ / sqrt(by_*by_+bx*bx)) / 2 AS sy, (ax / sqrt(ay*ay+ax*ax) - bx / sqrt(by_*by_+bx*bx)) / 2 AS sx FROM (SELECT *, {AB} FROM an)) SELECT polygon_id, pos, CASE WHEN sqrt(sy*sy+sx*sx) > 1e-9 THEN round(sy / sqrt(sy*sy+sx*sx), 6) END AS cy, CASE WHEN sqrt(sy*sy+sx*sx) > 1e-9 THEN round(sx / sqrt(sy*sy+sx*sx), 6) END AS cx FROM u")
register("polygon_measures", lambda s, d: polygon.measures(fixtures.polygons(s, d)).withColumn("ratio", F.round("ratio", 6)), f"""WITH {POLYGONS}{AROUND}, t AS (SELECT *, ay * bx - ax * by_ AS turn, by_*by_+bx*bx AS e FROM (SELECT *, {AB} FROM an))
SELECT polygon_id, count(*) AS n, sum(x * ny - nx * y) AS area2, round(CASE WHEN min(e) > 0 THEN sqrt(max(e) / min(e)::DOUBLE) END, 6) AS ratio, min(y) AS y_min, min(x) AS x_min, max(y) AS y_max, max(x) AS x_max,
  sum(CASE WHEN turn > 0 THEN 1 ELSE 0 END) AS up, sum(CASE WHEN turn <= 0 THEN 1 ELSE 0 END) AS down, sum(CASE WHEN turn > 0 THEN 1 ELSE 0 END) = 0 OR sum(CASE WHEN turn <= 0 THEN 1 ELSE 0 END) = 0 AS convex, count(*) > 2 AND count(DISTINCT (y, x)) = count(*) AS valid FROM t GROUP BY 1""")
CUTS = AROUND + """, cuts AS (SELECT a.polygon_id, a.pos AS a, b.pos AS b, a.y AS y0, a.x AS x0, b.y AS y1, b.x AS x1 FROM polygons a JOIN polygons b ON a.polygon_id = b.polygon_id AND b.pos - a.pos > 1 AND b.pos - a.pos < 7)"""
SIDE = "sign(({by} - {ay}) * ({cx} - {ax}) - ({bx} - {ax}) * ({cy} - {ay}))"
_s = lambda *n: SIDE.format(**dict(zip(("ay", "ax", "by", "bx", "cy", "cx"), n, strict=True)))
register("segment_intersections", lambda s, d: polygon.crossing(polygon.candidate_cuts(fixtures.polygons(s, d)), fixtures.polygons(s, d)), f"WITH {POLYGONS}{CUTS} SELECT c.polygon_id, a, b, sum(CASE WHEN {_s('y0', 'x0', 'y1', 'x1', 'y', 'x')} * {_s('y0', 'x0', 'y1', 'x1', 'ny', 'nx')} < 0 AND {_s('y', 'x', 'ny', 'nx', 'y0', 'x0')} * {_s('y', 'x', 'ny', 'nx', 'y1', 'x1')} < 0 THEN 1 ELSE 0 END) AS crossings FROM cuts c JOIN an USING (polygon_id) GROUP BY 1, 2, 3")
register("point_in_polygon", lambda s, d: polygon.middle_inside(polygon.candidate_cuts(fixtures.polygons(s, d)), fixtures.polygons(s, d)), f"WITH {POLYGONS}{CUTS} SELECT polygon_id, a, b, sum(CASE WHEN (2*y > y0+y1) <> (2*ny > y0+y1) AND x0 + x1 < (2*nx - 2*x) * (y0+y1 - 2*y) / (2*ny - 2*y)::DOUBLE + 2*x THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM cuts JOIN an USING (polygon_id) GROUP BY 1, 2, 3")
register("convex_parts", lambda s, d: polygon.partition(fixtures.polygons(s, d), "convex"))
register("quad_parts", lambda s, d: polygon.partition(fixtures.polygons(s, d), "quads"))
register("first_occurrences", lambda s, d: polygon.first_occurrences(fixtures.polygons(s, d).union(fixtures.polygons(s, d).withColumn("pos", F.col("pos") + 8))), f"WITH {POLYGONS} SELECT polygon_id, CAST(row_number() OVER (PARTITION BY polygon_id ORDER BY min(pos)) - 1 AS INT) AS pos, y, x FROM polygons GROUP BY polygon_id, y, x")
_W = ", w AS (SELECT polygon_id, " + ", ".join(f"max(CASE WHEN pos = {k} THEN {c} END) AS {c}{k}" for k in range(4) for c in "yx") + " FROM polygons GROUP BY 1)"
_SUB = "CAST(floor((({c}0 * (2 - t) + {c}1 * t) * (2 - b) + ({c}3 * (2 - t) + {c}2 * t) * b) / 4.0) AS INT) AS {c}"
register("quad_subdivide", lambda s, d: polygon.subdivide(fixtures.quads(s, d)), f"WITH {QUADS}{_W} SELECT polygon_id, ti, bi, pos, {_SUB.format(c='y')}, {_SUB.format(c='x')} FROM (SELECT w.*, CAST(ti AS INT) AS ti, CAST(bi AS INT) AS bi, pos, ti + da AS t, bi + db AS b FROM w, range(2) u(ti), range(2) v(bi), (VALUES (0,0,0),(1,0,1),(2,1,1),(3,1,0)) q(pos, da, db))")
register("mesh_vertices", lambda s, d: mesh.vertices(fixtures.quads(s, d)), f"WITH {QUADS}{MESH} SELECT * FROM vertices")
register("mesh_edges", lambda s, d: mesh.edges(fixtures.quads(s, d)), f"WITH {QUADS}{MESH} SELECT * FROM edges")
register("mesh_incidence", lambda s, d: mesh.incidence(fixtures.quads(s, d)), f"WITH {QUADS}{MESH} SELECT * FROM inc")
register("vertex_lookup", lambda s, d: mesh.polygon_vertices(fixtures.quads(s, d), mesh.vertices(fixtures.quads(s, d))), f"WITH {QUADS}{MESH} SELECT polygon_id, pos, vertex_id FROM polygons JOIN vertices USING (y, x)")
register("void_edges", lambda s, d: pipeline.void_edges(fixtures.quads(s, d)), f"WITH {QUADS}{MESH} SELECT * FROM edges WHERE degree = 1")
register("void_polygons", lambda s, d: mesh.void_polygons(fixtures.quads(s, d)), f"WITH {QUADS}{MESH} SELECT polygon_id, count(*) = 3 AS triangle, min(degree) = 1 AS void_border FROM inc GROUP BY 1")
register("polygon_neighbors", lambda s, d: mesh.neighbors(fixtures.quads(s, d)), f"WITH {QUADS}{MESH} SELECT a.polygon_id, a.pos, b.polygon_id AS neighbor_id FROM inc a LEFT JOIN inc b ON a.edge_id = b.edge_id AND a.polygon_id <> b.polygon_id")
register("polygon_by_points", lambda s, d: mesh.containing(fixtures.quads(s, d), fixtures.quads(s, d).where("polygon_id = 11 AND pos < 3").select("y", "x"), 3), f"WITH {QUADS}, p AS (SELECT y, x FROM polygons WHERE polygon_id = 11 AND pos < 3) SELECT min(polygon_id) AS polygon_id FROM (SELECT polygon_id FROM polygons JOIN p USING (y, x) GROUP BY 1 HAVING count(*) = 3)")


def _folded(s: SparkSession, d: str) -> DataFrame:
    """The mesh of quads with every fifth one twice."""
    q = fixtures.quads(s, d)
    return q.unionByName(q.where("polygon_id % 5 = 0").withColumn("polygon_id", -F.col("polygon_id") - 1))


register("mesh_fold_faults", lambda s, d: mesh.fold_faults(_folded(s, d)), f"WITH {QUADS.replace('polygons AS', 'once AS')}, polygons AS (SELECT * FROM once UNION ALL SELECT -polygon_id - 1, pos, y, x FROM once WHERE polygon_id % 5 = 0){MESH} SELECT * FROM edges WHERE degree > 2")
register("jacobi_smooth_step", lambda s, d: mesh.jacobi_step(fixtures.quads(s, d)).select("vertex_id", F.round("y", 6).alias("y"), F.round("x", 6).alias("x")), f"WITH {QUADS}{MESH}, b AS (SELECT v_lo AS v, v_hi AS o, degree FROM edges UNION ALL SELECT v_hi, v_lo, degree FROM edges) SELECT m.vertex_id, round(CASE WHEN min(degree) > 1 THEN avg(n.y) ELSE m.y::DOUBLE END, 6) AS y, round(CASE WHEN min(degree) > 1 THEN avg(n.x) ELSE m.x::DOUBLE END, 6) AS x FROM b JOIN vertices m ON m.vertex_id = v JOIN vertices n ON n.vertex_id = o GROUP BY m.vertex_id, m.y, m.x")
register("mesh_smooth", lambda s, d: mesh.smooth(fixtures.quads(s, d).withColumn("group_id", F.floor(F.col("polygon_id") / 500).cast("int"))))

# --- sets and order ----------------------------------------------------------------------------------------------------

register("sorted_distinct", lambda s, d: sets.sorted_distinct(fixtures.quads(s, d).withColumn("k", F.col("polygon_id") % 7), ["k"]), f"WITH {QUADS} SELECT k, y, x, CAST(row_number() OVER (PARTITION BY k ORDER BY y, x) - 1 AS INT) AS rank FROM (SELECT DISTINCT polygon_id % 7 AS k, y, x FROM polygons)")
register("walk_start", lambda s, d: sets.middle(fixtures.polygons(s, d), ["polygon_id"]), f"WITH {POLYGONS} SELECT polygon_id, y, x FROM (SELECT polygon_id, y, x, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY polygon_id) AS n FROM (SELECT DISTINCT polygon_id, y, x FROM polygons) WINDOW w AS (PARTITION BY polygon_id ORDER BY y, x)) WHERE r = n // 2")
register("reverse_prefix", lambda s, d: sets.reverse_prefix(fixtures.polygons(s, d), ["polygon_id"], 3), f"WITH {POLYGONS} SELECT polygon_id, CASE WHEN pos <= 3 THEN 3 - pos ELSE pos END AS pos, y, x FROM polygons")
_A, _B = "SELECT image_id, y, x FROM grid WHERE value = 600", "SELECT image_id, y, x FROM grid WHERE y > 15"
_SET = lambda f: lambda s, d: f(grid(s, d).where("value = 600").select("image_id", "y", "x"), grid(s, d).where("y > 15").select("image_id", "y", "x"))
register("points_union_all", _SET(sets.union), f"WITH {GRID} {_A} UNION ALL {_B}")
register("points_except", _SET(lambda a, b: sets.minus(a, b, ["image_id", "y", "x"])), f"WITH {GRID} {_A} EXCEPT {_B}")
register("points_intersect", _SET(lambda a, b: sets.common(a, b, ["image_id", "y", "x"])), f"WITH {GRID} {_A} INTERSECT {_B}")
register("symmetric_edges", lambda s, d: sets.symmetric(mesh.edges(fixtures.quads(s, d)).select(F.col("v_lo").alias("a"), F.col("v_hi").alias("b"))), f"WITH {QUADS}{MESH} SELECT v_lo AS a, v_hi AS b FROM edges UNION SELECT v_hi, v_lo FROM edges")


from pixelweft import catalog_points  # noqa: E402, F401  registers its queries


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
