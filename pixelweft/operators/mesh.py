"""Meshes from polygons: vertices, edges, incidence, smoothing, triangles to quads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.schema import dealt

from .polygon import edges as polygon_edges

#: Bits of a pixel in which edges are halved while triangles become quads.
FRACTION = 20


def rank_bucketed(rows: DataFrame, order: list[str], out: str, bucket: str, width: int = 64, kind: str = "int") -> DataFrame:
    """Numbers distinct rows from 0 in the given order, whose first column is `bucket`.

    Buckets of `width` values are numbered on their own and then moved by the sizes of those before. kind: "long" for
    tables that may have more than two billion rows.
    """
    rows = rows.withColumn("__b", F.floor(F.col(bucket) / width))
    sizes = rows.groupBy("__b").count()
    before = sizes.withColumn("__off", F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inner = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1)
    return inner.join(dealt(before), "__b").withColumn(out, (F.col("__off") + F.col("__r")).cast(kind)).drop("__b", "__r", "__off")


def vertices(polygons: DataFrame) -> DataFrame:
    """(vertex_id, y, x): distinct corners, numbered by (y, x)."""
    return rank_bucketed(polygons.select("y", "x").distinct(), ["y", "x"], "vertex_id", "y").select("vertex_id", "y", "x")


def polygon_vertices(polygons: DataFrame, v: DataFrame) -> DataFrame:
    """(polygon_id, pos, vertex_id): -1 for a point that the table of vertices doesn't have."""
    from .points import code_of

    return code_of(polygons, v).select("polygon_id", "pos", "vertex_id")


def polygon_edges_by_id(polygons: DataFrame, v: DataFrame) -> DataFrame:
    """(polygon_id, pos, v_lo, v_hi): the edge that begins at each corner."""
    e = polygon_edges(polygons)
    e = e.join(dealt(v.select(F.col("vertex_id").alias("a"), F.col("y").alias("y0"), F.col("x").alias("x0"))), ["y0", "x0"])
    e = e.join(dealt(v.select(F.col("vertex_id").alias("b"), F.col("y").alias("y1"), F.col("x").alias("x1"))), ["y1", "x1"])
    return e.select("polygon_id", "pos", F.least("a", "b").alias("v_lo"), F.greatest("a", "b").alias("v_hi"))


def edges(polygons: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(edge_id, v_lo, v_hi, degree): numbered by (v_hi, v_lo); degree: polygons that have it."""
    e = polygon_edges_by_id(polygons, vertices(polygons) if v is None else v)
    d = e.groupBy("v_lo", "v_hi").agg(F.countDistinct("polygon_id").cast("int").alias("degree"))
    return rank_bucketed(d, ["v_hi", "v_lo"], "edge_id", "v_hi").select("edge_id", "v_lo", "v_hi", "degree")


def incidence(polygons: DataFrame) -> DataFrame:
    """(polygon_id, pos, edge_id, degree)."""
    v = vertices(polygons)
    return polygon_edges_by_id(polygons, v).join(dealt(edges(polygons, v)), ["v_lo", "v_hi"]).select("polygon_id", "pos", "edge_id", "degree")


def void_polygons(polygons: DataFrame) -> DataFrame:
    """(polygon_id, triangle, void_border): polygons with an edge that no other one has; their number of corners is three."""
    return incidence(polygons).groupBy("polygon_id").agg((F.count(F.lit(1)) == 3).alias("triangle"), (F.min("degree") == 1).alias("void_border"))


def neighbors(polygons: DataFrame) -> DataFrame:
    """(polygon_id, pos, neighbor_id): across each edge, null at the rim."""
    i = incidence(polygons)
    other = i.select("edge_id", F.col("polygon_id").alias("neighbor_id"))
    both = i.join(dealt(other), "edge_id").where("polygon_id <> neighbor_id").select("polygon_id", "pos", "neighbor_id")
    return i.select("polygon_id", "pos").join(dealt(both), ["polygon_id", "pos"], "left")


def containing(polygons: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """The first polygon that has all n points (y, x)."""
    hit = polygons.join(points, ["y", "x"]).groupBy("polygon_id").agg(F.countDistinct("y", "x").alias("k")).where(F.col("k") == n)
    return hit.agg(F.min("polygon_id").alias("polygon_id"))


def owners(polygons: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v_lo, v_hi, edge_id, polygon_id, pos): edge and first polygon of pairs (a, b) of vertices, -1 if there is none."""
    v = vertices(polygons)
    first = polygon_edges_by_id(polygons, v).groupBy("v_lo", "v_hi").agg(F.min(F.struct("polygon_id", "pos")).alias("f"))
    known = edges(polygons, v).join(first, ["v_lo", "v_hi"]).select("v_lo", "v_hi", "edge_id", "f.polygon_id", "f.pos")
    asked = pairs.select(F.least("a", "b").alias("v_lo"), F.greatest("a", "b").alias("v_hi")).distinct()
    return asked.join(known, ["v_lo", "v_hi"], "left").select("v_lo", "v_hi", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("edge_id", "polygon_id", "pos")])


def replaced(polygons: DataFrame, new: DataFrame) -> DataFrame:
    """The mesh after an edit: polygons (polygon_id, pos, y, x) with the polygons named in `new` (of, part, pos, y, x)
    taken out and its pieces put in, all numbered anew by (polygon, part). Vertices and edges follow by `vertices` and
    `edges`, which number what is there."""
    left = polygons.join(new.select(F.col("of").alias("polygon_id")).distinct(), "polygon_id", "left_anti").select(F.col("polygon_id").alias("of"), F.lit(0).alias("part"), "pos", "y", "x")
    both = left.unionByName(new.select("of", "part", "pos", "y", "x"))
    ids = rank_bucketed(both.select("of", "part").distinct(), ["of", "part"], "polygon_id", "of")
    return both.join(ids, ["of", "part"]).select("polygon_id", "pos", "y", "x")


def quad_strip_cut(quads: DataFrame, a: int, b: int) -> DataFrame:
    """(polygon_id, part, pos, y, x): quads (polygon_id, pos, y, x) cut along a way that enters by edge a and leaves by
    edge b, edge k being the one from corner k: opposite edges leave two quads, adjacent ones three around the centre.

    Middles and centres are cut down to whole numbers.
    """
    at = {k: (F.max(F.when(F.col("pos") == k, F.col("y"))), F.max(F.when(F.col("pos") == k, F.col("x")))) for k in range(4)}
    wide = quads.groupBy("polygon_id").agg(*[e.alias(f"{c}{k}") for k, own in at.items() for c, e in zip("yx", own, strict=True)])
    corner = lambda k: tuple(F.col(f"{c}{k % 4}") for c in "yx")
    middle = lambda k: tuple(F.floor((F.col(f"{c}{k % 4}") + F.col(f"{c}{(k + 1) % 4}")) / 2) for c in "yx")
    centre = tuple(F.floor(sum((F.col(f"{c}{k}") for k in range(1, 4)), F.col(f"{c}0")) / 4) for c in "yx")
    if (b - a) % 4 == 2:
        pieces = [[middle(a), corner(a + 1), corner(a + 2), middle(b)], [middle(b), corner(b + 1), corner(b + 2), middle(a)]]
    else:
        a = a if (b - a) % 4 == 1 else b
        pieces = [[middle(a), corner(a + 1), middle(a + 1), centre], [middle(a + 1), corner(a + 2), corner(a + 3), centre], [centre, corner(a + 3), corner(a), middle(a)]]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(k).alias("pos"), y.cast("int").alias("y"), x.cast("int").alias("x")) for i, p in enumerate(pieces) for k, (y, x) in enumerate(p)]))
    return wide.select("polygon_id", each.alias("p")).select("polygon_id", "p.*")


def displacements(polygons: DataFrame) -> DataFrame:
    """(mean, largest): squared moves of one `jacobi_step`, their sum over all vertices' number, and the largest."""
    v = vertices(polygons).select("vertex_id", F.col("y").alias("y0"), F.col("x").alias("x0"))
    moved = jacobi_step(polygons).join(v, "vertex_id")
    d2 = (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0")) + (F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0"))
    return moved.agg((F.sum(d2) / F.count(F.lit(1))).alias("mean"), F.max(d2).alias("largest"))


def gathered(parts: DataFrame, group: str) -> DataFrame:
    """(group, n, polygons): the polygons of each group, by id, as text."""
    held = F.array_sort(F.collect_set("polygon_id"))
    return parts.groupBy(group).agg(F.countDistinct("polygon_id").alias("n"), F.concat_ws(",", F.transform(held, lambda p: p.cast("string"))).alias("polygons"))


def fold_faults(polygons: DataFrame) -> DataFrame:
    """Edges that more than two polygons have: none in a proper mesh."""
    return edges(polygons).where("degree > 2")


def jacobi_step(polygons: DataFrame) -> DataFrame:
    """(vertex_id, y, x): every vertex whose edges all have two polygons moves to the mean of its neighbours."""
    v = vertices(polygons)
    e = edges(polygons, v)
    both = e.select(F.col("v_lo").alias("vertex_id"), F.col("v_hi").alias("other"), "degree").unionByName(e.select(F.col("v_hi").alias("vertex_id"), F.col("v_lo").alias("other"), "degree"))
    at = v.select(F.col("vertex_id").alias("other"), F.col("y").alias("oy"), F.col("x").alias("ox"))
    mean = both.join(at, "other").groupBy("vertex_id").agg(F.min("degree").alias("least"), F.sum("oy").alias("sy"), F.sum("ox").alias("sx"), F.count(F.lit(1)).alias("k"))
    free = F.col("least") > 1
    return v.join(mean, "vertex_id").select("vertex_id", F.when(free, F.col("sy") / F.col("k")).otherwise(F.col("y").cast("double")).alias("y"), F.when(free, F.col("sx") / F.col("k")).otherwise(F.col("x").cast("double")).alias("x"))


def smooth_points(polygons: list[list[tuple[int, int]]], ratio: float = 0.05, most: int = 1000) -> dict[tuple[int, int], tuple[int, int]]:
    """Moves inner vertices in the order of their coordinates, in place and in 32-bit floats, each to the mean of its
    neighbours, until the largest squared move is at most `ratio` times the first mean one; cuts to whole numbers."""
    points = sorted({p for poly in polygons for p in poly})
    ids = {p: i for i, p in enumerate(points)}
    owners: dict[tuple[int, int], set[int]] = {}
    for k, poly in enumerate(polygons):
        for a, b in zip(poly, [*poly[1:], poly[0]], strict=True):
            e = tuple(sorted((ids[a], ids[b])))
            owners.setdefault(e, set()).add(k)
    near: list[list[int]] = [[] for _ in points]
    free = [True] * len(points)
    for (a, b), who in sorted(owners.items(), key=lambda x: (x[0][1], x[0][0])):
        near[a].append(b)
        near[b].append(a)
        if len(who) < 2:
            free[a] = free[b] = False
    at = np.array(points, np.float32)

    def sweep() -> list[float]:
        moved = [0.0] * len(points)
        for i in range(len(points)):
            if free[i] and near[i]:
                new = at[near[i]].sum(axis=0, dtype=np.float32) / np.float32(len(near[i]))
                moved[i] = float(((at[i] - new) ** 2).sum())
                at[i] = new
        return moved

    first = sweep()
    goal = ratio * sum(first) / max(1, len(points))
    largest = max(first, default=0.0)
    for _ in range(most):
        if largest <= goal:
            break
        largest = max(sweep(), default=0.0)
    return {p: (int(at[i][0]), int(at[i][1])) for p, i in ids.items()}


def smooth(polygons: DataFrame, group: str = "group_id", ratio: float = 0.05) -> DataFrame:
    """(group, polygon_id, pos, y, x) after smoothing each group's mesh in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["polygon_id", "pos"], ignore_index=True)
        polys = [list(zip(g.y.tolist(), g.x.tolist(), strict=True)) for _, g in rows.groupby("polygon_id")]
        to = smooth_points(polys, ratio)
        moved = [to[p] for p in zip(rows.y.tolist(), rows.x.tolist(), strict=True)]
        rows["y"], rows["x"] = [p[0] for p in moved], [p[1] for p in moved]
        return rows[[group, "polygon_id", "pos", "y", "x"]]

    kinds = {f.name: f.dataType.simpleString() for f in polygons.schema}
    return polygons.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, polygon_id {kinds['polygon_id']}, pos int, y int, x int")


def _middle(p: tuple[int, int], q: tuple[int, int]) -> tuple[int, int]:
    return ((p[0] + q[0]) // 2, (p[1] + q[1]) // 2)


def triangles_to_quads(polygons: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Turns a mesh of triangles and quads into quads: see `owned_quads`."""
    return [p for _, p in owned_quads(polygons)]


def owned_quads(polygons: list[list[tuple[int, int]]]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Turns a mesh of triangles and quads into quads, each with the place of the polygon that it is a part of.

    A triangle at the rim gets the middle of its rim edge as a corner. From every triangle left a search spreads, one
    layer at a time, over shared edges; the first that meets another triangle or the rim is cut along: quads on the
    way split at the middles of the edges that the way crosses, two opposite ones into two, two adjacent ones into
    three around their centre; the ends take up the middle of the edge they are entered by.
    """
    polys = {k: list(p) for k, p in enumerate(polygons)}
    owner = {k: k for k in polys}
    own: dict[tuple, list[int]] = {}

    def edges_of(p: list) -> list[tuple]:
        return [(min(a, b), max(a, b)) for a, b in zip(p, [*p[1:], p[0]], strict=True)]

    def enter(k: int) -> None:
        for e in edges_of(polys[k]):
            own.setdefault(e, []).append(k)

    def leave(k: int) -> None:
        for e in edges_of(polys[k]):
            own[e].remove(k)

    for k in polys:
        enter(k)
    for k, p in list(polys.items()):
        if len(p) == 3:
            for i, e in enumerate(edges_of(p)):
                if len(own[e]) == 1:
                    leave(k)
                    polys[k] = [*p[: i + 1], _middle(*e), *p[i + 1 :]]
                    enter(k)
                    break
    while any(len(p) == 3 for p in polys.values()):
        fronts = {k: {k: (None, None)} for k, p in polys.items() if len(p) == 3}
        layer = {k: [k] for k in fronts}
        found = None
        while found is None and any(layer.values()):
            for t in fronts:
                nxt = []
                for k in layer[t]:
                    for e in edges_of(polys[k]):
                        if len(own[e]) == 1 and k != t and len(polys[k]) == 4:
                            found = (t, k, e)
                            break
                        for m in own[e]:
                            if m not in fronts[t]:
                                fronts[t][m] = (k, e)
                                nxt.append(m)
                                if len(polys[m]) == 3:
                                    found = (t, m, None)
                    if found:
                        break
                layer[t] = nxt
                if found:
                    break
        if found is None:
            break
        t, k, rim = found
        way = []
        out = rim
        while k is not None:
            back, entry = fronts[t][k]
            way.append((k, entry, out))
            k, out = back, entry
        for k, a, b in way:
            new = _split(polys[k], [e for e in (a, b) if e])
            leave(k)
            del polys[k]
            for p in new:
                m = len(owner)
                polys[m], owner[m] = p, owner[k]
                enter(m)
    return [(owner[k], p) for k, p in polys.items()]


def quads_of_pieces(pieces: list[list[tuple[int, int]]], ratio: float = 0.05) -> list[tuple[int, list[tuple[int, int]]]]:
    """Smooths one mesh of pieces of at most four corners and turns it into quads, each with the place of its piece.

    Corners that smoothing has put on one point are one corner; pieces of less than three have no area and go. Halving
    counts in parts of a pixel, so short edges don't vanish, and is cut to whole numbers at the end. A triangle that
    nothing reaches gets the middle of its first edge as a corner.
    """
    to = smooth_points(pieces, ratio)
    kept = []
    for i, p in enumerate(pieces):
        q = [to[c] for c in p]
        q = [c for c, before in zip(q, [q[-1], *q[:-1]], strict=True) if c != before]
        if len(set(q)) > 2 and len(set(q)) == len(q):
            kept.append((i, [(y << FRACTION, x << FRACTION) for y, x in q]))
    out = []
    for k, p in owned_quads([p for _, p in kept]):
        p = p if len(p) != 3 else [p[0], _middle(p[0], p[1]), *p[1:]]
        out.append((kept[k][0], [(y >> FRACTION, x >> FRACTION) for y, x in p]))
    return out


def quad_mesh(parts: DataFrame, group: str, ratio: float = 0.05) -> DataFrame:
    """(group, polygon_id, part, pos, y, x): quads of all the pieces (group, polygon_id, part, pos, y, x), numbered anew
    in each polygon. A group is one mesh, worked through in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["polygon_id", "part", "pos"], ignore_index=True)
        names, pieces = [], []
        for (key, _), g in rows.groupby(["polygon_id", "part"], sort=False):
            names.append(key)
            pieces.append(list(zip(g.y.tolist(), g.x.tolist(), strict=True)))
        numbers: dict = {}
        out = []
        for k, q in quads_of_pieces(pieces, ratio):
            part = numbers[names[k]] = numbers.get(names[k], -1) + 1
            out += [(rows[group].iloc[0], names[k], part, i, y, x) for i, (y, x) in enumerate(q)]
        return pd.DataFrame(out, columns=[group, "polygon_id", "part", "pos", "y", "x"])

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    return parts.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, polygon_id {kinds['polygon_id']}, part int, pos int, y int, x int")


def _split(p: list, cuts: list[tuple]) -> list[list]:
    """A polygon with middles on the edges that are cut, in pieces of four corners where it can be."""
    marked, at = [], []
    for a, b in zip(p, [*p[1:], p[0]], strict=True):
        marked.append(a)
        if (min(a, b), max(a, b)) in cuts:
            at.append(len(marked))
            marked.append(_middle(a, b))
    if len(marked) <= 4 or len(at) < 2:
        return [marked]
    i, j = at
    n = len(marked)
    if n == 6 and j - i == 3:
        return [[marked[(i + k) % n] for k in range(4)], [marked[(j + k) % n] for k in range(4)]]
    if j - i != 2:
        i, j = j, i
    corner = marked[(i + 1) % n]
    centre = (sum(v[0] for v in p) // len(p), sum(v[1] for v in p) // len(p))
    m1, m2 = marked[i], marked[j % n]
    rest = [marked[(j + k) % n] for k in range(1, n - 2)]
    return [[m1, corner, m2, centre], [m2, rest[0], rest[1], centre], [centre, rest[1], rest[-1], m1]]
