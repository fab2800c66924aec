"""Polygons (polygon_id, pos, y, x), closed by the edge from the last point to the first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.schema import dealt

from .polyline import rasterize


def with_neighbors(polygons: DataFrame) -> DataFrame:
    """Adds py, px and ny, nx: the points before and after, around the end."""
    w = Window.partitionBy("polygon_id").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda c, f, end: F.coalesce(f(c).over(w), end(c).over(whole))
    return polygons.select("polygon_id", "pos", "y", "x", at("y", F.lag, F.last).alias("py"), at("x", F.lag, F.last).alias("px"), at("y", F.lead, F.first).alias("ny"), at("x", F.lead, F.first).alias("nx"))


def _norm(dy: Column, dx: Column) -> Column:
    n = F.sqrt((dy * dy + dx * dx).cast("double"))
    return F.when(n > 0, n)


def corner_cross(polygons: DataFrame) -> DataFrame:
    """(polygon_id, pos, z): cross product of the unit edges that meet at a corner; null at a repeated point."""
    p = with_neighbors(polygons)
    ay, ax, by, bx = F.col("y") - F.col("py"), F.col("x") - F.col("px"), F.col("ny") - F.col("y"), F.col("nx") - F.col("x")
    return p.select("polygon_id", "pos", ((ay * bx - ax * by) / (_norm(ay, ax) * _norm(by, bx))).alias("z"))


def ideal_cuts(polygons: DataFrame) -> DataFrame:
    """(polygon_id, pos, cy, cx): direction of the bisector; null at straight corners."""
    p = with_neighbors(polygons)
    ay, ax, by, bx = F.col("y") - F.col("py"), F.col("x") - F.col("px"), F.col("y") - F.col("ny"), F.col("x") - F.col("nx")
    p = p.withColumn("sy", (ay / _norm(ay, ax) + by / _norm(by, bx)) / 2).withColumn("sx", (ax / _norm(ay, ax) + bx / _norm(by, bx)) / 2)
    n = F.sqrt(F.col("sy") * F.col("sy") + F.col("sx") * F.col("sx"))
    return p.select("polygon_id", "pos", F.when(n > 1e-9, F.col("sy") / n).alias("cy"), F.when(n > 1e-9, F.col("sx") / n).alias("cx"))


def measures(polygons: DataFrame) -> DataFrame:
    """(polygon_id, n, area2, ratio, box, up, down, convex, valid): double signed area, longest to shortest edge,
    corners by the sign of their turn, all turns of one sign, more than two points and none twice."""
    p = with_neighbors(polygons)
    ay, ax, by, bx = F.col("y") - F.col("py"), F.col("x") - F.col("px"), F.col("ny") - F.col("y"), F.col("nx") - F.col("x")
    turn, edge = ay * bx - ax * by, by * by + bx * bx
    out = p.groupBy("polygon_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).alias("area2"),
        F.max(edge).alias("long2"),
        F.min(edge).alias("short2"),
        F.min("y").alias("y_min"),
        F.min("x").alias("x_min"),
        F.max("y").alias("y_max"),
        F.max("x").alias("x_max"),
        F.sum((turn > 0).cast("int")).alias("up"),
        F.sum((turn <= 0).cast("int")).alias("down"),
        F.countDistinct("y", "x").alias("points"),
    )
    ratio = F.when(F.col("short2") > 0, F.sqrt(F.col("long2") / F.col("short2")))
    return out.select("polygon_id", "n", "area2", ratio.alias("ratio"), "y_min", "x_min", "y_max", "x_max", "up", "down", ((F.col("up") == 0) | (F.col("down") == 0)).alias("convex"), ((F.col("n") > 2) & (F.col("points") == F.col("n"))).alias("valid"))


def edges(polygons: DataFrame) -> DataFrame:
    return with_neighbors(polygons).select("polygon_id", "pos", F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("ny").alias("y1"), F.col("nx").alias("x1"))


def outlines(polygons: DataFrame) -> DataFrame:
    """(polygon_id, y, x): distinct pixels of the outlines."""
    return rasterize(edges(polygons), ["polygon_id"]).select("polygon_id", "y", "x").distinct()


def candidate_cuts(polygons: DataFrame) -> DataFrame:
    """(polygon_id, a, b, y0, x0, y1, x1) for pairs of corners that aren't neighbours, a < b."""
    n = polygons.groupBy("polygon_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    a = polygons.select("polygon_id", F.col("pos").alias("a"), F.col("y").alias("y0"), F.col("x").alias("x0"))
    b = polygons.select("polygon_id", F.col("pos").alias("b"), F.col("y").alias("y1"), F.col("x").alias("x1"))
    return a.join(dealt(b), "polygon_id").join(dealt(n), "polygon_id").where("b - a > 1 AND b - a < n - 1").drop("n")


def crossing(cuts: DataFrame, polygons: DataFrame) -> DataFrame:
    """Cuts with the number of edges that they properly cross."""
    e = edges(polygons).select("polygon_id", F.col("y0").alias("ey"), F.col("x0").alias("ex"), F.col("y1").alias("fy"), F.col("x1").alias("fx"))
    turn = lambda ay, ax, by, bx, cy, cx: (F.col(by) - F.col(ay)) * (F.col(cx) - F.col(ax)) - (F.col(bx) - F.col(ax)) * (F.col(cy) - F.col(ay))
    s = lambda *names: F.signum(turn(*names).cast("double"))
    hit = (s("y0", "x0", "y1", "x1", "ey", "ex") * s("y0", "x0", "y1", "x1", "fy", "fx") < 0) & (s("ey", "ex", "fy", "fx", "y0", "x0") * s("ey", "ex", "fy", "fx", "y1", "x1") < 0)
    return cuts.join(dealt(e), "polygon_id").groupBy("polygon_id", "a", "b").agg(F.sum(hit.cast("int")).alias("crossings"))


def middle_inside(cuts: DataFrame, polygons: DataFrame) -> DataFrame:
    """(polygon_id, a, b, inside): whether the middle of a cut lies inside, by even-odd crossings of a ray.

    Coordinates are doubled, so middles are whole numbers and no edge case depends on rounding.
    """
    e = edges(polygons).select("polygon_id", (2 * F.col("y0")).alias("ey"), (2 * F.col("x0")).alias("ex"), (2 * F.col("y1")).alias("fy"), (2 * F.col("x1")).alias("fx"))
    c = cuts.select("polygon_id", "a", "b", (F.col("y0") + F.col("y1")).alias("my"), (F.col("x0") + F.col("x1")).alias("mx"))
    spans = (F.col("ey") > F.col("my")) != (F.col("fy") > F.col("my"))
    side = (F.col("mx") - F.col("ex")) * (F.col("fy") - F.col("ey")) - (F.col("fx") - F.col("ex")) * (F.col("my") - F.col("ey"))
    hit = spans & F.when(F.col("fy") > F.col("ey"), side < 0).otherwise(side > 0)
    return c.join(dealt(e), "polygon_id").groupBy("polygon_id", "a", "b").agg((F.sum(hit.cast("int")) % 2 == 1).alias("inside"))


def cut_scores(polygons: DataFrame) -> DataFrame:
    """(polygon_id, a, b, score, rank): for cuts from corner a to b, distance x (1 - dot(bisector, direction)), least first."""
    both = candidate_cuts(polygons)
    both = both.unionByName(both.select("polygon_id", F.col("b").alias("a"), F.col("a").alias("b"), F.col("y1").alias("y0"), F.col("x1").alias("x0"), F.col("y0").alias("y1"), F.col("x0").alias("x1")))
    dy, dx = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    d = F.sqrt((dy * dy + dx * dx).cast("double"))
    s = both.join(dealt(ideal_cuts(polygons).withColumnRenamed("pos", "a")), ["polygon_id", "a"]).where("cy IS NOT NULL")
    s = s.withColumn("score", F.round(d * (1 - (F.col("cy") * dy + F.col("cx") * dx) / F.when(d > 0, d)), 6)).where("score IS NOT NULL")
    return s.select("polygon_id", "a", "b", "score", F.row_number().over(Window.partitionBy("polygon_id", "a").orderBy("score", "b")).alias("rank"))


def cut(points: list, a: int, b: int) -> tuple[list, list]:
    """Both halves of a polygon cut from a to b; each keeps both ends."""
    n = len(points)
    turned = points[a % n :] + points[: a % n]
    k = (b - a) % n
    return turned[: k + 1], turned[k:] + turned[:1]


def _bisectors(p: np.ndarray) -> np.ndarray:
    a, b = p - np.roll(p, 1, axis=0), p - np.roll(p, -1, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = (a / np.hypot(*a.T)[:, None] + b / np.hypot(*b.T)[:, None]) / 2
        return m / np.hypot(*m.T)[:, None]


def _inward(p: np.ndarray) -> np.ndarray:
    """Unit vectors that halve the corners, toward the inside of a convex ring; at a straight corner the normal."""
    before, after = np.roll(p, 1, axis=0) - p, np.roll(p, -1, axis=0) - p
    unit = lambda v: v / np.maximum(np.hypot(*v.T), 1e-12)[:, None]
    half = unit(before) + unit(after)
    side = np.sign((after[:, 0] * before[:, 1] - after[:, 1] * before[:, 0]).sum()) or 1.0
    normal = side * unit(after)[:, ::-1] * [-1.0, 1.0]
    return unit(np.where((np.hypot(*half.T) < 1e-9)[:, None], normal, half))


def peel_quads(points: list) -> list[list]:
    """Pieces of at most four corners of a convex ring of corners.

    While more than four are left, the corner whose inward direction points best along the line from the third corner
    before it gives a quad with the three corners after it; the two in the middle of those leave the ring.
    """
    p = np.array(points, float)
    ring, out = np.arange(len(points)), []
    while len(ring) > 4:
        q = p[ring]
        toward = q - q[np.arange(len(ring)) - 3]
        fit = np.einsum("ij,ij->i", _inward(q), toward) / np.maximum(np.hypot(*toward.T), 1e-12)
        four = (int(np.argmax(np.round(fit, 9))) + np.arange(4)) % len(ring)
        out.append([points[k] for k in ring[four]])
        ring = np.delete(ring, four[1:3])
    return [*out, [points[k] for k in ring]]


def _turns(p: np.ndarray) -> np.ndarray:
    a, b = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def _proper(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> bool:
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    return bool(side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0)


def _contains(p: np.ndarray, m: np.ndarray) -> bool:
    inside = False
    for a, b in zip(p, np.roll(p, -1, axis=0), strict=True):
        if (a[0] > m[0]) != (b[0] > m[0]) and m[1] < (b[1] - a[1]) * (m[0] - a[0]) / (b[0] - a[0]) + a[1]:
            inside = not inside
    return inside


def convex_parts(points: list, ratio: float = 3.0, halved: dict | None = None) -> list[list]:
    """Convex pieces of a simple polygon.

    Corners whose turn has the rarer sign are concave. Cuts from a concave corner are tried by score, those to another
    concave corner first; one that crosses no edge and has its middle inside is taken. Without one, the longest edge
    is halved if it is `ratio` times the shortest, and the cuts are tried again; without any the piece stays. `halved`
    collects the middle of each edge that was halved, by its two ends.
    """
    todo, out = [list(points)], []
    while todo:
        p = todo.pop()
        q = np.array(p, float)
        z = _turns(q)
        if len(p) < 4 or (z > 0).all() or (z <= 0).all():
            out.append(p)
            continue
        up = int((z > 0).sum())
        concave = z > 0 if up * 2 < len(p) else z <= 0
        bis, n, found = _bisectors(q), len(p), None
        order = []
        for i in np.flatnonzero(concave):
            for j in range(n):
                if (j - i) % n in (0, 1, n - 1):
                    continue
                d = q[j] - q[i]
                far = float(np.hypot(*d))
                dot = float(np.nan_to_num(bis[i] @ d / far)) if far else 0.0
                order.append((not concave[j], far * (1 - dot), int(i), j))
        for _, _, i, j in sorted(order):
            clear = not any(_proper(q[i], q[j], q[k], q[(k + 1) % n]) for k in range(n) if len({i, j, k, (k + 1) % n}) == 4)
            if clear and _contains(q, (q[i] + q[j]) / 2):
                found = cut(p, i, j)
                break
        if found:
            todo += found
            continue
        edge = np.hypot(*(np.roll(q, -1, axis=0) - q).T)
        k = int(np.argmax(edge))
        mid = tuple(int(v) for v in (q[k] + q[(k + 1) % n]) // 2)
        if edge[k] > ratio * max(edge.min(), 1e-9) and mid not in p:
            todo.append([*p[: k + 1], mid, *p[k + 1 :]])
            if halved is not None:
                halved[frozenset((p[k], p[(k + 1) % n]))] = mid
        else:
            out.append(p)
    return out


def with_middles(points: list, halved: dict) -> list:
    """A polygon with the middles of those of its edges that were halved, and of their halves."""
    out = []
    for a, b in zip(points, [*points[1:], *points[:1]], strict=True):
        out.append(a)
        inner = [(a, b)]
        while inner:
            p, q = inner.pop()
            mid = halved.get(frozenset((p, q)))
            if mid is None or mid in (p, q):
                if q != b:
                    out.append(q)
            else:
                inner += [(mid, q), (p, mid)]
    return out


def partition(polygons: DataFrame, into: str = "quads", ratio: float = 3.0) -> DataFrame:
    """(polygon_id, part, pos, y, x): convex parts, or convex parts peeled to at most four corners.

    Polygons are independent: each becomes one array of corners, and a task works through batches of them.
    """
    whole = polygons.groupBy("polygon_id").agg(F.array_sort(F.collect_list(F.struct("pos", "y", "x"))).alias("p"))

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in source:
            out = []
            for key, corners in zip(rows.polygon_id, rows.p, strict=True):
                parts = convex_parts([(c["y"], c["x"]) for c in corners], ratio)
                if into == "quads":
                    parts = [q for p in parts for q in peel_quads(p)]
                out += [(key, k, i, int(y), int(x)) for k, p in enumerate(parts) for i, (y, x) in enumerate(p)]
            yield pd.DataFrame(out, columns=["polygon_id", "part", "pos", "y", "x"])

    return whole.mapInPandas(run, f"polygon_id {polygons.schema['polygon_id'].dataType.simpleString()}, part int, pos int, y int, x int")


def mesh_partition(polygons: DataFrame, group: str, ratio: float = 3.0) -> DataFrame:
    """(group, polygon_id, part, pos, y, x): pieces of at most four corners of the polygons of each group's mesh.

    As `partition`, but an edge that is halved in one polygon gets its middle in all that share it, so that the pieces
    still meet edge to edge. A group is one mesh, worked through in one task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        halved: dict = {}
        cut_up = []
        for key, own in rows.sort_values(["polygon_id", "pos"]).groupby("polygon_id", sort=False):
            cut_up += [(key, p) for p in convex_parts(list(zip(own.y.tolist(), own.x.tolist(), strict=True)), ratio, halved)]
        numbers: dict = {}
        out = []
        for key, p in cut_up:
            for q in peel_quads(with_middles(p, halved)):
                part = numbers[key] = numbers.get(key, -1) + 1
                out += [(rows[group].iloc[0], key, part, i, int(y), int(x)) for i, (y, x) in enumerate(q)]
        return pd.DataFrame(out, columns=[group, "polygon_id", "part", "pos", "y", "x"])

    kinds = {f.name: f.dataType.simpleString() for f in polygons.schema}
    return polygons.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, polygon_id {kinds['polygon_id']}, part int, pos int, y int, x int")


def cut_all(polygons: DataFrame, cuts: DataFrame) -> DataFrame:
    """(polygon_id, half, pos, y, x): both halves of polygons cut from corner a to corner b (polygon_id, a, b), numbered
    from the corner that each begins at; both keep the two ends."""
    n = polygons.groupBy("polygon_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = polygons.join(cuts, "polygon_id").join(n, "polygon_id").withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    begin, end = F.when(F.col("half") == 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("half") == 0, F.col("b")).otherwise(F.col("a"))
    place = F.pmod(F.col("pos") - begin, F.col("n"))
    return rows.where(place <= F.pmod(end - begin, F.col("n"))).select("polygon_id", "half", place.cast("int").alias("pos"), "y", "x")


def cut_order(polygons: DataFrame) -> DataFrame:
    """(polygon_id, a, b, even, nested, place): the order in which cuts are tried.

    nested: by how concave the corner is that a cut begins at, then by the cut's rank among those of its corner. place:
    cuts that leave halves with even numbers of corners first, each in the nested order.
    """
    n = polygons.groupBy("polygon_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    z = corner_cross(polygons).select("polygon_id", F.col("pos").alias("a"), F.round("z", 6).alias("z"))
    c = cut_scores(polygons).join(dealt(z), ["polygon_id", "a"]).join(dealt(n), "polygon_id")
    k = F.pmod(F.col("b") - F.col("a"), F.col("n"))
    c = c.withColumn("even", ((k + 1) % 2 == 0) & ((F.col("n") - k + 1) % 2 == 0))
    w = Window.partitionBy("polygon_id")
    c = c.withColumn("nested", (F.row_number().over(w.orderBy("z", "a", "rank")) - 1).cast("int"))
    return c.select("polygon_id", "a", "b", "even", "nested", (F.row_number().over(w.orderBy(F.desc("even"), "nested")) - 1).cast("int").alias("place"))


def paired_crossing(pairs: DataFrame) -> DataFrame:
    """Pairs of segments (ay0, ax0, ay1, ax1, by0, bx0, by1, bx1) with `hit`: whether they meet, ends included.

    Both cross products of one segment's ends with the other's line are of different sign, or 0; where all four are
    0, the segments lie on one line and their boxes decide.
    """
    c = F.col
    turn = lambda p, q, r: F.signum(((c(f"{q[0]}y{q[1]}") - c(f"{p[0]}y{p[1]}")) * (c(f"{r[0]}x{r[1]}") - c(f"{p[0]}x{p[1]}")) - (c(f"{q[0]}x{q[1]}") - c(f"{p[0]}x{p[1]}")) * (c(f"{r[0]}y{r[1]}") - c(f"{p[0]}y{p[1]}"))).cast("double"))
    apart = (turn("a0", "a1", "b0") * turn("a0", "a1", "b1") > 0) | (turn("b0", "b1", "a0") * turn("b0", "b1", "a1") > 0)
    over = lambda k: (F.least(f"a{k}0", f"a{k}1") <= F.greatest(f"b{k}0", f"b{k}1")) & (F.least(f"b{k}0", f"b{k}1") <= F.greatest(f"a{k}0", f"a{k}1"))
    return pairs.withColumn("hit", ~apart & over("y") & over("x"))


def parallel_crossing(cuts: DataFrame, polygons: DataFrame, cos: float = 0.999) -> DataFrame:
    """`crossing` that leaves out edges nearly parallel to the cut: the fallback for polygons with no clear cut."""
    e = edges(polygons).select("polygon_id", F.col("y0").alias("ey"), F.col("x0").alias("ex"), F.col("y1").alias("fy"), F.col("x1").alias("fx"))
    turn = lambda ay, ax, by, bx, cy, cx: (F.col(by) - F.col(ay)) * (F.col(cx) - F.col(ax)) - (F.col(bx) - F.col(ax)) * (F.col(cy) - F.col(ay))
    s = lambda *names: F.signum(turn(*names).cast("double"))
    hit = (s("y0", "x0", "y1", "x1", "ey", "ex") * s("y0", "x0", "y1", "x1", "fy", "fx") < 0) & (s("ey", "ex", "fy", "fx", "y0", "x0") * s("ey", "ex", "fy", "fx", "y1", "x1") < 0)
    uy, ux, vy, vx = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"), F.col("fy") - F.col("ey"), F.col("fx") - F.col("ex")
    dot, size = (uy * vy + ux * vx).cast("double"), ((uy * uy + ux * ux) * (vy * vy + vx * vx)).cast("double")
    slanted = dot * dot < F.lit(cos * cos) * size
    return cuts.join(dealt(e), "polygon_id").groupBy("polygon_id", "a", "b").agg(F.sum((hit & slanted).cast("int")).alias("crossings"))


def inside_within(cuts: DataFrame, polygons: DataFrame, radius: float) -> DataFrame:
    """(polygon_id, a, b, inside): `middle_inside`, or a middle at most `radius` away from an edge."""
    e = edges(polygons)
    c = cuts.select("polygon_id", "a", "b", ((F.col("y0") + F.col("y1")) / 2).alias("my"), ((F.col("x0") + F.col("x1")) / 2).alias("mx"))
    ey, ex = F.col("ey1") - F.col("ey0"), F.col("ex1") - F.col("ex0")
    e = e.select("polygon_id", *[F.col(f"{k}{i}").alias(f"e{k}{i}") for k in "yx" for i in "01"])
    j = c.join(dealt(e), "polygon_id")
    size = (ey * ey + ex * ex).cast("double")
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("my") - F.col("ey0")) * ey + (F.col("mx") - F.col("ex0")) * ex) / size))).otherwise(F.lit(0.0))
    dy, dx = F.col("my") - F.col("ey0") - t * ey, F.col("mx") - F.col("ex0") - t * ex
    near = j.groupBy("polygon_id", "a", "b").agg(F.min(F.round(dy * dy + dx * dx, 9)).alias("d2"))
    return middle_inside(cuts, polygons).join(dealt(near), ["polygon_id", "a", "b"]).select("polygon_id", "a", "b", (F.col("inside") | (F.col("d2") <= radius * radius)).alias("inside"))


def corner_vertices(polygons: DataFrame) -> DataFrame:
    """(polygon_id, corner, pos, y, x): the corner of the polygon nearest to each corner of its box, the first on a tie."""
    box = polygons.groupBy("polygon_id").agg(F.min("y").alias("y_min"), F.min("x").alias("x_min"), F.max("y").alias("y_max"), F.max("x").alias("x_max"))
    four = F.explode(F.array(*[F.struct(F.lit(k).alias("corner"), F.col(a).alias("cy"), F.col(b).alias("cx")) for k, (a, b) in enumerate((("y_min", "x_min"), ("y_min", "x_max"), ("y_max", "x_max"), ("y_max", "x_min")))]))
    c = box.select("polygon_id", four.alias("c")).select("polygon_id", "c.*")
    d2 = (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))
    best = c.join(dealt(polygons), "polygon_id").groupBy("polygon_id", "corner").agg(F.min(F.struct(d2.alias("d2"), "pos", "y", "x")).alias("m"))
    return best.select("polygon_id", "corner", "m.pos", "m.y", "m.x")


def centroids(polygons: DataFrame) -> DataFrame:
    """(polygon_id, y, x): the mean of the corners, down to whole numbers."""
    return polygons.groupBy("polygon_id").agg(F.floor(F.sum("y") / F.count(F.lit(1))).cast("int").alias("y"), F.floor(F.sum("x") / F.count(F.lit(1))).cast("int").alias("x"))


def subdivide(quads: DataFrame, s: int = 2) -> DataFrame:
    """(polygon_id, ti, bi, pos, y, x): s x s quads of each quad by bilinear interpolation, cut to whole numbers."""
    wide = quads.groupBy("polygon_id").agg(*[F.max(F.when(F.col("pos") == k, F.col(c))).alias(f"{c}{k}") for k in range(4) for c in "yx"])
    g = wide.withColumn("ti", F.explode(F.sequence(F.lit(0), F.lit(s - 1)))).withColumn("bi", F.explode(F.sequence(F.lit(0), F.lit(s - 1))))
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))]))
    g = g.withColumn("__c", corner).select("*", "__c.*")
    t, b = F.col("ti") + F.col("a"), F.col("bi") + F.col("b")
    # Sums of whole numbers over s * s keep the cut exact.
    at = lambda c: F.floor(((F.col(f"{c}0") * (s - t) + F.col(f"{c}1") * t) * (s - b) + (F.col(f"{c}3") * (s - t) + F.col(f"{c}2") * t) * b) / F.lit(s * s)).cast("int")
    return g.select("polygon_id", "ti", "bi", "pos", at("y").alias("y"), at("x").alias("x"))


def first_occurrences(points: DataFrame) -> DataFrame:
    """Points of each polygon without later repeats, numbered anew."""
    once = points.groupBy("polygon_id", "y", "x").agg(F.min("pos").alias("p"))
    return once.select("polygon_id", (F.row_number().over(Window.partitionBy("polygon_id").orderBy("p")) - 1).cast("int").alias("pos"), "y", "x")
