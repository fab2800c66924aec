"""Pixel graphs: degrees, distances, orders by distance, and the exterior around branch points.

Distances over tables of any size spread by joins, one ring of nodes a round. The orders within one border are worked
out in a kernel, one border to a task.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweft.plans.fixpoint import settle
from pixelweft.schema import RING, around, dealt

Point = tuple[int, int]


def branches(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, degree): points with more than two neighbours in edges (keys, y, x, ny, nx)."""
    return edges.groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("degree")).where("degree > 2")


def distances(edges: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, distance): steps from the nearest start, for the points that can be reached."""
    seen = settle(starts.select(*keys, "y", "x").distinct().withColumn("distance", F.lit(0)), "distances")
    front = seen
    step = 0
    while not front.isEmpty():
        step += 1
        near = front.select(*keys, "y", "x").join(edges, [*keys, "y", "x"]).select(*keys, F.col("ny").alias("y"), F.col("nx").alias("x")).distinct()
        front = settle(near.join(seen, [*keys, "y", "x"], "left_anti").withColumn("distance", F.lit(step)), "front")
        seen = seen.unionByName(front)
        if step % 16 == 0:
            seen = settle(seen, "distances")
    return seen


def graph_order(distance: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, y, x): points by distance, then (y, x)."""
    from .points import rank_of

    return rank_of(distance, keys, ["distance", "y", "x"], "pos").select(*keys, "pos", "y", "x")


def exterior_links(points: DataFrame, region_pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, i, j): neighbours i and j of a listed point, by their place in the ring, that lie at both ends
    of a run of exterior cells, followed in the order of the ring.

    A cell is exterior if it is neither listed nor of the point's region. points: (image_id, region_id, y, x).
    """
    keys = ["image_id", "region_id"]
    ring = around(points.select(*keys, "y", "x").distinct(), RING)
    listed = points.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx")).distinct().withColumn("__on", F.lit(1))
    own = region_pixels.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx")).withColumn("__in", F.lit(1))
    cells = ring.join(dealt(listed), [*keys, "ny", "nx"], "left").join(dealt(own), [*keys, "ny", "nx"], "left")
    kind = F.when(F.col("__on").isNotNull(), 2).when(F.col("__in").isNotNull(), 1).otherwise(0)
    rings = cells.groupBy(*keys, "y", "x").agg(F.array_sort(F.collect_list(F.struct("i", kind.alias("k")))).alias("r"))
    # From each listed cell to the next cell that isn't exterior, which has to be a listed one behind a gap.
    ahead = lambda i: F.filter(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda d: F.struct(d.alias("d"), F.get("r", (i + d) % 8)["k"].alias("k"))), lambda s: s["k"] > 0)
    each = rings.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).where(F.col("r")[F.col("i")]["k"] == 2).withColumn("n", F.get(ahead(F.col("i")), F.lit(0)))
    return each.where("n.k = 2 AND n.d > 1").select("image_id", "region_id", "y", "x", "i", ((F.col("i") + F.col("n.d")) % 8).alias("j"))


# --- orders within one border, in kernels --------------------------------------------------------------------------------


def _links(points: list[Point]) -> list[list[int]]:
    at = {p: k for k, p in enumerate(points)}
    return [[at[q] for dy, dx in RING if (q := (y + dy, x + dx)) in at] for y, x in points]


def hops(links: list[list[int]], start: int) -> np.ndarray:
    """Steps from `start` to each node; -1 where none lead."""
    out = np.full(len(links), -1)
    out[start] = 0
    todo = deque([start])
    while todo:
        k = todo.popleft()
        for m in links[k]:
            if out[m] < 0:
                out[m] = out[k] + 1
                todo.append(m)
    return out


def shortest_path(points: list[Point], a: Point, b: Point) -> list[Point]:
    """A path of least steps over touching points, both ends included; empty if none leads from a to b."""
    at = {p: k for k, p in enumerate(points)}
    if a not in at or b not in at:
        return []
    links = _links(points)
    far = hops(links, at[b])
    if far[at[a]] < 0:
        return []
    path = [at[a]]
    while path[-1] != at[b]:
        path.append(min((m for m in links[path[-1]] if far[m] == far[path[-1]] - 1), key=lambda m: points[m]))
    return [points[k] for k in path]


def shortest_paths(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, y, x): `shortest_path` over the points (keys, y, x, ay, ax, by, bx) of each group."""
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        path = shortest_path(list(zip(rows.y.tolist(), rows.x.tolist(), strict=True)), (int(first.ay), int(first.ax)), (int(first.by), int(first.bx)))
        return pd.DataFrame([(*[first[c] for c in keys], i, y, x) for i, (y, x) in enumerate(path)], columns=[*keys, "pos", "y", "x"])

    return points.groupBy(*keys).applyInPandas(run, f"{kinds}, pos int, y int, x int")


def farthest_order(points: list[Point]) -> tuple[list[Point], bool]:
    """The points of one connected border from end to end, and whether it is a loop.

    The order begins at a point that is farthest from the first and goes by distance from there. If two arms run
    beside each other, so that the point halfway has a counterpart at its distance that is farther from it than the
    beginning is, the border is a loop: one arm is run through forwards and the other one back.
    """
    points = sorted(set(points))
    if not points:
        return [], False
    links = _links(points)
    reach = hops(links, 0)
    begin = int(np.flatnonzero(reach == reach.max())[-1])
    far = hops(links, begin)
    order = sorted((k for k in range(len(points)) if far[k] >= 0), key=lambda k: (far[k], points[k]))
    pivot = order[len(order) // 2]
    from_pivot = hops(links, pivot)
    same = [from_pivot[k] for k in order if far[k] == far[pivot]]
    loop = from_pivot[begin] < max(same)
    if loop:
        # An arm is what hangs together once both ends are taken away.
        end = order[-1]
        side, todo = {pivot}, [pivot]
        while todo:
            k = todo.pop()
            for m in links[k]:
                if m not in side and m not in (begin, end):
                    side.add(m)
                    todo.append(m)
        other = [k for k in order if k not in side and k != end]
        order = [*other, *([end] if end not in side else []), *[k for k in reversed(order) if k in side]]
    return [points[k] for k in order], bool(loop)


def _orders(rows: pd.DataFrame, names: list[str], f) -> pd.DataFrame:
    key = [rows[c].iloc[0] for c in names]
    return pd.DataFrame([(*key, i, y, x, bool(loop)) for path, loop in [f(list(zip(rows.y.tolist(), rows.x.tolist(), strict=True)))] for i, (y, x) in enumerate(path)], columns=[*names, "pos", "y", "x", "is_loop"])


def farthest_orders(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, y, x, is_loop): `farthest_order` of each border (keys, y, x)."""
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in keys)
    return points.groupBy(*keys).applyInPandas(lambda rows: _orders(rows, keys, farthest_order), f"{kinds}, pos int, y int, x int, is_loop boolean")


def chunked_walk(points: list[Point], size: int) -> list[Point]:
    """An order of a border's points that works cell by cell.

    In every square cell the connected points are ordered on their own; the pieces are then joined, each time the
    one with an end that is closest to an end of the walk so far. No point is left out, and none comes twice.
    """
    cells: dict[Point, set[Point]] = {}
    for y, x in points:
        cells.setdefault((y // size, x // size), set()).add((y, x))
    pieces = []
    for _, held in sorted(cells.items()):
        while held:
            todo = [min(held)]
            part = set(todo)
            held -= part
            while todo:
                y, x = todo.pop()
                near = {(y + dy, x + dx) for dy, dx in RING} & held
                held -= near
                part |= near
                todo += near
            pieces.append(farthest_order(list(part))[0])
    if not pieces:
        return []
    path = pieces.pop(0)
    gap = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2
    while pieces:
        # Which piece, by which of its ends (0, -1), goes to which end of the walk.
        _, k, own, end = min((gap(p[own], path[end]), k, own, end) for k, p in enumerate(pieces) for own in (0, -1) for end in (-1, 0))
        piece = pieces.pop(k)
        piece = piece if (own == 0) == (end == -1) else piece[::-1]
        path = path + piece if end == -1 else piece + path
    return path


def chunked_walks(points: DataFrame, keys: list[str], size: int = 16) -> DataFrame:
    """(keys, pos, y, x): `chunked_walk` of each border (keys, y, x)."""
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in keys)
    return points.groupBy(*keys).applyInPandas(lambda rows: _orders(rows, keys, lambda p: (chunked_walk(p, size), False)).drop(columns="is_loop"), f"{kinds}, pos int, y int, x int")
