"""Connected regions, their statistics, tiny ones merged, holes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.plans.fixpoint import connected_components, settle
from pixelweft.schema import REGION_PIXELS, RING, VOID, dealt

_SHIFT = 20


def runs(grid: DataFrame) -> DataFrame:
    """(image_id, value, y, x0, x1): maximal stretches of one value in a row."""
    island = F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y", "value").orderBy("x"))
    return grid.withColumn("g", island).groupBy("image_id", "value", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


def label_relational(grid: DataFrame, diagonals: bool = True) -> DataFrame:
    """Regions by joins only, for images of any size: runs, overlaps of neighbouring rows, components, ranks."""
    node = F.col("image_id").cast("long") * F.lit(1 << 2 * _SHIFT) + F.col("y").cast("long") * F.lit(1 << _SHIFT) + F.col("x0")
    r = settle(runs(grid).withColumn("node", node), "runs")
    reach = 1 if diagonals else 0
    below = r.select("image_id", "value", (F.col("y") - 1).alias("y"), F.col("x0").alias("c0"), F.col("x1").alias("c1"), F.col("node").alias("b"))
    edges = r.join(below, ["image_id", "value", "y"]).where((F.col("x0") <= F.col("c1") + reach) & (F.col("c0") <= F.col("x1") + reach))
    roots = connected_components(edges.select(F.col("node").alias("a"), "b"))
    named = r.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.select("image_id", "root").distinct().withColumn("region_id", (F.row_number().over(Window.partitionBy("image_id").orderBy("root")) - 1).cast("int"))
    named = named.join(ids, ["image_id", "root"])
    return named.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "region_id", "value")


def _touching(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, v: np.ndarray, diagonals: bool) -> np.ndarray:
    """Least run of the component of each run; runs sorted by (y, x0)."""
    reach, label = int(diagonals), np.arange(len(y))
    starts = np.searchsorted(y, np.arange(int(y.max(initial=0)) + 3))
    a, b = [], []
    for row in range(len(starts) - 2):
        i, j, k = starts[row], starts[row + 1], starts[row + 2]
        lo = j + np.searchsorted(x1[j:k], x0[i:j] - reach)
        hi = j + np.searchsorted(x0[j:k], x1[i:j] + reach, "right")
        many = np.maximum(hi - lo, 0)
        a.append(np.repeat(np.arange(i, j), many))
        b.append(np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    a, b = np.concatenate(a).astype(int), np.concatenate(b).astype(int)
    same = v[a] == v[b]
    a, b = a[same], b[same]
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def label_kernel(grid: DataFrame, diagonals: bool = True) -> DataFrame:
    """The same per image in one task, for images of up to about a million pixels."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"], ignore_index=True)
        y, x, v = rows.y.to_numpy(), rows.x.to_numpy(), rows.value.to_numpy()
        new = np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1) | (v[1:] != v[:-1]))
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(y)) - 1
        root = _touching(y[head], x[head], x[last], v[head], diagonals)
        ids = np.unique(root, return_inverse=True)[1]
        rows["region_id"] = ids[np.cumsum(new) - 1].astype(np.int32)
        return rows[["image_id", "y", "x", "region_id", "value"]]

    return grid.groupBy("image_id").applyInPandas(run, REGION_PIXELS)


def stats(region_pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, value, n, bounding box)."""
    return region_pixels.groupBy("image_id", "region_id", "value").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y_min"), F.min("x").alias("x_min"), F.max("y").alias("y_max"), F.max("x").alias("x_max"))


def modes(region_pixels: DataFrame, values: DataFrame) -> DataFrame:
    """(image_id, region_id, mode): the most frequent value of a region in another grid, the least on a tie."""
    c = region_pixels.drop("value").join(values, ["image_id", "y", "x"]).groupBy("image_id", "region_id", "value").count()
    return c.groupBy("image_id", "region_id").agg(F.min_by("value", F.struct(-F.col("count"), "value")).alias("mode"))


def coverage_faults(grid: DataFrame, region_pixels: DataFrame) -> DataFrame:
    """Pixels that no region or more than one has: none if regions partition the grid."""
    n = region_pixels.groupBy("image_id", "y", "x").count()
    return grid.select("image_id", "y", "x").join(n, ["image_id", "y", "x"], "full").where("count IS NULL OR count <> 1").select("image_id", "y", "x", F.coalesce("count", F.lit(0)).alias("n"))


def merge_tiny(region_pixels: DataFrame, limit: int = 10) -> DataFrame:
    """Merges regions of up to `limit` pixels, the smallest first, each into the neighbour of the nearest value.

    Neighbours are looked up in the original grid, in the order pixel, then direction; void and equal values don't
    count, and a region without others stays. Ids are dense again, in the old order.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["region_id", "y", "x"], ignore_index=True)
        at = {(y, x): k for k, (y, x) in enumerate(zip(rows.y, rows.x, strict=True))}
        value, region = rows.value.tolist(), rows.region_id.tolist()
        members: dict[int, list[int]] = {}
        for k, r in enumerate(region):
            members.setdefault(r, []).append(k)
        ys, xs = rows.y.tolist(), rows.x.tolist()
        stuck: set[int] = set()
        while True:
            small = [(len(m), r) for r, m in members.items() if len(m) <= limit and r not in stuck]
            if not small:
                break
            r = min(small)[1]
            v = value[members[r][0]]
            best = None
            for k in members[r]:
                for dy, dx in RING:
                    j = at.get((ys[k] + dy, xs[k] + dx))
                    if j is not None and value[j] != VOID and value[j] != v and (best is None or abs(value[j] - v) < best[0]):
                        best = (abs(value[j] - v), j)
            if best is None or region[best[1]] == r:
                stuck.add(r)
                continue
            to = region[best[1]]
            for k in members[r]:
                region[k] = to
            members[to] += members.pop(r)
        rank = {r: i for i, r in enumerate(sorted(members))}
        head = {r: value[m[0]] for r, m in members.items()}
        rows["region_id"] = [rank[r] for r in region]
        rows["value"] = [head[r] for r in region]
        return rows[["image_id", "y", "x", "region_id", "value"]]

    return region_pixels.groupBy("image_id").applyInPandas(run, REGION_PIXELS)


def holed(region_pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, parts): regions whose outward border has more than one 8-connected part."""
    from .stencil import outward_border

    border = outward_border(region_pixels).select((F.col("image_id").cast("long") * F.lit(1 << 20) + F.col("region_id")).alias("key"), "image_id", "region_id", "y", "x")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"image_id": [rows.image_id.iloc[0]], "region_id": [rows.region_id.iloc[0]], "parts": [len(_parts(set(zip(rows.y, rows.x, strict=True)), RING))]})

    return border.groupBy("key").applyInPandas(run, "image_id int, region_id int, parts int").where("parts > 1")


def _parts(points: set, steps: tuple) -> list[set]:
    out = []
    while points:
        todo = [points.pop()]
        part = set(todo)
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                p = (y + dy, x + dx)
                if p in points:
                    points.discard(p)
                    part.add(p)
                    todo.append(p)
        out.append(part)
    return out


def region_graph(region_pixels: DataFrame) -> DataFrame:
    """(image_id, a, b): regions that touch, corners too, in both directions."""
    from pixelweft.schema import around

    other = region_pixels.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("region_id").alias("b"))
    near = around(region_pixels.select("image_id", "y", "x", F.col("region_id").alias("a")), RING)
    return near.join(dealt(other), ["image_id", "ny", "nx"]).where("a <> b").select("image_id", "a", "b").distinct()


def complement_parts(region_pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, n, exterior): 8-connected parts of what a region leaves; exterior ones touch the frame.

    Regions hang together, so the parts are those of the graph of regions without the one: pixels are read once, and
    a task holds the regions of an image and what touches what.
    """
    ends = region_pixels.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    nodes = region_pixels.join(dealt(ends), "image_id").groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("y").isin(0) | F.col("x").isin(0) | (F.col("y") == F.col("h")) | (F.col("x") == F.col("w"))).alias("exterior"))

    def run(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {r: [] for r in nodes.region_id}
        for a, b in zip(edges.a, edges.b, strict=True):
            near[a].append(b)
        n, exterior = dict(zip(nodes.region_id, nodes.n, strict=True)), dict(zip(nodes.region_id, nodes.exterior, strict=True))
        out = []
        for r in sorted(near):
            seen = {r}
            for start in sorted(near):
                if start in seen:
                    continue
                part, todo = [], [start]
                seen.add(start)
                while todo:
                    k = todo.pop()
                    part.append(k)
                    new = [m for m in near[k] if m not in seen]
                    seen.update(new)
                    todo += new
                out.append((key[0], r, sum(n[k] for k in part), any(exterior[k] for k in part)))
        return pd.DataFrame(out, columns=["image_id", "region_id", "n", "exterior"])

    edges = region_graph(region_pixels)
    edges = edges.select(*[F.col(c).alias(c) for c in edges.columns])
    return nodes.groupBy("image_id").cogroup(edges.groupBy("image_id")).applyInPandas(run, "image_id int, region_id int, n long, exterior boolean")


def quadtree(grid: DataFrame, depth: int = 5) -> DataFrame:
    """(image_id, level, cy, cx, size, n, value): leaves of the quad-tree that stops at cells of one value."""
    ends = grid.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    side = 1 << depth
    open_, out = grid.join(ends, "image_id").drop("h", "w"), None
    for level in range(depth + 1):
        size = side >> level
        cell = open_.withColumn("cy", F.floor(F.col("y") / size).cast("int")).withColumn("cx", F.floor(F.col("x") / size).cast("int"))
        w = Window.partitionBy("image_id", "cy", "cx")
        cell = cell.withColumn("one", F.min("value").over(w) == F.max("value").over(w))
        done = cell.where(F.col("one") | F.lit(level == depth)).groupBy("image_id", "cy", "cx").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
        done = done.select("image_id", F.lit(level).alias("level"), "cy", "cx", F.lit(size).alias("size"), "n", "value")
        out = done if out is None else out.unionByName(done)
        open_ = cell.where(~F.col("one")).select("image_id", "y", "x", "value")
    return out


def label_quadtree(grid: DataFrame, depth: int = 5) -> DataFrame:
    """The regions of `label_relational` from the quad-tree: leaves of one value that touch are components, each found
    without looking at pixels; the pixels get their leaf's label at the end. Images are up to 2 ** depth wide and high."""
    from .spatial import rect_contacts

    leaf = settle(quadtree(grid, depth).withColumn("top", F.col("cy") * F.col("size")).withColumn("left", F.col("cx") * F.col("size")), "leaves")
    leaf = leaf.withColumn("bottom", F.col("top") + F.col("size") - 1).withColumn("right", F.col("left") + F.col("size") - 1)
    side = 1 << depth
    leaf = leaf.withColumn("rect_id", F.col("image_id").cast("long") * side * side + F.col("top") * side + F.col("left"))
    touch = rect_contacts(leaf, ["image_id", "value"])
    roots = connected_components(touch.select("a", "b"))
    named = leaf.join(roots, leaf["rect_id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "rect_id"))
    cells = named.select("image_id", "level", "cy", "cx", "root")
    levels = grid.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    at = lambda c: F.floor(F.col(c) / F.expr(f"shiftright({side}, level)")).cast("int")
    rows = levels.withColumn("cy", at("y")).withColumn("cx", at("x")).join(cells, ["image_id", "level", "cy", "cx"]).select("image_id", "y", "x", "value", "root")
    first = rows.groupBy("image_id", "root").agg(F.min(F.struct("y", "x")).alias("first"))
    ids = first.withColumn("region_id", (F.row_number().over(Window.partitionBy("image_id").orderBy("first")) - 1).cast("int"))
    return rows.join(ids, ["image_id", "root"]).select("image_id", "y", "x", "region_id", "value")


def label_seeded(grid: DataFrame, seeds: int = 100) -> DataFrame:
    """The same from many seeds at once: evenly dealt seeds spread over equal values, one ring a step; where two meet,
    they are merged. Pixels that none has reached seed the next round. One image to a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"], ignore_index=True)
        h, w = int(rows.y.max()) + 1, int(rows.x.max()) + 1
        value = np.full((h + 2, w + 2), np.iinfo(np.int64).min)
        place = (rows.y.to_numpy() + 1) * (w + 2) + rows.x.to_numpy() + 1
        value.ravel()[place] = rows.value.to_numpy()
        value = value.ravel()
        steps = np.array([dy * (w + 2) + dx for dy, dx in RING])
        label = np.full(len(value), -1)
        parent: list[int] = []

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        while len(left := place[label[place] < 0]):
            front = np.unique(left[np.linspace(0, len(left) - 1, min(seeds, len(left))).astype(int)])
            label[front] = len(parent) + np.arange(len(front))
            parent += range(len(parent), len(parent) + len(front))
            while len(front):
                near = (front[:, None] + steps).ravel()
                source = np.repeat(front, len(steps))
                same = value[near] == value[source]
                near, source = near[same], source[same]
                met = (label[near] >= 0) & (label[near] != label[source])
                for a, b in np.unique(np.stack([label[near[met]], label[source[met]]], axis=1), axis=0):
                    a, b = find(int(a)), find(int(b))
                    parent[max(a, b)] = min(a, b)
                new = label[near] < 0
                front, first = np.unique(near[new], return_index=True)
                label[front] = label[source[new][first]]
        root = np.array([find(int(k)) for k in label[place]])
        _, first, back = np.unique(root, return_index=True, return_inverse=True)
        rows["region_id"] = np.argsort(np.argsort(first))[back].astype(np.int32)
        return rows[["image_id", "y", "x", "region_id", "value"]]

    return grid.groupBy("image_id").applyInPandas(run, REGION_PIXELS)
