"""Border segments: split, walked, joined into loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.schema import RING, dealt

PAIR = ["image_id", "region_id", "other_id"]


def segments(border: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair, segment, y, x): connected parts of a pair's border, numbered by their first pixel in raster order."""

    def run(key: tuple, points: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        root = {p: p for p in sorted(set(zip(points.y, points.x, strict=True)))}

        def find(p: tuple) -> tuple:
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        for a, b, c, d in zip(links.y, links.x, links.ny, links.nx, strict=True):
            p, q = find((a, b)), find((c, d))
            if p != q:
                root[max(p, q)] = min(p, q)
        rank = {p: i for i, p in enumerate(sorted({find(p) for p in root}))}
        return pd.DataFrame([(*key, rank[find(p)], *p) for p in root], columns=[*PAIR, "segment", "y", "x"])

    edges = edges.select(*[F.col(c).alias(c) for c in edges.columns])  # names of their own, where both come from one table
    return border.select(*PAIR, "y", "x").groupBy(*PAIR).cogroup(edges.groupBy(*PAIR)).applyInPandas(run, "image_id int, region_id int, other_id int, segment int, y int, x int")


def walk(points: list[tuple[int, int]], inside: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Orders border pixels as a walk; what it can't reach is left out.

    It begins at the middle of the sorted pixels and takes, in the order of the ring, the first open neighbour. A
    neighbour is open if it is a border pixel with a cell beside it that leads outside, and, if diagonal, with one
    beside it that is inside. A cell leads outside if it isn't in the region and, if diagonal, not both cells beside
    it are. From the start two ways may be taken; the first is turned round before the second follows.
    """
    if not points:
        return []
    pool = sorted(set(points))
    border = set(pool)
    start = pool[len(pool) // 2]

    def open_from(p: tuple[int, int]) -> list[tuple[int, int]]:
        ring = [(p[0] + dy, p[1] + dx) for dy, dx in RING]
        within = [q in border or q in inside for q in ring]
        beside = lambda i: (within[(i + 1) % 8], within[i - 1])
        leads = [not within[i] and (i % 2 == 0 or not all(beside(i))) for i in range(8)]
        return [q for i, q in enumerate(ring) if q in border and (leads[(i + 1) % 8] or leads[i - 1]) and (i % 2 == 0 or any(beside(i)))]

    path, seen = [start], {start}
    for first in open_from(start):
        if first in seen:
            continue
        if len(path) > 1:
            path.reverse()
        at: tuple[int, int] | None = first
        while at is not None:
            seen.add(at)
            path.append(at)
            at = next((q for q in open_from(at) if q not in seen), None)
    return path


def walks(segment_pixels: DataFrame, region_pixels: DataFrame) -> DataFrame:
    """(pair, segment, pos, y, x): every segment as a walk, its image's pixels of the same region being inside."""
    key = [*PAIR, "segment"]
    near = segment_pixels.withColumn("o", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), *RING)])))
    near = near.select(*key, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    # The pixels of an owned border lie in the other region, which is the walk's inside.
    own = region_pixels.select("image_id", F.col("region_id").alias("other_id"), "y", "x")
    inner = near.join(dealt(own), ["image_id", "other_id", "y", "x"], "left_semi").select(*key, "y", "x")

    def run(k: tuple, points: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        path = walk(list(zip(points.y.tolist(), points.x.tolist(), strict=True)), set(zip(around.y.tolist(), around.x.tolist(), strict=True)))
        return pd.DataFrame([(*k, i, *p) for i, p in enumerate(path)], columns=[*key, "pos", "y", "x"])

    inner = inner.select(*[F.col(c).alias(c) for c in inner.columns])
    return segment_pixels.groupBy(*key).cogroup(inner.groupBy(*key)).applyInPandas(run, "image_id int, region_id int, other_id int, segment int, pos int, y int, x int")


def traversal_failures(segment_pixels: DataFrame, walked: DataFrame, tolerance: int = 5) -> DataFrame:
    """Pixels that no walk reached, of segments with more than `tolerance` of them."""
    key = [*PAIR, "segment"]
    left = segment_pixels.join(dealt(walked), [*key, "y", "x"], "left_anti")
    many = left.groupBy(*key).count().where(F.col("count") > tolerance)
    return left.join(dealt(many), key).drop("count")


def loops(walked: DataFrame) -> DataFrame:
    """(pair, segment, n, is_loop): whether a walk ends beside its start in both axes."""
    key = [*PAIR, "segment"]
    ends = walked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("y", "x"), "pos").alias("a"), F.max_by(F.struct("y", "x"), "pos").alias("b"))
    return ends.select(*key, "n", ((F.abs(F.col("a.y") - F.col("b.y")) <= 1) & (F.abs(F.col("a.x") - F.col("b.x")) <= 1)).alias("is_loop"))


def tour(ends: list[tuple[tuple[float, float], tuple[float, float]]]) -> list[tuple[int, int, int, int]]:
    """Joins lines end to end: (line, next line, end that is left, end that is entered), a nearest-end walk.

    Begins at the first end of the first line, runs along lines at no cost and hops to the nearest end not yet
    visited, the lower one on a tie; the last hop closes the loop.
    """
    at, seen, out = (0, 1), {0}, []
    while len(seen) < len(ends):
        y, x = ends[at[0]][at[1]]
        _, k, e = min(((ends[k][e][0] - y) ** 2 + (ends[k][e][1] - x) ** 2, k, e) for k in range(len(ends)) if k not in seen for e in (0, 1))
        out.append((at[0], k, at[1], e))
        seen.add(k)
        at = (k, 1 - e)
    if len(ends) > 1:
        out.append((at[0], 0, at[1], 0))
    return out


def region_loops(walked: DataFrame, least: float = 5.0) -> DataFrame:
    """(image_id, region_id, step, other_id, segment, end): the lines of a region in the order of their tour.

    Closed lines are left out if there are open ones; lines up to `least` long too; a single one is closed in place.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lines = []
        for k, g in rows.sort_values("pos").groupby(["region_id", "other_id", "segment"]):
            p = g[["y", "x"]].to_numpy(float)
            lines.append((k, tuple(p[0]), tuple(p[-1]), float(np.hypot(*np.diff(p, axis=0).T).sum()), bool((np.abs(p[0] - p[-1]) <= 1).all())))
        opened = [x for x in lines if not x[4]]
        kept = [x for x in opened if x[3] > least] if opened else lines
        image, region = rows.image_id.iloc[0], rows.owner.iloc[0]
        steps = tour([(x[1], x[2]) for x in kept]) if len(kept) > 1 and opened else [(i, i, 0, 0) for i in range(len(kept))]
        return pd.DataFrame([(image, region, i, int(kept[a][0][1]), int(kept[a][0][2]), e) for i, (a, _, e, _) in enumerate(steps)], columns=["image_id", "region_id", "step", "other_id", "segment", "end"])

    both = walked.withColumn("owner", F.explode(F.array("region_id", "other_id"))).where("owner >= 0")
    return both.groupBy("image_id", "owner").applyInPandas(run, "image_id int, region_id int, step int, other_id int, segment int, end int")


def links(tours: DataFrame) -> DataFrame:
    """(line_a, end_a, line_b, end_b): the ends that follow each other in tours (image_id, region_id, step, line_id, end).

    `end` is the end by which a line is left; a line alone in its tour is closed in itself.
    """
    w = Window.partitionBy("image_id", "region_id").orderBy("step")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead(F.struct("line_id", "end")).over(w), F.first(F.struct("line_id", "end")).over(whole))
    return tours.select(F.col("line_id").alias("line_a"), F.col("end").alias("end_a"), after.alias("n")).select("line_a", "end_a", F.col("n.line_id").alias("line_b"), (1 - F.col("n.end")).alias("end_b"))


def cinch(ends: DataFrame) -> DataFrame:
    """(link, y, x): one point for linked ends, their mean cut to whole numbers; the order of ends doesn't matter."""
    return ends.groupBy("link").agg(F.avg("y").cast("int").alias("y"), F.avg("x").cast("int").alias("x"))


def cinched(lines: DataFrame, linked: DataFrame) -> DataFrame:
    """Lines (line_id, pos, y, x) whose linked ends lie on one point: the mean of all that hang together."""
    from pixelweft.plans.fixpoint import connected_components

    node = lambda line, end: F.concat_ws("#", line, F.col(end).cast("string"))
    roots = connected_components(linked.select(node("line_a", "end_a").alias("a"), node("line_b", "end_b").alias("b")))
    span = lines.groupBy("line_id").agg(F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    rows = lines.join(span, "line_id").withColumn("end", F.when(F.col("pos") == F.col("p0"), 0).when(F.col("pos") == F.col("p1"), 1)).withColumn("node", node("line_id", "end"))
    rows = rows.join(roots.withColumnRenamed("root", "link"), "node", "left")
    to = cinch(rows.where("link IS NOT NULL")).select("link", F.col("y").alias("cy"), F.col("x").alias("cx"))
    return rows.join(to, "link", "left").select("line_id", "pos", F.coalesce("cy", "y").cast("double").alias("y"), F.coalesce("cx", "x").cast("double").alias("x"))


def longer(lines: DataFrame, least: float) -> DataFrame:
    """Lines (line_id, pos, y, x) that are longer than `least`."""
    from .polyline import lengths

    return lines.join(lengths(lines).where(F.round("length", 6) > least).select("line_id"), "line_id", "left_semi")


def end_distances(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, end_a, b, end_b, d2): squared distances between the ends of the lines of a group, a < b.

    Groups are the lines around one region, which are few.
    """
    ends = lines.groupBy(*keys, "line_id").agg(F.min_by(F.struct("y", "x"), "pos").alias("e0"), F.max_by(F.struct("y", "x"), "pos").alias("e1"))
    e = ends.select(*keys, "line_id", F.posexplode(F.array("e0", "e1")).alias("end", "p"))
    one = lambda k: e.select(*keys, F.col("line_id").alias(k), F.col("end").alias(f"end_{k}"), F.col("p.y").alias(f"y{k}"), F.col("p.x").alias(f"x{k}"))
    d2 = (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb")) + (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb"))
    return one("a").join(one("b"), keys).where("a < b").select(*keys, "a", "end_a", "b", "end_b", d2.alias("d2"))


class TraversalError(RuntimeError):
    """A border walk has left out more pixels than are tolerated."""


def check_traversal(segment_pixels: DataFrame, walked: DataFrame, tolerance: int = 5) -> None:
    """Raises if any segment has more than `tolerance` pixels that its walk didn't reach; naming some of them."""
    some = traversal_failures(segment_pixels, walked, tolerance).select(*PAIR, "segment").distinct().orderBy(*PAIR, "segment").limit(5).collect()
    if some:
        raise TraversalError("walks left out pixels of " + "; ".join("image {}, regions {} and {}, segment {}".format(*r) for r in some))


def failed_images(segment_pixels: DataFrame, walked: DataFrame, tolerance: int = 5) -> DataFrame:
    """(image_id, failed): whether any segment of an image has failed."""
    bad = traversal_failures(segment_pixels, walked, tolerance).select("image_id").distinct().withColumn("bad", F.lit(True))
    return segment_pixels.select("image_id").distinct().join(dealt(bad), "image_id", "left").select("image_id", F.coalesce("bad", F.lit(False)).alias("failed"))
