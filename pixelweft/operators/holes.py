"""Regions with holes, cut open: cuts run from the outside through the holes and back, and the parts become regions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.schema import CROSS, REGION_PIXELS, RING, VOID, dealt

from .points import weight_shape
from .regions import holed

#: Distances that are held at a time.
ROOM = 1 << 20


def label_mask(mask: np.ndarray, steps: tuple) -> np.ndarray:
    """Parts of a mask by the steps that connect cells, numbered by their first cell in raster order; -1 elsewhere."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    h, w = mask.shape
    while True:
        low = label.copy()
        for dy, dx in steps:
            a = (slice(max(0, dy), h + min(0, dy)), slice(max(0, dx), w + min(0, dx)))
            b = (slice(max(0, -dy), h + min(0, -dy)), slice(max(0, -dx), w + min(0, -dx)))
            np.minimum(low[a], label[b], out=low[a])
        low[~mask] = mask.size
        # A label names a cell, whose own label may be lower by now.
        flat = np.append(low.ravel(), mask.size)
        while not np.array_equal(flat[flat], flat):
            flat = flat[flat]
        low = flat[:-1].reshape(mask.shape)
        if np.array_equal(low, label):
            break
        label = low
    names, out = np.unique(label, return_inverse=True)
    out = out.reshape(mask.shape).astype(np.int64)
    out[~mask] = -1
    return out


def touching(mask: np.ndarray) -> np.ndarray:
    """Cells with one of eight neighbours in a mask."""
    wide = np.pad(mask, 1)
    h, w = mask.shape
    return np.logical_or.reduce([wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in RING])


def closest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(squared distance, i, j) of the closest points of two lists, the first ones on a tie; in blocks."""
    best = (1 << 62, 0, 0)
    step = max(1, ROOM // max(1, len(b)))
    for at in range(0, len(a), step):
        d = ((a[at : at + step, None] - b[None]) ** 2).sum(axis=2)
        k = int(np.argmin(d))
        i, j = divmod(k, len(b))
        best = min(best, (int(d[i, j]), at + i, j))
    return best


def line_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cells of a line: the longer axis in steps of one, the other cut toward zero."""
    n = int(np.abs(b - a).max())
    return a + np.trunc((b - a) * np.arange(n + 1)[:, None] / max(n, 1)).astype(np.int64)


def _ahead(end: np.ndarray, ray: np.ndarray, rim: np.ndarray, penalty: float) -> int | None:
    """The point of a rim ahead of a cut at the least distance * penalty ** -cos of the turn to it."""
    to = rim - end
    far = np.hypot(*to.T)
    dot = to @ ray
    ok = np.flatnonzero((dot > 0) & (far > 0))
    if not len(ok):
        return None
    return int(ok[np.argmin(np.round(far[ok] * np.exp(-dot[ok] / far[ok] * math.log(penalty)), 9))])


def cuts(rims: list[np.ndarray], penalty: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cuts (from, to) between rims, the last of which is the outside's and counts as open.

    Every chain begins at the shortest link between an open rim and a closed one and goes on from rim to rim, each
    time by the link of the least distance times the weight of its turn, until it reaches one that is open. Where no
    rim lies ahead, the shortest link to one that the chain hasn't come through is taken.
    """
    links = {(i, j): closest(rims[i], rims[j]) for i in range(len(rims)) for j in range(i + 1, len(rims))}

    def link(i: int, j: int) -> tuple[int, np.ndarray, np.ndarray]:
        d, a, b = links[min(i, j), max(i, j)]
        a, b = rims[min(i, j)][a], rims[max(i, j)][b]
        return (d, a, b) if i < j else (d, b, a)

    open_, out = {len(rims) - 1}, []
    while len(open_) < len(rims):
        _, at, start = min((link(u, c)[0], u, c) for u in range(len(rims)) if u not in open_ for c in sorted(open_))
        _, a, b = link(start, at)
        out.append((a, b))
        came, chain = start, [at]
        while at not in open_:
            ray = (b - a) / max(1e-9, float(np.hypot(*(b - a))))
            ways = []
            for m in range(len(rims)):
                if m == at or m in chain:
                    continue
                k = _ahead(b, ray, rims[m], penalty)
                if k is not None:
                    d, i, _ = closest(rims[at], rims[m][k : k + 1])
                    ways.append((math.sqrt(d), m, rims[at][i], rims[m][k]))
            if ways:
                shape = weight_shape(max(w[0] for w in ways))
                turn = lambda w: float(np.clip(ray @ (w[3] - w[2]) / max(w[0], 1e-9), -1.0, 1.0))
                curve = lambda t: (1 - t) / 2 + shape[0] + shape[1] * (math.exp(t * shape[2]) if shape[2] else t)
                _, _, m, a, b = min((round(w[0] * curve(turn(w)), 9), k, *w[1:]) for k, w in enumerate(ways))
            else:
                left = [m for m in range(len(rims)) if m not in chain and m != came] or [came]
                _, m = min((link(at, m)[0], m) for m in left)
                _, a, b = link(at, m)
            out.append((a, b))
            came, at = at, m
            chain.append(m)
        open_.update(chain)
    return out


def cut_open(points: np.ndarray, height: int, width: int, penalty: float = 100.0) -> np.ndarray:
    """The part of each point (y, x) of a region after its holes are cut open, from 0; all 0 without holes.

    Work is done within the region's box and a cell around it. Cells outside of the region that hang together with
    the outside of the box, or with the frame of the image, are outside; others are holes. Parts are what the cuts
    leave, by four neighbours; cells on a cut go to the part of their first neighbour that has one, round by round.
    """
    low = np.maximum(points.min(axis=0) - 1, 0)
    high = np.minimum(points.max(axis=0) + 1, [height - 1, width - 1])
    at = points - low
    mask = np.zeros(high - low + 1, bool)
    mask[at[:, 0], at[:, 1]] = True
    rest = label_mask(~mask, RING)
    y, x = np.indices(mask.shape)
    rim = (y == 0) | (x == 0) | (y == mask.shape[0] - 1) | (x == mask.shape[1] - 1)
    frame = (y + low[0] == 0) | (x + low[1] == 0) | (y + low[0] == height - 1) | (x + low[1] == width - 1)
    outside = np.unique(rest[rim & ~mask])
    inner = np.setdiff1d(np.unique(rest[~mask]), outside)
    if not len(inner):
        return np.zeros(len(points), np.int64)
    near = touching(mask)
    rims = [np.argwhere((rest == k) & near) for k in inner]
    rims.append(np.argwhere((np.isin(rest, outside) | frame) & near))
    cut = np.zeros(mask.shape, bool)
    for a, b in cuts(rims, penalty):
        cells = line_cells(a, b)
        cut[cells[:, 0], cells[:, 1]] = True
    # Lines touch holes and the outside at their ends; those cells stay what they are.
    cut &= mask
    part = label_mask(mask & ~cut, CROSS)
    todo = np.argwhere(cut)
    while len(todo):
        wide = np.pad(part, 1, constant_values=-1)
        beside = np.stack([wide[todo[:, 0] + 1 + dy, todo[:, 1] + 1 + dx] for dy, dx in RING], axis=1)
        first = beside[np.arange(len(todo)), np.argmax(beside >= 0, axis=1)]
        if (first < 0).all():
            part[todo[:, 0], todo[:, 1]] = part.max() + 1 + np.arange(len(todo))
            break
        part[todo[:, 0], todo[:, 1]] = first
        todo = todo[first < 0]
    return part[at[:, 0], at[:, 1]]


def all_parts(points: np.ndarray, height: int, width: int, penalty: float, rounds: int = 8) -> np.ndarray:
    """`cut_open`, and again for parts that have holes still, numbered by their first point in raster order."""
    label = cut_open(points, height, width, penalty)
    for _ in range(rounds):
        new = label.copy()
        for k in np.unique(label):
            own = np.flatnonzero(label == k)
            inner = cut_open(points[own], height, width, penalty)
            new[own[inner > 0]] = new.max() + inner[inner > 0]
        if np.array_equal(new, label):
            break
        label = new
    order = np.lexsort(points.T[::-1])
    _, first = np.unique(label[order], return_index=True)
    names = label[order][np.sort(first)]
    rank = {int(k): i for i, k in enumerate(names)}
    return np.array([rank[int(k)] for k in label])


def cut_holes(region_pixels: DataFrame, penalty: float = 100.0) -> DataFrame:
    """Region pixels in which no region that isn't void has a hole; ids are dense, in the order (old id, part).

    Only regions whose border has more than one part are worked on, each in one task; the others pass through. Every
    pixel keeps its value and belongs to one region.
    """
    size = region_pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    some = holed(region_pixels).select("image_id", "region_id")
    own = region_pixels.where(F.col("value") != VOID).join(dealt(some), ["image_id", "region_id"], "left_semi").join(dealt(size), "image_id")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows["part"] = all_parts(rows[["y", "x"]].to_numpy(np.int64), int(rows.height.iloc[0]), int(rows.width.iloc[0]), penalty).astype(np.int32)
        return rows[["image_id", "y", "x", "region_id", "value", "part"]]

    parted = own.groupBy("image_id", "region_id").applyInPandas(run, REGION_PIXELS + ", part int")
    done = parted.select("image_id", "y", "x", F.col("part").alias("__part"))
    both = region_pixels.join(dealt(done), ["image_id", "y", "x"], "left").withColumn("__part", F.coalesce("__part", F.lit(0)))
    ids = both.select("image_id", "region_id", "__part").distinct().withColumn("__id", (F.row_number().over(Window.partitionBy("image_id").orderBy("region_id", "__part")) - 1).cast("int"))
    return both.join(dealt(ids), ["image_id", "region_id", "__part"]).select("image_id", "y", "x", F.col("__id").alias("region_id"), "value")
