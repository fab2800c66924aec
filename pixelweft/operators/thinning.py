"""Simplification of ordered borders by direction, and loops without short lines. Kernels for one line each."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points nearer than this to the anchor have no direction worth the name.
LEAST = 3.0


def past_angle(p: np.ndarray, sample: int, cutoff: float) -> list[int]:
    """Indices that stay: from each anchor the line runs on while it keeps its direction.

    The direction is the mean of the unit vectors from the anchor to the first `sample` points at least `LEAST` away.
    The first point whose own turns by more than `cutoff` is the next anchor; ends always stay. A rest of up to
    `sample` points is one straight line.
    """
    kept, at = [0] if len(p) else [], 0
    while len(p) - at > sample:
        away = p[at:] - p[at]
        far = np.hypot(*away.T)
        valid = np.flatnonzero(far >= LEAST)
        if not len(valid):
            break
        unit = away[valid] / far[valid, None]
        off = np.flatnonzero(np.round(unit @ unit[:sample].mean(axis=0), 9) < round(math.cos(cutoff), 9))
        if not len(off) or at + valid[off[0]] >= len(p) - 1:
            break
        at += int(valid[off[0]])
        kept.append(at)
    return [*kept, len(p) - 1] if len(p) > 1 else kept


def follow(p: np.ndarray, reach: int, cutoff: float) -> list[int]:
    """Indices that stay when a line is followed through windows of `reach` steps.

    In each window the search direction is the mean of the unit vectors from the anchor. Points ahead that turn from
    it by at most `cutoff`, without a gap from the first of them on, are candidates; of those at the greatest distance
    along the line the one that deviates least is the next anchor. If none qualifies, the next point is.
    """
    kept, at = [0] if len(p) else [], 0
    while at < len(p) - 1:
        away = p[at + 1 : at + 1 + reach] - p[at]
        far = np.hypot(*away.T)
        unit = away / np.where(far > 0, far, 1)[:, None]
        mean = unit.mean(axis=0)
        norm = float(np.hypot(*mean))
        cos = np.round(unit @ (mean / norm), 9) if norm > 0 else np.full(len(unit), -1.0)
        good = cos >= round(math.cos(cutoff), 9)
        run = int(np.argmin(good)) if not good.all() else len(good)
        at += max(1, run)
        kept.append(at)
    return kept


def thin(lines: DataFrame, how: str = "angle", sample: int = 5, cutoff: float = math.pi / 6) -> DataFrame:
    """(line_id, pos, y, x) of the points that `past_angle` ("angle") or `follow` ("window") keeps."""
    keep = {"angle": past_angle, "window": follow}[how]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        return rows.loc[keep(rows[["y", "x"]].to_numpy(float), sample, cutoff), ["line_id", "pos", "y", "x"]]

    return lines.select("line_id", "pos", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).groupBy("line_id").applyInPandas(run, f"line_id {lines.schema['line_id'].dataType.simpleString()}, pos int, y double, x double")


Line = list[tuple[int, int]]


def without_short(loop: list[Line], least: float) -> list[Line]:
    """A loop of lines without those up to `least` long; where some were, the lines on both sides meet in the middle
    between their ends, cut to whole numbers. A loop of short lines only stays as it is."""
    long = [k for k, p in enumerate(loop) if sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False)) > least]
    out = {k: list(loop[k]) for k in long}
    for k, m in zip(long, [*long[1:], *long[:1]], strict=True):
        if (m - k) % len(loop) != 1 and len(long) > 1:
            a, b = out[k][-1], out[m][0]
            out[k][-1] = out[m][0] = ((a[0] + b[0]) // 2, (a[1] + b[1]) // 2)
    return list(out.values()) if long else loop


def loops_without_short(lines: DataFrame, least: float = 5.0) -> DataFrame:
    """(loop_id, step, pos, y, x): `without_short` for each loop of lines (loop_id, step, pos, y, x)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows.loop_id.iloc[0]
        loop = [list(zip(g.y.tolist(), g.x.tolist(), strict=True)) for _, g in rows.sort_values(["step", "pos"]).groupby("step")]
        return pd.DataFrame([(name, k, i, y, x) for k, p in enumerate(without_short(loop, least)) for i, (y, x) in enumerate(p)], columns=["loop_id", "step", "pos", "y", "x"])

    return lines.groupBy("loop_id").applyInPandas(run, f"loop_id {lines.schema['loop_id'].dataType.simpleString()}, step int, pos int, y int, x int")
