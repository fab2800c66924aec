"""Polylines: measures, simplification, rasterisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _line() -> Window:
    return Window.partitionBy("line_id").orderBy("pos")


def lengths(lines: DataFrame) -> DataFrame:
    """(line_id, length): sum of the distances of consecutive points."""
    w = _line()
    step = F.sqrt(F.pow(F.col("y") - F.lag("y").over(w), 2) + F.pow(F.col("x") - F.lag("x").over(w), 2))
    return lines.withColumn("d", step).groupBy("line_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"))


def displacements(lines: DataFrame) -> DataFrame:
    """(line_id, pos, dy, dx): to the next point; none for the last."""
    w = _line()
    return lines.select("line_id", "pos", (F.lead("y").over(w) - F.col("y")).alias("dy"), (F.lead("x").over(w) - F.col("x")).alias("dx")).where("dy IS NOT NULL")


def offset(lines: DataFrame, by: float) -> DataFrame:
    """Moves each line along the normal of its chord; a closed line has none and is dropped."""
    ends = lines.groupBy("line_id").agg(F.min_by(F.struct("y", "x"), "pos").alias("a"), F.max_by(F.struct("y", "x"), "pos").alias("b"))
    ends = ends.select("line_id", (F.col("b.y") - F.col("a.y")).alias("cy"), (F.col("b.x") - F.col("a.x")).alias("cx")).withColumn("c", F.sqrt(F.col("cy") * F.col("cy") + F.col("cx") * F.col("cx"))).where("c > 0")
    return lines.join(ends, "line_id").select("line_id", "pos", (F.col("y") + F.lit(by) * F.col("cx") / F.col("c")).alias("y"), (F.col("x") - F.lit(by) * F.col("cy") / F.col("c")).alias("x"))


def fits(lines: DataFrame) -> DataFrame:
    """(line_id, slope, intercept, r2): least-squares lines."""
    return lines.groupBy("line_id").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def straight_prefix(lines: DataFrame, least_r2: float = 0.5) -> DataFrame:
    """(line_id, n): points of the longest beginning whose line fits at least so well."""
    w = _line().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, sx, sy = F.count(F.lit(1)).over(w), F.sum("x").over(w), F.sum("y").over(w)
    sxy, sxx, syy = F.sum(F.col("x") * F.col("y")).over(w), F.sum(F.col("x") * F.col("x")).over(w), F.sum(F.col("y") * F.col("y")).over(w)
    r = lines.select("line_id", n.alias("n"), (n * sxy - sx * sy).alias("c"), ((n * sxx - sx * sx) * (n * syy - sy * sy)).alias("v"))
    fit = (F.col("n") <= 2) | (F.col("v") <= 0) | (F.col("c") * F.col("c") >= F.lit(least_r2) * F.col("v"))
    return r.where(fit).groupBy("line_id").agg(F.max("n").alias("n"))


def keep_points(p: np.ndarray, cutoff: float, strict: bool) -> list[int]:
    """Indices that simplification keeps. strict: textbook recursion; otherwise the part before a split loses its own
    last point but not the split, so a split at index 1 loses point 0, and coincident ends keep the two ends only."""

    def far(a: int, b: int) -> tuple[int, float]:
        """Index and distance of the point between a and b that is farthest from the chord, its ends included."""
        away, chord = p[a : b + 1] - p[a], p[b] - p[a]
        size = float(chord @ chord)
        if size == 0 and not strict:
            return 0, float("nan")
        along = np.clip(away @ chord / size, 0.0, 1.0) if size else np.zeros(len(away))
        d = np.hypot(*(away - along[:, None] * chord).T)
        k = int(np.argmax(d))
        return k, float(d[k])

    # Each range (a, b) yields its kept indices; ranges wait on a stack, so long lines don't recurse.
    kept: dict[tuple[int, int], list[int]] = {}
    stack = [(0, len(p) - 1, False)]
    parts: dict[tuple[int, int], int] = {}
    while stack:
        a, b, ready = stack.pop()
        if ready:
            k = parts[a, b]
            left_end = k if strict else k - 1
            left = kept[a, left_end]
            kept[a, b] = [*left[:-1], k, *kept[k, b][1:]]
            continue
        if b - a < 2:
            kept[a, b] = list(range(a, b + 1))
            continue
        k, d = far(a, b)
        if d > cutoff:
            k += a
            if k in (a, b) and strict:
                kept[a, b] = [a, b]
                continue
            parts[a, b] = k
            stack += [(a, b, True), (a, k if strict else k - 1, False), (k, b, False)]
        else:
            kept[a, b] = [a, b]
    return kept[0, len(p) - 1] if len(p) else []


def simplify(lines: DataFrame, cutoff: float = 3.0, strict: bool = False) -> DataFrame:
    """(line_id, pos, y, x) of the points kept; one line at a time in a kernel."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        return rows.loc[keep_points(rows[["y", "x"]].to_numpy(float), cutoff, strict), ["line_id", "pos", "y", "x"]]

    return lines.select("line_id", "pos", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).groupBy("line_id").applyInPandas(run, f"line_id {lines.schema['line_id'].dataType.simpleString()}, pos int, y double, x double")


def rasterize(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, y, x): pixels of lines (y0, x0)-(y1, x1). The longer axis steps by one, the other is cut toward zero."""
    dy, dx = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    n = F.greatest(F.abs(dy), F.abs(dx))
    out = edges.withColumn("__n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    at = lambda a, d: F.when(F.col("__n") == 0, F.col(a)).otherwise((F.col(a) + F.col("i") * d / F.col("__n")).cast("int")).cast("int")
    return out.select(*keys, "i", at("y0", dy).alias("y"), at("x0", dx).alias("x"))
