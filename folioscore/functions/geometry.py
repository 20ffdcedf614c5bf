"""Boxes, polygons and membership as Column builders; only the convex hull needs Python."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME_FRAME = r".*_(\d{2,})x(\d{2,})_(\d{2,})x(\d{2,})"
POINTS = r"^\s*-?\d+(?:\.\d+)?,-?\d+(?:\.\d+)?(?:\s+-?\d+(?:\.\d+)?,-?\d+(?:\.\d+)?)+\s*$"


def frame_from_name(name: Column) -> Column:
    """The box that a file name ends in, as _X0xY0_X1xY1, else null."""
    at = lambda i: F.regexp_extract(name, _NAME_FRAME, i).cast("int")
    return F.when(name.rlike(_NAME_FRAME), F.struct(at(1).alias("x0"), at(2).alias("y0"), at(3).alias("x1"), at(4).alias("y1")))


def box_polygon(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The four corners of a box, clockwise from its origin."""
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(p(x, y), p(x + width, y), p(x + width, y + height), p(x, y + height))


def box_of(polygon: Column) -> Column:
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.when(F.size(polygon) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def parse_points(text: Column) -> Column:
    """A list of points "x,y x,y ..."; two points stand for a rectangle, anything else than points is null."""
    p = F.transform(
        F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != ""),
        lambda s: F.struct(F.split_part(s, F.lit(","), F.lit(1)).try_cast("double").alias("x"), F.split_part(s, F.lit(","), F.lit(2)).try_cast("double").alias("y")),
    )
    a, b = p[0], p[1]
    q = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rectangle = F.array(a, q(b["x"], a["y"]), b, q(a["x"], b["y"]))
    return F.when(text.rlike(POINTS), F.when(F.size(p) == 2, rectangle).otherwise(p))


def centroid(polygon: Column) -> Column:
    """Area-weighted centre; the mean of the corners where there is no area.  One pass over the edges."""
    n = F.size(polygon)
    turned = F.when(n > 0, F.concat(F.slice(polygon, 2, F.greatest(n - 1, F.lit(1))), F.slice(polygon, 1, 1)))
    edges = F.zip_with(polygon, turned, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), p["x"].alias("px"), p["y"].alias("py"), (p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y")))
    names = ("area", "cx", "cy", "sx", "sy", "n")
    start = F.struct(*[F.lit(0.0).alias(k) for k in names])

    def step(s: Column, e: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in zip(names, (s["area"] + e["c"], s["cx"] + e["c"] * e["x"], s["cy"] + e["c"] * e["y"], s["sx"] + e["px"], s["sy"] + e["py"], s["n"] + 1.0), strict=True)])

    def end(s: Column) -> Column:
        side = lambda whole, plain: F.when(s["area"] != 0, s[whole] / (3 * s["area"])).otherwise(s[plain] / s["n"])
        return F.struct(side("cx", "sx").alias("x"), side("cy", "sy").alias("y"))

    return F.when(n > 0, F.aggregate(edges, start, step, end))


def inside_box(point: Column, box: Column) -> Column:
    """Strictly inside; an edge is outside."""
    return (point["x"] > box["x0"]) & (point["x"] < box["x1"]) & (point["y"] > box["y0"]) & (point["y"] < box["y1"])


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    pts = sorted({(float(x), float(y)) for x, y in points})
    if len(pts) < 3:
        return np.array(pts)

    def chain(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def strictly_in_hull(polygon: np.ndarray, x: float, y: float) -> bool:
    return bool(_strictly(hull(polygon), np.array([x]), np.array([y]))[0])


def _strictly(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie strictly inside a hull."""
    if len(h) < 3:
        return np.zeros(len(x), bool)
    d = np.roll(h, -1, 0) - h
    return np.all(d[:, 0, None] * (y - h[:, 1, None]) - d[:, 1, None] * (x - h[:, 0, None]) > 0, axis=0)


@F.pandas_udf(T.BooleanType())
def in_hull(polygon: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """Whether a point lies strictly inside the convex hull of a polygon; null for an empty polygon or point. A hull is found once for each different polygon of a batch."""
    keys = [None if p is None or len(p) == 0 else tuple((q["x"], q["y"]) for q in p) for p in polygon]
    out = np.full(len(keys), None, object)
    there = (x.notna() & y.notna()).to_numpy()
    rows: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        if k is not None and there[i]:
            rows.setdefault(k, []).append(i)
    for k, at in rows.items():
        out[at] = _strictly(hull(np.array(k)), x.to_numpy(float)[at], y.to_numpy(float)[at])
    return pd.Series(out, dtype="object")


def rectangular(polygon: Column) -> Column:
    """Four corners with sides along the axes."""
    xs, ys = F.array_distinct(F.transform(polygon, lambda p: p["x"])), F.array_distinct(F.transform(polygon, lambda p: p["y"]))
    return (F.size(polygon) == 4) & (F.size(xs) == 2) & (F.size(ys) == 2)


def centre(points: Column, vertical: bool = False) -> Column:
    """Mean of the corners along an axis; null for no corner."""
    k = "y" if vertical else "x"
    return F.when(F.size(points) > 0, F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k]) / F.size(points))


def parse_polygon(text: str) -> list[tuple[float, float]]:
    """The same as `parse_points` for one string on the driver; raises ValueError for anything else."""
    if not re.match(POINTS, text):
        raise ValueError(f"not a list of points: {text}")
    p = [tuple(map(float, s.split(","))) for s in text.split()]
    return [p[0], (p[1][0], p[0][1]), p[1], (p[0][0], p[1][1])] if len(p) == 2 else p
