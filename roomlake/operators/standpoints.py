"""Random standpoints inside the hull of a scene's objects: the one generator that needs an order."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans.catalog import over_tables

# Heights over the floor, part of the hull, least distance and most alike direction, field of view.
HEIGHTS, HULL, APART, ALIKE, FOV = (0.7, 1.75), 0.7, 0.3, 0.85, 82.0
PAIRS = 1 << 20  # pairs of objects that are looked at at once, so that a scene's objects need memory in proportion to their number
COUNT = 64  # cameras of a scene; five times as many are drawn at most


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points in a plane, in order; fewer than three where they lie on a line."""
    rows = [tuple(p) for p in np.unique(points, axis=0)]

    def half(line: list) -> list:
        out: list = []
        for p in line:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(rows) + half(rows[::-1])) if len(rows) > 1 else np.array(rows)


class Draws:
    """Numbers in [0, 1) from the MD5 of a key and a count: the same in any order of scenes."""

    def __init__(self, key: str):
        self.key, self.n = key, 0

    def __call__(self) -> float:
        self.n += 1
        return int(hashlib.md5(f"{self.key}/{self.n}".encode()).hexdigest()[:13], 16) / 16**13

    def normal(self) -> float:
        return float(np.sqrt(-2 * np.log(1 - self())) * np.cos(2 * np.pi * self()))


def point_in(corners: np.ndarray, draw: Draws) -> np.ndarray:
    """A point of a convex shape, all parts alike: by triangles around the middle, each by its area."""
    middle = corners.mean(axis=0)
    a, b = corners - middle, np.roll(corners, -1, axis=0) - middle
    upto = np.cumsum(np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]))
    if upto[-1] <= 0:
        return middle
    k = min(int(np.searchsorted(upto, draw() * upto[-1])), len(corners) - 1)
    u, v = draw(), draw()
    if u + v > 1:
        u, v = 1 - u, 1 - v
    return middle + u * a[k] + v * b[k]


def best_target(place: np.ndarray, middles: np.ndarray, draw: Draws) -> np.ndarray | None:
    """A target: of one distance class, by lot, the object that brings most others into view, near its middle."""
    to = middles - place
    far = np.sqrt((to * to).sum(axis=1))
    ok = np.flatnonzero(far > 0.1)
    flat = np.sqrt((to[:, :2] ** 2).sum(axis=1))
    classes = [c for c in (ok[flat[ok] < 1], ok[(flat[ok] >= 1) & (flat[ok] < 2)], ok[flat[ok] >= 2]) if len(c)]
    if not classes:
        return None
    one = classes[int(draw() * len(classes))]
    unit = to[ok] / far[ok, None]
    ahead, rows = to[one] / far[one, None], max(1, PAIRS // len(ok))
    seen = np.concatenate([(ahead[i : i + rows] @ unit.T >= np.cos(np.radians(FOV / 2))).sum(axis=1) for i in range(0, len(one), rows)])
    x, y, z = middles[one[int(seen.argmax())]]
    return np.array([x + 0.05 * draw.normal(), y + 0.05 * draw.normal(), max(place[2] - 1.0, min(z, place[2] - 0.1)) + 0.02 * draw.normal()])


def scene_cameras(scene: str, objects: pd.DataFrame, count: int = COUNT) -> pd.DataFrame:
    """At most ``count`` cameras of a scene, each unlike those before it in place or direction."""
    names = ["scene_id", "name", "px", "py", "pz", "lx", "ly", "lz", "hfov"]
    objects = objects.sort_values(["ord", "id"])
    flat = objects[["x", "y"]].to_numpy(float)
    corners = hull(flat.mean(axis=0) + HULL * (flat - flat.mean(axis=0)))
    if len(objects) < 3 or len(corners) < 3:
        return pd.DataFrame([], columns=names)
    middles = np.column_stack([flat, objects["z"] + objects["height"].fillna(0) / 2])
    floor, draw = float(objects["z"].min()), Draws(scene)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    out = []
    for _ in range(5 * count):
        if len(out) == count:
            break
        x, y = point_in(corners, draw)
        place = np.array([x, y, floor + HEIGHTS[0] + draw() * (HEIGHTS[1] - HEIGHTS[0])])
        target = best_target(place, middles, draw)
        # looks are kept reflected through the place, as point-cloud cameras have them
        look = 2 * place - (middles[0] if target is None else target)
        ahead = (look - place) / max(1e-9, float(np.linalg.norm(look - place)))
        if any(np.linalg.norm(place - p) < APART and float(ahead @ a) > ALIKE for p, a in kept):
            continue
        kept.append((place, ahead))
        out.append((scene, f"rand_{len(out):03d}", *place, *look, FOV))
    return pd.DataFrame(out, columns=names)


def cameras_of(objects: DataFrame, count: int = COUNT) -> DataFrame:
    """Random cameras of every scene; a scene is one task, bounded by its objects."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return scene_cameras(pdf["scene_id"].iloc[0], pdf, count)

    return objects.select("scene_id", "id", "ord", "x", "y", "z", "height").groupBy("scene_id").applyInPandas(run, "scene_id string, name string, px double, py double, pz double, lx double, ly double, lz double, hfov double")


def random_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cameras_of(over_tables(spark, sf_dir, "objects"))


__all__ = ["cameras_of", "hull", "random_cameras", "scene_cameras"]
