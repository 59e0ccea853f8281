"""Lines of sight against a scene of triangles, and un-projection of fisheye pixels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dot, minus, norm, transform, vec
from ..sources.scratch import checkpointed

MIN_RAY, TOLERANCE = 1e-6, 0.02


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def hit_distance(origin: Column, way: Column, v0: Column, v1: Column, v2: Column) -> Column:
    """How far along a unit way a triangle is hit (Moeller and Trumbore); null if it isn't."""
    e1, e2 = minus(v1, v0), minus(v2, v0)
    p = cross(way, e2)
    det = dot(e1, p)
    t = minus(origin, v0)
    u = dot(t, p) / det
    q = cross(t, e1)
    v, far = dot(way, q) / det, dot(e2, q) / det
    return F.when((F.abs(det) > 1e-12), F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (far > 1e-9), far))


def crossed_cells(origin: Column, target: Column, size: Column) -> Column:
    """The grid cells (x, y, z) that a segment passes, each once.

    The segment is cut where it crosses the grid's planes, axis by axis; each cut's middle tells its cell. They are one more than the planes crossed, at most.
    """

    def crossings(axis: str) -> Column:
        a, b = origin[axis] / size, target[axis] / size
        low, high = F.floor(F.least(a, b)) + 1, F.floor(F.greatest(a, b))
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda plane: (plane - a) / (b - a))).otherwise(F.array().cast("array<double>"))

    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings("x"), crossings("y"), crossings("z"))))
    middles = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts)), lambda p, q: (p + q) / 2)
    return F.array_distinct(F.transform(middles, lambda m: F.struct(*(F.floor((origin[c] + m * (target[c] - origin[c])) / size).alias(c) for c in "xyz"))))


def _blocked(rays: DataFrame, triangles: DataFrame, scene: str, least: float) -> DataFrame:
    """(scene, key, _ray) of the rays that one of the triangles blocks.

    Grids of cells of `least`, twice that, four times and so on: a triangle is listed in the grid whose cells are as large as its extent, hence in eight cells at most, and a ray in
    the cells that it passes in each grid that its scene uses, within the box of the grid's triangles. So neither a scene nor the box around a ray is met as a whole.
    """
    # A little more than the triangle, so that rounding of a ray's cells on a face loses nothing.
    size, room = F.lit(float(least)) * F.pow(F.lit(2.0), F.col("_grid")), 1e-6
    corner = lambda f, c: f(*(F.col(v)[c] for v in ("v0", "v1", "v2")))
    spread = lambda c: F.sequence(F.floor(corner(F.least, c) / size - room), F.floor(corner(F.greatest, c) / size + room))
    box = [f(corner(g, c)).alias(f"_{n}{c}") for f, g, n in ((F.min, F.least, "low"), (F.max, F.greatest, "high")) for c in "xyz"]
    grids = triangles.groupBy(scene, "_grid").agg(*box)  # a few of each scene
    tri = triangles
    for c in "xyz":
        tri = tri.withColumn(f"_{c}", F.explode(spread(c)))
    # What a ray passes of the box, with a cell around it.
    o, w = F.col("origin"), {c: F.col("target")[c] - F.col("origin")[c] for c in "xyz"}
    at = {c: [F.when(w[c] != 0, (F.col(f"_{n}{c}") + sign * size - o[c]) / w[c]) for n, sign in (("low", -1), ("high", 1))] for c in "xyz"}
    enter = F.greatest(F.lit(0.0), *(F.least(*at[c]) for c in "xyz"))
    leave = F.least(F.lit(1.0), *(F.greatest(*at[c]) for c in "xyz"))
    # A partition's number in a step keeps Spark from putting its expressions into the next one over and over.
    step = F.spark_partition_id().alias("_step")
    again = (F.col("_step") + F.spark_partition_id()).alias("_step")
    met = rays.join(F.broadcast(grids), scene).select("*", enter.alias("_enter"), leave.alias("_leave"), step).where("_enter <= _leave")
    part = lambda t: vec(*(o[c] + F.col(t) * w[c] for c in "xyz"))
    met = met.select(scene, "key", "_ray", "origin", "_way", "_len", "_grid", part("_enter").alias("_from"), part("_leave").alias("_to"), size.alias("_size"), again)
    met = met.withColumn("_cell", F.explode(crossed_cells(F.col("_from"), F.col("_to"), F.col("_size")))).where("_step >= 0")
    met = met.select(scene, "key", "_ray", "origin", "_way", "_len", "_grid", *(F.col("_cell")[c].alias(f"_{c}") for c in "xyz"))
    cell = [scene, "_grid", "_x", "_y", "_z"]
    flat = lambda name, of: [of[c].alias(f"_{name}{c}") for c in "xyz"]
    tri = tri.select(*cell, *flat("v", F.col("v0")), *flat("e", minus(F.col("v1"), F.col("v0"))), *flat("f", minus(F.col("v2"), F.col("v0"))))
    hits = met.select(*cell, "key", "_ray", "_len", *flat("o", F.col("origin")), *flat("w", F.col("_way"))).join(tri, cell)
    # hit_distance in steps: as one condition of the join it would repeat its parts.
    triple = lambda n: vec(*(F.col(f"_{n}{c}") for c in "xyz"))
    told = [scene, "key", "_ray", "_len"]
    hits = hits.select(*told, *(f"_{n}{c}" for n in "wef" for c in "xyz"), *flat("p", cross(triple("w"), triple("f"))), *flat("t", minus(triple("o"), triple("v"))), step)
    hits = hits.select(*told, *(f"_{n}{c}" for n in "wefpt" for c in "xyz"), *flat("q", cross(triple("t"), triple("e"))), dot(triple("e"), triple("p")).alias("_det"), again).where(F.abs("_det") > 1e-12)
    u, v, far = (dot(triple(a), triple(b)) / F.col("_det") for a, b in ("tp", "wq", "fq"))
    hits = hits.select(*told, u.alias("_u"), v.alias("_v"), far.alias("_far"), again)
    inside = (F.col("_u") >= 0) & (F.col("_v") >= 0) & (F.col("_u") + F.col("_v") <= 1) & (F.col("_far") > 1e-9)
    return hits.where(inside & (F.col("_step") >= 0) & (F.col("_far") < F.col("_len") - TOLERANCE)).select(scene, "key", "_ray").distinct()


def occluded_fraction(rays: DataFrame, triangles: DataFrame, scene: str, least: float = 0.125, first: int = 256, growth: int = 16) -> DataFrame:
    """(key, n_rays, n_blocked, fraction): rays(scene, key, origin, target) against triangles(scene, v0, v1, v2).

    A ray is blocked if the nearest triangle is hit before its target, less a tolerance; no hit is no block; rays shorter than 1e-6 count nowhere.

    Any triangle before the target blocks, so rays meet about `first` triangles of their scene first, drawn by a hash, those that nothing blocks yet meet `growth` times as many others, and so on to the last one. In a
    dense scene most rays are done after few triangles, and what passes through a thin one meets few in the cells of its way.
    """
    parts = int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = rays.withColumn("_len", norm(minus(F.col("target"), F.col("origin")))).where(F.col("_len") >= MIN_RAY)
    long = long.withColumn("_way", vec(*((F.col("target")[c] - F.col("origin")[c]) / F.col("_len") for c in "xyz"))).withColumn("_ray", F.xxhash64("key", "origin", "target"))
    long = checkpointed(long.select(scene, "key", "origin", "target", "_len", "_way", "_ray").repartition(parts, "_ray"))
    corner = lambda f, c: f(*(F.col(v)[c] for v in ("v0", "v1", "v2")))
    extent = F.greatest(*(corner(F.greatest, c) - corner(F.least, c) for c in "xyz"))
    grid = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(1e-9)) / least))).cast("int")
    sizes = triangles.groupBy(scene).agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64("v0", "v1", "v2"), F.lit(2**30)) / F.lit(float(2**30)) * F.col("_n")
    tri = checkpointed(triangles.join(sizes, scene).select(scene, "v0", "v1", "v2", grid.alias("_grid"), place.alias("_place")).repartition(parts, "_place"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    blocked, left, low, high = None, long, 0, first
    while True:
        now = tri.where((F.col("_place") >= low) & (F.col("_place") < high)) if high < most else tri.where(F.col("_place") >= low)
        found = checkpointed(_blocked(left, now, scene, least))
        blocked = found if blocked is None else blocked.unionByName(found)
        if high >= most:
            break
        left = checkpointed(left.join(found.select(scene, "_ray"), [scene, "_ray"], "left_anti"))
        low, high = high, high * growth
    counts = blocked.groupBy(scene, "key").agg(F.count("*").alias("n_blocked"))
    every = long.select(scene, "key", "_ray").distinct().groupBy(scene, "key").agg(F.count("*").alias("n_rays"))
    return every.join(counts, [scene, "key"], "left").fillna(0, ["n_blocked"]).withColumn("fraction", F.round(F.col("n_blocked") / F.col("n_rays"), 6))


def unprojected(u: pd.Series, v: pd.Series, params: Sequence[float], valid_radius: float | None = None) -> np.ndarray:
    """Unit directions of pixels under the fisheye model, by Newton steps on its published equations; NaN outside the valid radius or without convergence."""
    f, cu, cv, k, (p0, p1), s = params[0], params[1], params[2], np.array(params[3:9]), params[9:11], params[11:15]
    target = np.stack([(u.to_numpy(float) - cu) / f, (v.to_numpy(float) - cv) / f])

    def distorted(x: np.ndarray) -> np.ndarray:
        r = x[0] * x[0] + x[1] * x[1]
        return np.stack([
            x[0] + (2 * x[0] * x[0] + r) * p0 + 2 * x[0] * x[1] * p1 + s[0] * r + s[1] * r * r,
            x[1] + (2 * x[1] * x[1] + r) * p1 + 2 * x[0] * x[1] * p0 + s[2] * r + s[3] * r * r,
        ])

    x = target.copy()
    for _ in range(12):
        step, h = target - distorted(x), 1e-6
        jx, jy = (distorted(x + np.array([[h], [0]])) - distorted(x)) / h, (distorted(x + np.array([[0], [h]])) - distorted(x)) / h
        det = jx[0] * jy[1] - jy[0] * jx[1]
        x = x + np.stack([(step[0] * jy[1] - step[1] * jy[0]) / det, (jx[0] * step[1] - jx[1] * step[0]) / det])
    bent = np.hypot(x[0], x[1])
    theta, powers = bent.copy(), 2 * np.arange(1, 7)
    for _ in range(20):
        value = theta * (1 + sum(a * theta**n for a, n in zip(k, powers, strict=True))) - bent
        slope = 1 + sum((n + 1) * a * theta**n for a, n in zip(k, powers, strict=True))
        theta = theta - value / slope
    safe = np.where(bent < 1e-12, 1.0, bent)
    out = np.stack([np.sin(theta) * x[0] / safe, np.sin(theta) * x[1] / safe, np.cos(theta)], axis=1)
    bad = ~np.isfinite(out).all(1) | (np.abs(distorted(x) - target).max(0) > 1e-6)
    if valid_radius is not None:
        bad |= np.hypot(u.to_numpy(float) - cu, v.to_numpy(float) - cv) > valid_radius
    out[bad] = np.nan
    return out


def pixel_directions(params: Sequence[float], valid_radius: float | None = None):
    """A vectorised function of columns u and v: the unit direction of a pixel as a struct x, y, z of NaN where there is none."""

    @F.pandas_udf("x double, y double, z double")
    def direction(u: pd.Series, v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(unprojected(u, v, params, valid_radius), columns=["x", "y", "z"])

    return direction


def back_projected(direction: Column, depth: Column, world_from_camera: Column) -> Column:
    """The world point along a direction at a depth of its z; null without a direction."""
    scale = depth / direction["z"]
    point = vec(direction["x"] * scale, direction["y"] * scale, direction["z"] * scale)
    return F.when(~F.isnan(direction["z"]) & (direction["z"] > 1e-9), transform(world_from_camera, point))


def occlusion_flags(samples: DataFrame, fractions: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """samples with occluded_fraction and geometrically_occluded; both null where nothing was tested."""
    return samples.join(fractions.select(*keys, F.col("fraction").alias("occluded_fraction")), list(keys), "left").withColumn("geometrically_occluded", F.col("occluded_fraction") >= threshold)
