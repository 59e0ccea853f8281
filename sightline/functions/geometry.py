"""Geometry of poses, pixels, boxes and directions, as Column expressions that stay inside code generation.

A vector is a struct of doubles x, y, z; a pixel one of u, v; a pose is a 3x4 matrix as an array of twelve doubles in rows.
Whatever can't be computed is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the camera model and of the label rules.
MIN_DEPTH, MIN_RADIUS = 1e-9, 1e-12
PROXIMITY_DECAY, MIN_NORM = 1.5, 1e-6
QUADRANT_MARGIN, QUADRANT_ANGLE = 0.05, 5.0
CLOSE, MEDIUM = 1.0, 1.5
LOOSE_MARGIN = 0.03
IMAGE_SIZE = 1408.0


def vec(x, y, z) -> Column:
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(as_col(x).alias("x"), as_col(y).alias("y"), as_col(z).alias("z"))


def _xyz(v: Column) -> tuple[Column, Column, Column]:
    return v["x"], v["y"], v["z"]


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def minus(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    """L2 distance."""
    return norm(minus(a, b))


def to_4x4(pose: Column) -> Column:
    """A pose with the row 0, 0, 0, 1."""
    return F.concat(pose, F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0))))


def compose(a: Column, b: Column) -> Column:
    """The pose that applies b, then a."""
    cell = lambda i, j: sum((a[4 * i + k] * b[4 * k + j] for k in range(3)), a[4 * i + 3] if j == 3 else F.lit(0.0))
    return F.array(*(cell(i, j) for i in range(3) for j in range(4)))


def invert(p: Column) -> Column:
    """The inverse of a rigid pose: the transposed rotation, and the translation turned back."""
    back = lambda i: -(p[i] * p[3] + p[4 + i] * p[7] + p[8 + i] * p[11])
    return F.array(*(x for i in range(3) for x in (p[i], p[4 + i], p[8 + i], back(i))))


def position(pose: Column) -> Column:
    """The translation of a pose."""
    return vec(pose[3], pose[7], pose[11])


def camera_position(camera_from_world: Column) -> Column:
    """Where the camera stands in the world: the translation of the inverse pose."""
    return position(invert(camera_from_world))


def transform(pose: Column, v: Column) -> Column:
    x, y, z = _xyz(v)
    row = lambda i: pose[4 * i] * x + pose[4 * i + 1] * y + pose[4 * i + 2] * z + pose[4 * i + 3]
    return vec(row(0), row(1), row(2))


def rotate(pose: Column, v: Column) -> Column:
    x, y, z = _xyz(v)
    row = lambda i: pose[4 * i] * x + pose[4 * i + 1] * y + pose[4 * i + 2] * z
    return vec(row(0), row(1), row(2))


def project_fisheye(v: Column, params: Sequence[Column | float] | Column) -> Column:
    """The pixel of a camera-space point under the fisheye model with 6 radial, 2 tangential and 4 thin-prism terms.

    params: f, cu, cv, k0..k5, p0, p1, s0..s3. Null at a depth of 1e-9 or less; a point on the axis has the principal point.
    """
    p = [params[i] if isinstance(params, Column) else x for i, x in enumerate(range(15) if isinstance(params, Column) else params)]
    f, cu, cv = (F.lit(x) for x in p[:3])
    radial, (p0, p1), (s0, s1, s2, s3) = p[3:9], p[9:11], p[11:15]
    a, b = v["x"] / v["z"], v["y"] / v["z"]
    r = F.hypot(a, b)
    theta = F.atan(r)
    # The expression is one tree, so what it repeats is kept small: powers of the angle instead of nested products, the bent radius for x * x + y * y, no terms of 0.
    there = lambda terms: [(k, x) for k, x in terms if isinstance(k, Column) or k]
    bent = theta
    for k, power in there((k, 2 * n + 3) for n, k in enumerate(radial)):
        bent = bent + F.lit(k) * F.pow(theta, F.lit(float(power)))
    x, y, rr = a * bent / r, b * bent / r, bent * bent
    u, w = x, y
    for k, term in there([(p0, 2 * x * x + rr), (p1, 2 * x * y), (s0, rr), (s1, F.pow(bent, F.lit(4.0)))]):
        u = u + F.lit(k) * term
    for k, term in there([(p1, 2 * y * y + rr), (p0, 2 * x * y), (s2, rr), (s3, F.pow(bent, F.lit(4.0)))]):
        w = w + F.lit(k) * term
    pixel = lambda u, w: F.struct(u.cast("double").alias("u"), w.cast("double").alias("v"))
    return F.when(v["z"] > MIN_DEPTH, F.when(r < MIN_RADIUS, pixel(cu, cv)).otherwise(pixel(f * u + cu, f * w + cv)))


def in_image(pixel: Column, width, height) -> Column:
    """0 <= u < width and 0 <= v < height; false for a null pixel."""
    u, v = pixel["u"], pixel["v"]
    return F.coalesce((u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def in_valid_circle(pixel: Column, width, height, radius) -> Column:
    """The nearest pixel lies within the lens circle around the image's centre; false outside the image or for a null pixel."""
    u, v = F.rint(pixel["u"]), F.rint(pixel["v"])
    inside = (u >= 0) & (u < width) & (v >= 0) & (v < height)
    cx, cy = (F.lit(width) - 1) / 2.0, (F.lit(height) - 1) / 2.0
    return F.coalesce(inside & ((u - cx) * (u - cx) + (v - cy) * (v - cy) <= radius * radius), F.lit(False))


def inside_margin(pixel: Column, width, height, ratio: float = 0.1) -> Column:
    """The pixel lies in the image shrunk by a share of its size on every side, edges included."""
    w, h = F.lit(width) * ratio, F.lit(height) * ratio
    return F.coalesce(pixel["u"].between(w, F.lit(width) - w) & pixel["v"].between(h, F.lit(height) - h), F.lit(False))


def normalised_pixel(pixel: Column, width=IMAGE_SIZE, height=IMAGE_SIZE) -> Column:
    return F.when(pixel.isNotNull() & (F.lit(width) > 0) & (F.lit(height) > 0), F.struct((pixel["u"] / width).alias("u"), (pixel["v"] / height).alias("v")))


def rescaled_pixel(pixel: Column, width, height, to_width, to_height) -> Column:
    return F.struct((pixel["u"] * to_width / width).alias("u"), (pixel["v"] * to_height / height).alias("v"))


def sample_pixels(box: Sequence[Column], many: bool = True) -> Column:
    """Pixels of a box x1, y1, x2, y2 to look along: its centre, and with many its corners and the middles of its edges."""
    x1, y1, x2, y2 = box
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    points = [(cx, cy)] + ([(x1, y1), (x2, y1), (x2, y2), (x1, y2), (cx, y1), (x2, cy), (cx, y2), (x1, cy)] if many else [])
    return F.array(*(F.struct(u.cast("double").alias("u"), v.cast("double").alias("v")) for u, v in points))


def gaze_cosine(gaze: Column, camera: Column, target: Column) -> Column:
    """The cosine of the gaze and the way from camera to target; -1 if either is shorter than 1e-6."""
    way = minus(target, camera)
    return F.when((norm(gaze) < MIN_NORM) | (norm(way) < MIN_NORM), -1.0).otherwise(dot(gaze, way) / (norm(gaze) * norm(way)))


def proximity(d: Column) -> Column:
    """exp(-d / 1.5)."""
    return F.exp(-d / PROXIMITY_DECAY)


def interaction(gaze: Column, camera: Column, target: Column) -> Column:
    """How much a look is on a target: the cosine where positive, times proximity."""
    return F.greatest(F.lit(0.0), gaze_cosine(gaze, camera, target)) * proximity(distance(camera, target))


def anchored(camera_from_world: Column, a: Column, b: Column) -> Column:
    """The way from b to a along the camera's axes."""
    return rotate(camera_from_world, minus(a, b))


def quadrant(v: Column) -> Column:
    """Front/Back and left/right of an anchored vector; null if it is too near an axis."""
    x, z = v["x"], v["z"]
    side = F.abs(F.abs(F.degrees(F.atan2(x, z))) - 90)
    label = F.concat(F.when(z > 0, "Front").otherwise("Back"), F.when(x > 0, "-right").otherwise("-left"))
    return F.when(~((F.abs(z) < QUADRANT_MARGIN) | (F.abs(x) < QUADRANT_MARGIN) | (side < QUADRANT_ANGLE)), label)


def quadrant_rejection(v: Column) -> Column:
    """Why a vector has no quadrant, in the order of the checks: z, x, angle; null if it has one."""
    x, z = v["x"], v["z"]
    side = F.abs(F.abs(F.degrees(F.atan2(x, z))) - 90)
    return F.when(F.abs(z) < QUADRANT_MARGIN, "z").when(F.abs(x) < QUADRANT_MARGIN, "x").when(side < QUADRANT_ANGLE, "angle")


def distance_bucket(d: Column) -> Column:
    return F.when(d < CLOSE, "close").when(d < MEDIUM, "medium").when(d.isNotNull(), "far")


def dominant_axis(v: Column) -> Column:
    """The six-way label of the axis with the largest part; of equal parts y comes before x before z."""
    x, y, z = _xyz(v)
    return (
        F.when((F.abs(y) >= F.abs(x)) & (F.abs(y) >= F.abs(z)), F.when(y > 0, "above").otherwise("below"))
        .when(F.abs(x) >= F.abs(z), F.when(x > 0, "to the right").otherwise("to the left"))
        .when(z.isNotNull(), F.when(z > 0, "in front of").otherwise("behind"))
    )


def second_axis(v: Column, margin: float = 10.0) -> Column:
    """The label of the second largest part (of equal ones x, y, z in order) if its angle to the largest is within margin degrees of 45; else null."""
    x, y, z = _xyz(v)
    parts = F.array_sort(
        F.array(*(F.struct((-F.abs(c)).alias("m"), F.lit(i).alias("i"), c.alias("c")) for i, c in enumerate((x, y, z))))
    )
    top, second = parts[0], parts[1]
    angle = F.degrees(F.atan(F.abs(second["c"]) / F.abs(top["c"])))
    names = (("to the right", "to the left"), ("above", "below"), ("in front of", "behind"))
    label = F.lit(None).cast("string")
    for i, (plus, minus_) in enumerate(names):
        label = F.when(second["i"] == i, F.when(second["c"] > 0, plus).otherwise(minus_)).otherwise(label)
    return F.when((F.abs(top["c"]) > 1e-12) & (F.abs(angle - 45) <= margin + 1e-12), label)


def heading(pose: Column) -> Column:
    """Degrees of the camera's forward axis in the ground plane; null if it points straight up or down."""
    x, y = -pose[2], -pose[6]
    return F.when(F.sqrt(x * x + y * y) >= 1e-8, F.degrees(F.atan2(y, x)))


def wrapped(angle: Column) -> Column:
    """An angle of degrees in (-180, 180]."""
    turned = angle - 360.0 * F.floor((angle + 180.0) / 360.0)
    return F.when(turned == -180.0, 180.0).otherwise(turned)


def rotation_label(delta: Column, threshold: float = 8.0) -> Column:
    """Five labels of a signed heading change: none, and left or right by about 10 or 20 degrees."""
    side = F.when(delta > 0, "left").otherwise("right")
    size = F.when(F.abs(delta) < 15.0, ", about 10 degrees").otherwise(", about 20 degrees")
    return F.when(F.abs(delta) < threshold, "no significant rotation").when(delta.isNotNull(), F.concat(side, size))


def off_boundaries(delta: Column, boundaries: Sequence[float] = (8.0, 15.0, 25.0), margin: float = 2.0) -> Column:
    """No boundary is within the margin of the angle's size."""
    return F.forall(F.array(*(F.lit(float(b)) for b in boundaries)), lambda b: F.abs(F.abs(delta) - b) >= margin)


def side_label(delta: Column, threshold: float = 8.0) -> Column:
    return F.when(F.abs(delta) < threshold, "no significant rotation").when(delta > 0, "left").when(delta.isNotNull(), "right")


def yaw_delta(ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """Signed degrees from direction a to direction b in a plane."""
    return F.degrees(F.atan2(ax * bz - az * bx, ax * bx + az * bz))


def turn_label(delta: Column, none: float = 15.0, back: float = 135.0) -> Column:
    return F.when(F.abs(delta) <= none, "none").when(F.abs(delta) >= back, "back").when(delta > 0, "left").when(delta.isNotNull(), "right")


def bearing_label(x: Column, z: Column, back: float = 135.0) -> Column:
    """behind if the point lies back and at least 180 - back degrees from straight ahead, else left or right."""
    return F.when((z < 0) & (F.degrees(F.atan2(F.abs(x), z)) >= 180.0 - back), "behind").when(x < 0, "left").when(x.isNotNull(), "right")


def inside_box(v: Column, low: Column, high: Column, margin: float = 0.0) -> Column:
    """The point lies in the axis-aligned box grown by the margin, faces included; low and high are arrays."""
    return F.coalesce(
        v["x"].between(low[0] - margin, high[0] + margin) & v["y"].between(low[1] - margin, high[1] + margin) & v["z"].between(low[2] - margin, high[2] + margin),
        F.lit(False),
    )


def containment(openable: Column, strict: Column, loose: Column) -> Column:
    return F.when(~openable, "not_applicable").when(strict, "inside_strict").when(loose, "inside_loose").otherwise("outside")


def containment_score(v: Column, low: Column, high: Column) -> Column:
    """As shares of the box's size on each axis: inside, the least distance to a face; outside, minus the largest overshoot."""
    size = [F.greatest(high[i] - low[i], F.lit(1e-9)) for i in range(3)]
    inner = [F.least(v[c] - low[i], high[i] - v[c]) / size[i] for i, c in enumerate("xyz")]
    over = [F.greatest(low[i] - v[c], v[c] - high[i], F.lit(0.0)) / size[i] for i, c in enumerate("xyz")]
    return F.when(inside_box(v, low, high), F.least(*inner)).otherwise(-F.greatest(*over))


def region_around(pixel: Column, size: Column, scale: float, slack: Column, width: int, height: int) -> Column:
    """The square of pixels to search: the rounded centre and half the scaled size plus slack (cut to an integer), clipped to the image."""
    half = (0.5 * scale * size + slack).cast("int")
    u, v = F.rint(pixel["u"]).cast("int"), F.rint(pixel["v"]).cast("int")
    clip = lambda c, most: F.greatest(F.lit(0), F.least(c, F.lit(most)))
    return F.struct(clip(u - half, width).alias("x1"), clip(v - half, height).alias("y1"), clip(u + half, width).alias("x2"), clip(v + half, height).alias("y2"))


def expected_size(last_seen: Column, expected: Column) -> Column:
    """The last seen box's larger side, else the expected size, else none."""
    return F.coalesce(last_seen, expected, F.lit(0.0))


def box_area(box: Column) -> Column:
    return F.greatest(F.lit(0), box["x2"] - box["x1"]) * F.greatest(F.lit(0), box["y2"] - box["y1"])


def box_centre(box: Column) -> Column:
    return F.struct(((box["x1"] + box["x2"]) / 2.0).alias("u"), ((box["y1"] + box["y2"]) / 2.0).alias("v"))


def centre_score(d: Column, scale: Column) -> Column:
    """1 at no distance, falling to 0 at the scale (at least 1)."""
    return F.greatest(F.lit(0.0), 1.0 - d / F.greatest(scale, F.lit(1.0)))


def size_score(ratio: Column) -> Column:
    """exp(-|ln ratio| / 1.2)."""
    return F.exp(-F.abs(F.log(ratio)) / 1.2)


def disagreement(visible_claim: Column, rate: Column) -> Column:
    """How far a detection rate is from a claim: 1 - rate of a claim to be visible, rate of one not to be, null without a claim."""
    return F.when(visible_claim, 1.0 - rate).when(~visible_claim, rate)
