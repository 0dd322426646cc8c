"""Coordinates, boxes, angles, costs and colours as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.config import DEFAULT, MapConfig

KEY_OFFSET = 32768
TREE_DEPTH = 16
AXES = ("x", "y", "z")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, (int, float)) else c


def square_distance(a: str, b: str) -> Column:
    """Of the points in columns a.x, a.y, a.z and b.x, ..., where a and b are aliases."""
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in AXES]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def distance(p: tuple, q: tuple) -> Column:
    d = [col(a) - col(b) for a, b in zip(p, q, strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def to_key(c, resolution: float = DEFAULT.resolution, depth: int = TREE_DEPTH) -> Column:
    """Voxel key of a coordinate; a smaller depth clears the low bits."""
    key = F.floor(col(c) / resolution) + KEY_OFFSET
    step = 1 << (TREE_DEPTH - depth)
    return key if step == 1 else key - F.pmod(key, F.lit(step))


def from_key(k, resolution: float = DEFAULT.resolution, depth: int = TREE_DEPTH) -> Column:
    """Centre of a key's voxel at a depth."""
    step = 1 << (TREE_DEPTH - depth)
    low = col(k) - F.pmod(col(k), F.lit(step)) if step > 1 else col(k)
    return (low - KEY_OFFSET + step / 2) * resolution


def packed_key(kx="kx", ky="ky", kz="kz") -> Column:
    return (col(kx).cast("long") * (1 << 16) + col(ky)) * (1 << 16) + col(kz)


def transform_point(r: str, t: str, p: tuple = AXES) -> list[Column]:
    """Rotation (array of 9) and translation (array of 3) applied to a point: out = R p + t."""
    return [sum((F.get(F.col(r), F.lit(3 * i + j)) * col(p[j]) for j in range(3)), F.get(F.col(t), F.lit(i))) for i in range(3)]


def inverse_point(r: str, t: str, p: tuple = AXES) -> list[Column]:
    """The inverse of a rigid transform: R' (p - t)."""
    d = [col(p[j]) - F.get(F.col(t), F.lit(j)) for j in range(3)]
    return [sum((F.get(F.col(r), F.lit(3 * j + i)) * d[j] for j in range(1, 3)), F.get(F.col(r), F.lit(i)) * d[0]) for i in range(3)]


def to_frame(points: DataFrame, transforms: DataFrame, target: str) -> DataFrame:
    """points(frame, x, y, z, ...) in the target frame; where no transform is known the message says so and x, y, z are null."""
    known = transforms.where(F.col("target") == target).select(F.col("source").alias("frame"), "r", "t")
    identity = F.col("frame") == target
    joined = points.join(known, "frame", "left")
    moved = {c: F.when(identity, F.col(c)).otherwise(m) for c, m in zip(AXES, transform_point("r", "t"), strict=True)}
    message = F.when(identity | F.col("r").isNotNull(), F.lit(None).cast("string")).otherwise("transform failed")
    return joined.withColumns(moved | {"message": message}).drop("r", "t")


def inside_box(low: tuple, high: tuple, p: tuple = AXES) -> Column:
    """Strictly inside a metric box."""
    out = F.lit(True)
    for a, lo, hi in zip(p, low, high, strict=True):
        out = out & (col(a) > lo) & (col(a) < hi)
    return out


def expanded(low: tuple, high: tuple, by: float) -> tuple[tuple, tuple]:
    """A box wider by the same length on all sides."""
    return tuple(c - by for c in low), tuple(c + by for c in high)


def inside_key_box(centre: tuple, half: float, resolution: float = DEFAULT.resolution, keys: tuple = ("kx", "ky", "kz")) -> Column:
    """Inside a box of keys, borders included."""
    low = lambda c: math.floor((c - half) / resolution) + KEY_OFFSET
    high = lambda c: math.floor((c + half) / resolution) + KEY_OFFSET
    out = F.lit(True)
    for k, c in zip(keys, centre, strict=True):
        out = out & col(k).between(low(c), high(c))
    return out


def bounds(points: DataFrame) -> DataFrame:
    """Bounding box of the points, zeros if there are none."""
    return points.agg(*(F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for c in AXES for n, f in (("min", F.min), ("max", F.max))))


def beyond_wall(wall: tuple, outward: tuple) -> Column:
    """Outside the half-space of a staging area."""
    return sum(((col(a) - w) * o for a, w, o in zip(AXES, wall, outward, strict=True)), F.lit(0.0)) > 0


def block_axes(alpha, beta=0.0) -> list[list[Column]]:
    """Three unit axes of a block from its yaw and pitch."""
    a, b = col(alpha), col(beta)
    zero = F.lit(0.0)
    return [[F.cos(a) * F.cos(b), F.sin(a) * F.cos(b), F.sin(b)], [-F.sin(a), F.cos(a), zero], [-F.cos(a) * F.sin(b), -F.sin(a) * F.sin(b), F.cos(b)]]


def block_angles(x, y, z) -> list[Column]:
    """Yaw and pitch of a block's first axis."""
    return [F.atan2(col(y), col(x)), F.atan2(col(z), F.sqrt(col(x) * col(x) + col(y) * col(y)))]


def heading(x, y) -> Column:
    return F.atan2(col(y), col(x))


def unsafety(radius, config: MapConfig = DEFAULT) -> Column:
    """Squared share of the safe range that a radius lacks; over 1 below the least safe radius."""
    lack = 1 - F.least((col(radius) - config.min_safe) / (config.full_safe - config.min_safe), F.lit(1.0))
    return lack * lack


def connectable(square, r1, r2, config: MapConfig = DEFAULT) -> Column:
    reach = col(r1) + col(r2) - config.reserve
    return col(square) < reach * reach


def linear_safety_cost(odist, low: float, base: float) -> Column:
    """Cost of one path point: 0 from `base` on, 1 at `low` and below."""
    return F.when(col(odist) < base, 1 - F.greatest((col(odist) - low) / (base - low), F.lit(0.0))).otherwise(0.0)


def ellipsoid_inside(p: tuple, centre: tuple, axes: list[tuple], lengths: tuple) -> Column:
    d = [col(a) - c for a, c in zip(p, centre, strict=True)]
    total = F.lit(0.0)
    for axis, length in zip(axes, lengths, strict=True):
        along = sum((x * a for x, a in zip(d, axis, strict=True)), F.lit(0.0)) / length
        total = total + along * along
    return total <= 1


def ellipsoid_volume(a, b, c) -> Column:
    """With the factor 0.75 pi that the map uses (the true one is 4/3 pi)."""
    return 0.75 * math.pi * col(a) * col(b) * col(c)


def ellipsoid_radius(a, b, c) -> Column:
    return F.cbrt(col(a) * col(b) * col(c))


def heat_color(h) -> list[Column]:
    """Red, green, blue of a hue in [0, 1) at full saturation."""
    h6 = col(h) * 6
    i = F.floor(h6)
    f = h6 - i
    pick = lambda *v: F.when(i == 0, v[0]).when(i == 1, v[1]).when(i == 2, v[2]).when(i == 3, v[3]).when(i == 4, v[4]).otherwise(v[5])
    one, zero = F.lit(1.0), F.lit(0.0)
    return [pick(one, 1 - f, zero, zero, f, one), pick(f, one, one, 1 - f, zero, zero), pick(zero, zero, f, one, one, 1 - f)]


#: Fixed number of colours that segments cycle through; hues are spread evenly.
PALETTE = 10


def segment_color(segment) -> list[Column]:
    return heat_color((col(segment) % PALETTE) / float(PALETTE))


def cylinder_samples(spark, n: int, dr: float, dz: float, circles: int, layers: int) -> DataFrame:
    """Offsets (layer, circle, i, x, y, z) on circles of growing radius in layers around the middle one."""
    frame = spark.range(2 * layers - 1).select((F.col("id") - (layers - 1)).alias("layer"))
    frame = frame.join(spark.range(1, circles).select(F.col("id").alias("circle"))).join(spark.range(n).select(F.col("id").alias("i")))
    angle = F.col("i") * (2 * math.pi / n)
    return frame.select("layer", "circle", "i", (F.col("circle") * dr * F.cos(angle)).alias("x"), (F.col("circle") * dr * F.sin(angle)).alias("y"), (F.col("layer") * dz).alias("z"))


def fibonacci_directions(spark, n: int) -> DataFrame:
    """n unit directions (i, dx, dy, dz), spread evenly without randomness."""
    z = 1 - (2 * F.col("id") + 1) / n
    r = F.sqrt(1 - z * z)
    a = F.col("id") * (math.pi * (3 - math.sqrt(5)))
    return spark.range(n).select(F.col("id").alias("i"), (r * F.cos(a)).alias("dx"), (r * F.sin(a)).alias("dy"), z.alias("dz"))


def ball_points(spark, n: int, radius: float, shell: float = 0.0) -> DataFrame:
    """n points in a ball of the radius, or between shell and radius, from fixed low-discrepancy numbers."""
    share = F.pmod((F.col("i") + 0.5) * 0.7548776662466927, F.lit(1.0))
    r = F.cbrt(shell**3 + share * (radius**3 - shell**3))
    return fibonacci_directions(spark, n).select("i", (F.col("dx") * r).alias("x"), (F.col("dy") * r).alias("y"), (F.col("dz") * r).alias("z"))


def camera_ends(spark, n: int, corner: tuple[float, float, float], optic: bool = False) -> DataFrame:
    """n ray ends (i, x, y, z) spread over a camera's view with that corner, from fixed low-discrepancy numbers in place of
    random ones: at depth x (optic frames: z) and between plus and minus the corner in the other two axes."""
    u = F.pmod((F.col("id") + 0.5) * 0.7548776662466927, F.lit(1.0)) * 2 - 1
    v = F.pmod((F.col("id") + 0.5) * 0.5698402909980532, F.lit(1.0)) * 2 - 1
    x, y, z = (F.lit(float(c)) for c in corner)
    return spark.range(n).select(F.col("id").alias("i"), *((x * u, y * v, z) if optic else (x, y * u, z * v))).toDF("i", *AXES)
