"""Image arithmetic over tables of pixels(keys..., px, py, value): gray values, blur, resampling.

keys name an image (video, frame). No image is held as a whole: a blur needs the pixels of a line and then those of
a column, the rest works pixel by pixel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of red, green and blue in a gray value (fixed values).
GRAY = (0.299, 0.587, 0.114)
#: Weights of short kernels without a deviation of their own (fixed values).
SHORT = {1: (1.0,), 3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625), 7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)}


def nearest(value: Column) -> Column:
    """The whole number next to a value that isn't negative; halves go up."""
    return F.floor(value + 0.5).cast("int")


def grayscale(pixels: DataFrame, red: str = "r", green: str = "g", blue: str = "b") -> DataFrame:
    """Adds value, the gray value (0 to 255) of three channels, and drops these."""
    total = sum((F.col(c) * w for c, w in zip((green, blue), GRAY[1:], strict=True)), F.col(red) * GRAY[0])
    return pixels.withColumn("value", nearest(total)).drop(red, green, blue)


def gaussian(size: int, sigma: float = 0.0) -> tuple[float, ...]:
    """The weights of a kernel of an odd size; without a deviation, the fixed ones or one that goes with the size."""
    if size < 1 or size % 2 == 0:
        raise ValueError(f"a kernel has an odd size, not {size}")
    if sigma <= 0 and size in SHORT:
        return SHORT[size]
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return tuple(x / sum(raw) for x in raw)


def _smoothed(pixels: DataFrame, keys: list[str], along: str, across: str, length: int, taps: tuple[float, ...]) -> DataFrame:
    reach = len(taps) // 2
    if reach >= length:
        raise ValueError(f"a kernel of {len(taps)} is too large for {length} pixels")
    line = Window.partitionBy(*keys, across).orderBy(along)
    at = F.col(along)
    weights = F.array(*map(F.lit, taps))

    def tap(i: Column) -> Column:
        return F.when(i.between(-reach, reach), F.try_element_at(weights, i.cast("int") + reach + 1)).otherwise(0.0)

    total = F.lit(0.0)
    for d in range(-reach, reach + 1):
        # the pixel d further on counts by its own weight, and by that of what lies beyond an edge and is mirrored onto it
        left, right = -2 * at - d, 2 * (length - 1) - 2 * at - d
        weight = F.lit(taps[d + reach]) + F.when(at + left < 0, tap(left)).otherwise(0.0) + F.when(at + right > length - 1, tap(right)).otherwise(0.0)
        total = total + weight * F.coalesce(F.sum("value").over(line.rangeBetween(d, d)).cast("double"), F.lit(0.0))
    return pixels.withColumn("value", total)


def blurred(pixels: DataFrame, keys: list[str], width: int, height: int, size: tuple[int, int] = (5, 5), sigma: float = 0.0, whole: bool = True) -> DataFrame:
    """A Gaussian blur by lines and then by columns; beyond an edge the image is mirrored without repeating the edge itself.

    size: the kernel's width and height. whole: as whole numbers. Pixels that the table doesn't have count as 0 and stay away.
    """
    px = pixels.withColumns({c: F.col(c).cast("int") for c in ("px", "py")})
    out = _smoothed(px, keys, "px", "py", width, gaussian(size[0], sigma))
    out = _smoothed(out, keys, "py", "px", height, gaussian(size[1], sigma))
    return out.withColumn("value", nearest(F.col("value"))) if whole else out


def resampled(pixels: DataFrame, width: int, height: int, factor: float) -> DataFrame:
    """The image at another scale by nearest neighbours, pixel by pixel: one of the result is the source's at the whole part of its place times the ratio of sizes."""
    if factor <= 0:
        raise ValueError("a factor is above 0")

    def places(c: str, n: int) -> Column:
        to = max(1, int(n * factor))
        first, last = F.expr(f"({c} * {to}l + {n - 1}) div {n}"), F.expr(f"(({c} + 1) * {to}l + {n - 1}) div {n} - 1")
        every = F.when(first <= last, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<long>)"))
        return F.explode(F.filter(every, lambda x: x < to))

    inside = pixels.filter(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
    out = inside.withColumn("px", places("px", width)).withColumn("py", places("py", height))
    return out.withColumns({c: F.col(c).cast("int") for c in ("px", "py")})


def ellipse_corners(moments: DataFrame) -> DataFrame:
    """Adds to mask_moments() corners, the four points of the rectangle around each ellipse, and the ends of its axes, as (x, y)."""
    a, b = F.col("major") / 2, F.col("minor") / 2
    cos, sin = F.cos("angle"), F.sin("angle")

    def point(along: Column, over: Column) -> Column:
        return F.struct((F.col("cx") + along * cos - over * sin).alias("x"), (F.col("cy") + along * sin + over * cos).alias("y"))

    none = F.lit(0.0)
    corners = F.array(point(a, b), point(a, -b), point(-a, -b), point(-a, b))
    return moments.withColumns({"corners": corners, "major_axis": F.array(point(-a, none), point(a, none)), "minor_axis": F.array(point(none, -b), point(none, b))})
