"""Box algebra as column expressions. xyxy boxes are x1, y1, x2, y2; all coordinates are doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def xywh_to_xyxy(x, y, w, h) -> tuple[Column, ...]:
    x, y, w, h = map(col, (x, y, w, h))
    return x, y, x + w, y + h


def xyxy_to_xywh(x1, y1, x2, y2) -> tuple[Column, ...]:
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    return x1, y1, x2 - x1, y2 - y1


def xyxy_to_center(x1, y1, x2, y2) -> tuple[Column, ...]:
    """Centre x, centre y, width, height."""
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def center_to_xyxy(cx, cy, w, h) -> tuple[Column, ...]:
    cx, cy, w, h = map(col, (cx, cy, w, h))
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def xyxy_to_state(x1, y1, x2, y2) -> tuple[Column, ...]:
    """Centre x, centre y, area, width to height; no ratio (null) for a box without height."""
    cx, cy, w, h = xyxy_to_center(x1, y1, x2, y2)
    return cx, cy, w * h, F.try_divide(w, h)


def state_to_xyxy(cx, cy, area, ratio) -> tuple[Column, ...]:
    """The inverse; null where area times ratio is negative."""
    cx, cy, area, ratio = map(col, (cx, cy, area, ratio))
    product = area * ratio
    w = F.when(product >= 0, F.sqrt(product))
    h = F.try_divide(area, w)
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def area(x1, y1, x2, y2, pixel: float = 0.0) -> Column:
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    return (x2 - x1 + pixel) * (y2 - y1 + pixel)


def iou(a: tuple, b: tuple, inclusive: bool = False) -> Column:
    """Intersection over union; inclusive counts the last pixel of each side as part of a box. 0 for two boxes without area."""
    pixel = 1.0 if inclusive else 0.0
    a, b = tuple(map(col, a)), tuple(map(col, b))
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + pixel)
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + pixel)
    shared = w * h
    return F.coalesce(F.try_divide(shared, area(*a, pixel=pixel) + area(*b, pixel=pixel) - shared), F.lit(0.0))


def sanitize(df: DataFrame, width: float, height: float, least: float = 1.0) -> DataFrame:
    """Clamps boxes to the image and drops those narrower or lower than `least`."""
    inside = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(top)))
    df = df.withColumns({"x1": inside("x1", width), "x2": inside("x2", width), "y1": inside("y1", height), "y2": inside("y2", height)})
    return df.filter((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))
