"""Regions of interest and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_BOTTOM = 0.40


def parse_roi(text: Column) -> Column:
    """'x,y,w,h' in shares of the frame as a struct; an error unless it lies inside."""
    part = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    x, y, w, h = (F.get(part, F.lit(i)) for i in range(4))
    good = (F.size(part) == 4) & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1 + 1e-9) & (y + h <= 1 + 1e-9)
    checked = F.assert_true(F.coalesce(good & ~F.isnan(x + y + w + h), F.lit(False)), F.lit("roi must be four numbers inside the frame")).isNull()
    return F.when(checked, F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height")))


def bottom_roi(ratio: Column | float = DEFAULT_BOTTOM) -> Column:
    ratio = F.lit(ratio) if not isinstance(ratio, Column) else ratio
    return F.struct(F.lit(0.0).alias("x"), (1 - ratio).alias("y"), F.lit(1.0).alias("width"), ratio.cast("double").alias("height"))


def resolve_roi(roi: Column, frame_width: Column, frame_height: Column) -> Column:
    """Pixels of a region: edges rounded half up, at least one pixel, inside the frame."""

    def edge(v: Column, size: Column) -> Column:
        return F.floor(v * size + 0.5).cast("int")

    def span(start: Column, length: Column, size: Column) -> tuple[Column, Column]:
        low = F.least(size - 1, F.greatest(F.lit(0), edge(start, size)))
        high = F.least(size, F.greatest(low + 1, edge(start + length, size)))
        return low, high - low

    left, width = span(roi["x"], roi["width"], frame_width)
    top, height = span(roi["y"], roi["height"], frame_height)
    return F.struct(*(c.cast("int").alias(n) for c, n in ((left, "x"), (top, "y"), (width, "width"), (height, "height"), (frame_width, "frame_width"), (frame_height, "frame_height"))))


def canonical_box(flat: Column) -> Column:
    """A flat list of an even number of coordinates as points."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(flat) / 2 - 1), lambda i: F.slice(flat, (2 * i + 1).cast("int"), F.lit(2)))
    return F.when(F.size(flat) % 2 == 0, pairs)


def geometry(box: Column) -> Column:
    """Bounds, centre and size of a polygon; null without a finite point.  The height is 1e-6 at least."""
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    points = F.filter(box, lambda p: (F.size(p) >= 2) & ok(F.get(p, F.lit(0))) & ok(F.get(p, F.lit(1))))
    start = F.struct(*(F.lit(None).cast("double").alias(n) for n in ("x_min", "x_max", "y_min", "y_max")))
    # least and greatest pass over nulls, so the fold starts from nothing
    grow = lambda g, p: F.struct(F.least(g["x_min"], p[0]).alias("x_min"), F.greatest(g["x_max"], p[0]).alias("x_max"), F.least(g["y_min"], p[1]).alias("y_min"), F.greatest(g["y_max"], p[1]).alias("y_max"))

    def whole(g: Column) -> Column:
        x0, x1, y0, y1 = g["x_min"], g["x_max"], g["y_min"], g["y_max"]
        parts = {"x_min": x0, "x_max": x1, "y_min": y0, "y_max": y1, "x_center": (x0 + x1) / 2, "y_center": (y0 + y1) / 2, "width": F.greatest(F.lit(0.0), x1 - x0), "height": F.greatest(F.lit(1e-6), y1 - y0)}
        return F.when(x0.isNotNull(), F.struct(*(v.alias(k) for k, v in parts.items())))

    return F.aggregate(points, start, grow, whole)


def bounds(box: Column) -> Column:
    """Bounds as the detector reads them: two corner points must not be inverted."""
    inverted = (F.size(box) == 2) & ((box[1][0] < box[0][0]) | (box[1][1] < box[0][1]))
    return F.when(~inverted, geometry(box))


def _overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"]))


def same_row(a: Column, b: Column) -> Column:
    """Strict test of the detector on two bounds: overlap of 0.6 of the lower, centres within 0.4 of the higher."""
    ha, hb = (F.greatest(g["y_max"] - g["y_min"], F.lit(1.0)) for g in (a, b))
    centre = F.abs(a["y_min"] + a["y_max"] - b["y_min"] - b["y_max"]) / 2
    # least and greatest pass over nulls, so absent bounds are told apart first
    return a.isNotNull() & b.isNotNull() & F.coalesce((_overlap(a, b) / F.least(ha, hb) >= 0.60) & (centre / F.greatest(ha, hb) <= 0.40), F.lit(False))


def same_visual_line(a: Column, b: Column, tolerance: float = 0.65) -> Column:
    """Loose test of row clustering: overlap of 0.3 of the lower, or centres within the tolerance of the higher."""
    return (_overlap(a, b) / F.least(a["height"], b["height"]) >= 0.30) | (F.abs(a["y_center"] - b["y_center"]) <= tolerance * F.greatest(a["height"], b["height"]))
