"""Geometry of boxes: polygons, overlaps, scaling, vectors. Boxes are [x0, y0, x1, y1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_bounds(polygon: Column) -> Column:
    """STRUCT<x0, y0, x1, y1> of ARRAY<ARRAY<DOUBLE>>, null where no point has two numbers."""
    points = F.filter(polygon, lambda p: F.size(p) >= 2)
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def box(bbox: Column) -> Column:
    """STRUCT<x0, y0, x1, y1, cx, cy, w, h> of an array of four numbers, else null."""
    x0, y0, x1, y1 = (F.try_element_at(bbox, F.lit(i)) for i in (1, 2, 3, 4))
    made = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), ((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    return F.when(F.size(bbox) >= 4, made)


def iou(a: Column, b: Column) -> Column:
    """Overlap over union of two structs of bounds; areas are at least 1; 0 where they do not meet or one is null."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = lambda r: F.greatest((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]), F.lit(1.0))
    return F.when(a.isNull() | b.isNull() | (w <= 0) | (h <= 0), 0.0).otherwise(w * h / (area(a) + area(b) - w * h))


def round_tenth(v: Column) -> Column:
    """A double to one place as its exact value says, ties to even: what is above a tie by less than a product shows still rounds up."""
    a, b = v * 8, v * 2  # exact, and their sum's error is too
    s = a + b
    part = s - a
    rest = (a - (s - part)) + (b - part)
    low = F.floor(s)
    tie = s - low == 0.5
    n = F.when(tie & (rest > 0), low + 1).when(tie & (rest < 0), low).otherwise(F.rint(s))
    return n.cast("double") / 10


def to_pixels(normal: Column, width: Column, height: Column) -> Column:
    """[ymin, xmin, ymax, xmax] in thousandths as [x0, y0, x1, y1] in pixels, clamped, to one place; [] if it has no area."""
    at = lambda i: F.try_element_at(normal, F.lit(i))
    cut = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    x0, x1 = (cut(F.least(at(2), at(4)) / 1000 * width, width), cut(F.greatest(at(2), at(4)) / 1000 * width, width))
    y0, y1 = (cut(F.least(at(1), at(3)) / 1000 * height, height), cut(F.greatest(at(1), at(3)) / 1000 * height, height))
    r = round_tenth
    return F.when((F.size(normal) == 4) & (x1 > x0) & (y1 > y0), F.array(r(x0), r(y0), r(x1), r(y1))).otherwise(F.array().cast("array<double>"))


def is_vertical(w: Column, h: Column, cjk: Column) -> Column:
    return (h > 1.4 * w) & (cjk >= 0.4)


def scaled(v: Column, dpi: Column) -> Column:
    """Points as pixels."""
    return v * dpi / 72.0


def cropped(bbox: Column, width: Column, height: Column) -> Column:
    """A region within a page, or null where nothing is left."""
    x0, y0 = F.greatest(F.lit(0), F.floor(bbox[0])), F.greatest(F.lit(0), F.floor(bbox[1]))
    x1, y1 = F.least(width, F.floor(bbox[2])), F.least(height, F.floor(bbox[3]))
    return F.when((x1 > x0) & (y1 > y0), F.array(x0, y0, x1, y1))


def mean_confidence(values: Column) -> Column:
    """The mean of the confidences that are there; 0 where there are none."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known)).otherwise(0.0)


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted values."""
    return F.try_element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, by: str = "cosine") -> Column:
    """cosine (0 for a zero vector), dot, or the negative Euclidean distance: more is nearer."""
    if by == "dot":
        return dot(a, b)
    if by == "euclid":
        return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def script_choice(ch_text_cjk: Column, ch_latin: Column, ch_conf: Column, lat_cjk: Column, lat_latin: Column, lat_conf: Column) -> Column:
    """ch or latin: which of two readings of one block is kept."""
    han = (ch_text_cjk >= 0.35) & (ch_text_cjk >= ch_latin) & (ch_text_cjk >= lat_cjk)
    latin = (lat_latin >= 0.35) | ((ch_latin >= 0.35) & (lat_latin >= ch_latin))
    return (
        F.when(lat_conf.isNull() | han, "ch")
        .when(latin & (lat_conf >= 0.85 * ch_conf), "latin")
        .when((lat_conf > 1.1 * ch_conf) & (lat_latin >= ch_latin), "latin")
        .when(ch_conf >= lat_conf, "ch")
        .otherwise("latin")
    )
