"""Geometry on columns: boxes, matrices, paths, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), F.greatest(F.lit(0.0), width).alias("width"), F.greatest(F.lit(0.0), height).alias("height"))


def from_pdf(x: Column, y: Column, width: Column, height: Column, page_height: Column | float) -> Column:
    """A box in page space of one in PDF space."""
    return box(x, page_height - (y + height), width, height)


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(a["left"] + a["width"], b["left"] + b["width"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["top"] + a["height"], b["top"] + b["height"]) - F.greatest(a["top"], b["top"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def axis_distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(b0 - a1, a0 - b1, F.lit(0.0))


def box_distance(a: Column, b: Column) -> Column:
    dx = axis_distance(a["left"], a["left"] + a["width"], b["left"], b["left"] + b["width"])
    dy = axis_distance(a["top"], a["top"] + a["height"], b["top"], b["top"] + b["height"])
    return F.sqrt(dx * dx + dy * dy)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the area of the smaller box."""
    smaller = F.least(a["width"] * a["height"], b["width"] * b["height"])
    return F.when(smaller > 0, intersection_area(a, b) / smaller).otherwise(0.0)


def centre_distance(a: Column, b: Column) -> Column:
    dx = (a["left"] + a["width"] / 2) - (b["left"] + b["width"] / 2)
    dy = (a["top"] + a["height"] / 2) - (b["top"] + b["height"] / 2)
    return F.sqrt(dx * dx + dy * dy)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c * 10**digits + 0.5) / float(10**digits)


def multiply(a: Column, b: Column) -> Column:
    """Product of two affine matrices [a, b, c, d, e, f]."""
    g = lambda m, i: F.get(m, F.lit(i))
    return F.array(
        g(a, 0) * g(b, 0) + g(a, 2) * g(b, 1),
        g(a, 1) * g(b, 0) + g(a, 3) * g(b, 1),
        g(a, 0) * g(b, 2) + g(a, 2) * g(b, 3),
        g(a, 1) * g(b, 2) + g(a, 3) * g(b, 3),
        g(a, 0) * g(b, 4) + g(a, 2) * g(b, 5) + g(a, 4),
        g(a, 1) * g(b, 4) + g(a, 3) * g(b, 5) + g(a, 5),
    )


def transform_point(m: Column, x: Column, y: Column) -> Column:
    g = lambda i: F.get(m, F.lit(i))
    return F.struct((g(0) * x + g(2) * y + g(4)).alias("x"), (g(1) * x + g(3) * y + g(5)).alias("y"))


def placement(m: Column) -> Column:
    """Where an image of unit size lands: x, y, width, height (1 where a side vanishes)."""
    g = lambda i: F.get(m, F.lit(i))
    side = lambda i, j: F.hypot(g(i), g(j))
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    return F.struct(g(4).alias("x"), g(5).alias("y"), one(side(0, 1)).alias("width"), one(side(2, 3)).alias("height"))


def rotation_degrees(m: Column) -> Column:
    return F.degrees(F.atan2(F.get(m, F.lit(1)), F.get(m, F.lit(0))))


def snapped_rotation(degrees: Column) -> Column:
    """0 or a quarter turn where within one degree of it, else 0."""
    return F.when(F.abs(degrees) < 1, 0.0).when(F.abs(F.abs(degrees) - 90) <= 1, F.signum(degrees) * 90).otherwise(0.0)


NUMBER = r"-?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?"


def path_bounds(path: Column) -> Column:
    """struct<min_x, min_y, max_x, max_y> of the numbers of a path taken in pairs; null under two pairs."""
    numbers = F.transform(F.regexp_extract_all(path, F.lit(NUMBER), F.lit(0)), lambda s: s.cast("double"))
    numbers = F.slice(numbers, F.lit(1), F.size(numbers) - F.size(numbers) % 2)
    xs, ys = F.filter(numbers, lambda v, i: i % 2 == 0), F.filter(numbers, lambda v, i: i % 2 == 1)
    return F.when(F.size(numbers) >= 4, F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")))


def hex_color(r: Column, g: Column, b: Column) -> Column:
    part = lambda c: F.lpad(F.lower(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), c.cast("int"))))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def estimated_width(text: Column, font_size: Column) -> Column:
    """Width of a text by classes of characters, in shares of the font size; 1 at least, 0 for none."""
    t = F.trim(text)
    count = lambda p: F.regexp_count(t, F.lit(p))
    digits, upper, lower, narrow, bar = count("[0-9]"), count("[A-Z]"), count("[a-z]"), count("[,.;:!?'\"() ]"), count("[|]")
    rest = F.length(t) - digits - upper - lower - narrow - bar
    units = digits * 0.52 + upper * 0.58 + lower * 0.55 + narrow * 0.3 + bar * 0.25 + rest * 0.55
    return F.when(t == "", 0.0).otherwise(F.greatest(F.lit(1.0), units * font_size))
