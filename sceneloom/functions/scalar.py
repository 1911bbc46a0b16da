"""Scalar functions as Column expressions: text, clock, colour, projection, geometry and number helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs by Euclid's steps; 93 steps do for any pair."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], F.nullif(s["y"], F.lit(0).cast("long"))).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def option_letter(i: Column) -> Column:
    """A to Z for 0 to 25, then Option27 and so on."""
    return F.when(i < 26, F.char(F.lit(65) + i)).otherwise(F.concat(F.lit("Option"), (i + 1).cast("string")))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    suffix = F.when(F.pmod(n, F.lit(100)).between(11, 13), "th").when(F.pmod(n, F.lit(10)) == 1, "st").when(F.pmod(n, F.lit(10)) == 2, "nd").when(F.pmod(n, F.lit(10)) == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def clock_add(minutes: Column, delta: Column, day: int = 1440) -> Column:
    """Minutes since midnight after a signed shift, within the day."""
    return F.pmod(minutes + delta, F.lit(day))


def clock_text(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(F.pmod(minutes, F.lit(1440)) / 60), F.pmod(minutes, F.lit(60)))


def hand_angle(minutes: Column) -> Column:
    """Smaller angle between the hands in degrees; the hour hand moves on continuously."""
    hour = F.pmod(minutes, F.lit(720)) * 0.5
    minute = F.pmod(minutes, F.lit(60)) * 6.0
    d = F.abs(hour - minute)
    return F.least(d, F.lit(360.0) - d)


def lab(r: Column, g: Column, b: Column) -> Column:
    """CIE L*a*b* (D65) of 8-bit sRGB, as a struct."""

    def linear(c: Column) -> Column:
        c = c / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    def f(t: Column) -> Column:
        return F.when(t > 216.0 / 24389.0, F.cbrt(t)).otherwise((t * (24389.0 / 27.0) + 16.0) / 116.0)

    # The sRGB matrix and the D65 white point.
    r, g, b = linear(r), linear(g), linear(b)
    x = f((r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047)
    y = f(r * 0.2126729 + g * 0.7151522 + b * 0.0721750)
    z = f((r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.08883)
    return F.struct((y * 116.0 - 16.0).alias("l"), ((x - y) * 500.0).alias("a"), ((y - z) * 200.0).alias("b"))


def color_distance(one: Column, other: Column) -> Column:
    """CIE76 distance of two lab() structs."""
    return F.sqrt(F.pow(one["l"] - other["l"], F.lit(2)) + F.pow(one["a"] - other["a"], F.lit(2)) + F.pow(one["b"] - other["b"], F.lit(2)))


def isometric(x: Column, y: Column, z: Column) -> Column:
    """Screen coordinates of an isometric view."""
    half = math.sqrt(3.0) / 2.0
    return F.struct(((x - y) * half).alias("u"), ((x + y) * 0.5 - z).alias("v"))


def bbox_union(boxes: Column, pad: float = 0.0) -> Column:
    """Box around an array of [x0, y0, x1, y1], padded; [0, 0, 0, 0] for none."""
    side = lambda i, best: best(F.transform(boxes, lambda b: b[i]))
    box = F.array(side(0, F.array_min) - pad, side(1, F.array_min) - pad, side(2, F.array_max) + pad, side(3, F.array_max) + pad)
    return F.when(F.size(boxes) > 0, F.transform(box, lambda v: F.bround(v, 3))).otherwise(F.array(*[F.lit(0.0)] * 4))


def bbox_center(box: Column) -> Column:
    return F.array((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)


def rotate_left(items: Column, k: Column | int) -> Column:
    """Cyclic shift of an array."""
    n = F.size(items)
    by = F.pmod(F.lit(k) if isinstance(k, int) else k, F.greatest(n, F.lit(1)))
    return F.when(n == 0, items).otherwise(F.concat(F.slice(items, by + 1, n), F.slice(items, F.lit(1), by)))


def placeholders(template: Column) -> Column:
    """Names of the {slots} of a template, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), F.lit(1)))


def shoelace(xs: Column, ys: Column) -> Column:
    """Area of a closed polygon from arrays of its corners."""
    n = F.size(xs)
    turn = lambda i: F.pmod(i + 1, n) + 1
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(xs, i + 1) * F.element_at(ys, turn(i)) - F.element_at(xs, turn(i)) * F.element_at(ys, i + 1))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2.0


def subseed(seed: Column, namespace: Column | str, index: Column | int) -> Column:
    """Sub-seed below 2**53 - 1 of a seed, a namespace and an index."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    text = F.concat_ws("|", seed.cast("string"), F.lit("v0"), as_column(namespace).cast("string"), as_column(index).cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), F.lit((1 << 53) - 1))


def normalize_answer(value: Column) -> Column:
    """Text form of a scalar answer: trimmed, lower case, integral numbers without a fraction."""
    text = F.lower(F.trim(value))
    number = text.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < float(1 << 53)) & text.rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$")
    return F.when(whole, number.cast("long").cast("string")).otherwise(text)
