"""Boxes and image budgets as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 when the union isn't positive."""
    zero = F.lit(0.0)
    both = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def best_iou(boxes: Column, targets: Column) -> Column:
    """Mean over targets of the best box's overlap; 0 without targets."""
    four = lambda b: [F.get(b, F.lit(i)) for i in range(4)]
    best = F.transform(targets, lambda t: F.coalesce(F.array_max(F.transform(boxes, lambda b: iou(four(b), four(t)))), F.lit(0.0)))
    return F.when(F.size(targets) > 0, F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(targets)).otherwise(0.0)


def smart_resize(h: Column, w: Column, factor: int, least: int, most: int) -> tuple[Column, Column]:
    """Height and width as multiples of factor, within an area of least to most pixels; sides over 200:1 fail."""
    near = lambda x: F.greatest(F.lit(factor), F.bround(x / factor) * factor)
    h0, w0 = near(h), near(w)
    shrink, grow = F.sqrt(h * w / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (h * w))
    big, small = h0 * w0 > most, h0 * w0 < least
    side = lambda x, x0: F.when(big, F.greatest(F.lit(factor), F.floor((x / shrink).cast("long") / factor) * factor)).when(small, F.ceil((x * grow).cast("long") / factor) * factor).otherwise(x0).cast("long")
    bad = F.greatest(h, w) / F.least(h, w) > 200
    return tuple(F.when(bad, F.raise_error(F.lit("sides differ by over 200 times"))).otherwise(side(x, x0)).cast("long") for x, x0 in ((h, h0), (w, w0)))


def to_original(v: Column, scale: Column, limit: Column) -> Column:
    return F.greatest(F.least(F.bround(v / scale), limit), F.lit(0)).cast("long")


def to_factor(v: Column, factor: int, how: str = "round") -> Column:
    """v as a multiple of factor; halves go to the even multiple."""
    return ({"round": F.bround, "floor": F.floor, "ceil": F.ceil}[how](v / factor) * factor).cast("long")


def shrunk(h: Column, w: Column, factor: int, most: int) -> tuple[Column, Column]:
    """Sides as multiples of factor, smaller if their area is over most, never below one factor."""
    beta = F.when(h * w > most, F.sqrt(h * w / F.lit(float(most)))).otherwise(1.0)
    return tuple(F.greatest(F.lit(factor), F.floor(x / beta / factor) * factor).cast("long") for x in (h, w))


def budget(w: Column, h: Column, ratio: Column, most: int, usual: int = 448 * 448) -> Column:
    """Pixels that an image may have: by its ratio if there is one, else the usual ones if it is larger than they."""
    return F.when(ratio.isNotNull(), F.when(ratio == 1, F.lit(float(most))).otherwise(F.least(w * ratio * h * ratio, F.lit(float(most))))).when(w * h > usual, F.lit(float(usual))).otherwise(F.lit(float(most))).cast("long")


def ratio_budget(w: Column, h: Column, ratio: Column, least: int = 13 * 13 * 28 * 28, most: int = 1024 * 1024) -> Column:
    return F.greatest(F.least(w * h * ratio, F.lit(float(most))), F.lit(float(least))).cast("long")


def box_to_original(box: list[Column], scale: list[Column], size: list[Column]) -> tuple[list[Column], Column]:
    """Coordinates of a box in the original image, within its bounds, and whether anything is left of it."""
    out = [to_original(v, scale[i % 2], size[i % 2]) for i, v in enumerate(box)]
    return out, (out[0] < out[2]) & (out[1] < out[3])


def box_to_overview(box: list[Column], scale: list[Column], size: list[Column]) -> list[Column]:
    """Coordinates of an original box in the overview, at least one pixel wide and high."""
    x1, y1 = (F.least(F.greatest(F.bround(box[i] * scale[i]), F.lit(0)), size[i] - 1).cast("long") for i in (0, 1))
    x2, y2 = (F.least(F.greatest(F.bround(box[i + 2] * scale[i]), v + 1), size[i]).cast("long") for i, v in ((0, x1), (1, y1)))
    return [x1, y1, x2, y2]


def box_from_shares(box: list[Column], w: Column, h: Column) -> list[Column]:
    """Absolute coordinates of a box given as shares of the sides, cut to whole pixels."""
    return [(v * (w, h)[i % 2]).cast("long") for i, v in enumerate(box)]


def boxes_to_original(turns: Column, scale: Column) -> Column:
    """Boxes of all turns over their scale (1 if there is none), those with area."""
    at = lambda i: F.coalesce(F.when(F.size(scale) >= 2, F.get(scale, F.lit(i))), F.lit(1.0))
    out = F.transform(F.filter(F.flatten(turns), lambda b: F.size(b) >= 4), lambda b: F.array(*(F.get(b, F.lit(i)) / at(i % 2) for i in range(4))))
    return F.filter(out, lambda b: (F.get(b, F.lit(0)) < F.get(b, F.lit(2))) & (F.get(b, F.lit(1)) < F.get(b, F.lit(3))))


def bad_boxes(boxes: Column, scale: list[Column], size: list[Column]) -> Column:
    """More than three boxes, two that overlap by over 0.6, or one over half the image or under four patches."""
    four = lambda b: [F.get(b, F.lit(i)).cast("double") for i in range(4)]
    overlap = F.exists(F.transform(boxes, lambda a, i: F.exists(F.slice(boxes, i + 2, F.size(boxes)), lambda b: iou(four(a), four(b)) > 0.6)), lambda x: x)

    def area(b: Column) -> Column:
        x1, y1, x2, y2 = (F.bround(v / scale[i % 2]) for i, v in enumerate(four(b)))
        return (x2 - x1) * (y2 - y1)

    odd = F.exists(boxes, lambda b: (area(b) > 0.5 * size[0] * size[1]) | (area(b) < 4 * 28 * 28))
    return (F.size(boxes) > 3) | overlap | odd


def curriculum(step: Column, start: int, end: int, warmup: int) -> Column:
    """Tokens of a budget that goes from start down to end over the warmup steps; a token has 28 * 28 pixels."""
    return F.bround(F.greatest(start + (end - start) * F.least(step / F.lit(float(warmup)), F.lit(1.0)), F.lit(float(end)))).cast("long")


def learning_rate(step: Column, warmup: int, total: int, least: float = 0.0, kind: str = "cosine") -> Column:
    """Share of the full rate: a linear rise, then a cosine down to least, or constant."""
    rise = step / F.lit(float(max(1, warmup)))
    if kind == "constant":
        return F.least(rise, F.lit(1.0))
    done = F.least((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(1.0))
    return F.when(step < warmup, rise).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * done)))


def constrained(w: Column, h: Column, most: Column, factor: int = 28) -> Column:
    """(width, height, scale_x, scale_y) of an image shrunk to an area of most pixels, its sides multiples of factor; smaller ones stay as they are."""
    near = lambda x: F.greatest(F.lit(factor), F.bround(x / factor) * factor)
    w0, h0, beta = near(w), near(h), F.sqrt(h * w / most)
    side = lambda x, x0: F.when(w * h <= most, x).when(h0 * w0 <= most, x0).otherwise(F.greatest(F.lit(factor), F.floor((x / beta).cast("long") / factor) * factor)).cast("long")
    return F.struct(side(w, w0).alias("width"), side(h, h0).alias("height"), (side(w, w0) / w).alias("scale_x"), (side(h, h0) / h).alias("scale_y"))


def clipped(v: Column, least: Column, most: Column) -> Column:
    """v within bounds that are columns too; where they cross, the lower one holds."""
    return F.greatest(F.least(v, most), least)
