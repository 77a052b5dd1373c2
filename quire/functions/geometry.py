"""Box arithmetic as Column expressions. A box is a struct (x0, y0, x1, y1) of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EDGES = ("x0", "y0", "x1", "y1")


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*((F.col(v) if isinstance(v, str) else F.lit(v) if not isinstance(v, Column) else v).cast("double").alias(n) for n, v in zip(EDGES, (x0, y0, x1, y1))))


def _limit(v: Column, most) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most).cast("double"), v))


def scale(b: Column, sx: float, sy: float, max_w=None, max_h=None) -> Column:
    """The box times (sx, sy), held to the page where its size is given."""
    x = [b[n] * F.lit(float(sx)) for n in ("x0", "x1")]
    y = [b[n] * F.lit(float(sy)) for n in ("y0", "y1")]
    x = x if max_w is None else [_limit(v, max_w) for v in x]
    y = y if max_h is None else [_limit(v, max_h) for v in y]
    return box(x[0], y[0], x[1], y[1])


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(w * h)


def iou(a: Column, b: Column) -> Column:
    common = intersection_area(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def center_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def letterbox(width: Column, height: Column, target: int) -> Column:
    """(ratio, pad_x, pad_y) that fit an image into a square; sizes round half to even."""
    ratio = F.least(F.lit(float(target)) / height, F.lit(float(target)) / width)
    return F.struct(ratio.alias("ratio"), ((target - F.rint(width * ratio)) / 2).alias("pad_x"), ((target - F.rint(height * ratio)) / 2).alias("pad_y"))


def unmap(b: Column, ratio: Column, pad_x: Column, pad_y: Column, width, height) -> Column:
    """Letterbox coordinates back to the image's, held to its size."""
    return box(*(_limit((b[n] - p) / ratio, m) for n, p, m in zip(EDGES, (pad_x, pad_y) * 2, (width, height) * 2)))


def clamp_padded(b: Column, width: int, height: int, pad: int = 4) -> Column:
    """The box grown by pad, rounded half to even and held to the page."""
    limit = lambda v, m: F.greatest(F.lit(0.0), F.least(F.lit(float(m)), F.rint(v)))
    return box(limit(b["x0"] - pad, width), limit(b["y0"] - pad, height), limit(b["x1"] + pad, width), limit(b["y1"] + pad, height))


def aspect_ratio(b: Column) -> Column:
    w, h = F.greatest(F.lit(0.0), b["x1"] - b["x0"]), F.greatest(F.lit(0.0), b["y1"] - b["y0"])
    return F.round(w / F.greatest(F.lit(1.0), h), 4)


def same_row(a: Column, b: Column, body_size: float, overlap: float = 0.45) -> Column:
    """Vertical overlap of at least that share of the lower box, or near centres where one is flat."""
    height = lambda x: F.greatest(F.lit(0.0), x["y1"] - x["y0"])
    least = F.least(height(a), height(b))
    centres = F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2) <= body_size * 0.55
    shared = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]) >= least * overlap
    return F.when(least <= max(1.0, body_size * 0.2), centres).otherwise(shared)


def crop_rectangle(width: Column, height: Column, header: float, footer: float, left: float, right: float) -> Column:
    """Page area inside four ratios; a footer ratio from 0.5 on is measured from the top."""
    f = footer if footer < 0.5 else 1.0 - footer
    return box(width * left, height * header, width * (1.0 - right), height * (1.0 - f))


def quantize(size: Column, step: float = 0.25) -> Column:
    """Half-up to multiples of step; null for sizes that are none."""
    steps = F.round(size.cast("decimal(18,4)") / F.lit(step).cast("decimal(18,4)"), 0)
    return F.when((size > 0) & ~F.isnan(size) & (size < 1e9), steps.cast("double") * F.lit(step))


def union_of(b: Column) -> Column:
    """Aggregate: envelope of the boxes with positive width and height; null without any."""
    ok = (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])
    pick = lambda n: F.when(ok, b[n])
    whole = box(F.round(F.min(pick("x0")), 2), F.round(F.min(pick("y0")), 2), F.round(F.max(pick("x1")), 2), F.round(F.max(pick("y1")), 2))
    return F.when(F.max(ok.cast("int")) == 1, whole)


def envelope_of(b: Column) -> Column:
    """Aggregate: envelope of all boxes, (0, 0, 0, 0) without any."""
    zero = lambda c: F.coalesce(F.round(c, 2), F.lit(0.0))
    return box(zero(F.min(b["x0"])), zero(F.min(b["y0"])), zero(F.max(b["x1"])), zero(F.max(b["y1"])))
