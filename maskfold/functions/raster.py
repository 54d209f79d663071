"""Geometry of letterboxing, tiling and blending as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letterbox(w: Column, h: Column, target_w: int = 256, target_h: int = 256) -> Column:
    """scale, scaled size and the four paddings of an aspect-preserving fit; sizes <= 0 raise."""
    bad = (w <= 0) | (h <= 0)
    w = F.when(bad, F.raise_error(F.lit("image dimensions must be positive")).cast("int")).otherwise(w)
    scale = F.least(F.lit(float(target_w)) / w, F.lit(float(target_h)) / h)
    nw = F.greatest(F.lit(1), F.bround(w * scale).cast("int"))
    nh = F.greatest(F.lit(1), F.bround(h * scale).cast("int"))
    left, top = F.floor((target_w - nw) / 2).cast("int"), F.floor((target_h - nh) / 2).cast("int")
    return F.struct(
        scale.alias("scale"), nw.alias("scaled_w"), nh.alias("scaled_h"), left.alias("pad_left"), top.alias("pad_top"),
        (target_w - nw - left).alias("pad_right"), (target_h - nh - top).alias("pad_bottom"),
    )


def tile_starts(dim: Column, tile: int = 256, overlap: float = 0.25) -> Column:
    """Start offsets of overlapping tiles: 0, equal steps, and the last start at dim - tile."""
    step = max(1, round(tile * (1.0 - overlap)))
    last = dim - tile
    steps = F.sequence(F.lit(0), last - 1, F.lit(step))
    # the last start closes the edge unless an earlier tile already ends there
    return F.when(dim <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(steps, F.array(last))))


def hann(i: Column, n: Column | int) -> Column:
    """Hann weight of position i (0-based) in a window of n, without the zero end points."""
    n = F.lit(n) if isinstance(n, int) else n
    return 0.5 - 0.5 * F.cos(2.0 * F.pi() * (i + 1) / (n + 1))


def hann2d(dx: Column, dy: Column, tile_w: Column | int, tile_h: Column | int, floor: float = 1e-3) -> Column:
    """Product of both window weights, at least `floor` and at most 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(floor), hann(dx, tile_w) * hann(dy, tile_h)))


def softmax2(l0: Column, l1: Column) -> Column:
    """Foreground probability of two logits; NaN or infinite logits raise."""
    inf = F.lit(float("inf"))
    bad = F.isnan(l0) | F.isnan(l1) | (F.abs(l0) == inf) | (F.abs(l1) == inf)
    return F.when(bad, F.raise_error(F.lit("logits must be finite")).cast("double")).otherwise(1.0 / (1.0 + F.exp(l0 - l1)))
