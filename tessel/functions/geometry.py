"""Arithmetic on image sizes, frames and schedules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_by_factor(x: Column, factor: int) -> Column:
    """The nearest multiple; halves go to the even one."""
    return (F.bround(x / F.lit(float(factor))) * factor).cast("long")


def ceil_by_factor(x: Column, factor: int) -> Column:
    return (F.ceil(x / F.lit(float(factor))) * factor).cast("long")


def floor_by_factor(x: Column, factor: int) -> Column:
    return (F.floor(x / F.lit(float(factor))) * factor).cast("long")


def smart_resize(height: Column, width: Column, factor: int = 28, least: int = 4 * 28 * 28, most: int = 16384 * 28 * 28, ratio: int = 200) -> Column:
    """(height, width) as multiples of ``factor`` with an area in bounds and about the same shape; too long a shape raises."""
    h, w = (F.greatest(F.lit(factor).cast("long"), round_by_factor(x, factor)) for x in (height, width))
    area = (height * width).cast("double")
    shrink, grow = F.sqrt(area / F.lit(float(most))), F.sqrt(F.lit(float(least)) / area)
    side = lambda x, bar: F.when(h * w > most, floor_by_factor(x / shrink, factor)).when(h * w < least, ceil_by_factor(x * grow, factor)).otherwise(bar)
    bad = F.greatest(height, width) / F.least(height, width) > ratio
    checked = F.when(bad, F.raise_error(F.lit("aspect ratio too large")).cast("long")).otherwise(side(height, h))
    return F.struct(checked.alias("height"), side(width, w).alias("width"))


def smart_frames(total: Column, video_fps: Column, fps: float = 2.0, least: int = 4, most: int = 768, factor: int = 2) -> Column:
    """Number of frames at ``fps``, in bounds and a multiple of ``factor``; null where no such number fits."""
    low = F.lit(-(-least // factor) * factor)
    high = floor_by_factor(F.least(F.lit(most), total), factor)
    n = total / video_fps * F.lit(fps)
    n = floor_by_factor(F.least(F.least(F.greatest(n, low), high), total), factor)
    return F.when((n >= factor) & (n <= total), n)


def patch_tokens(width: Column, height: Column, patch: int = 14) -> Column:
    return (F.ceil(width / patch) * F.ceil(height / patch) + 2).cast("long")


def is_large_image(width: Column, height: Column, pixels: int = 1_000_000, tokens: int = 400) -> Column:
    return (width * height > pixels) | (patch_tokens(width, height) > tokens)


def fit_within(width: Column, height: Column, most: int) -> Column:
    """(width, height) with the longer side at most ``most``; fractions are cut off."""
    w = F.when(F.greatest(width, height) <= most, width).when(width > height, F.lit(most)).otherwise((width * most / height).cast("int"))
    h = F.when(F.greatest(width, height) <= most, height).when(width > height, (height * most / width).cast("int")).otherwise(F.lit(most))
    return F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))


def center_crop(width: Column, height: Column, size: int) -> Column:
    """(left, top) of a centred square crop, after the shorter side is brought to ``size``."""
    scale = F.lit(float(size)) / F.least(width, height)
    return F.struct(*[F.bround((F.bround(x * scale) - size) / 2).cast("long").alias(n) for x, n in ((width, "left"), (height, "top"))])


def even_indices(n: Column, m: Column, rounded: bool = False) -> Column:
    """m places from 0 to n - 1 at even distance: whole parts, or rounded; place 0 alone where m is 1."""
    step = lambda i: i * (n - 1) / (m - 1)
    pick = (lambda i: F.bround(step(i)).cast("long")) if rounded else (lambda i: F.floor(step(i)))
    return F.when(m <= 0, F.array().cast("array<bigint>")).when(m == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), m.cast("int") - 1), pick))


def padding(n: Column, parts: int) -> Column:
    """How many are missing to a multiple of ``parts``."""
    return F.pmod(-n, F.lit(parts))


def linear_schedule(step: Column, warmup: int, total: int) -> Column:
    """Learning-rate factor: up to 1 over the warm-up, and down to 0."""
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(float(max(1, total - warmup)))))


def keyframe_schedule(step: Column, frames: list[tuple[int, float]], cosine: bool = False) -> Column:
    """Values between keyframes (step, value), straight or along half a cosine; outside them the nearest one's."""
    out = F.when(step <= frames[0][0], F.lit(float(frames[0][1])))
    for (a, x), (b, y) in zip(frames, frames[1:], strict=False):
        t = (step - a) / F.lit(float(b - a))
        t = (1 - F.cos(t * np.pi)) / 2 if cosine else t
        out = out.when(step <= b, F.lit(float(x)) + t * F.lit(float(y - x)))
    return out.otherwise(F.lit(float(frames[-1][1])))


def optimal_bands(threshold: float, num_perm: int, fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """Bands and rows of the least weighted error area about a similarity threshold, of all whose product fits."""
    best, found = float("inf"), (1, 1)
    below, above = np.linspace(0, threshold, 1001), np.linspace(threshold, 1, 1001)
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            fp = np.trapezoid(1 - (1 - below**r) ** b, below)
            fn = np.trapezoid((1 - above**r) ** b, above)
            error = fp_weight * fp + fn_weight * fn
            if error < best:
                best, found = error, (b, r)
    return found
