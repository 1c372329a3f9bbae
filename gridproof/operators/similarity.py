"""Structural similarity of two fields, at one scale and at several."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import local_moments
from .metrics import ssim_of

WINDOW, SIGMA = 11, 1.5
#: Weights of the scales.
WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def _maps(rows: DataFrame, keys: Sequence[str], height: int, width: int, reach: float, window: int) -> DataFrame:
    """keys, ssim, cs by cell, where the whole window is inside the field."""
    if min(height, width) < window:
        raise ValueError("the field is smaller than the window")
    x, y = F.col("x"), F.col("y")
    both = rows.where(x.isNotNull() & y.isNotNull()).withColumn("value", F.lit(1.0))
    m = local_moments(both, window, (window - 1) / (2 * SIGMA), keys=keys, mx=x, my=y, mxx=x * x, myy=y * y, mxy=x * y)
    half = window // 2
    inside = m.where(F.col("i").between(half, height - 1 - half) & F.col("j").between(half, width - 1 - half))
    ssim, cs = ssim_of(*[F.col(c) for c in ("mx", "my", "mxx", "myy", "mxy")], reach=reach)
    return inside.select(*keys, ssim.alias("ssim"), cs.alias("cs"))


def ssim(rows: DataFrame, keys: Sequence[str], height: int, width: int, reach: float = 1.0, window: int = WINDOW, clamp: bool = False) -> DataFrame:
    """keys, ssim, cs: means over cells of rows (keys, i, j, x, y)."""
    out = _maps(rows, keys, height, width, reach, window).groupBy(*keys).agg(F.avg("ssim").alias("ssim"), F.avg("cs").alias("cs"))
    return out.withColumns({c: F.greatest(c, F.lit(0.0)) for c in ("ssim", "cs")}) if clamp else out


def halved(rows: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Means of 2 x 2 cells. An odd side is padded by a zero at both ends, which count."""
    half = lambda c, n: F.floor((F.col(c) + n % 2) / 2).cast("int").alias(c)
    return rows.groupBy(*keys, half("i", height), half("j", width)).agg((F.sum("x") / 4).alias("x"), (F.sum("y") / 4).alias("y"))


def ms_ssim(rows: DataFrame, keys: Sequence[str], height: int, width: int, reach: float = 1.0, window: int = WINDOW, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """keys, value: product over scales of contrast-structure, and similarity at the last, to their weights.

    A fixed number of scales, so the plan has one pass for each."""
    if min(height, width) <= (window - 1) * 2 ** (len(weights) - 1):
        raise ValueError("the field is too small for so many scales")
    parts = []
    for k, w in enumerate(weights):
        s = ssim(rows, keys, height, width, reach, window, clamp=True)
        parts.append(s.select(*keys, F.pow(F.col("ssim" if k == len(weights) - 1 else "cs"), F.lit(w)).alias(f"p{k}")))
        rows, height, width = halved(rows, keys, height, width), -(-height // 2), -(-width // 2)
    joined = reduce(lambda a, b: a.join(b, list(keys)), parts)
    return joined.select(*keys, reduce(lambda a, b: a * b, [F.col(f"p{k}") for k in range(len(weights))]).alias("value"))
