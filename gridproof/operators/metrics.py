"""Pointwise metrics: column functions over the values of a combination of datasets."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridproof.functions.missing import all_present, divided, flag, greatest_of, null_if_nan
from gridproof.functions.scalars import acos_degrees, modulo


@dataclass(frozen=True)
class Spread:
    """The local deviation, over a Gaussian window, of one dataset of a combination or of the first less the second of two.

    of: their places in the combination, from 0."""

    of: tuple[int, ...]
    window: int = 21
    n_sigma: float = 3.0
    eps: float = 1e-8

    def __post_init__(self) -> None:
        if len(self.of) not in (1, 2):
            raise ValueError("a spread is that of one dataset or of the difference of two")


@dataclass(frozen=True)
class Metric:
    """A name, how many datasets it compares, and the expression over their values.

    kind: ``cell`` metrics take the value of each channel, ``vector`` metrics take structs of the
    channels u and v and give one value for both, whose channel is missing. The local deviations that
    ``spreads`` names follow the values: of each channel, or as structs of u and v."""

    name: str
    arity: int
    of: Callable[..., Column]
    kind: str = "cell"
    spreads: tuple[Spread, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in ("cell", "vector"):
            raise ValueError(f"{self.name}: no such kind of metric: {self.kind}")
        if any(not 0 <= k < self.arity for s in self.spreads for k in s.of):
            raise ValueError(f"{self.name}: a spread of a dataset that the combination does not have")

    def column(self, places: dict[Spread, str] | None = None) -> Column:
        """The expression over columns v1, v2, ... and the columns that hold its spreads."""
        out = self.of(*[F.col(f"v{k + 1}") for k in range(self.arity)], *[F.col((places or {})[s]) for s in self.spreads])
        if isinstance(out, (tuple, list)):
            raise ValueError(f"{self.name} gives {len(out)} values: only as the first of a sequence")
        return out


def applied(rows: DataFrame, *metrics: Metric, places: dict[Spread, str] | None = None) -> DataFrame:
    """metric, combo, date, channel, i, j, value of rows of combinations, one pass for all metrics."""
    each = [F.struct(F.lit(m.name).alias("metric"), m.column(places).cast("double").alias("value")) for m in metrics]
    return rows.select(F.explode(F.array(*each)).alias("m"), "combo", "date", "channel", "i", "j").select("m.metric", "combo", "date", "channel", "i", "j", "m.value")


MSE = Metric("mse", 2, lambda a, b: (a - b) * (a - b))
MAE = Metric("mae", 2, lambda a, b: F.abs(a - b))
RELATIVE_ERROR = Metric("relative_error", 2, lambda a, b: F.abs(divided(a - b, b)) * 100)
DIFFERENCE = Metric("difference", 2, lambda a, b: a - b)
IDENTITY = Metric("identity", 1, lambda a: a)
TIMES = Metric("times", 2, lambda a, b: a * b)
NET = Metric("net", 2, lambda a, b: a * (1 - b))
#: The name is misspelt, as results are known by it.
SQUARED = Metric("sqared", 1, lambda a: a * a)
IDENTITY_OVER = Metric("identity_over", 2, lambda a, b: F.when(b.isNotNull(), a))


def transformed(name: str, f: Callable[[Column], Column]) -> Metric:
    return Metric(name, 1, f)


def sequential(first: Metric, *then: Metric) -> Metric:
    """First any metric, then metrics on what came out: one value, a vector, or as many values as a metric gave."""
    if not then:
        raise ValueError("a sequence has two metrics or more")
    if any(m.spreads for m in then):
        raise ValueError("only the first of a sequence can have local deviations")

    def of(*cols: Column) -> Column:
        out = first.of(*cols)
        for m in then:
            args = out if isinstance(out, (tuple, list)) else (out,)
            if len(args) != m.arity:
                raise ValueError(f"{m.name} takes {m.arity} values and gets {len(args)}")
            out = m.of(*args)
        return out

    return Metric("→".join(m.name for m in (first, *then)), first.arity, of, first.kind, first.spreads)


def componentwise(metric: Metric) -> Metric:
    """A metric of values as one of vectors that gives a vector, for use as the first of a sequence."""
    return Metric(metric.name, metric.arity, lambda *vs: F.struct(metric.of(*[x["u"] for x in vs]).alias("u"), metric.of(*[x["v"] for x in vs]).alias("v")), "vector")


def sic_success(fraction: bool = False, mask: Column | None = None) -> Metric:
    """1 where the tenths of two concentrations differ by one at most."""
    tenth = (lambda x: F.rint(x * 10)) if fraction else (lambda x: F.floor(x / 10))

    def of(a: Column, b: Column) -> Column:
        hit = flag(F.abs(tenth(a) - tenth(b)) <= 1)
        return hit if mask is None else F.when(mask, hit)

    return Metric("sic_success", 2, of)


def thick_success(sensitivity: float = 0.3, least: float = 0.1, require_init: bool = False) -> Metric:
    """1 where the forecast's error is within a share of the observed change.

    A missing first state gives 0, or with ``require_init`` a missing result."""

    def of(p: Column, o: Column, o0: Column) -> Column:
        hit = F.abs(p - o) <= greatest_of(F.abs(o - o0), least) * sensitivity
        return F.when(all_present(p, o, o0) if require_init else all_present(p, o), flag(F.coalesce(hit, F.lit(False))))

    return Metric("thick_success", 3, of)


def efficiency(success: Metric) -> Metric:
    """Success of the forecast beyond that of the first state; success takes (p, o) or (p, o, o0)."""

    def of(p: Column, o: Column, o0: Column, *spreads: Column) -> Column:
        rest = () if success.arity == 2 else (o0,)
        return success.of(p, o, *rest, *spreads) - success.of(o0, o, *rest, *spreads)

    return Metric(success.name.replace("_success", "_efficiency"), 3, of, success.kind, success.spreads)


# vectors: columns u1, v1, u2, v2


def vector_norm(u: Column, v: Column, p: float = 2.0) -> Column:
    if p == 2.0:
        return F.sqrt(u * u + v * v)
    if math.isinf(p):
        return F.when(all_present(u, v), F.greatest(F.abs(u), F.abs(v)))
    return F.pow(F.pow(F.abs(u), F.lit(p)) + F.pow(F.abs(v), F.lit(p)), F.lit(1 / p))


def vector_angle(u: Column, v: Column, degrees: bool = True, normalize: bool = False, sensitivity: float = 0.1) -> Column:
    angle = F.degrees(F.atan2(v, u)) if degrees else F.atan2(v, u)
    if normalize:
        angle = modulo(angle, 360.0 if degrees else 2 * math.pi)
    return F.when(vector_norm(u, v) >= sensitivity, angle)


def angle_error(u1: Column, v1: Column, u2: Column, v2: Column, sensitivity: float = 0.1) -> Column:
    """Degrees between two vectors; missing where both are short or the cosine is out of range."""
    a, b = vector_norm(u1, v1), vector_norm(u2, v2)
    cos = u1 / greatest_of(a, sensitivity) * (u2 / greatest_of(b, sensitivity)) + v1 / greatest_of(a, sensitivity) * (v2 / greatest_of(b, sensitivity))
    return F.when(~((a < sensitivity) & (b < sensitivity)), acos_degrees(cos))


def _each(vectors: tuple[Column, ...], f: Callable[[Column, Column], Column]):
    out = [f(x["u"], x["v"]) for x in vectors]
    return out[0] if len(out) == 1 else out


def of_norm(p: float = 2.0, arity: int = 1) -> Metric:
    """The norm of a vector; of several as the first of a sequence."""
    return Metric("norm", arity, lambda *vs: _each(vs, lambda u, v: vector_norm(u, v, p)), "vector")


def of_angle(degrees: bool = True, normalize: bool = False, sensitivity: float = 0.1, arity: int = 1) -> Metric:
    return Metric("angle", arity, lambda *vs: _each(vs, lambda u, v: vector_angle(u, v, degrees, normalize, sensitivity)), "vector")


def of_angle_error(sensitivity: float = 0.1) -> Metric:
    return Metric("angle_error", 2, lambda a, b: angle_error(a["u"], a["v"], b["u"], b["v"], sensitivity), "vector")


def of_local_std(window: int = 21, n_sigma: float = 3.0, eps: float = 1e-8, masked: bool = False) -> Metric:
    """The local deviation of each channel; with ``masked`` missing where the cell itself is."""
    return Metric("local_spatial_std", 1, lambda x, s: F.when(x.isNotNull(), s) if masked else s, spreads=(Spread((0,), window, n_sigma, eps),))


def of_drift_success(window: int = 21, n_sigma: float = 3.0, eps: float = 1e-8, least: float = 0.0, share: float = 0.674, mask: Column | None = None) -> Metric:
    """Of a forecast, an observation and the first state: 1 where the error is within a share of the local deviation of the
    observed change, or within ``least``. ``mask``: a condition over i and j outside which it is missing."""

    def of(p: Column, o: Column, o0: Column, s: Column) -> Column:
        valid = all_present(*[x[c] for x in (p, o, o0) for c in "uv"])
        hit = vector_norm(p["u"] - o["u"], p["v"] - o["v"]) <= greatest_of(vector_norm(s["u"], s["v"]) * share, least)
        return F.when(valid if mask is None else valid & mask, flag(F.coalesce(hit, F.lit(False))))

    return Metric("drift_success", 3, of, "vector", (Spread((1, 2), window, n_sigma, eps),))


def drift_success(rows: DataFrame, local: Column, least: float = 0.1, share: float = 0.674, mask: Column | None = None) -> DataFrame:
    """``rows`` (u1, v1 forecast; u2, v2 observed) with ``value``: hit within a share of the local spread.

    local: norm of the local standard deviation of the observed change. Cells outside the mask are missing."""
    return rows.withColumn("value", _drift_hit("u1", "v1", local, least, share, mask))


def _drift_hit(u: str, v: str, local: Column, least: float, share: float, mask: Column | None) -> Column:
    error = vector_norm(F.col(u) - F.col("u2"), F.col(v) - F.col("v2"))
    valid = all_present(F.col(u), F.col(v), F.col("u2"), F.col("v2"), local)
    return F.when(valid if mask is None else valid & mask, flag(error <= greatest_of(local * share, least)))


def drift_efficiency(rows: DataFrame, local: Column, least: float = 0.1, share: float = 0.674, mask: Column | None = None) -> DataFrame:
    """``rows`` (u1, v1 forecast; u2, v2 observed; u0, v0 first state) with ``value``: success of the forecast
    beyond that of the first state."""
    hit = lambda u, v: _drift_hit(u, v, local, least, share, mask)
    return rows.withColumn("value", hit("u1", "v1") - hit("u0", "v0"))


def ssim_of(mx: Column, my: Column, mxx: Column, myy: Column, mxy: Column, reach: float, clamp: bool = False) -> tuple[Column, Column]:
    """Similarity and contrast-structure of local moments."""
    c1, c2 = (0.01 * reach) ** 2, (0.03 * reach) ** 2
    cs = ((mxy - mx * my) * 2 + c2) / ((mxx - mx * mx) + (myy - my * my) + c2)
    ssim = (mx * my * 2 + c1) / (mx * mx + my * my + c1) * cs
    return (F.greatest(ssim, F.lit(0.0)), F.greatest(cs, F.lit(0.0))) if clamp else (ssim, cs)


def clean(c: Column) -> Column:
    return null_if_nan(c)
