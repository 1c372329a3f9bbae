"""Regridding between grids whose lines are curves: weights by finding points in quadrilaterals on the sphere.

A quadrilateral is four unit vectors; in it a point has coordinates s and t, those of the bilinear
surface through its corners where the ray to the point meets it. Quadrilaterals are dealt into cubes
about as wide as they are, so each lies in eight at most, and a point asks one cube for each width
that occurs: one join of equality, whatever the grids' shapes, with no map projection and no seam."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridproof.functions.projection import EARTH_KM, from_polar
from gridproof.functions.scalars import unit_sphere

from .grid import corners, regrid_method

#: Corners in order about the quadrilateral, as steps of i and j.
ROUND = ((0, 0), (0, 1), (1, 1), (1, 0))
#: How far outside a point may lie and still be on the edge, as a share of the side.
EDGE = 1e-9
Vector = tuple[Column, Column, Column]


def _vector(name: str) -> Vector:
    return tuple(F.col(f"{name}_{a}") for a in "xyz")


def _named(v: Sequence[Column], name: str) -> dict[str, Column]:
    return {f"{name}_{a}": c for a, c in zip("xyz", v, strict=True)}


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _det(a: Vector, b: Vector, c: Vector) -> Column:
    return a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def _fixed(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``df`` with further columns as values: what refers to them later doesn't repeat the expressions that made them,
    as the optimizer does where a column is used many times over in a long chain."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return df.withColumn("made", made).select(*df.columns, "made.*")


def centre_quads(grid: DataFrame, wrap: int | None = None) -> DataFrame:
    """quad (struct i, j) and corners k0..k3 (x, y, z): the quadrilaterals of neighbouring centres of a grid (i, j, lat, lon).

    ``wrap``: the number of columns of a grid that closes upon itself, whose last column neighbours the first."""
    step = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(ROUND)]))
    # asked of values that are made, as a condition on lat and lon is looked at once for each row that a distinct cell comes from
    placed = _fixed(grid.select("i", "j", "lat", "lon"), dict(zip("xyz", unit_sphere(F.col("lat"), F.col("lon")), strict=True)))
    rows = placed.where("x IS NOT NULL").select("i", "j", "x", "y", "z", step.alias("c"))
    j = F.col("j") - F.col("c.b")
    rows = rows.withColumn("quad", F.struct((F.col("i") - F.col("c.a")).alias("i"), (j if wrap is None else F.pmod(j, F.lit(wrap))).alias("j")))
    at = {f"k{k}_{a}": F.max(F.when(F.col("c.k") == k, F.col(a))).alias(f"k{k}_{a}") for k in range(4) for a in "xyz"}
    return rows.groupBy("quad").agg(F.count("*").alias("n"), *at.values()).where("n = 4").select("quad", *at)


def cell_quads(grid: DataFrame) -> DataFrame:
    """quad (struct i, j), corners k0..k3 (x, y, z) and area in km2: the cells of a grid (i, j, lat, lon) about its centres."""
    at = {}
    for k in range(4):
        at |= _named(unit_sphere(*from_polar(F.col(f"x{k}"), F.col(f"y{k}"))), f"k{k}")
    k0, k1, k2, k3 = (_vector(f"k{k}") for k in range(4))
    half = lambda a, b, c: F.atan2(F.abs(_det(a, b, c)), 1 + _dot(a, b) + _dot(b, c) + _dot(a, c)) * 2
    area = (half(k0, k1, k2) + half(k0, k2, k3)) * EARTH_KM**2
    return _fixed(corners(grid), at).select(F.struct("i", "j").alias("quad"), *at, area.alias("area"))


def located(points: DataFrame, quads: DataFrame) -> DataFrame:
    """point, quad, s, t of the points (point, p_x, p_y, p_z) that lie in a quadrilateral; of several in the least one."""
    cube = ("level", "cx", "cy", "cz")
    edges = {f"{n}_{a}": f(*[F.col(f"k{k}_{a}") for k in range(4)]) for a in "xyz" for n, f in (("low", F.least), ("high", F.greatest))}
    sizes = [F.col(f"high_{a}") - F.col(f"low_{a}") for a in "xyz"]
    q = _fixed(quads, edges)
    # the sphere rises over a flat quadrilateral by under a quarter of the square of its box's diagonal
    q = _fixed(q, {"rise": sum((x * x for x in sizes), F.lit(0.0)) / 4 + EDGE})
    q = _fixed(q, {"level": F.floor(-F.log2(F.greatest(*sizes) + F.col("rise") * 2)).cast("int")})
    width = F.pow(F.lit(2.0), -F.col("level"))
    for a in "xyz":
        reach = F.sequence(F.floor((F.col(f"low_{a}") - F.col("rise")) / width), F.floor((F.col(f"high_{a}") + F.col("rise")) / width))
        q = q.withColumn(f"c{a}", F.explode(reach))
    q = q.select(*cube, "quad", *[f"k{k}_{a}" for k in range(4) for a in "xyz"])
    asked = points.crossJoin(F.broadcast(q.select("level").distinct()))  # one row for each power of two that a quadrilateral is wide
    asked = asked.withColumns({f"c{a}": F.floor(F.col(f"p_{a}") / width) for a in "xyz"})
    rows = asked.join(q, list(cube))
    p, k0, k1, k2, k3 = map(_vector, ("p", "k0", "k1", "k2", "k3"))
    rows = rows.where(_dot(p, k0) > 0)
    rows = _fixed(rows, _named([b - a for a, b in zip(k0, k1, strict=True)], "b") | _named([c - a for a, c in zip(k0, k3, strict=True)], "c") | _named([a - b - c + d for a, b, c, d in zip(k0, k1, k3, k2, strict=True)], "d"))
    # the surface k0 + s b + t c + s t d, seen from the point: a square equation for t
    a, b, c, d = k0, _vector("b"), _vector("c"), _vector("d")
    rows = _fixed(rows, {"e0": _det(p, a, b), "e1": _det(p, a, d) + _det(p, c, b), "e2": _det(p, c, d)})
    rows = _fixed(rows, {"root": F.col("e1") + F.when(F.col("e1") < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(F.col("e1") * F.col("e1") - F.col("e2") * F.col("e0") * 4, F.lit(0.0)))})
    ratio = lambda x, y: F.when(y != 0, x / y)
    rows = _fixed(rows, {"t0": ratio(F.col("e0") * -2, F.col("root")), "t1": ratio(-F.col("root"), F.col("e2") * 2)})
    sides = {}
    for n in ("0", "1"):
        u, v = ([x + F.col(f"t{n}") * y for x, y in zip(*pair, strict=True)] for pair in ((a, c), (b, d)))
        along = lambda x, y: _dot(x, y) - _dot(x, p) * _dot(y, p)
        sides[f"s{n}"] = ratio(-along(u, v), along(v, v))
    rows = _fixed(rows, sides)
    inside = lambda n: F.coalesce(F.col(f"s{n}").between(-EDGE, 1 + EDGE) & F.col(f"t{n}").between(-EDGE, 1 + EDGE), F.lit(False))
    clip = lambda x: F.least(F.greatest(F.col(x), F.lit(0.0)), F.lit(1.0))
    pick = lambda x: F.when(inside("0"), clip(f"{x}0")).otherwise(clip(f"{x}1")).alias(x)
    rows = rows.where(inside("0") | inside("1")).select("point", F.struct("quad", pick("s"), pick("t")).alias("found"))
    return rows.groupBy("point").agg(F.min("found").alias("found")).select("point", "found.*")


def bilinear_between(src: DataFrame, dst: DataFrame, wrap: int | None = None) -> DataFrame:
    """src_i, src_j, dst_i, dst_j, w: the weights of the four centres of ``src`` about each centre of ``dst`` (i, j, lat, lon).

    A destination outside of all source centres has none."""
    points = dst.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.struct("i", "j").alias("point"), *[c.alias(n) for n, c in _named(unit_sphere(F.col("lat"), F.col("lon")), "p").items()])
    s, t = F.col("s"), F.col("t")
    share = {(0, 0): (1 - s) * (1 - t), (0, 1): s * (1 - t), (1, 1): s * t, (1, 0): (1 - s) * t}
    j = lambda b: F.col("quad.j") + b if wrap is None else F.pmod(F.col("quad.j") + b, F.lit(wrap))
    each = F.explode(F.array(*[F.struct((F.col("quad.i") + a).alias("src_i"), j(b).alias("src_j"), w.alias("w")) for (a, b), w in share.items()]))
    rows = located(points, centre_quads(src, wrap)).select(F.col("point.i").alias("dst_i"), F.col("point.j").alias("dst_j"), each.alias("x"))
    return rows.select("x.src_i", "x.src_j", "dst_i", "dst_j", "x.w").where("w > 0")


def conservative_between(src: DataFrame, dst: DataFrame, n: int = 8, covered: bool = True) -> DataFrame:
    """src_i, src_j, dst_i, dst_j, w, area: the share of each destination cell that a source cell fills, and its km2.

    Each source cell is n x n points that carry equal parts of its area; a point counts for the
    destination cell that holds it. Where ``covered`` the weights of a destination add up to 1 over
    what of it is covered, else to the share of it that is."""
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = cell_quads(src).withColumn("a", at).withColumn("b", at)
    s, t = (F.col("b") + 0.5) / n, (F.col("a") + 0.5) / n
    middle = [(1 - s) * (1 - t) * k0 + s * (1 - t) * k1 + s * t * k2 + (1 - s) * t * k3 for k0, k1, k2, k3 in zip(*(_vector(f"k{k}") for k in range(4)), strict=True)]
    cells, m = _fixed(cells, _named(middle, "m")), _vector("m")
    points = cells.select(F.struct("quad", "a", "b", (F.col("area") / (n * n)).alias("part")).alias("point"), *[(c / F.sqrt(_dot(m, m))).alias(name) for name, c in _named(m, "p").items()])
    target = cell_quads(dst)
    parts = located(points, target.drop("area")).groupBy(F.col("point.quad").alias("from"), F.col("quad").alias("to")).agg(F.sum("point.part").alias("area"))
    whole = parts.groupBy("to").agg(F.sum("area").alias("whole")) if covered else target.select(F.col("quad").alias("to"), F.col("area").alias("whole"))
    return parts.join(whole, "to").select(F.col("from.i").alias("src_i"), F.col("from.j").alias("src_j"), F.col("to.i").alias("dst_i"), F.col("to.j").alias("dst_j"), (F.col("area") / F.col("whole")).alias("w"), "area")


def weights_between(src: DataFrame, dst: DataFrame, n: int = 8) -> DataFrame:
    """Weights of the method that the grids' mean cell areas ask for: conservative where the source is the finer one, else bilinear."""
    if regrid_method(*(cell_quads(g).select("area") for g in (src, dst))) == "conservative":
        return conservative_between(src, dst, n).drop("area")
    return bilinear_between(src, dst)


def everywhere(regridded: DataFrame, field: DataFrame, dst: DataFrame) -> DataFrame:
    """The regridded field with all cells of ``dst``: those that nothing reaches are missing.

    The times are counted with their values, so that both sides of the plan read one exchange of the field."""
    times = field.groupBy("dataset", "date", "channel").agg(F.count("value").alias("n")).where("n >= 0").drop("n")
    full = times.crossJoin(dst.select("i", "j"))  # the product is the result
    return full.join(regridded, ["dataset", "date", "channel", "i", "j"], "left").select("dataset", "date", "channel", "i", "j", "value")


