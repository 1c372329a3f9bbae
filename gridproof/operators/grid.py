"""Grids, neighbours, interpolation, polygons and local moments, as keyed joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridproof.functions.projection import EARTH_KM, from_polar, to_polar
from gridproof.functions.scalars import unit_sphere
from gridproof.functions.storage import stored

from . import covers
from .quantiles import quantiles
from .tiles import Tile, over_tiles


def mesh(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """i, j, lat, lon: the product of a latitude (i, lat) and a longitude (j, lon) axis."""
    return lats.select("i", "lat").crossJoin(lons.select("j", "lon"))  # the product is the result


def projected_grid(spark, x: tuple[float, float, int], y: tuple[float, float, int], turn: float = 0.0) -> DataFrame:
    """Regular grid in the polar stereographic plane: (first, last, n) of both axes, ends included."""
    at = lambda c, a: F.col(c) * ((a[1] - a[0]) / (a[2] - 1)) + a[0]
    cells = spark.range(y[2]).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(x[2]).select(F.col("id").cast("int").alias("j")))
    px, py = at("j", x), at("i", y)
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    lat, lon = from_polar(px * c - py * s, px * s + py * c)
    return cells.select("i", "j", lat.alias("lat"), lon.alias("lon"))


def corners(grid: DataFrame) -> DataFrame:
    """x0..x3, y0..y3: corners of each cell in the projected plane, counter-clockwise from (i, j).

    Centres are padded by a linear step beyond the edges, rows first and then columns, so the
    padding's own corners come from padded centres; a corner is the mean of the four about it."""
    x, y = to_polar(F.col("lat"), F.col("lon"))
    p = grid.select("i", "j", x.alias("x"), y.alias("y"))
    for axis, other in (("i", "j"), ("j", "i")):
        w = Window.partitionBy(other).orderBy(axis)
        near = p.withColumns({"n": F.count("*").over(Window.partitionBy(other)), "k": F.row_number().over(w), **{f"{d}{c}": f(c).over(w) for c in "xy" for d, f in (("a", F.lead), ("b", F.lag))}})
        edge = lambda k, step, d: near.where(k).select((F.col(axis) + step).cast("int").alias(axis), other, *[(F.col(c) * 2 - F.col(f"{d}{c}")).alias(c) for c in "xy"])  # noqa: B023, E731
        p = p.unionByName(edge(F.col("k") == 1, -1, "a")).unionByName(edge(F.col("k") == F.col("n"), 1, "b"))
    # each centre is a quarter of its four corners; corner (i, j) is the lower left of cell (i, j)
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    c = p.withColumn("s", shift).groupBy((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).where("n = 4")
    own = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))]))
    rows = c.withColumn("s", own).select((F.col("i") - F.col("s.a")).alias("i"), (F.col("j") - F.col("s.b")).alias("j"), "s.k", "x", "y")
    out = rows.groupBy("i", "j").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("k") == k, F.col(v))).alias(f"{v}{k}") for k in range(4) for v in "xy"]).where("n = 4").drop("n")
    return grid.select("i", "j").join(out, ["i", "j"])


def cell_area(cells: DataFrame) -> DataFrame:
    """i, j, area in km2 of spherical quadrilaterals with the corners of ``corners``."""
    rows, triples = cells, []
    for k in range(4):
        lat, lon = from_polar(F.col(f"x{k}"), F.col(f"y{k}"))
        x, y, z = unit_sphere(lat, lon)
        rows = rows.withColumns({f"p{k}": x, f"q{k}": y, f"r{k}": z})
    dot = lambda a, b: F.col(f"p{a}") * F.col(f"p{b}") + F.col(f"q{a}") * F.col(f"q{b}") + F.col(f"r{a}") * F.col(f"r{b}")
    for a, b, c in ((0, 1, 2), (0, 2, 3)):
        det = F.col(f"p{a}") * (F.col(f"q{b}") * F.col(f"r{c}") - F.col(f"r{b}") * F.col(f"q{c}")) - F.col(f"q{a}") * (F.col(f"p{b}") * F.col(f"r{c}") - F.col(f"r{b}") * F.col(f"p{c}")) + F.col(f"r{a}") * (F.col(f"p{b}") * F.col(f"q{c}") - F.col(f"q{b}") * F.col(f"p{c}"))
        triples.append(F.atan2(F.abs(det), 1 + dot(a, b) + dot(b, c) + dot(a, c)) * 2)
    return rows.select("i", "j", ((triples[0] + triples[1]) * EARTH_KM**2).alias("area"))


#: Parts that a source cell's dates are dealt into.
PARTS = 16


def regridded(field: DataFrame, weights: DataFrame) -> DataFrame:
    """Fields on the destination grid; a destination with a missing contributor is missing.

    weights: src_i, src_j, dst_i, dst_j, w. A coarse source cell is in very many destinations, so few rows make
    many: the join is dealt by cells and parts of the dates into as many tasks as a shuffle has, of which none are put together."""
    n = int(field.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, times = ["i", "j", "part"], ["dataset", "date", "channel"]
    needed = F.count("*").over(Window.partitionBy("dst_i", "dst_j"))
    w = weights.select(F.col("src_i").alias("i"), F.col("src_j").alias("j"), "dst_i", "dst_j", "w", needed.alias("n"))
    w = w.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(n, *keys)
    rows = field.withColumn("part", F.pmod(F.hash(*times), F.lit(PARTS))).repartition(n, *keys)
    got = rows.join(w.hint("merge"), keys).groupBy(*times, "dst_i", "dst_j").agg(F.sum(F.col("value") * F.col("w")).alias("s"), F.count("value").alias("c"), F.max("n").alias("n"))
    return got.select(*times, F.col("dst_i").alias("i"), F.col("dst_j").alias("j"), F.when(F.col("c") == F.col("n"), F.col("s")).alias("value"))


def bilinear_weights(points: DataFrame) -> DataFrame:
    """Weights of points (dst_i, dst_j, x, y) given in a grid's index space; ``curvilinear`` has those of points on the sphere."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    rows = points.withColumns({"fi": F.floor("y"), "fj": F.floor("x")}).withColumn("c", corner)
    part = lambda f, v, s: F.when(s == 1, F.col(v) - F.col(f)).otherwise(1 - F.col(v) + F.col(f))
    rows = rows.withColumn("w", part("fi", "y", F.col("c.a")) * part("fj", "x", F.col("c.b")))
    return rows.where("w > 0").select((F.col("fi") + F.col("c.a")).cast("int").alias("src_i"), (F.col("fj") + F.col("c.b")).cast("int").alias("src_j"), "dst_i", "dst_j", "w")


#: Cubes of the nearest search are 2 ** -level wide; the finest ones span about 1.5 km of the Earth.
FINEST = 12


def nearest(points: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    """query, point, d, rank: the k nearest by chord distance on the unit sphere; ties by point.

    points: point, lat, lon; queries: query, lat, lon. The space is cut into cubes of several levels.
    The finest cube about a query that holds k points bounds the distance of its k-th neighbour by the
    cube's diagonal, and all points within it lie in the cubes of twice that width about the query's
    own. So one join of equality on cubes finds all candidates, in as many cubes as the points' density
    there asks for, and the plan doesn't grow. Where the coarsest cube has fewer than k points, the
    query meets all points within reach of the next ones, up to the whole sphere. The joins merge both
    sides, as a size estimated before the levels are exploded would have them broadcast."""
    xyz = lambda df, name: df.select(name, *[c.alias(a) for a, c in zip("xyz", unit_sphere(F.col("lat"), F.col("lon")), strict=True)])
    cube = lambda a: F.floor(F.col(a) * F.pow(F.lit(2.0), F.col("level"))).cast("int")
    cubes = ("level", "cx", "cy", "cz")
    at_level = lambda df: df.withColumns({f"c{a}": cube(a) for a in "xyz"})
    levels = lambda lo: F.explode(F.sequence(F.lit(lo), F.lit(FINEST)))
    p, q = xyz(points, "point"), xyz(queries, "query")
    held = at_level(p.withColumn("level", levels(-1)))
    dense = held.groupBy(*cubes).agg(F.count("*").alias("n")).where(F.col("n") >= k)
    asked = at_level(q.withColumn("level", levels(0)))
    best = asked.join(dense.select(*cubes).hint("merge"), list(cubes)).groupBy("query").agg(F.max("level").alias("best"))
    asked = q.join(best.hint("merge"), "query", "left").withColumn("level", F.coalesce(F.col("best") - 1, F.lit(-1)))
    asked = at_level(asked.withColumn("bound", F.coalesce(F.pow(F.lit(2.0), -F.col("best")) * 3**0.5 + 1e-12, F.lit(3.0))))
    for a in ("cx", "cy", "cz"):
        asked = asked.withColumn("near", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(a, F.col(a) + F.col("near")).drop("near")
    other = held.select(*cubes, "point", *[F.col(a).alias(f"p{a}") for a in "xyz"])
    d = F.sqrt(sum((F.col(a) - F.col(f"p{a}")) * (F.col(a) - F.col(f"p{a}")) for a in "xyz"))
    found = asked.join(other.hint("merge"), list(cubes)).select("query", "point", d.alias("d"), "bound").where(F.col("d") <= F.col("bound")).drop("bound")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", "point"))).where(F.col("rank") <= k)


def inverse_weights(near: DataFrame, how: str = "inverse", sigma2: float | None = None) -> DataFrame:
    """near with ``w``, weights of each query that add up to 1; a query on a point takes that point alone.

    gaussian: sigma2 is by default a ninth of the median squared distance."""
    if how == "gaussian":
        if sigma2 is None:
            near = stored(near, "near")
            middle = quantiles(near, (0.5,), value="d").first()  # one number
            sigma2 = middle.q[0] ** 2 / 9 if middle and middle.q else 1.0
        raw = F.exp(-F.col("d") * F.col("d") / (2 * sigma2))
    else:
        exact = F.min("d").over(Window.partitionBy("query")) == 0
        raw = F.when(exact, F.when(F.col("d") == 0, 1.0).otherwise(0.0)).otherwise(1 / F.col("d"))
    rows = near.withColumn("r", raw)
    w = Window.partitionBy("query")
    total = F.sum("r").over(w)
    return rows.withColumn("w", F.when(total > 0, F.col("r") / total).otherwise(F.lit(1.0) / F.count("*").over(w))).drop("r")


def interpolated(weights: DataFrame, values: DataFrame, skip_missing: bool = True) -> DataFrame:
    """query, value. values: point, value. Missing neighbours are left out and the rest reweighted.

    The join merges both sides, so a grid's values are not broadcast."""
    rows = weights.join(values.hint("merge"), "point", "left")
    some = F.when(F.col("value").isNotNull(), F.col("w"))
    out = rows.groupBy("query").agg(F.sum(F.col("value") * F.col("w")).alias("s"), F.sum(some).alias("t"), F.count("value").alias("c"), F.count("*").alias("n"))
    ok = F.col("t") > 0 if skip_missing else F.col("c") == F.col("n")
    return out.select("query", F.when(ok, F.col("s") / (F.col("t") if skip_missing else F.lit(1.0))).alias("value"))


def coverage(near: DataFrame, most: float, fill: float | None = None) -> DataFrame:
    """1 where the mean distance of a query's neighbours is within a limit, else the fill."""
    return near.groupBy("query").agg(F.when(F.avg("d") <= most, 1.0).otherwise(F.lit(fill).cast("double")).alias("mask"))


def in_polygons(points: DataFrame, edges: DataFrame, strip: float) -> DataFrame:
    """point, poly_id of points (point, x, y) inside polygons given by edges (poly_id, x1, y1, x2, y2).

    An edge counts for a point left of it whose y is in [low, high): odd counts are inside, and holes
    are edges of the same polygon. Edges are dealt into strips of y, so the join is one of equality."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.withColumns({"lo": lo, "hi": hi}).where("lo < hi").withColumn("s", F.explode(F.sequence(F.floor(F.col("lo") / strip), F.floor(F.col("hi") / strip))))
    rows = points.withColumn("s", F.floor(F.col("y") / strip)).join(e, "s").where("y >= lo AND y < hi")
    cross = F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return rows.where(cross).groupBy("point", "poly_id").agg(F.count("*").alias("n")).where("n % 2 = 1").select("point", "poly_id")


def labelled(points: DataFrame, edges: DataFrame, order: DataFrame, strip: float | None = None) -> DataFrame:
    """point, label: of the polygons that hold a point the last by poly_order (order: poly_id, poly_order, label); 0 for none.

    By covers of cells, which coasts of very many edges need, or for few edges by strips of a width."""
    held = covers.inside(points, edges) if strip is None else in_polygons(points, edges, strip)
    best = held.join(order, "poly_id").groupBy("point").agg(F.max_by("label", "poly_order").alias("label"))
    return points.select("point").join(best, "point", "left").select("point", F.coalesce("label", F.lit(0)).alias("label"))


def numbered(polygons: DataFrame) -> DataFrame:
    """poly_id, poly_order, label: labels 1, 2, ... in the order of poly_order; of (poly_id, poly_order, label, n_edges).

    A polygon without edges gets none and uses no number; a given label stays, and 0 is an error, as it stands for none."""
    own = polygons.where("n_edges > 0").withColumn("place", F.row_number().over(Window.orderBy("poly_order", "poly_id")))  # polygons: a short list
    label = F.coalesce("label", "place").cast("int")
    bad = F.raise_error(F.concat(F.lit("label 0 of polygon "), F.col("poly_id").cast("string"))).cast("int")
    return own.select("poly_id", "poly_order", F.when(label != 0, label).otherwise(bad).alias("label"))


def in_convex(corners_ij: list[tuple[float, float]]) -> Column:
    """Whether (i, j) is on the inner side of every edge of a convex polygon, corners in order."""
    inside = F.lit(True)
    for (i0, j0), (i1, j1) in zip(corners_ij[-1:] + corners_ij[:-1], corners_ij, strict=True):
        inside = inside & ((F.col("j") - j0) * (i1 - i0) - (F.col("i") - i0) * (j1 - j0) <= 0)
    return inside


def land_mask(grid: DataFrame, land: DataFrame, step: float) -> DataFrame:
    """grid with ``is_land``, from a table of land cells (a, b) of ``step`` degrees."""
    at = lambda c: F.floor(F.col(c) / step).cast("int")
    has = land.select("a", "b").distinct().withColumn("is_land", F.lit(True))
    rows = grid.withColumns({"a": at("lat"), "b": at("lon")}).join(has, ["a", "b"], "left")
    return rows.drop("a", "b").withColumn("is_land", F.coalesce("is_land", F.lit(False)))


def local_sums(window: int, n_sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    """Sums of an array by Gaussian weights of a square window, by rows and then by columns; in extended precision, as quotients of them are wanted."""
    half, sigma = window // 2, (window - 1) / (2 * n_sigma)
    weights = np.exp(-0.5 * (np.arange(-half, half + 1, dtype=np.longdouble) / sigma) ** 2)

    def along(x: np.ndarray, axis: int) -> np.ndarray:
        out, n = np.zeros_like(x), x.shape[axis]
        own, other = (np.moveaxis(y, axis, 0) for y in (out, x))
        for o, w in zip(range(-half, half + 1), weights, strict=True):
            own[max(0, -o) : max(0, n - max(0, o))] += w * other[max(0, o) : max(0, n + min(0, o))]
        return out

    return lambda x: along(along(x.astype(np.longdouble), 0), 1)


def local_moments(field: DataFrame, window: int, n_sigma: float, keys: Sequence[str] | None = None, side: int | None = None, **values: Column) -> DataFrame:
    """Gaussian means over the present cells of a square window, for each named value; a tile is weighted by rows and then by columns."""
    keys = list(keys or [c for c in field.columns if c not in ("i", "j", "value")])
    sums = local_sums(window, n_sigma)

    def of(tile: Tile) -> dict[str, np.ndarray]:
        dense = {n: sums(np.where(np.isnan(x), 0, x)) for n, x in tile.values.items()}
        some = dense.pop("present")
        with np.errstate(invalid="ignore", divide="ignore"):
            return {n: np.where(some > 0, x / some, np.nan) for n, x in dense.items()}

    present = F.col("value").isNotNull().cast("double")
    return over_tiles(field, keys, window // 2, {"present": present, **values}, of, list(values), side)


def local_std(field: DataFrame, window: int = 21, n_sigma: float = 3.0, eps: float = 1e-8, masked: bool = False) -> DataFrame:
    """Local standard deviation by cell; with ``masked`` missing where the cell itself is."""
    v = F.col("value")
    m = local_moments(field, window, n_sigma, m1=v, m2=v * v)
    out = m.withColumn("value", F.sqrt(F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0)) + eps)).drop("m1", "m2")
    if masked:
        keys = [c for c in field.columns if c != "value"]
        out = out.join(field.where("value IS NOT NULL").select(*keys), keys, "left_semi")
    return out


def outline(grid: DataFrame) -> DataFrame:
    """ring_order, i, j, lat, lon: the grid's edge from the top left by top, right, bottom and left, closed."""
    n = grid.agg(F.max("i").alias("h"), F.max("j").alias("w"))  # one row
    g = grid.crossJoin(F.broadcast(n)).where("i = 0 OR j = w OR i = h OR j = 0")
    i, j, h, w = (F.col(c) for c in "ijhw")
    at = F.when(i == 0, j).when(j == w, w + i).when(i == h, w + h + w - j).otherwise(w + h + w + h - i)
    ring = g.select(at.alias("ring_order"), "i", "j", "lat", "lon", ((h + w) * 2).alias("last"))
    closed = ring.unionByName(ring.where("ring_order = 0").withColumn("ring_order", F.col("last")))
    bad = F.raise_error(F.lit("the grid's edge has missing coordinates")).cast("double")
    return closed.drop("last").withColumn("lat", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("lat")).otherwise(bad))


def axis_overlaps(src: DataFrame, dst: DataFrame, width: float) -> DataFrame:
    """s, d, share: the share of each destination interval (d, lo, hi) that a source interval (s, lo, hi) covers.

    Intervals are dealt into buckets of a width, so the join is one of equality."""
    bucket = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))
    a = src.withColumn("bucket", bucket)
    b = dst.withColumn("bucket", bucket).select("d", "bucket", F.col("lo").alias("lo_"), F.col("hi").alias("hi_"))
    share = (F.least("hi", "hi_") - F.greatest("lo", "lo_")) / (F.col("hi_") - F.col("lo_"))
    # a pair that meets in several buckets has the same share in each
    return a.join(b, "bucket").select("s", "d", share.alias("share")).where("share > 0").distinct()


def area_weights(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Conservative weights of two grids whose axes are parallel: the product of the overlaps of rows and columns."""
    i = rows.select(F.col("s").alias("src_i"), F.col("d").alias("dst_i"), F.col("share").alias("a"))
    j = cols.select(F.col("s").alias("src_j"), F.col("d").alias("dst_j"), F.col("share").alias("b"))
    return i.crossJoin(j).select("src_i", "src_j", "dst_i", "dst_j", (F.col("a") * F.col("b")).alias("w"))  # the product is the result


def regrid_method(src_area: DataFrame, dst_area: DataFrame) -> str:
    """conservative for a source finer than the destination by the mean area of cells, else bilinear."""
    a, b = (df.agg(F.avg("area")).first()[0] for df in (src_area, dst_area))  # two numbers
    return "conservative" if a < b else "bilinear"


def onto(field: DataFrame, cells: DataFrame, sites: DataFrame, k: int = 4, how: str = "inverse", skip_missing: bool = True) -> DataFrame:
    """dataset, date, channel, query, value: each date of a field at the sites, by the distances of the nearest cells.

    cells: i, j, lat, lon; sites: query, lat, lon. The weights are made once for all dates."""
    near = nearest(cells.select(F.struct("i", "j").alias("point"), "lat", "lon"), sites, k)
    w = inverse_weights(near, how).select("query", "point.i", "point.j", "w")
    some = F.when(F.col("value").isNotNull(), F.col("w"))
    rows = field.join(w, ["i", "j"]).groupBy("dataset", "date", "channel", "query")
    out = rows.agg(F.sum(F.col("value") * F.col("w")).alias("a"), F.sum(some).alias("b"), F.count("value").alias("c"))
    ok = F.col("b") > 0 if skip_missing else F.col("c") == k
    return out.select("dataset", "date", "channel", "query", F.when(ok, F.col("a") / (F.col("b") if skip_missing else F.lit(1.0))).alias("value"))


#: Names of latitude and longitude columns.
LAT_NAMES, LON_NAMES = ("lat", "latitude", "nav_lat", "XLAT"), ("lon", "longitude", "nav_lon", "XLONG")


def lat_lon(grid: DataFrame) -> DataFrame:
    """The grid with its coordinates called lat and lon, whichever of the known names they have."""
    for name, known in (("lat", LAT_NAMES), ("lon", LON_NAMES)):
        found = [c for c in grid.columns if c in known]
        if len(found) != 1:
            raise ValueError(f"one column of {known} is needed, not {found}")
        grid = grid.withColumnRenamed(found[0], name)
    return grid


def lat_lon_grid(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """i, j, lat, lon from two tables of coordinates: of axes (i) and (j) the mesh, of cells (i, j) the rows that both have; other shapes are an error."""
    y, x = (set(df.columns) & {"i", "j"} for df in (lats, lons))
    if (y, x) == ({"i"}, {"j"}):
        return mesh(lats, lons)
    if y == x == {"i", "j"}:
        return lats.join(lons, ["i", "j"]).select("i", "j", "lat", "lon")
    raise ValueError(f"the coordinates have different shapes: {sorted(y)} and {sorted(x)}")
