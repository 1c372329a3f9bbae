"""Points in polygons of any number of edges, by covers of cells.

The plane is cut into square cells about as wide as an edge is long, or less where points are many. A cell that an edge passes keeps
its edges and the parity of one reference point, its left side at a fixed height; a point in it is
told by the few edges that the way from there crosses. Parities come from one walk along each row of
cells. Between the cells of a polygon's boundary a row is all inside or all outside; the inner runs are
stored as blocks of 4 ** k cells, so a point asks once for each width of block and no edge is looked
at. Work grows with edges plus points, whatever the coast's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridproof.functions.storage import stored

#: Where rows of cells have their reference height and the plane its origin: no multiple of usual coordinates.
HEIGHT, SHIFT = 0.3819660112501051, 0.2360679774997897
#: Widths of blocks of inner cells: 4 ** k.
BLOCKS = 8


def _cell(c: Column | str, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size + SHIFT)


def _low(cell: Column, size: float) -> Column:
    return (cell - SHIFT) * size


def boundary(edges: DataFrame, size: float) -> DataFrame:
    """poly_id, cy, cx, edges, parity: the cells of each polygon's boundary; of edges (poly_id, x1, y1, x2, y2).

    parity: whether the cell's left side lies inside at the row's reference height, as 1 or 0."""
    slack, low, high = size * 1e-9, F.least("y1", "y2"), F.greatest("y1", "y2")
    # an edge is a run of cells in each row that it passes; a little more is held, as that does no harm
    of_rows = edges.withColumn("cy", F.explode(F.sequence(_cell(low - slack, size), _cell(high + slack, size))))
    x_at = lambda y: F.col("x1") + F.when(F.col("y2") != F.col("y1"), (y - F.col("y1")) / (F.col("y2") - F.col("y1"))).otherwise(0.0) * (F.col("x2") - F.col("x1"))
    ends = x_at(F.greatest(low, _low(F.col("cy"), size) - slack)), x_at(F.least(high, _low(F.col("cy") + 1, size) + slack))
    level = F.col("y1") == F.col("y2")
    first, last = (F.when(level, f("x1", "x2")).otherwise(f(*ends)) for f in (F.least, F.greatest))
    edge = F.struct("x1", "y1", "x2", "y2")
    held = of_rows.select("poly_id", edge.alias("edge"), "cy", F.explode(F.sequence(_cell(first - slack, size), _cell(last + slack, size))).alias("cx")).select("poly_id", "cy", "cx", "edge", F.lit(0).alias("crossed"))
    # where an edge crosses the reference height of a row
    height = lambda cy: _low(cy + HEIGHT, size)
    rows = edges.withColumn("cy", F.explode(F.sequence(_cell(low, size) - 1, _cell(high, size)))).where((low <= height(F.col("cy"))) & (height(F.col("cy")) < high))
    x = F.col("x1") + (height(F.col("cy")) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossed = rows.select("poly_id", "cy", _cell(x, size).alias("cx"), F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>").alias("edge"), F.lit(1).alias("crossed"))
    one = held.unionByName(crossed).groupBy("poly_id", "cy", "cx").agg(F.collect_list("edge").alias("edges"), F.sum("crossed").alias("crossed"))
    w = Window.partitionBy("poly_id", "cy").orderBy("cx").rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumn("up_to", F.sum("crossed").over(w)).select("poly_id", "cy", "cx", "edges", ((F.col("up_to") - F.col("crossed")) % 2).cast("int").alias("parity"), (F.col("up_to") % 2).cast("int").alias("after"))


def inner(cells: DataFrame) -> DataFrame:
    """poly_id, cy, level, block: the runs of cells inside, between those of the boundary, as blocks of 4 ** level cells."""
    w = Window.partitionBy("poly_id", "cy").orderBy("cx")
    runs = cells.withColumn("next", F.lead("cx").over(w)).where("after = 1 AND next > cx + 1").select("poly_id", "cy", (F.col("cx") + 1).alias("a"), F.col("next").alias("b"))
    every = []
    for level in range(BLOCKS + 1):
        width = 4**level
        # whole blocks of this width in [a, b) that lie in none of the next
        first, last = F.ceil(F.col("a") / width), F.floor(F.col("b") / width)
        wide_first, wide_last = F.ceil(F.col("a") / (4 * width)) * 4, F.floor(F.col("b") / (4 * width)) * 4
        free = F.when((wide_first >= wide_last) | F.lit(level == BLOCKS), F.array(F.struct(first.alias("a"), last.alias("b")))).otherwise(F.array(F.struct(first.alias("a"), wide_first.alias("b")), F.struct(wide_last.alias("a"), last.alias("b"))))
        blocks = F.flatten(F.transform(F.filter(free, lambda r: r["a"] < r["b"]), lambda r: F.sequence(r["a"], r["b"] - 1)))
        of = F.lit(level).alias("level")
        every.append(F.transform(blocks, lambda x: F.struct(of, x.alias("block"))))  # noqa: B023
    return runs.select("poly_id", "cy", F.explode(F.concat(*every)).alias("x")).select("poly_id", "cy", "x.level", "x.block")


def fitting(points: DataFrame, edges: DataFrame) -> float:
    """A width of cells for which edges are in few cells and points meet few edges.

    Edges of a length of l together are in l / size cells, and by their number in a cell the n points of an area a
    meet l * size * n / a of them. The sum is least where a cell has a point; as to store an edge in a cell takes
    some four times as long as to look at it, cells are twice as wide. Cells wider than an edge save nothing."""
    each = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    ends = {f"{n}_{a}": f(g(f"{a}1", f"{a}2")) for a in "xy" for n, f, g in (("low", F.min, F.least), ("high", F.max, F.greatest))}
    box = edges.agg(F.avg(each).alias("long"), *[c.alias(n) for n, c in ends.items()]).first()  # five numbers
    if not box["long"]:
        return 1.0
    n = points.where(F.col("x").between(box["low_x"], box["high_x"]) & F.col("y").between(box["low_y"], box["high_y"])).count()
    area = (box["high_x"] - box["low_x"]) * (box["high_y"] - box["low_y"])
    return float(min(box["long"], 2 * (area / n) ** 0.5)) if n and area else float(box["long"])


def inside(points: DataFrame, edges: DataFrame, size: float | None = None) -> DataFrame:
    """point, poly_id of points (point, x, y) inside polygons given by edges; odd counts are inside, holes are edges as well.

    size: width of a cell, by default the mean length of an edge, or less where that leaves many points to a cell.
    The joins merge both sides, as sizes estimated before rows are exploded would have them broadcast."""
    edges = edges.where("x1 <> x2 OR y1 <> y2")
    size = size or fitting(points, edges)
    cells = stored(boundary(edges.select("poly_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]), float(size)), "cover")
    p = points.where("x IS NOT NULL AND y IS NOT NULL").select("point", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumns({"cx": _cell("x", size), "cy": _cell("y", size)})
    met = p.join(cells.select("poly_id", "cy", "cx", "edges", "parity").hint("merge"), ["cy", "cx"])
    left, ref = _low(F.col("cx"), size), _low(F.col("cy") + HEIGHT, size)

    def crosses(e: Column) -> Column:
        """Crossings of an edge by the way from the reference point up or down to the point's height, and on to the point."""
        y_at = e["y1"] + (left - e["x1"]) * (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])
        side = (F.least(e["x1"], e["x2"]) < left) & (F.greatest(e["x1"], e["x2"]) >= left)
        up = F.when(side, ((y_at > ref) != (y_at > F.col("y"))).cast("int")).otherwise(0)
        x_at = e["x1"] + (F.col("y") - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        level = (F.least(e["y1"], e["y2"]) <= F.col("y")) & (F.col("y") < F.greatest(e["y1"], e["y2"]))
        return up + F.when(level, ((x_at >= left) & (x_at <= F.col("x"))).cast("int")).otherwise(0)

    odd = F.aggregate("edges", F.col("parity"), lambda a, e: a + crosses(e)) % 2 == 1
    near = met.where(odd).select("point", "poly_id")
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("cx") / 4**k).alias("block")) for k in range(BLOCKS + 1)]))
    far = p.select("point", "cy", levels.alias("l")).select("point", "cy", "l.level", "l.block").join(inner(cells).hint("merge"), ["cy", "level", "block"]).select("point", "poly_id")
    return near.unionByName(far)
