"""Points in polygons with many edges, holes and several parts: a cell index whose parity is known, so that points meet the edges of their cell only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidence.sources.files import materialize

#: Where in its cell the reference point of a cell lies; off any round fraction, so that no vertex shares its place.
_REF_X, _REF_Y = 0.5707963267, 0.4142135623
#: Edges that a cell has on average, if their ends were spread evenly.
EDGES_PER_CELL = 4


def ring_edges(points: DataFrame) -> DataFrame:
    """polygon, x1, y1, x2, y2: the edges of rings given by points (polygon, ring, nr, lon, lat), each point to the next, the last to the first.

    Holes are rings like others. Points without a place are left out, and so are edges without length.
    """
    known = points.where("lon is not null and lat is not null")
    order = Window.partitionBy("polygon", "ring").orderBy("nr")
    first = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(first))
    edges = known.select("polygon", F.col("lon").alias("x1"), F.col("lat").alias("y1"), after("lon").alias("x2"), after("lat").alias("y2"))
    return edges.where("y1 <> y2 or x1 <> x2")


def _spans(y: Column, y1: Column, y2: Column) -> Column:
    return (y1 > y) != (y2 > y)


def _at(y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where the edge's line has height y."""
    return F.try_divide((x2 - x1) * (y - y1), y2 - y1) + x1


@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    width: float
    height: float

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.floor((x - self.x0) / self.width).cast("long"), F.floor((y - self.y0) / self.height).cast("long")

    def ref_x(self, cx: Column) -> Column:
        return F.lit(self.x0) + (cx + _REF_X) * self.width

    def ref_y(self, cy: Column) -> Column:
        return F.lit(self.y0) + (cy + _REF_Y) * self.height


@dataclass(frozen=True)
class Index:
    """`cells`: polygon, cx, cy, parity of the cell's reference point, edges of the polygon in the cell; cells outside aren't listed."""

    grid: Grid
    cells: DataFrame


def index_of(edges: DataFrame) -> Index | None:
    """The index of polygons given by edges (None: there are no edges).

    A grid of about edges / EDGES_PER_CELL cells lies over all edges. An edge goes to the cells that it can touch, row
    by row. In every row of cells the reference line is crossed at some places, and the number of crossings to the east
    of a cell's reference point is its parity; crossings and points are counted in one window per row of cells.
    """
    edges = materialize(edges)
    found = edges.agg(F.count(F.lit(1)), F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    n, low_x, high_x, low_y, high_y = found
    if not n:
        return None
    side = max(1, math.ceil(math.sqrt(n / EDGES_PER_CELL)))
    grid = Grid(low_x, low_y, max((high_x - low_x) / side, 1e-12) * (1 + 1e-9), max((high_y - low_y) / side, 1e-12) * (1 + 1e-9))
    last = F.lit(side - 1)
    row_of = lambda y: F.greatest(F.lit(0), F.least(last, F.floor((y - grid.y0) / grid.height).cast("int")))
    column_of = lambda x, by: F.greatest(F.lit(0), F.least(last, F.floor((x - grid.x0) / grid.width + by).cast("int")))
    rows = edges.withColumn("cy", F.explode(F.sequence(row_of(F.least("y1", "y2")), row_of(F.greatest("y1", "y2")))))
    bottom, top = F.lit(grid.y0) + F.col("cy") * grid.height, F.lit(grid.y0) + (F.col("cy") + 1) * grid.height
    clip = lambda y: F.greatest(F.least("y1", "y2"), F.least(F.greatest("y1", "y2"), y))
    reach = [F.when(F.col("y1") == F.col("y2"), x).otherwise(_at(clip(y), *map(F.col, ("x1", "y1", "x2", "y2")))) for x, y in ((F.col("x1"), bottom), (F.col("x2"), top))]
    touched = rows.withColumn("cx", F.explode(F.sequence(column_of(F.least(*reach), -1e-6), column_of(F.greatest(*reach), 1e-6))))
    own = touched.groupBy("polygon", "cx", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    line = grid.ref_y(F.col("cy"))
    crossings = rows.where(_spans(line, F.col("y1"), F.col("y2"))).select("polygon", "cy", _at(line, *map(F.col, ("x1", "y1", "x2", "y2"))).alias("x"), F.lit(1).alias("crosses"), F.lit(None).cast("int").alias("cx"))
    # Cells of a row that can lie inside or have edges: those between the row's outermost edges.
    extent = touched.groupBy("polygon", "cy").agg(F.min("cx").alias("a"), F.max("cx").alias("b"))
    refs = extent.select("polygon", "cy", F.explode(F.sequence("a", "b")).alias("cx")).select("polygon", "cy", grid.ref_x(F.col("cx")).alias("x"), F.lit(0).alias("crosses"), "cx")
    east = Window.partitionBy("polygon", "cy").orderBy(F.desc("x"), "crosses").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parity = crossings.unionByName(refs).withColumn("parity", F.sum("crosses").over(east) % 2).where("cx is not null").select("polygon", "cx", "cy", F.col("parity").cast("int").alias("parity"))
    cells = parity.join(own, ["polygon", "cx", "cy"], "left").where("parity = 1 or edges is not null")
    return Index(grid, materialize(cells.select("polygon", F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), "parity", "edges")))


def _crossed(x: Column, y: Column, qx: Column, qy: Column, edges: Column) -> Column:
    """How many edges the way from (x, y) along its height to qx and then up or down to qy crosses."""

    def one(e: Column) -> Column:
        x1, y1, x2, y2 = (e[c] for c in ("x1", "y1", "x2", "y2"))
        place = _at(y, x1, y1, x2, y2)
        level = _spans(y, y1, y2) & ((x < place) != (qx < place))
        height = F.try_divide((y2 - y1) * (qx - x1), x2 - x1) + y1
        upright = ((x1 > qx) != (x2 > qx)) & ((y < height) != (qy < height))
        return level.cast("int") + upright.cast("int")

    return F.coalesce(F.aggregate(edges, F.lit(0), lambda s, e: s + F.coalesce(one(e), F.lit(0))), F.lit(0))


def containing(points: DataFrame, index: Index | None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows of `points` once per polygon that holds them, with `polygon`; points without a place are in none."""
    if index is None:
        return points.limit(0).withColumn("polygon", F.lit(None).cast("int"))
    cx, cy = index.grid.cell(F.col(lon), F.col(lat))
    placed = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumns({"cx": cx, "cy": cy})
    met = placed.join(index.cells, ["cx", "cy"])
    crossed = _crossed(F.col(lon), F.col(lat), index.grid.ref_x(F.col("cx")), index.grid.ref_y(F.col("cy")), F.col("edges"))
    return met.where((F.col("parity") + crossed) % 2 == 1).select(*points.columns, "polygon")


def with_inside(points: DataFrame, index: Index | None, key: str, lon: str = "lon", lat: str = "lat", name: str = "is_in_region") -> DataFrame:
    """`points` with a boolean column: whether any polygon holds the point; without a place it is null. Keys differ and aren't null."""
    held = containing(points.select(key, lon, lat), index, lon, lat).select(key).distinct().withColumn(name, F.lit(True))
    placed = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    return points.join(held, key, "left").withColumn(name, F.when(placed, F.coalesce(name, F.lit(False))))
