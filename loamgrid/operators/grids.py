"""Cells on the sphere and in time, and what is gathered in them.

A regular cell is two column expressions, so placing documents needs no
shuffle.  A K-d tree is a table that is grown level by level.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import boxes_overlap, clip_latitude, wrap_longitude
from ..sources.scratch import written

#: Added before flooring, so that coordinates on an edge fall into the upper cell.
NUDGE = 1e-8


@dataclass(frozen=True)
class RegularGrid:
    """Square cells of `degrees`; a cell spans `width` x `width` tiles and is named by its south-west tile."""

    degrees: float = 1.0
    width: int = 1
    offset: tuple[float, float] = (0.0, 0.0)

    def _range(self, axis: int) -> tuple[int, int]:
        """Least and greatest tile index of an axis."""
        low, high = ((-90.0, 90.0), (-180.0, 180.0))[axis]
        per, off = 1.0 / self.degrees, self.offset[axis] % self.degrees
        return math.floor((low - off) * per + NUDGE), math.ceil((high - off) * per - NUDGE) - 1

    def _kept(self, row: Column, col: Column) -> tuple[Column, Column]:
        """Rows are held at the poles, columns go round."""
        (r0, r1), (c0, c1) = self._range(0), self._range(1)
        inside = F.greatest(F.lit(r0), F.least(F.lit(r1), row))
        return inside.cast("int"), (F.pmod(col - c0, F.lit(c1 - c0 + 1)) + c0).cast("int")

    def tile(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        per = F.lit(1.0 / self.degrees)  # a reciprocal: 175 * (1 / 0.14) is whole, 175 / 0.14 isn't
        found = (F.floor((x - off % self.degrees) * per + NUDGE) for x, off in zip((lat, lon), self.offset, strict=True))
        return self._kept(*found)

    def cell(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Index of the cell that holds a coordinate most centrally."""
        back = (self.width - 1) / 2 * self.degrees
        return self.tile(lat - back, lon - back)

    def cells(self, lat: Column, lon: Column) -> Column:
        """All cells that hold a coordinate: an array of (row, col), width x width of them."""
        row, col = self.tile(lat, lon)
        steps = [(i, j) for i in range(self.width) for j in range(self.width)]
        pairs = [self._kept(row - i, col - j) for i, j in steps]
        return F.array_distinct(F.array(*[F.struct(r.alias("row"), c.alias("col")) for r, c in pairs]))

    def corner(self, row: Column, col: Column, along: float = 0.0) -> tuple[Column, Column]:
        """(lat, lon) of a point `along` tiles north-east of a cell's south-west corner, held in bounds."""
        lat = (row + along) * self.degrees + self.offset[0] % self.degrees
        lon = (col + along) * self.degrees + self.offset[1] % self.degrees
        return clip_latitude(lat), F.when(lon == 180, 180.0).otherwise(wrap_longitude(lon))

    def center(self, row: Column, col: Column) -> tuple[Column, Column]:
        return self.corner(row, col, self.width / 2)

    def finer(self, factor: int = 2) -> RegularGrid:
        """The grid that cuts each tile into factor x factor tiles."""
        return RegularGrid(self.degrees / factor, self.width, self.offset)

    def parent(self, row: Column, col: Column, factor: int = 2) -> tuple[Column, Column]:
        """Index in this grid of a tile of `self.finer(factor)`."""
        return F.floor(row / factor).cast("int"), F.floor(col / factor).cast("int")

    def overlaps(self, row: Column, col: Column, boxes: list[tuple[float, float, float, float]]) -> Column:
        """Whether a cell shares area with one of the boxes (south, west, north, east)."""
        span = self.degrees * self.width
        lat, lon = self.corner(row, col)
        return reduce(lambda a, b: a | b, [boxes_overlap((lat, lon, lat + span, lon + span), b, False) for b in boxes], F.lit(False))


def index_within(row: Column, col: Column, south_west: tuple[int, int], north_east: tuple[int, int]) -> Column:
    """Inclusive box of indices; one whose west is greater than its east crosses the antimeridian."""
    (s, w), (n, e) = south_west, north_east
    return row.between(s, n) & (col.between(w, e) if w <= e else (col >= w) | (col <= e))


def with_cells(docs: DataFrame, grid: RegularGrid) -> DataFrame:
    """`docs` with (row, col); rows without a coordinate go, and under a wide grid each row comes once for each cell."""
    placed = docs.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if grid.width == 1:
        row, col = grid.cell(F.col("lat"), F.col("lon"))
        return placed.withColumns({"row": row, "col": col})
    out = placed.withColumn("_c", F.explode(grid.cells(F.col("lat"), F.col("lon"))))
    return out.withColumns({"row": F.col("_c.row"), "col": F.col("_c.col")}).drop("_c")


def accumulate(docs: DataFrame, keys: list[str], id_col: str, salience: str | None = None) -> DataFrame:
    """One row per cell: documents, centroid, salience and the most salient document (least id of equals)."""
    measures = [F.count(F.lit(1)).alias("n_docs"), F.avg("lat").alias("clat"), F.avg("lon").alias("clon")]
    if salience:
        measures += [
            F.sum(salience).alias("salience"),
            F.max(F.struct(F.col(salience).alias("s"), (-F.col(id_col)).alias("i"))).alias("_top"),
        ]
    out = docs.groupBy(*keys).agg(*measures)
    if not salience:
        return out
    return out.withColumns({"top_id": -F.col("_top.i"), "top_salience": F.col("_top.s")}).drop("_top")


def add_points(cells: DataFrame, points: DataFrame, grid: RegularGrid) -> DataFrame:
    """Add the salience of named points (lat, lon, salience) to the cells that exist."""
    row, col = grid.cell(F.col("lat"), F.col("lon"))
    extra = points.groupBy(row.alias("row"), col.alias("col")).agg(F.sum("salience").alias("_more"))
    joined = cells.join(extra, ["row", "col"], "left")
    return joined.withColumn("salience", F.col("salience") + F.coalesce("_more", F.lit(0))).drop("_more")


def override_centroids(cells: DataFrame, places: DataFrame, grid: RegularGrid) -> DataFrame:
    """Cells that hold a point of `places` (lat, lon) take it as their central point; of several the least."""
    row, col = grid.cell(F.col("lat"), F.col("lon"))
    chosen = places.groupBy(row.alias("row"), col.alias("col")).agg(F.min(F.struct("lat", "lon")).alias("_p"))
    joined = cells.join(chosen, ["row", "col"], "left")
    return joined.withColumns({"clat": F.coalesce("_p.lat", "clat"), "clon": F.coalesce("_p.lon", "clon")}).drop("_p")


def canonical_numbers(cells: DataFrame, keys: list[str], name: str = "cell_no") -> DataFrame:
    """Number cells from 0 in the order of their keys.  There are far fewer cells than documents: one task sorts them."""
    return cells.withColumn(name, F.row_number().over(Window.orderBy(*keys)) - 1)


def balanced(docs: DataFrame, keys: list[str], most: int, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """At most `most` documents of each group, chosen by a seeded hash; a sampling operator.

    The least hashes are found with a partial top-k (Spark filters on the rank
    inside each map task first), so a hot group is cut before it is shuffled.
    """
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), id_col), id_col)
    return docs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def combine(grids: dict[str, DataFrame]) -> DataFrame:
    """Cells of several grids in one relation, told apart by `grid`."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [g.withColumn("grid", F.lit(n)) for n, g in grids.items()])


def time_cells(at: Column, before: tuple[int, int], after: tuple[int, int]) -> Column:
    """`before` or `after` of a timestamp in milliseconds, by two half-open intervals; else null."""
    return F.when((at >= before[0]) & (at < before[1]), "before").when((at >= after[0]) & (at < after[1]), "after")


def slice_index(value: Column, size: float) -> Column:
    """Index that is cut off towards zero, as dated corpora number their cells and slices."""
    return (value / size).cast("int")


# --- K-d tree -----------------------------------------------------------------------


@dataclass(frozen=True)
class KdNode:
    path: str
    axis: str | None
    split: float | None
    size: int


def kd_assign(points: DataFrame, bucket: int = 200, method: str = "halfway", max_depth: int = 40) -> tuple[DataFrame, DataFrame]:
    """(points with `leaf`, nodes) of a K-d tree over (lat, lon); nodes: (path, axis, split, size), leaves have no axis.

    A node of more than `bucket` points is split on its wider axis (latitude if
    equal): halfway, at the median, or in the middle of the widest gap.  Paths
    are L (at or below the split) and R.  A node whose points are all equal
    stays a leaf.  The tree is a table: at each level the points of open nodes
    take their node's split by a join on the path, so neither a plan nor the
    driver grows with the nodes; two numbers of a level come to the driver.
    Each level is written to the shared folder and read again.
    """
    if method not in ("halfway", "median", "maxmargin"):
        raise ValueError(f"unknown split method: {method}")
    at, levels, leaves = written(points.withColumn("path", F.lit("")), "kd-points"), [], []
    for _ in range(max_depth):
        level = written(_kd_level(at, bucket, method), "kd-level")
        n_split, n_leaves = level.agg(F.count("axis"), F.count_if(F.col("axis").isNull())).first()
        levels.append(level.select("path", "axis", "split", "size"))
        joined = at.join(level.select("path", "axis", "split"), "path")
        if n_leaves:
            leaves.append(joined.filter("axis is null").select(*points.columns, F.col("path").alias("leaf")))
        if not n_split:
            break
        below = F.when(F.col("axis") == "lon", F.col("lon")).otherwise(F.col("lat")) <= F.col("split")
        path = F.concat("path", F.when(below, "L").otherwise("R"))
        at = written(joined.filter("axis is not null").select(*points.columns, path.alias("path")), "kd-points")
    else:
        leaves.append(at.select(*points.columns, F.col("path").alias("leaf")))
    if not leaves:
        leaves.append(at.select(*points.columns, F.col("path").alias("leaf")))
    return reduce(DataFrame.union, leaves), reduce(DataFrame.union, levels)


def _kd_level(at: DataFrame, bucket: int, method: str) -> DataFrame:
    """(path, axis, split, size) of the nodes that hold the points (lat, lon, path)."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    stats = at.groupBy("path").agg(F.count(F.lit(1)).alias("size"), *ends)
    wide = (F.col("hi_lon") - F.col("lo_lon")) > (F.col("hi_lat") - F.col("lo_lat"))
    lo, hi, n = (F.when(wide, F.col(f"{x}_lon")).otherwise(F.col(f"{x}_lat")) for x in ("lo", "hi", "n"))
    stats = stats.select("path", "size", F.when(wide, "lon").otherwise("lat").alias("axis"), lo.alias("lo"), hi.alias("hi"), n.alias("n"))
    is_open = (F.col("size") > bucket) & (F.col("lo") < F.col("hi"))
    if method == "halfway":
        found = stats.withColumn("s", (F.col("lo") + F.col("hi")) * 0.5)
    else:
        value = F.when(F.col("axis") == "lon", F.col("lon")).otherwise(F.col("lat"))
        values = at.join(stats.filter(is_open).select("path", "axis", "n"), "path").select("path", "n", value.alias("v")).filter("v is not null")
        values = values.groupBy("path", "n", "v").agg(F.count(F.lit(1)).alias("c"))
        order = Window.partitionBy("path").orderBy("v")
        if method == "median":
            upto = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            values = values.withColumn("_upto", upto)
            middle = [F.max(F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("c") <= r), F.col("v"))) for r in (F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))]
            splits = values.groupBy("path").agg((0.5 * middle[0] + 0.5 * middle[1]).alias("s"))
        else:
            values = values.withColumn("g", F.lead("v").over(order) - F.col("v"))
            splits = values.groupBy("path").agg(F.max(F.struct(F.col("g"), (-F.col("v")).alias("at"))).alias("b"))
            splits = splits.select("path", (-F.col("b.at") + 0.5 * F.col("b.g")).alias("s"))
        found = stats.join(splits, "path", "left")
    is_open = F.coalesce(is_open, F.lit(False))
    split = F.when(F.col("s") < F.col("hi"), F.col("s")).otherwise(F.col("lo"))
    return found.select("path", F.when(is_open, F.col("axis")).alias("axis"), F.when(is_open, split).alias("split"), "size")


def grow_kd(points: DataFrame, bucket: int = 200, method: str = "halfway", max_depth: int = 40) -> list[KdNode]:
    """Nodes of a K-d tree as `kd_assign` grows it, parents first, in a list on the driver: for trees of few nodes."""
    _, nodes = kd_assign(points.select("lat", "lon"), bucket, method, max_depth)
    found = [KdNode(*r) for r in nodes.collect()]
    return sorted(found, key=lambda n: (len(n.path), n.path))


def kd_path(nodes: list[KdNode]) -> Column:
    """Leaf path of (lat, lon): nested conditions, so descending needs no join.

    The plan grows with the nodes, so this is for trees of few hundred; `kd_assign` gives the leaves of any.
    """
    by_path = {n.path: n for n in nodes}

    def descend(path: str) -> Column:
        node = by_path.get(path)
        if node is None or node.axis is None:
            return F.lit(path)
        return F.when(F.col(node.axis) <= node.split, descend(path + "L")).otherwise(descend(path + "R"))

    return descend("")


def kd_ancestors(path: Column) -> Column:
    """All prefixes of a path, the root "" first: a document counts in its leaf and in every node above."""
    return F.transform(F.sequence(F.lit(0), F.length(path)), lambda i: F.substring(path, F.lit(1), i))


def kd_cutoff(nodes: list[KdNode], cutoff: int) -> list[KdNode]:
    """The nodes that stand if only those of more than `cutoff` points are split."""
    split = {n.path for n in nodes if n.axis and n.size > cutoff}
    return [n if n.path in split else KdNode(n.path, None, None, n.size) for n in nodes if all(n.path[:i] in split for i in range(len(n.path)))]


def kd_coarse(nodes: DataFrame, leaves: DataFrame, cutoff: int) -> DataFrame:
    """(leaf, coarse) of (leaf): the leaf it lies in if only nodes of more than `cutoff` points are split."""
    split = nodes.filter(F.col("axis").isNotNull() & (F.col("size") > cutoff)).select("path", F.lit(True).alias("_split"))
    above = leaves.select("leaf").distinct().select("leaf", F.explode(kd_ancestors(F.col("leaf"))).alias("path"))
    ends = above.join(split, "path", "left").filter("_split is null").groupBy("leaf").agg(F.min(F.length("path")).alias("_n"))
    return ends.select("leaf", F.substring("leaf", F.lit(1), F.col("_n")).alias("coarse"))


def kd_interpolate(grams: DataFrame, weight: float, depth: int) -> DataFrame:
    """Node models mixed with their parents', top-down: (1 - w) own + w parent, kept above w.

    `grams` has (path, gram, cnt) for all nodes.  One join per level.
    """
    own, done = grams, grams.filter(F.length("path") == 0)
    above = done
    for level in range(1, depth + 1):
        here = own.filter(F.length("path") == level)
        nodes = here.select("path").distinct().withColumn("up", F.expr("substring(path, 1, length(path) - 1)"))
        down = above.select(F.col("path").alias("up"), "gram", (F.col("cnt") * weight).alias("cnt")).join(nodes, "up").select("path", "gram", "cnt")
        mixed = here.select("path", "gram", (F.col("cnt") * (1 - weight)).alias("cnt")).unionByName(down)
        above = mixed.groupBy("path", "gram").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") > weight)
        done = done.unionByName(above)
    return done
