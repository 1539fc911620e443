"""The planar subdivision as relations: cracks between regions, lattice nodes, junctions, polygon areas.

Crack H(x, y) runs from node (x, y) to (x + 1, y), below pixel row y - 1; V(x, y) from (x, y) to (x, y + 1), right of
pixel column x - 1. Outside the image lies region -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .raster import along_column, along_row
from .segment import OUTSIDE


def cracks(regions: DataFrame) -> DataFrame:
    """image_id, kind, x, y, left, right: the sides when walked from the first node to the second."""
    outside, region = F.lit(OUTSIDE), F.col("region")
    above, before = F.lag("region").over(along_column()), F.lag("region").over(along_row())
    below, after = F.lead("region").over(along_column()), F.lead("region").over(along_row())
    sides = regions.select("image_id", "x", "y", "region", *(c.alias(n) for c, n in zip((above, before, below, after), ("above", "before", "below", "after"))))

    def crack(kind: str, x, y, left, right):
        return F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"), left.alias("left"), right.alias("right"))

    x, y = F.col("x"), F.col("y")
    of_pixel = F.array(
        crack("H", x, y, F.coalesce("above", outside), region),
        crack("V", x, y, region, F.coalesce("before", outside)),
        F.when(F.col("below").isNull(), crack("H", x, y + 1, region, outside)),
        F.when(F.col("after").isNull(), crack("V", x + 1, y, outside, region)),
    )
    real = F.filter(of_pixel, lambda c: c.isNotNull() & (c["left"] != c["right"]))
    return sides.select("image_id", F.explode(real).alias("c")).select("image_id", "c.*")


def nodes(cracks_: DataFrame) -> DataFrame:
    """image_id, x, y, degree of the lattice nodes that cracks touch."""
    other = F.when(F.col("kind") == "H", F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y"))).otherwise(F.struct(F.col("x").alias("x"), (F.col("y") + 1).alias("y")))
    ends = cracks_.select("image_id", F.explode(F.array(F.struct("x", "y"), other)).alias("p"))
    return ends.groupBy("image_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.count("*").alias("degree"))


def junctions(nodes_: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes where arcs end: degree other than 2, or a corner of the image."""
    corner = F.col("x").isin(0) | (F.col("x") == F.col("width"))
    corner &= (F.col("y") == 0) | (F.col("y") == F.col("height"))
    return nodes_.join(sizes.select("image_id", "width", "height"), "image_id").where((F.col("degree") != 2) | corner).drop("width", "height")


def polygon_areas(vertices: DataFrame, by: list[str]) -> DataFrame:
    """by, seq, x, y -> by, area: the shoelace sum of closed polygons, negative for outer rings (y points down)."""
    order = Window.partitionBy(*by).orderBy("seq")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(every))
    crossed = vertices.select(*by, (F.col("x") * after("y") - after("x") * F.col("y")).alias("c"))
    return crossed.groupBy(*by).agg((F.sum("c") / 2).alias("area"))


def region_areas(cracks_: DataFrame) -> DataFrame:
    """image_id, region, area: Green's theorem over the cracks, without walking them; equals the count of pixels."""
    along = cracks_.where("kind = 'V'")
    sides = along.select("image_id", F.col("right").alias("region"), F.col("x").alias("s")).unionAll(along.select("image_id", F.col("left").alias("region"), (-F.col("x")).alias("s")))
    return sides.where(F.col("region") != OUTSIDE).groupBy("image_id", "region").agg(F.sum("s").alias("area"))
