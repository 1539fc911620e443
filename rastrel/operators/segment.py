"""Regions of equal labels: components, areas, colours, contacts and what despeckling would merge.

components() makes a row of each image's labels and unites pixels in NumPy, many images at a time: right for images that fit a
worker. components_relational() is for a single image larger than that: minimum propagation over neighbour edges with the
star-contraction rounds of a distributed connected-components algorithm, each round cut by a checkpoint.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import regions as kernel
from .raster import KEY, along_column, along_row

OUTSIDE = -1


def _by_image(labels: DataFrame, kernel_: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], name: str) -> DataFrame:
    """Adds a column computed from whole label grids: kernel_(labels of some images one after the other, their sizes, their widths).

    An image becomes one row with its labels in raster order, so that many small images share a Python call.
    """
    cells = F.sort_array(F.collect_list(F.struct("y", "x", "label")))
    grids = labels.groupBy("image_id").agg(cells.alias("cells"))
    grids = grids.select("image_id", (F.element_at("cells", -1)["x"] + 1).cast("int").alias("width"), F.col("cells.label").cast("array<int>").alias("label"))

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for part in _portions(batch):
                lists = part.column("label")
                values, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                out = kernel_(values, sizes, part.column("width").to_numpy()).astype(np.int32)
                at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, pa.array(out))], [*part.schema.names, name])

    found = grids.mapInArrow(run, f"image_id long, width int, label array<int>, {name} array<int>")
    cells = found.select("image_id", "width", F.posexplode(F.arrays_zip("label", name)).alias("i", "c"))
    return cells.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "c.*")


def _portions(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Runs of images with about `most` pixels; a larger image comes alone."""
    ends, at = np.cumsum(pc.list_value_length(batch.column("label")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def components(labels: DataFrame) -> DataFrame:
    """image_id, y, x, label, region: 4-connected, numbered by their first pixel in raster order."""
    return _by_image(labels, kernel.components_of_many, "region")


def neighbours(table: DataFrame, column: str) -> DataFrame:
    """image_id and the pairs (p, q) of values of a column in pixels next to each other, each pair of pixels once."""
    right = table.select("image_id", F.col(column).alias("p"), F.lead(column).over(along_row()).alias("q"))
    below = table.select("image_id", F.col(column).alias("p"), F.lead(column).over(along_column()).alias("q"))
    return right.unionAll(below).where("q is not null")


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the folder that spark.checkpoint.dir names; where it names none and all is one machine, to a temporary one."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="rastrel-"))
    return df.checkpoint()


def components_relational(labels: DataFrame) -> DataFrame:
    """The same as components(), for images of any size."""
    wide = F.col("y").cast("long") * (1 << 31) + F.col("x")
    cells = labels.select(*KEY, "label", wide.alias("cell"))
    both = F.struct("label", "cell")
    pairs = neighbours(cells.withColumn("both", both), "both").where("p.label = q.label").select("image_id", F.col("p.cell").alias("u"), F.col("q.cell").alias("v"))
    edges = checkpointed(pairs.select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    count = -1
    while True:
        both_ways = edges.unionAll(edges.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both_ways.groupBy("image_id", "u").agg(F.min("v").alias("m")).select("image_id", "u", F.least("u", "m").alias("m"))
        large = both_ways.join(least, ["image_id", "u"]).where("v > u").select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("image_id", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["image_id", "u"]).where("v != m").select("image_id", F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionAll(least.select("image_id", "u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(38,0)"))).first()
        if state == count:
            break
        count = state
    roots = cells.join(edges.select("image_id", F.col("u").alias("cell"), F.col("v").alias("root")), ["image_id", "cell"], "left")
    rooted = roots.select(*KEY, "label", F.coalesce("root", "cell").alias("root"))
    # distinct roots are ranked, not pixels: a region's number is the place of its first pixel among all first pixels
    firsts = rooted.select("image_id", "root").distinct().withColumn("region", (F.row_number().over(Window.partitionBy("image_id").orderBy("root")) - 1).cast("int"))
    return rooted.join(firsts, ["image_id", "root"]).select(*KEY, "label", "region")


def region_table(regions: DataFrame) -> DataFrame:
    """image_id, region, label, area."""
    return regions.groupBy("image_id", "region").agg(F.first("label").alias("label"), F.count("*").alias("area"))


def region_colors(pixels: DataFrame, regions: DataFrame, weights: DataFrame, least: float = 0.02) -> DataFrame:
    """image_id, region and the mean r, g, b, a weighted by flatness, each weight `least` at least."""
    w = F.greatest("w", F.lit(least))
    both = regions.select(*KEY, "region").join(pixels, KEY).join(weights, KEY)
    return both.groupBy("image_id", "region").agg(*((F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in "rgba"))


def contacts(regions: DataFrame) -> DataFrame:
    """image_id, region, other, border: unit edges between each region and each neighbour, in both directions."""
    pairs = neighbours(regions, "region").where("p != q")
    both = pairs.unionAll(pairs.select("image_id", F.col("q").alias("p"), F.col("p").alias("q")))
    return both.groupBy("image_id", F.col("p").alias("region"), F.col("q").alias("other")).agg(F.count("*").alias("border"))


def despeckle_targets(regions: DataFrame, min_area: int) -> DataFrame:
    """image_id, region, target: for each region under min_area, the neighbour with the longest border, then the largest area, then the first."""
    areas = region_table(regions).select("image_id", "region", "area")
    small = contacts(regions).join(areas.where(F.col("area") < min_area).drop("area"), ["image_id", "region"])
    other = areas.select("image_id", F.col("region").alias("other"), F.col("area").alias("other_area"))
    best = F.min_by("other", F.struct((-F.col("border")).alias("b"), (-F.col("other_area")).alias("a"), F.col("other").alias("o")))
    return small.join(other, ["image_id", "other"]).groupBy("image_id", "region").agg(best.alias("target"))


def despeckle(labels: DataFrame, min_area: int, rounds: int = 3) -> DataFrame:
    """Labels with the regions under min_area absorbed, smallest first, for up to `rounds` rounds or until nothing changes."""

    def absorb(values: np.ndarray, sizes: np.ndarray, widths: np.ndarray) -> np.ndarray:
        cuts = np.split(values, np.cumsum(sizes)[:-1])
        return np.concatenate([kernel.despeckle(v.reshape(-1, w), min_area, rounds).ravel() for v, w in zip(cuts, widths.tolist())])

    return _by_image(labels, absorb, "merged").select(*KEY, F.col("merged").alias("label"))
