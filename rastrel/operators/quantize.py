"""Palettes: Otsu's threshold, binary palettes, nearest entries, keyed colours, one Lloyd step.

A palette is an array of struct<entry, r, g, b, l, a, b_, transparent, slot> in each image's row, at most a few hundred
entries; the arg-min over it runs inside the row, without a join by distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour
from ..sources import pixels as px


def otsu(pixels: DataFrame) -> DataFrame:
    """image_id, threshold in 0..1: the first bin with the greatest variance between classes; 128/255 if none, 0.5 without opaque pixels."""
    bins = pixels.where("a >= 0.5").select("image_id", colour.to_byte(colour.luma(*px.rgb())).alias("bin")).groupBy("image_id", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("image_id")
    run = bins.select(
        "image_id",
        "bin",
        F.sum("n").over(upto).alias("wb"),
        F.sum(F.col("n") * F.col("bin")).over(upto).alias("sb"),
        F.sum("n").over(every).alias("w"),
        F.sum(F.col("n") * F.col("bin")).over(every).alias("s"),
    )
    wb, wf = F.col("wb").cast("double"), (F.col("w") - F.col("wb")).cast("double")
    apart = F.col("sb") / wb - (F.col("s") - F.col("sb")) / F.greatest(wf, F.lit(1.0))
    best = run.where("w > wb").groupBy("image_id").agg(F.max_by("bin", F.struct((wb * wf * apart * apart).alias("v"), (-F.col("bin")).alias("b"))).alias("bin"))
    images = pixels.groupBy("image_id").agg(F.bool_or(F.col("a") >= 0.5).alias("opaque"))
    return images.join(best, "image_id", "left").select("image_id", F.when(F.col("opaque"), F.coalesce("bin", F.lit(128)) / 255.0).otherwise(0.5).alias("threshold"))


def binary_palette(pixels: DataFrame, alpha: float = 0.5, invert: bool = False) -> DataFrame:
    """image_id, threshold, dark and light (struct r, g, b): means of the pixels up to and above Otsu's threshold."""
    known = pixels.join(otsu(pixels), "image_id").where(F.col("a") > alpha)
    low = colour.luma(*px.rgb()) <= F.col("threshold")
    mean = lambda on, other: F.struct(*(F.coalesce(F.avg(F.when(on, F.col(c))), F.lit(other)).alias(c) for c in "rgb"))
    first, second = ("light", "dark") if invert else ("dark", "light")
    return known.groupBy("image_id", "threshold").agg(mean(low, 0.0).alias(first), mean(~low, 1.0).alias(second))


def entries(colours: list[Column]) -> Column:
    """A palette array of struct colours (r, g, b), numbered from 0, with their Lab values."""
    return F.array(*(F.struct(F.lit(i).alias("entry"), c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), colour.lab(c["r"], c["g"], c["b"]).alias("lab")) for i, c in enumerate(colours)))


def nearest(lab: Column, palette: Column) -> Column:
    """The entry with the least squared Lab distance; of equal ones the first."""
    return F.array_min(F.transform(palette, lambda p: F.struct(colour.dist_sq(lab, p["lab"]).alias("d"), p["entry"].alias("entry"))))["entry"]


def assign(pixels: DataFrame, palettes: DataFrame, alpha: float = 0.5) -> DataFrame:
    """image_id, y, x, label: the nearest entry by 5-bit Lab; the alpha slot, numbered after the entries, where a <= alpha."""
    # Lab is a column of its own: inside the search it would be computed again for each entry
    labs = pixels.select("image_id", "y", "x", "a", colour.lab5(*px.rgb()).alias("lab"))
    both = labs.join(palettes.select("image_id", "palette"), "image_id")
    label = F.when(F.col("a") <= alpha, F.size("palette")).otherwise(nearest(F.col("lab"), F.col("palette")))
    return both.select("image_id", "y", "x", label.cast("int").alias("label"))


def hex_labs(keys: list[str]) -> list[tuple[float, float, float]]:
    """Keyed colours as gamma r, g, b."""
    return [tuple(int(k.lstrip("#")[i : i + 2], 16) / 255 for i in (0, 2, 4)) for k in keys]


def is_keyed(lab: Column, keys: list[str], tolerance: float = 8.0, coarse: bool = False) -> Column:
    """Whether a Lab colour lies within the tolerance of any keyed colour."""
    make = colour.lab5 if coarse else colour.lab
    near = [colour.dist_sq(lab, make(*map(F.lit, k))) <= tolerance * tolerance for k in hex_labs(keys)]
    return F.lit(False) if not near else sum((n.cast("int") for n in near), F.lit(0)) > 0


def mark_transparent(palettes: DataFrame, keys: list[str], tolerance: float = 8.0) -> DataFrame:
    """The palette's entries with a flag; a key without any entry in its tolerance becomes a flagged entry of its own."""
    flagged = palettes.select("image_id", F.transform("palette", lambda p: F.struct(p["entry"].alias("entry"), p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b"), p["lab"].alias("lab"), is_keyed(p["lab"], keys, tolerance).alias("transparent"))).alias("palette"))
    for k in hex_labs(keys):
        r, g, b = map(F.lit, k)
        own = colour.lab(r, g, b)
        missing = ~F.exists("palette", lambda p: colour.dist_sq(p["lab"], own) <= tolerance * tolerance)
        added = F.array(F.struct(F.size("palette").alias("entry"), r.alias("r"), g.alias("g"), b.alias("b"), own.alias("lab"), F.lit(True).alias("transparent")))
        flagged = flagged.select("image_id", F.when(missing, F.concat("palette", added)).otherwise(F.col("palette")).alias("palette"))
    return flagged


def scoring_reference(pixels: DataFrame, keys: list[str], tolerance: float = 8.0) -> DataFrame:
    """Pixels within tolerance of a key (5-bit Lab on both sides) get alpha 0."""
    if not keys:
        return pixels
    keyed = is_keyed(colour.lab5(*px.rgb()), keys, tolerance, coarse=True)
    return pixels.withColumn("a", F.when(keyed, 0.0).otherwise(F.col("a")))


def lloyd_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """One weighted k-means step. points: image_id, lab, w. centres: image_id, palette. -> image_id, entry, n, l, a, b."""
    near = points.join(centres, "image_id").select("image_id", "lab", "w", nearest(F.col("lab"), F.col("palette")).alias("entry"))
    mean = lambda k: (F.sum(F.col(f"lab.{k}") * F.col("w")) / F.sum("w")).alias(k)
    return near.groupBy("image_id", "entry").agg(F.count("*").alias("n"), mean("l"), mean("a"), mean("b"))
