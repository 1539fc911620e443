"""How close a rendering is to its original: colour difference, error, structural similarity, as aggregates by image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from . import raster
from .raster import KEY


def pair(original: DataFrame, rendered: DataFrame, background=(1.0, 1.0, 1.0), check: bool = True) -> DataFrame:
    """Both over the background, pixel by pixel. Images of unequal sizes are an error, not a shifted comparison."""
    left = raster.composite_over(original, background).drop("a")
    right = raster.composite_over(rendered, background).select(*KEY, *(F.col(c).alias(f"{c}2") for c in "rgb"))
    if not check:
        return left.join(right, KEY)
    both = left.join(right, KEY, "full")
    odd = F.col("r").isNull() | F.col("r2").isNull()
    return both.withColumn("r", F.when(odd, F.raise_error(F.lit("the images differ in size")).cast("double")).otherwise(F.col("r")))


def delta_e(pairs: DataFrame) -> DataFrame:
    left, right = (colour.lab(*(F.col(c + s) for c in "rgb")) for s in ("", "2"))
    labs = pairs.select(*KEY, *"rgb", "r2", "g2", "b2", left.alias("p"), right.alias("q"))
    return colour.delta_e2000(labs, "p", "q", "de").drop("p", "q")


def metrics(pairs: DataFrame, threshold: float = 2.0) -> DataFrame:
    """image_id, pixels, match_pct, mean_de, max_de, p95_de, rmse, psnr.

    p95 is the value at 0-based rank min(floor(0.95 n), n - 1). Ranks come from counts of equal values, so a partition of
    the window holds an image's distinct differences (equal ones are summed up before), never its pixels.
    """
    from pyspark.sql import Window

    rows = delta_e(pairs)
    square = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "gb"), (F.col("r") - F.col("r2")) * (F.col("r") - F.col("r2")))
    rmse = F.sqrt(F.avg(square) / 3) * 255
    sums = rows.groupBy("image_id").agg(
        F.count("*").alias("pixels"),
        (F.avg((F.col("de") <= threshold).cast("double")) * 100).alias("match_pct"),
        F.avg("de").alias("mean_de"),
        F.max("de").alias("max_de"),
        rmse.alias("rmse"),
    )
    steps = rows.groupBy("image_id", "de").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("image_id").orderBy("de").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("image_id")
    ranked = steps.select("image_id", "de", F.sum("n").over(upto).alias("upto"), F.sum("n").over(every).alias("all"))
    rank = F.least(F.floor(F.col("all") * 0.95), F.col("all") - 1)
    p95 = ranked.where(F.col("upto") > rank).groupBy("image_id").agg(F.min("de").alias("p95_de"))
    psnr = F.when(F.col("rmse") < 1e-9, 99.0).otherwise(F.least(F.log10(255 / F.greatest("rmse", F.lit(1e-300))) * 20, F.lit(99.0)))
    return sums.join(p95, "image_id").withColumn("psnr", psnr)


def ssim(pairs: DataFrame) -> DataFrame:
    """image_id, ssim: the mean over all pixels, luma in 0..255, 11 taps with sigma 1.5, clamped edges."""
    x, y = colour.luma(*map(F.col, "rgb")) * 255, colour.luma(*(F.col(f"{c}2") for c in "rgb")) * 255
    lumas = pairs.select(*KEY, x.alias("x_"), y.alias("y_"))
    products = lumas.select(*KEY, "x_", "y_", (F.col("x_") * F.col("x_")).alias("xx"), (F.col("y_") * F.col("y_")).alias("yy"), (F.col("x_") * F.col("y_")).alias("xy"))
    m = raster.blur(products, ["x_", "y_", "xx", "yy", "xy"])
    mx, my = F.col("x_"), F.col("y_")
    vx, vy, cov = F.col("xx") - mx * mx, F.col("yy") - my * my, F.col("xy") - mx * my
    each = ((mx * my * 2 + 6.5025) * (cov * 2 + 58.5225)) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225))
    return m.groupBy("image_id").agg(colour.clamp(F.avg(each), -1.0, 1.0).alias("ssim"))


def composite(match_pct: Column, points: Column, target: float, reference_points: float) -> Column:
    """0 to 100: full marks for meeting the target with no points."""
    miss, allowed = F.greatest(100 - match_pct, F.lit(0.0)) / 100, max(100 - target, 0.01) / 100
    reference_points = max(reference_points, 1.0)
    return F.exp(-miss / allowed) * reference_points / (points + reference_points) * 100


def meets(match_pct: Column, target: float) -> Column:
    return match_pct >= target
