"""Pixel tables in, pixel tables out: compositing, resampling, stencils.

Stencils are window functions over the pixels of one row, then of one column of an image, so a partition is never larger
than a side of an image and no neighbour join multiplies the rows. Only the bilateral filter, which isn't separable,
sends each pixel to its neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour
from ..sources import pixels as px

KEY = ["image_id", "y", "x"]


def along_row():
    """A window over an image's row; made when asked for, as windows need a session."""
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def _all(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def shifted(c: Column, by: int, window) -> Column:
    """The value `by` places further on, the first or last one beyond the ends."""
    if by == 0:
        return c
    if by > 0:
        return F.coalesce(F.lead(c, by).over(window), F.last(c).over(_all(window)))
    return F.coalesce(F.lag(c, -by).over(window), F.first(c).over(_all(window)))


def has_alpha(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.bool_or(F.col("a") < 0.999).alias("has_alpha"))


def composite_over(pixels: DataFrame, background=(1.0, 1.0, 1.0)) -> DataFrame:
    return pixels.select(*KEY, *(colour.over(F.col(c), F.col("a"), v).alias(c) for c, v in zip("rgb", background)), F.lit(1.0).alias("a"))


def to_rgba8(pixels: DataFrame) -> DataFrame:
    return pixels.select(*KEY, *(colour.to_byte(F.col(c)).alias(c) for c in "rgba"))


def sample(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """points (image_id, px, py) with the bilinear colour there; pixel centres lie at halves, edges are clamped."""
    sizes = px.size(pixels).select("image_id", "width", "height")
    fx, fy = F.col("px") - 0.5, F.col("py") - 0.5
    near = points.join(sizes, "image_id").withColumns({"x0": F.floor(fx), "y0": F.floor(fy)}).withColumns({"tx": fx - F.col("x0"), "ty": fy - F.col("y0")})
    corners = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (0, 1) for dx in (0, 1)))
    spread = near.select("*", F.explode(corners).alias("c"))
    at = lambda c, d, n: F.greatest(F.least(F.col(c) + F.col(f"c.{d}"), F.col(n) - 1), F.lit(0)).cast("int")
    part = lambda t, d: F.when(F.col(f"c.{d}") == 1, F.col(t)).otherwise(1 - F.col(t))
    keyed = spread.select("image_id", "px", "py", at("x0", "dx", "width").alias("x"), at("y0", "dy", "height").alias("y"), (part("tx", "dx") * part("ty", "dy")).alias("w"))
    return keyed.join(pixels, KEY).groupBy("image_id", "px", "py").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in "rgba"))


def downsample(pixels: DataFrame, factor: int) -> DataFrame:
    """Box means of factor x factor pixels; what doesn't fill a box is left out."""
    sizes = px.size(pixels).select("image_id", "width", "height")
    whole = lambda c, n: F.col(c) < F.floor(F.col(n) / factor) * factor
    inside = pixels.join(sizes, "image_id").where(whole("x", "width") & whole("y", "height"))
    by = ["image_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")]
    return inside.groupBy(*by).agg(*(F.avg(c).alias(c) for c in "rgba"))


def resized(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Plain means over the source pixels floor(x * s) to max(ceil((x + 1) * s), that + 1) of each side; windows may overlap."""
    return _resized(pixels, px.size(pixels).select("image_id", "width", "height", F.lit(width).alias("w"), F.lit(height).alias("h")))


def fit_within(pixels: DataFrame, most: int) -> DataFrame:
    """Shrunk so that neither side is over `most`; 0 or small enough: unchanged."""
    sizes = px.size(pixels).select("image_id", "width", "height")
    big = F.greatest("width", "height")
    scale = F.when((F.lit(most) == 0) | (big <= most), 1.0).otherwise(most / big)
    to = lambda n: F.greatest(F.floor(F.col(n) * scale + 0.5), F.lit(1)).cast("int")
    return _resized(pixels, sizes.select("image_id", "width", "height", to("width").alias("w"), to("height").alias("h")))


def _resized(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    def side(n: str, m: str, out: str, source: str) -> DataFrame:
        each = sizes.select("image_id", n, m, F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(out))
        s = F.col(n) / F.col(m)
        first = F.floor(F.col(out) * s).cast("int")
        end = F.least(F.greatest(F.ceil((F.col(out) + 1) * s).cast("int"), first + 1), F.col(n).cast("int"))
        return each.select("image_id", out, F.explode(F.sequence(first, end - 1)).alias(source))

    across = pixels.join(side("width", "w", "x_", "x"), ["image_id", "x"])
    both = across.join(side("height", "h", "y_", "y"), ["image_id", "y"])
    return both.groupBy("image_id", F.col("y_").alias("y"), F.col("x_").alias("x")).agg(*(F.avg(c).alias(c) for c in "rgba"))


def difference(left: DataFrame, right: DataFrame, gain: float) -> DataFrame:
    """Absolute differences times gain, capped, with alpha 1 where both have a pixel; zero elsewhere in left."""
    other = right.select(*KEY, *(F.col(c).alias(f"{c}_") for c in "rgb"))
    both = left.join(other, KEY, "left")
    there = F.col("r_").isNotNull()
    apart = [F.when(there, F.least(F.abs(F.col(c) - F.col(f"{c}_")) * gain, F.lit(1.0))).otherwise(0.0).alias(c) for c in "rgb"]
    return both.select(*KEY, *apart, F.when(there, 1.0).otherwise(0.0).alias("a"))


def flatness(pixels: DataFrame) -> DataFrame:
    """image_id, y, x, w: near 1 in flat areas, near 0 on edges (Sobel, the strongest channel); 1 for images under 3 x 3."""
    across = pixels.select(
        *KEY,
        *((shifted(F.col(c), 1, along_row()) - shifted(F.col(c), -1, along_row())).alias(f"d{c}") for c in "rgb"),
        *((shifted(F.col(c), -1, along_row()) + F.col(c) * 2 + shifted(F.col(c), 1, along_row())).alias(f"s{c}") for c in "rgb"),
        F.count("*").over(_all(along_row())).alias("width"),
    )
    gx = lambda c: shifted(F.col(f"d{c}"), -1, along_column()) + F.col(f"d{c}") * 2 + shifted(F.col(f"d{c}"), 1, along_column())
    gy = lambda c: shifted(F.col(f"s{c}"), 1, along_column()) - shifted(F.col(f"s{c}"), -1, along_column())
    edges = across.select(*KEY, "width", F.count("*").over(_all(along_column())).alias("height"), *(F.sqrt(gx(c) * gx(c) + gy(c) * gy(c)).alias(f"g{c}") for c in "rgb"))
    g = F.greatest("gr", "gg", "gb") * 0.25 / 0.12
    return edges.select(*KEY, F.when((F.col("width") < 3) | (F.col("height") < 3), 1.0).otherwise(F.exp(-(g * g))).alias("w"))


def gaussian_kernel(sigma: float, radius: int) -> list[float]:
    weights = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [w / sum(weights) for w in weights]


def blur(table: DataFrame, columns: list[str], sigma: float = 1.5, radius: int = 5) -> DataFrame:
    """Separable Gaussian over the named columns, edges clamped."""
    kernel = gaussian_kernel(sigma, radius)
    for window in (along_row(), along_column()):
        sums = [sum((shifted(F.col(c), i - radius, window) * k for i, k in enumerate(kernel)), F.lit(0.0)).alias(c) for c in columns]
        table = table.select(*KEY, *sums)
    return table


def bilateral(pixels: DataFrame, radius: int = 3, range_sigma: float = 4.0) -> DataFrame:
    """Edge-keeping smoothing: weights by distance and by exact Lab difference, means of gamma values, alpha as it is."""
    if radius == 0 or range_sigma <= 0:
        return pixels
    space = max(radius / 2, 0.5)
    marked = pixels.select(*KEY, *"rgba", colour.lab(*px.rgb()).alias("lab"))
    reach = range(-radius, radius + 1)
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(math.exp(-(dx * dx + dy * dy) / (2 * space * space))).alias("w")) for dy in reach for dx in reach))
    sent = marked.select("image_id", *(F.col(c).alias(f"{c}_") for c in "rgb"), F.col("lab").alias("lab_"), "y", "x", F.explode(steps).alias("s"))
    sent = sent.select("image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "r_", "g_", "b_", "lab_", F.col("s.w").alias("w"))
    both = marked.join(sent, KEY)
    weight = F.col("w") * F.exp(-colour.dist_sq(F.col("lab"), F.col("lab_")) / (2 * range_sigma * range_sigma))
    sums = both.withColumn("w", weight).groupBy(*KEY).agg(*((F.sum(F.col(f"{c}_") * F.col("w")) / F.sum("w")).alias(c) for c in "rgb"), F.first("a").alias("a"))
    return sums


def block_artifacts(pixels: DataFrame, strength: float, block: int = 8) -> DataFrame:
    """Each pixel pushed away from its block's mean, less where it differs most, as lossy codecs ring at edges."""
    here = Window.partitionBy("image_id", F.floor(F.col("y") / block), F.floor(F.col("x") / block))

    def pushed(c: str) -> Column:
        mean = F.avg(c).over(here)
        d = F.col(c) - mean
        return colour.clamp(mean + d * (1 + strength) - F.signum(d) * F.least(F.abs(d), F.lit(0.5)) * (strength * 0.12))

    return pixels.select(*KEY, *(pushed(c).alias(c) for c in "rgb"), "a")
