"""What kind of image it is: distinct colours, edges, blends and flat areas, and the flags drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from ..sources import pixels as px
from .raster import KEY, along_column, along_row


def profile(pixels: DataFrame) -> DataFrame:
    """image_id, width, height, has_alpha, unique_colors, edge_density, antialiasing, flatness, photographic, pixel_art, bilevel.

    Colours are cut to 5 bits and counted on every (n div 200000)-th pixel; the others on interior pixels of every
    (height div 400)-th row.
    """
    sizes = px.size(pixels)
    five = [F.floor(F.col(c) * 31).cast("int") for c in "rgb"]
    index = F.col("y").cast("long") * F.col("width") + F.col("x")
    known = pixels.join(sizes, "image_id")
    colours = known.where(index % F.greatest(F.floor(F.col("n") / 200_000), F.lit(1)) == 0).groupBy("image_id").agg(F.count_distinct(five[0] * 1024 + five[1] * 32 + five[2]).alias("unique_colors"))
    alphas = pixels.groupBy("image_id").agg(F.bool_or(F.col("a") < 0.999).alias("has_alpha"))
    rgb = F.struct(*"rgb")
    near = pixels.select(*KEY, rgb.alias("c"), F.lag(rgb).over(along_row()).alias("l"), F.lead(rgb).over(along_row()).alias("r"), F.lag(rgb).over(along_column()).alias("u"), F.lead(rgb).over(along_column()).alias("d"))
    luma = lambda s: colour.luma(*(F.col(f"{s}.{c}") for c in "rgb"))
    inside = near.where("l is not null and r is not null and u is not null and d is not null").join(sizes, "image_id")
    inside = inside.where((F.col("y") - 1) % F.greatest(F.floor(F.col("height") / 400), F.lit(1)) == 0)
    gx, gy = F.abs(luma("r") - luma("l")), F.abs(luma("d") - luma("u"))
    inside = inside.withColumns({"gx": gx, "gy": gy}).withColumns({"grad": F.greatest("gx", "gy"), "p": F.when(F.col("gx") >= F.col("gy"), F.col("l")).otherwise(F.col("u")), "q": F.when(F.col("gx") >= F.col("gy"), F.col("r")).otherwise(F.col("d"))})
    same = lambda s: (F.abs(F.col(f"c.r") - F.col(f"{s}.r")) < 0.004) & (F.abs(F.col(f"c.g") - F.col(f"{s}.g")) < 0.004) & (F.abs(F.col(f"c.b") - F.col(f"{s}.b")) < 0.004)  # noqa: E731, F541
    flat = (F.col("grad") < 0.004) & same("l") & same("r") & same("u") & same("d")
    span = {c: F.col(f"q.{c}") - F.col(f"p.{c}") for c in "rgb"}
    from_p = {c: F.col(f"c.{c}") - F.col(f"p.{c}") for c in "rgb"}
    dot = lambda a, b: a["r"] * b["r"] + a["g"] * b["g"] + a["b"] * b["b"]
    t = dot(from_p, span) / F.greatest(dot(span, span), F.lit(1e-300))
    off = {c: from_p[c] - span[c] * t for c in "rgb"}
    edge = F.col("grad") > 0.12
    blend = edge & (dot(span, span) > 1e-6) & t.between(0.12, 0.88) & (F.sqrt(dot(off, off)) < 0.08)
    share = lambda on: F.sum(on.cast("long"))
    counts = inside.groupBy("image_id").agg(F.count("*").alias("sampled"), share(edge).alias("edges"), share(blend).alias("blends"), share(flat).alias("flats"))
    rows = sizes.join(alphas, "image_id").join(colours, "image_id").join(counts, "image_id", "left").na.fill(0, ["sampled", "edges", "blends", "flats"])
    sampled = F.greatest("sampled", F.lit(1)).cast("double")
    rows = rows.select("image_id", "width", "height", "has_alpha", "unique_colors", (F.col("edges") / sampled).alias("edge_density"), F.when(F.col("edges") > 0, F.col("blends") / F.col("edges")).otherwise(0.0).alias("antialiasing"), (F.col("flats") / sampled).alias("flatness"))
    return rows.withColumns(
        {
            "photographic": (F.col("unique_colors") > 256) & (F.col("flatness") < 0.25),
            "pixel_art": (F.col("antialiasing") < 0.15) & (F.col("unique_colors") <= 256) & (F.col("flatness") > 0.45),
            "bilevel": F.col("unique_colors") <= 8,
        }
    )
