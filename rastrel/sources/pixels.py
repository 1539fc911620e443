"""Pixel tables: image_id, y, x and r, g, b, a as doubles in 0..1 (gamma sRGB, straight alpha), one row a pixel.

Sources: the driver's tables (8 x 8 tiles of vectors, heat maps of events and lineitem), raw RGBA buffers, blank images,
and files, through Spark's image reader or decoded from their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "image_id long, y int, x int, r double, g double, b double, a double"


def tiles(embeddings: DataFrame, grey: bool = False) -> DataFrame:
    """Each vector of 64 numbers as an 8 x 8 tile: r from the number itself, g and b from others of the vector."""
    value = F.transform("embedding", lambda e: F.greatest(F.least((e.cast("double") + 0.55) / 1.1, F.lit(1.0)), F.lit(0.0)))
    cells = embeddings.select(F.col("vec_id").alias("image_id"), value.alias("v")).select("image_id", "v", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    at = lambda k: F.element_at("v", (k + 1).cast("int"))
    i = F.col("i")
    g, b = (at(i), at(i)) if grey else (at(63 - i), at((i * 5 + 11) % 64))
    return cells.select("image_id", F.floor(i / 8).cast("int").alias("y"), (i % 8).cast("int").alias("x"), at(i).alias("r"), g.alias("g"), b.alias("b"), F.lit(1.0).alias("a"))


def event_map(events: DataFrame) -> DataFrame:
    """One image: x is the hour since the first midnight, y the user; red the count, green the mean value, blue the share of errors, capped."""
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600).cast("int")
    cells = events.groupBy(F.col("user_id").cast("int").alias("y"), hour.alias("x")).agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.avg((F.col("event_type") == "error").cast("double")).alias("e"))
    return cells.select(F.lit(0).cast("long").alias("image_id"), "y", "x", F.least(F.col("n") / 4.0, F.lit(1.0)).alias("r"), F.greatest(F.least(F.col("v") / 100.0, F.lit(1.0)), F.lit(0.0)).alias("g"), F.col("e").alias("b"), F.lit(1.0).alias("a"))


def blank(spark: SparkSession, width: int, height: int, image_id: int = 0) -> DataFrame:
    """All zero, as many rows as pixels, made on the executors."""
    at = F.col("id")
    zero = [F.lit(0.0).alias(c) for c in "rgba"]
    return spark.range(width * height).select(F.lit(image_id).cast("long").alias("image_id"), F.floor(at / width).cast("int").alias("y"), (at % width).cast("int").alias("x"), *zero)


def from_rgba8(images: DataFrame) -> DataFrame:
    """image_id, width, height, data (RGBA bytes by rows) to pixels; a short buffer is an error, bytes beyond are ignored."""
    need = F.col("width") * F.col("height") * 4
    data = F.when(F.length("data") < need, F.raise_error(F.concat(F.lit("the buffer of image "), F.col("image_id"), F.lit(" is too short"))).cast("binary")).otherwise(F.col("data"))
    cells = images.select("image_id", "width", data.alias("data"), F.explode(F.sequence(F.lit(0), (F.col("width") * F.col("height") - 1).cast("int"))).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), F.col("i") * 4 + k + 1, F.lit(1))), 16, 10).cast("double") / 255
    return cells.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), *(byte(k).alias(c) for k, c in enumerate("rgba")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id (a hash of the path), width, height, data (RGBA) of the files Spark's image reader decodes (PNG, JPEG, GIF, BMP)."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def to_rgba(batches):
        import numpy as np
        import pandas as pd

        for frame in batches:
            out = []
            for h, w, n, raw in zip(frame.height, frame.width, frame.nChannels, frame.data):
                px = np.frombuffer(raw, np.uint8).reshape(h, w, n)
                rgba = np.full((h, w, 4), 255, np.uint8)
                rgba[:, :, :3] = px[:, :, :3][:, :, ::-1] if n >= 3 else px
                if n == 4:
                    rgba[:, :, 3] = px[:, :, 3]
                out.append(rgba.tobytes())
            yield pd.DataFrame({"image_id": frame.image_id, "width": frame.width, "height": frame.height, "data": out})

    named = rows.select(F.xxhash64("origin").alias("image_id"), "width", "height", "nChannels", "data")
    return named.mapInPandas(to_rgba, "image_id long, width int, height int, data binary")


def decode(files: DataFrame, content: str = "content", broken: str = "error") -> DataFrame:
    """image_id (a hash of path), width, height, data (RGBA) of files given as path and bytes, by content; see kernels.decode.

    broken: "error" raises for what can't be read, "drop" leaves it out.
    """

    def run(frames):
        import pandas as pd

        from ..kernels import decode as kernel

        for frame in frames:
            out = []
            for image_id, raw in zip(frame.image_id, frame.content):
                try:
                    image = kernel.image(bytes(raw or b""))
                except ValueError:
                    if broken == "error":
                        raise
                    continue
                out.append((image_id, image.shape[1], image.shape[0], image.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "data"])

    named = files.select(F.xxhash64("path").alias("image_id"), F.col(content).alias("content"))
    return named.mapInPandas(run, "image_id long, width int, height int, data binary")


def read_files(spark: SparkSession, path: str, glob: str = "*", broken: str = "error") -> DataFrame:
    """decode() of all files of a folder."""
    return decode(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content"), broken=broken)


def size(pixels: DataFrame) -> DataFrame:
    """image_id, width, height, n."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count("*").alias("n"))


def rgb(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in "rgb"]
