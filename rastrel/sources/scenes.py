"""Synthetic scenes: polygons, discs and rings in painter's order, rendered by supersampling; pictures; the benchmark suite.

render() is one declarative plan: a row for each sample, the scene's items folded in order, a mean for each pixel.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def inside(points: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd, half-open in y."""
    odd = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        if ay != by:
            odd ^= ((ay > y) != (by > y)) & (x < (y - ay) * ((bx - ax) / (by - ay)) + ax)
    return odd


@dataclass(frozen=True)
class Item:
    kind: str  # "polygon", "disc" or "ring"
    points: tuple  # polygon: (x, y) pairs; disc: (cx, cy, r); ring: (cx, cy, outer, inner)
    colour: tuple  # 0..255

    def contains(self, x: Column, y: Column) -> Column:
        """Even-odd and half-open in y for polygons; discs and rings include their borders."""
        if self.kind == "polygon":
            odd = F.lit(False)
            for (ax, ay), (bx, by) in zip(self.points, self.points[1:] + self.points[:1]):
                if ay != by:
                    odd = odd != (((F.lit(float(ay)) > y) != (F.lit(float(by)) > y)) & (x < (y - ay) * ((bx - ax) / (by - ay)) + ax))
            return odd
        cx, cy, outer, *inner = self.points
        d = (x - cx) * (x - cx) + (y - cy) * (y - cy)
        return (d <= outer * outer) & (d >= inner[0] * inner[0]) if inner else d <= outer * outer

    def holds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """contains() of arrays."""
        if self.kind == "polygon":
            return inside(self.points, x, y)
        cx, cy, outer, *inner = self.points
        d = (x - cx) * (x - cx) + (y - cy) * (y - cy)
        return (d <= outer * outer) & (d >= (inner[0] * inner[0] if inner else 0))

    def svg(self) -> str:
        fill = f'fill="#{"".join(f"{c:02x}" for c in self.colour)}"'
        if self.kind == "polygon":
            return f'<path d="M{"L".join(f"{x!r} {y!r}" for x, y in self.points)}Z" fill-rule="evenodd" {fill}/>'
        cx, cy, outer, *inner = self.points
        if not inner:
            return f'<circle cx="{cx!r}" cy="{cy!r}" r="{outer!r}" {fill}/>'
        loop = lambda r: f"M{cx + r!r} {cy!r}A{r!r} {r!r} 0 0 1 {cx - r!r} {cy!r}A{r!r} {r!r} 0 0 1 {cx + r!r} {cy!r}Z"
        return f'<path d="{loop(outer)}{loop(inner[0])}" fill-rule="evenodd" {fill}/>'


@dataclass(frozen=True)
class Scene:
    name: str
    width: int
    height: int
    background: tuple | None  # 0..255, None for transparent
    items: tuple
    supersample: int = 8

    def svg(self) -> str:
        """The exact geometry, as drawn by an ideal tracer."""
        w, h = self.width, self.height
        back = [f'<rect width="{w}" height="{h}" fill="#{"".join(f"{c:02x}" for c in self.background)}"/>'] if self.background else []
        return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}">', *back, *(i.svg() for i in self.items), "</svg>"])


    def make(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The pixels of some rows, 0..1, as render() has them: sums of whole numbers, so that means are exact up to a rounding."""
        s, end = self.supersample, self.height if end is None else end
        x, y = np.meshgrid((np.arange(self.width * s) + 0.5) / s, (np.arange(first * s, end * s) + 0.5) / s)
        top = np.broadcast_to([*self.background, 1.0] if self.background else np.zeros(4), (*x.shape, 4)).copy()
        for item in self.items:
            top[item.holds(x, y)] = [*item.colour, 1.0]
        cells = top.reshape(end - first, s, self.width, s, 4)
        alpha = cells[..., 3:].sum((1, 3))
        rgb = (cells[..., :3] * cells[..., 3:]).sum((1, 3)) / np.where(alpha > 0, alpha, 1) / 255
        return np.dstack([rgb, alpha / (s * s)])


def regular(cx: float, cy: float, r: float, sides: int, turn: float) -> tuple:
    return tuple((cx + r * math.cos(turn + math.tau * k / sides), cy + r * math.sin(turn + math.tau * k / sides)) for k in range(sides))


def star(cx: float, cy: float, outer: float, inner: float, points: int) -> tuple:
    """First vertex up."""
    return tuple((cx + r * math.cos(a), cy + r * math.sin(a)) for k in range(2 * points) for r, a in [((outer, inner)[k % 2], -math.pi / 2 + math.pi * k / points)])


def wedges(cx: float, cy: float, r: float, colours: tuple, steps: int = 24) -> tuple:
    each = math.tau / len(colours)
    rim = lambda i: tuple((cx + r * math.cos(each * (i + k / steps)), cy + r * math.sin(each * (i + k / steps))) for k in range(steps + 1))
    return tuple(Item("polygon", ((cx, cy), *rim(i)), c) for i, c in enumerate(colours))


def box(x0: float, y0: float, x1: float, y1: float) -> tuple:
    return ((x0, y0), (x1, y0), (x1, y1), (x0, y1))


@dataclass(frozen=True)
class Picture:
    """A benchmark image that has no ideal geometry; make gives its pixels, 0..1."""

    name: str
    width: int
    height: int
    make: Callable[[], np.ndarray]

    def svg(self) -> None:
        return None


def pixel_art() -> np.ndarray:
    """128 x 128: cells of 8 pixels, five colours from the random stream."""
    from ..kernels.palette import Stream

    stream, colours = Stream(0xA11CE), np.array([(0.10, 0.10, 0.15), (0.85, 0.25, 0.25), (0.95, 0.85, 0.40), (0.20, 0.55, 0.85), (0.95, 0.95, 0.95)])
    cells = colours[[stream.below(5) for _ in range(256)]].reshape(16, 16, 3)
    return np.dstack([np.kron(cells, np.ones((8, 8, 1))), np.ones((128, 128))])


def gradient(width: int = 160, height: int = 120) -> np.ndarray:
    fx, fy = np.meshgrid(np.arange(width) / (width - 1), np.arange(height) / (height - 1))
    return np.dstack([0.15 + 0.7 * fx, 0.25 + 0.5 * fy, 0.85 - 0.5 * fx, np.ones_like(fx)])


def add_noise(image: np.ndarray, amount: float, seed: int) -> np.ndarray:
    """Uniform noise on r, g and b from the random stream, by rows."""
    from ..kernels.palette import Stream

    stream, out = Stream(seed), image.copy()
    draws = np.array([stream.unit() for _ in range(3 * image.shape[0] * image.shape[1])])
    out[..., :3] = np.clip(out[..., :3] + (2 * draws.reshape(*image.shape[:2], 3) - 1) * amount, 0, 1)
    return out


def add_block_artifacts(image: np.ndarray, strength: float) -> np.ndarray:
    """Ringing like JPEG's: each 8 x 8 block's detail is raised about the block's mean, less a share of large differences."""
    out = image.copy()
    for y in range(0, image.shape[0], 8):
        for x in range(0, image.shape[1], 8):
            cell = image[y : y + 8, x : x + 8, :3]
            mean = cell.mean((0, 1))
            d = cell - mean
            out[y : y + 8, x : x + 8, :3] = np.clip(mean + d * (1 + strength) - np.copysign(1, d) * strength * 0.12 * np.minimum(abs(d), 0.5), 0, 1)
    return out


def noisy_shapes() -> np.ndarray:
    """180 x 140: a box and a star, eight samples a side of each pixel, with block artefacts and noise."""
    w, h, s = 180, 140, 8
    x, y = np.meshgrid((np.arange(w * s) + 0.5) / s, (np.arange(h * s) + 0.5) / s)
    top = np.full((h * s, w * s, 3), 250 / 255)
    for points, colour in ((box(20, 20, 84, 120), (40, 40, 120)), (star(130, 70, 44, 19, 5), (220, 120, 30))):
        top[inside(points, x, y)] = np.array(colour) / 255
    clean = np.dstack([top.reshape(h, s, w, s, 3).mean((1, 3)), np.ones((h, w))])
    return add_noise(add_block_artifacts(clean, 0.35), 0.02, 0x5A17)


#: The benchmark suite; scenes have a known geometry, pictures have none.
SUITE = (
    Scene("hard-rects", 160, 120, (255, 255, 255), (Item("polygon", box(20, 20, 100, 70), (30, 60, 180)), Item("polygon", box(70, 50, 140, 100), (220, 60, 40))), 1),
    Scene("aa-circle", 160, 160, (250, 250, 245), (Item("disc", (80.3, 79.7, 52.4), (25, 110, 190)),)),
    Scene(
        "slants", 200, 140, (255, 255, 255),
        (
            Item("polygon", ((10, 12.3), (190, 40.7), (190, 58.1), (10, 29.9)), (40, 40, 40)),
            Item("polygon", ((18.4, 70), (46.9, 132), (66.2, 132), (37.7, 70)), (200, 90, 20)),
            Item("polygon", ((90, 72.5), (180, 118.5), (120, 132)), (20, 140, 90)),
        ),
    ),
    Scene("junctions", 160, 160, (245, 245, 245), wedges(80, 80, 110, ((210, 70, 60), (60, 150, 210), (240, 190, 50), (90, 180, 90), (140, 90, 180)))),
    Scene("star", 160, 160, (255, 255, 255), (Item("polygon", star(80, 80, 66, 27, 7), (230, 160, 20)),)),
    Scene("rings", 160, 160, (255, 255, 255), (Item("ring", (80, 80, 70, 48), (40, 90, 160)), Item("ring", (80, 80, 36, 18), (200, 70, 60)))),
    Scene(
        "logo", 200, 200, (255, 255, 255),
        (Item("polygon", regular(100, 100, 86, 6, 0.3), (28, 42, 92)), Item("polygon", regular(100, 100, 58, 3, -0.4), (240, 200, 40)), Item("disc", (100, 118, 24), (220, 60, 50))),
    ),
    Picture("pixel-art", 128, 128, pixel_art),
    Picture("noisy-shapes", 180, 140, noisy_shapes),
    Scene("alpha", 140, 140, None, (Item("disc", (60, 70, 40), (200, 50, 90)), Item("polygon", regular(95, 75, 38, 5, 0.2), (40, 150, 180)))),
    Picture("gradient", 160, 120, gradient),
)


EDGES = 48
BAND = 32  # rows of a scene that are painted at a time


def drawn(spark: SparkSession, images: dict[int, Scene | Picture]) -> DataFrame:
    """The pixels of some images by number, made on executors: scenes in bands of rows, pictures whole."""
    bands = [(i, a, min(m.height, a + (BAND if isinstance(m, Scene) else m.height))) for i, m in images.items() for a in range(0, m.height, BAND if isinstance(m, Scene) else m.height)]

    def run(frames):
        for frame in frames:
            for n in frame["id"]:
                i, first, end = bands[n]
                image = images[i]
                pixels = image.make(first, end) if isinstance(image, Scene) else image.make()
                y, x = np.divmod(np.arange(pixels.shape[0] * image.width), image.width)
                yield pd.DataFrame({"image_id": i, "y": y + first, "x": x, **dict(zip("rgba", pixels.reshape(-1, 4).T))})

    parts = min(len(bands), 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, len(bands), 1, parts).mapInPandas(run, "image_id long, y int, x int, r double, g double, b double, a double")


def render(spark: SparkSession, scene: Scene | Picture, image_id: int = 0) -> DataFrame:
    """Pixels by the mean of supersample x supersample samples, each item laid over the last in gamma space.

    A scene of few edges is one declarative plan; each edge is an expression of its own there, and more of them than `EDGES`
    are too much code for one stage, so those scenes and pictures are painted by NumPy.
    """
    if isinstance(scene, Picture) or sum(len(i.points) for i in scene.items if i.kind == "polygon") > EDGES:
        return drawn(spark, {image_id: scene})
    s, w, h = scene.supersample, scene.width, scene.height
    i = F.col("id")
    samples = spark.range(w * h * s * s).select((i % (w * s)).alias("sx"), F.floor(i / (w * s)).alias("sy"))
    x, y = (F.col("sx") + 0.5) / s, (F.col("sy") + 0.5) / s
    top = [F.lit(float(c)) for c in scene.background] + [F.lit(1.0)] if scene.background else [F.lit(0.0)] * 4
    for item in scene.items:
        inside = item.contains(x, y)
        top = [F.when(inside, v).otherwise(t) for v, t in zip([*map(float, item.colour), 1.0], top)]
    painted = samples.select(F.floor(F.col("sy") / s).cast("int").alias("y"), F.floor(F.col("sx") / s).cast("int").alias("x"), *(t.alias(c) for t, c in zip(top, "rgba")))
    weight = F.avg("a")
    # sums of whole numbers have no rounding, whatever their order
    rgb = [F.coalesce(F.sum(F.col(c) * F.col("a")) / F.when(F.sum("a") > 0, F.sum("a")) / 255, F.lit(0.0)).alias(c) for c in "rgb"]
    means = painted.groupBy("y", "x").agg(*rgb, weight.alias("a"))
    return means.select(F.lit(image_id).cast("long").alias("image_id"), "y", "x", *"rgba")


def suite(spark: SparkSession) -> DataFrame:
    """All images' pixels; image_id is the place in SUITE."""
    return drawn(spark, dict(enumerate(SUITE)))
