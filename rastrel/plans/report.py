"""Reports: candidates and profiles as text or JSON, the benchmark suite with its ceilings, differences as images."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..kernels import paint
from ..sources import scenes
from . import trace


def bar(fraction: float, width: int = 20) -> str:
    full = int(np.floor(min(max(fraction, 0.0), 1.0) * width + 0.5))
    return "#" * full + "." * (width - full)


def shortened(text: str, most: int) -> str:
    """At most this many bytes of UTF-8, cut between characters, with dots where something went."""
    raw = text.encode()
    return text if len(raw) <= most else raw[: max(most - 3, 0)].decode(errors="ignore") + "..."


def metrics_text(found: dict, threshold: float = 2.0) -> str:
    """A score as lines; the threshold printed is the one that was used."""
    return "\n".join(
        [
            f"match      {found['match_pct']:6.2f} % within deltaE {threshold:g}  {bar(found['match_pct'] / 100)}",
            f"deltaE     mean {found['mean_de']:.3f}, 95 % {found['p95_de']:.3f}, max {found['max_de']:.3f}",
            f"error      rmse {found['rmse']:.3f}, psnr {found['psnr']:.2f} dB",
        ]
    )


def candidates_text(candidates: Iterable[dict], target: float, most: int = 40) -> str:
    lines = [f"{'':2} {'label':28} {'match':>7} {'points':>7} {'bytes':>8}"]
    for c in list(candidates)[:most]:
        lines.append(f"{'*' if c['match_pct'] >= target else ' ':2} {shortened(c['label'], 28):28} {c['match_pct']:7.2f} {c['points']:7d} {c['bytes']:8d}")
    return "\n".join(lines)


def candidates_json(candidates: Iterable[dict], target: float) -> str:
    rows = [{**c, "config": json.loads(c["config"]), "meets_target": bool(c["match_pct"] >= target)} for c in candidates]
    return json.dumps({"target": target, "candidates": rows}, default=float)


def suite(spark: SparkSession, config: Config | None, threshold: float = 2.0) -> DataFrame:
    """place, name, match_pct, ceiling_pct, gap, mean_de, points, bytes of each image of the benchmark suite.

    config: of all images; None: the best that the search finds for each (about a minute an image, ten for noisy-shapes).
    The ceiling is the score of the scene's exact geometry drawn by the same painter; a picture has no ceiling and no gap.
    """
    images = trace.dense(scenes.suite(spark))
    scored = trace.score(images, {"suite": config}, threshold) if config else trace.auto_select(images, keep=1)
    ideal = {i: s.svg() for i, s in enumerate(scenes.SUITE) if s.svg()}
    drawn = trace.dense(scenes.suite(spark)).where(F.col("image_id").isin(*ideal))
    names = F.create_map(*(F.lit(v) for i, s in enumerate(scenes.SUITE) for v in (i, s.name)))

    def ceilings(frames):
        for frame in frames:
            best = [paint.compare(trace.unpacked(r.width, r.height, r.data), paint.rasterise(ideal[r.image_id]), threshold)["match_pct"] for r in frame.itertuples()]
            yield frame[["image_id"]].assign(ceiling_pct=best)

    top = drawn.mapInPandas(ceilings, "image_id long, ceiling_pct double")
    both = scored.join(top, "image_id", "left")
    return both.select(F.col("image_id").alias("place"), names[F.col("image_id").cast("int")].alias("name"), "match_pct", "ceiling_pct", (F.col("ceiling_pct") - F.col("match_pct")).alias("gap"), "mean_de", "points", "bytes")


def summary(rows: DataFrame, target: float = 99.0) -> DataFrame:
    """One row: cases, those at target, mean match, points, mean and worst gap."""
    return rows.agg(F.count("*").alias("cases"), F.sum((F.col("match_pct") >= target).cast("int")).alias("at_target"), F.avg("match_pct").alias("mean_match"), F.sum("points").alias("points"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("worst_gap"))


def with_summary(rows: DataFrame, target: float = 99.0) -> DataFrame:
    """The suite's rows in order, then the summary: numbers of cases and of those at target, means, sums, worst gap."""
    numbers = [F.avg(c).alias(c) for c in ("match_pct", "ceiling_pct", "gap", "mean_de")] + [F.sum(c).alias(c) for c in ("points", "bytes")]
    out = rows.rollup("place").agg(F.max("name").alias("name"), *numbers, F.max("gap").alias("worst_gap"), F.count("*").alias("cases"), F.sum((F.col("match_pct") >= target).cast("int")).alias("at_target"))
    named = out.withColumn("name", F.when(F.col("place").isNull(), "summary").otherwise(F.col("name")))
    return named.orderBy(F.col("place").asc_nulls_last()).drop("place")


def difference_png(original: np.ndarray, rendered: np.ndarray, gain: float = 4.0) -> bytes:
    """Amplified absolute difference, opaque."""
    apart = np.minimum(abs(original[..., :3] - rendered[..., :3]) * gain, 1)
    return paint.png(np.dstack([apart, np.ones(apart.shape[:2])]))


def suggested_key(image: np.ndarray) -> str:
    """The colour of the first pixel, white where it is mostly transparent."""
    r, g, b, a = np.floor(image[0, 0] * 255 + 0.5).astype(int)
    return "#ffffff" if a < 128 else f"#{r:02x}{g:02x}{b:02x}"
