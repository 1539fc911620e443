"""Ranking of candidate settings: the point budget, the order, consecutive duplicates, the best few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Percent of match that a doubling of the points must bring, where the target isn't met.
DISCOUNT = 0.5


def point_budget(width: Column, height: Column) -> Column:
    return F.floor(F.sqrt((width * height).cast("double")) * 24 + 1000).cast("long")


def rank(candidates: DataFrame, target: float = 99.0, by: str = "image_id") -> DataFrame:
    """by, label, match_pct, points, budget -> the same with place (from 1).

    Within the budget first; those that meet the target by fewest points, then match; the others by match less what
    their points cost, then fewest points; at last by label.
    """
    over, meets = F.col("points") > F.col("budget"), F.col("match_pct") >= target
    reference = F.greatest(F.col("budget") / 32, F.lit(32.0))
    worth = F.col("match_pct") - F.log2(F.col("points") / reference + 1) * DISCOUNT
    keys = [over, ~meets, F.when(meets, F.col("points")), F.when(meets, -F.col("match_pct")), F.when(~meets, -worth), F.col("points"), F.col("label")]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*keys)))


def without_repeats(ranked: DataFrame, by: str = "image_id") -> DataFrame:
    """Ranked candidates (points, match_pct, colors, tolerance) without those equal to the one before."""
    order = Window.partitionBy(by).orderBy("place")
    before = lambda c: F.lag(c).over(order)
    same = (F.col("points") == before("points")) & (F.abs(F.col("match_pct") - before("match_pct")) < 1e-9)
    same &= (F.col("colors") == before("colors")) & (F.abs(F.col("tolerance") - before("tolerance")) < 1e-12)
    return ranked.withColumn("same_", F.coalesce(same, F.lit(False))).where("not same_").drop("same_")


def best(ranked: DataFrame, k: int = 1) -> DataFrame:
    return ranked.where(F.col("place") <= k)
