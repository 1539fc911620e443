"""The engine's own queries over the driver's tables, and SQL that gives the same rows where SQL can.

Images are 8 x 8 tiles of the embeddings table. Doubles are rounded in both forms.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import colour, geometry
from ..operators import profile, quantize, raster, score, search, segment, topology
from ..sources import pixels as px
from ..sources import scenes
from ..streaming import requests
from . import report, trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str, grey: bool = False) -> DataFrame:
    return px.tiles(table(spark, sf_dir, "embeddings"), grey)


def rounded(df: DataFrame, k: int = 5) -> DataFrame:
    return df.select(*(F.round(c, k).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- SQL parts -------------------------------------------------------------------------------------------------------

_V = lambda i: f"greatest(least((embedding[{i}]::DOUBLE + 0.55) / 1.1, 1.0), 0.0)"
PX = f"""px AS (SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, {_V("i + 1")} AS r,
 {_V("64 - i")} AS g, {_V("(i * 5 + 11) % 64 + 1")} AS b, 1.0::DOUBLE AS a FROM embeddings, range(64) t(i))"""
_LUMA = "({0}r * 0.2126 + {0}g * 0.7152 + {0}b * 0.0722)"
luma = _LUMA.format
_LIN = lambda c: f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"


def lab_sql(r: str, g: str, b: str) -> tuple[str, str, str]:
    f = []
    for row, w in zip(colour.TO_XYZ, colour.WHITE):
        t = "((" + " + ".join(f"{_LIN(c)} * {m!r}" for c, m in zip((r, g, b), row)) + f") / {w!r})"
        f.append(f"(CASE WHEN {t} > 216.0 / 24389 THEN cbrt({t}) ELSE ({t} * 24389 / 27 + 16) / 116 END)")
    return f"({f[1]} * 116 - 16)", f"(({f[0]} - {f[1]}) * 500)", f"(({f[1]} - {f[2]}) * 200)"


def five(c: str) -> str:
    return f"(floor(greatest(least({c}, 1), 0) * 31 + 0.5) / 31.0)"


def de_sql(source: str, keep: str = "") -> str:
    """A query with columns l1 a1 b1 l2 a2 b2 (and those kept) -> those kept and de, CIEDE2000."""
    k = keep + ", " if keep else ""
    return f"""SELECT {k}sqrt(greatest(tl * tl + tc * tc + th * th + rt * tc * th, 0)) AS de FROM (
 SELECT *, (l2 - l1) / (1 + 0.015 * (ml - 50) * (ml - 50) / sqrt(20 + (ml - 50) * (ml - 50))) AS tl, (d2 - d1) / (1 + 0.045 * mc) AS tc,
 2 * sqrt(d1 * d2) * sin(radians(dh / 2)) / (1 + 0.015 * mc * (1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.20 * cos(radians(4 * mh - 63)))) AS th,
 -sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) * 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + 6103515625.0)) AS rt FROM (
 SELECT *, (l1 + l2) / 2 AS ml, (d1 + d2) / 2 AS mc,
 CASE WHEN d1 * d2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
 CASE WHEN d1 * d2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh FROM (
 SELECT *, sqrt(e1 * e1 + b1 * b1) AS d1, sqrt(e2 * e2 + b2 * b2) AS d2,
 CASE WHEN e1 = 0 AND b1 = 0 THEN 0 ELSE CASE WHEN degrees(atan2(b1, e1)) < 0 THEN degrees(atan2(b1, e1)) + 360 ELSE degrees(atan2(b1, e1)) END END AS h1,
 CASE WHEN e2 = 0 AND b2 = 0 THEN 0 ELSE CASE WHEN degrees(atan2(b2, e2)) < 0 THEN degrees(atan2(b2, e2)) + 360 ELSE degrees(atan2(b2, e2)) END END AS h2 FROM (
 SELECT *, a1 * (1 + g_) AS e1, a2 * (1 + g_) AS e2 FROM (
 SELECT *, 0.5 * (1 - sqrt(c7 / (c7 + 6103515625.0))) AS g_ FROM (
 SELECT *, pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) AS c7 FROM ({source}))))))) """


#: Fixed values of the queries: a palette, keyed colours, and the grey limit that makes two labels.
PALETTE = ((0.1, 0.1, 0.1), (0.9, 0.9, 0.9), (0.8, 0.3, 0.3), (0.3, 0.7, 0.4), (0.35, 0.4, 0.8))
KEYS = ["#808080", "#995577"]
_P0, _P1, _P2, _P3 = ("struct_pack(x := 0, y := 0)",) * 4

REGIONS = f"""{PX}, lb AS (SELECT image_id, y, x, y * 8 + x AS i, CAST({luma("")} > 0.5 AS INTEGER) AS label, r, g, b, a FROM px),
 ed AS (SELECT p.image_id, p.i AS u, q.i AS v FROM lb p JOIN lb q ON p.image_id = q.image_id AND p.label = q.label AND abs(p.x - q.x) + abs(p.y - q.y) = 1),
 rc AS (SELECT image_id, i AS src, i AS dst FROM lb UNION SELECT rc.image_id, rc.src, ed.v FROM rc JOIN ed ON ed.image_id = rc.image_id AND ed.u = rc.dst),
 rt AS (SELECT image_id, src AS i, min(dst) AS root FROM rc GROUP BY 1, 2),
 rg AS (SELECT lb.*, CAST(dense_rank() OVER (PARTITION BY lb.image_id ORDER BY root) - 1 AS INTEGER) AS region FROM lb JOIN rt USING (image_id, i))"""
WITH = f"WITH {PX} "
RWITH = f"WITH RECURSIVE {REGIONS} "
_CRACKS = """ck AS (SELECT l.image_id, 'H' AS kind, l.x, l.y, coalesce(u.region, -1) AS lf, l.region AS rgt FROM rg l LEFT JOIN rg u ON u.image_id = l.image_id AND u.x = l.x AND u.y = l.y - 1
 UNION ALL SELECT image_id, 'H', x, 8, region, -1 FROM rg WHERE y = 7
 UNION ALL SELECT l.image_id, 'V', l.x, l.y, l.region, coalesce(u.region, -1) FROM rg l LEFT JOIN rg u ON u.image_id = l.image_id AND u.y = l.y AND u.x = l.x - 1
 UNION ALL SELECT image_id, 'V', 8, y, -1, region FROM rg WHERE x = 7), cr AS (SELECT * FROM ck WHERE lf <> rgt)"""
_NODES = """nd AS (SELECT image_id, x, y, count(*) AS degree FROM (SELECT image_id, x, y FROM cr UNION ALL SELECT image_id, CASE kind WHEN 'H' THEN x + 1 ELSE x END, CASE kind WHEN 'V' THEN y + 1 ELSE y END FROM cr) GROUP BY 1, 2, 3)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    return t.select("image_id", "y", "x", (colour.luma(*px.rgb()) > 0.5).cast("int").alias("label"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.components(labels(spark, sf_dir))


# --- pixels and colour -----------------------------------------------------------------------------------------------


@query(WITH + "SELECT image_id, y, x, round(r, 5) AS r, round(g, 5) AS g, round(b, 5) AS b, round(a, 5) AS a FROM px")
def tile_pixels(spark, sf_dir):
    return rounded(tiles(spark, sf_dir))


@query("""SELECT CAST(user_id AS INTEGER) AS y, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS INTEGER) AS x, round(least(count(*) / 4.0, 1.0), 5) AS r,
 round(greatest(least(avg(value) / 100.0, 1.0), 0.0), 5) AS g, round(avg(CASE WHEN event_type = 'error' THEN 1.0 WHEN event_type IS NULL THEN NULL ELSE 0.0 END), 5) AS b FROM events GROUP BY 1, 2""")
def event_map(spark, sf_dir):
    return rounded(px.event_map(table(spark, sf_dir, "events"))).select("y", "x", "r", "g", "b")


@query(WITH + "SELECT image_id, y, x, round({0}, 4) AS l, round({1}, 4) AS a, round({2}, 4) AS b FROM px".format(*lab_sql("r", "g", "b")))
def lab_convert(spark, sf_dir):
    t = tiles(spark, sf_dir).select("image_id", "y", "x", colour.lab(*px.rgb()).alias("lab"))
    return rounded(t.select("image_id", "y", "x", "lab.*"), 4)


@query(WITH + "SELECT image_id, y, x, round({0}, 4) AS l, round({1}, 4) AS a, round({2}, 4) AS b FROM px".format(*lab_sql(five("r"), five("g"), five("b"))))
def lab_grid(spark, sf_dir):
    t = tiles(spark, sf_dir).select("image_id", "y", "x", colour.lab5(*px.rgb()).alias("lab"))
    return rounded(t.select("image_id", "y", "x", "lab.*"), 4)


def _back_sql() -> str:
    """r, g, b of l_, a_, b_, clamped."""
    f = ("((l_ + 16) / 116 + a_ / 500)", "((l_ + 16) / 116)", "((l_ + 16) / 116 - b_ / 200)")
    xyz = [f"(CASE WHEN pow({t}, 3) > 216.0 / 24389 THEN pow({t}, 3) ELSE ({t} * 116 - 16) * 27 / 24389 END * {w!r})" for t, w in zip(f, colour.WHITE)]
    out = []
    for row, name in zip(colour.FROM_XYZ, "rgb"):
        c = "greatest(" + " + ".join(f"{v} * {m!r}" for v, m in zip(xyz, row)) + ", 0)"
        out.append(f"round(greatest(least(CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4) - 0.055 END, 1), 0), 4) AS {name}")
    return ", ".join(out)


@query(WITH + f"SELECT image_id, y, x, {_back_sql()} FROM (SELECT image_id, y, x, r * 100 AS l_, (g - 0.5) * 120 AS a_, (b - 0.5) * 120 AS b_ FROM px)")
def lab_to_rgb(spark, sf_dir):
    """Pixels read as Lab, to gamma sRGB."""
    at = F.struct((F.col("r") * 100).alias("l"), ((F.col("g") - 0.5) * 120).alias("a"), ((F.col("b") - 0.5) * 120).alias("b"))
    t = tiles(spark, sf_dir).select("image_id", "y", "x", at.alias("lab"))
    return rounded(t.select("image_id", "y", "x", *(c.alias(n) for c, n in zip(colour.lab_to_srgb(F.col("lab")), "rgb"))), 4)


_PAIR = "SELECT image_id, y, x, {0} AS l1, {1} AS a1, {2} AS b1, {3} AS l2, {4} AS a2, {5} AS b2 FROM px".format(*lab_sql("r", "g", "b"), *lab_sql("g", "b", "r"))


@query(WITH + "SELECT image_id, y, x, round(de, 4) AS de FROM (" + de_sql(_PAIR, "image_id, y, x") + ")")
def delta_e2000_pairs(spark, sf_dir):
    t = tiles(spark, sf_dir).select("image_id", "y", "x", colour.lab(*px.rgb()).alias("p"), colour.lab(F.col("g"), F.col("b"), F.col("r")).alias("q"))
    return rounded(colour.delta_e2000(t, "p", "q", "de").drop("p", "q"), 4)


_BYTE = lambda c: f"CAST(floor({c} * 255 + 0.5) AS INTEGER)"


@query(WITH + f"SELECT image_id, y, x, printf('#%02x%02x%02x', {_BYTE('r')}, {_BYTE('g')}, {_BYTE('b')}) AS hex, {_BYTE('r')} AS r, {_BYTE('g')} AS g, {_BYTE('b')} AS b, 255 AS a FROM px")
def hex_roundtrip(spark, sf_dir):
    t = raster.to_rgba8(tiles(spark, sf_dir)).select("image_id", "y", "x", colour.to_hex(*px.rgb()).alias("hex"))
    return t.select("*", colour.from_hex(F.col("hex")).alias("c")).select("image_id", "y", "x", "hex", "c.*")


@query(WITH + "SELECT image_id, y, x, round(r * g + (1 - g) * 1.0, 5) AS r, round(g * g + (1 - g) * 0.5, 5) AS g, round(b * g + (1 - g) * 0.25, 5) AS b FROM px")
def composite_over(spark, sf_dir):
    t = tiles(spark, sf_dir).withColumn("a", F.col("g"))
    return rounded(raster.composite_over(t, (1.0, 0.5, 0.25)).drop("a"))


@query(WITH + "SELECT image_id, bool_or(g < 0.999) AS has_alpha FROM px GROUP BY 1")
def has_alpha(spark, sf_dir):
    return raster.has_alpha(tiles(spark, sf_dir).withColumn("a", F.col("g")))


@query(WITH + "SELECT image_id, y, x, round(CASE WHEN x < 6 THEN least(abs(r - g) * 4, 1) ELSE 0 END, 5) AS r, round(CASE WHEN x < 6 THEN least(abs(g - b) * 4, 1) ELSE 0 END, 5) AS g, round(CASE WHEN x < 6 THEN least(abs(b - r) * 4, 1) ELSE 0 END, 5) AS b, CASE WHEN x < 6 THEN 1.0 ELSE 0.0 END AS a FROM px")
def difference_gain(spark, sf_dir):
    t = tiles(spark, sf_dir)
    other = t.where("x < 6").select("image_id", "y", "x", F.col("g").alias("r"), F.col("b").alias("g"), F.col("r").alias("b"), "a")
    return rounded(raster.difference(t, other, 4.0))


# --- resampling and stencils -----------------------------------------------------------------------------------------

_MEAN = "round(avg(r), 5) AS r, round(avg(g), 5) AS g, round(avg(b), 5) AS b"


@query(WITH + f"SELECT image_id, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x, {_MEAN} FROM px WHERE y < 6 AND x < 6 GROUP BY 1, 2, 3")
def downsample_box(spark, sf_dir):
    return rounded(raster.downsample(tiles(spark, sf_dir), 3).drop("a"))


def _cells(n: int, m: int) -> str:
    return f"(SELECT j, CAST(floor(j * {n}::DOUBLE / {m}) AS INTEGER) AS lo, greatest(CAST(ceil((j + 1) * {n}::DOUBLE / {m}) AS INTEGER), CAST(floor(j * {n}::DOUBLE / {m}) AS INTEGER) + 1) AS hi FROM range({m}) t(j))"


@query(WITH + f"SELECT image_id, CAST(v.j AS INTEGER) AS y, CAST(h.j AS INTEGER) AS x, {_MEAN} FROM px JOIN {_cells(8, 3)} v ON y >= v.lo AND y < v.hi JOIN {_cells(8, 5)} h ON x >= h.lo AND x < h.hi GROUP BY 1, 2, 3")
def resize_area(spark, sf_dir):
    return rounded(raster.resized(tiles(spark, sf_dir), 5, 3).drop("a"))


@query(WITH + f"SELECT image_id, CAST(v.j AS INTEGER) AS y, CAST(h.j AS INTEGER) AS x, {_MEAN} FROM px JOIN {_cells(8, 6)} v ON y >= v.lo AND y < v.hi JOIN {_cells(8, 6)} h ON x >= h.lo AND x < h.hi GROUP BY 1, 2, 3")
def fit_within(spark, sf_dir):
    return rounded(raster.fit_within(tiles(spark, sf_dir), 6).drop("a"))


@query(WITH + """SELECT image_id, px_ AS px, py_ AS py, round(sum(r * w), 5) AS r, round(sum(g * w), 5) AS g, round(sum(b * w), 5) AS b FROM (
 SELECT q.image_id, px_, py_, p.r, p.g, p.b, (1 - abs(dx - (px_ - 0.5 - floor(px_ - 0.5)))) * (1 - abs(dy - (py_ - 0.5 - floor(py_ - 0.5)))) AS w FROM
 (SELECT vec_id AS image_id, vec_id % 9 + 0.25 AS px_, vec_id % 7 + 0.6 AS py_, dx, dy FROM embeddings, range(2) a(dx), range(2) b(dy)) q
 JOIN px p ON p.image_id = q.image_id AND p.x = greatest(least(floor(px_ - 0.5) + dx, 7), 0) AND p.y = greatest(least(floor(py_ - 0.5) + dy, 7), 0)) GROUP BY 1, 2, 3""")
def sample_bilinear(spark, sf_dir):
    at = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), (F.col("vec_id") % 9 + 0.25).alias("px"), (F.col("vec_id") % 7 + 0.6).alias("py"))
    return rounded(raster.sample(tiles(spark, sf_dir), at).drop("a"))


_G = lambda c: f"sqrt(pow(sum({c} * dx * (2 - abs(dy))), 2) + pow(sum({c} * dy * (2 - abs(dx))), 2))"
_NEAR = "FROM px c JOIN range(-1, 2) m(dy) ON true JOIN range(-1, 2) k(dx) ON true JOIN px n ON n.image_id = c.image_id AND n.y = greatest(least(c.y + dy, 7), 0) AND n.x = greatest(least(c.x + dx, 7), 0)"


@query(WITH + f"SELECT image_id, y, x, round(exp(-pow(greatest(gr, gg, gb) * 0.25 / 0.12, 2)), 5) AS w FROM (SELECT c.image_id, c.y, c.x, {_G('n.r')} AS gr, {_G('n.g')} AS gg, {_G('n.b')} AS gb {_NEAR} GROUP BY 1, 2, 3)")
def flatness_sobel(spark, sf_dir):
    return rounded(raster.flatness(tiles(spark, sf_dir)))


_LABS = "lp AS (SELECT *, {0} AS l_, {1} AS a_, {2} AS b_ FROM px)".format(*lab_sql("r", "g", "b"))
_BW = "exp(-(dx * dx + dy * dy) / 0.5) * exp(-(pow(c.l_ - n.l_, 2) + pow(c.a_ - n.a_, 2) + pow(c.b_ - n.b_, 2)) / 32.0)"


@query(f"WITH {PX}, {_LABS} SELECT image_id, y, x, round(sum(r * w) / sum(w), 5) AS r, round(sum(g * w) / sum(w), 5) AS g, round(sum(b * w) / sum(w), 5) AS b FROM (SELECT c.image_id, c.y, c.x, n.r, n.g, n.b, {_BW} AS w FROM lp c JOIN range(-1, 2) m(dy) ON true JOIN range(-1, 2) k(dx) ON true JOIN lp n ON n.image_id = c.image_id AND n.y = c.y + dy AND n.x = c.x + dx) GROUP BY 1, 2, 3")
def bilateral_r1(spark, sf_dir):
    return rounded(raster.bilateral(tiles(spark, sf_dir), 1, 4.0).drop("a"))


_K = raster.gaussian_kernel(1.5, 5)
_KERNEL = "kn AS (SELECT * FROM (VALUES " + ", ".join(f"({i - 5}, {k!r}::DOUBLE)" for i, k in enumerate(_K)) + ") t(d, w))"


@query(f"WITH {PX}, {_KERNEL}, ax AS (SELECT c.image_id, c.y, c.x, sum(n.r * w) AS r FROM px c CROSS JOIN kn JOIN px n ON n.image_id = c.image_id AND n.y = c.y AND n.x = greatest(least(c.x + d, 7), 0) GROUP BY 1, 2, 3) SELECT c.image_id, c.y, c.x, round(sum(n.r * w), 5) AS r FROM ax c CROSS JOIN kn JOIN ax n ON n.image_id = c.image_id AND n.x = c.x AND n.y = greatest(least(c.y + d, 7), 0) GROUP BY 1, 2, 3")
def gaussian_blur(spark, sf_dir):
    return rounded(raster.blur(tiles(spark, sf_dir), ["r"]))


_PUSH = lambda c: f"round(greatest(least(m{c} + ({c} - m{c}) * 1.35 - sign({c} - m{c}) * 0.35 * 0.12 * least(abs({c} - m{c}), 0.5), 1), 0), 5) AS {c}"


@query(WITH + f"SELECT image_id, y, x, {_PUSH('r')}, {_PUSH('g')}, {_PUSH('b')} FROM (SELECT *, avg(r) OVER w AS mr, avg(g) OVER w AS mg, avg(b) OVER w AS mb FROM px WINDOW w AS (PARTITION BY image_id, y // 4, x // 4))")
def block_artifacts(spark, sf_dir):
    return rounded(raster.block_artifacts(tiles(spark, sf_dir), 0.35, 4).drop("a"))


# --- palettes --------------------------------------------------------------------------------------------------------

_OTSU = f"""hs AS (SELECT image_id, CAST(floor({luma("")} * 255 + 0.5) AS INTEGER) AS bin, count(*) AS n FROM px GROUP BY 1, 2),
 cu AS (SELECT *, sum(n) OVER u AS wb, sum(n * bin) OVER u AS sb, sum(n) OVER e AS w, sum(n * bin) OVER e AS s FROM hs WINDOW u AS (PARTITION BY image_id ORDER BY bin), e AS (PARTITION BY image_id)),
 ot AS (SELECT image_id, coalesce(arg_max(bin, (wb * (w - wb) * pow(sb / wb - (s - sb) / (w - wb), 2), -bin)) FILTER (WHERE w > wb), 128) / 255.0 AS t FROM cu GROUP BY 1)"""


@query(f"WITH {PX}, {_OTSU} SELECT image_id, round(t, 5) AS threshold FROM ot")
def otsu_threshold(spark, sf_dir):
    return rounded(quantize.otsu(tiles(spark, sf_dir)))


@query(f"WITH {PX}, {_OTSU} SELECT image_id, round(coalesce(avg(r) FILTER (WHERE {luma('')} <= t), 0), 5) AS dark_r, round(coalesce(avg(g) FILTER (WHERE {luma('')} <= t), 0), 5) AS dark_g, round(coalesce(avg(r) FILTER (WHERE {luma('')} > t), 1), 5) AS light_r FROM px JOIN ot USING (image_id) GROUP BY 1")
def binary_palette(spark, sf_dir):
    p = quantize.binary_palette(tiles(spark, sf_dir))
    return rounded(p.select("image_id", F.col("dark.r").alias("dark_r"), F.col("dark.g").alias("dark_g"), F.col("light.r").alias("light_r")))


def _palettes(spark, sf_dir) -> DataFrame:
    colours = [F.struct(*(F.lit(v).alias(c) for v, c in zip(p, "rgb"))) for p in PALETTE]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), quantize.entries(colours).alias("palette"))


_ENTRIES = "pe AS (SELECT entry, {0} AS pl, {1} AS pa, {2} AS pb FROM (VALUES ".format(*lab_sql("er", "eg", "eb")) + ", ".join(f"({i}, {p[0]}::DOUBLE, {p[1]}::DOUBLE, {p[2]}::DOUBLE)" for i, p in enumerate(PALETTE)) + ") t(entry, er, eg, eb))"
_L5 = "l5 AS (SELECT *, {0} AS l_, {1} AS a_, {2} AS b_ FROM px)".format(*lab_sql(five("r"), five("g"), five("b")))
_NEAREST = "ne AS (SELECT image_id, y, x, min_by(entry, (pow(l_ - pl, 2) + pow(a_ - pa, 2) + pow(b_ - pb, 2), entry)) AS label FROM l5, pe GROUP BY 1, 2, 3)"


@query(f"WITH {PX}, {_ENTRIES}, {_L5}, {_NEAREST} SELECT * FROM ne")
def nearest_palette(spark, sf_dir):
    return quantize.assign(tiles(spark, sf_dir), _palettes(spark, sf_dir))


def _keyed(space: str, tolerance: float, coarse: bool) -> str:
    tests = []
    for k in quantize.hex_labs(KEYS):
        e = lab_sql(*((five(repr(v)) if coarse else repr(v)) + "::DOUBLE" for v in k))
        tests.append(f"pow({space}l_ - {e[0]}, 2) + pow({space}a_ - {e[1]}, 2) + pow({space}b_ - {e[2]}, 2) <= {tolerance * tolerance}")
    return "(" + " OR ".join(tests) + ")"


@query(f"WITH {PX}, {_L5} SELECT image_id, y, x, CASE WHEN {_keyed('', 20.0, True)} THEN 0.0 ELSE a END AS a FROM l5")
def scoring_reference(spark, sf_dir):
    return quantize.scoring_reference(tiles(spark, sf_dir), KEYS, 20.0).select("image_id", "y", "x", "a")


def _transparent_sql(tolerance: float) -> str:
    keys = [lab_sql(*(f"{v!r}::DOUBLE" for v in k)) for k in quantize.hex_labs(KEYS)]
    near = lambda p, k: "(" + " + ".join(f"pow({x} - {y}, 2)" for x, y in zip(p, k)) + f" <= {tolerance * tolerance})"
    own = ("pl", "pa", "pb")
    none = [f"NOT EXISTS (SELECT 1 FROM pe WHERE {near(own, k)})" for k in keys]
    rows = [f"SELECT entry, {' OR '.join(near(own, k) for k in keys)} AS transparent FROM pe", f"SELECT {len(PALETTE)}, true WHERE {none[0]}"]
    rows.append(f"SELECT {len(PALETTE)} + CAST({none[0]} AS INTEGER), true WHERE {none[1]} AND NOT ({none[0]} AND {near(keys[0], keys[1])})")
    return f"WITH {_ENTRIES} SELECT entry, transparent, count(*) AS n FROM (" + " UNION ALL ".join(rows) + "), embeddings GROUP BY 1, 2"


@query(_transparent_sql(20.0))
def transparent_keys(spark, sf_dir):
    p = quantize.mark_transparent(_palettes(spark, sf_dir), KEYS, 20.0)
    return p.select(F.explode("palette").alias("p")).groupBy("p.entry", "p.transparent").agg(F.count("*").alias("n"))


@query(f"WITH {PX}, {_ENTRIES}, {_L5}, {_NEAREST} SELECT image_id, label AS entry, count(*) AS n, round(sum(l_ * (0.5 + r)) / sum(0.5 + r), 4) AS l, round(sum(a_ * (0.5 + r)) / sum(0.5 + r), 4) AS a, round(sum(b_ * (0.5 + r)) / sum(0.5 + r), 4) AS b FROM ne JOIN l5 USING (image_id, y, x) GROUP BY 1, 2")
def kmeans_step(spark, sf_dir):
    points = tiles(spark, sf_dir).select("image_id", colour.lab5(*px.rgb()).alias("lab"), (F.col("r") + 0.5).alias("w"))
    return rounded(quantize.lloyd_step(points, _palettes(spark, sf_dir)), 4)


# --- regions and topology --------------------------------------------------------------------------------------------


@query(RWITH + "SELECT image_id, y, x, label, region FROM rg")
def components_tiles(spark, sf_dir):
    return regions(spark, sf_dir)


@query(RWITH + "SELECT image_id, y, x, label, region FROM rg")
def components_large(spark, sf_dir):
    """The form for images larger than a worker: star contraction over neighbour edges."""
    return segment.components_relational(labels(spark, sf_dir))


@query(RWITH + "SELECT image_id, region, any_value(label) AS label, count(*) AS area FROM rg GROUP BY 1, 2")
def region_area(spark, sf_dir):
    return segment.region_table(regions(spark, sf_dir))


_FLAT = f"fl AS (SELECT image_id, y, x, greatest(exp(-pow(greatest(gr, gg, gb) * 0.25 / 0.12, 2)), 0.02) AS w FROM (SELECT c.image_id, c.y, c.x, {_G('n.r')} AS gr, {_G('n.g')} AS gg, {_G('n.b')} AS gb {_NEAR} GROUP BY 1, 2, 3))"


@query(RWITH + f", {_FLAT} SELECT image_id, region, round(sum(r * w) / sum(w), 5) AS r, round(sum(g * w) / sum(w), 5) AS g, round(sum(b * w) / sum(w), 5) AS b FROM rg JOIN fl USING (image_id, y, x) GROUP BY 1, 2")
def region_color(spark, sf_dir):
    t = tiles(spark, sf_dir)
    return rounded(segment.region_colors(t, regions(spark, sf_dir), raster.flatness(t)).drop("a"))


_CONTACT = "ct AS (SELECT p.image_id, p.region, q.region AS other, count(*) AS border FROM rg p JOIN rg q ON p.image_id = q.image_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1 AND p.region <> q.region GROUP BY 1, 2, 3)"


@query(RWITH + f", {_CONTACT} SELECT * FROM ct")
def neighbor_contacts(spark, sf_dir):
    return segment.contacts(regions(spark, sf_dir))


@query(RWITH + f", {_CONTACT}, ar AS (SELECT image_id, region, count(*) AS area FROM rg GROUP BY 1, 2) SELECT ct.image_id, ct.region, min_by(ct.other, (-border, -o.area, ct.other)) AS target FROM ct JOIN ar s ON s.image_id = ct.image_id AND s.region = ct.region AND s.area < 3 JOIN ar o ON o.image_id = ct.image_id AND o.region = ct.other GROUP BY 1, 2")
def despeckle_target(spark, sf_dir):
    return segment.despeckle_targets(regions(spark, sf_dir), 3)


@query()
def despeckle(spark, sf_dir):
    return segment.region_table(segment.components(segment.despeckle(labels(spark, sf_dir), 3)))


@query(RWITH + f", {_CRACKS} SELECT image_id, kind, x, y, lf AS left_region, rgt AS right_region FROM cr")
def cracks(spark, sf_dir):
    return topology.cracks(regions(spark, sf_dir)).withColumnsRenamed({"left": "left_region", "right": "right_region"})


@query(RWITH + f", {_CRACKS}, {_NODES} SELECT image_id, degree, count(*) AS n FROM nd GROUP BY 1, 2")
def node_degree(spark, sf_dir):
    return topology.nodes(topology.cracks(regions(spark, sf_dir))).groupBy("image_id", "degree").agg(F.count("*").alias("n"))


@query(RWITH + f", {_CRACKS}, {_NODES} SELECT image_id, x, y, degree FROM nd WHERE degree <> 2 OR (x IN (0, 8) AND y IN (0, 8))")
def junctions(spark, sf_dir):
    sizes = tiles(spark, sf_dir).groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return topology.junctions(topology.nodes(topology.cracks(regions(spark, sf_dir))), sizes)


@query(RWITH + "SELECT image_id, region, count(*) AS area FROM rg GROUP BY 1, 2")
def crack_area(spark, sf_dir):
    return topology.region_areas(topology.cracks(regions(spark, sf_dir)))


@query("""SELECT l_orderkey AS polygon, round(sum(x * ny - nx * y) / 2, 4) AS area FROM (SELECT l_orderkey, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
 FROM (SELECT l_orderkey, l_linenumber AS s1, l_partkey AS s2, l_suppkey AS s3, l_quantity AS x, l_discount * 100 AS y FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY s1, s2, s3, x, y)) GROUP BY 1""")
def ring_area(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("polygon"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount").alias("seq"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return rounded(topology.polygon_areas(v, ["polygon"]), 4)


# --- scoring, profile, ranking ---------------------------------------------------------------------------------------


def _pairs(spark, sf_dir) -> DataFrame:
    t = tiles(spark, sf_dir)
    half = t.select("image_id", "y", "x", *((F.floor(F.col(c) * 24) / 24.0).alias(c) for c in "rgb"), "a")
    return score.pair(t, half)


_COARSE = lambda c: f"(floor({c} * 24) / 24.0)"
_SCORED = "SELECT image_id, r, g, b, {0} AS l1, {1} AS a1, {2} AS b1, {3} AS l2, {4} AS a2, {5} AS b2 FROM px".format(*lab_sql("r", "g", "b"), *lab_sql(*map(_COARSE, "rgb")))
_SQ = " + ".join(f"pow({c} - {_COARSE(c)}, 2)" for c in "rgb")


@query(WITH + f", sc AS ({de_sql(_SCORED, 'image_id, r, g, b')}), rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY de) - 1 AS k FROM sc) SELECT image_id, count(*) AS pixels, round(avg(CASE WHEN de <= 2 THEN 100.0 ELSE 0 END), 4) AS match_pct, round(avg(de), 4) AS mean_de, round(max(de), 4) AS max_de, round(sqrt(avg({_SQ}) / 3) * 255, 4) AS rmse, round(max(de) FILTER (WHERE k = 60), 4) AS p95_de, round(least(20 * log10(255 / (sqrt(avg({_SQ}) / 3) * 255)), 99), 4) AS psnr FROM rk GROUP BY 1")
def score_metrics(spark, sf_dir):
    return rounded(score.metrics(_pairs(spark, sf_dir)), 4)


def _blurred(c: str) -> str:
    return f"sum(n.{c} * w) AS {c}"


_LX, _LY = luma("") + " * 255", "(" + " + ".join(f"{_COARSE(c)} * {k}" for c, k in zip("rgb", colour.LUMA)) + ") * 255"
_SUMS = ", ".join(map(_blurred, ("u", "v", "uu", "vv", "uv")))


@query(f"WITH {PX}, {_KERNEL}, l1 AS (SELECT image_id, y, x, {_LX} AS u, {_LY} AS v FROM px), l2 AS (SELECT *, u * u AS uu, v * v AS vv, u * v AS uv FROM l1), ax AS (SELECT c.image_id, c.y, c.x, {_SUMS} FROM l2 c CROSS JOIN kn JOIN l2 n ON n.image_id = c.image_id AND n.y = c.y AND n.x = greatest(least(c.x + d, 7), 0) GROUP BY 1, 2, 3), ay AS (SELECT c.image_id, c.y, c.x, {_SUMS} FROM ax c CROSS JOIN kn JOIN ax n ON n.image_id = c.image_id AND n.x = c.x AND n.y = greatest(least(c.y + d, 7), 0) GROUP BY 1, 2, 3) SELECT image_id, round(greatest(least(avg((2 * u * v + 6.5025) * (2 * (uv - u * v) + 58.5225) / ((u * u + v * v + 6.5025) * (uu - u * u + vv - v * v + 58.5225))), 1), -1), 5) AS ssim FROM ay GROUP BY 1")
def ssim(spark, sf_dir):
    return rounded(score.ssim(_pairs(spark, sf_dir)))


_SAME = lambda s: f"abs(c.r - {s}.r) < 0.004 AND abs(c.g - {s}.g) < 0.004 AND abs(c.b - {s}.b) < 0.004"
_IN = " ".join(f"JOIN px {n} ON {n}.image_id = c.image_id AND {n}.y = c.y + ({dy}) AND {n}.x = c.x + ({dx})" for n, dy, dx in (("l", 0, -1), ("r", 0, 1), ("u", -1, 0), ("d", 1, 0)))


@query(WITH + f"""SELECT q.image_id, 8 AS width, 8 AS height, unique_colors, round(edges / 36.0, 5) AS edge_density, round(flats / 36.0, 5) AS flatness, unique_colors <= 8 AS bilevel FROM
 (SELECT image_id, count(DISTINCT CAST(floor(r * 31) AS INTEGER) * 1024 + CAST(floor(g * 31) AS INTEGER) * 32 + CAST(floor(b * 31) AS INTEGER)) AS unique_colors FROM px GROUP BY 1) q JOIN
 (SELECT image_id, count(*) FILTER (WHERE gr > 0.12) AS edges, count(*) FILTER (WHERE gr < 0.004 AND same) AS flats FROM (SELECT c.image_id, greatest(abs({luma('r.')} - {luma('l.')}), abs({luma('d.')} - {luma('u.')})) AS gr, {_SAME('l')} AND {_SAME('r')} AND {_SAME('u')} AND {_SAME('d')} AS same FROM px c {_IN}) GROUP BY 1) e USING (image_id)""")
def image_profile(spark, sf_dir):
    p = profile.profile(tiles(spark, sf_dir))
    return rounded(p.select("image_id", "width", "height", "unique_colors", "edge_density", "flatness", "bilevel"))


_CAND = "cd AS (SELECT p_size AS image_id, p_partkey AS label, 90 + p_retailprice % 10 AS match_pct, CAST(p_retailprice AS BIGINT) % 700 * 9 AS points, 4500 AS budget FROM part)"
_WORTH = "match_pct - 0.5 * log2(1 + points / greatest(budget / 32.0, 32.0))"


def _candidates(spark, sf_dir) -> DataFrame:
    points = F.floor(F.col("p_retailprice") + 0.5).cast("long") % 700 * 9
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("image_id"), F.col("p_partkey").alias("label"), (F.col("p_retailprice") % 10 + 90).alias("match_pct"), points.alias("points"), F.lit(4500).alias("budget"))


@query(f"WITH {_CAND.replace('CAST(p_retailprice AS BIGINT)', 'CAST(floor(p_retailprice + 0.5) AS BIGINT)')} SELECT image_id, label, points, row_number() OVER (PARTITION BY image_id ORDER BY points > budget, match_pct < 95, CASE WHEN match_pct >= 95 THEN points END, CASE WHEN match_pct >= 95 THEN -match_pct END, CASE WHEN match_pct < 95 THEN -({_WORTH}) END, points, label) AS place FROM cd")
def rank_candidates(spark, sf_dir):
    return search.rank(_candidates(spark, sf_dir), 95.0).select("image_id", "label", "points", F.col("place").cast("long").alias("place"))


@query("SELECT p_size AS image_id, p_partkey AS label, round(exp(-greatest(100 - (90 + p_retailprice % 10), 0) / 100 / 0.05) * 200 / (200 + p_size) * 100, 5) AS composite, CAST(floor(24 * sqrt(p_size * 37) + 1000) AS BIGINT) AS budget FROM part")
def composite_score(spark, sf_dir):
    match = F.col("p_retailprice") % 10 + 90
    return rounded(table(spark, sf_dir, "part").select(F.col("p_size").alias("image_id"), F.col("p_partkey").alias("label"), score.composite(match, F.col("p_size"), 95.0, 200.0).alias("composite"), search.point_budget(F.col("p_size"), F.lit(37)).alias("budget")))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_generation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return requests.latest(e, "user_id", "ts")


@query("""SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM
 (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events)) GROUP BY user_id, burst""")
def debounced_requests(spark, sf_dir):
    """The last event of each burst of a user's events that follow each other within half an hour."""
    return requests.debounced(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "30 minutes")


# --- geometry --------------------------------------------------------------------------------------------------------

_ANGLE = "radians(p_partkey % 90)"


_SIDE = "SELECT p_partkey, (p_retailprice % 101) / 101 * 0.98 + 0.01 AS c, greatest(abs(cos({0})), abs(sin({0}))) AS a, least(abs(cos({0})), abs(sin({0}))) AS b FROM part".format(_ANGLE)


@query(f"""SELECT p_partkey, round(CASE WHEN c < 0.5 THEN -s ELSE s END, 5) AS distance, round(c, 5) AS share FROM
 (SELECT *, CASE WHEN least(c, 1 - c) >= b / (a * 2) THEN (0.5 - least(c, 1 - c)) * a ELSE (a + b) / 2 - sqrt(least(c, 1 - c) * a * b * 2) END AS s FROM ({_SIDE}))""")
def coverage_inverse(spark, sf_dir):
    """How far from its centre an edge cuts a pixel that is covered by this share, and the share that this distance gives."""
    share = (F.col("p_retailprice") % 101) / 101 * 0.98 + 0.01
    nx, ny = F.cos(F.radians(F.col("p_partkey") % 90)), F.sin(F.radians(F.col("p_partkey") % 90))
    far = geometry.coverage_inverse(share, nx, ny)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", far.alias("distance"), geometry.coverage(far, nx, ny).alias("share")))


def _part_points(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x, y = F.col("p_size").cast("double"), F.col("p_partkey") % 17
    return p, [geometry.point(x, y), geometry.point(x + 3, y + 7), geometry.point(x * 2, y - 4), geometry.point(x + 11, y * 3)]


_B = lambda a, b, c, d: f"({a}) * pow(1 - t, 3) + ({b}) * 3 * t * pow(1 - t, 2) + ({c}) * 3 * t * t * (1 - t) + ({d}) * pow(t, 3)"
_N = "greatest(least(CAST(ceil(sqrt(0.75 / 0.5 * greatest(sqrt(pow(x - 2 * (x + 3) + 2 * x, 2) + pow(y - 2 * (y + 7) + y - 4, 2)), sqrt(pow(x + 3 - 4 * x + x + 11, 2) + pow(y + 7 - 2 * (y - 4) + 3 * y, 2))))) AS INTEGER), 256), 1)"


@query(f"SELECT p_partkey, i AS seq, round({_B('x', 'x + 3', '2 * x', 'x + 11')}, 5) AS x, round({_B('y', 'y + 7', 'y - 4', '3 * y')}, 5) AS y FROM (SELECT p_partkey, x, y, CAST(i AS INTEGER) AS i, i::DOUBLE / n AS t FROM (SELECT p_partkey, x, y, {_N} AS n FROM (SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 17)::DOUBLE AS y FROM part)), range(1, 257) g(i) WHERE i <= n)")
def flatten_cubic(spark, sf_dir):
    p, points = _part_points(spark, sf_dir)
    flat = p.select("p_partkey", F.posexplode(geometry.flatten_cubic(*points, 0.5)).alias("seq", "p"))
    return rounded(flat.select("p_partkey", (F.col("seq") + 1).alias("seq"), "p.x", "p.y"))


@query("""SELECT p_partkey, round(CASE WHEN sqrt(pow(dx, 2) + pow(dy, 2)) < 1e-12 THEN 0 ELSE abs(dx * 2 - dy * 1) / sqrt(dx * dx + dy * dy) END, 5) AS to_line, round(atan2(dx * 2 - dy * 1, dx + dy * 2), 5) AS turn FROM (SELECT p_partkey, p_size::DOUBLE AS dx, (p_partkey % 17)::DOUBLE AS dy FROM part)""")
def line_distance(spark, sf_dir):
    o, p = geometry.point(F.lit(0), F.lit(0)), geometry.point(F.col("p_size"), F.col("p_partkey") % 17)
    q = geometry.point(F.col("p_size") + 1, F.col("p_partkey") % 17 + 2)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", geometry.dist_point_line(q, o, p).alias("to_line"), geometry.turn_angle(o, p, q).alias("turn")))


_TURN = "(CASE WHEN p_partkey % 2 = 0 THEN pi() / 2 ELSE -pi() / 2 END)"
_KNOT = lambda c, e: f"round({c}, 5) + 0.0 AS {e}"


@query(f"""SELECT p_partkey, CAST(i AS INTEGER) AS seq, {_KNOT('r * cos(b) - k * sin(b)', 'x1')}, {_KNOT('r * sin(b) + k * cos(b)', 'y1')}, {_KNOT('r * cos(e) + k * sin(e)', 'x2')}, {_KNOT('r * sin(e) - k * cos(e)', 'y2')},
 {_KNOT('r * cos(e)', 'x')}, {_KNOT('r * sin(e)', 'y')} FROM (SELECT *, r * 4 / 3 * tan((e - b) / 4) AS k FROM (SELECT p_partkey, p_size + 20.0::DOUBLE AS r, i, i * {_TURN} AS b, (i + 1) * {_TURN} AS e
 FROM part, range(3) t(i) WHERE i < CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 3 END))""")
def arc_to_cubics(spark, sf_dir):
    """A quarter or three quarters of a circle round the origin: control points and ends of every piece."""
    r, large = (F.col("p_size") + 20).cast("double"), F.col("p_partkey") % 2 == 1
    pieces = geometry.arc_to_cubics(geometry.point(r, F.lit(0)), r, large, ~large, geometry.point(F.lit(0), r))
    t = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(pieces).alias("seq", "c"))
    at = lambda p, k, n: (F.round(F.col(f"c.{p}.{k}"), 5) + 0.0).alias(n)
    return t.select("p_partkey", "seq", at("c1", "x", "x1"), at("c1", "y", "y1"), at("c2", "x", "x2"), at("c2", "y", "y2"), at("to", "x", "x"), at("to", "y", "y"))


@query("SELECT l_orderkey, l_linenumber, CAST(sign(v) * floor(abs(v) * 100 + 0.5) / 100 AS DOUBLE) AS v2 FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * (l_discount - 0.05) AS v FROM lineitem)")
def round_half_away(spark, sf_dir):
    v = F.col("l_extendedprice") * (F.col("l_discount") - 0.05)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (geometry.half_away(v, 2) + 0.0).alias("v2"))


_SHORT = "regexp_replace(regexp_replace(printf('%.3f', sign(v) * floor(abs(v) * 1000 + 0.5) / 1000), '0+$', ''), '[.]$', '')"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN {_SHORT} IN ('-0', '') THEN '0' ELSE {_SHORT} END AS text FROM
 (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN round(l_quantity) WHEN 1 THEN (l_discount - 0.05) * l_extendedprice / 7 ELSE (l_discount - 0.05) / 128 END AS v FROM lineitem)""")
def number_format(spark, sf_dir):
    """Whole numbers, long fractions, and numbers that are nothing after rounding."""
    q, d, p = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")
    v = F.when(F.col("l_linenumber") % 3 == 0, F.round(q)).when(F.col("l_linenumber") % 3 == 1, (d - 0.05) * p / 7).otherwise((d - 0.05) / 128)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.number(v, 3).alias("text"))


# --- scenes, tracing, search -----------------------------------------------------------------------------------------

_HARD = scenes.SUITE[0]


_BOX = lambda c: "CASE WHEN x >= 70 AND x < 140 AND y >= 50 AND y < 100 THEN {} WHEN x >= 20 AND x < 100 AND y >= 20 AND y < 70 THEN {} ELSE 255 END".format(*c)


@query(f"SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {_BOX((220, 30))} AS r, {_BOX((60, 60))} AS g, {_BOX((40, 180))} AS b FROM range(160) a(x), range(120) b(y)")
def scene_hard(spark, sf_dir):
    return scenes.render(spark, _HARD).select("y", "x", *(F.round(F.col(c) * 255).cast("int").alias(c) for c in "rgb"))


def _polygons_sql(scene: scenes.Scene) -> str:
    """Each sample takes the colour of the last polygon of which an odd number of edges lies to its right."""
    edges = ", ".join(
        f"({k}, {float(ax)!r}::DOUBLE, {float(ay)!r}::DOUBLE, {float(bx)!r}::DOUBLE, {float(by)!r}::DOUBLE)"
        for k, item in enumerate(scene.items) for (ax, ay), (bx, by) in zip(item.points, item.points[1:] + item.points[:1]) if ay != by
    )
    colours = ", ".join(f"({k}, {item.colour[0]}, {item.colour[1]}, {item.colour[2]})" for k, item in enumerate(scene.items))
    s, back = scene.supersample, scene.background
    means = ", ".join(f"round(avg(coalesce(c.{c}, {v})) / 255, 4) AS {c}" for c, v in zip("rgb", back))
    return f"""WITH ed AS (SELECT * FROM (VALUES {edges}) t(k, ax, ay, bx, by_)), co AS (SELECT * FROM (VALUES {colours}) t(k, r, g, b)),
 sa AS (SELECT i, j, (i + 0.5) / {s} AS x, (j + 0.5) / {s} AS y FROM range({scene.width * s}) a(i), range({scene.height * s}) b(j)),
 cr AS (SELECT i, j, k FROM sa JOIN ed ON (ay > y) <> (by_ > y) AND x < (y - ay) * ((bx - ax) / (by_ - ay)) + ax GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
 tp AS (SELECT i, j, max(k) AS k FROM cr GROUP BY 1, 2)
 SELECT CAST(sa.j // {s} AS INTEGER) AS y, CAST(sa.i // {s} AS INTEGER) AS x, {means} FROM sa LEFT JOIN tp USING (i, j) LEFT JOIN co c USING (k) GROUP BY 1, 2"""


@query(_polygons_sql(scenes.SUITE[2]))
def scene_slants(spark, sf_dir):
    return rounded(scenes.render(spark, scenes.SUITE[2]).select("y", "x", *"rgb"), 4)


@query(_polygons_sql(scenes.SUITE[3]))
def scene_junctions(spark, sf_dir):
    """Too many edges for one generated stage: painted in bands."""
    return rounded(scenes.render(spark, scenes.SUITE[3]).select("y", "x", *"rgb"), 4)


@query("SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(0.15 + 0.7 * x / 159.0, 4) AS r, round(0.25 + 0.5 * y / 119.0, 4) AS g, round(0.85 - 0.5 * x / 159.0, 4) AS b FROM range(160) a(x), range(120) b(y)")
def scene_gradient(spark, sf_dir):
    return rounded(scenes.render(spark, next(s for s in scenes.SUITE if s.name == "gradient")).select("y", "x", *"rgb"), 4)


@query("SELECT 'hard-rects' AS label, 3 AS shapes, 24 AS points, 0 AS handles, 0 AS cubics, 0 AS arcs")
def trace_hard_rects(spark, sf_dir):
    """Three shapes of straight lines only, at the published number of points."""
    return trace.trace(trace.dense(scenes.render(spark, _HARD)), {"hard-rects": config.PRESETS["logo"]}).select("label", "shapes", "points", "handles", "cubics", "arcs")


@query("""SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(avg(CASE WHEN d <= 52.4 * 52.4 THEN 25 ELSE 250 END) / 255, 4) AS r FROM (SELECT sy // 8 AS y, sx // 8 AS x, pow((sx + 0.5) / 8 - 80.3, 2) + pow((sy + 0.5) / 8 - 79.7, 2) AS d FROM range(1280) a(sx), range(1280) b(sy)) GROUP BY 1, 2""")
def scene_circle_aa(spark, sf_dir):
    return rounded(scenes.render(spark, scenes.SUITE[1]).select("y", "x", "r"), 4)


@query("""SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(avg(CASE WHEN d <= 1296 AND d >= 324 THEN 200 WHEN d <= 4900 AND d >= 2304 THEN 40 ELSE 255 END) / 255, 4) AS r FROM (SELECT sy // 8 AS y, sx // 8 AS x, pow((sx + 0.5) / 8 - 80, 2) + pow((sy + 0.5) / 8 - 80, 2) AS d FROM range(1280) a(sx), range(1280) b(sy)) GROUP BY 1, 2""")
def scene_rings(spark, sf_dir):
    return rounded(scenes.render(spark, scenes.SUITE[5]).select("y", "x", "r"), 4)


def _tile_images(spark, sf_dir) -> DataFrame:
    return trace.dense(tiles(spark, sf_dir, grey=True))


@query()
def trace_tiles(spark, sf_dir):
    return trace.trace(_tile_images(spark, sf_dir), {"black-and-white": config.PRESETS["black-and-white"]}).drop("config", "ms")


@query()
def trace_scenes(spark, sf_dir):
    return trace.trace(trace.dense(scenes.suite(spark)), {"logo": config.PRESETS["logo"]}).drop("config", "ms")


@query()
def export_formats(spark, sf_dir):
    configs = {f: config.PRESETS["logo"].with_(output__format=f) for f in ("svg", "eps", "pdf", "dxf")}
    out = trace.trace(trace.dense(scenes.render(spark, scenes.SUITE[6], 6)), configs)
    return out.select("image_id", "label", "points", F.length("content").alias("bytes"))


@query()
def render_roundtrip(spark, sf_dir):
    return rounded(trace.score(trace.dense(scenes.suite(spark)), {"logo": config.PRESETS["logo"].with_(output__recolor_regions=True)}).drop("config"), 3)


@query()
def bench_suite(spark, sf_dir):
    """The images' match, ceiling and gap, and their summary in the last row."""
    return rounded(report.with_summary(report.suite(spark, config.PRESETS["logo"].with_(output__recolor_regions=True))), 3)


@query()
def auto_select(spark, sf_dir):
    """The search's best settings for every tile, with the operator's defaults; it takes over a hundred traces a tile."""
    return rounded(trace.auto_select(_tile_images(spark, sf_dir)).drop("config"), 3)


@query(f"WITH RECURSIVE {REGIONS} SELECT image_id, count(DISTINCT region) AS regions, round(64.0 / count(DISTINCT region), 5) AS mean_area FROM rg GROUP BY 1")
def region_summary(spark, sf_dir):
    """Tiles to labels to components to regions: the flagship."""
    areas = segment.region_table(regions(spark, sf_dir))
    return rounded(areas.groupBy("image_id").agg(F.count("*").alias("regions"), F.avg("area").alias("mean_area")))
