"""Colour as column expressions: gamma sRGB in 0..1, CIE Lab (D65), distances, hexadecimal names.

All run inside whole-stage code generation. Fixed values are those of the sRGB and CIE standards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The D65 white point, the linear sRGB to XYZ matrix and its inverse, the Lab constants.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
EPSILON, KAPPA = 216 / 24389, 24389 / 27
LUMA = (0.2126, 0.7152, 0.0722)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def to_byte(c: Column) -> Column:
    """0..1 to 0..255, halves up."""
    return F.floor(clamp(c) * 255.0 + 0.5).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def _rows(matrix, x: Column, y: Column, z: Column) -> list[Column]:
    return [x * a + y * b + z * c for a, b, c in matrix]


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct<l, a, b> of a gamma sRGB colour."""
    f = [F.when(v / w > EPSILON, F.cbrt(v / w)).otherwise((v / w * KAPPA + 16) / 116) for v, w in zip(_rows(TO_XYZ, *map(srgb_to_linear, (r, g, b))), WHITE)]
    return F.struct((f[1] * 116 - 16).alias("l"), ((f[0] - f[1]) * 500).alias("a"), ((f[1] - f[2]) * 200).alias("b"))


def lab5(r: Column, g: Column, b: Column) -> Column:
    """Lab of the nearest node of a 32-step grid of the colour cube: what a lookup table would hold, without one."""
    return lab(*(F.floor(clamp(c) * 31 + 0.5) / 31.0 for c in (r, g, b)))


def lab_to_srgb(lab_: Column) -> list[Column]:
    """r, g, b in 0..1, clamped."""
    fy = (lab_["l"] + 16) / 116
    back = lambda t: F.when(t * t * t > EPSILON, t * t * t).otherwise((t * 116 - 16) / KAPPA)
    xyz = [back(t) * w for t, w in zip((fy + lab_["a"] / 500, fy, fy - lab_["b"] / 200), WHITE)]
    return [clamp(linear_to_srgb(F.greatest(c, F.lit(0.0)))) for c in _rows(FROM_XYZ, *xyz)]


def dist_sq(p: Column, q: Column) -> Column:
    return sum(((p[k] - q[k]) * (p[k] - q[k]) for k in "ab"), (p["l"] - q["l"]) * (p["l"] - q["l"]))


def delta_e2000(table: DataFrame, p: str, q: str, out: str) -> DataFrame:
    """The table with the CIEDE2000 difference of two Lab columns, all parametric factors 1.

    The formula goes through a few projections, so that each term is written, optimised and computed once.
    """
    keep, two, full = table.columns, F.lit(2.0), F.lit(360.0)
    col = {k: f"_{k}" for k in "l1 l2 b1 b2 a1 a2 d1 d2 h1 h2 dh mh ml mc t".split()}
    c = {k: F.col(v) for k, v in col.items()}
    size = lambda x: F.sqrt(F.col(f"{x}.a") * F.col(f"{x}.a") + F.col(f"{x}.b") * F.col(f"{x}.b"))
    c7 = F.pow((size(p) + size(q)) / two, F.lit(7.0))
    step = table.select(*keep, ((1 - F.sqrt(c7 / (c7 + 6103515625.0))) * 0.5 + 1).alias("_g"))
    lab_ = lambda x, n: [F.col(f"{x}.l").alias(f"_l{n}"), F.col(f"{x}.b").alias(f"_b{n}"), (F.col(f"{x}.a") * F.col("_g")).alias(f"_a{n}")]
    step = step.select(*keep, *lab_(p, 1), *lab_(q, 2))
    hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), full))
    far = lambda a, b: F.sqrt(a * a + b * b)
    polar = [far(c["a1"], c["b1"]).alias("_d1"), far(c["a2"], c["b2"]).alias("_d2"), hue(c["a1"], c["b1"]).alias("_h1"), hue(c["a2"], c["b2"]).alias("_h2")]
    step = step.select(*keep, "_l1", "_l2", *polar)
    grey, turn, both = c["d1"] * c["d2"] == 0, c["h2"] - c["h1"], c["h1"] + c["h2"]
    dh = F.when(grey, 0.0).when(turn > 180, turn - full).when(turn < -180, turn + full).otherwise(turn)
    mh = F.when(grey, both).when(F.abs(turn) <= 180, both / two).when(both < 360, (both + full) / two).otherwise((both - full) / two)
    step = step.select(*keep, "_l1", "_l2", "_d1", "_d2", dh.alias("_dh"), mh.alias("_mh"), ((c["l1"] + c["l2"]) / two).alias("_ml"), ((c["d1"] + c["d2"]) / two).alias("_mc"))
    cos = lambda k, shift: F.cos(F.radians(c["mh"] * k + shift))
    t = 1 - cos(1.0, -30.0) * 0.17 + cos(2.0, 0.0) * 0.24 + cos(3.0, 6.0) * 0.32 - cos(4.0, -63.0) * 0.20
    off = (c["ml"] - 50) * (c["ml"] - 50)
    m7 = F.pow(c["mc"], F.lit(7.0))
    bend = F.exp(-F.pow((c["mh"] - 275) / 25.0, two))
    x = (c["l2"] - c["l1"]) / (off * 0.015 / F.sqrt(off + 20) + 1)
    y = (c["d2"] - c["d1"]) / (c["mc"] * 0.045 + 1)
    z = F.sqrt(c["d1"] * c["d2"]) * F.sin(F.radians(c["dh"] / two)) * two / (c["mc"] * t * 0.015 + 1)
    rt = -F.sin(F.radians(bend * 60.0)) * F.sqrt(m7 / (m7 + 6103515625.0)) * 2
    step = step.select(*keep, x.alias("_x"), y.alias("_y"), z.alias("_z"), rt.alias("_t"))
    x, y, z, rt = (F.col(n) for n in ("_x", "_y", "_z", "_t"))
    return step.select(*keep, F.sqrt(F.greatest(x * x + y * y + z * z + rt * y * z, F.lit(0.0))).alias(out))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of byte channels."""
    return F.format_string("#%02x%02x%02x", r, g, b)


def from_hex(text: Column) -> Column:
    """struct<r, g, b, a> of #rrggbb or #rgb (any number of leading #, spaces around), else null."""
    body = F.regexp_replace(F.trim(text), "^#+", "")
    six = F.when(body.rlike("^[0-9A-Fa-f]{6}$"), body).when(body.rlike("^[0-9A-Fa-f]{3}$"), F.regexp_replace(body, "(.)", "$1$1"))
    part = lambda i: F.conv(F.substring(six, i, 2), 16, 10).cast("int")
    return F.when(six.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), F.lit(255).alias("a")))


def over(c: Column, a: Column, background: float | Column = 1.0) -> Column:
    """A channel over an opaque background, in gamma space."""
    return c * a + (1 - a) * background
