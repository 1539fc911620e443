"""Plane geometry as column expressions. Points are structs of x and y; y points down."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed and written once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def half_away(v: Column, decimals: int = 0) -> Column:
    """Binary rounding, halves away from zero, unlike F.round, which rounds the decimal text of a number."""
    f = float(10**decimals)
    return F.signum(v) * F.floor(F.abs(v) * f + 0.5) / f


def cross(o: Column, p: Column, q: Column) -> Column:
    return (p["x"] - o["x"]) * (q["y"] - o["y"]) - (p["y"] - o["y"]) * (q["x"] - o["x"])


def dist(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def dist_point_line(p: Column, a: Column, b: Column) -> Column:
    """To the line through a and b; to a where they are one point."""
    return F.when(dist(a, b) < 1e-12, dist(p, a)).otherwise(F.abs(cross(a, b, p)) / dist(a, b))


def dist_point_segment(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.when(size < 1e-24, 0.0).otherwise(F.greatest(F.least(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.greatest(size, F.lit(1e-300)), F.lit(1.0)), F.lit(0.0)))
    return dist(p, point(a["x"] + dx * t, a["y"] + dy * t))


def turn_angle(a: Column, b: Column, c: Column) -> Column:
    """Signed angle from a->b to b->c."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
    return F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)


def cubic(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    u = 1 - t
    at = lambda k: p0[k] * u * u * u + p1[k] * u * u * t * 3 + p2[k] * u * t * t * 3 + p3[k] * t * t * t
    return point(at("x"), at("y"))


def cubic_tangent(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    u = 1 - t
    at = lambda k: ((p1[k] - p0[k]) * u * u + (p2[k] - p1[k]) * u * t * 2 + (p3[k] - p2[k]) * t * t) * 3
    return point(at("x"), at("y"))


def cubic_steps(p0: Column, p1: Column, p2: Column, p3: Column, tolerance: float) -> Column:
    """Chords that stay within tolerance, by the bound on second differences; 1 to 256."""
    bend = lambda a, b, c: F.sqrt(F.pow(a["x"] - b["x"] * 2 + c["x"], F.lit(2.0)) + F.pow(a["y"] - b["y"] * 2 + c["y"], F.lit(2.0)))
    n = F.ceil(F.sqrt(F.greatest(bend(p0, p1, p2), bend(p1, p2, p3)) * (6.0 / (8.0 * tolerance))))
    return F.greatest(F.least(n, F.lit(256)), F.lit(1)).cast("int")


def flatten_cubic(p0: Column, p1: Column, p2: Column, p3: Column, tolerance: float) -> Column:
    """Array of points after the first."""
    n = cubic_steps(p0, p1, p2, p3, tolerance)
    return F.transform(F.sequence(F.lit(1), n), lambda i: cubic(p0, p1, p2, p3, i.cast("double") / n))


def arc_to_cubics(start: Column, radius: Column, large: Column, sweep: Column, end: Column) -> Column:
    """Array of struct<c1, c2, to>: a circular arc in pieces of 90 degrees at most. Flags as in SVG; a radius below half the chord is raised to it."""
    none = F.expr("array()").cast("array<struct<c1:struct<x:double,y:double>,c2:struct<x:double,y:double>,to:struct<x:double,y:double>>>")

    def with_centre(v: Column) -> Column:
        dx, dy = v["ex"] - v["sx"], v["ey"] - v["sy"]
        high = F.sqrt(F.greatest(v["r"] * v["r"] - v["chord"] * v["chord"] / 4, F.lit(0.0))) * v["side"] / v["chord"]
        cx, cy = (v["sx"] + v["ex"]) / 2 - dy * high, (v["sy"] + v["ey"]) / 2 + dx * high
        return let(F.struct(cx.alias("cx"), cy.alias("cy"), v.alias("v")), with_angles)

    def with_angles(w: Column) -> Column:
        v = w["v"]
        a0 = F.atan2(v["sy"] - w["cy"], v["sx"] - w["cx"])
        raw = F.atan2(v["ey"] - w["cy"], v["ex"] - w["cx"]) - a0
        return let(F.struct(a0.alias("a0"), raw.alias("raw"), w.alias("w")), with_turn)

    def with_turn(u: Column) -> Column:
        sweep_, raw = u["w"]["v"]["sweep"], u["raw"]
        turn = F.when(sweep_ & (raw < 0), raw + 2 * math.pi).when(~sweep_ & (raw > 0), raw - 2 * math.pi).otherwise(raw)
        n = F.greatest(F.ceil(F.abs(turn) / (math.pi / 2) - 1e-9), F.lit(1)).cast("int")
        return let(F.struct((turn / n).alias("step"), n.alias("n"), u.alias("u")), pieces)

    def pieces(s: Column) -> Column:
        w, v = s["u"]["w"], s["u"]["w"]["v"]

        def piece(i: Column) -> Column:
            b, e = s["u"]["a0"] + s["step"] * i, s["u"]["a0"] + s["step"] * (i + 1)
            k = v["r"] * F.tan(s["step"] / 4) * (4.0 / 3.0)
            to = F.when(i == s["n"] - 1, point(v["ex"], v["ey"])).otherwise(point(w["cx"] + v["r"] * F.cos(e), w["cy"] + v["r"] * F.sin(e)))
            c1 = point(w["cx"] + v["r"] * F.cos(b) - k * F.sin(b), w["cy"] + v["r"] * F.sin(b) + k * F.cos(b))
            c2 = point(w["cx"] + v["r"] * F.cos(e) + k * F.sin(e), w["cy"] + v["r"] * F.sin(e) - k * F.cos(e))
            return F.struct(c1.alias("c1"), c2.alias("c2"), to.alias("to"))

        return F.transform(F.sequence(F.lit(0), s["n"] - 1), piece)

    chord = dist(start, end)
    known = F.struct(
        start["x"].alias("sx"), start["y"].alias("sy"), end["x"].alias("ex"), end["y"].alias("ey"), F.greatest(chord, F.lit(1e-300)).alias("chord"),
        F.greatest(radius, chord / 2).alias("r"), F.when(large == sweep, -1.0).otherwise(1.0).alias("side"), sweep.alias("sweep"),
    )
    return F.when(chord < 1e-12, none).otherwise(let(known, with_centre))


def coverage(t: Column, nx: Column, ny: Column) -> Column:
    """Share of a unit pixel inside a half-plane whose edge is t beyond its centre along the unit normal (nx, ny)."""
    a, b = F.greatest(F.abs(nx), F.abs(ny)), F.least(F.abs(nx), F.abs(ny))
    s = F.abs(t)
    reach, flat = (a + b) / 2, (a - b) / 2
    below = F.when(s >= reach, 0.0).when((s <= flat) | (b < 1e-12), 0.5 - s / a).otherwise((reach - s) * (reach - s) / F.greatest(a * b * 2, F.lit(1e-300)))
    share = F.greatest(below, F.lit(0.0))
    return F.when(t < 0, share).otherwise(1 - share)


def coverage_inverse(c: Column, nx: Column, ny: Column) -> Column:
    """The distance whose coverage is c."""
    a, b = F.greatest(F.abs(nx), F.abs(ny)), F.least(F.abs(nx), F.abs(ny))
    low = F.least(c, 1 - c)
    corner = b / (a * 2)
    s = F.when(low >= corner, (0.5 - low) * a).otherwise((a + b) / 2 - F.sqrt(F.greatest(low, F.lit(0.0)) * a * b * 2))
    return F.when(c < 0.5, -s).otherwise(s)


def number(v: Column, precision: int) -> Column:
    """Fixed decimals without trailing zeros or a negative zero; 0 for what isn't finite."""
    text = F.format_string(f"%.{precision}f", half_away(v, precision))
    short = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    odd = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(odd, "0").when(short.isin("-0", ""), "0").otherwise(short)
