"""Planar polygon geometry as column expressions over ``array<struct<x double, y double>>``; no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import all_of, let

TYPE = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def cross(a: Column, b: Column, p: Column) -> Column:
    """Twice the signed area of the triangle a, b, p."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _edges(v: Column, value, zero=0.0) -> Column:
    """Sum of ``value(p, q)`` over the edges."""
    n = F.size(v)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(zero), lambda s, i: s + value(F.get(v, i), F.get(v, (i + 1) % n)))


def signed_area(v: Column) -> Column:
    # relative to the first vertex, so that far-away polygons keep their digits
    return let(v, lambda v: F.when(F.size(v) < 3, F.lit(0.0)).otherwise(_edges(v, lambda p, q: cross(F.get(v, F.lit(0)), p, q)) / 2))


def area(v: Column) -> Column:
    return F.abs(signed_area(v))


def centroid(v: Column) -> Column:
    def body(v: Column) -> Column:
        o = F.get(v, F.lit(0))
        part = lambda axis: _edges(v, lambda p, q: (p[axis] + q[axis] - 2 * o[axis]) * cross(o, p, q))
        return let(signed_area(v), lambda a: point(o["x"] + F.try_divide(part("x"), 6 * a), o["y"] + F.try_divide(part("y"), 6 * a)))

    return let(v, body)


def radius(v: Column, centre: Column) -> Column:
    return F.array_max(F.transform(v, lambda p: F.sqrt(F.pow(p["x"] - centre["x"], 2) + F.pow(p["y"] - centre["y"], 2))))


def oriented(v: Column) -> Column:
    """Counter-clockwise vertices."""
    return let(v, lambda v: F.when(signed_area(v) < 0, F.reverse(v)).otherwise(v))


def bounds(v: Column) -> Column:
    at = lambda f, axis: f(F.transform(v, lambda p: p[axis]))
    return F.struct(at(F.array_min, "x").alias("x0"), at(F.array_min, "y").alias("y0"), at(F.array_max, "x").alias("x1"), at(F.array_max, "y").alias("y1"))


def _segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (F.signum(cross(a, b, c)) * F.signum(cross(a, b, d)) < 0) & (F.signum(cross(c, d, a)) * F.signum(cross(c, d, b)) < 0)


def self_crossing(v: Column) -> Column:
    """Whether opposite edges of a quadrilateral cross."""
    p = [F.get(v, F.lit(i)) for i in range(4)]
    return _segments_cross(p[0], p[1], p[2], p[3]) | _segments_cross(p[1], p[2], p[3], p[0])


def swap_middle(v: Column) -> Column:
    """The second and third of four entries exchanged."""
    return F.array(*[F.get(v, F.lit(i)) for i in (0, 2, 1, 3)])


def valid_quad(v: Column) -> Column:
    return F.coalesce((F.size(v) == 4) & ~F.exists(v, lambda p: p.isNull()) & ~self_crossing(v) & (area(v) > 0), F.lit(False))


def convex(v: Column) -> Column:
    """Whether counter-clockwise vertices turn left everywhere."""
    n = F.size(v)
    return F.forall(F.sequence(F.lit(0), n - 1), lambda i: cross(F.get(v, i), F.get(v, (i + 1) % n), F.get(v, (i + 2) % n)) >= 0)


def _clip_edge(poly: Column, a: Column, b: Column) -> Column:
    """What of ``poly`` is left of the line a-b."""
    empty = F.array().cast(TYPE)

    def body(v: Column) -> Column:
        n = F.size(v)

        def corner(i: Column) -> Column:
            p, q = F.get(v, i), F.get(v, (i + 1) % n)

            def sides(s: Column) -> Column:
                t = s["p"] / (s["p"] - s["q"])
                meet = point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
                return F.when((s["p"] >= 0) & (s["q"] >= 0), F.array(q)).when(s["p"] >= 0, F.array(meet)).when(s["q"] >= 0, F.array(meet, q)).otherwise(empty)

            return let(F.struct(cross(a, b, p).alias("p"), cross(a, b, q).alias("q")), sides)

        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), corner))).otherwise(empty)

    return let(poly, body)


def _clipped_area(subject: Column, clip: Column, corners: int) -> Column:
    out = subject
    for i in range(corners):
        out = _clip_edge(out, F.get(clip, F.lit(i)), F.get(clip, F.lit((i + 1) % corners)))
    return area(out)


def _triangles(v: Column) -> Column:
    """A counter-clockwise quadrilateral as two triangles, by the diagonal inside it."""
    p = [F.get(v, F.lit(i)) for i in range(4)]
    by02 = (cross(p[0], p[1], p[2]) >= 0) & (cross(p[0], p[2], p[3]) >= 0)
    return F.when(by02, F.array(F.array(p[0], p[1], p[2]), F.array(p[0], p[2], p[3]))).otherwise(F.array(F.array(p[1], p[2], p[3]), F.array(p[1], p[3], p[0])))


def intersection_area(a: Column, b: Column) -> Column:
    """Area that two quadrilaterals share (Sutherland-Hodgman; concave ones by their triangles)."""

    return let(F.struct(oriented(a).alias("a"), oriented(b).alias("b")), lambda s: oriented_intersection(s["a"], s["b"], convex(s["a"]) & convex(s["b"])))


def oriented_intersection(a: Column, b: Column, both_convex: Column) -> Column:
    """``intersection_area`` of counter-clockwise quadrilaterals."""
    pieces = F.aggregate(_triangles(a), F.lit(0.0), lambda x, t: x + F.aggregate(_triangles(b), F.lit(0.0), lambda y, u: y + _clipped_area(t, u, 3)))
    return F.when(both_convex, _clipped_area(a, b, 4)).otherwise(pieces)


def overlap_fraction(a: Column, b: Column) -> Column:
    """Shared area over the smaller area."""
    return let(intersection_area(a, b), lambda i: F.greatest(F.try_divide(i, area(a)), F.try_divide(i, area(b))))


def contains(v: Column, x: Column, y: Column) -> Column:
    """Whether a point is strictly inside; the boundary is outside."""

    def body(v: Column) -> Column:
        p = point(x, y)
        n = F.size(v)
        at = lambda i: (F.get(v, i), F.get(v, (i + 1) % n))
        every = F.sequence(F.lit(0), n - 1)
        inside_all = F.forall(every, lambda i: cross(*at(i), p) > 0)

        def on(i: Column) -> Column:
            a, b = at(i)
            return (cross(a, b, p) == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

        def ray(i: Column) -> Column:
            a, b = at(i)
            return (((a["y"] > y) != (b["y"] > y)) & ((cross(a, b, p) > 0) == (b["y"] > a["y"]))).cast("int")

        odd = F.aggregate(every, F.lit(0), lambda s, i: s + ray(i)) % 2 == 1
        return F.when(convex(v), inside_all).otherwise(odd & ~F.exists(every, on))

    return let(oriented(v), body)


def closed_ring(v: Column) -> Column:
    return F.concat(v, F.slice(v, 1, 1))


def all_inside(v: Column, xs: list[tuple[Column, Column]]) -> Column:
    return all_of([contains(v, x, y) for x, y in xs])
