"""Outlines of unions of polygons: the outer ring of each group, holes filled, one connected piece asked for.

The plane of a group is cut into strips of equal width and these into slabs between all vertices and edge crossings. In a slab
the polygons' parts are trapezoids whose order does not change, so their union is that of intervals, found by a running
maximum. Runs of a slab give directed boundary edges with the inside on the left; at a slab's end, what one side covers and
the other does not gives the vertical ones. Each edge points to the one that follows it around the outside; the ring that
starts at the lowest leftmost point is put in order by pointer doubling.

Scale: joins are by (group, strip), so one group that holds a third of all polygons is dealt over its strips; nothing but the
finished ring of a group is ever gathered. A ring of n edges takes about log2(n) joins, all groups together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import polygon
from ..functions.columns import checked, let
from ..scratch import written


def _edges(fps: DataFrame, group: str, strip: float) -> DataFrame:
    """(group, strip, left, right, poly, x0, y0, x1, y1): each polygon's edges, left end first, in each strip that they reach into."""
    v = fps.select(group, F.monotonically_increasing_id().alias("poly"), polygon.oriented(F.col("vertices")).alias("v"))
    n = F.size("v")
    ring = v.select(group, "poly", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("v", i).alias("p"), F.get("v", (i + 1) % n).alias("q")))).alias("e"))
    flip = F.col("e.p.x") > F.col("e.q.x")
    edge = ring.select(group, "poly", F.when(flip, F.col("e.q")).otherwise(F.col("e.p")).alias("l"), F.when(flip, F.col("e.p")).otherwise(F.col("e.q")).alias("r"))
    edge = edge.select(group, "poly", F.col("l.x").alias("x0"), F.col("l.y").alias("y0"), F.col("r.x").alias("x1"), F.col("r.y").alias("y1"))
    near = F.sequence(F.floor(F.col("x0") / strip) - 1, F.floor(F.col("x1") / strip) + 1)
    edge = edge.withColumn("strip", F.explode(near)).withColumns({"left": F.col("strip") * F.lit(strip), "right": (F.col("strip") + 1) * F.lit(strip)})
    return edge.where((F.col("x0") <= F.col("right")) & (F.col("x1") >= F.col("left")))


def _runs(edge: DataFrame, group: str, tol: float) -> DataFrame:
    """(group, xl, xr, lo, hi): the covered intervals of each slab, ``lo`` and ``hi`` with the heights yl and yr at its ends."""
    where = [group, "strip"]
    a, b = edge.alias("a"), edge.alias("b")
    meet = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.poly") < F.col("b.poly"))
    meet = meet & (F.least("a.y0", "a.y1") <= F.greatest("b.y0", "b.y1")) & (F.least("b.y0", "b.y1") <= F.greatest("a.y0", "a.y1"))
    slope = lambda s: (F.col(f"{s}.y1") - F.col(f"{s}.y0")) / F.nullif(F.col(f"{s}.x1") - F.col(f"{s}.x0"), F.lit(0.0))
    sa, sb = slope("a"), slope("b")
    x = F.try_divide(F.col("b.y0") - F.col("a.y0") + sa * F.col("a.x0") - sb * F.col("b.x0"), sa - sb)
    pairs = a.join(b, reduce(lambda p, q: p & q, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in where]) & meet)
    crossing = pairs.select(*(F.col(f"a.{c}").alias(c) for c in where), F.col("a.left").alias("left"), F.col("a.right").alias("right"), x.alias("x"), F.greatest("a.x0", "b.x0").alias("lo"), F.least("a.x1", "b.x1").alias("hi"))
    crossing = crossing.where((F.col("x") > F.col("lo")) & (F.col("x") < F.col("hi"))).select(*where, "left", "right", "x")
    events = edge.select(*where, "left", "right", F.explode(F.array("x0", "x1", "left", "right")).alias("x")).unionByName(crossing)
    events = events.where((F.col("x") >= F.col("left")) & (F.col("x") <= F.col("right"))).select(*where, "x").distinct()
    slab = events.withColumn("xr", F.lead("x").over(Window.partitionBy(*where).orderBy("x"))).where(F.col("xr").isNotNull()).withColumnRenamed("x", "xl")
    # each polygon's lower and upper line in each slab it spans
    at = lambda s: F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(s) - F.col("x0")) / (F.col("x1") - F.col("x0"))
    spans = slab.join(edge.where("x1 > x0"), where).where((F.col("x0") <= F.col("xl")) & (F.col("x1") >= F.col("xr")))
    spans = spans.select(group, "xl", "xr", "poly", at("xl").alias("yl"), at("xr").alias("yr")).withColumn("ym", (F.col("yl") + F.col("yr")) / 2)
    order = F.row_number().over(Window.partitionBy(group, "xl", "poly").orderBy("ym"))
    spans = spans.withColumn("k", F.floor((order - 1) / 2))  # a concave polygon has more than one part in a slab
    iv = spans.groupBy(group, "xl", "xr", "poly", "k").agg(F.min_by(F.struct("yl", "yr", "ym"), "ym").alias("lo"), F.max_by(F.struct("yl", "yr", "ym"), "ym").alias("hi"))
    w = Window.partitionBy(group, "xl").orderBy("lo.ym", "hi.ym")
    reach = F.max("hi.ym").over(w.rowsBetween(Window.unboundedPreceding, -1))
    iv = iv.withColumn("new", (reach.isNull() | (F.col("lo.ym") > reach + tol)).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = iv.groupBy(group, "xl", "xr", "run").agg(F.min_by("lo", "lo.ym").alias("lo"), F.max_by("hi", "hi.ym").alias("hi"))
    return runs.select(group, "xl", "xr", "lo", "hi", F.monotonically_increasing_id().alias("rid"))


def _boundary(runs: DataFrame, group: str, tol: float) -> DataFrame:
    """(group, eid, f, t): directed edges between nodes (x, node, y), inside on the left. Heights nearer than ``tol`` at one x are one node."""
    end = lambda i, x, y, left, right: F.struct(F.lit(i).alias("at"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(left).alias("dl"), F.lit(right).alias("dr"))
    ends = F.array(end(0, "xl", "lo.yl", 0, 1), end(1, "xl", "hi.yl", 0, -1), end(2, "xr", "lo.yr", 1, 0), end(3, "xr", "hi.yr", -1, 0))
    ends = runs.select(group, "rid", F.explode(ends).alias("e")).select(group, "rid", "e.*")
    w = Window.partitionBy(group, "x").orderBy("y")
    ends = ends.withColumn("new", F.coalesce(F.col("y") - F.lag("y").over(w) > tol, F.lit(True)).cast("int"))
    ends = written(ends.withColumn("node", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new"), "ends", plain=True)
    point = F.struct("x", "node", "y")
    corner = [F.max(F.when(F.col("at") == i, point)).alias(f"p{i}") for i in range(4)]
    sides = ends.groupBy(group, "rid").agg(*corner).where((F.col("p0.node") != F.col("p1.node")) | (F.col("p2.node") != F.col("p3.node")))
    lines = sides.select(group, F.explode(F.array(F.struct(F.col("p0").alias("f"), F.col("p2").alias("t")), F.struct(F.col("p3").alias("f"), F.col("p1").alias("t")))).alias("e")).select(group, "e.*")
    w = Window.partitionBy(group, "x").orderBy("node")
    nodes = ends.groupBy(group, "x", "node").agg(F.min("y").alias("y"), F.sum("dl").alias("dl"), F.sum("dr").alias("dr"))
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.select(group, point.alias("p"), F.lead(point).over(w).alias("q"), (F.sum("dl").over(up_to) > 0).alias("cl"), (F.sum("dr").over(up_to) > 0).alias("cr"))
    nodes = nodes.where(F.col("q").isNotNull() & (F.col("cl") != F.col("cr")))
    upright = nodes.select(group, F.when(F.col("cl"), F.col("p")).otherwise(F.col("q")).alias("f"), F.when(F.col("cl"), F.col("q")).otherwise(F.col("p")).alias("t"))
    return written(lines.unionByName(upright).withColumn("eid", F.monotonically_increasing_id()), "boundary", [ends], plain=True)


def _angle(p: str, q: str) -> Column:
    return F.atan2(F.col(f"{q}.y") - F.col(f"{p}.y"), F.col(f"{q}.x") - F.col(f"{p}.x"))


def _followers(edges: DataFrame, group: str) -> DataFrame:
    """``edges`` with ``next``: at its end, the first outgoing edge counter-clockwise from the way back, which goes around the outside."""
    e, o = edges.alias("e"), edges.alias("o")
    same = (F.col(f"e.{group}") == F.col(f"o.{group}")) & (F.col("e.t.x") == F.col("o.f.x")) & (F.col("e.t.node") == F.col("o.f.node"))
    turn = F.pmod(_angle("o.f", "o.t") - _angle("e.t", "e.f"), F.lit(2 * 3.141592653589793))
    turn = F.when(turn < 1e-12, 7.0).otherwise(turn)
    follow = e.join(o, same).groupBy(F.col("e.eid").alias("eid")).agg(F.min_by(F.col("o.eid"), turn).alias("next"))
    return edges.join(follow, "eid")


def _jump(state: DataFrame, label: str, join) -> DataFrame:
    """One step of pointer doubling: ``next`` of ``next``, with ``label`` joined by ``join``; where ``next`` is null the row is done and does not join."""
    other = state.select(F.col("eid").alias("next"), F.col("next").alias("_next"), F.col(label).alias("_label"))
    out = state.where(F.col("next").isNotNull()).join(other, "next").withColumn(label, join(F.col(label), F.col("_label")))
    return out.select(*[F.col("_next").alias("next") if c == "next" else F.col(c) for c in state.columns]).unionByName(state.where(F.col("next").isNull()))


def _outer(edges: DataFrame, group: str) -> DataFrame:
    """(group, eid, next, left): for the edges of each group's outer ring next is null and left how many are left to its end; other rings' have a next."""
    first = F.struct(F.col("f.x").alias("x"), F.col("f.node").alias("node"), _angle("f", "t").alias("angle"), F.col("eid"))
    heads = edges.groupBy(group).agg(F.min(first)["eid"].alias("head"))
    state = edges.join(heads, group).select(group, "eid", F.when(F.col("next") != F.col("head"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("left"))
    state, done = written(state, "ring", plain=True), -1
    while True:
        now = state.where(F.col("next").isNull()).count()
        if now == done:
            break
        done = now
        state = written(_jump(state, "left", lambda a, b: a + b), "ring", [state], plain=True)
    return state


def _other_rings(edges: DataFrame, others: DataFrame, group: str, tol: float) -> DataFrame:
    """(group, holes, pieces): rings beside the outer one, by the sign of their area; a table."""
    rest = written(edges.join(others, "eid", "left_semi"), "others", plain=True)
    labels, before = rest.select("eid", "next", F.col("eid").alias("label")), None
    for _ in range(64):
        now = labels.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            break
        before, labels = now, written(_jump(labels, "label", F.least), "labels", [labels], plain=True)
    corner = rest.groupBy(group).agg(F.min("f.x").alias("ox"), F.min("f.y").alias("oy"))
    x = lambda p: F.col(f"{p}.x") - F.col("ox")
    y = lambda p: F.col(f"{p}.y") - F.col("oy")
    rings = rest.join(labels.select("eid", "label"), "eid").join(corner, group).groupBy(group, "label").agg((F.sum(x("f") * y("t") - x("t") * y("f")) / 2).alias("area"))
    return written(rings.groupBy(group).agg(F.count_if(F.col("area") < -tol * tol).alias("holes"), F.count_if(F.col("area") > tol * tol).alias("pieces")), "other_rings", [rest, labels], plain=True)


def _tidy(v: Column, tol: float) -> Column:
    """A ring without points nearer than ``tol`` to the one before or to the line between its neighbours."""
    far = lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))
    around = lambda v, i: (F.get(v, (i + F.size(v) - 1) % F.size(v)), F.get(v, (i + 1) % F.size(v)))
    apart = let(v, lambda v: F.filter(v, lambda p, i: far(p, around(v, i)[0]) > tol))
    return let(apart, lambda v: F.filter(v, lambda p, i: F.abs(polygon.cross(around(v, i)[0], p, around(v, i)[1])) > tol * far(*around(v, i))))


def union_outline(fps: DataFrame, group: str, strip: float = 0.05, tol: float = 1e-10, one_piece: bool = True) -> DataFrame:
    """(group, area, cx, cy, vertices, pieces, holes) of the union of each group's footprints: its outer ring, counter-clockwise from the
    lowest leftmost vertex, with holes filled; area and centroid are the ring's.

    A union of more than one piece (pieces that only touch at a point are apart) is an error, or, with ``one_piece=False``, has
    null for area, centre and vertices. ``strip`` is the width of the strips, about a footprint's; ``tol`` the distance below which
    points are one. Footprints are simple polygons; rows without vertices are left out; an empty table gives an empty result.
    """
    fps = fps.where(F.size("vertices") > 2).select(group, "vertices")
    cut = written(_edges(fps, group, strip), "edges", plain=True)
    runs = written(_runs(cut, group, tol), "runs", [cut], plain=True)
    boundary = _boundary(runs, group, tol)
    edges = written(_followers(boundary, group), "followed", [boundary, runs], plain=True)
    state = _outer(edges, group)
    rings = _other_rings(edges, state.where(F.col("next").isNotNull()).select("eid"), group, tol)
    ring = edges.join(state.where(F.col("next").isNull()).select("eid", "left"), "eid")
    # a ring that passes a point twice goes around pieces that touch there
    twice = ring.groupBy(group, "f.x", "f.node").agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.sum(F.col("n") - 1).alias("pinched"))
    vertices = ring.groupBy(group).agg(F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("place"), F.col("f.x").alias("x"), F.col("f.y").alias("y")))).alias("v"))
    vertices = vertices.select(group, _tidy(F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), tol).alias("vertices"))
    zero = F.lit(0).cast("long")
    out = vertices.join(twice, group).join(rings, group, "left")
    out = out.select(group, "vertices", (1 + F.coalesce("pieces", zero) + F.col("pinched")).alias("pieces"), F.coalesce("holes", zero).alias("holes"))
    one = F.col("pieces") == 1
    if one_piece:
        out = out.withColumn("pieces", checked(F.col("pieces"), one, "the union of a group is not one piece; pieces"))
    out = out.withColumn("vertices", F.when(one, F.col("vertices"))).withColumn("c", polygon.centroid(F.col("vertices")))
    out = out.select(group, polygon.area(F.col("vertices")).alias("area"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), "vertices", "pieces", "holes")
    return written(out, "outlines", [edges, state, rings], plain=True)
