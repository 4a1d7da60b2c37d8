"""Spatial joins over footprints (``vertices``: array of x, y structs, in degrees)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygon
from ..functions.columns import all_of, let
from ..scratch import spread, written
from .order import numbered


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def with_bounds(fps: DataFrame) -> DataFrame:
    return fps.withColumn("bb", polygon.bounds(F.col("vertices")))


def gridded(fps: DataFrame, cell: float) -> DataFrame:
    """A row for each grid cell that a footprint's bounding box touches (columns gx, gy)."""
    out = fps if "bb" in fps.columns else with_bounds(fps)
    return out.withColumn("gx", F.explode(_cells(F.col("bb.x0"), F.col("bb.x1"), cell))).withColumn("gy", F.explode(_cells(F.col("bb.y0"), F.col("bb.y1"), cell)))


LEAF = ["_sx", "_sy", "_li", "_ri"]


def leaves(left: DataFrame, right: DataFrame, on: list[str], cell: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on grid cells (rows with ``on``, which holds gx and gy, and bb) with the leaf of the cell that each row goes to, in LEAF.

    A cell in which both sides have many rows is divided into sub-cells, as long as these are no smaller than the boxes in it, so that
    the rows of one have fewer to meet. A sub-cell that still has more than ``most`` rows of a side is dealt: a side's rows are numbered off
    into parts of about ``most``, and each part meets each part of the other side in a leaf of its own. No leaf has many more rows
    than ``most`` of either side, and two rows of a sub-cell meet exactly once.
    """
    width = F.greatest(F.col("bb.x1") - F.col("bb.x0"), F.col("bb.y1") - F.col("bb.y0"))

    def counted(own: list[str], *sides: DataFrame) -> DataFrame:
        rows = [side.select(*own, width.alias("w"), F.lit(1 - i).alias("l"), F.lit(i).alias("r")) for i, side in enumerate(sides)]
        return rows[0].unionByName(rows[1]).groupBy(*own).agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.avg("w").alias("w"))

    hot = counted(on, left, right).where((F.col("l") > most) | (F.col("r") > most)).where((F.col("l") > 0) & (F.col("r") > 0))
    wanted = F.ceil(F.sqrt(F.greatest("l", "r") / most))
    parts = F.greatest(F.least(wanted, F.floor(F.lit(cell) / F.greatest("w", F.lit(cell / 1024)))), F.lit(1)).cast("long")
    hot = written(hot.select(*on, parts.alias("_parts")), "hot_cells", plain=True)  # a row for each cell with over ``most`` rows

    def divided(side: DataFrame) -> DataFrame:
        side = side.join(hot, on, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long")))
        sub = lambda c, g: sub_cell(F.col(f"bb.{c}"), F.col(g), cell)
        spread = lambda axis: F.explode(F.sequence(sub(f"{axis}0", f"g{axis}"), sub(f"{axis}1", f"g{axis}")))
        return side.withColumn("_sx", spread("x")).withColumn("_sy", spread("y"))

    left, right = divided(left), divided(right)
    own = [*on, "_sx", "_sy"]
    deal = counted(own, left, right).where((F.col("l") > 0) & (F.col("r") > 0)).where((F.col("l") > most) | (F.col("r") > most))
    deal = written(deal.select(*own, F.ceil(F.col("l") / most).cast("long").alias("_kl"), F.ceil(F.col("r") / most).cast("long").alias("_kr")), "dealt_cells", plain=True)

    def numbered_off(side: DataFrame, mine: str, mine_k: str, others: str, others_k: str) -> DataFrame:
        one, row = F.lit(1).cast("long"), F.xxhash64(*side.columns)  # by content: a task that runs again deals alike
        side = side.withColumn("_row", row).join(deal, own, "left").withColumns({"_kl": F.coalesce("_kl", one), "_kr": F.coalesce("_kr", one)})
        side = side.withColumn(mine, F.pmod(F.col("_row"), F.col(mine_k)))
        return side.withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others_k) - 1))).drop("_kl", "_kr", "_row")

    return numbered_off(left, "_li", "_kl", "_ri", "_kr"), numbered_off(right, "_ri", "_kr", "_li", "_kl").drop("_parts")


def sub_cell(at: Column, g: Column, cell: float) -> Column:
    """Which of a cell's ``_parts`` holds a coordinate; what lies beyond the cell counts to its ends."""
    return F.least(F.greatest(F.floor((at / cell - g) * F.col("_parts")), F.lit(0)), F.col("_parts") - 1)


def overlap_pairs(fps: DataFrame, key: str = "fp_id", same: tuple[str, ...] = (), min_fraction: float = 0.6, cell: float = 0.05, most: int = 1000) -> DataFrame:
    """Unordered pairs of footprints that share at least ``min_fraction`` of the smaller: (a, b, inter_area, fraction).

    Boxes meet in grid cells by an equi-join; a pair counts only in the cell of the lower left corner of
    its common box, so none comes twice. Attributes in ``same`` are join keys, not filters. Cells with more than ``most`` footprints are
    split (``leaves``), so that a crowded field is dealt over tasks.
    """
    if min_fraction <= 0:
        raise ValueError("min_fraction must be positive")
    # what a footprint says of itself is computed once for each, before the cells
    facts = with_bounds(fps.select(key, "vertices", *same).repartition(key)).withColumn("v", polygon.oriented(F.col("vertices")))
    facts = facts.select(key, *same, "bb", F.struct("v", polygon.convex(F.col("v")).alias("convex"), polygon.area(F.col("v")).alias("area")).alias("q"))
    g, on = written(gridded(facts, cell), "gridded", plain=True), ["gx", "gy", *same]
    left, right = leaves(g, g, on, cell, most)
    left = left.select(*on, *LEAF, "_parts", F.col(key).alias("a"), F.col("q").alias("qa"), F.col("bb").alias("ba"))
    right = right.select(*on, *LEAF, F.col(key).alias("b"), F.col("q").alias("qb"), F.col("bb").alias("b_"))
    meet = (F.col("a") < F.col("b")) & (F.greatest("ba.x0", "b_.x0") <= F.least("ba.x1", "b_.x1")) & (F.greatest("ba.y0", "b_.y0") <= F.least("ba.y1", "b_.y1"))
    x, y = F.greatest("ba.x0", "b_.x0"), F.greatest("ba.y0", "b_.y0")
    home = (F.floor(x / cell) == F.col("gx")) & (F.floor(y / cell) == F.col("gy")) & (sub_cell(x, F.col("gx"), cell) == F.col("_sx")) & (sub_cell(y, F.col("gy"), cell) == F.col("_sy"))
    # the shared area is no larger than that of the common box
    common = (F.least("ba.x1", "b_.x1") - F.greatest("ba.x0", "b_.x0")) * (F.least("ba.y1", "b_.y1") - F.greatest("ba.y0", "b_.y0"))
    enough = common * (1 + 1e-9) >= min_fraction * F.least("qa.area", "qb.area")
    left, right = spread(g.count(), [*on, *LEAF], left, right)
    pairs = left.join(right, [*on, *LEAF]).where(meet & home & enough)
    inter = polygon.oriented_intersection(F.col("qa.v"), F.col("qb.v"), F.col("qa.convex") & F.col("qb.convex"))
    shared = let(inter, lambda i: F.struct(i.alias("inter_area"), F.greatest(i / F.col("qa.area"), i / F.col("qb.area")).alias("fraction")))
    # the generator keeps the planner from copying the geometry into the filter
    hit = F.filter(F.array(shared), lambda s: s["fraction"] >= min_fraction)
    return pairs.select("a", "b", F.inline(hit))


def same_pointing(a: Column, b: Column, min_fraction: float = 0.6) -> Column:
    return polygon.overlap_fraction(a, b) >= min_fraction


def search(fps: DataFrame, targets: DataFrame, same: tuple[str, ...] = (), min_fraction: float = 0.6, key: str = "fp_id", cell: float = 0.05, must_find: bool = False, most: int = 1000) -> DataFrame:
    """Footprints at the pointing of each of ``targets`` (rows with ``key``, vertices, and the attributes in ``same``): the columns of
    ``fps``, target (the target's key) and fraction.

    Boxes meet in grid cells, crowded ones split, as in ``overlap_pairs``; a footprint that is a target itself is found too. With ``must_find``
    it is an error if nothing is found.
    """
    if min_fraction <= 0:
        raise ValueError("min_fraction must be positive")
    on = ["gx", "gy", *same]
    left, right = (written(gridded(side, cell), "gridded", plain=True) for side in (fps.repartition(key), targets.select(key, "vertices", *same)))
    rows = left.count()
    left, right = leaves(left, right, on, cell, most)
    t = right.select(*on, *LEAF, F.col(key).alias("target"), F.col("vertices").alias("tv"), F.col("bb").alias("tb"))
    x, y = F.greatest("bb.x0", "tb.x0"), F.greatest("bb.y0", "tb.y0")
    near = (x <= F.least("bb.x1", "tb.x1")) & (y <= F.least("bb.y1", "tb.y1"))
    home = (F.floor(x / cell) == F.col("gx")) & (F.floor(y / cell) == F.col("gy")) & (sub_cell(x, F.col("gx"), cell) == F.col("_sx")) & (sub_cell(y, F.col("gy"), cell) == F.col("_sy"))
    left, t = spread(rows, [*on, *LEAF], left, t)
    hit = left.join(t, [*on, *LEAF]).where(near & home).withColumn("fraction", polygon.overlap_fraction(F.col("vertices"), F.col("tv")))
    hit = hit.where(F.col("fraction") >= min_fraction).select(*fps.columns, "target", "fraction")
    if must_find and hit.isEmpty():
        raise ValueError("no footprint is at the pointing of any target")
    return hit


def points_in_footprints(points: DataFrame, fps: DataFrame, x: str = "ra", y: str = "dec", cell: float = 0.05, most: int = 10_000) -> DataFrame:
    """Points with each footprint that strictly contains them; a point has one cell, so no pair comes twice. Crowded cells are split (``leaves``)."""
    p = points.withColumn("gx", F.floor(F.col(x) / cell)).withColumn("gy", F.floor(F.col(y) / cell))
    v, p_ = F.col("_v"), polygon.point(F.col(x), F.col(y))
    # convex quadrilaterals, the common ones, have their corners as columns: four comparisons for a pair
    g = gridded(fps, cell).withColumn("_v", polygon.oriented(F.col("vertices"))).withColumn("_quad", F.coalesce((F.size("_v") == 4) & polygon.convex(v), F.lit(False)))
    g = g.withColumns({f"_p{i}": F.get(v, F.lit(i)) for i in range(4)})
    inside = F.when(F.col("_quad"), all_of([polygon.cross(F.col(f"_p{i}"), F.col(f"_p{(i + 1) % 4}"), p_) > 0 for i in range(4)])).otherwise(polygon.contains(F.col("vertices"), F.col(x), F.col(y)))
    box = F.col(x).between(F.col("bb.x0"), F.col("bb.x1")) & F.col(y).between(F.col("bb.y0"), F.col("bb.y1"))
    on = ["gx", "gy"]
    at = F.struct(F.col(x).alias("x0"), F.col(y).alias("y0"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    p, g = leaves(p.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bb", at), written(g, "gridded", plain=True), on, cell, most)
    return p.drop("bb", "_parts").join(g, [*on, *LEAF]).where(box & inside).drop(*on, *LEAF, "bb", "vertices", "_v", "_quad", "_p0", "_p1", "_p2", "_p3")


def _spread(v: Column) -> Column:
    """The low 30 bits of a long with a free bit between each two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def curve(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Place along the Z-order curve over ``box`` (x0, y0, x1, y1); what lies outside counts to its border."""
    steps = (1 << 30) - 1
    at = lambda c, lo, hi: F.floor(F.greatest(F.least((c - lo) / ((hi - lo) or 1.0), F.lit(1.0)), F.lit(0.0)) * steps).cast("long")
    return _spread(at(x, box[0], box[2])).bitwiseOR(F.shiftleft(_spread(at(y, box[1], box[3])), 1))


def nearest_footprint(points: DataFrame, fps: DataFrame, id_: str = "id", x: str = "ra", y: str = "dec", key: str = "fp_id", leaf: int = 256, most_leaves: int = 65_536, most_points: int = 50_000) -> DataFrame:
    """Each point with the footprint whose centre is nearest by planar squared distance; ties by the least key.

    Centres are cut along a space-filling curve into leaves of equal numbers of them (``leaf``, or as many more as keep it to
    ``most_leaves``), so that leaves are small where centres are dense. In a first pass a point asks the leaf at its own place on
    the curve; its best there is a bound. The leaves' boxes, at most ``most_leaves`` of them, say which others can hold a centre within that bound, and these
    are asked in the second pass, which answers where it finds none farther; a point that has none to ask is done. Points of a crowded leaf are dealt over several tasks, repeated ones to the same, which
    keeps one of them. Points with a null id or coordinate have no footprint; without footprints there are answers for such points only.
    """
    left = points.select(F.col(id_).alias("_id"), *((F.col(v).cast("double") + 0.0).alias(a) for v, a in ((x, "_x"), (y, "_y"))))  # -0.0 is 0.0
    placed = F.col("_id").isNotNull() & F.col("_x").isNotNull() & F.col("_y").isNotNull()
    kind, id_kind = fps.schema[key].dataType.simpleString(), points.schema[id_].dataType.simpleString()
    answers = left.where(~placed).distinct().select(F.col("_id").alias(id_), F.col("_x").alias(x), F.col("_y").alias(y), F.lit(None).cast(kind).alias(key), F.lit(None).cast("double").alias("d2"))
    # small files hold many footprints: they are dealt before the geometry, and a centre is computed once, not for each use of its parts
    c = written(fps.select(F.col(key).alias("_key"), "vertices").repartition("_key").select("_key", polygon.centroid(F.col("vertices")).alias("c")), "centres", plain=True)
    kept = c
    c = c.select("_key", F.col("c.x").alias("cx"), F.col("c.y").alias("cy")).where("cx is not null and cy is not null")
    n, bx, by, bx1, by1 = c.agg(F.count(F.lit(1)), F.min("cx"), F.min("cy"), F.max("cx"), F.max("cy")).first()
    if not n:
        return answers
    side = max(bx1 - bx, by1 - by)
    box = (bx, by, bx + side, by + side)  # a square, as leaves of a long box would be as long and border on more points
    size = max(leaf, -(-n // most_leaves))
    c = numbered(c.withColumn("z", curve(F.col("cx"), F.col("cy"), box)), "z", "_key")
    c = written(c.withColumn("leaf", F.floor(F.col("ord") / size).cast("long")).drop("ord"), "leaves", [kept], plain=True)
    edges = c.groupBy("leaf").agg(F.min("z").alias("z"), *(f(v).alias(a) for v in ("cx", "cy") for f, a in ((F.min, f"{v}0"), (F.max, f"{v}1")))).orderBy("leaf").toArrow()  # ``most_leaves`` rows at most
    first, x0, x1, y0, y1 = (edges.column(i).to_numpy() for i in range(1, 6))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.searchsorted(first, batch.column(3).to_numpy(), "right") - 1, 0, None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at.astype(np.int64))], ["_id", "_x", "_y", "leaf"])

    todo = left.where(placed).select("_id", "_x", "_y", curve(F.col("_x"), F.col("_y"), box).alias("z"))
    todo = written(todo.mapInArrow(home, f"_id {id_kind}, _x double, _y double, leaf long"), "points", plain=True)

    def best_in(p: pa.Table, t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Least squared distance of each point to a leaf's centres, and which; centres are in the order of their keys."""
        px, py, cx, cy = (v.to_numpy() for v in (p.column("_x"), p.column("_y"), t.column("cx"), t.column("cy")))
        d, at = np.empty(len(px)), np.empty(len(px), np.int64)
        rows = max(1, (1 << 20) // len(cx))
        for lo in range(0, len(px), rows):
            s = slice(lo, lo + rows)
            d2 = (cx[None, :] - px[s, None]) ** 2 + (cy[None, :] - py[s, None]) ** 2
            at[s] = d2.argmin(axis=1)
            d[s] = d2[np.arange(len(d2)), at[s]]
        return d, at

    def ask(p: pa.Table, t: pa.Table, others: bool) -> pa.Table:
        if not p.num_rows or not t.num_rows:
            return p.slice(0, 0).select(["_id", "_x", "_y"]).append_column("_key", pa.array([], t.schema.field("_key").type)).append_column("d2", pa.array([], pa.float64())).append_column("ask", pa.array([], pa.list_(pa.int64())))
        t = t.sort_by("_key")
        if others:
            p = p.group_by(["_id", "_x", "_y", "leaf"]).aggregate([])  # one of each repeated point
        d, at = best_in(p, t)
        if not others:
            better = d <= p.column("bound").to_numpy()
            p, d, at = p.filter(pa.array(better)), d[better], at[better]
        counts, asked = np.zeros(len(d), np.int64), []
        if others:
            px, py, own = p.column("_x").to_numpy(), p.column("_y").to_numpy(), p.column("leaf")[0].as_py()
            for s in (slice(i, i + 256) for i in range(0, len(d), 256)):
                gap = lambda lo, hi, a, b: np.maximum(np.maximum(lo - b, a - hi), 0)
                far = np.sqrt(d[s].max()) * (1 + 1e-9)
                near = np.flatnonzero((gap(x0, x1, px[s].min(), px[s].max()) <= far) & (gap(y0, y1, py[s].min(), py[s].max()) <= far))
                near = near[near != own]
                d2 = gap(x0[near], x1[near], px[s, None], px[s, None]) ** 2 + gap(y0[near], y1[near], py[s, None], py[s, None]) ** 2
                row, col = np.nonzero(d2 <= d[s, None] * (1 + 1e-9))
                counts[s] = np.bincount(row, minlength=len(d2))
                asked.append(near[col])
        out = p.select(["_id", "_x", "_y"]).append_column("_key", t.column("_key").take(pa.array(at)))
        ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
        return out.append_column("d2", pa.array(d)).append_column("ask", pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *asked]))))

    schema = f"_id {id_kind}, _x double, _y double, _key {kind}, d2 double, ask array<long>"

    def passed(asking: DataFrame, others: bool) -> DataFrame:
        parts = written(asking.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / most_points).cast("long").alias("_k")), "leaf_parts", plain=True)
        own = asking.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("_id", "_x", "_y"), F.col("_k"))).drop("_k")
        centres = c.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))).select("leaf", "part", "_key", "cx", "cy")
        return own.groupBy("leaf", "part").cogroup(centres.groupBy("leaf", "part")).applyInArrow(lambda p, t: ask(p, t, others), schema)

    one = written(passed(todo, True), "first_pass", [todo], plain=True)
    two = passed(one.select("_id", "_x", "_y", F.col("d2").alias("bound"), F.explode("ask").alias("leaf")), False)
    best = one.where(F.size("ask") > 0).unionByName(two).groupBy("_id", "_x", "_y").agg(F.min(F.struct("d2", "_key")).alias("b"))
    best = best.unionByName(one.where(F.size("ask") == 0).select("_id", "_x", "_y", F.struct("d2", "_key").alias("b")))
    best = written(best, "nearest", [one, c], plain=True)
    return answers.unionByName(best.select(F.col("_id").alias(id_), F.col("_x").alias(x), F.col("_y").alias(y), F.col("b._key").alias(key), F.col("b.d2").alias("d2")))


def near_pairs(points: DataFrame, eps: float = 0.1, key: str = "id", x: str = "ra", y: str = "dec") -> DataFrame:
    """Pairs a < b with a great-circle separation over 0 and under ``eps`` degrees: declination bands, then right ascension cells.

    Cells are as wide as two points of the band or its neighbours can lie apart in right ascension, for any declination (beyond 90 degrees, too).
    """
    band = F.floor(F.col(y) / eps)
    p = points.select(F.col(key).alias("k"), F.col(x).alias("px"), F.col(y).alias("py"), band.alias("band"))
    p = written(p.repartition("k"), "places", plain=True)
    l = p.select(F.col("k").alias("a"), F.col("px").alias("ax"), F.col("py").alias("ay"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    r = p.select(F.col("k").alias("b"), F.col("px").alias("bx"), F.col("py").alias("by"), "band")
    # sin(eps / 2) >= |cos(dec)| sin(d / 2) for a distance d in right ascension; a band that touches a pole is one cell; cells wrap at 360
    lo, hi = (F.col("band") - 1) * eps, (F.col("band") + 2) * eps
    pole = F.floor((lo - 90) / 180) != F.floor((hi - 90) / 180)
    least = F.when(pole, 0.0).otherwise(F.least(F.abs(F.cos(F.radians(lo))), F.abs(F.cos(F.radians(hi)))))
    half = math.sin(math.radians(eps / 2)) * (1 + 1e-9)
    n = F.when(least > half, F.greatest(F.floor(180.0 / F.degrees(F.asin(F.lit(half) / least))), F.lit(1))).otherwise(F.lit(1))
    cell = lambda c: F.floor(F.pmod(c, F.lit(360.0)) * n / 360.0)
    l = l.withColumn("n", n).withColumn("gx", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.pmod(cell(F.col("ax")) + o, F.col("n"))))))
    r = r.withColumn("gx", cell(F.col("bx")))
    sep = separation(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return l.join(r, ["band", "gx"]).where(F.col("a") < F.col("b")).withColumn("separation", sep).where((F.col("separation") > 0) & (F.col("separation") < eps)).select("a", "b", "separation")


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees."""
    c = F.sin(F.radians(dec1)) * F.sin(F.radians(dec2)) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.cos(F.radians(ra1 - ra2))
    return F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))))


def vertex_rows(fps: DataFrame, key: str = "fp_id") -> DataFrame:
    """Closed rings for display: a row per vertex, the first again at the end, with its text."""
    ring = fps.select(key, F.posexplode(polygon.closed_ring(F.col("vertices"))).alias("pos", "v"))
    return ring.select(key, "pos", F.col("v.x").alias("x"), F.col("v.y").alias("y"))


