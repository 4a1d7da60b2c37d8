import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfield.functions import polygon
from lumenfield.operators import pointing, spatial, wcs
from lumenfield.operators.graph import connected_components, extended_components
from lumenfield.scratch import written

TYPE = "array<struct<x:double,y:double>>"
SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]
BOWTIE = [(0, 0), (1, 1), (1, 0), (0, 1)]


def quads(spark, rows, names=("v",)):
    return spark.createDataFrame([tuple([(float(x), float(y)) for x, y in v] for v in r) for r in rows], ", ".join(f"{n} {TYPE}" for n in names))


def test_quad_validity(spark):
    v = F.col("v")
    df = quads(spark, [(SQUARE,), ([(0, 0), (1, 1), (1, 0)],), (BOWTIE,), ([(0, 0), (1, 0), (2, 0), (3, 0)],)])
    got = df.select(polygon.valid_quad(v).alias("a"), polygon.valid_quad(polygon.swap_middle(v)).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(True, False), (False, False), (False, True), (False, False)]


def box(a, b):
    return [(a, a), (b, a), (b, b), (a, b)]


def test_intersection_areas(spark):
    diamond = [(1, -1), (3, 1), (1, 3), (-1, 1)]
    dart = [(0, 0), (2, 1), (4, 0), (2, 4)]
    rows = [(box(0, 2), box(1, 3)), (box(0, 2), diamond), (box(0, 2), box(5, 6)), (box(0, 2)[::-1], box(1, 3)), (dart, [(-9, -9), (9, -9), (9, 9), (-9, 9)]), (dart, [(0, 0), (4, 0), (4, 1), (0, 1)])]
    got = [r[0] for r in quads(spark, rows, ("a", "b")).select(polygon.intersection_area(F.col("a"), F.col("b"))).collect()]
    assert got[:4] == pytest.approx([1, 4, 0, 1]) and got[4] == pytest.approx(6) and 0 < got[5] < 2


def test_random_overlaps_are_symmetric_and_bounded(spark):
    rng = random.Random(4)

    def turned():
        cx, cy, t, w, h = rng.random(), rng.random(), rng.random() * 7, 0.2 + rng.random(), 0.2 + rng.random()
        return [(cx + w * a * math.cos(t) - h * b * math.sin(t), cy + w * a * math.sin(t) + h * b * math.cos(t)) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]

    a, b = F.col("a"), F.col("b")
    df = quads(spark, [(turned(), turned()) for _ in range(60)], ("a", "b"))
    for r in df.select(polygon.intersection_area(a, b).alias("ab"), polygon.intersection_area(b, a).alias("ba"), F.least(polygon.area(a), polygon.area(b)).alias("m")).collect():
        assert r["ab"] == pytest.approx(r["ba"], abs=1e-9) and -1e-9 <= r["ab"] <= r["m"] + 1e-9


def test_contains_excludes_the_boundary(spark):
    df = quads(spark, [(box(0, 2),)])
    dart = quads(spark, [([(0, 0), (2, 1), (4, 0), (2, 4)],)])
    ask = lambda d, x, y: d.select(polygon.contains(F.col("v"), F.lit(float(x)), F.lit(float(y)))).first()[0]
    assert ask(df, 1, 1) and not ask(df, 0, 1) and not ask(df, 2, 2) and not ask(df, 3, 1)
    assert ask(dart, 2, 2) and not ask(dart, 2, 0.5) and not ask(dart, 2, 1)


def test_union_outlines(spark):
    groups = {"squares": [box(0, 2), box(1, 3)], "diamond": [box(0, 2), [(1, -1), (3, 1), (1, 3), (-1, 1)]], "one": [SQUARE]}
    df = spark.createDataFrame([(g, [(float(x), float(y)) for x, y in v]) for g, vs in groups.items() for v in vs], f"g string, vertices {TYPE}")
    got = {r["g"]: (r["area"], r["cx"], r["cy"]) for r in pointing.union_outline(df, "g").collect()}
    assert got["squares"] == pytest.approx((7, 1.5, 1.5)) and got["diamond"] == pytest.approx((8, 1, 1)) and got["one"] == pytest.approx((1, 0.5, 0.5))


def outlines(spark, groups, **options):
    df = spark.createDataFrame([(g, [(float(x), float(y)) for x, y in v]) for g, vs in groups.items() for v in vs], f"g string, vertices {TYPE}")
    return {r["g"]: r for r in pointing.union_outline(df, "g", **options).collect()}


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_outer_ring_fills_holes(spark):
    ring = [rect(0, 0, 3, 1), rect(0, 2, 3, 3), rect(0, 0, 1, 3), rect(2, 0, 3, 3)]
    cee = [rect(0, 0, 3, 1), rect(0, 2, 3, 3), rect(0, 0, 1, 3)]
    tip = [*ring[:3], [(2, 1), (3, 0.5), (3, 2.5)]]  # a triangle closes the ring
    turned = [[(x - y, x + y) for x, y in v] for v in ring]
    for strip in (0.37, 50.0):
        got = outlines(spark, {"ring": ring, "cee": cee, "turned": turned, "squares": [box(0, 2), box(1, 3)], "one": [SQUARE], "twice": [SQUARE, SQUARE[::-1]]}, strip=strip)
        at = lambda g: [(round(p["x"], 9), round(p["y"], 9)) for p in got[g]["vertices"]]
        assert at("ring") == rect(0, 0, 3, 3) and got["ring"]["area"] == pytest.approx(9) and got["ring"]["holes"] == 1
        assert (got["ring"]["cx"], got["ring"]["cy"]) == pytest.approx((1.5, 1.5))
        assert at("cee") == [(0, 0), (3, 0), (3, 1), (1, 1), (1, 2), (3, 2), (3, 3), (0, 3)] and got["cee"]["area"] == pytest.approx(7) and got["cee"]["holes"] == 0
        assert at("squares") == [(0, 0), (2, 0), (2, 1), (3, 1), (3, 3), (1, 3), (1, 2), (0, 2)]
        assert at("one") == at("twice") == rect(0, 0, 1, 1)
        assert len(at("turned")) == 4 and got["turned"]["area"] == pytest.approx(18) and got["turned"]["holes"] == 1
    assert outlines(spark, {"tip": tip}, strip=1.0)["tip"]["pieces"] == 1


def test_unions_of_several_pieces_are_errors(spark):
    apart = {"apart": [box(0, 2), box(3, 5)], "corner": [box(0, 1), box(1, 2)], "inside": [rect(0, 0, 5, 1), rect(0, 4, 5, 5), rect(0, 0, 1, 5), rect(4, 0, 5, 5), box(2, 3)]}
    with pytest.raises(Exception, match="not one piece"):
        outlines(spark, apart, strip=1.0)
    got = outlines(spark, apart | {"side": [rect(0, 0, 1, 1), rect(1, 0, 2, 1)]}, strip=1.0, one_piece=False)
    assert {g: (r["pieces"], r["area"], r["vertices"] is None) for g, r in got.items()} == {"apart": (2, None, True), "corner": (2, None, True), "inside": (2, None, True), "side": (1, pytest.approx(2), False)}
    assert got["inside"]["holes"] == 1 and [(p["x"], p["y"]) for p in got["side"]["vertices"]] == rect(0, 0, 2, 1)


def test_outlines_of_random_boxes_against_a_grid(spark):
    """Pieces, holes, area with holes filled and the vertices of the outer ring, from the cells of a grid."""
    rng, groups, want = random.Random(8), {}, {}
    for g in range(40):
        members = [rect(x, y, x + rng.randint(1, 6), y + rng.randint(1, 6)) for x, y in ((rng.randint(0, 8), rng.randint(0, 8)) for _ in range(rng.randint(2, 12)))]
        groups[str(g)] = members
        full = {(x, y) for v in members for x in range(v[0][0], v[2][0]) for y in range(v[0][1], v[2][1])}

        def parts(cells, steps):
            cells, n = set(cells), 0
            while cells:
                todo, n = [cells.pop()], n + 1
                while todo:
                    x, y = todo.pop()
                    for dx, dy in steps:
                        if (x + dx, y + dy) in cells:
                            cells.remove((x + dx, y + dy)), todo.append((x + dx, y + dy))
            return n

        four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
        empty = {(x, y) for x in range(-1, 16) for y in range(-1, 16)} - full
        outside, todo = {(-1, -1)}, [(-1, -1)]
        while todo:
            x, y = todo.pop()
            for dx, dy in four:
                if (x + dx, y + dy) in empty - outside:
                    outside.add((x + dx, y + dy)), todo.append((x + dx, y + dy))
        pieces, filled = parts(full, four), 17 * 17 - len(outside)
        corner = lambda x, y: [(x - a, y - b) in outside for a in (0, 1) for b in (0, 1)]  # noqa: B023, E731
        turns = {(x, y) for x in range(16) for y in range(16) if sum(corner(x, y)) in (1, 3) or corner(x, y) in ([True, False, False, True], [False, True, True, False])}
        want[str(g)] = (pieces, filled, turns) if pieces == 1 else (pieces, None, None)
    got = outlines(spark, groups, strip=2.5, one_piece=False)
    assert set(got) == set(want) and sum(w[0] == 1 for w in want.values()) > 9 and any(r["holes"] for r in got.values())
    for g, (pieces, filled, turns) in want.items():
        assert got[g]["pieces"] == pieces
        if pieces == 1:
            assert got[g]["area"] == pytest.approx(filled) and {(round(p["x"], 9), round(p["y"], 9)) for p in got[g]["vertices"]} == turns


def test_components_do_not_depend_on_order_or_partitions(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for c in range(40) for i in range(c * 100, c * 100 + rng.randrange(1, 30))] + [(9000 + i, 9000) for i in range(1, 300)]
    want = {}
    for a, b in edges:
        low = (a // 100) * 100 if a < 9000 else 9000
        want[a] = want[b] = low
    for parts in (1, 7):
        rng.shuffle(edges)
        df = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges], "src long, dst long").repartition(parts)
        assert {r["node"]: r["component"] for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).collect() == []


def test_a_forest_kept_up_to_date_equals_the_components_of_all_edges(spark):
    rng = random.Random(6)
    batches = [[(rng.randrange(300), rng.randrange(300)) for _ in range(60)] for _ in range(2)] + [[(299, 0), (5, 5), (None, 7)], []]
    forest, seen = spark.createDataFrame([], "node long, component long"), []
    for batch in batches:
        seen += batch
        forest = written(extended_components(forest, spark.createDataFrame(batch, "src long, dst long").repartition(3)))
        want = connected_components(spark.createDataFrame(seen, "src long, dst long"))
        assert sorted(map(tuple, forest.collect())) == sorted(map(tuple, want.collect()))


def crowded(rng, n, size):
    """A field with two thirds of all footprints, half of these in one spot of it; the others are spread."""
    out = []
    for i in range(n):
        x, y = (rng.uniform(0.0, 3.0), rng.uniform(-2, 2)) if i % 3 == 0 else (1.0 + rng.random() * 0.05, 0.5 + rng.random() * 0.05) if i % 3 == 1 else (1.02 + rng.random() * 0.002, 0.52 + rng.random() * 0.002)
        out.append((i, x, y, x + size * rng.uniform(0.5, 1), y + size * rng.uniform(0.5, 1)))
    return out


def test_crowded_cells_are_split_and_no_pair_is_lost(spark):
    rng = random.Random(11)
    for size, most in ((0.004, 10), (0.04, 25), (0.2, 40)):
        boxes = crowded(rng, 240, size)
        df = spark.createDataFrame([(i, "AB"[i % 7 == 0], rect(*b)) for i, *b in boxes], f"fp_id long, filter string, vertices {TYPE}").repartition(4)

        def share(a, b):
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            return 0 if w <= 0 or h <= 0 else w * h / min((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2]))

        alike = [(a[0], b[0]) for a in boxes for b in boxes if (a[0] % 7 == 0) == (b[0] % 7 == 0) and share(a, b) >= 0.3]
        got = [(r["a"], r["b"]) for r in spatial.overlap_pairs(df, same=("filter",), min_fraction=0.3, most=most).collect()]
        assert sorted(got) == sorted((a, b) for a, b in alike if a < b) and len(got) > 200
        found = [(r["target"], r["fp_id"]) for r in spatial.search(df, df.where("fp_id % 5 = 0"), ("filter",), 0.3, most=most).collect()]
        assert sorted(found) == sorted((a, b) for a, b in alike if a % 5 == 0)
        points = [(1000 + i, x + 1e-5, y + 1e-5) for i, x, y, *_ in boxes] + [(1, None, 0.0)]
        inside = [(r["id"], r["fp_id"]) for r in spatial.points_in_footprints(spark.createDataFrame(points, "id long, ra double, dec double"), df, most=most).collect()]
        assert sorted(inside) == sorted((k, b[0]) for k, x, y in points[:-1] for b in boxes if b[1] < x < b[3] and b[2] < y < b[4])


def test_leaves_of_a_crowded_field_are_even(spark):
    boxes = crowded(random.Random(3), 6000, 0.004)
    df = spark.createDataFrame([(i, rect(*b)) for i, *b in boxes], f"fp_id long, vertices {TYPE}")
    g = written(spatial.gridded(df, 0.05))
    sides = spatial.leaves(g, g, ["gx", "gy"], 0.05, 100)
    for side in sides:
        n = side.groupBy("gx", "gy", *spatial.LEAF).count()
        assert n.agg(F.max("count")).first()[0] <= 200 < 2000 < g.groupBy("gx", "gy").count().agg(F.max("count")).first()[0]
    # as tasks get them: leaves by hash over 16 partitions
    at = ["gx", "gy", *spatial.LEAF]
    count = lambda s, name: s.groupBy(*at).agg(F.count(F.lit(1)).alias(name))
    tasks = count(sides[0], "l").join(count(sides[1], "r"), at).repartition(16, *at).groupBy(F.spark_partition_id()).agg(F.sum(F.col("l") * F.col("r")).alias("n"))
    work = sorted(r["n"] for r in tasks.collect())
    assert len(work) == 16 and work[-1] < 4 * work[8]


def test_nearest_footprint_against_brute_force(spark):
    rng = random.Random(2)
    fps = [(i, rng.uniform(0, 3), rng.uniform(-2, 2)) for i in range(40)]
    pts = [(i, rng.uniform(-5, 9), rng.uniform(-5, 5)) for i in range(200)]
    f = spark.createDataFrame([(i, [(x + dx, y + dy) for dx, dy in ((-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1))]) for i, x, y in fps], f"fp_id long, vertices {TYPE}")
    p = spark.createDataFrame(pts, "id long, ra double, dec double")
    got = {r["id"]: r["d2"] for r in spatial.nearest_footprint(p, f).collect()}
    assert got == pytest.approx({i: min((x - a) ** 2 + (y - b) ** 2 for _, a, b in fps) for i, x, y in pts})


def test_nearest_over_uneven_densities_and_ties(spark):
    """Two dense clusters, a sparse rest, coincident centres, points far outside and in the voids; small leaves, dealt points."""
    rng = random.Random(7)
    fps = [(i, *((rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) if i % 3 == 0 else (5 + rng.gauss(0, 1e-4), 5.0) if i % 3 == 1 else (rng.uniform(-20, 20), rng.uniform(-20, 20)))) for i in range(300)] + [(900 + i, 1.0, 1.0) for i in range(40)]
    pts = [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(150)] + [(200 + i, rng.gauss(0, 2e-3), rng.gauss(0, 2e-3)) for i in range(150)] + [(500, 1.0, 1.0), (501, 1e3, -1e3), (501, 1e3, -1e3), (502, None, 1.0)]
    f = spark.createDataFrame([(f"k{i:04d}", [(x + dx, y + dy) for dx, dy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))]) for i, x, y in fps], f"fp_id string, vertices {TYPE}").repartition(5)
    p = spark.createDataFrame(pts, "id long, ra double, dec double").repartition(3)
    centre = {r["fp_id"]: tuple(r["c"]) for r in f.select("fp_id", polygon.centroid(F.col("vertices")).alias("c")).collect()}
    for options in ({"leaf": 8, "most_points": 40}, {"leaf": 3, "most_leaves": 20}, {}):
        got = {r["id"]: (r["fp_id"], r["d2"]) for r in spatial.nearest_footprint(p, f, **options).collect()}
        assert set(got) == {i for i, *_ in pts} and got[502] == (None, None) and got[500][0] == "k0900"
        for i, x, y in pts[:-1]:
            d, k = min(((a - x) ** 2 + (b - y) ** 2, k) for k, (a, b) in centre.items())
            assert got[i] == (k, pytest.approx(d, rel=1e-12, abs=1e-300)) or got[i][1] == pytest.approx(d, rel=1e-12)
    assert spatial.nearest_footprint(p, f.limit(0)).collect()[0]["id"] == 502


def test_groups_by_pointing_in_order(spark):
    fps = [(k, "F1", [(x + dx, y + dy) for dx, dy in ((0, 0), (0.04, 0), (0.04, 0.04), (0, 0.04))]) for k, x, y in ((1, 10.0, 0.0), (2, 10.005, 0.0), (3, 10.0, 1.0), (4, 20.0, 0.5), (5, 10.003, 1.004))]
    df = spark.createDataFrame(fps, f"fp_id long, filter string, vertices {TYPE}")
    got = {r["fp_id"]: (r["component"], r["group_no"]) for r in pointing.group_by_pointing(df).collect()}
    assert got == {3: (3, 0), 5: (3, 0), 4: (4, 1), 1: (1, 2), 2: (1, 2)}
    with pytest.raises(Exception, match="no footprint: 9"):
        pointing.group_by_pointing(df.unionByName(spark.createDataFrame([(9, "F1", None)], df.schema))).collect()


def test_search_answers_every_target(spark):
    square = lambda x, y: [(x, y), (x + 0.12, y), (x + 0.12, y + 0.12), (x, y + 0.12)]
    places = {1: (0, 0), 2: (0.03, 0), 3: (0.5, -0.5), 4: (0.5, -0.47), 5: (0, 0.01), 6: (9, 9)}
    rows = [(k, "B" if k == 5 else "A", [dict(x=float(a), y=float(b)) for a, b in square(*at)]) for k, at in places.items()]
    df = spark.createDataFrame(rows, "fp_id long, filter string, vertices array<struct<x double, y double>>")
    got = {(r["target"], r["fp_id"]): r["fraction"] for r in spatial.search(df, df.where("fp_id in (1, 3, 6)"), ("filter",), 0.3).collect()}
    assert set(got) == {(1, 1), (1, 2), (3, 3), (3, 4), (6, 6)}
    assert abs(got[1, 2] - 0.75) < 1e-9 and abs(got[3, 4] - 0.75) < 1e-9


def test_unions_of_all_components_against_brute_force(spark, sf):
    from lumenfield.plans import queries as plans
    from lumenfield.plans.fixtures import view

    boxes = {r["fp_id"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in view(spark, sf, "v_footprints").collect()}
    least = {k: k for k in boxes}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    def size(b):
        return max(b[2] - b[0], 0) * max(b[3] - b[1], 0)

    for i, a in boxes.items():
        for j, b in boxes.items():
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if i < j and w > 0 and h > 0 and w * h >= 0.6 * min(size(a), size(b)):
                p, q = sorted((root(i), root(j)))
                least[q] = p
    want = {}
    for c in {root(k) for k in boxes}:
        mine = [boxes[k] for k in boxes if root(k) == c]
        xs, ys = sorted({x for b in mine for x in b[::2]}), sorted({y for b in mine for y in b[1::2]})
        full = [(x, y, u, v) for x, u in zip(xs, xs[1:]) for y, v in zip(ys, ys[1:]) if any(b[0] <= x and u <= b[2] and b[1] <= y and v <= b[3] for b in mine)]
        area = sum(map(size, full))
        want[c] = (len(mine), area, *(sum(size(b) * (b[k] + b[k + 2]) / 2 for b in full) / area for k in (0, 1)))
    got = {r["component"]: (r["n"], r["area"], r["cx"], r["cy"]) for r in plans.queries()["union_components"](spark, sf).collect()}
    assert set(got) == set(want) and sum(n for n, *_ in got.values()) == len(boxes) and max(n for n, *_ in got.values()) > 2
    for c, w in want.items():
        assert got[c][0] == w[0] and all(abs(x - y) < 1e-7 for x, y in zip(got[c][1:], w[1:]))


def test_components_that_do_not_settle_are_an_error(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(64)], "src long, dst long")
    with pytest.raises(RuntimeError, match="unfinished"):
        connected_components(df, max_rounds=1)


def test_points_without_a_place_have_no_nearest_footprint(spark):
    f = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], f"fp_id long, vertices {TYPE}")
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 1.0, None), (None, 1.0, 1.0)], "id long, ra double, dec double")
    got = {r["id"]: (r["fp_id"], r["d2"]) for r in spatial.nearest_footprint(p, f).collect()}
    assert got == {1: (1, 0.5), 2: (None, None), 3: (None, None), None: (None, None)}
    assert {r["id"] for r in spatial.nearest_footprint(p, f.limit(0)).collect()} == {2, 3, None}


def test_centres_are_dealt_before_their_geometry_and_computed_once(spark, monkeypatch):
    """A small file of many footprints is one task: its rows are dealt by key first. Repeated points, -0.0 too, come once and their ties go to the least key."""
    plans, own = {}, spatial.written
    monkeypatch.setattr(spatial, "written", lambda df, name="table", *a, **b: (plans.setdefault(name, df), own(df, name, *a, **b))[1])
    f = spark.createDataFrame([(i, [(i + dx, dy) for dx, dy in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]) for i in range(30)], f"fp_id long, vertices {TYPE}").coalesce(1)
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, -0.0, 0.0), (2, 29.0, 1.0), (2, 29.0, 1.0), (2, 29.0, 2.0)], "id long, ra double, dec double").repartition(5)
    got = sorted(tuple(r)[:4] for r in spatial.nearest_footprint(p, f, leaf=2).collect())
    assert [g[:3] for g in got] == [(1, 0.0, 0.0), (2, 29.0, 1.0), (2, 29.0, 2.0)] and [g[3] for g in got] == [0, 28, 28]
    plan = plans["centres"]._jdf.queryExecution().optimizedPlan().toString()
    assert plans["centres"].columns == ["_key", "c"] and "RepartitionByExpression" in plan
    assert plan.index(" AS c#") < plan.index("RepartitionByExpression")  # geometry above the exchange


SCALE = 1e-4


def fields(spark, rows, height=40, width=64):
    """wcs rows of images without rotation, one pixel being SCALE degrees."""
    names = "image_id long, detector string, crval1 double, crval2 double, crpix1 double, crpix2 double, cd11 double, cd12 double, cd21 double, cd22 double, width long, height long"
    return spark.createDataFrame([(i, d, a, b, 1.0, 1.0, SCALE, 0.0, 0.0, SCALE, width, height) for i, d, a, b in rows], names)


def test_counterparts_of_both_modules(spark):
    a, b = 10.0, 0.0
    at = lambda x, y: (a + x * SCALE, b + y * SCALE)
    # direct images by where their first pixel is on the field's grid: only the long sides of each module reach them
    places = {1: at(-1050, 0), 2: at(1000, 0), 3: at(180, -80), 4: at(-180, 110), 5: at(0, -230)}
    direct = fields(spark, [(i, "", *p) for i, p in places.items()])
    images = wcs.footprints(direct).withColumn("filter", F.when(F.col("image_id") < 3, "F1").otherwise("F2")).withColumn("pupil", F.lit("CLEAR"))
    images = images.unionByName(images.where("image_id = 5").withColumn("filter", F.lit("F9")))
    grism = fields(spark, [(100, "NRCALONG", a, b), (101, "NRCBLONG", a, b)])
    got = {(r["target"], r["filter"], r["image_id"]) for r in wcs.counterparts(grism, images).collect()}
    assert got == {(100, "F1", 1), (100, "F2", 3), (100, "F2", 4), (100, "F9", None), (101, "F1", 2), (101, "F2", 3), (101, "F2", 4), (101, "F9", None)}
    with pytest.raises(ValueError, match="CLEAR"):
        wcs.counterparts(grism, images.withColumn("pupil", F.lit("GRISMR")))


def test_counterpart_planes_are_on_the_grid_of_the_field(spark):
    grism = fields(spark, [(100, "NRCALONG", 10.0, 0.0)], 4, 6)
    direct = fields(spark, [(1, "", 10.0 - 3 * SCALE, 0.0 + SCALE)], 4, 6)
    images = wcs.footprints(direct).withColumn("filter", F.lit("F1")).withColumn("pupil", F.lit("CLEAR"))
    images = images.unionByName(images.withColumn("image_id", F.lit(7).cast("long")).withColumn("filter", F.lit("F2")).withColumn("vertices", F.transform("vertices", lambda v: polygon.point(v["x"] + 5, v["y"]))))
    px = spark.createDataFrame([(1, y, x, float(10 * y + x)) for y in range(4) for x in range(6)], "image_id long, y long, x long, sci double")
    near = {"A": {"left": 4, "bottom": 1, "right": 2, "top": 1}}
    got = wcs.counterpart_planes(grism, images, direct, px, near).collect()
    one = {(r["oy"], r["ox"]): r["value"] for r in got if r["filter"] == "F1"}
    assert set(one) == {(y, x) for y in range(-1, 5) for x in range(-4, 8)} and {r["image_id"] for r in got if r["filter"] == "F1"} == {1}
    for (y, x), v in one.items():
        iy, ix = y - 1, x + 3
        if 0 < iy < 3 and 0 < ix < 5:
            assert v == pytest.approx(10 * iy + ix, abs=1e-3)
        elif not (0 <= iy <= 3 and 0 <= ix <= 5):
            assert v is None
    none = [r for r in got if r["filter"] == "F2"]
    assert len(none) == len(one) and all(r["value"] is None and r["image_id"] is None for r in none)


def test_planes_of_any_tile_equal_the_bilinear_join(spark):
    """A grid of several tiles, turned against the image, with missing pixels and places off the image."""
    rng = random.Random(9)
    grid = fields(spark, [(100, "NRCALONG", 10.0, 3.0)], 20, 30).withColumns({"cd11": F.lit(-0.8 * SCALE), "cd12": F.lit(0.3 * SCALE), "cd21": F.lit(0.25 * SCALE), "cd22": F.lit(0.9 * SCALE)})
    direct = fields(spark, [(1, "", 10.0 + 2 * SCALE, 3.0 - SCALE), (2, "", 10.0 - 9 * SCALE, 3.0 + 4 * SCALE)], 25, 35)
    px = spark.createDataFrame([(k, y, x, None if rng.random() < 0.2 else rng.random()) for k in (1, 2) for y in range(25) for x in range(35)] + [(3, 0, 0, 1.0)], "image_id long, y long, x long, sci double")
    ends = {"first_x": -13, "last_x": 44, "first_y": -6, "last_y": 29}
    grids = grid.drop("image_id").crossJoin(spark.createDataFrame([("F1", 1), ("F1", 2), ("F2", 1), ("F3", None)], "filter string, image_id long")).withColumns({k: F.lit(v).cast("long") for k, v in ends.items()})
    places = grids.where("image_id is not null").withColumn("oy", F.explode(F.sequence("first_y", "last_y"))).withColumn("ox", F.explode(F.sequence("first_x", "last_x")))
    places = places.select("filter", "image_id", "oy", "ox", wcs.pixel_to_sky(F.col("ox"), F.col("oy")).alias("s")).join(direct, "image_id").withColumn("p", wcs.sky_to_pixel(F.col("s.ra"), F.col("s.dec")))
    want = {tuple(r[:4]): r["value"] for r in wcs.reproject(px, places.select("filter", "image_id", "oy", "ox", F.col("p.pix_x").alias("in_x"), F.col("p.pix_y").alias("in_y")), also=("filter",)).collect()}
    want |= {("F3", None, y, x): None for y in range(-6, 30) for x in range(-13, 45)}
    assert sum(v is not None for v in want.values()) > 500
    for side in (7, 16, 128):
        rows = wcs.reproject_grids(px, grids, direct, ("filter",), side=side).collect()
        got = {tuple(r[:4]): r["value"] for r in rows}
        assert len(rows) == len(got) and set(got) == set(want)
        assert all((v is None) == (want[k] is None) and (v is None or v == pytest.approx(want[k], abs=1e-9)) for k, v in got.items())
    assert {tuple(r[:4]) for r in wcs.reproject_grids(px, grids, direct, ("filter",), side=16, missing=False).collect()} == {k for k, v in want.items() if v is not None}


def test_counterpart_planes_query_against_brute_force(spark, sf):
    """Every image on every field's grid, with the whole extension, pixel by pixel."""
    import numpy as np

    from lumenfield.plans import queries as plans

    p = plans._px(spark, sf)
    grism, images = plans._fields(p)
    data = {}
    for r in p.collect():
        data.setdefault(r["image_id"], {})[r["y"], r["x"]] = r["sci"]
    solution = {r["image_id"]: r.asDict() for r in grism.collect()}
    pairs = {(r["target"], r["filter"], r["image_id"]) for r in plans.queries()["counterparts"](spark, sf).collect() if r["image_id"] is not None}
    shape, want = {"A": (1100, 100, 200, 100), "B": (200, 100, 1100, 100)}, {}
    for target, filter_, image in pairs:
        left, bottom, right, top = shape[solution[target]["detector"][3]]
        oy, ox = np.mgrid[-bottom : 40 + top, -left : 64 + right]
        px, py = wcs._mapped(ox, oy, solution[target], solution[image])
        my, mx = (max(k[i] for k in data[image]) for i in (0, 1))
        for k in np.argwhere((px >= 0) & (px <= mx) & (py >= 0) & (py <= my)):
            x, y = px[tuple(k)], py[tuple(k)]
            near = [(int(y) + j, int(x) + i, abs(1 - i - x + int(x)) * abs(1 - j - y + int(y))) for j in (0, 1) for i in (0, 1)]
            some = [(w, data[image].get((j, i))) for j, i, w in near if w > 0 and data[image].get((j, i)) is not None]
            if some:
                at = (int(oy[tuple(k)]), int(ox[tuple(k)]))
                want.setdefault((target, filter_, image, at[0] // 128, at[1] // 128), []).append((at, sum(w * v for w, v in some) / sum(w for w, _ in some)))
    got = {tuple(r[:5]): r for r in plans.queries()["counterpart_planes"](spark, sf).collect()}
    assert set(got) == set(want) and len(want) >= 10
    for k, rows in want.items():
        assert got[k]["n"] == len(rows) and got[k]["total"] == pytest.approx(sum(v for _, v in rows), abs=1e-4)
        assert (tuple(got[k]["first"]), tuple(got[k]["last"])) == (min(rows)[0], max(rows)[0])


def _clipped(subject, clip):
    """Area of two convex counter-clockwise polygons together."""
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: E731, B023
        out = []
        for p, q in zip(subject, subject[1:] + subject[:1]):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if (s >= 0) != (t >= 0):
                out.append((p[0] + s / (s - t) * (q[0] - p[0]), p[1] + s / (s - t) * (q[1] - p[1])))
        subject = out
        if not subject:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(subject, subject[1:] + subject[:1]))) / 2


def test_counterparts_query_against_brute_force(spark, sf):
    from lumenfield.plans import queries as plans

    grism, images = plans._fields(plans._px(spark, sf))
    shape = {"A": (1100, 100, 200, 100), "B": (200, 100, 1100, 100)}

    def sky(r, x, y):
        u, v = x + 1 - r["crpix1"], y + 1 - r["crpix2"]
        xi, eta, d0 = math.radians(r["cd11"] * u + r["cd12"] * v), math.radians(r["cd21"] * u + r["cd22"] * v), math.radians(r["crval2"])
        den = math.cos(d0) - eta * math.sin(d0)
        return r["crval1"] + math.degrees(math.atan2(xi, den)), math.degrees(math.atan2(math.sin(d0) + eta * math.cos(d0), math.hypot(xi, den)))

    def corners(r, left=0, bottom=0, right=0, top=0):
        x, y = r["width"] - 1 + right, r["height"] - 1 + top
        v = [sky(r, *c) for c in ((-left, -bottom), (x, -bottom), (x, y), (-left, y))]
        return v if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(v, v[1:] + v[:1])) > 0 else v[::-1]

    area = lambda v: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(v, v[1:] + v[:1]))) / 2
    ims = [(r["image_id"], r["filter"], corners(r)) for r in images.collect()]
    want = set()
    for g in grism.collect():
        v = corners(g, *shape[g["detector"][3]])
        hit = {(f, i) for i, f, w in ims if _clipped(w, v) >= 0.01 * min(area(w), area(v))}
        want |= {(g["image_id"], f, i) for f, i in hit} | {(g["image_id"], f, None) for f in {f for _, f, _ in ims} - {f for f, _ in hit}}
    assert {(r["target"], r["filter"], r["image_id"]) for r in plans.queries()["counterparts"](spark, sf).collect()} == want and len(want) > 10


def test_small_files_of_many_rows_are_not_broadcast_and_are_dealt_by_rows(spark, monkeypatch):
    """Footprints on a grid compress to a few bytes each; what counts is their size in memory."""
    from lumenfield import scratch

    monkeypatch.setattr(scratch, "ROWS", 1000)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400k")
    try:
        f = spark.range(4000).select(F.col("id").alias("fp_id"), polygon.box(*[(F.col("id") % 200 + d) / 10 if i % 2 == 0 else (F.floor(F.col("id") / 200) + d) / 10 for i, d in enumerate((0, 0, 0.6, 0.6))]).alias("vertices"))
        plan = spatial.overlap_pairs(f)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin [gx" in plan
        t = scratch.written(spark.range(100_000), plain=True)
        assert int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 800_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_near_pairs_by_poles_and_beyond_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.uniform(0, 360), rng.choice([89.97, -89.96, 91.5, 150.0, 269.99, 12.0]) + rng.uniform(0, 0.02)) for i in range(240)]
    rows += [(1000 + i, 10.0 + i * 0.011, 150.0) for i in range(40)]
    got = {(r["a"], r["b"]) for r in spatial.near_pairs(spark.createDataFrame(rows, "id long, ra double, dec double"), 0.02).collect()}
    want = set()
    for i, (a, ra, da) in enumerate(rows):
        for b, rb, db in rows[i + 1 :]:
            c = math.sin(math.radians(da)) * math.sin(math.radians(db)) + math.cos(math.radians(da)) * math.cos(math.radians(db)) * math.cos(math.radians(ra - rb))
            if abs(da - db) < 0.02 and 0 < math.degrees(math.acos(max(-1.0, min(1.0, c)))) < 0.02:
                want.add((a, b))
    assert got == want and len(want) > 100


def test_rows_that_are_done_stay_out_of_the_join_of_pointer_doubling(spark):
    from lumenfield.operators import outline

    state = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, None, 1)], "eid long, next long, left long")
    step = outline._jump(state, "left", lambda a, b: a + b)
    assert sorted(map(tuple, step.collect())) == [(1, 3, 2), (2, None, 2), (3, None, 1)]
    assert "LeftOuter" not in step._jdf.queryExecution().optimizedPlan().toString()
