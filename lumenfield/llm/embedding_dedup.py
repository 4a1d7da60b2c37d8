"""Near-duplicate vectors of one label by PCA-ordered tiled comparison.

All vectors are rotated onto their principal axes, of the largest variance first, and scaled to length one. Within a
label they are dealt to tiles in the order of their first coordinate; two tiles are compared in one task, by
accumulating products over the leading axes first: after each block of axes the rest of a product is at most the product of the
vectors' remaining norms (Cauchy-Schwarz), and where that cannot reach the threshold a row stops. Tile pairs whose
first coordinates are too far apart for the threshold are never made. What remains is
computed again from the vectors as they are, in double precision, which alone decides.

Scale: equal vectors of a label are one point with a multiplicity, so copies cost nothing. A tile has about ``tile``
points, so a task holds two tiles; tile pairs send counts per point and a spanning forest of their links,
never the links. The comparison within a label is all against all (less what the bound rules out), as the method is: its work
grows with the square of a label's distinct vectors and is dealt over its tile pairs.

Defined results: a null label, and null, empty, zero or non-finite vectors or such with null parts, link with nothing; vectors of
different lengths do not link; repeated vec_ids are linked by their vectors, each row reported; a null vec_id is reported but names no component
unless there is no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import written

SLACK = 1e-9


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vectors: count and second moments of the unit vectors."""
    sums: dict[int, list] = {}
    for batch in batches:
        for dim, x in _by_length(batch.column(0)):
            got = sums.setdefault(dim, [0, np.zeros((dim, dim))])
            got[0] += len(x)
            got[1] += x.T @ x
    for dim, (n, m) in sums.items():
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([n], pa.int64()), "m": pa.array([m.ravel()], pa.list_(pa.float64()))})


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.diff(column.offsets.to_numpy())
    values, offs = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        x = values[offs[rows][:, None] + np.arange(dim)]
        yield int(dim), x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(xa: np.ndarray, xb: np.ndarray, axes: np.ndarray, threshold: float, block: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of unit vectors ``xa``, ``xb`` with a product of ``threshold`` or more, in pieces."""
    pa_, pb = xa @ axes, xb @ axes
    cuts = list(range(0, axes.shape[1], block)) + [axes.shape[1]]
    tail = lambda p: np.sqrt(np.maximum(0, np.cumsum((p * p)[:, ::-1], axis=1)[:, ::-1]))
    ta, tb = tail(pa_), tail(pb)
    for lo in range(0, len(xa), 512):
        rows, cols = np.arange(lo, min(lo + 512, len(xa))), np.arange(len(xb))
        part = np.zeros((len(rows), len(cols)))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part += pa_[rows, a:b] @ pb[cols, a:b].T
            if b == cuts[-1]:
                break
            open_ = part + np.outer(ta[rows, b], tb[cols, b]) >= threshold - SLACK
            r, c = open_.any(axis=1), open_.any(axis=0)
            if not r.any():
                part = part[:0, :0]
                rows, cols = rows[:0], cols[:0]
                break
            few = np.count_nonzero(open_)
            if few * 8 < open_.size:  # the rest pair by pair
                i, j = np.nonzero(open_)
                i, j = rows[i], cols[j]
                for s in range(0, len(i), 1 << 16):
                    yield _exact(xa, xb, i[s : s + (1 << 16)], j[s : s + (1 << 16)], threshold)
                rows = rows[:0]
                break
            part, rows, cols = part[r][:, c], rows[r], cols[c]
        if len(rows):
            i, j = np.nonzero(part >= threshold - SLACK)
            i, j = rows[i], cols[j]
            for s in range(0, len(i), 1 << 16):
                yield _exact(xa, xb, i[s : s + (1 << 16)], j[s : s + (1 << 16)], threshold)


def _exact(xa, xb, i, j, threshold):
    ok = np.einsum("ij,ij->i", xa[i], xb[j]) >= threshold
    return i[ok], j[ok]


def _tile_pair(axes_by_dim: dict[int, np.ndarray], threshold: float):
    schema = pa.schema([("point", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, dim, ta, tb = (k.as_py() for k in key)
        at = table.column("tile").to_numpy()
        point, times = table.column("point").to_numpy(), table.column("times").to_numpy()
        x = np.array(table.column("v").combine_chunks().values.to_numpy(zero_copy_only=False)).reshape(-1, dim)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.flatnonzero(at == ta), np.flatnonzero(at == tb)
        links, root = np.zeros(len(point), np.int64), np.arange(len(point))
        for i, j in compare(x[a], x[b], axes_by_dim[dim], threshold):
            i, j = a[i], b[j]
            if ta == tb:
                i, j = i[i != j], j[i != j]
            np.add.at(links, i, times[j])
            if ta != tb:
                np.add.at(links, j, times[i])
            while True:  # hook roots to smaller ones, then flatten
                ri, rj = root[i], root[j]
                if (ri == rj).all():
                    break
                np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
                while (root != root[root]).any():
                    root = root[root]
        keep = links > 0
        return pa.table([point[keep], links[keep], point[root[keep]]], schema=schema)

    return run


def _first_coordinate(points: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("point", pa.int64()), ("times", pa.int64()), ("c", pa.float64()), ("v", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, v = np.zeros(batch.num_rows), batch.column("v")
            sizes = np.diff(v.offsets.to_numpy())
            for dim, x in _by_length(v):
                c[sizes == dim] = x @ axes[dim][:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(n) if n != "c" else pa.array(c) for n in schema.names], schema=schema)

    return points.select("label", "dim", "point", "times", "v").mapInArrow(run, "label string, dim int, point long, times long, c double, v array<double>")


def principal_axes(points: DataFrame) -> dict[int, np.ndarray]:
    """By length of vectors, the axes as columns, of the largest second moment first."""
    sums = points.select("v").mapInArrow(_moments, "dim int, n long, m array<double>").select("dim", F.posexplode("m").alias("pos", "m"))
    sums = sums.groupBy("dim", "pos").agg(F.sum("m").alias("m")).collect()  # length x length numbers
    axes = {}
    for dim in {r["dim"] for r in sums}:
        m = np.zeros(dim * dim)
        for r in sums:
            if r["dim"] == dim:
                m[r["pos"]] = r["m"]
        axes[dim] = np.linalg.eigh(m.reshape(dim, dim))[1][:, ::-1].copy()
    return axes


def tiles(first: DataFrame, tile: int, bins: int = 256) -> DataFrame:
    """Adds ``tile``: about ``tile`` points each, in the order of the first coordinate within (label, dim)."""
    cuts = first.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("c", F.array(*[F.lit(k / bins) for k in range(1, bins)]), 2000).alias("cuts"))
    wanted = F.ceil(F.col("n") / tile)
    ranges = F.least(wanted, F.lit(bins))
    spot = F.floor(F.size(F.filter("cuts", lambda x: x <= F.col("c"))) * ranges / bins)
    parts = F.ceil(wanted / ranges)  # a label with more tiles than bins is split further by hash
    return first.join(cuts, ["label", "dim"]).withColumn("tile", (spot * parts + F.pmod(F.xxhash64("point"), parts)).cast("long")).drop("n", "cuts")


def link(vectors: DataFrame, threshold: float = 0.93, tile: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, label)."""
    v = F.col("embedding").cast("array<double>")
    inf = float("inf")
    good = F.col("label").isNotNull() & F.coalesce(
        (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf)) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    label = F.col("label").cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.when(good, v).alias("v"))
    rows = rows.select("vec_id", "label", "v", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")).alias("k1"), F.xxhash64(F.lit(7), "label", "v").alias("k2"))
    points = rows.where(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"))
    points = written(points.withColumn("point", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "points")
    axes = principal_axes(points)
    tiled = written(tiles(_first_coordinate(points, axes), tile), "tiles")
    spans = tiled.groupBy("label", "dim", "tile").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    a = spans.select("label", "dim", F.col("tile").alias("ta"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    b = spans.select("label", "dim", F.col("tile").alias("tb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK  # how far apart unit vectors with such a cosine can be on any axis
    pairs = a.join(b, ["label", "dim"]).where((F.col("ta") <= F.col("tb")) & (F.greatest("la", "lb") - F.least("ha", "hb") <= reach))
    sides = pairs.select("label", "dim", "ta", "tb", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("tile"))
    met = tiled.join(sides, ["label", "dim", "tile"]).select("label", "dim", "ta", "tb", "tile", "point", "times", "v")
    found = written(met.groupBy("label", "dim", "ta", "tb").applyInArrow(_tile_pair(axes, threshold), "point long, links long, low long"), "links")
    comp = connected_components(found.select(F.col("point").alias("src"), F.col("low").alias("dst")))
    group = F.coalesce("component", "point")
    named = points.select("k1", "k2", "point", "times", "least").join(found.groupBy("point").agg(F.sum("links").alias("links")), "point", "left")
    named = written(named.join(comp.withColumnRenamed("node", "point"), "point", "left").select("k1", "k2", "times", "least", "links", group.alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("k1", "k2", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
