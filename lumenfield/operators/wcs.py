"""Sky and pixel coordinates on the tangent plane, image stacks and reprojection.

Linear tangent-plane solutions only (published FITS WCS standard); no distortion and no grism dispersion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygon
from ..functions.columns import let
from ..scratch import written
from . import spatial, tiles


def pixel_to_sky(x: Column, y: Column) -> Column:
    """struct(ra, dec) in degrees, from pixel numbers starting at 0 and the columns of a wcs row."""
    u, v = x + 1 - F.col("crpix1"), y + 1 - F.col("crpix2")
    plane = F.struct(F.radians(F.col("cd11") * u + F.col("cd12") * v).alias("xi"), F.radians(F.col("cd21") * u + F.col("cd22") * v).alias("eta"))
    d0 = F.radians("crval2")

    def sky(p: Column) -> Column:
        den = F.cos(d0) - p["eta"] * F.sin(d0)
        ra = F.pmod(F.col("crval1") + F.degrees(F.atan2(p["xi"], den)), F.lit(360.0))
        dec = F.degrees(F.atan2(F.sin(d0) + p["eta"] * F.cos(d0), F.sqrt(p["xi"] * p["xi"] + den * den)))
        return F.struct(ra.alias("ra"), dec.alias("dec"))

    return let(plane, sky)


def sky_to_pixel(ra: Column, dec: Column) -> Column:
    """struct(pix_x, pix_y), numbers starting at 0."""
    a, d, d0 = F.radians(ra - F.col("crval1")), F.radians(dec), F.radians("crval2")
    cosc = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    xi, eta = F.degrees(F.cos(d) * F.sin(a) / cosc), F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / cosc)

    def pixel(p: Column) -> Column:
        det = F.col("cd11") * F.col("cd22") - F.col("cd12") * F.col("cd21")
        u, v = (F.col("cd22") * p["xi"] - F.col("cd12") * p["eta"]) / det, (F.col("cd11") * p["eta"] - F.col("cd21") * p["xi"]) / det
        return F.struct((u + F.col("crpix1") - 1).alias("pix_x"), (v + F.col("crpix2") - 1).alias("pix_y"))

    return let(F.struct(xi.alias("xi"), eta.alias("eta")), pixel)


def footprints(wcs: DataFrame, left: Column | int = 0, bottom: Column | int = 0, right: Column | int = 0, top: Column | int = 0) -> DataFrame:
    """``wcs`` (with width and height) with vertices on the sky and their pixel pairs; sides can be pushed out."""
    x0, y0 = -F.lit(left), -F.lit(bottom)
    x1, y1 = F.col("width") - 1 + right, F.col("height") - 1 + top
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    sky = [pixel_to_sky(x, y) for x, y in corners]
    out = wcs.withColumn("_sky", F.array(*sky)).withColumn("vertex_marker", F.array(*[F.array(x.cast("long"), y.cast("long")) for x, y in corners]))
    return out.withColumn("vertices", F.transform("_sky", lambda s: polygon.point(s["ra"], s["dec"]))).drop("_sky")


def catalog_pixels(points: DataFrame, exposures: DataFrame, wcs: DataFrame, x: str = "ra", y: str = "dec", key: str = "image_id", cell: float = 0.05) -> DataFrame:
    """Sources strictly inside each exposure's footprint, with their pixel position."""
    inside = spatial.points_in_footprints(points, exposures.select(key, "vertices"), x, y, cell)
    return inside.join(wcs, key).withColumn("p", sky_to_pixel(F.col(x), F.col(y))).select(*points.columns, key, "p.pix_x", "p.pix_y")


def pixel_coordinates(pixels: DataFrame, wcs: DataFrame) -> DataFrame:
    return pixels.join(wcs, "image_id").withColumn("s", pixel_to_sky(F.col("x").cast("double"), F.col("y").cast("double"))).select(*pixels.columns, "s.ra", "s.dec")


#: How many pixels a grism field reaches beyond the image on each side, by module.
EXTENSION = {"A": {"left": 1100, "bottom": 100, "right": 200, "top": 100}, "B": {"left": 200, "bottom": 100, "right": 1100, "top": 100}}


def extended(grism: DataFrame, extension: dict[str, dict[str, int]] = EXTENSION) -> DataFrame:
    """Grism fields (wcs rows with detector, width, height) with left, bottom, right and top, the pixels beyond the image, by the module in the detector's name."""
    module = F.substring("detector", 4, 1)
    side = lambda s: F.coalesce(*[F.when(module == m, F.lit(e[s])) for m, e in extension.items()])
    return grism.withColumns({s: side(s) for s in ("left", "bottom", "right", "top")})


def counterparts(grism: DataFrame, images: DataFrame, extension: dict[str, dict[str, int]] = EXTENSION, min_fraction: float = 0.01) -> DataFrame:
    """(target, filter, image_id) of direct images that overlap each grism field's extended footprint; a field's filters without any have a null image.

    ``grism``: wcs rows with image_id (the target), detector, width and height; ``images``: image_id, filter, pupil, vertices. An
    error if no image is direct.
    """
    clear = images.where(F.col("pupil") == "CLEAR")
    if clear.isEmpty():
        raise ValueError("no CLEAR images")
    fields = footprints(extended(grism, extension), *map(F.col, ("left", "bottom", "right", "top"))).select("image_id", "vertices")
    hit = spatial.search(clear, fields, (), min_fraction, "image_id")
    wanted = fields.select(F.col("image_id").alias("target")).crossJoin(clear.select("filter").distinct())  # filters are few
    return wanted.join(hit.select("target", "filter", "image_id"), ["target", "filter"], "left")


SOLUTION = ["crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22", "crval1", "crval2"]


def counterpart_planes(grism: DataFrame, images: DataFrame, wcs: DataFrame, pixels: DataFrame, extension: dict[str, dict[str, int]] = EXTENSION, min_fraction: float = 0.01, side: int = tiles.SIDE, missing: bool = True) -> DataFrame:
    """The counterparts of each field on the field's own extended grid: (target, filter, image_id, oy, ox, value), places counted from the
    field's first pixel, so that those of the extension before it are negative. A filter without counterpart gives one plane of missing values.

    ``wcs``: rows of the direct images; ``pixels``: image_id, y, x, sci. Without ``missing``, places without a value have no row.
    """
    field = extended(grism, extension).withColumnRenamed("image_id", "target")
    asked = counterparts(grism, images, extension, min_fraction).join(field, "target")
    grids = asked.select("target", "filter", "image_id", *SOLUTION, (-F.col("left")).alias("first_x"), (F.col("width") - 1 + F.col("right")).alias("last_x"), (-F.col("bottom")).alias("first_y"), (F.col("height") - 1 + F.col("top")).alias("last_y"))
    return reproject_grids(pixels, grids, wcs, ("target", "filter"), side=side, missing=missing)


def reproject_grids(pixels: DataFrame, grids: DataFrame, wcs: DataFrame, also: tuple[str, ...] = (), value: str = "sci", side: int = tiles.SIDE, missing: bool = True) -> DataFrame:
    """Bilinear values (*also, image_id, oy, ox, value) of images on other images' grids, as ``reproject``, tile by tile.

    ``grids``: *also, image_id (null: missing everywhere), the solution of the grid, first_x, last_x, first_y, last_y; ``wcs``: the images'
    solutions. A tile of the grid asks for the tiles of the image that its corners enclose there (lines stay lines between
    tangent planes) and nothing else; tiles that lie off the image take no part, so work follows the overlap, not the grid.
    """
    own, at = [*also, "image_id"], ["oty", "otx"]
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"first_{c}") / side), F.floor(F.col(f"last_{c}") / side)))
    out = grids.withColumn("oty", span("y")).withColumn("otx", span("x"))
    for c, t in (("x", "otx"), ("y", "oty")):
        out = out.withColumns({f"{c}0": F.greatest(F.col(t) * side, F.col(f"first_{c}")), f"{c}1": F.least(F.col(t) * side + side - 1, F.col(f"last_{c}"))})
    corners = F.array(*(pixel_to_sky(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    out = written(out.select(*own, *at, "x0", "x1", "y0", "y1", corners.alias("sky"), F.struct(*SOLUTION).alias("o")), "grid_tiles")
    shape = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    met = out.join(wcs.select("image_id", *SOLUTION), "image_id").join(shape, "image_id")
    there = met.withColumn("p", F.transform("sky", lambda s: sky_to_pixel(s["ra"], s["dec"])))
    end = lambda f, c: f(F.transform("p", lambda q: q[c]))
    for c in "xy":
        there = there.withColumns({f"{c}a": F.greatest(F.floor(end(F.array_min, f"pix_{c}")), F.lit(0)), f"{c}b": F.least(F.floor(end(F.array_max, f"pix_{c}")) + 1, F.col(f"m{c}"))})
    there = there.where("xa <= xb and ya <= yb").select(*own, *at, "x0", "x1", "y0", "y1", "mx", "my", "o", F.struct(*SOLUTION).alias("i"), "xa", "xb", "ya", "yb")
    there = written(there, "asking_tiles")
    tile = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}a") / side), F.floor(F.col(f"{c}b") / side)))
    wanted = there.select(*own, *at, "x0", "x1", "y0", "y1", "mx", "my", "o", "i", tile("x").alias("tx"), "ya", "yb").withColumn("ty", tile("y")).drop("ya", "yb")
    fields = [f"{c} {grids.schema[c].dataType.simpleString()}" for c in own]
    got = wanted.join(_tile_rows(pixels, value, side), ["image_id", "ty", "tx"]).groupBy(*own, *at)
    got = got.applyInArrow(lambda key, t: _bilinear_tile(key, t, own, side), ", ".join(fields) + ", oy long, ox long, value double")
    if not missing:
        return got.where("value is not null")
    answered = written(got, "values")
    # tiles off the image, and those on a part of it that has no pixels
    off = out.join(answered.select(*own, F.floor(F.col("oy") / side).alias("oty"), F.floor(F.col("ox") / side).alias("otx")).distinct().withColumn("_hit", F.lit(True)), [*own, *at], "left").where("_hit is null")
    off = off.withColumn("oy", F.explode(F.sequence("y0", "y1"))).withColumn("ox", F.explode(F.sequence("x0", "x1")))
    return answered.unionByName(off.select(*own, F.col("oy").cast("long").alias("oy"), F.col("ox").cast("long").alias("ox"), F.lit(None).cast("double").alias("value")))


def _tile_rows(pixels: DataFrame, value: str, side: int) -> DataFrame:
    """(image_id, ty, tx, y, x, v): a row for each tile with the pixels that have a value."""
    rows = tiles.dealt(pixels.where(F.col(value).isNotNull()).select("image_id", "y", "x", F.col(value).cast("double").alias("v")), side=side)
    return rows.groupBy("image_id", "ty", "tx").agg(F.collect_list(F.struct("y", "x", "v")).alias("v"))  # a tile at most


def _bilinear_tile(key: tuple, t: pa.Table, own: list[str], side: int) -> pa.Table:
    """Values of one tile of a grid out of the rows of image tiles that it asks for."""
    first = t.slice(0, 1).to_pylist()[0]
    flat = pc.list_flatten(t.column("v")).combine_chunks()
    y, x, v = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "v"))
    oy, ox = int(y.min()), int(x.min())
    image = np.full((int(y.max()) - oy + 1, int(x.max()) - ox + 1), np.nan)
    image[y - oy, x - ox] = v
    gy, gx = (a.ravel() for a in np.mgrid[first["y0"] : first["y1"] + 1, first["x0"] : first["x1"] + 1])
    px, py = _mapped(gx, gy, first["o"], first["i"])
    inside = (px >= 0) & (px <= first["mx"]) & (py >= 0) & (py <= first["my"])
    fx, fy = np.floor(px), np.floor(py)
    total, weight = np.zeros(len(px)), np.zeros(len(px))
    for j in (0, 1):
        for i in (0, 1):
            w = (px - fx if i else 1 - px + fx) * (py - fy if j else 1 - py + fy)
            c, r = fx.astype(np.int64) + i - ox, fy.astype(np.int64) + j - oy
            ok = inside & (w > 0) & (c >= 0) & (r >= 0) & (c < image.shape[1]) & (r < image.shape[0])
            near = np.where(ok, image[np.where(ok, r, 0), np.where(ok, c, 0)], np.nan)
            ok &= ~np.isnan(near)
            total += np.where(ok, w * np.where(ok, near, 0), 0)
            weight += np.where(ok, w, 0)
    value = pa.array(total / np.where(weight > 0, weight, 1), mask=weight <= 0)
    same = {c: pa.array([k.as_py()] * len(gx), t.schema.field(c).type) for c, k in zip(own, key)}
    return pa.table(same | {"oy": pa.array(gy.astype(np.int64)), "ox": pa.array(gx.astype(np.int64)), "value": value})


def _mapped(x: np.ndarray, y: np.ndarray, grid: dict, image: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of an image under pixels of a grid, through the sky (the formulas of ``pixel_to_sky`` and ``sky_to_pixel``)."""
    u, v = x + 1 - grid["crpix1"], y + 1 - grid["crpix2"]
    xi, eta = np.radians(grid["cd11"] * u + grid["cd12"] * v), np.radians(grid["cd21"] * u + grid["cd22"] * v)
    d0 = np.radians(grid["crval2"])
    den = np.cos(d0) - eta * np.sin(d0)
    a = np.radians(grid["crval1"] - image["crval1"]) + np.arctan2(xi, den)
    d = np.arctan2(np.sin(d0) + eta * np.cos(d0), np.sqrt(xi * xi + den * den))
    d0 = np.radians(image["crval2"])
    cosc = np.sin(d0) * np.sin(d) + np.cos(d0) * np.cos(d) * np.cos(a)
    xi, eta = np.degrees(np.cos(d) * np.sin(a) / cosc), np.degrees((np.cos(d0) * np.sin(d) - np.sin(d0) * np.cos(d) * np.cos(a)) / cosc)
    det = image["cd11"] * image["cd22"] - image["cd12"] * image["cd21"]
    return (image["cd22"] * xi - image["cd12"] * eta) / det + image["crpix1"] - 1, (image["cd11"] * eta - image["cd21"] * xi) / det + image["crpix2"] - 1


def reproject(pixels: DataFrame, targets: DataFrame, value: str = "sci", also: tuple[str, ...] = ()) -> DataFrame:
    """Bilinear values at (image_id, oy, ox, in_x, in_y): weighted mean of the valid of four neighbours; missing if none has weight.

    Positions outside the image are missing. Columns in ``also`` tell apart grids that ask the same image.
    """
    place = [*also, "image_id", "oy", "ox"]
    shape = pixels.groupBy("image_id").agg((F.max("x")).alias("mx"), (F.max("y")).alias("my"))
    t = targets.join(shape, "image_id")
    inside = F.col("in_x").between(0, F.col("mx")) & F.col("in_y").between(0, F.col("my"))
    fx, fy = F.floor("in_x"), F.floor("in_y")
    wx, wy = F.col("in_x") - fx, F.col("in_y") - fy
    near = F.array(*[F.struct((fx + i).alias("x"), (fy + j).alias("y"), ((wx if i else 1 - wx) * (wy if j else 1 - wy)).alias("w")) for j in (0, 1) for i in (0, 1)])
    four = t.where(inside).select(*place, F.explode(near).alias("n")).select(*place, "n.x", "n.y", "n.w").where("w > 0")
    got = four.join(pixels.select("image_id", "x", "y", F.col(value).alias("v")).where("v is not null"), ["image_id", "x", "y"])
    s = got.groupBy(*place).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))
    return targets.select(*place).join(s, place, "left")
