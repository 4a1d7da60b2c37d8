"""Pixel operators over long-form images (image_id, y, x, sci, err, dq); missing values are null."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from . import stats, surface, tiles
from .graph import connected_components


def gaussian_kernel(radius: int, sigma: float) -> list[float]:
    """2 * radius + 1 normalised weights."""
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def data_box(pixels: DataFrame, value: str = "sci") -> DataFrame:
    """(image_id, x0, x1, y0, y1) of the pixels that are not missing."""
    return pixels.where(F.col(value).isNotNull()).groupBy("image_id").agg(*[f(c).alias(n) for c in "xy" for f, n in ((F.min, f"{c}0"), (F.max, f"{c}1"))])


def smooth(pixels: DataFrame, radius_x: int = 15, radius_y: int | None = None, sigma_x: float | None = None, sigma_y: float | None = None, value: str = "sci", invalid: Column | None = None, fill: str = "nan", side: int = tiles.SIDE) -> DataFrame:
    """(image_id, y, x, smooth): normalised Gaussian convolution inside the box of the data, every pixel replaced.

    Missing pixels have no weight; where no weight reaches, the image's median stands. Both axes blur with the
    x width unless ``sigma_y`` is given. ``invalid`` may only mark missing pixels. ``fill`` says what stands outside the box: nan
    (missing), zero, mean or median; nearest changes nothing.

    Work is by tiles of ``side`` pixels, each with a margin of the radius from its neighbours, in one shuffle; borders of the box are
    mirrored without repeating the edge.
    """
    radius_y = radius_x if radius_y is None else radius_y
    sigma_x = radius_x / 2 if sigma_x is None else sigma_x
    sigma_y = sigma_x if sigma_y is None else sigma_y
    side = max(side, radius_x, radius_y)
    v = F.col(value).cast("double")
    if invalid is not None:
        v = F.when(invalid & v.isNotNull(), F.raise_error(F.lit("the mask covers pixels that have data")).cast("double")).otherwise(v)
    src = pixels.select("image_id", "y", "x", v.alias("v"))
    stat = src.groupBy("image_id").agg(F.avg("v").alias("mean")).join(stats.quantiles(src, ("image_id",), "v", {"median": 0.5}), "image_id", "left")
    box = stat.join(data_box(src, "v"), "image_id", "left")
    outside = {"zero": F.lit(0.0), "mean": F.col("mean"), "median": F.col("median")}.get(fill, F.lit(None).cast("double"))
    rows = tiles.dealt(src.join(box.withColumn("out", outside).drop("mean"), "image_id"), radius_x, radius_y, side)
    wx, wy = np.array(gaussian_kernel(radius_x, sigma_x)), np.array(gaussian_kernel(radius_y, sigma_y))

    def tile(key: tuple, t: pa.Table) -> pa.Table:
        column = lambda c: t.column(c).to_numpy()
        y, x, own_y, own_x = column("y"), column("x"), key[1].as_py() * side, key[2].as_py() * side
        own = (y >= own_y) & (y < own_y + side) & (x >= own_x) & (x < own_x + side)
        out = np.full(len(y), np.nan if t.column("out")[0].as_py() is None else t.column("out")[0].as_py())
        if t.column("x0")[0].is_valid:
            x0, x1, y0, y1 = (t.column(c)[0].as_py() for c in ("x0", "x1", "y0", "y1"))
            inside = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
            first_y, first_x = max(y0, own_y), max(x0, own_x)
            last_y, last_x = min(y1, own_y + side - 1), min(x1, own_x + side - 1)
            mine = own & inside
            if mine.any():
                oy, ox = max(y0, own_y - radius_y), max(x0, own_x - radius_x)
                num = np.zeros((min(y1, own_y + side - 1 + radius_y) - oy + 1, min(x1, own_x + side - 1 + radius_x) - ox + 1))
                den = num.copy()
                value = column("v")
                some = inside & ~np.isnan(value)
                num[y[some] - oy, x[some] - ox] = value[some]
                den[y[some] - oy, x[some] - ox] = 1
                rows = tiles.mirrored(np.arange(first_y - radius_y, last_y + radius_y + 1) - y0, y1 - y0 + 1) + y0 - oy
                cols = tiles.mirrored(np.arange(first_x - radius_x, last_x + radius_x + 1) - x0, x1 - x0 + 1) + x0 - ox
                num, den = (tiles.blurred(a, wx, rows, cols, wy) for a in (num, den))
                made = np.where(den > 1e-12, num / np.maximum(den, 1e-300), t.column("median")[0].as_py())
                out[mine] = made[y[mine] - first_y, x[mine] - first_x]
        image, out = t.column("image_id").filter(pa.array(own)), out[own]
        return pa.table({"image_id": image, "y": y[own], "x": x[own], "smooth": pa.array(out, mask=np.isnan(out))})

    kind = src.schema["image_id"].dataType.simpleString()
    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("y", "x", "x0", "x1", "y0", "y1")})
    return rows.groupBy("image_id", "ty", "tx").applyInArrow(tile, f"image_id {kind}, y long, x long, smooth double")


def segments(bright: DataFrame, min_pixels: int = 10, side: int = tiles.SIDE) -> DataFrame:
    """Pixels (image_id, y, x) of 8-connected regions of at least ``min_pixels``.

    Regions are labelled inside tiles; touching pixels on the two sides of a tile's border are the edges, and components are of
    labels that reach a border, not of pixels.
    """

    def tile(t: pa.Table) -> pa.Table:
        t = t.sort_by([("y", "ascending"), ("x", "ascending")])
        y, x = (t.column(c).to_numpy() for c in ("y", "x"))
        root = tiles.labelled(y, x)
        return t.append_column("ly", pa.array(y[root])).append_column("lx", pa.array(x[root]))

    kind = bright.schema["image_id"].dataType.simpleString()
    spots = bright.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    own = tiles.dealt(spots, side=side).groupBy("image_id", "ty", "tx").applyInArrow(tile, f"image_id {kind}, y long, x long, ty long, tx long, ly long, lx long")
    place = [F.lpad(F.col(c).cast("string"), 12, "0") for c in ("ly", "lx")]
    own = written(own.select("image_id", "y", "x", F.concat_ws("/", F.col("image_id").cast("string"), *place).alias("label")), "labels", plain=True)
    last = lambda c: F.pmod(F.col(c), F.lit(side)).isin(0, side - 1)
    border = own.where(last("y") | last("x"))
    beyond = border.select("image_id", F.col("label").alias("src"), F.explode(tiles.neighbours(side)).alias("p")).select("image_id", "src", "p.y", "p.x")
    edges = beyond.join(border.withColumnRenamed("label", "dst"), ["image_id", "y", "x"]).select("src", "dst").distinct()
    comp = connected_components(edges).withColumnRenamed("node", "label")
    sizes = own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(comp, "label", "left").withColumn("component", F.coalesce("component", "label"))
    large = sizes.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pixels)
    kept = sizes.join(large.select("component"), "component", "left_semi").select("label")
    return own.join(kept, "label", "left_semi").select("image_id", "y", "x")


def segmentation(pixels: DataFrame, factor: float = 2.0, min_pixels: int = 10, radius: int = 4, sigma: float | None = None, value: str = "sci") -> DataFrame:
    """(image_id, y, x, segment): sources, grown by a blur of their regions that is over 0.05."""
    pixels = written(pixels.select("image_id", "y", "x", value), "pixels", plain=True)  # read by every pass; exploded rows are more than the planner takes them for
    st = stats.clipped_stats(pixels, value=value).select("image_id", "median", "mad")
    bright = pixels.join(st, "image_id").where(F.col(value) - F.col("median") > factor * F.col("mad"))
    on = segments(bright, min_pixels).withColumn("on", F.lit(1.0))
    plane = pixels.select("image_id", "y", "x").join(on, ["image_id", "y", "x"], "left").fillna({"on": 0.0})
    blurred = smooth(plane, radius, radius, sigma or radius / 2, value="on")
    return blurred.select("image_id", "y", "x", F.coalesce(F.col("smooth") > 0.05, F.lit(False)).alias("segment"))


def fill_masked(pixels: DataFrame, model: DataFrame, mask: Column, value: str = "sci", model_value: str = "model", fill: str = "nan") -> DataFrame:
    """``pixels`` with ``filled``: the model where masked inside the data's box, the data elsewhere."""
    box = data_box(pixels, value)
    both = pixels.join(model.select("image_id", "y", "x", F.col(model_value).alias("_m")), ["image_id", "y", "x"], "left").join(box, "image_id", "left")
    inside = F.coalesce(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")), F.lit(False))
    out = both.withColumn("filled", F.when(mask & inside, F.col("_m")).otherwise(F.col(value))).withColumn("_in", inside)
    if fill in ("zero", "mean", "median"):
        if fill == "median":
            agg = pixels.select("image_id").distinct().join(stats.quantiles(pixels, ("image_id",), value, {"_o": 0.5}), "image_id", "left")
        else:
            agg = pixels.groupBy("image_id").agg({"zero": F.lit(0.0), "mean": F.avg(value)}[fill].alias("_o"))
        out = out.join(agg, "image_id").withColumn("filled", F.when(F.col("_in"), F.col("filled")).otherwise(F.coalesce("filled", "_o"))).drop("_o")
    return out.drop("_m", "_in", "x0", "x1", "y0", "y1")


def stripe_noise(pixels: DataFrame, mask: Column, pupil: str = "CLEAR", bin_size: int = 1, value: str = "sci") -> DataFrame:
    """(image_id, y, x, noise): row and column medians of what is not masked, about the image's median.

    CLEAR: binned columns, then rows of what they leave (not binned); GRISMR: columns; GRISMC: rows.
    """
    if pupil not in ("CLEAR", "GRISMR", "GRISMC"):
        raise ValueError(f"unsupported pupil: {pupil}")
    good = pixels.where(~F.coalesce(mask, F.lit(False)) & F.col(value).isNotNull())
    med = stats.quantiles(good, ("image_id",), value, {"_all": 0.5})
    r = good.join(med, "image_id").select("image_id", "y", "x", (F.col(value) - F.col("_all")).alias("v"))
    out = pixels.select("image_id", "y", "x")
    noise = F.lit(0.0)
    if pupil != "GRISMC":
        cols = stats.axis_medians(r, "x", "v", bin_size=bin_size).withColumnRenamed("med", "_c")
        out = out.join(cols, ["image_id", "x"], "left")
        noise = noise + F.coalesce("_c", F.lit(0.0))
        r = r.join(cols, ["image_id", "x"]).select("image_id", "y", "x", (F.col("v") - F.col("_c")).alias("v"))
    if pupil != "GRISMR":
        rows = stats.axis_medians(r, "y", "v", bin_size=bin_size if pupil == "GRISMC" else 1).withColumnRenamed("med", "_r")
        out = out.join(rows, ["image_id", "y"], "left")
        noise = noise + F.coalesce("_r", F.lit(0.0))
    return out.select("image_id", "y", "x", noise.alias("noise"))


def smoothing_of(pupil: str) -> dict[str, float]:
    """Kernel of the stripe step by pupil: along the dispersion for grisms; widths follow the x radius."""
    return {"CLEAR": {"radius_x": 1, "radius_y": 1}, "GRISMR": {"radius_x": 15, "radius_y": 1}, "GRISMC": {"radius_x": 1, "radius_y": 1}}[pupil]


def stripe_noise_full(pixels: DataFrame, pupil: str = "CLEAR", bin_size: int = 1) -> DataFrame:
    """Stripe noise with the mask from the data: bad pixels and the segments of the smoothed image."""
    pixels = written(pixels.select("image_id", "y", "x", "sci", "dq"), "pixels", plain=True)
    seg = written(segmentation(smooth(pixels, **smoothing_of(pupil)).withColumnRenamed("smooth", "sci")), "segments", plain=True)
    both = pixels.join(seg, ["image_id", "y", "x"], "left")
    return stripe_noise(both, (F.col("dq") != 0) | F.coalesce("segment", F.lit(False)), pupil, bin_size)


def subtract(pixels: DataFrame, model: DataFrame, model_value: str, value: str = "sci") -> DataFrame:
    """``pixels`` less a model plane; places without a model become missing."""
    m = model.select("image_id", "y", "x", F.col(model_value).alias("_m"))
    return pixels.join(m, ["image_id", "y", "x"], "left").withColumn(value, F.col(value) - F.col("_m")).drop("_m")


def mask_plane(pixels: DataFrame, mask: Column, value: str = "sci") -> DataFrame:
    """``pixels`` with shown: the high end of the display range where masked, else the low end."""
    p = stats.percentiles(pixels, value=value)
    return pixels.join(p, "image_id").withColumn("shown", F.when(mask, F.col("p_high")).otherwise(F.col("p_low"))).drop("p_low", "p_high")


def background(pixels: DataFrame, mask: Column | None = None, block: int = 128, size_x: int | None = None, size_y: int | None = None, fraction: float = 0.5, value: str = "sci", origin_x: float | None = None, origin_y: float | None = None, smoothing: float | None = None, bounds: tuple[float, float, float, float] | None = None, knots: int | None = None, partial: bool = True) -> DataFrame:
    """(image_id, y, x, background): a bicubic smoothing spline through tile medians, at every pixel.

    ``smoothing`` is the sum of squared residuals that the spline may leave (default: the number of tiles); ``bounds`` (x0, x1, y0, y1) its
    domain (default: of the tiles used), beyond which its border values stand; ``knots`` asks for a least-squares surface with as many
    equal intervals on each axis instead. Tile medians are Spark's; the fit is one small solve per image (a number per tile); pixels are
    evaluated in batches. Images with fewer usable tiles than the first surface has coefficients (16) have no background. Without
    ``partial`` an image whose sides are not multiples of the tile's is an error. The first tile's place is half its number of tiles unless given.
    """
    sx, sy = size_x or block, size_y or block
    if mask is None:
        pixels = pixels.join(segmentation(pixels, value=value), ["image_id", "y", "x"], "left")
        mask = F.coalesce("segment", F.lit(False))
    med = stats.tile_medians(pixels, mask, block, sx, sy, fraction, value, partial)
    shape = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ox = (int(pdf["w"].iloc[0]) // sx) // 2 if origin_x is None else origin_x
        oy = (int(pdf["h"].iloc[0]) // sy) // 2 if origin_y is None else origin_y
        pdf = pdf.sort_values(["ty", "tx"])  # the order of rows in a group must not show
        x, y, z = ox + sx * pdf["tx"].to_numpy(float), oy + sy * pdf["ty"].to_numpy(float), pdf["med"].to_numpy(float)
        made = surface.fitted(x, y, z, smoothing, bounds, knots)
        rows = [] if made is None else [(pdf["image_id"].iloc[0], made.coef.ravel().tolist(), made.kx.tolist(), made.ky.tolist())]
        return pd.DataFrame(rows, columns=["image_id", "coef", "kx", "ky"])

    key = pixels.schema["image_id"].dataType.simpleString()
    coef = med.join(shape, "image_id").groupBy("image_id").applyInPandas(fit, f"image_id {key}, coef array<double>, kx array<double>, ky array<double>")

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            for _, at in pdf.groupby("image_id").indices.items():
                row = pdf.iloc[at[0]]
                if row["coef"] is not None:
                    kx, ky = np.asarray(row["kx"], float), np.asarray(row["ky"], float)
                    c = np.asarray(row["coef"], float).reshape(len(ky) - surface.DEGREE - 1, -1)
                    out[at] = surface.Surface(kx, ky, c).at(pdf["x"].to_numpy(float)[at], pdf["y"].to_numpy(float)[at])
            yield pd.DataFrame({"image_id": pdf["image_id"], "y": pdf["y"], "x": pdf["x"], "background": out})

    placed = pixels.select("image_id", "y", "x").join(coef, "image_id", "left")
    out = placed.mapInPandas(evaluate, f"image_id {key}, y long, x long, background double")
    return out.withColumn("background", stats.finite(F.col("background")))
