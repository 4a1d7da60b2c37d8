"""Spectra in long form (spec_id, y, x, wavelength, flux, err): grids, resampling, combination, cut-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import spread, written
from . import order as order_
from .stats import HELD, MAD_ROUNDED, most_held, quantiles


def edges(centers: DataFrame, by: str = "spec_id", wave: str = "wavelength") -> DataFrame:
    """``centers`` with lo and hi: midpoints to the neighbours, half a step beyond the ends; an error for a single center."""
    w = Window.partitionBy(by).orderBy(wave)
    c, prev, nxt = F.col(wave), F.lag(wave).over(w), F.lead(wave).over(w)
    half = lambda a, b: (a + b) / 2
    lone = F.raise_error(F.lit("two centers at least are needed")).cast("double")
    lo = F.when(prev.isNotNull(), half(prev, c)).when(nxt.isNotNull(), c - (nxt - c) / 2).otherwise(lone)
    hi = F.when(nxt.isNotNull(), half(c, nxt)).when(prev.isNotNull(), c + (c - prev) / 2).otherwise(lone)
    return centers.withColumn("lo", lo).withColumn("hi", hi)


def wave_steps(waves: DataFrame, by: str = "spec_id", wave: str = "wavelength") -> DataFrame:
    w = Window.partitionBy(by).orderBy(wave)
    return waves.withColumn("step", F.col(wave) - F.lag(wave).over(w)).where("step is not null")


def _median(df: DataFrame, value: str, held: int = HELD) -> DataFrame:
    """The exact median of a column in one row: equal values are counted first; up to ``held`` different ones are one
    aggregate's, more are placed by ranges, never in one task."""
    counts = written(df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), "steps")
    if counts.count() <= held:
        return counts.agg(F.percentile(value, F.lit(0.5), F.col("_n")).alias(value))
    placed = order_.numbered(counts, value, weight="_n", before="_before")
    total = placed.agg(F.sum("_n").alias("_total"))
    holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n"))
    middle = placed.join(total).where(holds(F.floor((F.col("_total") - 1) / 2)) | holds(F.floor(F.col("_total") / 2)))
    return middle.agg(F.avg(value).alias(value))


def grid_parameters(waves: DataFrame, by: str = "spec_id", wave: str = "wavelength", strategy: str = "median") -> DataFrame:
    """One row (g0, step, n) of a uniform grid from the least to the largest wavelength, by the median or mean of all steps."""
    if strategy not in ("median", "mean"):
        raise ValueError(f"unknown strategy: {strategy}")
    steps = wave_steps(waves, by, wave)
    steps = _median(steps, "step") if strategy == "median" else steps.agg(F.avg("step").alias("step"))
    ends = waves.agg(F.min(wave).alias("g0"), F.max(wave).alias("g1"))
    return ends.join(steps).select("g0", "step", (F.floor((F.col("g1") - F.col("g0")) / F.col("step")) + 1).alias("n"))


def grid(waves: DataFrame, by: str = "spec_id", wave: str = "wavelength", strategy: str = "median") -> DataFrame:
    """(bin, center) of the common grid."""
    p = grid_parameters(waves, by, wave, strategy)
    return p.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bin"), "g0", "step").select("bin", (F.col("g0") + F.col("bin") * F.col("step")).alias("center"))


def bin_overlaps(inputs: DataFrame, params: DataFrame) -> DataFrame:
    """Input bins (lo, hi) with each bin of a uniform grid that they overlap, by arithmetic on the bin number: adds bin and part."""
    p = inputs.join(F.broadcast(params))  # one row
    at = lambda x: F.floor((x - F.col("g0")) / F.col("step") + 0.5)
    first, last = F.greatest(at(F.col("lo")) - 1, F.lit(0)), F.least(at(F.col("hi")) + 1, F.col("n") - 1)
    rows = p.where(last >= first).withColumn("bin", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    left = F.col("g0") + (F.col("bin") - 0.5) * F.col("step")
    part = (F.least("hi", left + F.col("step")) - F.greatest("lo", left)) / F.col("step")
    return rows.withColumn("part", part).where("part > 0").drop("g0", "n", "step")


def resample(spectra: DataFrame, params: DataFrame) -> DataFrame:
    """Flux-conserving resampling to a uniform grid: (spec_id, y, bin, flux, err).

    flux = sum(f * c), err^2 = sum(err^2 * c^2) with c the overlap over the bin's width; inputs that are missing or have
    no positive error add nothing; bins without a good input are missing. Partly covered bins are not scaled up.
    """
    line = edges(spectra.select(F.struct("spec_id", "y").alias("line"), "spec_id", "y", "wavelength", "flux", "err"), "line").drop("line")
    o = bin_overlaps(line, params)
    good = F.col("flux").isNotNull() & ~F.isnan("flux") & (F.abs("flux") != float("inf")) & (F.col("err") > 0) & ~F.isnan("err") & (F.col("err") != float("inf"))
    f, e = F.when(good, F.col("flux") * F.col("part")), F.when(good, F.pow(F.col("err") * F.col("part"), 2))
    return o.groupBy("spec_id", "y", "bin").agg(F.sum(f).alias("flux"), F.sqrt(F.sum(e)).alias("err"))


def resample_to(spectra: DataFrame, centers: DataFrame, width: float) -> DataFrame:
    """As ``resample``, to any grid ``centers`` (bin, wavelength): overlaps by an equi-join on pieces of ``width``."""
    line = edges(spectra.select(F.struct("spec_id", "y").alias("line"), "spec_id", "y", "wavelength", "flux", "err"), "line").drop("line", "wavelength")
    out = edges(centers.select(F.lit(0).alias("one"), "bin", "wavelength"), "one").select("bin", F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    met = line.withColumn("cell", cells("lo", "hi")).join(out.withColumn("cell", cells("blo", "bhi")), "cell")
    home = F.floor(F.greatest("lo", "blo") / width) == F.col("cell")
    met = met.where(home).withColumn("part", (F.least("hi", "bhi") - F.greatest("lo", "blo")) / (F.col("bhi") - F.col("blo"))).where("part > 0")
    good = F.col("flux").isNotNull() & ~F.isnan("flux") & (F.abs("flux") != float("inf")) & (F.col("err") > 0) & ~F.isnan("err") & (F.col("err") != float("inf"))
    f, e = F.when(good, F.col("flux") * F.col("part")), F.when(good, F.pow(F.col("err") * F.col("part"), 2))
    return met.groupBy("spec_id", "y", "bin").agg(F.sum(f).alias("flux"), F.sqrt(F.sum(e)).alias("err"))


def combine_mean(spectra: DataFrame, sigma_clip: float = 3.0, by: tuple[str, ...] = ("y", "bin")) -> DataFrame:
    """Mean weighted by 1/err^2 with one clip pass at ``sigma_clip`` weighted deviations: (*by, flux, err, n).

    The window sums and the final sums share their keys, so there is one shuffle.
    """
    w = Window.partitionBy(*by)
    good = spectra.where(F.col("flux").isNotNull() & (F.col("err") > 0)).withColumn("w", 1 / F.pow("err", 2))
    m = good.withColumn("m", F.sum(F.col("w") * F.col("flux")).over(w) / F.sum("w").over(w))
    s = m.withColumn("s", F.sqrt(F.sum(F.col("w") * F.pow(F.col("flux") - F.col("m"), 2)).over(w) / F.sum("w").over(w)))
    kept = s.where(F.abs(F.col("flux") - F.col("m")) <= sigma_clip * F.col("s"))
    return kept.groupBy(*by).agg((F.sum(F.col("w") * F.col("flux")) / F.sum("w")).alias("flux"), F.sqrt(1 / F.sum("w")).alias("err"), F.count(F.lit(1)).alias("n"))


def combine_median(spectra: DataFrame, by: tuple[str, ...] = ("y", "bin"), held: int = HELD) -> DataFrame:
    """Median, with the scaled MAD over the root of the count as error; bins without a value are missing."""
    keys = list(by)
    n = spectra.groupBy(*by).agg(F.count("flux").alias("n"))
    largest = most_held(n)
    med = quantiles(spectra, by, "flux", {"m": 0.5}, held, largest)
    dev = spectra.select(*by, "flux").join(med, keys).withColumn("d", F.abs(F.col("flux") - F.col("m")))
    out = n.join(med, keys, "left").join(quantiles(dev, by, "d", {"mad": 0.5}, held, largest), keys, "left")
    return out.select(*by, F.col("m").alias("flux"), F.when(F.col("n") > 0, F.col("mad") * MAD_ROUNDED / F.sqrt("n")).alias("err"), "n")


def resample_and_combine(spectra: DataFrame, method: str = "mean", strategy: str = "median", sigma_clip: float = 3.0) -> DataFrame:
    """Common grid, resampling and combination: (y, bin, center, flux, err, n)."""
    if method not in ("mean", "median"):
        raise ValueError(f"unknown method: {method}")
    params = grid_parameters(spectra.select("spec_id", "wavelength").distinct(), strategy=strategy)
    r = resample(spectra, params)
    out = combine_mean(r, sigma_clip) if method == "mean" else combine_median(r)
    return out.join(F.broadcast(params.drop("n"))).select("y", "bin", (F.col("g0") + F.col("bin") * F.col("step")).alias("center"), "flux", "err", "n")


def cutout(pixels: DataFrame, trace: DataFrame, height: int, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows about a trace (image_id, source_id, x, y_trace, wavelength): (image_id, source_id, x, row, wave_no, wavelength, flux, err).

    Row 0 is ``height // 2`` under the trace, rounded half to even; rows outside the image are missing; sources without any
    pixel in the image do not appear. wave_no is a sample's place from 0 in the order of its row's wavelengths. Columns in ``also`` tell
    apart cut-outs of the same source.
    """
    own = [*also, "image_id", "source_id"]
    t = trace.withColumn("y0", (F.bround("y_trace") - height // 2).cast("long"))
    rows = t.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("y", F.col("y0") + F.col("row"))
    got = rows.join(pixels.select("image_id", "x", "y", "sci", "err", F.lit(1).alias("_in")), ["image_id", "x", "y"], "left")
    covered = got.where("_in = 1").select(*own).distinct()
    order = F.row_number().over(Window.partitionBy(*own, "row").orderBy("wavelength", "x")) - 1
    return got.join(covered, own, "left_semi").select(*own, "x", "row", order.alias("wave_no"), "wavelength", F.col("sci").alias("flux"), F.col("err"))


def extract(exposures: DataFrame, pixels: DataFrame, traces: DataFrame, targets: DataFrame, height: int, pupil: str = "GRISMR") -> DataFrame:
    """For each of ``targets`` (id, ra, dec) the cut-outs of all exposures of ``pupil`` whose footprint holds an end of the
    spectrum in the exposure nearest to the target.

    Targets of one id at several places have the cut-outs of all of them. ``exposures``: ord, image_id, pupil, vertices; ``traces`` has the sky position (sx, sy) of each trace point. The nearest
    exposure and the footprints about the ends are found by grid cells. An error if no exposure has the pupil.
    """
    from . import spatial

    if pupil != "GRISMR":
        raise ValueError(f"unsupported pupil: {pupil}")
    some = exposures.where(F.col("pupil") == pupil)
    if some.isEmpty():
        raise ValueError(f"no exposures with pupil {pupil}")
    nearest = spatial.nearest_footprint(targets.select("id", "ra", "dec"), some, key="ord").join(some.select("ord", "image_id"), "ord").select("id", "image_id")
    at = F.struct("sx", "sy")
    ends = traces.groupBy("image_id").agg(F.min_by(at, "wavelength").alias("a"), F.max_by(at, "wavelength").alias("b"))
    ends = ends.select(F.col("image_id").alias("home"), F.explode(F.array("a", "b")).alias("e")).select("home", "e.sx", "e.sy")
    around = spatial.points_in_footprints(ends, some.select("image_id", "vertices"), "sx", "sy").select("home", "image_id").distinct()
    near = nearest.distinct().withColumnRenamed("image_id", "home").join(around, "home").select("id", "image_id").distinct()
    near = written(near, "near", plain=True)
    # a source is cut out once, and its rows come back to each target in one piece, as long as its trace
    rows = ("x", "row", "wave_no", "wavelength", "flux", "err")
    cut = cutout(pixels, traces.join(near.select("image_id").distinct(), "image_id", "left_semi"), height)
    cut = written(cut.groupBy("image_id", "source_id").agg(F.collect_list(F.struct(*rows)).alias("cut")), "cutouts", plain=True)
    (near,) = spread(near.count(), ["id", "image_id"], near)
    return near.join(cut, "image_id").select("id", "image_id", "source_id", F.inline("cut"))


def long_rows(lines: DataFrame, columns: tuple[str, ...] = ("wavelength", "flux", "err")) -> DataFrame:
    """Arrays by spectrum row as one row per sample."""
    zipped = F.arrays_zip(*columns)
    return lines.select(*[c for c in lines.columns if c not in columns], F.posexplode(zipped).alias("x", "s")).select("*", *[F.col(f"s.{c}").alias(c) for c in columns]).drop("s")


