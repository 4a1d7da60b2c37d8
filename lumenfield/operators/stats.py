"""Robust statistics over pixels (image_id, y, x, sci, err, dq); missing values are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .order import numbered

#: Median absolute deviation to standard deviation of a normal distribution: exact, and as combination of spectra rounds it.
MAD_EXACT, MAD_ROUNDED = 1.482602218505602, 1.4826


def finite(c: Column) -> Column:
    """NaN and infinities become null, the engine's missing value."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


#: Values that the aggregates of one task may hold at once: where groups take no more, they have Spark's exact quantile, else they are counted by ranges.
HELD = 1_000_000
#: Groups whose aggregates a task holds at once (``spark.sql.objectHashAggregate.sortBased.fallbackThreshold``); beyond, it sorts and holds one.
AT_ONCE = 128


def most_held(sizes: DataFrame) -> int:
    """Values that a task's aggregates hold at most where groups have the sizes ``n``: all groups may meet in one task."""
    largest, groups = sizes.agg(F.max("n"), F.count(F.lit(1))).first()
    return (largest or 0) * min(groups, AT_ONCE)


def held_at_once(rows: DataFrame, by: tuple[str, ...]) -> int:
    return most_held(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))


def quantiles(rows: DataFrame, by: tuple[str, ...], value: str, at: dict[str, float], held: int = HELD, largest: int | None = None) -> DataFrame:
    """(*by, and a column for each name in ``at``): exact quantiles with linear interpolation of each group's values that are not null.

    Groups of any size: where a task could have to hold more than ``held`` values (``largest``, if that is known), a mergeable sketch gives each
    quantile a bracket, what is under the bracket is only counted, and the values inside are counted and placed by ranges over
    all groups together, so that no aggregate or task holds a group. Groups whose quantile a bracket misses take all their
    values. A group without values does not appear.
    """
    x = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if (held_at_once(x, by) if largest is None else largest) <= held:
        return x.groupBy(*by).agg(*(F.percentile("_v", F.lit(p)).alias(name) for name, p in at.items()))
    asked = list(at.items())
    accuracy = max(100, min(10_000, held // 4))
    margin = 3 / accuracy
    ends = [min(1.0, max(0.0, p + s * margin)) for _, p in asked for s in (-1, 1)]
    groups = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    bracket = [F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), (F.get("_e", F.lit(2 * i)) if ends[2 * i] > 0 else F.col("_min")).alias("lo"), (F.get("_e", F.lit(2 * i + 1)) if ends[2 * i + 1] < 1 else F.col("_max")).alias("hi")) for i, (_, p) in enumerate(asked)]
    groups = written(groups.select(*by, "_n", "_min", "_max", F.explode(F.array(*bracket)).alias("b")).select(*by, "_n", "_min", "_max", "b.*"), "brackets", plain=True)
    found = _in_brackets(x, groups, by)
    missed = found.where("_a is null").select(*by, "i")
    if not missed.isEmpty():
        whole = groups.join(missed, [*by, "i"], "left_semi").withColumns({"lo": F.col("_min"), "hi": F.col("_max")})
        found = written(found.where("_a is not null").unionByName(_in_brackets(x, whole, by)), "quantiles", plain=True)
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("i") == i, F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a")))).alias(name) for i, (name, _) in enumerate(asked)))


def _in_brackets(x: DataFrame, groups: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, i, _a, _b, _f): the two values about place p * (n - 1) of each group and the fraction between them; null where the bracket holds neither."""
    own = [*by, "i"]
    place = F.col("p") * (F.col("_n") - 1)
    groups = groups.select(*own, "lo", "hi", F.floor(place).alias("_k"), (place - F.floor(place)).alias("_f"))
    met = x.join(groups.select(*own, "lo", "hi"), list(by))
    under = met.where("_v < lo").groupBy(*own).agg(F.count(F.lit(1)).alias("_under"))
    counts = met.where("_v between lo and hi").groupBy(*own, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = numbered(counts, *own, "_v", weight="_c", before="_before")
    starts = placed.groupBy(*own).agg(F.min("_before").alias("_start"))
    ranks = placed.join(starts, own).join(groups, own).join(under, own, "left")
    first = F.col("_before") - F.col("_start") + F.coalesce("_under", F.lit(0))
    holds = lambda k: F.when((first <= k) & (k < first + F.col("_c")), F.col("_v"))
    two = ranks.select(*own, "_f", holds(F.col("_k")).alias("_a"), holds(F.col("_k") + (F.col("_f") > 0).cast("int")).alias("_b"))
    two = two.groupBy(*own).agg(F.max("_f").alias("_f"), F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    two = groups.select(*own).join(two, own, "left")
    return written(two.withColumn("_a", F.when(F.col("_b").isNotNull(), F.col("_a"))), "placed", plain=True)


def clipped_stats(pixels: DataFrame, by: tuple[str, ...] = ("image_id",), value: str = "sci", mask: Column | None = None, sigma: float = 3.0, held: int = HELD) -> DataFrame:
    """Mean, population deviation, median and scaled MAD of what is within ``sigma`` MADs of the median; masked values are left out."""
    keys = list(by)
    x = pixels.where(F.col(value).isNotNull() & (F.lit(True) if mask is None else ~mask)).select(*by, F.col(value).alias("v"))
    n = held_at_once(x, by)
    middle = lambda rows, c, name: quantiles(rows, by, c, {name: 0.5}, held, n)
    d = x.join(middle(x, "v", "m"), keys).withColumn("d", F.abs(F.col("v") - F.col("m")))
    s = middle(d, "d", "s")
    kept = d.join(s, keys).where(F.col("d") <= sigma * F.col("s") * MAD_EXACT)
    sums = kept.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    med = middle(kept, "v", "median")
    mad = middle(kept.select(*by, "v").join(med, keys).withColumn("d", F.abs(F.col("v") - F.col("median"))), "d", "mad")
    return sums.join(med, keys).join(mad.withColumn("mad", F.col("mad") * MAD_EXACT), keys)


def axis_medians(pixels: DataFrame, axis: str = "x", value: str = "sci", good: Column | None = None, bin_size: int = 1, held: int = HELD) -> DataFrame:
    """Median of each column (axis x) or row (axis y), then the median of ``bin_size`` neighbours: (image_id, axis, med)."""
    rows = pixels if good is None else pixels.where(good)
    med = quantiles(rows, ("image_id", axis), value, {"med": 0.5}, held)
    if bin_size == 1:
        return med
    binned = med.groupBy("image_id", F.floor(F.col(axis) / bin_size).alias("bin")).agg(F.median("med").alias("bin_med"))
    return med.withColumn("bin", F.floor(F.col(axis) / bin_size)).join(binned, ["image_id", "bin"]).select("image_id", axis, F.col("bin_med").alias("med"))


def divisible(pixels: DataFrame, size_x: int, size_y: int) -> DataFrame:
    """(image_id, width, height), an error if a side is not a multiple of its size."""
    shape = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    bad = (F.col("width") % size_x != 0) | (F.col("height") % size_y != 0)
    return shape.withColumn("width", F.when(bad, F.raise_error(F.lit("image sides are not multiples of the tile"))).otherwise(F.col("width")))


def tile_medians(pixels: DataFrame, mask: Column, block: int = 128, size_x: int | None = None, size_y: int | None = None, fraction: float = 0.5, value: str = "sci", partial: bool = True) -> DataFrame:
    """(image_id, ty, tx, med) of tiles with at most ``fraction`` of block^2 pixels masked (also where tiles have other sides).

    Without ``partial`` an image whose sides are not multiples of the tile's is an error; with it, tiles at its ends are smaller.
    """
    sx, sy = size_x or block, size_y or block
    if not partial:
        pixels = pixels.join(divisible(pixels, sx, sy).where("width > 0 and height > 0").select("image_id"), "image_id")
    bad = F.coalesce(mask, F.lit(False)) | F.col(value).isNull()
    t = pixels.groupBy("image_id", F.floor(F.col("y") / sy).alias("ty"), F.floor(F.col("x") / sx).alias("tx"))
    t = t.agg(F.count_if(bad).alias("masked"), F.median(F.when(~bad, F.col(value))).alias("med"))
    return t.where((F.col("masked") <= fraction * block * block) & F.col("med").isNotNull()).select("image_id", "ty", "tx", "med")


def percentiles(pixels: DataFrame, by: tuple[str, ...] = ("image_id",), value: str = "sci", low: float = 0.01, high: float = 0.99, exact: bool = True, held: int = HELD) -> DataFrame:
    """Display range of the planes of each group, exact with linear interpolation or approximate; null where a group has no values."""
    if exact:
        return pixels.select(*by).distinct().join(quantiles(pixels, by, value, {"p_low": low, "p_high": high}, held), list(by), "left")
    return pixels.groupBy(*by).agg(*(F.percentile_approx(value, F.lit(p), 100_000).alias(name) for name, p in (("p_low", low), ("p_high", high))))
