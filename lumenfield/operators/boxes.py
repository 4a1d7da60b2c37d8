"""The catalogue of exposures ("box") as a DataFrame: one row per exposure and stage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.columns import all_of, any_of
from ..scratch import written
from . import order as order_

ATTRIBUTES = ("filter", "detector", "pupil")


def named(files: DataFrame, filename: str = "filename") -> DataFrame:
    """Adds basename, fileset, proposal_id and expects_wcs from file names."""
    c = F.col(filename)
    return files.withColumns({"basename": names.basename(c), "fileset": names.fileset(c), "proposal_id": names.proposal_id(names.basename(c)), "expects_wcs": names.expects_wcs(c)})


def summary(box: DataFrame) -> DataFrame:
    """Files by pupil, filter and detector."""
    return box.groupBy("pupil", "filter", "detector").agg(F.count(F.lit(1)).alias("n_files"))


def summary_tree(box: DataFrame) -> DataFrame:
    """The summary with one row per pupil: filters, each with its detectors and counts, all sorted."""
    detectors = summary(box).groupBy("pupil", "filter").agg(F.sort_array(F.collect_list(F.struct("detector", "n_files"))).alias("detectors"))
    return detectors.groupBy("pupil").agg(F.sort_array(F.collect_list(F.struct("filter", "detectors"))).alias("filters"))


def summary_rollup(box: DataFrame) -> DataFrame:
    """The summary with subtotals; the totals have nulls for what they sum over."""
    return box.rollup("pupil", "filter", "detector").agg(F.count(F.lit(1)).alias("n_files"))


def _condition(box: DataFrame, condition: dict[str, Iterable]) -> Column:
    unknown = set(condition) - set(box.columns)
    if unknown:
        raise ValueError(f"unknown attributes: {sorted(unknown)}")
    return all_of([F.col(k).isin(list(v) if not isinstance(v, str) else [v]) for k, v in condition.items()])


def select(box: DataFrame, condition: dict[str, Iterable] | None = None, predicate: Column | None = None) -> DataFrame:
    """Rows that meet all of ``condition`` (any of its values per attribute), and those that meet ``predicate``; no row twice."""
    if condition is None and predicate is None:
        raise ValueError("a condition or a predicate is needed")
    parts = [] if condition is None else [_condition(box, condition)]
    if predicate is not None:
        parts.append(F.coalesce(predicate, F.lit(False)))
    return box.where(any_of(parts))


def numbered(box: DataFrame, order: str = "exposure_id") -> DataFrame:
    """``box`` with its order as a dense number from 0 (column ord)."""
    return order_.numbered(box, order)


def at(box: DataFrame, key: int | str | slice | list) -> DataFrame:
    """Lookup by place, name, slice, list of places, list of names or list of booleans (``box`` has ord and basename)."""
    if isinstance(key, bool):
        raise TypeError("a single boolean is no key")
    if isinstance(key, int):
        return at(box, [key])
    if isinstance(key, str):
        return box.where(F.col("basename") == names.basename(F.lit(key)))
    n = None

    def size() -> int:
        nonlocal n
        n = box.count() if n is None else n
        return n

    if isinstance(key, slice):
        start, stop, step = key.start, key.stop, key.step or 1
        if step < 0 or (start or 0) < 0 or (stop is not None and stop < 0):
            start, stop, step = key.indices(size())
            places = range(start, stop, step)
            lo, hi = (places[0], places[-1]) if places else (1, 0)
            return box.where(F.col("ord").between(min(lo, hi), max(lo, hi)) if places else F.lit(False)).where((F.col("ord") - lo) % abs(step) == 0)
        out = box.where(F.col("ord") >= (start or 0))
        out = out if stop is None else out.where(F.col("ord") < stop)
        return out.where((F.col("ord") - (start or 0)) % step == 0)
    kinds = {type(k) for k in key}
    if kinds <= {bool} and key:
        if len(key) != size():
            raise ValueError("a mask needs one value per exposure")
        key = [i for i, k in enumerate(key) if k]
    elif kinds <= {str}:
        spark = box.sparkSession
        wanted = spark.createDataFrame([(k,) for k in key], "k string").select(names.basename(F.col("k")).alias("basename")).distinct()
        return box.join(wanted, "basename", "left_semi")
    elif not kinds <= {int}:
        raise TypeError("a list of one kind is needed: booleans, names or places")
    if any(k < 0 for k in key):
        key = [k + size() if k < 0 else k for k in key]
    return box.where(F.col("ord").isin(key))


def holds(box: DataFrame, key: str) -> bool:
    """Whether the exact name is in the box."""
    return not box.where(F.col("basename") == key).isEmpty()


def held(box: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (name, any columns) with found: whether the exact name is in the box. A null name is not."""
    names_ = box.select(F.col("basename").alias("name")).where("name is not null").distinct().withColumn("found", F.lit(True))
    return keys.join(names_, "name", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def example(box: DataFrame, target: str) -> DataFrame:
    """Exposures of the target's visit and sequence."""
    return box.where(F.col("basename").contains(names.visit_prefix(F.lit(target))))


def random_target(box: DataFrame, seed: int = 0) -> DataFrame:
    return box.orderBy(F.rand(seed)).limit(1)


def hide(box: DataFrame, hidden: dict[str, Iterable], stage: str | None = None) -> DataFrame:
    """Rows without those that have any hidden value; with ``stage``, only rows of that stage."""
    out = box if stage is None else box.where(F.col("stage") == stage)
    return out.where(~any_of([F.coalesce(F.col(k).isin(list(v)), F.lit(False)) for k, v in hidden.items()]))


def merge(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("basename", "stage"), discard: bool = False) -> DataFrame:
    """Both boxes; where both have an exposure's stage the right side wins. ``discard`` drops exposures that only the right side has."""
    if discard:
        right = right.join(left.select("basename").distinct(), "basename", "left_semi")
    values = [c for c in left.columns if c not in keys]
    sides = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    latest = sides.groupBy(*keys).agg(F.max_by(F.struct(*values), "_side").alias("_v"))
    return latest.select(*keys, "_v.*").select(*left.columns)


def merge_nested(left: DataFrame, right: DataFrame, discard: bool = False) -> DataFrame:
    """Boxes with one row per exposure and a map of stages; the right side's stages win (needs the LAST_WIN map policy)."""
    r = right.select("basename", F.struct(*[c for c in right.columns if c != "basename"]).alias("_r"))
    both = left.join(r, "basename", "left" if discard else "full")
    cols = [F.coalesce(F.col(c), F.col(f"_r.{c}")).alias(c) for c in left.columns if c not in ("basename", "stages")]
    none = F.create_map().cast(left.schema["stages"].dataType)
    return both.select("basename", *cols, F.map_concat(F.coalesce("stages", none), F.coalesce("_r.stages", none)).alias("stages"))


def nested(box: DataFrame, value: Column | str = "filepath") -> DataFrame:
    """One row per exposure with the map stage -> file."""
    return box.groupBy("basename", *ATTRIBUTES).agg(F.map_from_entries(F.collect_list(F.struct("stage", value))).alias("stages"))


def first_stages(box_nested: DataFrame) -> DataFrame:
    """Stages of the first exposure only (least ord)."""
    return box_nested.agg(F.min_by("stages", "ord").alias("stages")).select(F.explode(F.map_keys("stages")).alias("stage"))


def attributes(box: DataFrame, attribute: str) -> DataFrame:
    """(basename, attribute) of each exposure."""
    return box.select("basename", attribute).distinct()


def proposals(box: DataFrame) -> DataFrame:
    return box.select(names.proposal_id(F.col("basename")).alias("proposal_id")).where("proposal_id is not null").distinct()


def sample(box: DataFrame, size: int, attrs: tuple[str, ...] = ("pupil",), seed: int = 0) -> DataFrame:
    """``size`` random rows, one of each combination of ``attrs`` first; all combinations where the size allows. Repeated rows are rows of their own."""
    dealt = written(box.withColumn("_r", F.rand(seed)).withColumn("_id", F.monotonically_increasing_id()), "dealt")
    first = dealt.groupBy(*attrs).agg(F.min(F.struct("_r", "_id")).alias("x")).select(F.col("x._id").alias("_id"), F.lit(0).alias("_first"))
    return dealt.join(first, "_id", "left").orderBy(F.coalesce("_first", F.lit(1)), "_r", "_id").limit(size).select(*box.columns)


def validity(box: DataFrame) -> DataFrame:
    """``box`` with valid: whether filter, detector and pupil are well formed."""
    ok = F.col("filter").rlike("^F[A-Z0-9]+$") & F.col("detector").rlike("^[A-Z0-9]+$") & F.col("pupil").rlike("^[A-Z0-9]+$")
    return box.withColumn("valid", F.coalesce(ok, F.lit(False)))


def add_stage(box: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) rows of ``new``: an exposure that the box has must keep its filter, detector and pupil."""
    known = box.groupBy("basename").agg(*[F.first(a).alias(f"_{a}") for a in ATTRIBUTES])
    both = new.join(known, "basename", "left")
    same = F.col("_filter").isNull() | all_of([F.col(a).eqNullSafe(F.col(f"_{a}")) for a in ATTRIBUTES])
    return both.where(same).select(*new.columns), both.where(~same).select(*new.columns)


def combo_index(box: DataFrame, attrs: tuple[str, ...], colours: int | None = None) -> DataFrame:
    """``box`` with the sorted ordinal of its combination of ``attrs``; an error if there are more than ``colours``."""
    combos = box.select(*attrs).distinct()
    combos = combos.withColumn("combo", F.row_number().over(Window.orderBy(*attrs)) - 1)  # over distinct combinations only
    if colours is not None:
        combos = combos.withColumn("combo", F.when(F.col("combo") < colours, F.col("combo")).otherwise(F.raise_error(F.lit("more combinations than colours"))))
    return box.join(combos, list(attrs))


def stage_footprints(covers: DataFrame, stage: str | None = None) -> DataFrame:
    """Rows (ord, basename, stage, vertices) with a footprint at ``stage``, by default the first stage of the first exposure that has one."""
    have = covers.where(F.col("vertices").isNotNull())
    if stage is None:
        first = have.agg(F.min_by("stage", F.struct("ord", "stage_no")).alias("stage"))
        return have.join(F.broadcast(first), "stage").select(*covers.columns)
    return have.where(F.col("stage") == stage)
