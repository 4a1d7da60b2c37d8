"""Saved boxes and listings."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import names
from ..operators import boxes


def _path(spark: SparkSession, path: str):
    """A path and the file system that it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def load(spark: SparkSession, path: str | None = None, suffix: str | None = None, folder: str = ".", name: str = "box") -> DataFrame:
    """A box of one JSON document, or a saved folder of them (one in a line), as rows; an empty box with a warning where there is none.

    ``suffix`` picks name_suffix.json and counts only when no path is given.
    """
    path = path or f"{folder}/{name}{'_' + suffix if suffix else ''}.json"
    empty = "basename string, filter string, detector string, pupil string, stage string, filepath string, footprint " + schema.FOOTPRINT
    if not _exists(spark, path):
        warnings.warn(f"no box at {path}", stacklevel=2)
        return spark.createDataFrame([], empty)
    p, fs = _path(spark, path)
    doc = spark.read.schema(schema.BOX).json(path, multiLine=not fs.getFileStatus(p).isDirectory())
    info = doc.select(F.explode(F.map_values("infos")).alias("i")).select("i.*")
    cover = info.select("basename", "filter", "detector", "pupil", F.explode("cover_dict").alias("stage", "c"))
    return cover.select("basename", "filter", "detector", "pupil", "stage", "c.filepath", "c.footprint")


def save(box: DataFrame, path: str, force: bool = False) -> None:
    """Writes a folder of JSON lines that ``load`` reads, a document for each exposure, with footprints where ``box`` has them.

    Refuses to replace a box that holds more exposures unless forced. The folder is written aside and then takes the place of
    the old one, so that ``box`` may have been read from ``path``.
    """
    spark = box.sparkSession
    if not force and _exists(spark, path):
        before, now = load(spark, path).select("basename").distinct().count(), box.select("basename").distinct().count()
        if before > now:
            raise ValueError(f"{path} holds {before} exposures, this box {now}")
    if "footprint" not in box.columns:
        box = box.withColumn("footprint", F.lit(None).cast(schema.FOOTPRINT))
    cover = boxes.nested(box, F.struct("filepath", "footprint").alias("cover"))
    info = F.struct("basename", *boxes.ATTRIBUTES, F.col("stages").alias("cover_dict"))
    proposals = F.filter(F.array(names.proposal_id(F.col("basename"))), lambda p: p.isNotNull())
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    cover.select(F.create_map("basename", info).alias("infos"), proposals.alias("proposal_ids")).write.json(aside)
    (old, fs), (new, _) = _path(spark, path), _path(spark, aside)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"the box is in {aside}: it could not be moved to {path}")


def load_saved(spark: SparkSession, path: str) -> DataFrame:
    """What ``save`` wrote, as rows without footprints."""
    return load(spark, path).drop("footprint")


def load_products(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of products, or a saved folder of lines."""
    p, fs = _path(spark, path)
    return spark.read.schema(schema.PRODUCTS).json(path, multiLine=not fs.getFileStatus(p).isDirectory())


def save_products(products: DataFrame, path: str) -> None:
    products.write.mode("overwrite").json(path)


def update_from_folder(box: DataFrame, found: DataFrame) -> DataFrame:
    """The box with a folder's exposures merged in (same columns)."""
    return boxes.merge(box, found.select(*box.columns))
