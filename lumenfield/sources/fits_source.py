"""FITS files as a Spark data source: ``spark.read.format("fits")`` after ``register``.

    register(spark)
    spark.read.format("fits").load(folder)                              # a row for each header and data unit
    spark.read.format("fits").option("read", "tiles").load(folder)      # tiles of image planes, a task for each file and plane

A header scan reads header blocks of 2880 bytes and seeks over the data; columns that the schema given with ``schema()`` leaves out
are not looked up. A tile scan seeks to its plane and reads bands of ``tile`` rows, so a task holds one band of any image; planes that
the option ``planes`` leaves out have no tasks. (Filters are not pushed: Spark 4.1 keeps what a Python source once took of a filter for later
queries of the same DataFrame without it, which would lose rows.)

Options: ``wildcard`` (default ``*.fits``), ``recursive`` (true), ``files`` in a task of a header scan (64), ``planes`` (``SCI,ERR,DQ``),
``tile`` (128). Paths are any that Arrow's file systems open (local, s3, gs, hdfs), with folders listed by the driver as for Spark's own
sources; for stores that only Spark's readers reach, ``fits.files`` gives the same through the binary file source.

Defined results: a folder without matches gives no rows; a file that is no FITS file, or ends inside a header, gives the units
before that; a plane that a file lacks gives no tiles; data cut short is an error that names the file.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import names
from .fits import FORMATS, walk

#: Header keyword of each column of a header scan.
KEYWORDS = {
    "filter": "FILTER", "detector": "DETECTOR", "pupil": "PUPIL", "extname": "EXTNAME", "bitpix": "BITPIX", "width": "NAXIS1", "height": "NAXIS2",
    "crpix1": "CRPIX1", "crpix2": "CRPIX2", "crval1": "CRVAL1", "crval2": "CRVAL2", "cd11": "CD1_1", "cd12": "CD1_2", "cd21": "CD2_1", "cd22": "CD2_2",
}
WCS = ("crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22")
UNITS = "filepath string, unit int, start long, bytes long, filter string, detector string, pupil string, extname string, bitpix int, width long, height long, " + ", ".join(f"{c} double" for c in WCS)
TILES = "filepath string, plane string, y0 long, x0 long, width long, values array<double>"


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Plane(InputPartition):
    path: str
    plane: str


def _open(path: str) -> pa.NativeFile:
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def listed(folder: str, wildcard: str = "*.fits", recursive: bool = True) -> list[str]:
    """URIs of a folder's files that match, in order; a path of a file is that file."""
    store, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    head = folder[: len(folder) - len(at)] if folder.endswith(at) else ("file://" if isinstance(store, fs.LocalFileSystem) else "")
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        found = [f for f in store.get_file_info(fs.FileSelector(at, recursive=recursive)) if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, wildcard)]
    return sorted((head or "file://") + f.path for f in found)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def _files(self) -> list[str]:
        return listed(self.options["path"], self.options.get("wildcard", "*.fits"), str(self.options.get("recursive", "true")).lower() == "true")


class HeaderReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        paths, n = self._files(), int(self.options.get("files", 64))
        return [Files(paths[i : i + n]) for i in range(0, len(paths), n)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        kinds = {f.name: f.dataType.simpleString() for f in self.schema}
        cast = {"string": str, "double": float, "int": int, "bigint": int}

        for path in partition.paths:
            with _open(path) as file:

                def block(at: int, n: int, file=file) -> bytes:
                    if at >= file.size():
                        return b""
                    file.seek(at)
                    return file.read(n)

                for unit, (head, start, size) in enumerate(walk(block)):
                    fixed = {"filepath": path, "unit": unit, "start": start, "bytes": size}
                    values = {c: fixed[c] if c in fixed else head.get(KEYWORDS[c]) for c in kinds}
                    yield tuple(None if v is None else cast[kinds[c]](v) for c, v in values.items())


class TileReader(_Reader):
    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.planes = [p.strip().upper() for p in options.get("planes", "SCI,ERR,DQ").split(",")]

    def partitions(self) -> list[InputPartition]:
        return [Plane(path, plane) for path in self._files() for plane in self.planes] or [Plane("", "")]

    def read(self, partition: Plane) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        tile, path = int(self.options.get("tile", 128)), partition.path
        with _open(path) as file:

            def block(at: int, n: int) -> bytes:
                if at >= file.size():
                    return b""
                file.seek(at)
                return file.read(n)

            for head, start, _ in walk(block):
                if str(head.get("EXTNAME", "")).upper() != partition.plane or head.get("NAXIS") != 2:
                    continue
                w, h, kind = head["NAXIS1"], head["NAXIS2"], np.dtype(FORMATS[head["BITPIX"]])
                for y in range(0, h, tile):
                    n = min(tile, h - y)
                    file.seek(start + y * w * kind.itemsize)
                    data = file.read(n * w * kind.itemsize)
                    if len(data) < n * w * kind.itemsize:
                        raise ValueError(f"{path} ends inside the data of {partition.plane}")
                    band = np.frombuffer(data, kind).reshape(n, w).astype(float) * head.get("BSCALE", 1) + head.get("BZERO", 0)
                    yield self._batch(path, partition.plane, y, band, tile)

    def _batch(self, path: str, plane: str, y: int, band: np.ndarray, tile: int) -> pa.RecordBatch:
        parts = [band[:, x : x + tile] for x in range(0, band.shape[1], tile)]
        flat = np.concatenate([p.ravel() for p in parts])
        ends = np.cumsum([0] + [p.size for p in parts])
        columns = {
            "filepath": lambda: pa.array([path] * len(parts)), "plane": lambda: pa.array([plane] * len(parts)), "y0": lambda: pa.array([y] * len(parts), pa.int64()),
            "x0": lambda: pa.array(range(0, band.shape[1], tile), pa.int64()), "width": lambda: pa.array([p.shape[1] for p in parts], pa.int64()),
            "values": lambda: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, mask=np.isnan(flat))),
        }
        return pa.RecordBatch.from_arrays([columns[f.name]() for f in self.schema], [f.name for f in self.schema])


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return TILES if self.options.get("read") == "tiles" else UNITS

    def reader(self, schema: StructType) -> DataSourceReader:
        return (TileReader if self.options.get("read") == "tiles" else HeaderReader)(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(FitsSource)


def exposures(spark: SparkSession, folder: str, stage: str, wildcard: str = "*.fits") -> DataFrame:
    """The rows of ``fits.headers`` by header blocks alone: a file's first value of each keyword, the shape of its first image."""
    register(spark)
    units = spark.read.format("fits").option("wildcard", wildcard).load(folder)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("unit"))).alias(c)
    image = F.when(F.col("height").isNotNull(), F.col("unit"))
    shape = [F.min_by(c, image).alias(c) for c in ("width", "height")]
    out = units.groupBy("filepath").agg(first("filter"), first("detector"), first("pupil"), *shape, *(first(c) for c in WCS))
    name = F.element_at(F.split("filepath", "/"), -1)
    return out.withColumn("basename", names.basename(name)).withColumn("stage", F.lit(stage)).withColumn("expects_wcs", names.expects_wcs(name))


def tiles(spark: SparkSession, folder: str, wildcard: str = "*.fits", planes: tuple[str, ...] = ("SCI", "ERR", "DQ"), tile: int = 128) -> DataFrame:
    """The rows of ``fits.planes``, a task for each file and plane."""
    register(spark)
    return spark.read.format("fits").options(read="tiles", wildcard=wildcard, planes=",".join(planes), tile=tile).load(folder)
