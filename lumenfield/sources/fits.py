"""FITS files as DataFrames: header and image planes, read in tasks from Spark's binary file source."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

#: Fixed values of the FITS standard: block and card sizes, number formats.
BLOCK, CARD = 2880, 80
FORMATS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def files(spark: SparkSession, folder: str, wildcard: str = "*.fits", content: bool = True) -> DataFrame:
    """Files of a folder that match the wildcard: path, modificationTime, length and, if asked, content."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", wildcard).option("recursiveFileLookup", "true").load(folder)
    return df if content else df.drop("content")


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        end = text.find("'", 1)
        while end >= 0 and text[end : end + 2] == "''":
            end = text.find("'", end + 2)
        return text[1 : end if end > 0 else None].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text or None


def walk(read: Callable[[int, int], bytes]) -> Iterator[tuple[dict, int, int]]:
    """(header, start of data, bytes of data) of each header and data unit; ``read(at, n)`` is asked for header blocks only."""
    at, block = 0, read(0, BLOCK)
    while len(block) == BLOCK:
        head, done = {}, False
        while not done and len(block) == BLOCK:
            for i in range(0, BLOCK, CARD):
                card = block[i : i + CARD].decode("ascii", "replace")
                name = card[:8].strip()
                if name == "END":
                    done = True
                    break
                if card[8:10] == "= " and name not in head:
                    head[name] = _value(card[10:])
            at += BLOCK
            if not done:
                block = read(at, BLOCK)
        if not done:
            return
        n = abs(head.get("BITPIX", 8)) // 8 * head.get("GCOUNT", 1)
        axes = [head.get(f"NAXIS{k}", 0) for k in range(1, head.get("NAXIS", 0) + 1)]
        size = n * (math.prod(axes) + head.get("PCOUNT", 0)) if axes else 0
        yield head, at, size
        at += -(-size // BLOCK) * BLOCK
        block = read(at, BLOCK)


def units(data: bytes) -> Iterator[tuple[dict, int, int]]:
    """``walk`` over the bytes of a file."""
    return walk(lambda at, n: data[at : at + n])


def headers(files_: DataFrame, stage: str) -> DataFrame:
    """Exposures: basename, filter, detector, pupil, stage, filepath, width, height and the linear sky solution where there is one."""
    wcs = ("crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                all_: dict = {}
                shape = (None, None)
                for head, _, _ in units(bytes(data)):
                    all_ = head | all_
                    if shape == (None, None) and head.get("NAXIS", 0) >= 2:
                        shape = (head["NAXIS1"], head["NAXIS2"])
                get = lambda k: None if all_.get(k) is None else float(all_[k])  # noqa: B023, E731
                sky = [get(k) for k in ("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2", "CD1_1", "CD1_2", "CD2_1", "CD2_2")]
                rows.append([path, all_.get("FILTER"), all_.get("DETECTOR"), all_.get("PUPIL"), *shape, *sky])
            yield pd.DataFrame(rows, columns=["filepath", "filter", "detector", "pupil", "width", "height", *wcs])

    schema = "filepath string, filter string, detector string, pupil string, width long, height long, " + ", ".join(f"{c} double" for c in wcs)
    out = files_.select("path", "content").mapInPandas(run, schema)
    name = F.element_at(F.split("filepath", "/"), -1)
    return out.withColumn("basename", names.basename(name)).withColumn("stage", F.lit(stage)).withColumn("expects_wcs", names.expects_wcs(name))


def planes(files_: DataFrame, tile: int = 128) -> DataFrame:
    """Tiles of the SCI, ERR and DQ planes: (filepath, plane, y0, x0, width, values)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                data, rows = bytes(data), []
                for head, at, size in units(data):
                    name = str(head.get("EXTNAME", "")).upper()
                    if name not in ("SCI", "ERR", "DQ") or head.get("NAXIS") != 2:
                        continue
                    w, h = head["NAXIS1"], head["NAXIS2"]
                    image = np.frombuffer(data, FORMATS[head["BITPIX"]], w * h, at).reshape(h, w).astype(float)
                    image = image * head.get("BSCALE", 1) + head.get("BZERO", 0)
                    for y in range(0, h, tile):
                        for x in range(0, w, tile):
                            part = image[y : y + tile, x : x + tile]
                            rows.append((path, name, y, x, part.shape[1], [None if v != v else v for v in part.ravel().tolist()]))
                yield pd.DataFrame(rows, columns=["filepath", "plane", "y0", "x0", "width", "values"])

    return files_.select("path", "content").mapInPandas(run, "filepath string, plane string, y0 long, x0 long, width long, values array<double>")


def pixels(tiles: DataFrame, image: str = "filepath") -> DataFrame:
    """Long-form pixels (image_id, y, x, sci, err, dq) of tiles; dq is a long, as flags are unsigned 32-bit."""
    p = tiles.select(F.col(image).alias("image_id"), "plane", "y0", "x0", "width", F.posexplode("values").alias("i", "v"))
    p = p.select("image_id", "plane", (F.col("y0") + F.floor(F.col("i") / F.col("width"))).alias("y"), (F.col("x0") + F.col("i") % F.col("width")).alias("x"), "v")
    pick = lambda n: F.max(F.when(F.col("plane") == n, F.col("v")))
    return p.groupBy("image_id", "y", "x").agg(pick("SCI").alias("sci"), pick("ERR").alias("err"), pick("DQ").cast("long").alias("dq"))
