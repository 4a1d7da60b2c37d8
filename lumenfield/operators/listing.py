"""Archive listings as DataFrames: search results (filesets) and products (files)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names


def open_products(products: DataFrame, filesets: DataFrame, level: str | None = None, rateints: bool = False) -> DataFrame:
    """Products of filesets that are not private, without time-series rates, of one level if asked."""
    out = products.where(names.product_suffix().isNotNull()) if level is None else products.where(F.col("category") == level)
    if not rateints:
        out = out.where(~F.col("file_suffix").contains("rateint"))
    return out.join(filesets.where(F.col("access") != "private").select(F.col("fileset").alias("dataset")), "dataset", "left_semi")


def without_products(products: DataFrame, filesets: DataFrame, level: str | None = None) -> DataFrame:
    """Filesets that are not private and have no product."""
    have = products if level is None else products.where(F.col("category") == level)
    return filesets.where(F.col("access") != "private").join(have.select(F.col("dataset").alias("fileset")), "fileset", "left_anti")


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def files_per_instrument(products: DataFrame, rateints: bool = True) -> DataFrame:
    """Suffixes times filesets of each instrument."""
    named = products.withColumn("suffix", names.product_suffix())
    if not rateints:
        named = named.where(~F.col("suffix").contains("rateint"))
    suffixes = named.select("instrument_name", "suffix").distinct().groupBy("instrument_name").agg(F.count(F.lit(1)).alias("n_suffixes"))
    sets = named.select("instrument_name", "dataset").distinct().groupBy("instrument_name").agg(F.count(F.lit(1)).alias("n_filesets"))
    return suffixes.join(sets, "instrument_name").withColumn("n_files", F.col("n_suffixes") * F.col("n_filesets"))


def first_contact(df: DataFrame, key: str, order: str) -> DataFrame:
    """First place of each value of ``key`` as text."""
    return df.groupBy(F.col(key).cast("string").alias(key)).agg(F.min(order).alias("first_ord"))


def to_download(products: DataFrame, present: DataFrame) -> DataFrame:
    """Products whose file is not there with the same size (``present``: filename, size)."""
    return products.join(present.select("filename", "size"), ["filename", "size"], "left_anti")


def preview(products: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` files by name with their sizes as text."""
    return products.orderBy("filename").limit(n).select("filename", names.size_text(F.col("size")).alias("size_text"))
