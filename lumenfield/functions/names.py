"""Names of exposures, filesets and products as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import checked

#: The archive's file name pattern.
BASENAME = r"^jw\d{11}_\d{5}_\d{5}_[^_]+"
FILESET = r"^jw\d{11}_\d{5}_\d{5}"
VISIT = r"^jw\d{11}_\d{5}"
PROPOSAL = r"jw(\d{5})"


def basename(name: Column) -> Column:
    """Leading exposure name; a name that does not match stays as it is."""
    return F.coalesce(F.nullif(F.regexp_extract(name, BASENAME, 0), F.lit("")), name)


def fileset(name: Column) -> Column:
    """Exposure name without its detector; an error where it does not match."""
    found = F.regexp_extract(name, FILESET, 0)
    return checked(found, found != "", "no fileset name")


def visit_prefix(name: Column) -> Column:
    """Visit and sequence part of a name, null where it does not match."""
    return F.nullif(F.regexp_extract(name, VISIT, 0), F.lit(""))


def proposal_id(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, PROPOSAL, 1), F.lit(""))


def expects_wcs(name: Column, force: bool = False) -> Column:
    """Whether a file should carry sky coordinates: neither an uncalibrated nor a rate product, or forced."""
    return (~name.contains("_uncal") & ~name.contains("_rate")) | F.lit(force)


def normal_proposal_id(value: Column) -> Column:
    """Five digits with leading zeros; an error for anything else, also for zeros alone."""
    bare = F.regexp_replace(F.trim(value), "^0+", "")
    return F.lpad(checked(bare, bare.rlike(r"^\d{1,5}$"), "not a proposal id"), 5, "0")


def product_suffix(filename: str = "filename", dataset: str = "dataset") -> Column:
    """What follows the last occurrence of the dataset's name."""
    return F.expr(f"substring_index({filename}, {dataset}, -1)")


def size_text(size: Column) -> Column:
    """Size in MB with two places, 'N/A' where there is none."""
    return F.when(size > 0, F.format_string("%.2f MB", size / 1e6)).otherwise(F.lit("N/A"))
