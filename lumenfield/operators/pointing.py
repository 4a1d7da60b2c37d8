"""Groups of exposures by pointing: overlap graph, components, union outlines, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import polygon
from ..scratch import written
from . import spatial
from .graph import connected_components
from .order import numbered
from .outline import union_outline


def components_of(items: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``items`` with component: the least key of its connected component; items without an edge are their own."""
    comp = connected_components(edges).withColumnRenamed("node", key)
    return items.join(comp, key, "left").withColumn("component", F.coalesce("component", key))


def ordered(centres: DataFrame, key: str = "id", component: str = "component", x: str = "ra", y: str = "dec") -> DataFrame:
    """``centres`` with place: components by their highest declination, downwards; inside by declination downwards,
    then by right ascension about the component's circular mean; ties by the least key.

    Components are numbered by ranges, not in one task; ranks inside a component are of its members only.
    """
    rad = F.radians(F.col(x))
    comp = centres.groupBy(component).agg(F.max(y).alias("top"), F.min(key).alias("least"), F.count(F.lit(1)).alias("n"), F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))).alias("mean"))
    comp = numbered(comp, F.col("top").desc(), F.col("least"), place="component_no", weight="n", before="start").select(component, "mean", "component_no", "start")
    wrapped = F.pmod(F.col(x) - F.col("mean") + 180, F.lit(360.0)) - 180
    inside = Window.partitionBy(component).orderBy(F.col(y).desc(), wrapped, key)
    out = centres.join(comp, component)
    return out.withColumn("place", F.col("start") + F.row_number().over(inside) - 1).drop("mean", "start")


def sort_pointings(centres: DataFrame, eps: float = 0.1, key: str = "id", x: str = "ra", y: str = "dec") -> DataFrame:
    """Components of centres nearer than ``eps`` degrees, ordered; equal positions are not linked directly."""
    pairs = spatial.near_pairs(centres, eps, key, x, y)
    return ordered(components_of(centres, pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), key), key, "component", x, y)


def group_by_pointing(fps: DataFrame, key: str = "fp_id", same: tuple[str, ...] = ("filter",), min_fraction: float = 0.6, eps: float = 0.1, cell: float = 0.05) -> DataFrame:
    """(key, component, group_no): groups of overlapping footprints, numbered in the order of ``sort_pointings`` by the centres of their
    outlines (holes filled, see ``union_outline``). A row without a footprint is an error."""
    fps = fps.withColumn("vertices", F.coalesce("vertices", F.raise_error(F.concat(F.lit("no footprint: "), F.col(key).cast("string"))).cast(polygon.TYPE)))
    fps = written(fps.select(key, *[c for c in same if c != key], "vertices"), "footprints", plain=True)
    pairs = spatial.overlap_pairs(fps, key, same, min_fraction, cell)
    groups = components_of(fps.select(key, "vertices"), pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), key)
    groups = written(groups, "groups", plain=True)
    centres = union_outline(groups, "component").select(F.col("component").alias("id"), F.col("cx").alias("ra"), F.col("cy").alias("dec"))
    placed = sort_pointings(centres, eps).select(F.col("id").alias("component"), F.col("place").alias("group_no"))
    return groups.join(placed, "component").select(key, "component", "group_no")


def product_name(members: DataFrame, group: str, fileset: str = "fileset", filter_: str = "filter", detector: str = "detector") -> DataFrame:
    """(group, name): visit, sequence numbers joined by +, filter and module of the group's members."""
    part = F.split(fileset, "_")
    seq = F.concat_ws("+", F.sort_array(F.collect_set(F.get(part, F.lit(1)))))
    return members.groupBy(group).agg(F.concat_ws("_", F.min(F.get(part, F.lit(0))), seq, F.min(filter_), F.min(F.lower(F.substring(detector, 1, 4)))).alias("name"))


def product_groups(members: DataFrame, group: str, fileset: str = "fileset", detector: str = "detector") -> DataFrame:
    """Groups with the same filesets and module merged: (filesets, module, groups)."""
    keys = members.groupBy(group).agg(F.sort_array(F.collect_set(fileset)).alias("filesets"), F.min(F.substring(detector, 1, 4)).alias("module"))
    return keys.groupBy("filesets", "module").agg(F.sort_array(F.collect_list(group)).alias("groups"))


def associations(members: DataFrame, group: str, path: str = "filename", name: str = "name") -> DataFrame:
    """(group, json): a product definition with the product's name and its members' paths."""
    m = members.groupBy(group, name).agg(F.sort_array(F.collect_list(F.struct(F.col(path).alias("expname"), F.lit("science").alias("exptype")))).alias("members"))
    return m.select(group, F.to_json(F.struct(F.array(F.struct(F.col(name).alias("name"), "members")).alias("products"))).alias("json"))
