"""The trie of conversation prefixes, with totals of each subtree by a depth-band rollup.

A node is a distinct sequence of turns (role, text) with which some conversation starts; it is known by its depth and two 64-bit
words, each the exclusive or over its turns of a hash of place, role and text. Texts are hashed where they are read and never move.

Subtree totals take bands of ``BAND`` depths. A node explodes to its ancestors inside its band only, and one aggregation completes
what each node holds within the band. The band roots then form a tree of their own, ``BAND`` times lower, which is rolled up in
the same way; its completed totals go to the ancestors in the band above them. A trie of depth D takes log(D) levels of
two aggregations each, and no node more than ``BAND`` rows in each.

Scale: places of turns come from range partitions, not from a window by conversation, and a conversation's prefixes are built in pieces of
``CHUNK`` turns with what stands before a piece carried in, so that one conversation with a third of all turns is dealt over tasks.
A node that a third of all conversations share is one row for each map task. Joins with parents are equi-joins whose large
partitions Spark splits. The ids that end at a node become strings of a batch of ids each in range order; one stream then hashes a
node's strings, a piece at a time (SHA-256 cannot be split further).

Defined results: null role and text are empty; turns of equal rank stand in the order of their hashes, repeated rows are turns of
their own; rows without a conv_id belong to no conversation and are left out; a conversation without turns is a member of
the root only; the multiple below a negative id is the one next to zero (SQL's remainder); an empty table has no root and gives an empty result; texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import written

BAND, CHUNK = 8, 1024
KEY = ["m", "k1", "k2"]


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, t1, t2, chars), places from 0, and conversations (conv_id, n)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(7), role, text).alias("t2"), F.length(text).cast("long").alias("chars"))
    turns = written(numbered(turns, "conv_id", "turn", "t1", "t2"), "turns")  # nulls first
    convs = turns.groupBy("conv_id").agg(F.min("ord").alias("_first"), F.count(F.lit(1)).alias("n"))
    convs = written(convs, "conversations")
    return turns.join(convs, "conv_id").select("conv_id", (F.col("ord") - F.col("_first")).alias("place"), "t1", "t2", "chars"), convs.select("conv_id", "n")


def shared_openings(turns: DataFrame, convs: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of the one whose id is the next lower multiple of ``group``, then the own turns after h.

    h is the CRC-32 of the decimal id modulo ``most``. Returns turns and conversations as ``numbered_turns`` does.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    plan = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = plan.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", taken)
    plan = written(plan.withColumn("own_n", F.greatest(F.col("n") - F.col("h"), F.lit(0))), "plan")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("place >= h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < most - 1)).withColumnRenamed("conv_id", "base")
    heads = heads.join(plan.select("base", "conv_id", "taken"), "base").where("place < taken")
    columns = ["conv_id", "place", "t1", "t2", "chars"]
    return own.select(columns).unionByName(heads.select(columns)), plan.select("conv_id", (F.col("taken") + F.col("own_n")).alias("n"))


def _in_pieces(rows: DataFrame, place: Column, band: int, chunk: int) -> DataFrame:
    """Rows with their piece; the last ``band`` of a piece also lead into the next one."""
    piece = F.floor(place / chunk).cast("long")
    return rows.withColumn("piece", F.explode(F.when(F.pmod(place, F.lit(chunk)) >= chunk - band, F.array(piece, piece + 1)).otherwise(F.array(piece))))


def _above(rows: DataFrame, band: int, chunk: int) -> DataFrame:
    """Rows (conv_id, m, k1, k2, piece) with ``above``, the keys of the ``band`` rows before; leading rows go."""
    w = Window.partitionBy("conv_id", "piece").orderBy("m")
    above = {f"_{k}{i}": F.lag(k, i, 0).over(w) for i in range(1, band + 1) for k in ("k1", "k2")}
    return rows.withColumns(above).where(F.floor((F.col("m") - 1) / chunk) == F.col("piece"))


def _above_names(band: int) -> list[str]:
    return [f"_{k}{i}" for i in range(1, band + 1) for k in ("k1", "k2")]


def prefixes(turns: DataFrame, band: int, chunk: int) -> DataFrame:
    """(conv_id, m, k1, k2, chars, _k11, _k21, ..): every prefix of every conversation, m its depth, with the keys of the depths above it."""
    rows = turns.select("conv_id", (F.col("place") + 1).alias("m"), F.xxhash64("place", "t1").alias("x1"), F.xxhash64("place", "t2").alias("x2"), "chars")
    place = F.col("m") - 1
    # what stands before a piece and its leading rows: one row for each piece of the conversations that have several
    sums = rows.groupBy("conv_id", F.floor((place + band) / chunk).cast("long").alias("piece")).agg(F.bit_xor("x1").alias("c1"), F.bit_xor("x2").alias("c2"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumns({c: F.bit_xor(c).over(earlier) for c in ("c1", "c2")}).where("piece > 0")
    carried = written(carried, "carried")
    rows = _in_pieces(rows, place, band, chunk)
    rows = rows.where("piece = 0").withColumns({"c1": F.lit(0).cast("long"), "c2": F.lit(0).cast("long")}).unionByName(rows.where("piece > 0").join(carried, ["conv_id", "piece"]))
    so_far = Window.partitionBy("conv_id", "piece").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"k1": F.bit_xor("x1").over(so_far).bitwiseXOR(F.col("c1")), "k2": F.bit_xor("x2").over(so_far).bitwiseXOR(F.col("c2"))})
    return _above(rows, band, chunk).drop("piece", "x1", "x2", "c1", "c2")


def _exploded(nodes: DataFrame, first: int, last: Column) -> DataFrame:
    """A row for each ancestor ``first`` to ``last`` steps above a node (0: itself), with the node's totals."""
    band = len([c for c in nodes.columns if c.startswith("_k1")])
    keys = F.array(*(F.struct((F.col("m") - i).alias("m"), F.col(f"_k1{i}" if i else "k1").alias("k1"), F.col(f"_k2{i}" if i else "k2").alias("k2")) for i in range(band + 1)))
    return nodes.select(F.explode(F.slice(keys, F.lit(first + 1), last - first + 1)).alias("key"), "saved", "leaves").select("key.*", "saved", "leaves")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def rolled_up(nodes: DataFrame, rows: DataFrame, deepest: int, band: int, chunk: int) -> DataFrame:
    """Totals (m, k1, k2, saved, leaves) of each node's subtree.

    ``nodes`` have their own values and the keys above them; ``rows`` (conv_id, m, k1, k2) are the prefixes they come from.
    """
    inside = _summed(_exploded(nodes, 0, (F.col("m") % band).cast("int")))
    if deepest < band:
        return inside
    inside = written(inside, "inside")
    # band roots as a tree of their own
    roots = rows.where(F.col("m") % band == 0).select("conv_id", (F.col("m") / band).cast("long").alias("m"), "k1", "k2")
    roots = written(roots, "roots")
    above = _above(_in_pieces(roots, F.col("m") - 1, band, chunk), band, chunk).groupBy(*KEY).agg(*(F.max(c).alias(c) for c in _above_names(band)))
    top = F.lit(0).cast("long")
    own = inside.where(F.col("m") % band == 0).withColumn("m", (F.col("m") / band).cast("long"))
    own = own.join(above, KEY, "left").withColumns({c: F.coalesce(c, top) for c in _above_names(band)})  # the root has none above it
    done = rolled_up(written(own, "band_roots"), roots, deepest // band, band, chunk)
    # completed totals of the band roots go to their ancestors in the band above
    done = done.where("m > 0").withColumn("m", F.col("m") * band).join(nodes.select(*KEY, *_above_names(band)), KEY)
    return _summed(inside.unionByName(_exploded(done, 1, F.lit(band))))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (m, k1, k2, conv_id) to a string of ids for each run of a key in a batch."""
    for batch in batches:
        m, k1, k2, ids = (batch.column(i).to_numpy() for i in range(4))
        if len(ids):
            start = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            joined = [",".join(map(str, x.tolist())) for x in np.split(ids, start[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x[start]) for x in (m, k1, k2, ids)] + [pa.array(joined, pa.string())], [*KEY, "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key and first id to one hash a key; a key's pieces are fed one after the other."""
    at, digest, out = None, None, []

    def ended() -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns[:3]] + [pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if key == at:
                digest.update(b",")
            else:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        if out:
            yield ended()
            out.clear()
    if at is not None:
        out.append((*at, digest.hexdigest()))
        yield ended()


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(m, k1, k2, ends_sha256) of the conversations (m, k1, k2, conv_id) that end at a node."""
    by_id = [*KEY, "conv_id"]
    pieces = ends.select(by_id).repartitionByRange(*by_id).sortWithinPartitions(*by_id).mapInArrow(_pieces, "m long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashes, "m long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, band: int = BAND, chunk: int = CHUNK) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` and ``convs`` are as from ``numbered_turns``; ``band`` is at most ``chunk``.
    """
    zero = F.lit(0).cast("long")
    rows = written(prefixes(turns, band, chunk), "prefixes")
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), *(F.max(c).alias(c) for c in _above_names(band)))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    nodes = nodes.unionByName(root.select("*", *(zero.alias(c) for c in (*KEY, "chars", *_above_names(band)))))
    nodes = written(nodes, "nodes")
    parent = [(F.col("m") - 1).alias("m"), F.col("_k11").alias("k1"), F.col("_k21").alias("k2")]
    children = nodes.where("m > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("chars"), "leaves": (F.col("n_children") == 0).cast("long")})
    nodes = written(nodes, "nodes")
    deepest = nodes.agg(F.max("m")).first()[0] or 0
    totals = rolled_up(nodes, rows.select("conv_id", *KEY), deepest, band, chunk)
    ends = rows.join(convs, "conv_id").where("m = n").select(*KEY, "conv_id").unionByName(convs.where("n = 0").select(*(zero.alias(c) for c in KEY), "conv_id"))
    parents = nodes.select((F.col("m") + 1).alias("m"), F.col("k1").alias("_k11"), F.col("k2").alias("_k21"), F.col("conv_id").alias("parent_conv_id"))
    facts = nodes.select(*KEY, "conv_id", "n_convs", "n_children", "_k11", "_k21").join(totals, KEY).join(ends_hashes(ends), KEY, "left")
    out = written(facts, "facts").join(parents, ["m", "_k11", "_k21"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", F.col("m").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))
