"""Line de-duplication over levelled sorted runs of line hashes, with DataFrame functions only.

Documents arrive in batches of ascending doc_id. Each batch's line keys (128-bit hashes) are merge-joined
with the runs of the earlier batches: keys that a run holds are repeats; the others form a new sorted run on
level 0. When a level has ``fanout`` runs, they are merged into one run of the next level, so that a batch
reads few, long, sorted runs.

Scale: only (doc, position, 16-byte hash) rows are shuffled by key, after a partial aggregation, so a line
that a third of all documents hold costs one row for each map task; the join back is an equi-join whose large
partitions Spark splits. The text moves once, by document.

Defined results: null text is one empty line; keys shorter than ``min_chars`` code points are never dropped;
all rows with one doc_id are one document to the key counts, a null doc_id counts as the largest; repeated rows of one
doc_id and text lose the same lines; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_LONG, SPACE, ascii_lower, unused, written

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Sorted runs of (h1, h2, first), kept by level in the shared folder."""

    def __init__(self, fanout: int = 2):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def keys(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        out = None
        for r in runs:
            out = r if out is None else out.unionByName(r)
        return out

    def add(self, run: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            out = merged[0]
            for r in merged[1:]:
                out = out.unionByName(r)
            self.add(self.sorted_run(out), level + 1)

    @staticmethod
    def sorted_run(df: DataFrame) -> DataFrame:
        return written(df.repartition(*KEY).sortWithinPartitions(*KEY), "run")

    def process(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of (ord, row, pos, h1, h2); returns the (ord, row, pos) that repeat a line of an earlier document."""
        firsts = lines.groupBy(*KEY).agg(F.min("ord").alias("first"))
        known = self.keys()
        if known is not None:
            firsts = firsts.join(known, KEY, "left_anti")
        fresh = written(firsts.sortWithinPartitions(*KEY), "run")
        repeats = lines.join(fresh, KEY, "left").where(F.col("first").isNull() | (F.col("first") < F.col("ord"))).select("ord", "row", "pos")
        repeats = written(repeats, "repeats")
        self.add(fresh)
        return repeats


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with the columns n_lines, n_dropped and kept_text added."""
    key, row, lines_c, drop_c = unused(docs, "_ord", "_row", "_lines", "_drop")
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_LONG))
    text = F.xxhash64("text")  # tells apart the texts of one doc_id
    line = docs.select(order.alias("ord"), text.alias("row"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).select("ord", "row", "pos", line_key(F.col("line")).alias("key"))
    line = line.where(F.length("key") >= min_chars).select("ord", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))
    line = written(line, "lines")
    cuts = line.agg(F.percentile_approx("ord", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    runs, dropped = LineRuns(fanout), None
    for lo, hi in zip(bounds, bounds[1:]):
        part = line
        if lo is not None:
            part = part.where(F.col("ord") > lo)
        if hi is not None:
            part = part.where(F.col("ord") <= hi)
        out = runs.process(part)
        dropped = out if dropped is None else dropped.unionByName(out)
    by_doc = dropped.groupBy(F.col("ord").alias(key), F.col("row").alias(row)).agg(F.collect_set("pos").alias(drop_c))
    joined = docs.withColumn(key, order).withColumn(row, text).join(by_doc.hint("shuffle_hash"), [key, row], "left")
    n = F.size(lines_c)
    keep = F.when(F.col(drop_c).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col(drop_c)), lambda i: F.get(F.col(lines_c), i)), "\n")
    )
    joined = joined.withColumn(lines_c, split_lines(F.col("text")))
    return joined.withColumns({"n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size(drop_c), F.lit(0)).cast("long"), "kept_text": F.coalesce(keep, F.lit(""))}).drop(key, row, lines_c, drop_c)
