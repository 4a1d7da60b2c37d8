"""How the sources of a language differ in their terms: distances between sources, and each source's own terms.

Terms are late materialised. Each task counts the terms of its documents and writes, where it stands, a row for each term of a
language: text, 64-bit digest, documents, and occurrences by source (the *fragments*: no shuffle). What is shuffled to find the
terms that enough documents of their language hold is digests and counts alone. A filter of fixed size, ``FILTER_BITS`` bits, then lets the
fragments of those terms pass (and few others, which an exact join takes out), so that the text of a rare term never leaves its task's file.
The minimum and the maximum of a digest's strings differ just where two terms share it, and only those digests are counted
again by their text. Kept terms have a number from then on; texts come back for the rows of the result alone.

Scale: a task's counts are flushed at ``flush`` entries, so its memory does not grow with the input. A source or term with a
third of all occurrences is one row for each flush. Distances between sources are summed over blocks of ``BLOCK`` terms and tiles of
about ``TILE`` sources in numpy: a group has at most a tile pair of one block, whatever the number of terms or sources, and terms that
neither source has are added by count. The result itself is quadratic in the sources of a language, as asked. Of a group's
terms only those that can reach the top ranks leave the map tasks.

Defined results: null text, lang and source are empty strings; each row is a document, also if it repeats; a text of any length is
counted whole; groups without terms have distances (0 where their language keeps no term) and no term rows; ranks of equal values
follow the UTF-8 order of the items; an empty table gives an empty result. Sums are exact: longs, and decimals where a product may not fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

UNIT = 1_000_000_000
BLOCK, TILE = 256, 48
FILTER_BITS = 1 << 24
#: Bytes of terms stay (letters in lower case, all of non-ASCII characters), every other byte becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _fragments(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    groups: dict[tuple[str, str], Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, docs in held.items():
            place = dict(zip(docs, range(len(docs))))
            own = [(source, n) for (x, source), n in groups.items() if x == lang]
            row = np.concatenate([np.fromiter((place[w] for w in n), np.int64, len(n)) for _, n in own])
            order = np.argsort(row, kind="stable")
            count = np.concatenate([np.fromiter(n.values(), np.int64, len(n)) for _, n in own])[order]
            source = pa.array([s for s, _ in own], pa.string()).take(pa.array(np.repeat(np.arange(len(own)), [len(n) for _, n in own])[order]))
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(docs)))], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (source, pa.array(count))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(docs), pa.string()), pa.array(list(docs), pa.binary()), pa.array(list(docs.values()), pa.int64()), *lists], ["lang", "term", "docs", "sources", "ns"])
        held.clear()
        groups.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            docs, n = held.setdefault(lang, Counter()), groups.setdefault((lang, source), Counter())
            found, size = terms(text), size - len(n)
            n.update(found)
            docs.update(set(found))
            size += len(n)
            if size > flush:
                yield from rows()
                size = 0
    yield from rows()


def fragments(docs: DataFrame, flush: int = 400_000, bits: int = 64) -> DataFrame:
    """(lang, h, docs, term, sources, ns): what each task counted, written in the shared folder. ``bits`` of the digest are used."""
    text = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    out = text.mapInArrow(lambda it: _fragments(it, flush), "lang string, term binary, docs long, sources array<string>, ns array<long>")
    h = F.xxhash64("term")
    return written(out.select("lang", (h if bits == 64 else h.bitwiseAND((1 << bits) - 1)).alias("h"), "docs", F.col("term").cast("string").alias("term"), "sources", "ns"), "fragments")


def _passing(parts: DataFrame, often: DataFrame) -> DataFrame:
    """Fragments whose digest may be one of ``often``: two bits of each digest in a filter of fixed size."""
    places = F.array(F.pmod("h", F.lit(FILTER_BITS)), F.pmod(F.shiftrightunsigned("h", 32), F.lit(FILTER_BITS)))
    place = often.select(F.explode(places).alias("p"))
    word = place.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("b"))  # at most FILTER_BITS / 32 rows
    filled = np.zeros(FILTER_BITS // 32, np.uint32)
    for w, b in word.toLocalIterator():
        filled[w] = b

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1).to_numpy().view(np.uint64)
            at = [(h % np.uint64(FILTER_BITS)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64) % FILTER_BITS]
            yield batch.filter(pa.array(np.logical_and(*[(filled[a >> 5] >> (a & 31).astype(np.uint32) & np.uint32(1)).astype(bool) for a in at])))

    return parts.select("lang", "h", "docs", "term", "sources", "ns").mapInArrow(passing, parts.schema)


def kept_terms(parts: DataFrame, min_docs: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, tid, item) of each language's terms in at least ``min_docs`` documents, and their (lang, source, tid, n)."""
    often = written(parts.groupBy("lang", "h").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "h"), "often")
    near = written(_passing(parts, often).join(often, ["lang", "h"], "left_semi"), "near", [parts])
    strings = written(near.groupBy("lang", "h").agg(F.min("term").alias("lo"), F.max("term").alias("hi")), "strings")
    shared = near.join(strings.where("lo <> hi").select("lang", "h"), ["lang", "h"], "left_semi")
    split = shared.groupBy("lang", "h", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = strings.where("lo = hi").select("lang", "h", F.col("lo").alias("item"), F.lit(False).alias("split"))
    kept = kept.unionByName(split.select("lang", "h", F.col("term").alias("item"), F.lit(True).alias("split")))
    kept = written(kept.withColumn("tid", F.monotonically_increasing_id()), "kept", [strings])  # numbered once, then fixed
    by_source = F.explode(F.arrays_zip("sources", "ns")).alias("c")
    plain = near.select("lang", "h", by_source).groupBy("lang", F.col("c.sources").alias("source"), "h").agg(F.sum("c.ns").alias("n"))
    plain = plain.join(kept.where("not split").select("lang", "h", "tid"), ["lang", "h"])
    again = near.join(kept.where("split").select("lang", "h", F.col("item").alias("term"), "tid"), ["lang", "h", "term"])
    again = again.select("lang", "tid", by_source).groupBy("lang", F.col("c.sources").alias("source"), "tid").agg(F.sum("c.ns").alias("n"))
    cells = plain.select("lang", "source", "tid", "n").unionByName(again.select("lang", "source", "tid", "n"))
    return kept.select("lang", "tid", "item"), written(cells, "cells", [often, near])


def _part(count: str, total: str, distinct: str) -> Column:
    """1 + floor(UNIT * (count + 5) / (total + 5 * distinct)), exactly; null where there are no terms."""
    whole = F.expr(f"(cast({UNIT} as decimal(10,0)) * cast({count} + 5 as decimal(19,0))) div cast({total} + 5 * {distinct} as decimal(19,0))")
    return F.when(F.col(distinct) > 0, 1 + whole)


def _distances(rows: pa.Table) -> pa.Table:
    """Summed differences of a tile pair over the terms of one block that some source here has; rows without tid give each source's p0."""
    lang, lo, hi = (rows.column(c)[0].as_py() for c in ("lang", "lo", "hi"))
    base = rows.filter(rows.column("tid").is_null())
    sources, tile, p0 = base.column("source").to_pylist(), base.column("tile").to_numpy(), base.column("p").to_numpy()
    cells = rows.filter(rows.column("tid").is_valid())
    place = {s: i for i, s in enumerate(sources)}
    tids, column = np.unique(cells.column("tid").to_numpy(), return_inverse=True)
    p = np.repeat(p0[:, None], len(tids), axis=1)
    p[[place[s] for s in cells.column("source").to_pylist()], column] = cells.column("p").to_numpy()
    a_side, b_side = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
    one, other, total = [], [], []
    for a in a_side if len(tids) else ():
        sums = np.abs(p[b_side] - p[a]).sum(axis=1)
        for b, x in zip(b_side, sums.tolist()):
            if a != b:
                one.append(sources[a]), other.append(sources[b]), total.append(x)
                if lo != hi:
                    one.append(sources[b]), other.append(sources[a]), total.append(x)
    n = len(one)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "source": pa.array(one, pa.string()), "item": pa.array(other, pa.string()), "total": pa.array(total, pa.int64()), "n_terms": pa.array([len(tids)] * n, pa.int64())})


def source_distances(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language; ``groups``: lang, source, v, p0; ``cells``: lang, source, tid, p."""
    langs = groups.groupBy("lang").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("s"))
    langs = langs.select("lang", F.ceil(F.col("v") / BLOCK).cast("long").alias("blocks"), F.ceil(F.col("s") / TILE).cast("long").alias("tiles")).where("blocks > 0")
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).alias("tile")
    base = groups.join(langs, "lang").select("lang", "source", tile, "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("tid"), F.col("p0").alias("p"))
    own = cells.join(langs, "lang").select("lang", "source", tile, "tiles", F.pmod(F.xxhash64("tid"), F.col("blocks")).alias("block"), "tid", "p")
    met = base.unionByName(own).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("with"))
    met = met.select("lang", "block", F.least("tile", "with").alias("lo"), F.greatest("tile", "with").alias("hi"), "source", "tile", "tid", "p")
    sums = met.groupBy("lang", "block", "lo", "hi").applyInArrow(_distances, "lang string, source string, item string, total long, n_terms long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("total").alias("total"), F.sum("n_terms").alias("n_terms"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("other_p0"))
    pairs = groups.select("lang", "source", "v", "p0").join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    rest = (F.col("v") - F.coalesce("n_terms", F.lit(0))) * F.abs(F.col("p0") - F.col("other_p0"))  # terms that neither source has
    return pairs.select("lang", "source", "item", (F.coalesce("total", F.lit(0)) + F.coalesce(rest, F.lit(0))).alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, flush: int = 400_000, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, distances to the other sources; part ``term``, terms over the language's share."""
    kept, cells = kept_terms(fragments(docs, flush, bits), min_docs)
    whole = written(cells.groupBy("lang", "tid").agg(F.sum("n").alias("lang_n")), "languages")
    langs = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).cast("long").alias("v"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), "lang_total").withColumn("zero", F.lit(0).cast("long"))
    groups = written(groups.withColumn("p0", _part("zero", "total", "v")), "groups")
    shares = cells.join(groups, ["lang", "source"]).select("lang", "source", "tid", "v", "lang_total", _part("n", "total", "v").alias("p"))
    pairs = source_distances(groups, shares.select("lang", "source", "tid", "p"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value.orderBy(F.col("value").desc(), "item")).alias("rank"))
    over = shares.join(whole, ["lang", "tid"]).select("lang", "source", "tid", (F.col("p") - _part("lang_n", "lang_total", "v")).alias("value")).where("value > 0")
    over = over.withColumn("place", F.rank().over(by_value)).where(F.col("place") <= top).drop("place")  # ties of the last place are settled by text
    over = over.join(kept.select("lang", "tid", "item"), ["lang", "tid"]).withColumn("rank", F.row_number().over(by_value.orderBy(F.col("value").desc(), "item"))).where(F.col("rank") <= top)
    return pairs.unionByName(over.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
