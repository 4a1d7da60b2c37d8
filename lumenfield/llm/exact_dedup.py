"""Exact de-duplication over an index of live digests behind cuckoo filters.

A text's key is the SHA-256 digest of the text with each run of ASCII white space as one space. The index holds

* the **members**: a row (digest, ord, rid) for every document that is in it;
* the **content**, in buckets ("shards") of digests: a row for each distinct digest with its first member and number of members;
* for each shard a **cuckoo filter**: four slots a bucket, 16-bit fingerprints, two buckets a digest.

A batch first asks the filters. A miss is new for certain and never meets the stored content; a hit is verified on whole
256-bit digests against the content, so a false positive costs a join row and never an answer. New digests go into their
shard's filter; a filter that overflows (no free slot after ``kicks`` rounds) is built anew, twice the size, from the shard's
stored keys, as fingerprints alone cannot be moved to a larger table. Deletion takes documents out: a digest that keeps
members gets the next of them as its first; one that keeps none leaves content and filter.

Scale: 40-byte rows travel, never texts; copies are summed in the map tasks before the shuffle, so a text that a third of all
documents share is one row for each task; the answer goes back by an equi-join whose large partitions Spark splits. A
shard has about ``shard_keys`` digests, whatever the size of the corpus. Filters and content are tables in the shared folder.

Defined results: null text is empty; a null doc_id counts as the largest; of equal texts exactly one row stays, also where
rows of one doc_id repeat (each is counted in group_size); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_LONG, WORD_SPLIT, discard, unused, written

SLOTS = 4
FILTER = "shard long, buckets long, slots binary"
KEYS = "shard long, digest binary, first struct<ord:long,rid:long>, n long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WORD_SPLIT, " ")


class CuckooFilter:
    """Fingerprints in buckets of four slots; a power of two of buckets. Insertion works on whole arrays, round by round."""

    def __init__(self, buckets: int, slots: bytes | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(buckets, SLOTS).copy()

    @classmethod
    def for_keys(cls, keys: int, load: float = 0.8) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * load))))))

    def slots(self) -> bytes:
        return self.table.tobytes()

    def _prints(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0, which is a free slot) and first bucket, from separate words of the digest."""
        return (digests[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16), (digests[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        mixed = prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
        return at ^ (mixed & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        prints, at = self._prints(digests)
        return (self.table[at] == prints[:, None]).any(1) | (self.table[self._other(at, prints)] == prints[:, None]).any(1)

    def insert(self, digests: np.ndarray, kicks: int = 200) -> bool:
        """Distinct digests that are not in it. False: it overflowed, and must be built anew from the stored keys."""
        prints, at = self._prints(digests)
        for turn in range(kicks):
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, int)
            rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
            free = self.table[at] == 0
            fits = rank < free.sum(1)
            slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            self.table[at[fits], slot[fits]] = prints[fits]
            prints, at = prints[~fits], at[~fits]
            if not len(at):
                return True
            if turn:  # one of each full bucket takes the place of another fingerprint, which moves on
                one = np.r_[True, at[1:] != at[:-1]]
                out = self.table[at[one], turn % SLOTS].copy()
                self.table[at[one], turn % SLOTS] = prints[one]
                prints[one] = out
            at = self._other(at, prints)
        return False

    def delete(self, digests: np.ndarray) -> None:
        """Distinct digests that are in it: one slot of each is freed."""
        for digest in digests:
            prints, at = self._prints(digest[None, :])
            for bucket in (at[0], self._other(at, prints)[0]):
                found = np.flatnonzero(self.table[bucket] == prints[0])
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
            else:
                raise ValueError("a digest to delete is not in the filter")


def _words(keys: pa.Table) -> np.ndarray:
    """The digests as rows of four 64-bit words."""
    return np.frombuffer(b"".join(keys.column("digest").to_pylist()), np.uint64).reshape(-1, 4)


def _filter_of(filters: pa.Table) -> CuckooFilter | None:
    row = filters.to_pylist()
    return CuckooFilter(row[0]["buckets"], row[0]["slots"]) if row else None


def _as_row(shard: int, f: CuckooFilter, ok: bool = True) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "buckets": pa.array([f.buckets], pa.int64()), "slots": pa.array([f.slots() if ok else None], pa.binary())})


class CuckooIndex:
    """Live digests with their members, in ``shards`` buckets; ``room`` is the number of keys that a new filter is made for."""

    def __init__(self, shards: int, room: int = 4096, kicks: int = 200):
        self.shards, self.room, self.kicks = shards, room, kicks
        self.filters: DataFrame | None = None
        self.runs: list[DataFrame] = []  # (shard, digest, first, n, known): content, and what later batches add to it
        self.members: list[DataFrame] = []
        self.resized = 0

    def shard(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.shards)).cast("long")

    def _summed(self, rows: DataFrame) -> DataFrame:
        out = rows.groupBy("digest").agg(F.min(F.struct("ord", "rid")).alias("first"), F.count(F.lit(1)).alias("n"))
        return out.select(self.shard(F.col("digest")).alias("shard"), "digest", "first", "n")

    def content(self) -> DataFrame:
        """The stored keys: (shard, digest), each live digest once."""
        out = None
        for run in self.runs:
            part = run.where(~F.col("known")).select("shard", "digest")
            out = part if out is None else out.unionByName(part)
        return out

    def entries(self) -> DataFrame:
        """(digest, first, n) of each live digest."""
        out = None
        for run in self.runs:
            part = run.select("digest", "first", "n")
            out = part if out is None else out.unionByName(part)
        return out.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``keys`` (shard, digest, first, n) with ``known``: hits of the filters, verified against the content."""
        if self.filters is None:
            return keys.withColumn("known", F.lit(False))

        def probe(filters: pa.Table, asked: pa.Table) -> pa.Table:
            f = _filter_of(filters)
            hit = np.zeros(asked.num_rows, bool) if f is None or not asked.num_rows else f.contains(_words(asked))
            return asked.append_column("hit", pa.array(hit))

        asked = written(self.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(probe, KEYS + ", hit boolean"), "probed")
        stored = self.content().withColumn("_in", F.lit(True))
        hits = asked.where("hit").join(stored, ["shard", "digest"], "left").withColumn("known", F.coalesce("_in", F.lit(False)))
        return asked.where("not hit").withColumn("known", F.lit(False)).drop("hit").unionByName(hits.drop("hit", "_in"))

    def insert(self, rows: DataFrame) -> None:
        """Adds members (digest, ord, rid); rows that were written, as they are read again."""
        run = written(self.lookup(self._summed(rows)), "content")
        self.members.append(rows)
        self.runs.append(run)
        room, kicks = self.room, self.kicks

        def grow(shard: tuple, filters: pa.Table, keys: pa.Table) -> pa.Table:
            f = _filter_of(filters) or CuckooFilter.for_keys(room)
            return _as_row(shard[0].as_py(), f, not keys.num_rows or f.insert(_words(keys), kicks))

        before = self.filters if self.filters is not None else rows.sparkSession.createDataFrame([], FILTER)
        fresh = run.where(~F.col("known")).select("shard", "digest")
        after = written(before.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInArrow(grow, FILTER), "filters", [self.filters] if self.filters is not None else [])
        self.filters = self._resized(after)

    def _resized(self, filters: DataFrame) -> DataFrame:
        """Filters that overflowed are built anew from the stored keys of their shards."""
        full = filters.where(F.col("slots").isNull())
        n = full.count()
        if not n:
            return filters
        self.resized += n
        kicks = self.kicks

        def rebuild(shard: tuple, filters: pa.Table, keys: pa.Table) -> pa.Table:
            buckets, digests = 2 * filters.column("buckets")[0].as_py(), _words(keys)
            while not (f := CuckooFilter(buckets)).insert(digests, kicks):
                buckets *= 2
            return _as_row(shard[0].as_py(), f)

        keys = self.content().join(full.select("shard"), "shard", "left_semi")
        new = full.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(rebuild, FILTER)
        return written(filters.where(F.col("slots").isNotNull()).unionByName(new), "filters", [filters])

    def delete(self, ids: DataFrame) -> None:
        """Takes out all members whose ``ord`` is in ``ids``; a digest without members leaves content and filter."""
        members = None
        for rows in self.members:
            members = rows if members is None else members.unionByName(rows)
        gone = ids.select("ord").distinct()
        touched = written(members.join(gone, "ord", "left_semi").select("digest").distinct(), "touched")
        left = written(members.join(gone, "ord", "left_anti"), "members")
        changed = written(self._summed(left.join(touched, "digest", "left_semi")), "changed")
        entries = self.entries().select(self.shard(F.col("digest")).alias("shard"), "digest", "first", "n")
        content = entries.join(touched, "digest", "left_anti").unionByName(changed).withColumn("known", F.lit(False))
        dead = touched.join(changed, "digest", "left_anti").select(self.shard(F.col("digest")).alias("shard"), "digest")

        def shrink(shard: tuple, filters: pa.Table, keys: pa.Table) -> pa.Table:
            f = _filter_of(filters)
            f.delete(_words(keys))
            return _as_row(shard[0].as_py(), f)

        filters = written(self.filters.groupBy("shard").cogroup(dead.groupBy("shard")).applyInArrow(shrink, FILTER), "filters")
        runs = [written(content, "content")]
        discard(self.filters, *self.runs, *self.members, touched, changed)
        self.filters, self.runs, self.members = filters, runs, [left]


def dedup(docs: DataFrame, carry: list[str] | None = None, batches: int = 4, shard_keys: int = 4096) -> DataFrame:
    """One row per row of ``docs``: its columns ``carry`` (all) and keep_id, group_size, kept, text_sha256.

    Documents go into the index in ``batches`` of ascending doc_id; shards are for ``shard_keys`` digests each if no texts were equal.
    """
    carry = docs.columns if carry is None else carry
    names = {c: f"_c{i}" for i, c in enumerate(carry)}
    place, rid, digest = unused(docs, "_ord", "_rid", "_digest")
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_LONG)).alias(place), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias(digest))
    rows = written(rows.withColumn(rid, F.monotonically_increasing_id()), "digests")  # numbered once, then fixed
    narrow = rows.select(F.col(digest).alias("digest"), F.col(place).alias("ord"), F.col(rid).alias("rid"))
    n, cuts = narrow.agg(F.count(F.lit(1)), F.percentile_approx("ord", [k / batches for k in range(1, batches)], 1000) if batches > 1 else F.lit(None)).first()
    index = CuckooIndex(max(1, -(-n // shard_keys)), max(1, shard_keys // batches))
    bounds = [None, *sorted(set(cuts or [])), None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = narrow
        if lo is not None:
            part = part.where(F.col("ord") > lo)
        if hi is not None:
            part = part.where(F.col("ord") <= hi)
        index.insert(part)
    found = written(index.entries(), "entries")  # a table, so that Spark can split the join with it
    found = found.select("digest", F.col("first.rid").alias("_first"), F.col("first.ord").alias("_keep"), F.col("n").alias("group_size"))
    out = rows.join(found, F.col(digest) == F.col("digest"))
    return out.select(
        *(F.col(n).alias(c) for c, n in names.items()),
        F.nullif(F.col("_keep"), F.lit(MAX_LONG)).alias("keep_id"), "group_size", (F.col(rid) == F.col("_first")).alias("kept"), F.lower(F.hex(digest)).alias("text_sha256"),
    )
