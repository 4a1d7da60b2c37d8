"""Best-fit packing of token sequences by a linear grouping scheme.

1. Documents are tokenised and cut into pieces of at most ``capacity`` tokens; the first piece of a document is the short one.
2. Piece lengths over a third of the capacity are sorted, split into ``groups`` of equal cardinality, and
   rounded up to the longest of their group.
3. A linear programme over the configurations of these few sizes (at most two fit into a sequence), solved by
   column generation, says how often each configuration is used.
4. The real documents of each group take the slots of their group.
5. All other pieces, in descending length, go to the sequence with the least room that holds them.

Scale: pieces are only distinguished by their length, so the plan is made from a histogram of at most
``capacity`` numbers, on runs of like sequences; its size is bounded by the capacity, whatever the number of
documents. A piece finds its place by its rank among the pieces of its length; ranks come from counts by
(task, length), so there is no sort and no group in one task. Token ids never leave the task that made them.

Defined results: a null text is an empty one (one piece with the end token); repeated rows are packed each;
an empty table gives an empty result. Strings of the vocabulary's added tokens in a text become their ids, as in
the ``tokenizers`` library.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import written

PIECE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "piece", "start", "length", "ids_crc32")] + [T.StructField("pid", T.IntegerType()), T.StructField("local", T.LongType())]
)
PIECE_ARROW = pa.schema([(f.name, pa.int32() if f.name == "pid" else pa.int64()) for f in PIECE.fields])


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece; ``local`` numbers the pieces of one length inside the task ``pid``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, seen = tokens.encoding(vocabulary).encode_to_numpy, TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "", allowed_special="all")
                ids = np.append(ids, end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                at = 0
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    n = stop - at
                    rows.append((doc_id, k, at, n, zlib.crc32(ids[at:stop].tobytes()), pid, seen[n]))
                    seen[n] += 1
                    at = stop
            cols = zip(*rows) if rows else [[]] * len(PIECE_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECE_ARROW)], schema=PIECE_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole-number uses of configurations of at most two of ``sizes`` (each over a third of the capacity).

    Revised simplex on the covering programme; a column is priced by the best pair that fits.
    """
    k = len(sizes)
    basis: list[tuple[int, ...]] = [(i,) for i in range(k)]
    inverse, x = np.eye(k), demand.astype(float)
    order = np.argsort(sizes)
    fits = np.searchsorted(sizes[order], capacity - sizes, side="right")  # how many sizes fit beside size i
    for _ in range(60 * k + 100):
        dual = np.ones(k) @ inverse
        best = np.maximum.accumulate(np.concatenate([[0.0], dual[order]]))
        value = dual + best[fits]
        i = int(np.argmax(value))
        if value[i] <= 1 + 1e-9:
            break
        partner = order[: fits[i]]
        j = int(partner[np.argmax(dual[partner])]) if len(partner) and best[fits[i]] > 0 else None
        column = (i,) if j is None else (i, j)
        a = np.zeros(k)
        for c in column:
            a[c] += 1
        d = inverse @ a
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        step = ratio[r]
        x = x - step * d
        x[r] = step
        pivot = inverse[r] / d[r]
        inverse = inverse - np.outer(d, pivot)
        inverse[r] = pivot
        basis[r] = column
    return [(c, int(v + 1e-6)) for c, v in zip(basis, x) if v >= 1]


def plan(counts: dict[int, int], capacity: int = 1024, groups: int = 320) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places by length and rank: rows (length, rank_from, rank_to, sequence, per, offset), and how many sequences.

    The piece of rank r goes to ``sequence + (r - rank_from) // per`` at ``offset + (r - rank_from) % per * length``.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = {}
    n_seq = 0
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences (from, to)

    def take(length: int, n: int, seq: int, per: int, offset: int) -> None:
        lo = used.get(length, 0)
        rows.append((length, lo, lo + n, seq, per, offset))
        used[length] = lo + n

    def free(tokens_left: int, a: int, b: int) -> None:
        if b > a:
            room.setdefault(tokens_left, []).append((a, b))

    if counts.get(capacity):
        take(capacity, counts[capacity], 0, 1, 0)
        n_seq = counts[capacity]
    large = sorted((n for n in counts if capacity / 3 < n < capacity and counts[n]), reverse=True)
    total = sum(counts[n] for n in large)
    if total:
        # equal-cardinality groups over the descending order; a group is a list of (length, how many)
        share = -(-total // groups)
        group: list[list[list[int]]] = [[]]
        filled = 0
        for n in large:
            left = counts[n]
            while left:
                if filled == share:
                    group.append([])
                    filled = 0
                m = min(left, share - filled)
                group[-1].append([n, m])
                filled += m
                left -= m
        sizes = np.array([g[0][0] for g in group])
        demand = np.array([sum(m for _, m in g) for g in group])
        for config, times in configurations(sizes, demand, capacity):
            # the documents of each slot, longest first; runs where no slot changes its length
            left = times
            while left:
                slots = []
                for g in dict.fromkeys(config):
                    if not group[g]:
                        break
                    slots.append((g, config.count(g)))
                if len(slots) < len(set(config)):
                    break
                m = min([left, *(group[g][0][1] // c for g, c in slots)])
                if m == 0:  # a pair of one group whose first length is used up to one piece
                    g = next(g for g, c in slots if group[g][0][1] < c)
                    if len(group[g]) < 2:
                        break
                    pair, (n1, _), (n2, k2) = n_seq, group[g][0], group[g][1]
                    take(n1, 1, pair, 1, 0)
                    take(n2, 1, pair, 1, n1)
                    group[g].pop(0)
                    group[g][0][1] = k2 - 1
                    if not group[g][0][1]:
                        group[g].pop(0)
                    free(capacity - n1 - n2, pair, pair + 1)
                    n_seq += 1
                    left -= 1
                    continue
                offset = 0
                for g, c in slots:
                    n = group[g][0][0]
                    take(n, m * c, n_seq, c, offset)
                    offset += n * c
                    group[g][0][1] -= m * c
                    if not group[g][0][1]:
                        group[g].pop(0)
                free(capacity - offset, n_seq, n_seq + m)
                n_seq += m
                left -= m
    levels = sorted(room)
    for n in sorted((n for n in counts if 0 < n < capacity), reverse=True):
        left = counts[n] - used.get(n, 0)
        while left:
            i = bisect.bisect_left(levels, n)
            if i < len(levels):
                r = levels[i]
                a, b = room[r].pop()
                if not room[r]:
                    del room[r]
                    levels.pop(i)
            else:
                r, a, b = capacity, n_seq, n_seq + -(-left // (capacity // n))
                n_seq = b
            per = r // n
            full = min(b - a, left // per)
            if full:
                take(n, full * per, a, per, capacity - r)
                left -= full * per
            rest = [(r - per * n, a, a + full)]
            if full < b - a:
                extra = left  # under per: into the next sequence of the run
                if extra:
                    take(n, extra, a + full, extra, capacity - r)
                    rest.append((r - extra * n, a + full, a + full + 1))
                    left = 0
                rest.append((r, a + full + bool(extra), b))
            for level, x, y in rest:
                if y > x and level > 0:
                    if level not in room:
                        bisect.insort(levels, level)
                    free(level, x, y)
    return rows, n_seq


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, groups: int = 320) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, capacity, end_id), "pieces")
    by_task = written(cut.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows, _ = plan(histogram, capacity, groups)
    places = spark.createDataFrame(rows, "length long, lo long, hi long, seq long, per long, place long")
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["pid", "length"]).withColumn("rank", F.col("first") + F.col("local"))
    r = F.col("rank") - F.col("lo")
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("seq") + F.floor(r / F.col("per"))).alias("sequence_id"), (F.col("place") + r % F.col("per") * ranked["length"]).alias("offset")
    )
