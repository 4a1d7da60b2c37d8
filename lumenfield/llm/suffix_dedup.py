"""Removal of byte strings that repeat, by column-wise construction of suffix orders over collections.

A window is a string of ``length`` bytes. Each window is assigned to one anchor inside it, the 64-byte string of
least hash (leftmost of equals), so equal windows have equal anchors at equal places in them. A text thus falls into few
contexts, an anchor with all windows assigned to it. Only contexts whose anchor occurs again are looked at further:

* equal contexts repeat as a whole: one of them stands for all;
* the different contexts of an anchor come together, aligned at the anchor, as a collection of short documents.
  Their suffixes are sorted column by column, from the last to the first: each round inserts one symbol per
  document, which permutes the order of the round before (the collection's Burrows-Wheeler step) and updates the
  common prefixes of neighbours as range minima of the former ones plus one. A suffix that shares ``length`` bytes
  with a neighbour starts a window that repeats.

The sequential files of the method are Spark's: the contexts are dealt to tasks by hash of the anchor, on
disk, and each task reads its own. Plain construction over whole texts takes one pass over everything for each byte of
the longest text; aligned at anchors, it takes as many rounds as a context has bytes (under 2 x ``length``).

Passages of words are found in the same way: a text is then the string of its words' 32-bit hashes, a symbol a word, a window
``passage_words`` words.

Scale: about one context per 170 bytes, of which only narrow digests are counted; bytes move for contexts with repeated anchors.
An anchor with more than ``crowd`` different contexts is not put into one task: its windows' 128-bit hashes are counted instead,
which pre-aggregates in each task and gives the same answer. Texts are numbered and written once; they move to their contexts and
to their spans, by row.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows are two places and so
lose all of their windows; runs of one byte are repeats of themselves; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .common import unused, written
from .near_dup import WordHashes, mix

U = np.uint64
#: Text whose anchors meet in a group.
GROUP_BYTES = 4 << 20
#: A passage has over 50 words.
PASSAGE_WORDS = 51
#: Symbols of an anchor by bytes of a symbol (a byte, or a word's hash), and the symbols' type.
GRAM = {1: 64, 4: 16}
SYMBOL = {1: np.uint8, 4: np.dtype("<u4")}
CHUNK = 1 << 18
_PLACE = U((1 << 20) - 1)
ANCHORS = "rid long, anchor long, start long, windows int, back int, c1 long, c2 long"
ANCHORS_ARROW = pa.schema([("rid", pa.int64()), ("anchor", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("back", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64())])


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the symbols of an anchor from each place on, by doubling."""
    h = b.astype(U)
    if b.dtype == np.uint8:
        for n in (1, 2, 4):
            h = h[:-n] | h[n:] << U(8 * n)
        steps = (8, 16, 32)
    else:
        h = h | h << U(32)
        steps = (1, 2, 4, 8)
    h = mix(h)
    for n, k in zip(steps, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)):
        h = h[:-n] * U(k) + (h[n:] ^ h[n:] >> U(29))
    return mix(h)


def least_in(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each place on."""
    n = 1
    while 2 * n <= width:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    return key if n == width else np.minimum(key[: len(key) - (width - n)], key[width - n :])


def contexts(b: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, how many windows, place of the anchor in the first window) over joined texts that end at ``ends``, in symbols."""
    if len(b) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h = gram_hashes(b)
    place = np.arange(len(h), dtype=U)
    at = (least_in(h & ~_PLACE | place, length - GRAM[b.itemsize] + 1) & _PLACE).astype(np.int64)
    start = np.arange(len(at))
    inside = start + length <= np.repeat(ends, np.diff(ends, prepend=0))[: len(at)]
    start, at = start[inside], at[inside]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return h[at[first]].view(np.int64), start[first], np.diff(np.append(first, len(at))), at[first] - start[first]


def _chunks(rows: Iterator[tuple[int, bytes]], window: int, unit: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Parts of texts (row, offset, bytes) of about CHUNK bytes together; long texts overlap by a window (in bytes)."""
    rids, offs, parts, size = [], [], [], 0
    for rid, text in rows:
        for at in range(0, max(1, len(text) - window + 1), CHUNK):
            part = text[at : at + CHUNK + window - unit]
            if len(part) < window:
                continue
            rids.append(rid)
            offs.append(at)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield rids, offs, parts
                rids, offs, parts, size = [], [], [], 0
    if parts:
        yield rids, offs, parts


def _symbols(unit: int):
    """A text's symbols: its bytes, or the 32-bit hashes of its words."""
    hashes = WordHashes()

    def of(text: bytes) -> bytes:
        if unit == 1:
            return text
        words = text.split()  # bytes: at ASCII white space only
        return np.fromiter(map(hashes.__getitem__, words), U, len(words)).astype("<u4").tobytes()

    return of


def _anchored(length: int, unit: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = _symbols(unit)
        rows = ((rid.as_py(), symbols(text.as_py())) for batch in batches for rid, text in zip(batch.column(0), batch.column(1)))
        for rids, offs, parts in _chunks(rows, length * unit, unit):
            joined = b"".join(parts)
            sizes = np.array([len(p) // unit for p in parts])
            ends = np.cumsum(sizes)
            anchor, start, windows, back = contexts(np.frombuffer(joined, SYMBOL[unit]), ends, length)
            own = np.searchsorted(ends, start, side="right")
            digest = [xxhash.xxh3_128_digest(joined[s * unit : (s + n + length - 1) * unit], d) for s, n, d in zip(start.tolist(), windows.tolist(), back.tolist())]
            c = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            at = start - (ends - sizes)[own] + np.array(offs)[own] // unit
            cols = (np.array(rids, np.int64)[own], anchor, at, windows, back, c[:, 0], c[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if f.type == pa.int32() else x, f.type) for x, f in zip(cols, ANCHORS_ARROW)], schema=ANCHORS_ARROW)

    return run


def repeated_columns(texts: list[bytes], backs: np.ndarray, windows: np.ndarray, length: int, unit: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) pairs that share ``length`` symbols with the same column of another text.

    Column-wise construction: texts are aligned at their anchors (``backs`` symbols from their start).
    """
    sizes = np.array([len(t) // unit for t in texts])
    data = np.frombuffer(b"".join(texts), SYMBOL[unit])
    origin = np.cumsum(sizes) - sizes + backs  # where column 0 of each text is in data
    lo, hi = -backs, sizes - backs  # columns of each text
    enter = np.argsort(-hi, kind="stable")
    enter_at = -hi[enter]
    leave = np.sort(-lo)
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int16)
    found_text, found_window = [], []
    entered = 0
    for col in range(int(hi.max()) - 1, int(lo.min()) - 1, -1):
        # texts whose first column was the one before leave; neighbours that come together share the least of what was between
        if np.searchsorted(leave, -col, side="left") > np.searchsorted(leave, -col - 1, side="left") and len(order):
            stay = np.flatnonzero(lo[order] <= col)
            if len(stay) < len(order):
                common = np.minimum.reduceat(common[: stay[-1] + 1], np.append(0, stay[:-1] + 1)) if len(stay) else common[:0]
                order = order[stay]
                common[:1] = 0
        upto = int(np.searchsorted(enter_at, -col - 1, side="right"))
        if upto > entered:  # texts whose last column this is: nothing follows, so they come first
            fresh = enter[entered:upto]
            common = np.concatenate([np.zeros(len(fresh), np.int16), common])
            order = np.concatenate([fresh, order])
            common[len(fresh) : len(fresh) + 1] = 0
            entered = upto
        if not len(order):
            continue
        symbol = data[origin[order] + col]
        perm = np.argsort(symbol, kind="stable")
        symbol = symbol[perm]
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        fresh_common = np.zeros(len(order), np.int16)
        if len(same):
            fresh_common[same] = 1 + range_min(common, perm[same - 1] + 1, perm[same] + 1)
        order, common = order[perm], fresh_common
        hit = common >= length
        if hit.any():
            hit[:-1] |= hit[1:]
            texts_hit = order[hit]
            window = col - lo[texts_hit]
            ok = window < windows[texts_hit]
            found_text.append(texts_hit[ok])
            found_window.append(window[ok])
    if not found_text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_text), np.concatenate(found_window)


def range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of x[a:b] (each a < b), from tables of powers of two made as they are needed."""
    level = np.frexp((b - a).astype(np.float32))[1].astype(np.uint8) - 1
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(int(level.max()) + 2))
    out = np.empty(len(a), x.dtype)
    table = x
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        q = order[cuts[k] : cuts[k + 1]]
        if len(q):
            out[q] = np.minimum(table[a[q]], table[b[q] - (1 << k)])
    return out


def runs(own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, count) of the runs of neighbouring places."""
    order = np.lexsort((at, own))
    own, at = own[order], at[order]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)) if len(own) else np.zeros(0, bool))
    return own[first], at[first], np.diff(np.append(first, len(own)))


SPANS_ARROW = pa.schema([("rid", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])
SPANS = "rid long, start long, windows long"


def _sorted_collection(length: int, unit: int):
    def run(table: pa.Table) -> pa.Table:
        texts = table.column("bytes").to_pylist()
        backs, windows = table.column("back").to_numpy().astype(np.int64), table.column("windows").to_numpy().astype(np.int64)
        own, window = repeated_columns(texts, backs, windows, length, unit)
        alone = table.column("n").to_numpy()[own] == 1  # equal contexts are repeats as a whole already
        own, first, count = runs(own[alone], window[alone])
        return pa.table([table.column("rid").to_numpy()[own], table.column("start").to_numpy()[own] + first, count], schema=SPANS_ARROW)

    return run


def _cut_out(length: int, unit: int):
    schema = pa.schema([("g", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("back", pa.int32()), ("n", pa.int64()), ("crowded", pa.bool_()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = _symbols(unit)
        for batch in batches:
            rows: list[dict] = []
            for rid, text, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = symbols(text.as_py())
                for p in parts.as_py():
                    s = p["start"]
                    rows.append({"rid": rid, "bytes": text[s * unit : (s + p["windows"] + length - 1) * unit], **p})
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _window_hashes(length: int, unit: int):
    import xxhash

    schema = pa.schema([("rid", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("h", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, text = r["windows"], r["bytes"]
                h = [xxhash.xxh3_128_digest(text[i * unit : (i + length) * unit]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([r["rid"]] * n, pa.int64()), pa.array(range(r["start"], r["start"] + n), pa.int64()), pa.array([r["n"]] * n, pa.int64()), pa.array(h, pa.binary())], schema=schema)

    return run


def _spans(places: list[tuple[int, int]]) -> list[dict]:
    """Ranges as few as they can be."""
    out: list[dict] = []
    for a, b in sorted(places):
        if out and a <= out[-1]["stop"]:
            out[-1]["stop"] = max(b, out[-1]["stop"])
        else:
            out.append({"start": a, "stop": b})
    return out


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _removed(columns: list[str], length: int, passage_words: int, as_text: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    more = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": spans_type, "passages": spans_type, "kept": pa.string() if as_text else pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            out: dict[str, list] = {n: [] for n in more}
            for text, found in zip(batch.column(len(columns)), batch.column(len(columns) + 1).to_pylist()):
                text = (text.as_py() or "").encode()
                spans = _spans([(p["start"], p["start"] + p["windows"] + length - 1) for p in found or () if p["unit"] == 1])
                by_words = [p for p in found or () if p["unit"] == 4]
                words = [m.span() for m in _WORD.finditer(text)] if by_words else []
                passages = _spans([(words[p["start"]][0], words[p["start"] + p["windows"] + passage_words - 2][1]) for p in by_words])
                at, kept = 0, []
                for s in _spans([(s["start"], s["stop"]) for s in spans + (passages if as_text else [])]):
                    kept.append(text[at : s["start"]])
                    at = s["stop"]
                kept.append(text[at:])
                kept = b"".join(kept)
                n_removed = sum(s["stop"] - s["start"] for s in spans)
                for n, x in zip(more, (len(text), n_removed, spans, passages, kept.decode("utf-8", "ignore") if as_text else kept)):
                    out[n].append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(out[n], t) for n, t in more.items())], names=[*columns, *more])

    return run


def repeats(texts: DataFrame, length: int, unit: int, crowd: int) -> DataFrame:
    """(rid, start, windows): runs of windows of ``length`` symbols (bytes, or words where ``unit`` is 4) that also start elsewhere in ``texts`` (rid, text: binary)."""
    all_ = written(texts.mapInArrow(_anchored(length, unit), ANCHORS), "anchors")
    again = all_.groupBy("anchor").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("anchor")
    again = written(again, "anchors")  # a table of its own, so that Spark can split the join where one anchor has most places
    found = written(all_.join(again, "anchor", "left_semi"), "again", spent=[all_, again])
    distinct = found.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "start", "windows", "back")).alias("x"))
    distinct = written(distinct.select("anchor", "c1", "c2", "n", "x.*"), "contexts")
    twice = written(distinct.where("n > 1").select("anchor", "c1", "c2"), "contexts")
    whole = found.join(twice, ["anchor", "c1", "c2"], "left_semi").select("rid", "start", F.col("windows").cast("long").alias("windows"))
    whole = written(whole, "spans", spent=[found, twice])
    kinds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    groups = blocks.buckets_for(texts, GROUP_BYTES)
    needed = distinct.join(kinds, "anchor").select("rid", F.struct(F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("g"), "start", "windows", "back", "n", (F.col("kinds") > crowd).alias("crowded")).alias("p"))
    by_text = needed.groupBy("rid").agg(F.collect_list("p").alias("parts"))
    cut = texts.join(by_text.hint("shuffle_hash"), "rid").select("rid", "text", "parts")
    cut = written(cut.mapInArrow(_cut_out(length, unit), "g long, rid long, start long, windows int, back int, n long, crowded boolean, bytes binary"), "pieces", spent=[distinct])
    sorted_ = cut.where(~F.col("crowded")).groupBy("g").applyInArrow(_sorted_collection(length, unit), SPANS)
    crowded = cut.where("crowded").mapInArrow(_window_hashes(length, unit), "rid long, start long, n long, h binary")
    hashes = crowded.groupBy("h").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("h")
    counted = crowded.where("n = 1").join(hashes, "h", "left_semi").select("rid", "start", F.lit(1).cast("long").alias("windows"))
    return whole.unionByName(written(sorted_.unionByName(counted), "spans", spent=[cut]))


def remove_repeats(docs: DataFrame, length: int = 400, crowd: int = 20_000, passage_words: int | None = None, as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, spans (byte ranges that repeat strings of ``length`` bytes), passages and kept (the bytes outside spans).

    With ``passage_words``, passages has the byte ranges of strings of so many words that occur twice. With ``as_text``, kept is a
    string, without passages and without the characters that a cut went through.
    """
    if length < 2 * GRAM[1] or passage_words is not None and passage_words < 2 * GRAM[4]:
        raise ValueError(f"length must be at least {2 * GRAM[1]}, passage_words {2 * GRAM[4]}")
    docs = docs.drop("n_bytes", "n_removed", "spans", "passages", "kept")
    rid, found = unused(docs, "_rid", "_found")
    numbered = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(rid).alias("rid"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    spans = repeats(texts, length, 1, crowd).withColumn("unit", F.lit(1))
    if passage_words is not None:
        spans = spans.unionByName(repeats(texts, passage_words, 4, crowd).withColumn("unit", F.lit(4)))
    by_row = spans.groupBy(F.col("rid").alias(rid)).agg(F.collect_list(F.struct("unit", "start", "windows")).alias(found))
    joined = numbered.join(by_row.hint("shuffle_hash"), rid, "left")
    one = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    out = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(one)), T.StructField("passages", T.ArrayType(one)), T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
    keep = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in keep), *out])
    return joined.select(*keep, "text", found).mapInArrow(_removed(keep, length, passage_words or 0, as_text), schema)
