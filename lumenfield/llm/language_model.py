"""Language model scores by a hashed maximum-entropy model with a class-factored softmax.

A token is one of the ``head`` most frequent words of the training texts, the end of a text, or a tail word. Tail
words are hashed by their endings to ``tails`` symbols. P(token | before) = P(class | two tokens before) * P(token | class, two tokens before):

* classes are the tail symbols and groups of ``CLASS`` head words of similar frequency; their softmax has bigram
  features (token before, class) and skip features (token before that, class);
* a word within its class has a base: for a head word a softmax of a unigram and bigram features of symbols, for a tail word its
  smoothed share of the class's training tokens, unknown words together one more;
* on that base, two softmaxes over the class's words have a feature for each pair of words that the training texts hold, whatever
  the size of the vocabulary: (word before, word) and (word before that, word). They are mixed, ``SKIP`` being the share of the second.

Training: texts become rows of symbols, whose bigrams and skip-bigrams are counted over all training texts, a sum
by cell of at most 2 * symbols^2 cells however large the corpus. The likelihood's gradient is a sum over cells: each round,
tasks over the cells return their parts of the expected feature counts under the current weights, and the weights take a
damped diagonal Newton step. With two additive features, the softmax's normalisers of all contexts are one matrix product.

Pairs of words: each block sends its distinct pairs, with their counts, to the bucket of their context (word before, class), hashed to 40
bits, a word inside it to 24; there each context's softmax is fitted on its own, and the pairs' probabilities go back to the blocks. No pair is
left out, but pairs with one hash are one: two of n words of a context with probability 2^-24 each, two of all contexts with 2^-40.

Scale: words, pairs and their counts travel as in ``blocks`` (each distinct one once, block dictionaries back); neither vocabulary nor
pairs are ever in one place. Symbols, cells and class weights have fixed sizes. Scoring is numpy lookups over blocks.

Defined results: a null text is an empty one (its end alone); rows with a null doc_id are scored and not learnt from; repeated rows
are learnt from and scored each; without training texts all words are unknown tail words; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import discard, written
from .quality_classifier import fold_of

CLASS = 64
LN10 = np.log(10.0)
SKIP = 0.25
#: Of a pair's key, the low bits are of its word, the high ones of its context.
WORD_BITS, CONTEXT_BITS = 24, 40
LOW = np.uint64((1 << WORD_BITS) - 1)
#: Logarithms travel in steps of 1 / STEP.
STEP = 1024.0
#: Text of a block, and text whose pairs meet in a bucket.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20
#: Words are hashed to 32 bits where they are features.
KEY = np.uint64((1 << 32) - 1)
END = np.uint64(0x9E3779B9)
ENCODED = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("codes", pa.binary()), ("words", pa.binary())])


def words_of():
    return lambda text: text.encode().lower().split()  # bytes: only A-Z and ASCII white space


def tail_of(word: bytes, tails: int) -> int:
    end = word[-4:]
    core = end.rstrip(b".,;:!?")
    return zlib.crc32(core[-2:] + (b"." if len(core) < len(end) else b"")) % tails


class Tails(dict):
    """Tail symbols, kept by the last bytes of words up to a bound."""

    def __init__(self, tails: int):
        self.tails = tails

    def __missing__(self, end: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        t = self[end] = tail_of(end, self.tails)
        return t

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self[w[-4:]] for w in words), np.int64, len(words))


class Shape:
    """Numbers of symbols: head words by rank, the end, the tail symbols."""

    def __init__(self, head: int, tails: int):
        self.head, self.end, self.tails = head, head, tails
        self.symbols = head + 1 + tails
        self.of = np.arange(self.symbols)  # class of each symbol
        self.groups = -(-(head + 1) // CLASS)
        self.of[: head + 1] //= CLASS
        self.of[head + 1 :] = self.groups + np.arange(tails)
        self.classes = self.groups + tails


def word_keys(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) & KEY


def _counted(lists: list[list[bytes]], extras: list) -> Iterator[bytes]:
    """For each list how often the training texts hold its words, and last the bucket's words with their counts."""
    number = blocks._Numbers()
    where = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in lists]
    count = np.zeros(len(number), np.int64)
    for at, (seen,) in zip(where, extras):
        count[at] += seen  # a block's words are distinct
    for at in where:
        yield blocks.put_parts(*map(blocks.put_numbers, _halves(count[at])))
    yield blocks.put_parts(blocks.put_words(list(number)), *map(blocks.put_numbers, _halves(count)))


def _total(row: bytes) -> tuple[list[bytes], np.ndarray]:
    words, low, high = blocks.get_parts(row)
    return blocks.get_words(words), _whole(blocks.get_numbers(low), blocks.get_numbers(high)).astype(np.int64)


def _sums(tails: int):
    """Sums of the counts by tail symbol (kind 0), and how many words have a count of so many bits (kind 1): a task's, not a bucket's."""
    schema = pa.schema([("kind", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v, tail = np.zeros((2, max(tails, 64)), np.int64), np.zeros((2, max(tails, 64)), np.int64), Tails(tails)
        for batch in batches:
            for x in batch.column(0):
                words, count = _total(x.as_py())
                seen = np.flatnonzero(count)
                for kind, at in enumerate((tail.of([words[i] for i in seen.tolist()]), np.frexp(count[seen].astype(float))[1])):
                    np.add.at(n[kind], at, count[seen])
                    np.add.at(v[kind], at, 1)
        kind, at = np.nonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[kind, at]), pa.array(v[kind, at])], schema=schema)

    return run


def _over(bits: int):
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                words, count = _total(x.as_py())
                at = np.flatnonzero(count >= 1 << bits >> 1)
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in at.tolist()], pa.binary()), pa.array(count[at])], schema=schema)

    return run


def summary(totals: DataFrame, head: int, tails: int) -> tuple[list[tuple[bytes, int]], np.ndarray, np.ndarray]:
    """The ``head`` most frequent training words with their counts, and by tail symbol the sum of counts and the number of all words.

    A histogram of the counts' magnitudes says from which magnitude on a word can be among the most frequent; only such words
    are made rows of.
    """
    n, v, bits = np.zeros(tails), np.zeros(tails), {}
    for r in totals.mapInArrow(_sums(tails), "kind int, at int, n long, v long").groupBy("kind", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # tails + 64 rows
        if r["kind"]:
            bits[r["at"]] = r["v"]
        else:
            n[r["at"]], v[r["at"]] = r["n"], r["v"]
    least = next((b for b in sorted(bits, reverse=True) if sum(k for x, k in bits.items() if x >= b) >= head), 1)
    often = totals.mapInArrow(_over(least), "word binary, n long").orderBy(F.col("n").desc(), "word").limit(head).collect()
    return [(bytes(r["word"]), r["n"]) for r in often], n, v


def encode(docs: DataFrame, held: int, folds: int, head: int, tails: int) -> tuple[DataFrame, dict, Shape]:
    """A row per block: texts as numbers of its words, what needs no context by text, and by word its symbol, hash and base in its class."""
    away = F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False))
    flag = ~away & F.col("doc_id").isNotNull()
    buckets = blocks.buckets_for(docs)

    def facts(words: list[bytes]) -> bytes:
        return blocks.put_parts(*map(blocks.put_numbers, (word_keys(words), Tails(tails).of(words))))

    parts = written(blocks.split(docs.select("doc_id", flag.alias("flag"), "text"), words_of, buckets, BLOCK_BYTES, counted=True, facts=facts), "blocks")
    back = written(blocks.by_word(parts, _counted, total=True), "counts")
    often, n_t, v_t = summary(back.where("block = -1").select("payload"), head, tails)
    ends = int(docs.where(flag).count())
    total, kinds = int(n_t.sum()) + ends, int(v_t.sum()) + (ends > 0)
    for w, n in often:
        n_t[tail_of(w, tails)] -= n
        v_t[tail_of(w, tails)] -= 1
    shape = Shape(head, tails)
    top_key, top_count = word_keys([w for w, _ in often]), np.array([n for _, n in often], np.int64)
    by_key = np.argsort(top_key)
    top_key, top_count = top_key[by_key], top_count[by_key]

    def join(b: blocks.Block) -> pa.Table:
        got = [[blocks.get_numbers(x) for x in blocks.get_parts(p)] for p in b.payloads]
        count = np.concatenate([_whole(*g) for g in got]).astype(np.int64)[b.place] if got else np.zeros(0, np.int64)
        key, tail = (blocks.get_numbers(x) for x in blocks.get_parts(b.facts))
        symbol, tail = head + 1 + tail.astype(np.int64), tail.astype(np.int64)
        if len(top_key):
            at = np.minimum(np.searchsorted(top_key, key), len(top_key) - 1)
            symbol = np.where((top_key[at] == key) & (top_count[at] == count), by_key[at], symbol)  # another word of that hash is rarer
        share = np.log10((count + 1) / (total + kinds + 1))
        rare = np.where(symbol > head, -np.log((count + 1) / (n_t + v_t + 1)[tail]), 0.0)
        end = np.log10((ends + 1) / (total + kinds + 1))
        at = [b.codes[stop - n : stop] for stop, n in zip(b.ends.tolist(), b.sizes.tolist())]
        known, base = [int((count[c] > 0).sum()) + (ends > 0) for c in at], [float(share[c].sum() + end) for c in at]
        words = blocks.put_parts(*map(blocks.put_numbers, (symbol, key, in_steps(rare))))
        row = (b.block, b.doc_ids, b.flags, b.sizes.tolist(), known, base, blocks.put_numbers(b.codes), words)
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, ENCODED)], schema=ENCODED)

    out = blocks.assemble(parts.where("bucket = -1"), back.where("block >= 0"), join, "block long, doc_ids array<long>, flags array<boolean>, sizes array<int>, known array<long>, base array<double>, codes binary, words binary")
    return written(out, "symbols", spent=[parts, back]), {"train_tokens": total}, shape


def in_steps(x: np.ndarray) -> np.ndarray:
    """Negative logarithms, from 0 to 60, as whole steps."""
    return np.round(np.clip(x, 0, 60) * STEP).astype(np.int64)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.uint64)
    return x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def _sequence(arrays: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two before, one before, token) of each token of the texts, ends included, and the texts' sizes."""
    sizes = np.array([len(a) + 1 for a in arrays])
    edge = np.full(2, end)
    flat = np.concatenate([x for a in arrays for x in (edge, a)] + [edge]).astype(np.int32)
    first = np.cumsum(sizes + 1) - sizes - 1  # each text has two ends before it; its own end is the next text's first
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()) + 2
    return flat[at - 2], flat[at - 1], flat[at], sizes


class Texts:
    """A row of ``encode``: tokens as numbers of the block's words (the last is the end), and the words' symbols, hashes, bases."""

    def __init__(self, row: dict, end: int):
        symbol, key, rare = map(blocks.get_numbers, blocks.get_parts(row["words"]))
        self.symbol = np.append(symbol, end).astype(np.int64)
        self.key = np.append(key.astype(np.uint64), END)
        self.rare = np.append(rare, 0).astype(np.float32)
        codes = np.split(blocks.get_numbers(row["codes"]), np.cumsum(row["sizes"])[:-1])
        self.before2, self.before, self.token, self.sizes = _sequence(codes, len(symbol))
        self.learnt = np.repeat(np.array(row["flags"], bool), self.sizes)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _cells(shape: Shape):
    """A task's counts: for each kind of feature and symbol before, a row of the symbols after and how often they came."""
    m = shape.symbols
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int16()), ("after", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, skip = np.zeros(m * m, np.int32), np.zeros(m * m, np.int32)

        def out():
            for kind, x in ((1, one.reshape(m, m)), (2, skip.reshape(m, m))):
                rows = np.flatnonzero(x.any(axis=1))
                after = [blocks.put_parts(blocks.put_numbers(b), blocks.put_numbers(x[a, b])) for a in rows.tolist() for b in (np.flatnonzero(x[a]),)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int8)), pa.array(rows.astype(np.int16)), pa.array(after, pa.binary())], schema=schema)

        n = 0
        for row in _rows(batches):
            t = Texts(row, shape.end)
            token = t.symbol[t.token[t.learnt]]
            for x, a in ((one, t.before), (skip, t.before2)):
                key, times = np.unique(t.symbol[a[t.learnt]] * m + token, return_counts=True)
                x[key] += times.astype(np.int32)
            n += len(token)
            if n > 1 << 30:
                yield from out()
                one[:], skip[:], n = 0, 0, 0
        yield from out()

    return run


def _cell_sums(shape: Shape):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(shape.symbols, np.int64)
        for x in table.column("after"):
            b, n = map(blocks.get_numbers, blocks.get_parts(x.as_py()))
            total[b] += n
        b = np.flatnonzero(total)
        return pa.table({"kind": pa.array([key[0].as_py()] * len(b), pa.int8()), "a": pa.array([key[1].as_py()] * len(b), pa.int16()), "b": pa.array(b.astype(np.int16)), "n": pa.array(total[b])})

    return run


def train(symbols: DataFrame, shape: Shape, rounds: int = 8, part_cells: int = 1 << 20, prior: float = 4.0) -> dict[str, np.ndarray]:
    """Weights: bigram and skip features of classes, normalisers, and head words within their classes."""
    spark = symbols.sparkSession
    m, k = shape.symbols, shape.classes
    cells = symbols.mapInArrow(_cells(shape), "kind byte, a short, after binary")
    cells = written(cells.groupBy("kind", "a").applyInArrow(_cell_sums(shape), "kind byte, a short, b short, n long"), "cells")
    parts = max(2, -(-cells.count() // (2 * part_cells)))  # tasks of a round; there are at most 2 * symbols^2 cells
    class_of = spark.createDataFrame([(i, int(c)) for i, c in enumerate(shape.of)], "b short, class int")  # a row per symbol
    seen = np.zeros((2, m, k), np.float32)
    by_class = cells.join(F.broadcast(class_of), "b").groupBy("kind", "a", "class").agg(F.sum("n").alias("n"))
    by_class = by_class.toArrow()  # at most 2 * symbols * classes rows
    kind, a, c, n = (by_class.column(i).to_numpy() for i in range(4))
    seen[kind - 1, a, c] = n
    del by_class, kind, a, c, n
    share = (seen[0].sum(axis=0, dtype=np.float64) + 1) / (seen[0].sum(dtype=np.float64) + k)
    smooth = lambda o: np.log((o + prior * share) / (o.sum(axis=1, keepdims=True) + prior))
    big, skip = smooth(seen[0]).astype(np.float32), (0.3 * (smooth(seen[1]) - np.log(share))).astype(np.float32)

    def expected(weights):
        schema = pa.schema([("rows", pa.binary()), ("big", pa.binary()), ("skip", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            eb, es = (np.exp(w) for w in weights.value)
            gb, gs = np.zeros((m, k), np.float32), []
            got = [[batch.column(i).to_numpy() for i in range(3)] for batch in batches]
            a, b, x = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int16) for i in range(3))
            order = np.argsort(a, kind="stable")
            a, b, x = a[order], b[order], x[order]
            found, first = np.unique(a, return_index=True)
            first = np.append(first, len(a))
            for lo in range(0, len(found), 64):
                rows = found[lo : lo + 64]
                part = slice(first[lo], first[lo + len(rows)])
                dense = np.zeros((len(rows), m), np.float32)
                dense[np.searchsorted(rows, a[part]), b[part]] = x[part]
                r = dense / np.maximum(es[rows] @ eb.T, 1e-30)
                gb += r.T @ es[rows]
                gs.append(es[rows] * (r @ eb))
            own = np.concatenate(gs) if gs else np.zeros((0, k), np.float32)
            values = (found.astype("<i4").tobytes(), (gb * eb).tobytes(), own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], schema=schema)

        return run

    # contexts (two before, one before): all bigrams but those that end a text, and the two ends before each text
    texts = float(cells.where((F.col("kind") == 1) & (F.col("b") == shape.end)).agg(F.sum("n")).first()[0] or 0)
    start = spark.createDataFrame([(shape.end, shape.end, int(texts))], "a short, b short, n long")
    contexts = cells.where((F.col("kind") == 1) & (F.col("b") != shape.end)).select("a", "b", "n").unionByName(start)
    contexts = written(contexts.repartition(parts, "a"), "contexts")
    for _ in range(rounds if texts else 0):
        weights = spark.sparkContext.broadcast((big, skip))
        e_big, e_skip = np.zeros((m, k), np.float32), np.zeros((m, k), np.float32)
        got = contexts.mapInArrow(expected(weights), "rows binary, big binary, skip binary").toArrow()  # `parts` rows
        for rows, b, s in zip(*got.columns):
            e_big += np.frombuffer(b.as_buffer(), np.float32).reshape(m, k)
            e_skip[np.frombuffer(rows.as_buffer(), "<i4")] += np.frombuffer(s.as_buffer(), np.float32).reshape(-1, k)
        del got
        weights.destroy()
        for w, o, e, centre in ((big, seen[0], e_big, np.log(share).astype(np.float32)), (skip, seen[1], e_skip, np.float32(0))):
            w += 0.6 * np.clip((o - e - (w - centre) * 0.5) / (np.maximum(o, e) + 1.0), -2, 2)
    z = np.exp(skip) @ np.exp(big).T
    np.log(np.maximum(z, 1e-30, out=z), out=z)

    def within(table: pa.Table) -> pa.Table:
        """Bigram weights of head words inside their classes for some tokens before; the rows are independent."""
        a = table.column("a").to_numpy()
        rows, at = np.unique(a, return_inverse=True)
        o = np.zeros((len(rows), shape.groups * CLASS))
        o[at, table.column("b").to_numpy()] = table.column("n").to_numpy()
        o = o.reshape(len(rows), shape.groups, CLASS)
        u = np.zeros_like(o)
        for _ in range(25):
            p = np.exp(u + base)
            p /= p.sum(axis=2, keepdims=True)
            e = p * o.sum(axis=2, keepdims=True)
            u += np.clip((o - e - u) / (np.maximum(e, o) * 0.5 + 1.0), -1, 1)
        return pa.table([pa.array(rows.astype(np.int16)), pa.array([r.astype(np.float32).tobytes() for r in u], pa.binary())], names=["a", "u"])

    plain = np.zeros(shape.groups * CLASS)
    for r in cells.where((F.col("kind") == 1) & (F.col("b") <= shape.head)).groupBy("b").agg(F.sum("n").alias("n")).collect():  # a row per head word
        plain[r["b"]] = r["n"]
    real = (np.arange(len(plain)) <= shape.head).reshape(shape.groups, CLASS)
    base = np.where(real, np.log(plain.reshape(shape.groups, CLASS) + 0.5), -60.0)
    head = np.zeros((m, shape.groups, CLASS), np.float32)
    fitted = cells.where((F.col("kind") == 1) & (F.col("b") <= shape.head)).withColumn("g", F.floor(F.col("a") / 32)).groupBy("g").applyInArrow(within, "a short, u binary")
    fitted = fitted.toArrow()  # a row per symbol
    for a, u in zip(fitted.column("a").to_pylist(), fitted.column("u")):
        head[a] = np.frombuffer(u.as_buffer(), np.float32).reshape(shape.groups, CLASS)
    del fitted
    head += base.astype(np.float32)
    for row in head:
        row -= np.log(np.exp(row.astype(np.float64)).sum(axis=1, keepdims=True)).astype(np.float32)
    alone = base - np.log(np.exp(base).sum(axis=1, keepdims=True))
    discard(cells, contexts)
    return {"big": big, "skip": skip, "z": z, "head": head.reshape(m, -1), "alone": alone.ravel().astype(np.float32)}


def class_log_probabilities(model: dict[str, np.ndarray], shape: Shape, before2: np.ndarray, before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Natural log of P(class of the symbol | two before)."""
    c = shape.of[token]
    return model["big"][before, c] + model["skip"][before2, c].astype(np.float64) - model["z"][before2, before]


def log_probabilities(model: dict[str, np.ndarray], shape: Shape, before2: np.ndarray, before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """log10 P(symbol | two before), without the choice of a tail word in its symbol."""
    out = class_log_probabilities(model, shape, before2, before, token)
    in_head = token <= shape.head
    out[in_head] += model["head"][before[in_head], token[in_head]]
    return out / LN10


def _mix(x: np.ndarray) -> np.ndarray:
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(by)) * np.uint64(times)
    return x ^ x >> np.uint64(31)


def pairs_of(t: Texts, shape: Shape, buckets: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the block's distinct pairs in order, where each bucket's begin, and of each token the place of its pair."""
    c, word = shape.of[t.symbol[t.token]].astype(np.uint64), _mix(t.key[t.token]) & LOW
    context = _mix(t.key[t.before2 if kind else t.before] * np.uint64(0x9E3779B97F4A7C15) + (c * np.uint64(2) + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93))
    key, at = np.unique(context >> np.uint64(64 - CONTEXT_BITS) << np.uint64(WORD_BITS) | word, return_inverse=True)
    return key, np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1)), at


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of contexts; contexts are hashes."""
    return (key >> np.uint64(WORD_BITS + CONTEXT_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)


def _pairs(model, shape: Shape, buckets: int, kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            t = Texts(row, shape.end)
            key, first, place = pairs_of(t, shape, buckets, kind)
            n = np.bincount(place[t.learnt], minlength=len(key))
            s = t.symbol[t.token]
            head, own = s <= shape.head, t.rare[t.token]
            own[head] = -STEP * (model.value["alone"][s[head]] if kind else model.value["head"][t.symbol[t.before][head], s[head]])
            base = np.empty(len(key), np.int64)
            base[place] = np.round(own)
            found = np.flatnonzero(np.diff(first))
            payloads = []
            for part in (slice(first[b], first[b + 1]) for b in found.tolist()):
                step = np.diff(key[part], prepend=np.uint64(0))
                payloads.append(blocks.put_parts(*map(blocks.put_numbers, (*_halves(step), n[part], base[part]))))
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(found), pa.int64()), pa.array(found.astype(np.int32)), pa.array(payloads, pa.binary())], schema=blocks.BACK_ARROW)

    return run


def pair_probabilities(context: np.ndarray, seen: np.ndarray, base: np.ndarray, rounds: int = 12) -> np.ndarray:
    """P(word | context) of pairs sorted by context, of which the training texts hold ``seen``. ``base``: ln of the base, which
    sums to one over a context's words. Pairs that are not seen have no weight."""
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
    b = np.exp(base)
    at = np.flatnonzero(seen)
    if not len(at):
        return b
    have, start, place = np.unique(own[at], return_index=True, return_inverse=True)
    n, x = seen[at].astype(np.float32), b[at].astype(np.float32)
    total, rest = np.add.reduceat(n, start), np.maximum(1 - np.add.reduceat(b[at], start), 1e-6)
    u = np.zeros(len(at), np.float32)
    for _ in range(rounds):
        w = x * np.exp(u)
        e = w * (total / (rest + np.add.reduceat(w, start))).astype(np.float32)[place]
        u += np.clip((n - e - u) / (np.maximum(n, e) * np.float32(0.5) + 1), -1, 1)
    w = b.copy()
    w[at] *= np.exp(u.astype(float))
    z = np.ones(len(first))
    z[have] = rest + np.add.reduceat(w[at], start)
    return w / z[own]


def _fit(table: pa.Table) -> pa.Table:
    keys, seen, bases = [], [], []
    for x in table.column("payload"):
        low, high, n, base = map(blocks.get_numbers, blocks.get_parts(x.as_py()))
        keys.append(np.cumsum(_whole(low, high), dtype=np.uint64))
        seen.append(n)
        bases.append(base)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    base = np.full(len(key), np.inf)
    np.minimum.at(base, at, np.concatenate(bases).astype(float))  # equal but for pairs that share a hash: the likelier one's, in any order of blocks
    p = pair_probabilities(key >> np.uint64(WORD_BITS), np.bincount(at, weights=np.concatenate(seen), minlength=len(key)), -base / STEP)
    p = in_steps(-np.log(p))
    out = [blocks.put_numbers(p[x]) for x in np.split(at, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table([table.column("block"), table.column("bucket"), pa.array(out, pa.binary())], schema=blocks.BACK_ARROW)


def score(docs: DataFrame, held_out: int = 2, folds: int = 7, head: int = 2047, tails: int = 256, rounds: int = 8) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    encoded, facts, shape = encode(docs, held_out, folds, head, tails)
    weights = train(encoded, shape, rounds)
    inside = spark.sparkContext.broadcast({n: weights.pop(n) for n in ("head", "alone")})
    model = spark.sparkContext.broadcast(weights)
    buckets = blocks.buckets_for(docs, BUCKET_BYTES)
    fitted = [written(encoded.mapInArrow(_pairs(inside, shape, buckets, kind), blocks.BACK).groupBy("bucket").applyInArrow(_fit, blocks.BACK).withColumn("kind", F.lit(kind)), "pairs") for kind in (0, 1)]
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        t = Texts(row, shape.end)

        def pair(kind: int) -> np.ndarray:
            own = right.filter(pc.equal(right.column("kind"), kind)).sort_by("bucket").column("payload")
            return np.exp(np.concatenate([blocks.get_numbers(x.as_py()) for x in own]) / -STEP)[pairs_of(t, shape, buckets, kind)[2]]

        lp = (class_log_probabilities(model.value, shape, t.symbol[t.before2], t.symbol[t.before], t.symbol[t.token]) + np.log((1 - SKIP) * pair(0) + SKIP * pair(1))) / LN10
        values = (row["doc_ids"], t.sizes, row["known"], row["base"], np.add.reduceat(lp, np.cumsum(t.sizes) - t.sizes))
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    back = fitted[0].unionByName(fitted[1])
    scored = encoded.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    away = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    return scored.select("doc_id", away.alias("held_out"), "n_tokens", "n_known", F.lit(facts["train_tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
