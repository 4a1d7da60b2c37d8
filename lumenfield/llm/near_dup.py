"""Near-duplicate documents by weighted MinHash of their word shingles.

Signatures follow BagMinHash: an element of weight w is a Poisson process in time over the weight axis, cut at
w; the weight axis is split into dyadic ranges [0,1), [1,2), [2,4), ..., a range of width d being one process of rate
d whose points carry a place in the range, so that the work grows with log w. Each point belongs to one of the
signature's components, whose value is its earliest point; two texts agree in a component with the probability
of their weighted Jaccard similarity. Signatures are banded; what meets in a band is verified on the whole
multisets of shingles.

Scale: exact copies are one node (their md5), however many rows they have. Texts that meet in a bucket are
not paired with each other: first each is verified against the least node of its buckets, then against the
least node of each of its buckets, and last, for the texts of buckets whose components are still apart, with those texts of
other components that an exact prefix filter leaves. Only texts that meet any other move again, twice for each pair
that is verified.

Defined results: texts are linked if the multisets of their ``k``-word shingles overlap (sum of minima over sum of
maxima) by ``threshold`` or more; a text of fewer words is one shingle of all its words; texts without words are linked
with their exact copies only, a null text being an empty one; a document's class is the least doc_id of its connected
component; null ids do not name a class unless it has no other; repeated rows of one id and text stay together; an
empty table gives an empty result. With 24 bands of 5 a pair at 0.8 is missed with probability 7e-5, at 0.9 with 2e-9.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..operators.graph import connected_components
from .common import unused

U = np.uint64
_K1, _K2, _K3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * _K2
    x = (x ^ (x >> U(27))) * _K3
    return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit hash of each word, kept for the words of a task up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, k: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles and how often the text holds each."""
    words = text.split()  # bytes: at ASCII white space only
    if not words:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    k = min(k, len(words))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * _K1 + h[i : len(h) - k + 1 + i]
    return np.unique(mix(out), return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m signature components of n bags, given flat (element hash, weight >= 1, bag) arrays; every bag has an element."""
    top = np.ceil(np.log2(weights)).astype(np.int64)  # levels beyond [0, 1)
    row = np.repeat(np.arange(len(elements)), top + 1)
    level = np.arange(len(row)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    key, weight, bag = mix(elements[row] + level.astype(U) * _K1), weights[row], owner[row]
    total = np.bincount(owner, weights, n)
    horizon = m * (np.log(m) + 4) / total
    out = np.full((n, m), np.inf)
    todo = np.arange(len(row))
    with np.errstate(over="ignore"):
        while len(todo):
            k, w, b, lo, wide = key[todo], weight[todo], bag[todo], low[todo], width[todo]
            t, i = np.zeros(len(todo)), 0
            while len(k):
                i += 1
                a = mix(k + U(i) * _K2)
                t = t - np.log(((a >> U(11)).astype(float) + 1) * 2.0**-53) / wide
                on = t < horizon[b]
                k, w, b, lo, wide, t, a = k[on], w[on], b[on], lo[on], wide[on], t[on], a[on]
                c = mix(a + _K3)
                place = lo + wide * ((c >> U(11)).astype(float) * 2.0**-53)
                hit = np.floor(place) < w
                np.minimum.at(out, (b[hit], (mix(c)[hit] % U(m)).astype(np.int64)), t[hit])
            short = np.isinf(out).any(axis=1)  # some component has no point yet: look further ahead
            horizon[short] *= 2
            todo = np.flatnonzero(short[bag])
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    bits = sig.view(U).reshape(len(sig), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * _K1, bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        key = mix(key + bits[:, :, i])
    return key.view(np.int64)


def _signed(k: int, bands: int, rows: int):
    schema = pa.schema([("node", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            nodes, bags, size = [], [], 0

            def flush() -> pa.RecordBatch:
                full = [i for i, (e, _) in enumerate(bags) if len(e)]
                keys: list = [[]] * len(bags)
                if full:
                    e = np.concatenate([bags[i][0] for i in full])
                    w = np.concatenate([bags[i][1] for i in full])
                    own = np.repeat(np.arange(len(full)), [len(bags[i][0]) for i in full])
                    for i, x in zip(full, band_keys(signatures(e, w, own, len(full), bands * rows), bands)):
                        keys[i] = x
                return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

            for node, text in zip(batch.column(0), batch.column(1)):
                nodes.append(node.as_py())
                bags.append(shingles(text.as_py(), k, hashes))
                size += len(bags[-1][0])
                if size > 300_000:
                    yield flush()
                    nodes, bags, size = [], [], 0
            if nodes:
                yield flush()

    return run


def _alike(k: int, threshold: float):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, hub = WordHashes(), None, None
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(i) for i in range(4))):
                a = a.as_py()
                if a != last:
                    last, hub = a, shingles(ta.as_py(), k, hashes)
                e, w = shingles(tb.as_py(), k, hashes)
                _, x, y = np.intersect1d(hub[0], e, assume_unique=True, return_indices=True)
                both = np.minimum(hub[1][x], w[y]).sum()
                if both >= threshold * (hub[1].sum() + w.sum() - both) and both:
                    out.append((a, b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], schema=schema)

    return run


SKETCH = 1 << 21
#: How many elements before its own a row of a text's front carries.
EARLIER = 8


def _elements(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """The multiset of shingles as a set: each with the number of its occurrence."""
    e, w = shingles(text, k, hashes)
    times = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    return mix(np.repeat(e, w) + times.astype(U) * _K1)


def _frequencies(k: int):
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(SKETCH, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, (_elements(text.as_py(), k, hashes) % U(SKETCH)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], schema=schema)

    return run


def _rare_first(k: int, threshold: float, sketch):
    schema = pa.schema([("node", pa.binary()), ("component", pa.binary()), ("element", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("earlier", pa.list_(pa.int64())), *((f"s{i}", pa.int64()) for i in range(4))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for node, comp, text in zip(*(batch.column(i) for i in range(3))):
                e = _elements(text.as_py(), k, hashes)
                parity = np.packbits((np.bincount(((e >> U(32)) % U(256)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)
                e = e[np.lexsort((e, sketch.value[(e % U(SKETCH)).astype(np.int64)]))]
                n = len(e)
                head = e[: n - int(np.ceil(threshold * n - 1e-9)) + 1].view(np.int64)
                m = len(head)
                back = np.arange(m)[:, None] - np.arange(EARLIER, 0, -1)
                earlier = pa.ListArray.from_arrays(np.append(0, np.cumsum((back >= 0).sum(axis=1))).astype(np.int32), head[back[back >= 0]])
                cols = (pa.array([node.as_py()] * m, pa.binary()), pa.array([comp.as_py()] * m, pa.binary()), pa.array(head), pa.array(np.arange(m, dtype=np.int32)), pa.array(np.full(m, n, np.int32)), earlier, *(pa.array(np.full(m, b)) for b in parity))
                yield pa.RecordBatch.from_arrays(list(cols), schema=schema)

    return run


def rare_pairs(texts: DataFrame, k: int, threshold: float, written: Callable[[DataFrame, str], DataFrame] = scratch.written) -> DataFrame:
    """Pairs (a, b) of texts (node, component, text) of different components that can reach the threshold.

    Exact prefix filter: in an order that all texts share, the first element that two texts have in common leaves each
    only what comes after it, so it stands near the front of both if they are alike. The order is by
    a sketch of the elements' frequencies (of fixed size, rare ones first): what sets a text apart
    comes first, and texts with too much of it meet nothing. 256 parities of the elements bound, from below and
    exactly, how many elements only one of the two has; the join drops the pair where that is too many. A pair need come only once, by
the first element of both fronts: it is passed over where one of the few elements before is in both.
    """
    counts = np.zeros(SKETCH, np.int64)
    seen = texts.select("text").mapInArrow(_frequencies(k), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SKETCH rows
    counts[seen.column("slot").to_numpy()] = seen.column("n").to_numpy()
    sketch = texts.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))
    front = written(texts.select("node", "component", "text").mapInArrow(_rare_first(k, threshold, sketch), "node binary, component binary, element long, place int, size int, earlier array<long>, s0 long, s1 long, s2 long, s3 long"), "front")
    shared = front.groupBy("element").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(F.col("x") != F.col("y")).select("element")
    front = written(front.join(shared, "element", "left_semi"), "front")
    a, b = front.alias("a"), front.alias("b")
    need = threshold / (1 + threshold) * (F.col("a.size") + F.col("b.size")) - 1e-6
    meet = (F.col("a.element") == F.col("b.element")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component"))
    meet = meet & (F.col("a.size") - F.col("a.place") >= need) & (F.col("b.size") - F.col("b.place") >= need)
    # each element that only one of them has flips one bit of the difference of their parities
    apart = sum((F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(1, 4)), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
    meet = meet & (apart <= (1 - threshold) / (1 + threshold) * (F.col("a.size") + F.col("b.size")) + 1e-6)
    meet = meet & ~F.arrays_overlap("a.earlier", "b.earlier")
    return a.join(b, meet).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def node_of(text: Column) -> Column:
    """Exact copies are one node."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def classes(docs: DataFrame, k: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 5) -> DataFrame:
    """``docs`` with class_id and kept (whether the document is its class's least)."""
    made: list[DataFrame] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        made.append(scratch.written(df, name))
        return made[-1]

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    signed = docs.select(node_of(F.col("text")).alias("node"), text.alias("text")).mapInArrow(_signed(k, bands, rows), "node binary, keys array<long>")
    keyed = written(signed.dropDuplicates(["node"]), "keys").select("node", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where(F.col("least") != F.col("most")).select("key", "least")
    met = written(keyed.join(met, "key"), "met")  # key, node, least: only what meets another text
    wanted = met.select("node").distinct()
    texts = docs.select(node_of(F.col("text")).alias("node"), text.alias("text")).join(wanted, "node", "left_semi")
    texts = written(texts.dropDuplicates(["node"]), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        side = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"t{n}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
        return written(both.mapInArrow(_alike(k, threshold), "a binary, b binary"), "links")

    def pieces(links: DataFrame, comp: DataFrame | None = None) -> DataFrame:
        """Components of ``links`` and of what ``comp`` (node, component) holds together already."""
        if comp is None:
            return written(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "components")
        named = lambda n, to: comp.select(F.col("node").alias(n), F.col("component").alias(to))
        edges = links.join(named("a", "src"), "a", "left").join(named("b", "dst"), "b", "left").select(F.coalesce("src", "a").alias("src"), F.coalesce("dst", "b").alias("dst"))
        more = written(connected_components(edges.where("src <> dst").distinct()), "components")
        own = comp.join(more.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        fresh = more.join(comp.select("node"), "node", "left_anti").select("node", "component")
        return written(own.unionByName(fresh), "components")

    def apart(comp: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component."""
        own = met.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(F.col("x") != F.col("y"))
        return written(own.join(split.select("key"), "key", "left_semi"), "apart")

    # 1: each text with the least node of all its buckets
    first = written(met.where(F.col("least") != F.col("node")).groupBy(F.col("node").alias("b")).agg(F.min("least").alias("a")), "pairs")
    links = linked(first)
    # 2: with the least node of each of its buckets
    comp = pieces(links)
    left = apart(comp)
    heads = written(left.select(F.col("node").alias("least"), F.col("component").alias("head")).distinct(), "heads")
    second = left.join(heads, "least").where(F.col("component") != F.col("head")).select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    second = written(second.join(first, ["a", "b"], "left_anti"), "pairs")
    comp = pieces(linked(second), comp)
    # 3: across the components of a bucket that are still apart
    left = apart(comp).select("node", "component").distinct()
    third = rare_pairs(left.join(texts, "node"), k, threshold, written)
    third = third.join(first.unionByName(second), ["a", "b"], "left_anti")
    named = _named(docs, pieces(linked(third), comp))
    scratch.discard(*made)
    return _with_classes(docs, named)


def _named(docs: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, class_id) of the texts that others equal or resemble."""
    least = docs.groupBy(node_of(F.col("text")).alias("node")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).join(comp, "node", "left")
    least = scratch.written(least.where((F.col("n") > 1) | F.col("component").isNotNull()), "least")
    group = F.coalesce("component", "node")
    whole = least.groupBy(group.alias("component")).agg(F.min("least").alias("class_id"))
    return scratch.written(least.select("node", group.alias("component")).join(whole, "component").select("node", "class_id"), "classes", spent=[least])


def _with_classes(docs: DataFrame, named: DataFrame) -> DataFrame:
    key, = unused(docs, "_node")
    docs = docs.drop("class_id", "kept")
    out = docs.withColumn(key, node_of(F.col("text"))).join(named.withColumnRenamed("node", key), key, "left").drop(key)
    return out.withColumn("class_id", F.coalesce("class_id", "doc_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
