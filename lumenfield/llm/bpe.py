"""Byte-level BPE encoding and decoding.

Encoding: texts are split by the vocabulary's pattern; each block's distinct pre-tokens are shuffled by word,
each distinct word of the corpus is encoded once, its ids are joined back to the blocks, and the blocks put
their documents together by position (see ``blocks``). Decoding takes the ids apart, with their positions, and joins them with the
token-byte table, which is broadcast, as its size is that of the vocabulary: each distinct id of a document once, as a row for each occurrence
is seven times as many. A document's rows stay together and in order, so that its bytes are joined up without a shuffle.

Defined results: a null text is an empty one (no ids); repeated rows are encoded each; an empty table gives an
empty result; strings of special tokens are ordinary text; words of any length are merged in n log n.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, tokens
from .common import unused

LONG = 256
NONE = np.int64(1) << 40


class Merges:
    """Which neighbours merge, and into what: every split of a token into two tokens."""

    def __init__(self, path: str):
        self.ranks = ranks = tokens.ranks(path)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.to = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pairs = pairs
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], NONE)

    def long_word(self, word: bytes) -> list[int]:
        """One word, with a heap of the possible merges."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (x := self.pairs.get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := self.pairs.get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has. All words merge their first pair of least rank in each round."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        whole = [(i, r) for i, w in enumerate(words) if (r := self.ranks.get(w)) is not None]
        known = {i for i, _ in whole}
        if whole:
            x = np.array(whole, np.int64)
            done.append((x[:, 0], x[:, 1]))
        todo = [i for i, w in enumerate(words) if i not in known and len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG and i not in known:
                ids = np.array(self.long_word(w), np.int64)
                done.append((np.full(len(ids), i), ids))
        if todo:
            sizes = np.array([len(words[i]) for i in todo])
            tok = self.byte[np.frombuffer(b"".join(words[i] for i in todo), np.uint8)]
            own = np.repeat(np.array(todo, np.int64), sizes)
            last = np.cumsum(sizes) - 1
            pair = np.append(self.rank(tok[:-1], tok[1:]), NONE)
            pair[last] = NONE
            while len(tok):
                start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                key = pair << 22 | (np.arange(len(tok)) - np.repeat(start, np.diff(np.append(start, len(tok)))))
                least = np.minimum.reduceat(key, start)
                ready = least >= NONE << 22
                at = start[~ready] + (least[~ready] & ((1 << 22) - 1))
                if ready.any():
                    out = np.repeat(ready, np.diff(np.append(start, len(tok))))
                    done.append((own[out], tok[out]))
                tok[at] = pair[at]
                keep = np.ones(len(tok), bool)
                keep[at + 1] = False
                if ready.any():
                    keep &= ~out
                moved = np.cumsum(keep) - 1
                at = moved[at]
                tok, own, pair = tok[keep], own[keep], pair[keep]
                if not len(tok):
                    break
                self._again(tok, own, pair, at)
                self._again(tok, own, pair, at[at > 0] - 1)
        at = np.concatenate([a for a, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([b for _, b in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        return ids[order], np.bincount(at, minlength=len(words))

    def _again(self, tok: np.ndarray, own: np.ndarray, pair: np.ndarray, at: np.ndarray) -> None:
        nxt = np.minimum(at + 1, len(tok) - 1)
        inside = (own[nxt] == own[at]) & (at + 1 < len(tok))
        pair[at] = np.where(inside, self.rank(tok[at], tok[nxt]), NONE)


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def _pretokens():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and tokens (array of the distinct ids), one row for each row of ``docs`` (doc_id, text)."""

    def once(lists: list[list[bytes]], _: list) -> Iterator[bytes]:
        number = blocks._Numbers()
        where = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in lists]
        ids, sizes = merges(vocabulary).encode(list(number))
        starts = np.cumsum(sizes) - sizes
        for at in where:
            n = sizes[at]
            yield blocks.put_parts(blocks.put_numbers(n), blocks.put_numbers(ids[ragged(starts[at], n)]))

    def join(b: blocks.Block) -> pa.Table:
        got = [[blocks.get_numbers(x) for x in blocks.get_parts(p)] for p in b.payloads]
        sizes = np.concatenate([g[0] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64)
        ids = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.uint32)
        starts = (np.cumsum(sizes) - sizes)[b.place]
        sizes = sizes[b.place]
        out, counts, distinct = [], [], []
        for end, n in zip(b.ends.tolist(), b.sizes.tolist()):
            c = b.codes[end - n : end]
            doc = ids[ragged(starts[c], sizes[c])]
            counts.append(len(doc))
            distinct.append(np.unique(doc).astype(np.int32))
            out.append(doc.astype("<u4").tobytes())
        ends = np.cumsum([0, *map(len, distinct)]).astype(np.int32)
        tokens_ = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(distinct)))
        return pa.table({"doc_id": pa.array(b.doc_ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(out, pa.binary()), "tokens": tokens_})

    buckets = blocks.buckets_for(docs)
    parts = blocks.split(docs.select("doc_id", F.lit(True).alias("flag"), "text"), _pretokens, buckets).repartition("block")
    return blocks.assemble(parts, blocks.by_word(parts, once), join, "doc_id long, n_tokens long, ids binary, tokens array<int>")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + sizes[i] - 1, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with the column decoded, the bytes of its ids, in place of the array tokens. An id without a token is an error."""
    rest = [f for f in encoded.schema.fields if f.name != "tokens"]
    pos, token, part = unused(encoded, "_pos", "_token", "_bytes")
    table = encoded.sparkSession.createDataFrame([(i, bytearray(b)) for b, i in tokens.ranks(vocabulary).items()], f"{token} int, {part} binary")
    apart = encoded.select(*[f.name for f in rest], F.posexplode_outer("tokens").alias(pos, token)).withColumn(pos, F.coalesce(pos, F.lit(0)))
    apart = apart.select(*[F.when(F.col(pos) == 0, F.col(f.name)).alias(f.name) for f in rest], pos, token)
    apart = apart.join(F.broadcast(table), token, "left").select(*[f.name for f in rest], pos, token, part)  # as many rows as the vocabulary has tokens
    ids = [f.name for f in rest].index("ids")

    def whole(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        first, n = rows.take(pa.array(starts)).combine_chunks(), len(rest)
        names, parts = (rows.column(n + i).to_pylist() for i in (1, 2))
        texts = []
        for a, b, x in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], first.column(ids)):
            known = dict(zip(names[a:b], parts[a:b]))
            try:
                texts.append(b"".join(map(known.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist())))
            except (KeyError, TypeError):
                raise ValueError("a document has ids that are not in its tokens or not in the vocabulary") from None
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in first.columns[:n]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names=[*(f.name for f in rest), "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a document that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            at = rows.column(len(rest)).to_numpy()
            starts = np.flatnonzero(at == 0)
            if not len(starts) or starts[0] or (at != np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))).any():
                raise RuntimeError("a document's tokens have come apart")
            if len(starts) > 1:
                yield whole(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1]).to_batches()
        if held:
            yield whole(pa.Table.from_batches(held), np.zeros(1, np.int64))

    return apart.mapInArrow(run, T.StructType([*rest, T.StructField("decoded", T.BinaryType())]))
