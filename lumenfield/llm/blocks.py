"""Texts as blocks of word numbers, and a shuffle of each block's distinct words.

A corpus has far more word occurrences than (block, distinct word) pairs. ``split`` turns each block of
documents (at most ``block_bytes`` of text, or one longer document) into one row of word numbers by place and,
for each hash bucket, one row with the block's distinct words of that bucket. The words then travel to the task
of their bucket, where each distinct word of the corpus is looked at once (``by_word``), and what it yields goes
back to the blocks (``assemble``), where the positions put the documents together again.

Give ``by_word`` and ``assemble`` one exchange by block (or a written table), so that texts are split once. No
row, group or task holds more than one block or one bucket; the number of buckets follows the bytes of the texts (``buckets_for``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("flags", T.ArrayType(T.BooleanType())),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("buckets", T.BinaryType()),
        T.StructField("facts", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
SPLIT_ARROW = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("buckets", pa.binary()), ("facts", pa.binary()), ("payload", pa.binary())]
)
BACK = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType())])
BACK_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def put_numbers(x: np.ndarray) -> bytes:
    """Numbers by byte planes, low bytes first: high planes of small numbers press to nothing."""
    raw = np.ascontiguousarray(x, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return squeeze(raw.T.tobytes())


def get_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(unsqueeze(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def put_parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def get_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def put_words(words: list[bytes]) -> bytes:
    return put_parts(put_numbers(np.fromiter(map(len, words), np.uint32, len(words))), squeeze(b"".join(words)))


def get_words(data: bytes) -> list[bytes]:
    sizes, text = get_parts(data)
    text, ends = unsqueeze(text), np.cumsum(get_numbers(sizes)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def give_back() -> None:
    """Free memory goes back to the system: Spark keeps idle workers, and each would hold what its largest block took."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def buckets_for(docs: DataFrame, bucket_bytes: int = 16 << 20) -> int:
    """As many buckets as give each the words of about ``bucket_bytes`` of text, but no fewer than shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))


def split(docs: DataFrame, tokenizer: Callable[[], Callable[[str], list]], buckets: int, block_bytes: int = 8 << 20, counted: bool = False, facts: Callable[[list[bytes]], bytes] | None = None) -> DataFrame:
    """Rows of a block's word numbers (bucket -1; ``facts``: what it says of the block's words) and of its distinct words (payload: words,
    and with ``counted`` how often documents with a true flag hold them). ``docs``: doc_id, flag, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pid, made = tokenizer(), TaskContext.get().partitionId(), 0
        texts, ids, flags, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, texts, ids, flags, size
            sizes = [len(t) for t in texts]
            whole, texts = pa.concat_arrays(texts), []
            numbered = whole.dictionary_encode()
            del whole
            flat, distinct = numbered.indices.to_numpy(), numbered.dictionary
            often = np.bincount(flat, minlength=len(distinct))
            by_rank = np.argsort(-often, kind="stable")
            rank = np.empty(len(distinct), np.uint32)
            rank[by_rank] = np.arange(len(distinct), dtype=np.uint32)
            words = distinct.take(pa.array(by_rank)).to_pylist()
            held = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
            seen = None
            if counted:
                there = np.repeat(np.array(flags, bool), sizes)
                seen = np.bincount(rank[flat[there]], minlength=len(words))
            order = np.argsort(held, kind="stable")
            found, first = np.unique(held[order], return_index=True)
            rows = {n: [] for n in SPLIT_ARROW.names}
            block = (pid << 24) + made

            def row(**x):
                for n in rows:
                    rows[n].append(x.get(n))

            row(block=block, bucket=-1, doc_ids=ids, flags=flags, sizes=sizes, buckets=put_numbers(held), facts=facts and facts(words), payload=put_numbers(rank[flat]))
            for b, at in zip(found.tolist(), np.split(order, first[1:])):
                part = put_words([words[k] for k in at.tolist()])
                row(block=block, bucket=b, payload=put_parts(part, put_numbers(seen[at])) if counted else put_parts(part))
            made += 1
            texts, ids, flags, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in SPLIT_ARROW], schema=SPLIT_ARROW)

        for batch in batches:
            for doc_id, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                if ids and size + len(text) > block_bytes:
                    yield flush()
                    give_back()
                texts.append(pa.array(tokens(text), pa.binary()))
                ids.append(doc_id)
                flags.append(bool(flag))
                size += len(text)
        if ids:
            yield flush()
        batch = text = None
        give_back()

    return docs.select(docs["doc_id"].cast("long"), "flag", "text").mapInArrow(run, SPLIT)


def by_word(parts: DataFrame, work: Callable[[list[list[bytes]], list[list[np.ndarray]]], Iterable[bytes]], total: bool = False) -> DataFrame:
    """``work(words, extras)`` gets all word lists of a bucket and yields a payload for each list, and with ``total`` one more for the
    bucket itself (block -1)."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pc.greater_equal(batch.column("bucket"), 0)
            yield batch.select(BACK_ARROW.names).filter(keep)

    def bucket(table: pa.Table) -> pa.Table:
        lists, extras = [], []
        for x in table.column("payload"):
            words, *extra = get_parts(x.as_py())
            lists.append(get_words(words))
            extras.append([get_numbers(e) for e in extra])
        out = list(work(lists, extras))
        del lists, extras
        give_back()
        block, held = table.column("block").to_pylist(), table.column("bucket").to_pylist()
        if total:
            block, held = [*block, -1], [*held, held[0]]
        return pa.table([pa.array(block, pa.int64()), pa.array(held, pa.int32()), pa.array(out, pa.binary())], schema=BACK_ARROW)

    return parts.mapInArrow(pick, BACK).groupBy("bucket").applyInArrow(bucket, BACK)


class Block:
    """What a block's task gets: documents' ids, flags and sizes, the numbers, and for each number the place
    of its word in the order in which the buckets' payloads follow each other."""

    def __init__(self, left: pa.Table, right: pa.Table):
        docs = left.filter(pc.equal(left.column("bucket"), -1)).to_pylist()[0]
        held = get_numbers(docs["buckets"])
        self.block = docs["block"]
        self.doc_ids, self.flags, self.sizes = docs["doc_ids"], docs["flags"], np.array(docs["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.codes = get_numbers(docs["payload"])
        self.facts = docs["facts"]
        order = np.argsort(held, kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        back = right.sort_by("bucket").column("payload").to_pylist() if right.num_rows else []
        self.payloads = back


def assemble(parts: DataFrame, back: DataFrame, work: Callable[[Block], pa.Table], schema: str) -> DataFrame:
    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(Block(left, right))
        give_back()
        return out

    return parts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(join, schema)
