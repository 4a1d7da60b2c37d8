import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfield.llm import packing, queries, tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")


def reference(text):
    from tokenizers import Tokenizer

    t = reference.__dict__.setdefault("t", Tokenizer.from_file(JSON))
    return t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.just("<|endoftext|>")), max_size=5).map("".join))
def test_ids_equal_the_tokenizers_library(text):
    assert tokens.encoding(JSON).encode(text, allowed_special="all") == reference(text)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40)), st.integers(1, 8))
def test_plan_places_every_piece_once_without_gaps(counts, groups):
    rows, n = packing.plan(counts, 30, groups)
    placed, sequences = defaultdict(int), defaultdict(list)
    for length, lo, hi, seq, per, offset in rows:
        assert lo == placed[length]
        placed[length] = hi
        for r in range(hi - lo):
            sequences[seq + r // per].append((offset + r % per * length, length))
    assert placed == counts and sorted(sequences) == list(range(n))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 30


def test_plan_is_close_to_the_lower_bound():
    counts = dict(enumerate(np.bincount(np.random.default_rng(1).integers(1, 1025, 20000)).tolist()))
    counts = {k: v for k, v in counts.items() if v}
    _, n = packing.plan(counts)
    assert n <= 1.01 * sum(k * v for k, v in counts.items()) / 1024


def check(rows, docs):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in docs.items():
        ids, at = [*reference(text), 2], 0
        got = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(len(got)))
        for r in got:
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 1024 for r in got[1:]) and len(got) == -(-len(ids) // 1024)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_query_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(queries.op4_best_fit_packing(spark, sf).collect(), docs)


def test_nulls_long_texts_and_extra_columns(spark):
    docs = [(1, None, 0), (2, "", 1), (3, "word " * 9000, 2), (None, "a null id", 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, length int")
    rows = packing.pack(df, JSON).collect()
    check(rows, {i: t for i, t, _ in docs})
    twice = packing.pack(df.unionByName(df), JSON).collect()
    once = lambda rs, n: sorted([(str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs] * n)
    assert once(twice, 1) == once(rows, 2) and len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice)
    assert packing.pack(df.limit(0), JSON).collect() == []


def test_added_tokens_in_texts_get_their_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny", "<|endoftext| > <|ENDOFTEXT|>", "plain", "<|endoftext|> " * 3000]
    got = defaultdict(list)
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), JSON).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert "<|endoftext|>" not in text or 50256 in ids
        assert sum(n for _, n, _ in got[i]) == len(ids) and all(c == zlib.crc32(ids[at : at + n].tobytes()) for at, n, c in got[i])
