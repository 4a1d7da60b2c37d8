import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfield.llm import bpe, queries, tokens

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.ranks(RANKS), special_tokens={})


def test_vocabulary_files_agree():
    assert tokens.ranks(RANKS) == tokens.ranks(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=40), st.text("abcdeth ", min_size=1, max_size=30).map(str.encode)), min_size=1, max_size=20))
def test_words_merge_as_the_library_merges(words):
    enc, m = reference(), bpe.merges(RANKS)
    ids, sizes = m.encode(words)
    want = [enc._encode_single_piece(w) for w in words]
    assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == want[0] and ids.tolist() == [i for w in want for i in w]
    assert [m.long_word(w) for w in words if w not in m.ranks] == [x for w, x in zip(words, want) if w not in m.ranks]


def test_pretokens_equal_the_pattern_of_the_library(spark):
    texts = ["a b 　 c\x1c\x1d\x85 d", "x​²Ⅰ ١'s 'LL 'll\r\n\n  y ", "́é \U0001f600\U0001f600 z" * 3]
    assert [[i for w in bpe._pretokens()(t) for i in bpe.merges(RANKS).encode([w.encode()])[0].tolist()] for t in texts] == [reference().encode_ordinary(t) for t in texts]


def check(rows, docs):
    enc = reference()
    want = sorted((i if i is not None else -1, len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want


def test_query_against_the_library(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(queries.op2_byte_bpe(spark, sf).collect(), docs)


def test_nulls_repeats_and_long_words(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "a" * 50000 + " " * 3000 + "ß" * 999), (3, "same id"), (None, "no id"), (4, "<|endoftext|> twice"), (4, "<|endoftext|> twice")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(queries.op2_byte_bpe(spark, str(tmp_path)).collect(), docs)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert queries.op2_byte_bpe(spark, f"{tmp_path}/e").collect() == []


def test_columns_that_clash_are_left_alone(spark):
    docs = spark.createDataFrame([(1, "some text", 5, 6, 7), (2, None, 5, 6, 7)], "doc_id long, text string, block int, ids int, flag int")
    made = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in made.collect()} == {1: b"some text", 2: b""}


def test_decoding_joins_each_distinct_id_of_a_document_once(spark):
    texts = {1: "to be or not to be, " * 300, 2: "", 3: " ".join(map(str, range(400))), 4: "to be"}
    made = bpe.encode(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), RANKS).localCheckpoint()
    rows = {r["doc_id"]: r for r in made.collect()}
    assert all(sorted(set(np.frombuffer(r["ids"], "<u4").tolist())) == r["tokens"] for r in rows.values()) and len(rows[1]["tokens"]) < 12 < 1500 < rows[1]["n_tokens"]
    # documents that go over several batches, and rows that come in another order and alone
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for rows in (made, made.orderBy("n_tokens"), made.where("doc_id = 3")):
            got = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(rows, RANKS).collect()}
            assert got == {r["doc_id"]: texts[r["doc_id"]] for r in rows.select("doc_id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_id_outside_the_vocabulary_is_an_error(spark):
    bad = spark.createDataFrame([(1, bytearray(np.array([10_000_000], "<u4").tobytes()), [10_000_000])], "doc_id long, ids binary, tokens array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad, RANKS).collect()
