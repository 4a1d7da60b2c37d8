import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.llm import exact_dedup, queries


def key(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def brute(docs):
    """Sorted (doc_id, keep_id, group_size, kept, digest); of repeated rows one stays."""
    groups, out = {}, []
    for d, t in docs:
        groups.setdefault(key(t), []).append(d)
    for k, ids in groups.items():
        ids.sort(key=lambda d: (d is None, d))
        out += [(d is None, d or 0, ids[0], len(ids), i == 0, k) for i, d in enumerate(ids)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def digests(n, seed=1):
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed} {i}".encode()).digest() for i in range(n)), np.uint64).reshape(-1, 4)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(queries.oracle_sql()["op13_exact_dedup"])
    df = queries.op13_exact_dedup(spark, sf)
    assert rel.columns == df.columns and sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_filter_holds_deletes_and_overflows():
    f, d = exact_dedup.CuckooFilter.for_keys(5000), digests(5000)
    assert f.insert(d[:2500]) and f.insert(d[2500:]) and f.contains(d).all()
    assert f.contains(digests(20000, 2)).mean() < 0.001
    f = exact_dedup.CuckooFilter(f.buckets, f.slots())
    f.delete(d[:2500])
    assert f.contains(d[2500:]).all() and f.contains(d[:2500]).mean() < 0.01 and (f.table != 0).sum() == 2500
    with pytest.raises(ValueError):
        for _ in range(9):
            f.delete(d[:1])
    assert f.insert(d[:2500]) and f.contains(d).all()
    assert not exact_dedup.CuckooFilter(64).insert(digests(300))
    full = exact_dedup.CuckooFilter(64)
    assert full.insert(digests(240)) and full.contains(digests(240)).all()  # 94 % of the slots


def test_odd_rows_in_any_batching(spark):
    docs = [(5, "a b"), (3, "a \t\n b"), (9, " a b"), (7, None), (8, ""), (None, "a b"), (None, "only null"), (4, "x" * 200_000), (2, "x" * 200_000), (6, "é é"), (1, "é é"), (3, "a b"), (3, "a b"), (11, "\n"), (10, " ")]
    docs += [(100 + i, f"text {i % 70}") for i in range(200)] + [(400 + i, "hot   text") for i in range(150)]
    df = spark.createDataFrame([(d, t, i, "k") for i, (d, t) in enumerate(docs)], "doc_id long, text string, n long, digest string").repartition(5)
    for batches, shard_keys in ((1, 4096), (4, 16), (7, 50)):
        out = exact_dedup.dedup(df, batches=batches, shard_keys=shard_keys)
        assert out.columns == ["doc_id", "text", "n", "digest", "keep_id", "group_size", "kept", "text_sha256"]
        assert rows(out) == brute(docs)
    assert exact_dedup.dedup(df.limit(0)).collect() == []


def test_index_grows_by_resizing_and_follows_deletions(spark):
    docs = [(i, f"text {i % 400}") for i in range(900)]
    part = lambda d: exact_dedup.written(spark.createDataFrame([(bytes.fromhex(key(t)), i, i) for i, t in d], "digest binary, ord long, rid long"))
    index = exact_dedup.CuckooIndex(3, room=8)
    index.insert(part(docs[:100]))
    index.insert(part(docs[100:]))
    assert index.resized >= 3  # each filter was made for 8 keys and holds about 133

    def check(live):
        want = {}
        for i, t in live:
            first, n = want.get(key(t), (i, 0))
            want[key(t)] = (min(first, i), n + 1)
        got = {r["digest"].hex(): (r["first"]["ord"], r["n"]) for r in index.entries().collect()}
        assert got == want
        assert sum(int((np.frombuffer(r["slots"], np.uint16) != 0).sum()) for r in index.filters.collect()) == len(want)

    check(docs)
    dead = [i for i in range(900) if i % 400 < 50 or i < 120]
    index.delete(spark.createDataFrame([(i,) for i in dead], "ord long"))
    live = [x for x in docs if x[0] not in set(dead)]
    check(live)
    asked = index._summed(part(docs[:60])).withColumn("n", F.lit(1).cast("long"))
    known = {r["digest"].hex(): r["known"] for r in index.lookup(asked).collect()}
    assert known == {key(t): any(key(t) == key(u) for _, u in live) for _, t in docs[:60]}
    index.insert(part(docs[:10]))
    check(live + docs[:10])
