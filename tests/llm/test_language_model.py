import math
import zlib
from collections import Counter

import numpy as np

from lumenfield.llm import language_model, queries


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def base(docs):
    fold = lambda d: zlib.crc32(str(d).encode()) % 7 if d is not None else None
    count = Counter(t for d, x in docs if d is not None and fold(d) != 2 for t in tokens(x))
    n, v = sum(count.values()), len(count)
    return [(d, fold(d) == 2, len(tokens(x)), sum(count[t] > 0 for t in tokens(x)), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(x))) for d, x in docs]


def test_base_scores_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    rows = {r["doc_id"]: r for r in queries.op6_language_model(spark, sf).collect()}
    for d, held, n, known, train, score in base(docs):
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert abs(r["base_score"] - score) < 1e-6 * max(1, abs(score)) and r["score"] < 0
    held = [r for r in rows.values() if r["held_out"]]
    ours, plain, n = (sum(r[c] for r in held) for c in ("score", "base_score", "n_tokens"))
    print("log10 a token: model", ours / n, "base", plain / n)
    assert ours > plain + 0.05 * n


def test_probabilities_sum_to_one():
    shape = language_model.Shape(70, 5)
    rng = np.random.default_rng(0)
    m, k = shape.symbols, shape.classes
    big, skip = rng.normal(size=(m, k)), rng.normal(size=(m, k))
    head = rng.normal(size=(m, shape.groups, language_model.CLASS))
    head[:, 1, 7:] = -60
    head -= np.log(np.exp(head).sum(axis=2, keepdims=True))
    model = {"big": big, "skip": skip, "z": np.log(np.exp(skip) @ np.exp(big).T), "head": head.reshape(m, -1)}
    for a, b in ((3, 9), (70, 70), (75, 1)):
        p = language_model.log_probabilities(model, shape, np.full(m, a), np.full(m, b), np.arange(m))
        assert abs((10**p).sum() - 1) < 1e-9


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "who knows"), (4, "a B a\x0bb"), (4, "a B a\x0bb"), (5, "É é " * 3000), (9, "zz")]
    df = spark.createDataFrame([(d, t) for d, t in docs], "doc_id long, text string")
    got = language_model.score(df, head=3, tails=4).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(map(key, base(docs)))
    have = sorted(key((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])) for r in got)
    assert [w[:-1] for w in want] == [h[:-1] for h in have] and np.allclose([w[-1] for w in want], [h[-1] for h in have])
    assert language_model.score(df.limit(0)).collect() == []


def test_words_of_one_symbol_have_features_of_their_own(spark):
    """One tail symbol: only features of the words themselves tell the pairs apart."""
    away = [d for d in range(10_000) if zlib.crc32(str(d).encode()) % 7 == 2]
    learnt = [d for d in range(10_000) if zlib.crc32(str(d).encode()) % 7 != 2]
    rows = [(learnt[i * 20 + k], f"f{i}zz g{i}zz h{(i + k) % 40}zz" if k % 2 else f"p{i}zz h{(i + k) % 40}zz q{i}zz") for i in range(40) for k in range(20)]
    asked = {away[0]: "f3zz g3zz", away[1]: "f3zz g8zz", away[2]: "p3zz f20zz q3zz", away[3]: "p3zz f20zz q8zz"}
    df = spark.createDataFrame(rows + list(asked.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in language_model.score(df, head=3, tails=1).collect() if r["doc_id"] in asked}
    assert got[away[0]] > got[away[1]] + 0.5 and got[away[2]] > got[away[3]] + 0.1


def test_pair_probabilities_sum_to_one_and_follow_the_counts():
    base = np.log(np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.5]))
    p = language_model.pair_probabilities(np.array([7, 7, 7, 7, 9, 9]), np.array([0, 50, 0, 1, 0, 0.0]), base, 100)
    assert np.allclose([p[:4].sum(), p[4:].sum()], 1) and np.allclose(p[4:], 0.5)
    assert p[1] > 0.85 and abs(p[0] / p[2] - 1 / 3) < 1e-9


def test_summary_and_scores_do_not_depend_on_the_number_of_buckets(spark):
    import random

    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(6000)]
    df = spark.createDataFrame([(i, " ".join(words[20 * i : 20 * i + 20])) for i in range(300)], "doc_id long, text string")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 37):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({r["doc_id"]: (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in language_model.score(df, head=63, tails=16).collect()})
            totals = spark.createDataFrame([(language_model.blocks.put_parts(language_model.blocks.put_words([w.encode() for w in sorted(set(words)) if hash(w) % n == b]), *map(language_model.blocks.put_numbers, language_model._halves(np.array([words.count(w) for w in sorted(set(words)) if hash(w) % n == b])))),) for b in range(n)], "payload binary")
            often, per_tail, kinds = language_model.summary(totals, 63, 16)
            want = sorted(Counter(words).items(), key=lambda x: (-x[1], x[0].encode()))[:63]
            assert often == [(w.encode(), c) for w, c in want] and per_tail.sum() == len(words) and kinds.sum() == len(set(words))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0].keys() == got[1].keys() and all(np.allclose(got[0][d], got[1][d], rtol=1e-3) for d in got[0])


def test_pairs_of_one_hash_have_one_base_in_any_order():
    """Two blocks send a pair under one key with different bases, as words of one hash would: the likelier one's, whichever comes first."""
    import pyarrow as pa

    b = language_model.blocks
    sent = [b.put_parts(*map(b.put_numbers, (*language_model._halves(np.array([77], np.uint64)), np.array([n]), np.array([base])))) for n, base in ((3, 900), (1, 500))]
    got = [language_model._fit(pa.table([pa.array([0, 1]), pa.array([0, 0], pa.int32()), pa.array(x, pa.binary())], schema=b.BACK_ARROW)).column("payload").to_pylist() for x in (sent, sent[::-1])]
    assert len({p for x in got for p in x}) == 1
    assert language_model.WORD_BITS + language_model.CONTEXT_BITS == 64


def test_clashing_columns_and_a_very_long_text(spark):
    rows = [(i, f"a b w{i % 5} c", 1, 2, 3) for i in range(40)] + [(90, "a b w1 c " * 30_000, 1, 2, 3), (None, None, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, score int, held_out int")
    got = {r["doc_id"]: r for r in language_model.score(df, head=3, tails=4).collect()}
    assert len(got) == 42 and got[90]["n_tokens"] == 120_001 and got[None]["n_tokens"] == 1 and all(np.isfinite(r["score"]) for r in got.values())
