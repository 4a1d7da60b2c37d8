from collections import Counter

import numpy as np

from lumenfield.llm import near_dup, queries


def bag(text, k=5):
    w = (text or "").encode().split()
    k = min(k, len(w)) or 1
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(docs):
    """Least id by document, over links at 0.8 or more and exact copies."""
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [bag(t) for _, t in docs]
    holds = {}
    for i, b in enumerate(bags):
        for s in b:
            holds.setdefault(s, []).append(i)
    pairs = {(i, j) for x in holds.values() for i in x for j in x if i < j}
    texts = {}
    for i, (_, t) in enumerate(docs):
        pairs.add((texts.setdefault(t or "", i), i))
    for i, j in pairs:
        if (docs[i][1] or "") == (docs[j][1] or "") or jaccard(bags[i], bags[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i), docs[i][0]) for i in range(len(docs))]


def test_components_agree_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(3)
    agree, n = 0, 200
    e = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
    for _ in range(n):
        f = near_dup.mix(e + rng.integers(1, 1 << 62, 1).astype(np.uint64))
        sig = near_dup.signatures(np.concatenate([f, f]), np.concatenate([wa, wb]), np.repeat([0, 1], 40), 2, 120)
        agree += (sig[0] == sig[1]).mean()
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs(agree / n - want) < 4 * np.sqrt(want * (1 - want) / (120 * n))


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r["class_id"] for r in queries.op3_minhash_near_dedup(spark, sf).collect()}
    assert [got[d] for d, _ in docs] == brute(docs)


def test_chains_heavy_weights_and_odd_rows(spark):
    base = [f"w{i}" for i in range(200)]
    chain = []
    for i in range(12):  # neighbours are alike, the ends are not
        chain.append((100 + i, " ".join(base)))
        base = base[:]
        base[i * 16] = f"x{i}"
        base[i * 16 + 1] = f"y{i}"
    docs = [*chain, (1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "one  two"), (6, "one two three"), (None, "one two three"), (7, "na " * 400 + "end"), (8, "na " * 390 + "end"), (9, "na " * 100 + "end"), (9, "na " * 100 + "end")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, node int, class_id int")
    rows = near_dup.classes(df).collect()
    want = sorted(zip([(d is None, d or 0) for d, _ in docs], brute(docs)))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["class_id"]) for r in rows) == want
    assert near_dup.classes(df.limit(0)).collect() == []


def test_very_long_texts_meet_their_near_copies(spark):
    words = [f"w{i % 9973}x{i // 7}" for i in range(60_000)]
    changed = [f"c{i}" if i % 50 == 7 else w for i, w in enumerate(words)]
    docs = [(3, " ".join(words)), (2, " ".join(changed)), (5, " ".join(words[:30_000])), (8, "short text of some words"), (9, " ".join(words))]
    assert 0.8 < jaccard(bag(docs[0][1]), bag(docs[1][1])) < 0.85
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {3: 2, 2: 2, 5: 5, 8: 8, 9: 2}
