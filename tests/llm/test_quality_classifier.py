import numpy as np

from lumenfield.llm import quality_classifier, queries


def test_descent_reaches_the_optimum_of_the_dual():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 6, replace=False)) for _ in range(60)]
    y = np.array([1.0 if 3 in r or 5 in r else -1.0 for r in rows])
    w = quality_classifier.descend(rows, y, np.ones(20), 1.0, 400)
    x = np.zeros((60, 21))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(6)
        x[i, -1] = 1
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + d) + 1e-6 for d in rng.normal(size=(300, 21)) * 0.02)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op7_quality_classifier(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    print("auc", auc, np.mean([(s >= 0.5) == y for y, s in held]), len(bad), len(good))
    assert auc > 0.9 and np.mean([(s >= 0.5) == y for y, s in held]) > 0.9


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x", 0), (3, "a b", 1), (3, "a b", 1)], "doc_id long, text string, score int")
    for rows in ([], [(1, 1)], [(1, 1), (2, 0), (3, None), (None, 1), (2, 0), (3, 1)]):
        out = quality_classifier.score(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
        assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.score(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_scores_against_a_brute_force_version(spark):
    """The whole query by dictionaries: counts, ratios, the dual by single coordinates until it stands still, the logistic curve by a fine search."""
    import math
    import random
    import zlib

    from pyspark.sql import functions as F

    from lumenfield.llm.near_dup import WordHashes

    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(160):
        y = rng.random() < 0.6
        pool = words[:40] if y else words[20:]
        docs.append((i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))), int(y)))
    docs.append((500, None, None))
    df = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs if y is not None], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_classifier.score(df, labels, bits=16, epochs=300).collect()}
    places = {r["doc_id"]: r["r"] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("r")).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    hashes = WordHashes()
    bags = {i: set(quality_classifier.indicators((t or "").encode(), hashes, 16).tolist()) for i, t, _ in docs}
    learnt = [(i, y) for i, _, y in docs if y is not None and fold(i) != 1]
    fit, apart = [x for x in learnt if places[x[0]] % 8], [x for x in learnt if places[x[0]] % 8 == 0]
    seen = {}
    for i, y in fit:
        for f in bags[i]:
            seen.setdefault(f, [0, 0])[y] += 1
    total = [sum(c[k] + 1 for c in seen.values()) + (1 << 16) - len(seen) for k in (0, 1)]
    ratio = lambda f: math.log((seen.get(f, (0, 0))[1] + 1) / total[1]) - math.log((seen.get(f, (0, 0))[0] + 1) / total[0])

    def vector(i):
        x = {f: ratio(f) for f in bags[i]}
        n = math.sqrt(sum(v * v for v in x.values())) or 1.0
        return {f: v / n for f, v in x.items()} | {"bias": 1.0}

    xs = {i: vector(i) for i, _, _ in docs}
    w, alpha = {}, dict.fromkeys((i for i, _ in fit), 0.0)
    dot = lambda x: sum(v * w.get(f, 0.0) for f, v in x.items())
    for _ in range(1500):
        moved = 0.0
        for i, y in fit:
            s = 2 * y - 1
            new = min(1.0, max(0.0, alpha[i] - (s * dot(xs[i]) - 1) / sum(v * v for v in xs[i].values())))
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                for f, v in xs[i].items():
                    w[f] = w.get(f, 0.0) + (new - alpha[i]) * s * v
                alpha[i] = new
        if moved < 1e-7:
            break
    m = [(max(-5.0, min(5.0, round(dot(xs[i]), 2))), y) for i, y in apart]
    assert len({y for _, y in m}) == 2
    cost = lambda a, b: 0.005 * (a - 2) ** 2 + 0.005 * b * b + sum(math.log1p(math.exp(-(2 * y - 1) * (a * z + b))) for z, y in m)
    a, b, step = 2.0, 0.0, 1.0
    while step > 1e-5:
        best = min(((a + i * step, b + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1)), key=lambda p: cost(*p))
        if best == (a, b):
            step /= 2
        a, b = best
    for i, _, _ in docs:
        want = 1 / (1 + math.exp(-(max(a, 1e-3) * dot(xs[i]) + b)))
        assert got[i]["held_out"] == (fold(i) == 1) and abs(got[i]["score"] - want) < 0.02
