import numpy as np
import pytest

from lumenfield.llm import embedding_dedup


def brute(rows, threshold):
    n = len(rows)
    ok = [label is not None and v and None not in v and np.isfinite(v).all() and np.any(v) for _, v, label in rows]
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return sorted((rows[i][0], links[i], min(rows[j][0] for j in range(n) if find(j) == find(i))) for i in range(n))


@pytest.mark.parametrize("threshold, tile", [(0.93, 2048), (0.8, 16)])
def test_against_brute_force(spark, threshold, tile):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 24))
    rows = []
    for i in range(240):
        v = centres[rng.integers(12)] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.5])
        rows.append((i, np.round(v, 3).tolist(), int(rng.integers(2))))
    rows += [(240 + i, rows[3][1], rows[3][2]) for i in range(30)]
    rows += [(270, None, 1), (271, [], 1), (272, [0.0] * 24, 1), (273, [float("nan")] * 24, 1), (274, [None] * 24, 1), (275, rows[0][1], None), (276, [1.0, 2.0], 1), (277, [2.0, 4.0], 1), (278, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.link(df, threshold, tile).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows, threshold)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.link(df).collect() == []


def test_exact_threshold_repeats_nulls_and_clashing_columns(spark):
    """Cosines just at, above and under the threshold; repeated and null vec_ids are rows of their own."""
    turn = lambda c: [float(c), float(np.sqrt(1 - c * c)), 0.0]
    at = np.nextafter(0.93, 1)
    while (lambda v: v[0] / np.sqrt(v[0] ** 2 + v[1] ** 2))(turn(at)) < 0.93:
        at = np.nextafter(at, 1)
    rows = [(1, [1.0, 0.0, 0.0], 3), (2, turn(at), 3), (3, [1.0, 0.0, 0.0], 4), (4, turn(0.93 - 1e-9), 4), (5, [0.0, 0.0, 2.0], 5), (5, [0.0, 0.0, 2.0], 5), (None, [0.0, 0.0, 1.0], 5), (None, [0.0, 3.0, 0.0], 5)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, point int, tile int, n_links int")
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embedding_dedup.link(df).collect()), key=str)
    assert got == sorted([(False, 1, 1, 1), (False, 2, 1, 1), (False, 3, 0, 3), (False, 4, 0, 4), (False, 5, 2, 5), (False, 5, 2, 5), (True, 0, 2, 5), (True, 0, 0, None)], key=str)
