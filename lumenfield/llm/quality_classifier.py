"""Quality classifier: a linear support vector machine over n-gram indicators scaled by naive Bayes ratios.

Indicators of word unigrams and bigrams and of byte trigrams are hashed into ``2**bits`` features. Each is scaled by the log ratio
of its smoothed class counts, which are summed over the labelled training rows; a row has length one after that.
The hinge loss is minimised by dual coordinate descent in parts of about ``part_rows`` rows, each in
one task, whose weights are averaged. Margins become probabilities by a logistic curve fitted to the margins of
training rows, one in eight, that were kept out of the counts and of the fit.

Scale: training texts move once, by doc_id, to meet their labels (the same join at every size); class counts are summed in each task and then by feature; weights
have a fixed size; scoring is one scan without a shuffle.

Defined results: a null text is an empty one (no indicators, the score of the bias); labels are by doc_id, the
majority of its non-null rows (a tie is 1); with no labels, or one class, scores are the smoothed share of 1;
rows with a null doc_id are scored and never learnt from; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .near_dup import WordHashes, mix

U = np.uint64


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def indicators(text: bytes, hashes: WordHashes, bits: int) -> np.ndarray:
    """Distinct hashed n-grams of a text."""
    shift = U(64 - bits)
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    b = np.frombuffer(text, np.uint8).astype(U)
    parts = [mix(h) >> shift]
    if len(h) > 1:
        parts.append(mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]) >> shift)
    if len(b) > 2:
        tri = np.unique((b[:-2] | b[1:-1] << U(8) | b[2:] << U(16)).astype(np.uint32)).astype(U)
        parts.append(mix(tri + U(1 << 40)) >> shift)
    return np.unique(np.concatenate(parts)).astype(np.int32)


def _class_counts(bits: int):
    schema = pa.schema([("feature", pa.int32()), ("c0", pa.int64()), ("c1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros((2, (1 << bits) + 1), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[y, indicators(text.as_py(), hashes, bits)] += 1
                counts[y, -1] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], schema=schema)

    return run


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int = 0) -> np.ndarray:
    """Weights (bias last) of the linear hinge-loss model, by dual coordinate descent."""
    w, alpha, rng = np.zeros(len(ratio) + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    xs = []
    for f in rows:
        x = ratio[f]
        xs.append(x / (np.sqrt(x @ x) or 1.0))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, x = rows[i], xs[i]
            gradient = y[i] * (w[f] @ x + w[-1]) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[f] += step * x
                w[-1] += step
    return w


def _fit_part(bits: int, ratio, c: float, epochs: int):
    schema = pa.schema([("n", pa.int64()), ("feature", pa.int32()), ("w", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        rows = [indicators(t.as_py(), hashes, bits) for t in table.column("text")]
        y = 2.0 * table.column("y").to_numpy() - 1
        w = descend(rows, y, ratio.value, c, epochs)
        at = np.flatnonzero(w)
        at = np.append(at, len(w) - 1) if not len(at) or at[-1] != len(w) - 1 else at
        return pa.table([pa.array(np.full(len(at), len(rows))), pa.array(at.astype(np.int32)), pa.array(w[at])], schema=schema)

    return run


def margins(texts: pa.Array, hashes: WordHashes, bits: int, ratio: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.full(len(texts), w[-1])
    for i, text in enumerate(texts):
        f = indicators(text.as_py(), hashes, bits)
        x = ratio[f]
        norm = np.sqrt(x @ x)
        if norm:
            out[i] += w[f] @ x / norm
    return out


def logistic(m: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin), by Newton's method with a weak prior on the slope."""
    a, b = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        e = (n0 + n1) * p - n1
        v = (n0 + n1) * p * (1 - p)
        g = np.array([e @ m + 0.01 * (a - 2), e.sum() + 0.01 * b])
        hess = np.array([[v @ (m * m) + 0.01, v @ m], [v @ m, v.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, bits: int = 18, c: float = 1.0, epochs: int = 8, part_rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    y = y.where(fold_of(F.col("doc_id"), folds) != held_out)
    known = docs.where(fold_of(F.col("doc_id"), folds) != held_out).select("doc_id", text.alias("text")).join(y.hint("shuffle_hash"), "doc_id")
    known = written(known.withColumn("r", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).select("text", "y", "r"), "labelled")
    counts = known.where("r % 8 <> 0").select("text", "y").mapInArrow(_class_counts(bits), "feature int, c0 long, c1 long").groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    n = np.zeros((2, (1 << bits) + 1))
    counts = counts.toArrow()  # at most 2**bits + 1 rows
    n[:, counts.column("feature").to_numpy()] = counts.column("c0").to_numpy(), counts.column("c1").to_numpy()
    rows = n[:, -1]
    p = n[:, :-1] + 1
    ratio = spark.sparkContext.broadcast(np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum()))
    weights, slope, offset = np.zeros((1 << bits) + 1), 1.0, float(np.log((rows[1] + 1) / (rows[0] + 1)))
    if rows.min() > 0:
        parts = max(1, int(-(-rows.sum() // part_rows)))
        fit = known.where("r % 8 <> 0").withColumn("part", (F.floor(F.col("r") / 8) % parts).cast("int"))
        fitted = fit.groupBy("part").applyInArrow(_fit_part(bits, ratio, c, epochs), "n long, feature int, w double")
        fitted = fitted.groupBy("feature").agg(F.sum(F.col("n") * F.col("w")).alias("w"), F.sum("n").alias("n"))
        fitted = fitted.toArrow()  # at most 2**bits + 1 rows
        at = fitted.column("feature").to_numpy()
        weights[at] = fitted.column("w").to_numpy()
        total = fitted.column("n").to_numpy()[at == 1 << bits].sum()
        weights /= total
    model = spark.sparkContext.broadcast(weights)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            m = margins(batch.column(0), hashes, bits, ratio.value, model.value)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.round(m * 100), -500, 500).astype(np.int32)), batch.column(1)], names=["bin", "y"])

    if rows.min() > 0:
        bins = known.where("r % 8 = 0").select("text", "y").mapInArrow(measured, "bin int, y int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).collect()  # at most 1001 rows
        if bins:
            m, k, k1 = (np.array([r[i] for r in bins], float) for i in range(3))
            slope, offset = logistic(m / 100, k - k1, k1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            m = margins(batch.column("text"), hashes, bits, ratio.value, model.value)
            s = 1 / (1 + np.exp(-np.clip(slope * m + offset, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    away = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), away.alias("held_out"), text.alias("text")).mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
