"""Text quality: ridge scores over random Fourier features of document statistics, calibrated by isotonic regression.

Statistics of the whole text (sizes, kinds of letters, repeated words, and shares of lines that shout, list or carry signs) are
standardised on the training rows and mapped to cosines of random projections, whose products approximate a Gaussian kernel.
Each partition sums its part of the normal equations; sums of sums meet on the driver as one FEATURES x FEATURES matrix. Raw
scores then go to 0..1 by pool-adjacent-violators over BINS counts of training rows, linear between the pools' centres.

All labelled rows that are not held out are learnt from. Null texts count as empty, and are scored like any. Rows with equal
ids are scored one by one. With no labels, or of one kind only, every score is that rate (0.5 with none).
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import cut, held_out, labels_of, slices, table

FEATURES, GAMMA, RIDGE, BINS, SEED, THRESHOLD = 256, 0.03, 1e-3, 1024, 11, 0.7
KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower, 3 digit, 4 blank, 5 sentence mark, 6 other sign, 7 not ASCII
KIND[[*range(65, 91)]], KIND[[*range(97, 123)]], KIND[[*range(48, 58)]] = 1, 2, 3
KIND[[9, 10, 11, 12, 13, 32]] = 4
KIND[[ord(c) for c in ".,;:?'\"-()"]] = 5
KIND[[c for c in range(33, 127) if not KIND[c]]] = 6
KIND[128:] = 7
STATS = 18


def statistics(text: str | None) -> list[float]:
    """The numbers that a score may depend on."""
    text = text or ""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    kinds = KIND[data]
    n = max(1, len(data))
    count = np.bincount(kinds, minlength=8)
    words = text.split()
    m = max(1, len(words))
    again = sum(map(str.__eq__, words[1:], words[:-1])) if m > 1 else 0
    out = [
        np.log1p(len(data)), np.log1p(len(words)), min(40.0, n / m), count[1] / n, count[3] / n, count[4] / n, count[5] / n, count[6] / n,
        count[7] / n, len(set(words)) / m, again / m, text.count("|") / m, text.count("!") / m,
    ]
    if not len(data):
        return [*out, 0.0, 0.0, 0.0, 0.0, 0.0]
    starts = np.concatenate(([0], np.flatnonzero(data[:-1] == 10) + 1))
    sizes = np.diff(np.append(starts, len(data)))
    upper, lower, signs, blanks = (np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in (1, 2, 6, 4))
    shout, marked = (upper > lower) & (sizes > 8), (signs > 0.2 * (blanks + 1)) & (sizes > 8)
    lines = text.split("\n")
    dull = np.array([len(w) > 5 and len(set(w)) < 0.34 * len(w) for w in map(str.split, lines)])[: len(sizes)]
    dull = np.pad(dull, (0, len(sizes) - len(dull)))
    return [*out, sizes[shout].sum() / n, sizes[marked].sum() / n, sizes[dull].sum() / n, float(shout.any() | marked.any() | dull.any()), 1 - len(set(lines)) / len(lines)]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<float>) of whole texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            stats = np.array([statistics(t) for t in b.column(1).to_pylist()], dtype=np.float32).reshape(-1, STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(stats), pa.list_(pa.float32()))], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<float>")


def matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(-1, STATS)


class Model:
    """How to score: scaling, projections, ridge weights, calibration."""

    def __init__(self, mean, scale, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.project = rng.normal(size=(STATS, FEATURES - 1)) * np.sqrt(2 * GAMMA)
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES - 1)
        self.weights = np.zeros(FEATURES)
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8) @ self.project + self.phase
        return np.hstack([np.sqrt(2 / (FEATURES - 1)) * np.cos(z), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.x, self.y)


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centre and rate of each pool, for positions x with n rows of which y are ones."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, n, y, strict=True):
        pools.append([a * b, b, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 1], p[:, 2] / p[:, 1]


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """The model for stats (doc_id, stats) with labels (doc_id, quality)."""
    train = cut(stats.where(~held_out(F.col("doc_id"))).join(labels_of(labels, "quality"), "doc_id").select("stats", "y"))
    each = [F.col("stats")[k].cast("double") for k in range(STATS)]
    row = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0)), *map(F.avg, each), *map(F.stddev_pop, each)).first()
    total, ones = row[0], row[1]
    if not total or ones in (0, total):
        model = Model(np.zeros(STATS), np.ones(STATS))
        model.y = np.array([ones / total if total else 0.5])
        return model
    model = Model(np.array(row[2 : 2 + STATS]), np.maximum(1e-6, np.array(row[2 + STATS :])))

    def equations(batches):
        from pyspark import TaskContext

        a, b = np.zeros((FEATURES, FEATURES)), np.zeros(FEATURES)
        for batch in batches:
            z, y = model.features(matrix(batch.column(0))), batch.column(1).to_numpy()
            a, b = a + z.T @ z, b + z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16]), pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["part", "a", "b"])

    def summed(batches):
        a, b = np.zeros(FEATURES * FEATURES), np.zeros(FEATURES)
        for batch in batches:
            for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a, b = a + np.frombuffer(x), b + np.frombuffer(y)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["part", "a", "b"])

    kinds = "part long, a binary, b binary"
    parts = train.mapInArrow(equations, kinds).repartition(16, "part").mapInArrow(summed, kinds).collect()  # 16 rows
    a = sum(np.frombuffer(p.a).reshape(FEATURES, FEATURES) for p in parts)
    b = sum(np.frombuffer(p.b) for p in parts)
    model.weights = np.linalg.solve(a + RIDGE * total * np.eye(FEATURES) / FEATURES, b)

    def binned(batches):
        n, y, x = np.zeros(BINS), np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            r = model.raw(matrix(batch.column(0)))
            k = np.clip((r + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
            n += np.bincount(k, minlength=BINS)
            y += np.bincount(k, weights=batch.column(1).to_numpy(), minlength=BINS)
            x += np.bincount(k, weights=r, minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (at, n[at], y[at], x[at])], names=["k", "n", "y", "x"])

    bins = train.mapInArrow(binned, "k long, n double, y double, x double").groupBy("k").agg(F.sum("n"), F.sum("y"), F.sum("x")).orderBy("k").collect()
    n, y, x = (np.array(c, dtype=np.float64) for c in list(zip(*bins, strict=True))[1:])
    model.x, model.y = isotonic(x / n, n, y)
    return model


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    stats = cut(measured(table(spark, sf_dir, "documents")))
    model = fit(stats, table(spark, sf_dir, "labels"))
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(matrix(b.column(1))))], names=["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
