"""Toxicity by a counterfactual-regularised linear classifier over words.

A document's features are its distinct words and their beginnings of 3 to 8 letters, lower-cased, anywhere in the whole
text. The fit takes one row of each of FIT_ROWS labelled ids at most (those whose md5 is smallest), counts documents and toxic
documents by feature, keeps the FEATURES that tell most of those in LEAST_DOCS documents or more (the model's size: bounds of
the fit, none of what is scored), and minimises logistic loss + ridge + the counterfactual term: in
labelled sentences that mention an identity term the term is swapped for each other term of its set, and the squared change
of the score is penalised, by how often the term is mentioned. So a mention alone doesn't move the score.

score is the model's probability; an empty or null text gets the intercept's. Rows with equal ids are scored one by one;
labels without a document, or null, are not learnt from; with no labels, or of one kind only, every score is that rate.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from affinis.llm.common import cut, held_out, labels_of, own_name, slices, small_batches, table

FIT_ROWS, FEATURES, LEAST_DOCS, THRESHOLD, CACHE = 12_000, 1_500, 4, 0.3, 100_000
WORDS = re.compile(r"[^\W\d_]+").findall
SENTENCE = re.compile(r"[.!?\n]+")
# Sets of identity terms whose swap leaves a sentence's toxicity as it is.
IDENTITY = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "disabled", "elderly"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in range(3, 9) if len(word) > n)]


def features(text: str | None) -> list[str]:
    """What the text has: a beginning that two or three distinct words share also counts as feature -2 or -3."""
    n = Counter(f for w in set(WORDS((text or "").lower())) for f in word_features(w))
    return [*n, *(f"{f}{k}" for f, c in n.items() if c > 1 for k in (2, 3) if c >= k)]


def mentions(text: str | None) -> list[str]:
    """The identity term of each sentence and term in it."""
    low = (text or "").lower()
    if not any(t in low for terms in IDENTITY for t in terms):
        return []
    return [t for s in SENTENCE.split(low) for ws in [set(WORDS(s))] for terms in IDENTITY for t in terms if t in ws]


def fit_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, y, text) of at most `limit` labelled documents that are not held out; of rows with one id the text of least hash."""
    some = (
        labels_of(labels, "toxic").where(~held_out(F.col("doc_id"))).withColumn("h", F.md5(F.col("doc_id").cast("string").cast("binary")))
        .orderBy("h").limit(limit).select(F.col("doc_id").alias("l_id"), "y")
    )
    found = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("l_id"))
    return found.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> tuple[dict[str, float], float]:
    """(weight by feature, intercept)."""
    with small_batches(docs.sparkSession):
        return fitted(docs, labels, limit)


def fitted(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[dict[str, float], float]:
    rows = cut(fit_rows(docs, labels, limit).select("y", "text"))
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not total or toxic in (0, total):
        rate = (toxic + 0.5) / (total + 1) if total else 0.0
        return {}, float(np.log(rate / (1 - rate))) if rate else -20.0

    def counted(batches):
        for b in slices(batches, 64):  # so many texts' counts at a time
            n, t = Counter(), Counter()
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = features(text)
                n.update(own)
                if y:
                    t.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([t[f] for f in n], pa.int64())], names=["f", "n", "t"])

    def swapped(batches):
        for b in slices(batches):
            n = Counter(s for text in b.column(0).to_pylist() for s in mentions(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["s", "n"])

    counts = rows.mapInArrow(counted, "f string, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= LEAST_DOCS)
    # how much a feature tells: the likelihood ratio of its own rate against the common one
    part = lambda k, n, p: F.when(k > 0, k * F.log(k / n / p)).otherwise(0.0)
    tells = part(F.col("t"), F.col("n"), toxic / total) + part(F.col("n") - F.col("t"), F.col("n"), 1 - toxic / total)
    best = [r.f for r in counts.withColumn("g", tells).orderBy(F.desc("g"), "f").limit(FEATURES).collect()]
    mentioned = {r.s: r.n for r in rows.select("text").mapInArrow(swapped, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()}
    names = sorted({*best, *(f for t in mentioned for f in word_features(t))})
    number = {f: k for k, f in enumerate(names)}

    def numbered(batches):
        scorer = Scorer(dict.fromkeys(names, 0.0))
        for b in slices(batches):
            own = [scorer.hits(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int32()))], names=["y", "k"])

    # at most `limit` rows of at most FEATURES numbers
    sparse = rows.mapInArrow(numbered, "y double, k array<int>").toArrow()
    y, lists = sparse.column("y").to_numpy(), sparse.column("k").combine_chunks()
    col = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    swaps = []
    for t, n in mentioned.items():
        for terms in IDENTITY:
            for a, b in permutations(terms, 2):
                if a == t:
                    change = {number[f]: 1.0 for f in word_features(b) if f in number}
                    for f in word_features(a):
                        change[number[f]] = change.get(number[f], 0.0) - 1.0
                    swaps.append((n / (len(terms) - 1), change))
    w, b = solve(row, col, y, len(names), swaps)
    return dict(zip(names, w.tolist(), strict=True)), b


def solve(row, col, y, n: int, swaps, ridge: float = 2e-5, fairness: float = 1.0, rounds: int = 400, step: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept, by Adam on the whole rows."""
    w, b = np.zeros(n), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    share = np.array([s for s, _ in swaps]) / len(y)
    at = [(np.array(list(c)), np.array(list(c.values()))) for _, c in swaps]
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col], minlength=len(y)) + b, -30, 30)))
        off = (p - y) / len(y)
        g = np.append(np.bincount(col, weights=off[row], minlength=n) + ridge * w, off.sum())
        for s, (i, c) in zip(share, at, strict=True):
            g[i] += 2 * fairness * s * (w[i] @ c) * c
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


class Scorer(dict):
    """word -> the features of the model that it can add to, as numbers; bounded."""

    def __init__(self, model: dict[str, float]):
        super().__init__()
        self.weights = np.array(list(model.values()) or [0.0])
        number = {f: k for k, f in enumerate(model)}
        # a feature and its counted forms make a row: what one, two and three words of a text turn on
        self.forms: list[tuple[int, int, int]] = []
        self.row: dict[str, int] = {}
        for f in {f[:-1] if f[-2:] in ("-2", "-3") else f: None for f in model}:
            self.row[f] = len(self.forms)
            self.forms.append(tuple(number.get(f + n, -1) for n in ("", "2", "3")))

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        own = self[word] = tuple(self.row[f] for f in word_features(word) if f in self.row)
        return own

    def hits(self, text: str | None) -> list[int]:
        """The numbers of the model's features that a text has."""
        n: dict[int, int] = {}
        for own in filter(None, map(self.__getitem__, set(WORDS((text or "").lower())))):
            for r in own:
                n[r] = n.get(r, 0) + 1
        return sorted(k for r, c in n.items() for k in self.forms[r][: min(c, 3)] if k >= 0)

    def of(self, text: str | None) -> float:
        return float(sum(self.weights[k] for k in self.hits(text)))


def score(docs: DataFrame, model: tuple[dict[str, float], float], name: str = "toxic_score") -> DataFrame:
    """docs with all its columns and the score, under a name that docs does not use."""
    weights, intercept = model
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(weights)
        for b in slices(batches):
            s = np.array([scorer.of(t) for t in b.column(at).to_pylist()], dtype=np.float64) + intercept
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, less those whose score reaches the threshold; whatever names its columns have, they stay as they are."""
    name = own_name("toxic_score", docs.columns)
    return cut(score(docs, fit(docs, labels), name).where(F.col(name) < threshold).drop(name))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return cut(scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted")
    ))
