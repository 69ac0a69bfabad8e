"""Approximate nearest neighbours by cross-polytope hashing.

A vector is padded to a power of two and turned by three rounds of random signs and a fast Hadamard transform, of which the
first AXES coordinates are kept; its hash is the largest of them, with its sign. A table joins two such hashes to a cell. Where
norms differ, one more coordinate brings all vectors to one length, so that the nearest direction has the largest inner
product. A query probes, in each of TABLES tables, the cells in descending order of the sum of its own two turned coordinates. How
many is measured: AUDIT queries are compared with all vectors, which gives the cells of each true neighbour, and the least
number of probes with recall TARGET is taken, for all queries alike. Candidates are ranked by the inner product of the original
vectors in double precision.

Cells are dealt over tasks in groups of about GROUP vectors, a fuller cell over several tasks, and so are the queries of a group
above QUERIES, so that no task holds more of either. A task passes on a query's K best, which lose none of the K best overall. A
query first visits the group of its best cell in each table; its K-th best there is what rows of all other groups must reach, so
that what travels for a query does not grow with the number of groups.

Vectors that are null, empty, zero or hold null or non-finite components, or are of another length than most, take no part;
nor do null ids. Equal scores go to the smaller id. A query with fewer candidates gets them all: where its probes bring fewer than
K, it is compared with all vectors. Rows with equal ids are rows of their own: each is a candidate of all others, each is a
query where its id is one, and ranks count for each query row. No vectors give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import cut, numbered, small_batches, table
from affinis.llm.embeddings import stacked, vectors

TABLES, AXES, K, AUDIT, TARGET, GROUP, QUERIES, SEED, LEVELS = 6, 64, 20, 128, 0.93, 16_384, 16_384, 5, 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n = x.shape[1]
    size = 1
    while size < n:
        x = x.reshape(len(x), -1, 2, size)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        size *= 2
    return x / np.sqrt(n)


class Hash:
    """The tables' pseudo-rotations, two each, for vectors of so many dimensions."""

    def __init__(self, dims: int, longest: float, flat: bool):
        self.dims, self.longest, self.flat = dims, longest, flat
        width = 1 << max(1, (dims + (not flat) - 1).bit_length())
        signs = np.random.default_rng(SEED).choice([-1.0, 1.0], size=(TABLES, 2, LEVELS, width))
        self.rotations = []  # what the transforms do to the unit vectors, axes beyond AXES left out
        for own in signs.reshape(-1, LEVELS, width):
            z = np.eye(width)
            for s in own:
                z = hadamard(z * s)
            self.rotations.append(z[: dims + (not flat), :AXES])
        self.axes = 2 * min(width, AXES)
        self.cells = self.axes**2

    def turned(self, x: np.ndarray, queries: bool, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Two tables (row, axis) of signed coordinates in table t, the negative axes after the positive ones."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        y = x / norm if queries or self.flat else x / self.longest
        if not self.flat:
            more = np.zeros(len(x)) if queries else np.sqrt(np.maximum(0, 1 - (norm[:, 0] / self.longest) ** 2))
            y = np.hstack([y, more[:, None]])
        one, two = (y @ r for r in self.rotations[2 * t : 2 * t + 2])
        return np.hstack([one, -one]), np.hstack([two, -two])

    def cell(self, x: np.ndarray, t: int) -> np.ndarray:
        one, two = self.turned(x, False, t)
        return one.argmax(axis=1) * self.axes + two.argmax(axis=1)


def reached(h: Hash, q: np.ndarray, t: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the sums of its coordinates for all cells of table t, and the least sum that it probes."""
    one, two = h.turned(q, True, t)
    sums = (one[:, :, None] + two[:, None, :]).reshape(len(q), -1)
    return sums, -np.partition(-sums, probes - 1, axis=1)[:, probes - 1]


def wanted(base: DataFrame, asked: DataFrame, h: Hash, k: int) -> int:
    """The least number of probes a table with recall TARGET, by brute force for AUDIT queries over all vectors."""
    sample = asked.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "row").limit(AUDIT).toArrow()
    if not sample.num_rows:
        return 1
    q, own = stacked(sample.column("v")), sample.column("row").to_numpy()

    def nearest(batches):
        # a task's k best for each query, and the cells they are in
        best, rows = np.zeros((len(q), 0)), np.zeros((len(q), 0, TABLES), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = stacked(b.column(1)), b.column(0).to_numpy()
            s = q @ x.T
            s[own[:, None] == ids[None]] = -np.inf
            cells = np.stack([h.cell(x, t) for t in range(TABLES)], axis=1)
            best = np.hstack([best, s])
            rows = np.concatenate([rows, np.broadcast_to(cells, (len(q), *cells.shape))], axis=1)
            m = min(k, best.shape[1])
            top = np.argpartition(-best, m - 1, axis=1)[:, :m]
            best, rows = np.take_along_axis(best, top, 1), np.take_along_axis(rows, top[:, :, None], 1)
        who = np.repeat(np.arange(len(q)), best.shape[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(who), pa.array(best.ravel()), pa.array(list(rows.reshape(-1, TABLES)), pa.list_(pa.int64()))], names=["q", "s", "cells"]
        )

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))
    top = base.select("row", "v").mapInArrow(nearest, "q long, s double, cells array<long>").where("s > double('-inf')").withColumn("r", rank)
    with small_batches(base.sparkSession):
        found = top.where(F.col("r") <= k).select("q", "cells").collect()  # at most AUDIT * k rows
    if not found:
        return 1
    who, cells = np.array([r.q for r in found]), np.array([r.cells for r in found])
    place = np.full(len(found), h.cells)
    for t in range(TABLES):
        one, two = h.turned(q, True, t)
        sums = np.sort((one[:, :, None] + two[:, None, :]).reshape(len(q), -1), axis=1)
        mine = one[who, cells[:, t] // h.axes] + two[who, cells[:, t] % h.axes]
        place = np.minimum(place, [h.cells - np.searchsorted(sums[w], m - 1e-12) for w, m in zip(who, mine, strict=True)])
    return int(np.sort(place)[int(np.ceil(TARGET * len(place))) - 1])


def best_of(q: np.ndarray, x: np.ndarray, allowed, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best among the vectors that are allowed to it, and those that tie with the k-th; of
    them only those that reach its least score."""
    found = []
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ x.T
        s[~allowed(slice(at, at + 256))] = -np.inf
        floor = least[at : at + 256].copy()
        if (open_ := np.flatnonzero(floor == -np.inf)).size:
            # a bound from the first vectors leaves few of the others
            some = s[open_, : max(1024, k)]
            m = min(k, some.shape[1])
            floor[open_] = -np.partition(-some, m - 1, axis=1)[:, m - 1]
        who, to = np.nonzero((s >= floor[:, None] - 1e-9) & (s > -np.inf))
        score = np.einsum("ij,ij->i", q[at + who], x[to])
        by = np.lexsort((-score, who))
        who, to, score = who[by], to[by], score[by]
        first = np.searchsorted(who, np.arange(len(floor)))
        size = np.diff(np.append(first, len(who)))
        kth = np.where(size >= k, score[np.minimum(first + k - 1, max(0, len(score) - 1))] if len(score) else 0.0, -np.inf)
        good = score >= kth[who]
        found.append((at + who[good], to[good], score[good]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def search(rows: DataFrame, is_query, k: int = K, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found, for the rows where is_query holds, among all others."""
    base = cut(numbered(vectors(rows, column).where("v IS NOT NULL AND vec_id IS NOT NULL").withColumn("d", F.size("v")), "row"))
    size = base.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = base.where(F.col("d") == size.d).select("row", F.col("vec_id").cast("long").alias("vec_id"), "v")
    number = base.schema["v"].dataType.simpleString()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    low, high, count = base.agg(F.min(norm), F.max(norm), F.count("*")).first()
    h = Hash(size.d, high, low > high * (1 - 1e-6))
    asked = base.where(is_query)
    probes = wanted(base, asked, h, k)

    def filled(batches):
        total = np.zeros((TABLES, h.cells), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x = stacked(b.column(0))
                for t in range(TABLES):
                    total[t] += np.bincount(h.cell(x, t), minlength=h.cells)
        t, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c), pa.array(total[t, c])], names=["t", "c", "n"])

    amount = np.zeros((TABLES, h.cells), dtype=np.int64)
    for r in base.select("v").mapInArrow(filled, "t long, c long, n long").groupBy("t", "c").agg(F.sum("n").alias("n")).collect():  # TABLES * cells
        amount[r.t, r.c] = r.n
    # groups of neighbouring cells; a cell over GROUP is one of its own, in parts
    parts = np.maximum(1, -(-amount // GROUP))
    group = np.zeros_like(amount)
    for t in range(TABLES):
        before, hot = (np.cumsum(amount[t]) - amount[t]) // GROUP, parts[t] > 1
        edge = np.append(True, before[1:] != before[:-1]) | hot | np.append(False, hot[:-1])
        group[t] = np.cumsum(edge) - 1
    groups = int(group.max()) + 1

    def probing(batches):
        """For each query and table: the groups that it visits, whether its best cell is there, the least sum that it probes."""
        for b in batches:
            q = stacked(b.column(2)) if b.num_rows else np.zeros((0, size.d))
            for at in range(0, len(q), 128):
                for t in range(TABLES):
                    sums, least = reached(h, q[at : at + 128], t, probes)
                    hit = (sums >= least[:, None] - 1e-12) & (amount[t] > 0)
                    if t == 0:
                        few = np.where(hit, amount[0], 0).sum(axis=1) < min(k + 1, count)
                        least[few], hit[few] = -np.inf, amount[0] > 0
                    row, c = np.nonzero(hit)
                    key = np.unique(row * groups + group[t][c])
                    row, g = key // groups, key % groups
                    best = group[t][np.where(hit, sums, -np.inf).argmax(axis=1)]
                    take = pa.array(at + row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), t)), pa.array(g), pa.array(g == best[row]), pa.array(least[row]), b.column(0).take(take), b.column(1).take(take)],
                        names=["t", "g", "first", "least", "q_row", "query_id"],
                    )

    visits = cut(asked.mapInArrow(probing, "t long, g long, first boolean, least double, q_row long, query_id long"))
    shares = np.ones((TABLES, groups), dtype=np.int64)
    for r in visits.groupBy("t", "g").agg(F.count("*").alias("n")).collect():  # TABLES * groups
        shares[r.t, r.g] = -(-r.n // QUERIES)
    most = np.zeros((TABLES, groups), dtype=np.int64)
    for t in range(TABLES):
        np.maximum.at(most[t], group[t], parts[t])

    # part and share tell the tasks of a group apart: a vector goes to each share of its part, a query to each part of its share
    def dealing(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, own = stacked(b.column(2)), b.column(0).to_numpy()
            for t in range(TABLES):
                c = h.cell(x, t)
                times = shares[t][group[t][c]]
                at = np.repeat(np.arange(len(x)), times)
                share = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(at)
                part = own[at] % parts[t][c[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), t)), pa.array(group[t][c[at]]), pa.array(part), pa.array(share), pa.array(c[at]), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take)],
                    names=["t", "g", "part", "share", "cell", "row", "vec_id", "v"],
                )

    def asking(batches):
        for b in batches:
            t, g, own = (b.column(c).to_numpy() for c in range(3))
            times = most[t, g]
            at = np.repeat(np.arange(b.num_rows), times)
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(part), pa.array((own % shares[t, g])[at]), *(c.take(take) for c in b.columns[2:])],
                names=["t", "g", "part", "share", "q_row", "query_id", "least", "floor", "v"],
            )

    keys = ("t", "g", "part", "share")
    kinds = "t long, g long, part long, share long"
    dealt = base.mapInArrow(dealing, f"{kinds}, cell long, row long, vec_id long, v {number}")

    def met(visiting: DataFrame) -> DataFrame:
        """What the visits (with floor, a score that found rows must reach) find: a query's best from each task."""
        rows = visiting.join(asked.select(F.col("row").alias("q_row"), "v"), "q_row").select("t", "g", "q_row", "query_id", "least", "floor", "v")
        asks = rows.mapInArrow(asking, f"{kinds}, q_row long, query_id long, least double, floor double, v {number}")
        return asks.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(ranked, "q_row long, query_id long, row long, vec_id long, score double")

    def ranked(mine, theirs):
        names = ["q_row", "query_id", "row", "vec_id", "score"]
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        t = mine.column("t")[0].as_py()
        q, x = stacked(mine.column("v")), stacked(theirs.column("v"))
        one, two = (y.astype(np.float64) for y in h.turned(q, True, t))
        cell, least = theirs.column("cell").to_numpy(), mine.column("least").to_numpy()
        qr, xr = mine.column("q_row").to_numpy(), theirs.column("row").to_numpy()
        cells, which = np.unique(cell, return_inverse=True)

        def allowed(some):
            good = (one[some][:, cells // h.axes] + two[some][:, cells % h.axes] >= least[some, None] - 1e-12)[:, which]
            return good & (qr[some, None] != xr[None])

        who, to, score = best_of(q, x, allowed, k, mine.column("floor").to_numpy())
        a, b = pa.array(who), pa.array(to)
        return pa.table({"q_row": mine.column("q_row").take(a), "query_id": mine.column("query_id").take(a), "row": theirs.column("row").take(b), "vec_id": theirs.column("vec_id").take(b), "score": pa.array(score)})

    once = lambda df: df.groupBy("q_row", "query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    # a query's best cells first: its k-th best there is what rows elsewhere must reach, so that few of them travel
    first = cut(once(met(visits.where("first").withColumn("floor", F.lit(float("-inf"))))))
    order = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score")))
    floors = first.withColumn("r", order).where(F.col("r") == k).select("q_row", F.col("score").alias("floor"))
    others = visits.where("NOT first").join(floors, "q_row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    best = once(first.unionByName(met(others)))
    place = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row"))
    return cut(best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
