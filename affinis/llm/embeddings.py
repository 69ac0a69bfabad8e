"""Embedding near-duplicates on a robust-pruned flat graph over overlapping cluster shards.

Equal vectors make one class, named by a row number. TABLES independent clusterings, each with centres from a bounded sample that
keep twice the link distance apart, make shards of about SHARD classes; where one level of centres is not enough, a second level
divides their residuals. In each clustering a class is at home in the shard of its nearest centre and joins the next WIDTH - 1
nearest too, as far as a link can reach there: of two linked vectors with homes a and b, one at least is less than
d |a - b| / 2 from the bound between both, with d = sqrt(2 - 2 threshold).

Build: in every shard each class at home gets a list of neighbours: of its nearest candidates one is kept only if no kept one is
closer to it by the factor ALPHA, all those that can share a link with it, and FAR others, up to DEGREE. Union: the lists of a
class from all its shards are united by a shuffle on the class. Search: with the united lists, the classes at home in a shard
search among its members, by a greedy beam search from the medoids of the shard and of its stretches, and from every hit (and the
class itself) by range expansion: neighbours of hits, until none is new. What it meets is verified in double precision. A pair
counts in the first clustering in which one is a member of the other's home.

Audit: inside a shard the number of each class's links is counted by a comparison with all members; a class that has met fewer
searches again with a wider beam, until none is missed. After it, AUDIT classes are compared with all classes, and where a link was missed all is repeated with WIDTH doubled, up to WIDEST. The recall
that the last audit measured is a column of the result. The work grows with the input times SHARD times WIDTH.

A shard above BLOCK members is dealt over blocks by hash, with lists of their own; each block's classes visit all others, one
pair of blocks a task. Pairs are counted and joined where they are found: what leaves a task is the count of each class and a
link to the least class that its pairs there lead to, in any number of steps.

Vectors that are null, empty, zero, or hold null or non-finite components, or are of another length than most, link with
nothing and are their own component. Rows with equal or null ids keep one row each and link like any others; a component without
ids has a null one. No vectors give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import components, cut, numbered, released, table

TABLES, SHARD, WIDTH, WIDEST, BLOCK, SAMPLE, CENTRES = 3, 2048, 3, 12, 8192, 20_000, 1024
DEGREE, FAR, CANDIDATES, ALPHA, BEAM, AUDIT, ENTRIES = 24, 6, 48, 1.2, 8, 256, 32


def valid(vector):
    """True for vectors that can be compared."""
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v) with v null where it can't be compared; v keeps its type where that is array<float>, else is array<double>."""
    v = F.col(column) if rows.schema[column].dataType.simpleString() == "array<float>" else F.col(column).cast("array<double>")
    return rows.select("vec_id", F.when(valid(v), v).alias("v"))


def stacked(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def lloyd(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k centres of x, from rows spread over it."""
    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        near = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some]) / n[some, None]
    return c


def parted(c: np.ndarray, least: float) -> np.ndarray:
    """The centres of c, without those nearer than `least` to one kept before."""
    kept: list[int] = []
    for j in range(len(c)):
        if not kept or ((c[kept] - c[j]) ** 2).sum(axis=1).min() >= least * least:
            kept.append(j)
    return c[kept]


class Shards:
    """One clustering: a shard is a pair of a centre and a centre of residuals."""

    def __init__(self, sample: np.ndarray, count: int, threshold: float):
        k = max(1, round(count / SHARD))
        first = min(k, CENTRES)
        self.reach = math.sqrt((1 - threshold) / 2)
        # by direction: where vectors have no clusters, means are short and all near zero
        self.one = parted(unit(lloyd(sample, first)), 2 * math.sqrt(2 - 2 * threshold))
        self.two = np.zeros((1, sample.shape[1]))
        if k > first:
            near = (sample @ self.one.T - (self.one**2).sum(axis=1) / 2).argmax(axis=1)
            self.two = lloyd(sample - self.one[near], min(CENTRES, -(-k // first)))

    def near(self, x: np.ndarray, width: int) -> np.ndarray:
        """(vector, width): the nearest shard of each unit vector, then those it joins, nearest first; -1 for none."""
        m = min(len(self.one), 2 * width)
        s = x @ self.one.T - (self.one**2).sum(axis=1) / 2
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        all_ = np.take_along_axis(s, top, 1)[:, :, None] + (x @ self.two.T - (self.two**2).sum(axis=1) / 2)[:, None, :] - (self.one @ self.two.T)[top]
        all_ = all_.reshape(len(x), -1)
        w = min(width, all_.shape[1])
        best = np.argsort(-all_, axis=1, kind="stable")[:, :w] if all_.shape[1] <= 64 else np.take_along_axis(
            part := np.argpartition(-all_, w - 1, axis=1)[:, :w], np.argsort(-np.take_along_axis(all_, part, 1), axis=1, kind="stable"), 1
        )
        score = np.take_along_axis(all_, best, 1)
        one, two = np.take_along_axis(top, best // len(self.two), 1), best % len(self.two)
        centre = self.one[one] + self.two[two]
        apart = np.sqrt(((centre - centre[:, :1]) ** 2).sum(axis=2))
        out = np.full((len(x), width), -1, dtype=np.int64)
        # 1e-7 for rounding
        out[:, :w] = np.where(score[:, :1] - score <= self.reach * apart + 1e-7, one * len(self.two) + two, -1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))


def clusterings(classes: DataFrame, count: int, threshold: float) -> list[Shards]:
    found = []
    for t in range(TABLES):
        # the sample is bounded by SAMPLE
        rows = classes.orderBy(F.xxhash64("v", F.lit(t)), "k").limit(min(SAMPLE, 64 * max(1, round(count / SHARD)))).select("v").toArrow()
        found.append(Shards(unit(stacked(rows.column("v"))), count, threshold))
    return found


def graph(x: np.ndarray, own: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Robust-pruned neighbours in x of the vertices `own`, as a list for each."""
    out = []
    m = min(CANDIDATES, len(x) - 1)
    if m <= 0:
        return [np.zeros(0, dtype=np.int64) for _ in own]
    shared = 2 - 2 * math.cos(2 * math.acos(threshold))  # a hit's neighbour beyond this squared distance can't be a hit
    for at in range(0, len(own), 512):
        some = own[at : at + 512]
        sims = x[some] @ x.T
        sims[np.arange(len(some)), some] = -np.inf
        near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        dist = 2 - 2 * np.take_along_axis(sims, near, 1)
        inner = 2 - 2 * (x[near] @ x[near].transpose(0, 2, 1))
        alive, rows = np.ones(near.shape, dtype=bool), np.arange(len(some))
        far = np.zeros(len(some), dtype=np.int64)
        lists = np.full((len(some), DEGREE), -1, dtype=np.int64)
        for d in range(min(DEGREE, m)):
            pick = alive.argmax(axis=1)
            good = alive[rows, pick]
            if not good.any():
                break
            lists[good, d] = near[rows[good], pick[good]]
            far += good & (dist[rows, pick] > shared)
            alive &= ~((ALPHA * inner[rows, pick] <= dist) & good[:, None])
            alive[rows, pick] = False
            alive &= ~((far >= FAR)[:, None] & (dist > shared))
        out += [l[l >= 0] for l in lists]
    return out


def both_ways(source: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All edges source-target among n vertices, both ways, as offsets and targets."""
    key = np.unique(np.concatenate([source * n + target, target * n + source]))
    source, target = key // max(n, 1), key % max(n, 1)
    return np.searchsorted(source, np.arange(n + 1)), target


def expand(offsets, targets, who, at):
    """Edges out of vertices `at` for queries `who`, as (query, neighbour)."""
    n = offsets[at + 1] - offsets[at]
    base = np.repeat(offsets[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(who, n), targets[base]


def search(q: np.ndarray, x: np.ndarray, offsets, targets, start: np.ndarray, threshold: float, beam: int, seeds) -> tuple[np.ndarray, np.ndarray]:
    """(query, vertex) of all that greedy search and range expansion meet at or above threshold; expansion also sets out from
    seeds (query, vertex): a query's own vertex, where the shard has it."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n), dtype=bool)
    width = min(beam, n)
    ids = np.full((b, width), -1, dtype=np.int64)
    sims = np.full((b, width), -np.inf)
    done = np.zeros((b, width), dtype=bool)
    first = q @ x[start].T
    seen[:, start] = True
    who, to = np.nonzero(first >= threshold)
    found = [np.stack([who, start[to]])]
    m = min(width, len(start))
    best = np.argpartition(-first, m - 1, axis=1)[:, :m]
    ids[:, :m], sims[:, :m] = start[best], np.take_along_axis(first, best, 1)
    active = np.arange(b)
    while len(active):
        open_ = np.where(done[active] | (ids[active] < 0), -np.inf, sims[active])
        pick = open_.argmax(axis=1)
        going = open_[np.arange(len(active)), pick] > -np.inf
        active, pick = active[going], pick[going]
        if not len(active):
            break
        done[active, pick] = True
        who, to = expand(offsets, targets, active, ids[active, pick])
        new = ~seen[who, to]
        who, to = who[new], to[new]
        seen[who, to] = True
        s = np.einsum("ij,ij->i", q[who], x[to])
        hit = s >= threshold
        found.append(np.stack([who[hit], to[hit]]))
        # each query's new neighbours beside its beam
        count = np.bincount(who, minlength=b)[active]
        most = int(count.max(initial=0))
        if not most:
            continue
        place = np.full(b, -1)
        place[active] = np.arange(len(active))
        slot = np.arange(len(who)) - np.repeat(np.cumsum(np.bincount(place[who], minlength=len(active))) - count, count)
        more_ids, more = np.full((len(active), most), -1, dtype=np.int64), np.full((len(active), most), -np.inf)
        more_ids[place[who], slot], more[place[who], slot] = to, s
        all_ids, all_sims = np.hstack([ids[active], more_ids]), np.hstack([sims[active], more])
        all_done = np.hstack([done[active], np.zeros(more.shape, dtype=bool)])
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[active], sims[active], done[active] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_sims, all_done))
    hits = np.concatenate(found, axis=1)
    seen[seeds[0], seeds[1]] = True
    edge = np.concatenate([hits, np.stack(seeds)], axis=1)
    while edge.shape[1]:  # range expansion
        who, to = expand(offsets, targets, edge[0], edge[1])
        new = ~seen[who, to]
        key = np.unique(who[new] * n + to[new])
        who, to = key // n, key % n
        seen[who, to] = True
        s = np.einsum("ij,ij->i", q[who], x[to])
        edge = np.stack([who[s >= threshold], to[s >= threshold]])
        hits = np.concatenate([hits, edge], axis=1)
    key = np.unique(hits[0] * n + hits[1])
    return key // n, key % n


def chained(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after links a-b: the least vertex that can be reached, for labels that are such already."""
    while True:
        one, two = label[a], label[b]
        open_ = one != two
        if not open_.any():
            return label
        a, b, one, two = a[open_], b[open_], one[open_], two[open_]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label != label[label]).any():
            label = label[label]


def links(classes: DataFrame, shards: list[Shards], width: int, threshold: float) -> DataFrame:
    """(k, n, low): for each class the number of vectors of other classes at or above threshold, by tasks, and a link: the (k, low)
    of a task connect whatever its pairs connect."""
    number = classes.schema["v"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            if b.num_rows:
                u = unit(stacked(b.column(2)))
                near = np.hstack([s.near(u, width) for s in shards]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int32()))], names=["k", "weight", "v", "near"])

    assigned = cut(classes.select("k", "weight", "v").mapInArrow(assign, f"k long, weight long, v {number}, near array<int>"))
    # a row for each clustering and shard that a class joins
    visits = F.filter(F.transform("near", lambda s, i: F.struct(F.floor(i / width).cast("int").alias("t"), s.alias("shard"), (i % width == 0).alias("home"))), lambda v: v["shard"] >= 0)
    joins = assigned.select("k", F.explode(visits).alias("at")).select("k", "at.*")
    blocks = cut(joins.groupBy("t", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))

    def members(rows: DataFrame) -> DataFrame:
        each = rows.select("*", F.explode(visits).alias("at")).select(*rows.columns, "at.*")
        return each.join(blocks, ["t", "shard"]).withColumn("block", F.pmod(F.xxhash64("k"), "blocks").cast("int"))

    def build(rows):
        k, home = rows.column("k").to_numpy(), rows.column("home").to_numpy(zero_copy_only=False)
        own = np.flatnonzero(home)
        if not len(own):
            return pa.table({"k": pa.array([], pa.int64()), "list": pa.array([], pa.list_(pa.int64()))})
        near = graph(unit(stacked(rows.column("v"))), own, threshold)
        return pa.table({"k": pa.array(k[own]), "list": pa.array([k[x] for x in near], pa.list_(pa.int64()))})

    lists = (
        members(assigned).select("t", "shard", "block", "k", "v", "home").groupBy("t", "shard", "block").applyInArrow(build, "k long, list array<long>")
        .groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("list"))
    )  # TABLES * DEGREE neighbours at most for each block that a class is in
    listed = cut(assigned.join(lists, "k", "left"))
    released(classes.sparkSession)
    every = members(listed)
    inside = every.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("asker"), F.lit(True).alias("member"))
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))
    asking = (
        every.where("home AND blocks > 1").withColumn("list", F.lit(None).cast("array<long>"))
        .select(*(F.col(c) for c in every.columns if c != "block"), F.col("block").alias("asker"), F.explode(other).alias("block"), F.lit(False).alias("member"))
    )
    columns = ["t", "shard", "block", "asker", "member", "home", "k", "weight", "v", "near", "list"]

    def run(rows):
        t, shard = rows.column("t")[0].as_py(), rows.column("shard")[0].as_py()
        member, home, k, weight = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("member", "home", "k", "weight"))
        near = np.stack(rows.column("near").to_pylist())
        v = unit(stacked(rows.column("v")))
        x, xk, xw, xnear = v[member], k[member], weight[member], near[member]
        asks = ~member if (~member).any() else home & (rows.column("asker")[0].as_py() == rows.column("block")[0].as_py())
        q, qk, qw, qnear = v[asks], k[asks], weight[asks], near[asks]
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("k", "n", "low")})
        if not len(x) or not len(q):
            return empty
        by = np.argsort(xk)
        sorted_k = xk[by]

        def places(ids):
            """Where classes are among the members, -1 for none."""
            at = np.minimum(np.searchsorted(sorted_k, ids), len(by) - 1)
            return np.where(sorted_k[at] == ids, by[at], -1)

        own_lists = rows.column("list").combine_chunks().filter(pa.array(member))
        size = own_lists.value_lengths().fill_null(0).to_numpy()
        source, target = np.repeat(np.arange(len(x)), size), places(own_lists.flatten().to_numpy(zero_copy_only=False))
        offsets, targets = both_ways(source[target >= 0], target[target >= 0], len(x))
        # the medoid of the shard and of each of its stretches
        cuts = np.linspace(0, len(x), min(ENTRIES, len(x)) + 1).astype(int)
        medoids = np.unique([int((x @ x.mean(axis=0)).argmax()), *(a + int((x[a:b] @ x[a:b].mean(axis=0)).argmax()) for a, b in zip(cuts, cuts[1:]))])
        at_own = places(qk)

        def ask(which, least, beam):
            own = np.flatnonzero(at_own[which] >= 0)
            return search(q[which], x, offsets, targets, medoids, least, beam, (own, at_own[which][own]))

        def met(which):
            """(query, member) of all links: those that have fewer than a comparison with all members counts search again, with a
            beam twice as wide."""
            truth = (q[which] @ x.T >= threshold + 1e-12).sum(axis=1) - (at_own[which] >= 0)
            beam, open_, found = BEAM, np.arange(len(which)), []
            while True:
                who, to = ask(which[open_], threshold - 1e-9, beam)
                who = which[open_[who]]
                # verified: the cosine itself
                good = (np.einsum("ij,ij->i", q[who], x[to]) >= threshold) & (qk[who] != xk[to])
                who, to = who[good], to[good]
                n = np.bincount(who - which[0], minlength=len(which))
                short = open_[n[open_] < truth[open_]] if beam < len(x) else open_[:0]
                done = ~np.isin(who, which[short])
                found.append(np.stack([who[done], to[done]]))
                if not len(short):
                    return np.concatenate(found, axis=1)
                open_, beam = short, 2 * beam

        ids = np.unique(np.concatenate([xk, qk]))
        qi, xi = np.searchsorted(ids, qk), np.searchsorted(ids, xk)
        n, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

        def joined(who, to, c):
            """Whether each pair meets in clustering c: by the query's home, by the other's home."""
            a, b = qnear[who, c * width : (c + 1) * width], xnear[to, c * width : (c + 1) * width]
            return (b == a[:, :1]).any(axis=1), (a == b[:, :1]).any(axis=1)

        step = max(16, min(512, 8_000_000 // len(x)))
        for at in range(0, len(q), step):
            who, to = met(np.arange(at, min(len(q), at + step)))
            label = chained(label, qi[who], xi[to])
            for c in range(t):
                new = ~np.logical_or(*joined(who, to, c))
                who, to = who[new], to[new]
            n += np.bincount(qi[who], weights=xw[to], minlength=len(ids)).astype(np.int64)
            # a member that is at home elsewhere finds the pair there, if the query is a member there
            single = ~joined(who, to, t)[1]
            n += np.bincount(xi[to[single]], weights=qw[who[single]], minlength=len(ids)).astype(np.int64)
        some = np.flatnonzero((n > 0) | (label != np.arange(len(ids))))
        return pa.table({"k": pa.array(ids[some], pa.int64()), "n": pa.array(n[some], pa.int64()), "low": pa.array(ids[label[some]], pa.int64())})

    return inside.select(*columns).unionByName(asking.select(*columns)).groupBy("t", "shard", "block", "asker").applyInArrow(run, "k long, n long, low long")


def audited(classes: DataFrame, counts: DataFrame, threshold: float) -> float:
    """The recall of counts (k, n) for AUDIT classes, by comparison with all classes."""
    sample = classes.orderBy(F.md5(F.col("k").cast("string").cast("binary")), "k").limit(AUDIT).toArrow()
    if not sample.num_rows:
        return 1.0
    q, own = unit(stacked(sample.column("v"))), sample.column("k").to_numpy()

    def compared(batches):
        total = np.zeros(len(q), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                near = (q @ unit(stacked(b.column(2))).T >= threshold + 1e-9) & (own[:, None] != b.column(0).to_numpy()[None])
                total += near @ b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total)], names=["k", "true"])

    true = classes.select("k", "weight", "v").mapInArrow(compared, "k long, true long").groupBy("k").agg(F.sum("true").alias("true"))
    both = true.join(counts.groupBy("k").agg(F.sum("n").alias("n")), "k", "left").agg(F.sum("true").alias("true"), F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("met")).first()
    return both.met / both.true if both.true else 1.0


def near_duplicates(rows: DataFrame, threshold: float = 0.95, column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) of every vector."""
    named = cut(numbered(vectors(rows, column).withColumn("d", F.size("v")), "row"))
    size = named.where("v IS NOT NULL").groupBy("d").count().orderBy(F.desc("count"), "d").first()
    usable = F.coalesce(F.col("d") == (size.d if size else -1), F.lit(False)) & F.col("v").isNotNull()
    # multiples have cosine 1 too, but are left to the search; only equal vectors merge here
    classes = cut(named.where(usable).groupBy("v").agg(F.min("row").alias("k"), F.count("*").alias("weight"), F.min("vec_id").alias("first")))
    count, width, recall = classes.count(), WIDTH, 1.0
    counts = None
    while count:
        counts = cut(links(classes, clusterings(classes, count, threshold), width, threshold))
        recall = audited(classes, counts, threshold)
        if recall >= 1 or width >= WIDEST:
            break
        width *= 2
    rest = named.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if counts is not None:
        per = counts.groupBy("k").agg(F.sum("n").alias("n"))
        found = components(counts.select(F.col("k").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("k"), "component")
        linked = classes.join(per, "k", "left").join(found, "k", "left").withColumn("component", F.coalesce("component", "k"))
        least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
        of = linked.join(least, "component").select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
        rest = named.where(usable).join(of, "v").select("vec_id", "n_links", "component_id").unionByName(rest)
    return rest.withColumns({"kept": F.col("vec_id").eqNullSafe(F.col("component_id")), "audit_recall": F.lit(float(recall))})


def op1_embedding_links(spark, sf_dir: str) -> DataFrame:
    """All embeddings, linked at cosine 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
