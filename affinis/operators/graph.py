"""Co-occurrence graphs: label propagation, components, betweenness, modularity, communities. Edges are (u, v), u < v."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.checkpoints import cut
from affinis.operators import tiles
from affinis.operators.similarity import joined_counts, pair_counts, tiled

SMALL = 5_000  # edges of a graph that may go to one task
LABELS = 500_000  # labels that may go to every task
SHIPPED = 200_000  # edges of a graph that may go to every task


def cooccurrence(pair_rows: DataFrame, least: int) -> DataFrame:
    """(u, v, n): keys with at least `least` common items."""
    return pair_counts(pair_rows, least).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("common").alias("n"))


def outline(pair_rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(u, v) with the components of cooccurrence(pair_rows, least) and (id, k) with its vertices' degrees. Where tiles pay, no edges are
    made: a task returns these for what it finds."""
    pair_rows, blocks = tiled(pair_rows)
    if blocks:
        found = cut(tiles.outlined(pair_rows, "key", "item", blocks, least))
        return found.where("u <> v").select("u", "v"), found.where("u = v").groupBy(F.col("u").alias("id")).agg(F.sum("k").alias("k"))
    edges = cut(joined_counts(pair_rows).where(F.col("common") >= least).select(F.col("a").alias("u"), F.col("b").alias("v")))
    return edges, degrees(edges)


def directed(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def degrees(edges: DataFrame) -> DataFrame:
    return directed(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("k"))


def vertices(edges: DataFrame) -> DataFrame:
    return directed(edges).select(F.col("u").alias("id")).distinct()


def label_propagation(edges: DataFrame, rounds: int = 5, repeated: bool = True) -> DataFrame:
    """(id, label) after synchronous rounds; the most frequent label among neighbours wins, ties to the smallest. repeated: an edge may
    be there more than once, and counts so often."""
    arcs = directed(cut(edges.select("u", "v")))
    if rounds < 1:
        return arcs.select(F.col("u").alias("id")).distinct().withColumn("label", F.col("id"))
    # in the first round each neighbour has a label of its own, so the smallest wins, unless an edge is there twice
    once = arcs.groupBy("v", "u").agg(F.count("*").alias("n")) if repeated else arcs.withColumn("n", F.lit(1))
    best = F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")
    labels = cut(once.withColumnRenamed("u", "label").groupBy(F.col("v").alias("id")).agg(best).select("id", F.col("best.label").alias("label")))
    few = labels.count() <= LABELS
    for _ in range(rounds - 1):
        votes = arcs.join(F.broadcast(labels) if few else labels, F.col("u") == F.col("id")).groupBy(F.col("v").alias("id"), "label").agg(F.count("*").alias("n"))
        labels = cut(votes.groupBy("id").agg(best).select("id", F.col("best.label").alias("label")))
    return labels


def forest(edges: DataFrame) -> DataFrame:
    """(u, v) with the components of edges (u, v; whole numbers) and no more edges than vertices in each partition: edges go by and are
    replaced by stars of what hangs together so far. Nulls and loops are left out."""

    def grow(batches):
        import numpy as np
        import pyarrow as pa

        stars, waiting, n = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

        def settled():
            u, v = (np.concatenate([stars[k], *(w[k] for w in waiting)]) for k in (0, 1))
            known, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            i, j = at[: len(u)], at[len(u) :]
            root = np.arange(len(known))
            while len(i):  # each root takes the least root next to it; then all nodes go up to their roots
                np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
                while (up := root[root] != root).any():
                    root = np.where(up, root[root], root)
                i, j = root[i], root[j]
                apart = i != j
                i, j = i[apart], j[apart]
            hang = root != np.arange(len(known))
            return known[root[hang]], known[hang]

        for b in batches:
            waiting.append([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)])
            n += b.num_rows
            if n > 500_000 + 2 * len(stars[0]):
                stars, waiting, n = settled(), [], 0
        stars = settled()
        yield pa.RecordBatch.from_arrays([pa.array(stars[0]), pa.array(stars[1])], names=["u", "v"])

    clean = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    return clean.mapInArrow(grow, "u long, v long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest vertex that can be reached, by rounds of large and small stars.

    In a large-star round each vertex points its larger neighbours at the smallest vertex around it, in a small-star round itself
    and its smaller ones; the rounds needed grow with the logarithm of the vertices, not with a path's length. Nulls and loops are
    left out. Raises if it has not settled in max_rounds.
    """
    clean = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = cut(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = directed(now)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")


def betweenness(adjacent: dict, roots=None) -> dict:
    """Edge betweenness of an undirected graph given as neighbour sets, by shortest-path counts from every vertex, or from roots."""
    total: dict = {}
    for root in adjacent if roots is None else roots:
        depth, paths, order, queue = {root: 0}, {root: 1}, [], deque([root])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in adjacent[x]:
                if y not in depth:
                    depth[y], paths[y] = depth[x] + 1, 0
                    queue.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
        credit = dict.fromkeys(order, 1.0)
        for y in reversed(order):
            for x in adjacent[y]:
                if depth[x] == depth[y] - 1:
                    part = credit[y] * paths[x] / paths[y]
                    credit[x] += part
                    e = (min(x, y), max(x, y))
                    total[e] = total.get(e, 0.0) + part / 2
    return total


def parts(adjacent: dict) -> list[list]:
    seen, out = set(), []
    for root in sorted(adjacent):
        if root not in seen:
            seen.add(root)
            group, queue = [root], deque([root])
            while queue:
                for y in adjacent[queue.popleft()]:
                    if y not in seen:
                        seen.add(y)
                        group.append(y)
                        queue.append(y)
            out.append(sorted(group))
    return out


def quality(groups: list[list], adjacent: dict, m: int) -> float:
    """Modularity without its i = j terms: a constant for a graph."""
    q = 0.0
    for g in groups:
        inside = set(g)
        links = sum(len(adjacent[x] & inside) for x in g) / 2
        k = [len(adjacent[x]) for x in g]
        q += links - (sum(k) ** 2 - sum(x * x for x in k)) / 2 / (2 * m)
    return q / m


def whole(edges: DataFrame, run, schema: str) -> DataFrame:
    """run(neighbour sets) -> rows, in one task: for graphs of at most SMALL edges; a larger one raises."""
    if edges.limit(SMALL + 1).count() > SMALL:
        raise ValueError(f"over {SMALL} edges")

    def one(pdf):
        import pandas as pd

        adjacent: dict = {}
        for u, v in zip(pdf.u.tolist(), pdf.v.tolist(), strict=True):
            adjacent.setdefault(u, set()).add(v)
            adjacent.setdefault(v, set()).add(u)
        return pd.DataFrame(run(adjacent), columns=[c.split()[0] for c in schema.split(", ")])

    return edges.select("u", "v", F.lit(0).alias("all")).groupBy("all").applyInPandas(one, schema)


def twins(edges: DataFrame) -> DataFrame:
    """(id, c, near): vertices with the same neighbours, themselves aside, have the same c, the smallest of them; near: they are neighbours
    of each other. Sets of neighbours are compared by two hashes; edge_betweenness checks that the classes are right."""
    hashes = [F.xxhash64("v"), F.xxhash64("v", F.lit(1))]
    v = directed(edges).groupBy(F.col("u").alias("id")).agg(*(F.bit_xor(h).alias(f"o{k}") for k, h in enumerate(hashes)))
    v = v.withColumns({"c0": F.col("o0").bitwiseXOR(F.xxhash64("id")), "c1": F.col("o1").bitwiseXOR(F.xxhash64("id", F.lit(1)))})
    apart, near = Window.partitionBy("o0", "o1"), Window.partitionBy("c0", "c1")
    v = v.withColumns({"a": F.min("id").over(apart), "n": F.min("id").over(near), "nn": F.count("*").over(near)})
    return v.select("id", F.when(F.col("nn") > 1, F.col("n")).otherwise(F.col("a")).alias("c"), (F.col("nn") > 1).alias("near"))


def class_betweenness(x, y, weight, apart, roots):
    """The betweenness of an edge between classes x[k] and y[k] of alike vertices (see twins), from the roots' classes only; weight: vertices
    of each class; apart: whether they are no neighbours. All by numbers from 0 on; each class has an edge."""
    import numpy as np

    n, m = len(weight), len(x)
    head, tail = np.concatenate([x, y]), np.concatenate([y, x])
    order = np.argsort(head, kind="stable")
    tail, first = tail[order], np.concatenate([[0], np.cumsum(np.bincount(head, minlength=n))[:-1]])
    degree = np.add.reduceat(weight[tail], first)
    around = lambda z: np.add.reduceat(z[tail], first, axis=0)
    total = np.zeros(m)
    step = max(1, 1_000_000 // (2 * m))
    for s in range(0, len(roots), step):
        r = roots[s : s + step]
        k = np.arange(len(r))
        many = np.repeat(weight[:, None], len(r), 1)
        many[r, k] = 1.0  # the root itself; those like it are leaves: next to it, or two steps away
        depth, paths = np.full((n, len(r)), -1, np.int32), np.zeros((n, len(r)))
        depth[r, k], paths[r, k] = 0, 1.0
        d = 0
        while True:
            got = around(np.where(depth == d, paths * many, 0.0))
            new = (got > 0) & (depth < 0)
            if not new.any():
                break
            d += 1
            depth[new], paths[new] = d, got[new]
        leaf = np.where(apart[r], (weight[r] - 1) / degree[r], 0.0)
        credit = np.where(depth == 1, 1.0 + leaf, 1.0)
        for e in range(d - 1, 0, -1):
            here = depth == e
            part = around(np.divide(many * credit, paths, out=np.zeros_like(paths), where=depth == e + 1))
            credit[here] += (paths * part)[here]
        ratio = np.divide(credit, paths, out=np.zeros_like(paths), where=depth >= 0)
        from_root = np.zeros((n, len(r)))
        from_root[r, k] = 1.0
        times = paths * np.where(from_root > 0, 1.0, weight[r])
        for p, q in ((x, y), (y, x)):
            total += np.where(depth[q] == depth[p] + 1, times[p] * ratio[q], 0.0).sum(1) + (from_root[p] * leaf).sum(1)
    return total / 2


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """(u, v, value). Vertices with the same neighbours (see twins) have one start between them; the tasks start from their share of these
    classes and hold the graph of classes, which has at most SHIPPED edges; a larger one raises."""
    import numpy as np

    clean = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    of = cut(twins(clean))
    ends = clean.join(of.select(F.col("id").alias("u"), F.col("c").alias("cu"), "near"), "u").join(of.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v")
    ends = cut(ends.select("u", "v", F.least("cu", "cv").alias("x"), F.greatest("cu", "cv").alias("y"), "near"))
    links = ends.groupBy("x", "y").agg(F.count("*").alias("n"))
    links = cut(links.join(of.groupBy(F.col("c").alias("x")).agg(F.count("*").alias("wx"), F.max("near").alias("nx")), "x").join(
        of.groupBy(F.col("c").alias("y")).agg(F.count("*").alias("wy"), F.max("near").alias("ny")), "y"))
    inside = F.col("x") == F.col("y")
    if links.where(F.col("n") != F.when(inside, F.col("wx") * (F.col("wx") - 1) / 2).otherwise(F.col("wx") * F.col("wy"))).limit(1).count():
        raise RuntimeError("classes of alike vertices are not alike")
    if (found := links.where(~inside).limit(SHIPPED + 1).count()) > SHIPPED:
        raise ValueError(f"over {SHIPPED} edges")
    inner = ends.where("x = y").select("u", "v", F.lit(1.0).alias("value"))
    if not found:
        return inner
    # whole numbers in the arrays below; as many as SHIPPED allows
    q = links.where(~inside).select("x", "y", "wx", "wy", "nx", "ny").toArrow().to_pydict()
    q = {k: np.array(v) for k, v in q.items()}
    ids, at = np.unique(np.concatenate([q["x"], q["y"]]), return_inverse=True)
    x, y = at[: len(q["x"])], at[len(q["x"]) :]
    weight, apart = np.ones(len(ids)), np.zeros(len(ids), bool)
    for e, w, near in ((x, "wx", "nx"), (y, "wy", "ny")):
        weight[e], apart[e] = q[w], ~q[near]

    def share(batches):
        import pyarrow as pa

        roots = np.concatenate([np.empty(0, np.int64), *(b.column(0).to_numpy() for b in batches)])
        if len(roots):
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(class_betweenness(x, y, weight, apart, roots))], names=["x", "y", "value"])

    spark = edges.sparkSession
    tasks = min(spark.sparkContext.defaultParallelism, -(-len(ids) * len(x) // 2_000_000))
    parts_ = spark.range(0, len(ids), 1, max(1, tasks)).mapInArrow(share, "x long, y long, value double").groupBy("x", "y").agg(F.sum("value").alias("value"))
    return ends.where("x <> y").join(parts_, ["x", "y"]).select("u", "v", "value").union(inner)


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(q): modularity of a partition (id, label), without the i = j terms; distributed."""
    l1, l2 = labels.select(F.col("id").alias("u"), F.col("label").alias("lu")), labels.select(F.col("id").alias("v"), F.col("label").alias("lv"))
    inside = edges.join(l1, "u").join(l2, "v").agg(F.count(F.when(F.col("lu") == F.col("lv"), 1)).alias("inside"), F.count("*").alias("m"))
    return scored(degrees(edges), labels, inside)


def component_modularity(pair_rows: DataFrame, least: int) -> DataFrame:
    """(q): modularity of the components of cooccurrence(pair_rows, least). All edges are inside one, so degrees and stars will do."""
    stars, degree = outline(pair_rows, least)
    degree = cut(degree)
    inside = degree.agg(F.expr("coalesce(sum(k), 0) div 2").alias("m")).select(F.col("m").alias("inside"), "m")
    return scored(degree, connected_components(stars).select("id", F.col("component").alias("label")), inside)


def scored(degree: DataFrame, labels: DataFrame, inside: DataFrame) -> DataFrame:
    """(q) of degrees (id, k), a partition (id, label) and (inside, m): the edges inside its parts, and all."""
    sums = degree.join(labels, "id").groupBy("label").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
    lost = sums.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("lost"))
    return inside.join(lost, F.lit(True)).select(F.round((F.col("inside") - F.col("lost") / (2 * F.col("m"))) / F.col("m"), 6).alias("q"))


def girvan_newman(edges: DataFrame) -> DataFrame:
    """(community, size, members) of the best partition met while the edge of most betweenness is cut, again and again."""

    def values(now, group):
        """The betweenness of a component's edges."""
        import numpy as np

        at = {x: k for k, x in enumerate(group)}
        e = [(x, y) for x in group for y in now[x] if x < y]
        if not e:
            return {}
        x, y = (np.array([at[z[k]] for z in e]) for k in (0, 1))
        one = np.ones(len(group))
        return dict(zip(e, class_betweenness(x, y, one, one > 0, np.arange(len(group))).tolist(), strict=True))

    def run(first):
        m = sum(map(len, first.values())) // 2
        now = {x: set(n) for x, n in first.items()}
        best, found, groups = None, [], parts(now)
        worth, split = {e: x for g in groups for e, x in values(now, g).items()}, True
        while worth:
            if split:
                q = quality(groups, first, m)
                if best is None or q > best + 1e-12:
                    best, found = q, groups
            u, v = min(worth.items(), key=lambda e: (-round(e[1], 9), e[0]))[0]
            now[u].discard(v)
            now[v].discard(u)
            # only the paths of what was the edge's component change
            del worth[u, v]
            groups, was = parts(now), len(groups)
            split = len(groups) > was
            for g in groups:
                if u in (inside := set(g)) or v in inside:
                    worth |= values(now, g)
        found = sorted(found, key=lambda g: (len(g), g[0]))
        return [(k, len(g), g) for k, g in enumerate(found)]

    return whole(edges, run, "community long, size long, members array<long>")


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    return edges.orderBy(F.desc("n"), "u", "v").limit(k)
