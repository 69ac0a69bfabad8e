"""K-means, cluster statistics and BFR. Points are (id, vec array<double>), centres and statistics small tables of clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.checkpoints import cut
from affinis.functions import euclidean, mahalanobis


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """points with cluster, dist: the nearest centre (cluster, centre), ties to the smallest cluster. centres: k rows."""
    k = centres.groupBy().agg(F.collect_list(F.struct("cluster", "centre")).alias("all"))
    near = F.array_min(F.transform("all", lambda c: F.struct(F.round(euclidean(F.col("vec"), c["centre"]), 9).alias("dist"), c["cluster"].alias("cluster"))))
    return points.join(F.broadcast(k), F.lit(True)).withColumn("near", near).select(*points.columns, F.col("near.cluster").alias("cluster"), F.col("near.dist").alias("dist"))


def means(assigned: DataFrame) -> DataFrame:
    dims = assigned.select("cluster", F.posexplode("vec").alias("d", "x")).groupBy("cluster", "d").agg(F.avg("x").alias("m"))
    return dims.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("centre"))


def small(df: DataFrame) -> DataFrame:
    """A table with a row for each cluster, through the driver: its lineage ends here."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def kmeans(points: DataFrame, centres: DataFrame, rounds: int) -> DataFrame:
    """(id, cluster) after so many Lloyd rounds from the given centres; a centre without points goes."""
    for _ in range(rounds):
        centres = small(means(assign(points, centres)))
    return assign(points, centres).select("id", "cluster")


def farthest_first(points: DataFrame, k: int, rows: int = 20_000) -> DataFrame:
    """(cluster, centre): k seeds from a sample of at most so many points (all, if there are fewer): its point of least id, then again
    and again the point farthest from all seeds, ties to the least id; fewer seeds where no other point is left."""
    spark, schema = points.sparkSession, "cluster long, centre array<double>"
    # the sample is bounded by rows
    sample = sorted(points.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(rows).collect(), key=lambda r: r.id)
    if not sample:
        return spark.createDataFrame([], schema)
    x = np.array([r.vec for r in sample])
    seeds, away = [0], np.full(len(x), np.inf)
    while len(seeds) < k:
        away = np.minimum(away, np.round(np.sqrt(((x - x[seeds[-1]]) ** 2).sum(axis=1)), 9))
        far = int(away.argmax())
        if away[far] == 0:
            break
        seeds.append(far)
    return spark.createDataFrame([(j, x[n].tolist()) for j, n in enumerate(seeds)], schema)


def statistics(assigned: DataFrame) -> DataFrame:
    """(cluster, n, total, squares): sufficient statistics by dimension."""
    dims = assigned.select("cluster", F.posexplode("vec").alias("d", "x")).groupBy("cluster", "d").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    rows = F.array_sort(F.collect_list(F.struct("d", "s", "q")))
    return dims.groupBy("cluster").agg(F.max("n").alias("n"), rows.alias("r")).select("cluster", "n", F.transform("r", lambda r: r["s"]).alias("total"), F.transform("r", lambda r: r["q"]).alias("squares"))


def mahalanobis_assign(points: DataFrame, stats: DataFrame, limit: float) -> DataFrame:
    """points with cluster and dist of the nearest cluster below limit, else null. stats: a row for each cluster."""
    k = stats.groupBy().agg(F.collect_list(F.struct("cluster", "n", "total", "squares")).alias("all"))
    near = F.array_min(F.transform("all", lambda c: F.struct(F.round(mahalanobis(F.col("vec"), c["n"], c["total"], c["squares"]), 6).alias("dist"), c["cluster"].alias("cluster"))))
    good = F.when(F.col("near.dist") < limit, F.col("near"))
    return points.join(F.broadcast(k), F.lit(True)).withColumn("near", near).withColumn("near", good).select(*points.columns, F.col("near.cluster").alias("cluster"), F.col("near.dist").alias("dist"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Statistics of two sets of clusters, added by cluster."""
    add = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    two = b.select("cluster", F.col("n").alias("n2"), F.col("total").alias("t2"), F.col("squares").alias("s2"))
    return a.join(two, "cluster", "left").select(
        "cluster", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.coalesce(add("total", "t2"), "total").alias("total"), F.coalesce(add("squares", "s2"), "squares").alias("squares")
    )


def trim(points: DataFrame, groups: DataFrame, share: float = 1e-4) -> DataFrame:
    """points without those whose cluster in groups (id, cluster) has fewer than that share of all points."""
    least = points.count() * share
    large = groups.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cluster")
    return points.join(groups.join(large, "cluster", "left_semi").select("id"), "id", "left_semi")


def unite(sets: list[tuple], limit: float) -> list[tuple]:
    """Statistics (cluster, n, total, squares) where, time after time, the set nearest to another is added to it, if below limit.

    The distance is that of a set's centre from the other set, in its deviations; a dimension without deviation where they differ is
    infinitely far. Ties go to the smallest numbers; the united set has the smaller number of both.
    """
    sets = sorted((c, n, np.array(t, dtype=float), np.array(q, dtype=float)) for c, n, t, q in sets)
    while len(sets) > 1:
        n = np.array([s[1] for s in sets], dtype=float)[:, None]
        mean = np.stack([s[2] for s in sets]) / n
        var = np.maximum(0, np.stack([s[3] for s in sets]) / n - mean * mean)
        apart = np.full((len(sets), len(sets)), np.inf)
        for j in range(len(sets)):
            gap = (mean - mean[j]) ** 2
            scaled = np.divide(gap, var[j], out=np.where(gap > 0, np.inf, 0.0), where=var[j] > 0)
            apart[:, j] = np.round(np.sqrt(scaled.sum(axis=1)), 6)
            apart[j, j] = np.inf
        apart = np.minimum(apart, apart.T)
        a, b = np.unravel_index(apart.argmin(), apart.shape)
        if not apart[a, b] < limit:
            break
        one, two = sets[a], sets.pop(b)
        sets[a] = (one[0], one[1] + two[1], one[2] + two[2], one[3] + two[3])
    return [(int(c), int(n), t.tolist(), q.tolist()) for c, n, t, q in sets]


def bfr_folder(spark, path: str, k: int, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """bfr over a folder of point files, a round for each, in the order of their names."""
    from affinis.sources import points

    return bfr(points(spark, path), "file", k, rounds)


def bfr(points: DataFrame, chunk: str, k: int, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """((id, cluster), round report) of BFR over the chunks in their order.

    The first chunk is clustered into 5 k groups in one round, and groups below a ten-thousandth of its points are set aside as
    retained; what is left is clustered into 3 k groups: the k largest are the discard sets, others with over one
    point compression sets, single points are retained. A later chunk's points go to the nearest discard set below 2 sqrt(d), else to
    the nearest compression set below 3 sqrt(d), else are retained. In every later round all retained points are then clustered into
    3 k groups again, and those with over one point become compression sets. Every round ends with compression sets within
    2 sqrt(d) of another merged into it, statistics added. In the end all points of compression sets and retained points go
    to the nearest discard set. Only statistics of the clusters, at most 3 k more a round, are on the driver.
    """
    spark = points.sparkSession
    chunks = [r[0] for r in points.select(chunk).distinct().orderBy(chunk).collect()]
    dims = len(points.first().vec)
    limit = math.sqrt(dims)
    first = points.where(F.col(chunk) == F.lit(chunks[0])).select("id", "vec")
    core = cut(trim(first, kmeans(first, farthest_first(first, 5 * k), 1)))
    groups = cut(kmeans(core, farthest_first(core, 3 * k), rounds))
    sized = groups.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").collect()
    ds = {r.cluster: j for j, r in enumerate(sized[:k])}
    cs = {r.cluster: 10_000 + j for j, r in enumerate(r for r in sized[k:] if r.n > 1)}
    lookup = spark.createDataFrame([(int(a), int(b)) for a, b in {**ds, **cs}.items()], "old long, cluster long")
    own = cut(first.join(groups.withColumnRenamed("cluster", "old"), "id", "left").join(F.broadcast(lookup), "old", "left").select("id", "vec", "cluster"))
    sums = "cluster long, n long, total array<double>, squares array<double>"
    number_of = 10_000 + len(cs)

    def settled(found):
        """The statistics, on the driver, with compression sets united."""
        rows = [tuple(r) for r in found.collect()]
        return spark.createDataFrame([r for r in rows if r[0] < 10_000] + unite([r for r in rows if r[0] >= 10_000], 2 * limit), sums)

    stats = settled(statistics(own.where("cluster IS NOT NULL")))
    placed, retained, report = own, own.where("cluster IS NULL").select("id", "vec"), []

    def note(number):
        c = {bool(r.cs): (r.g, r.n) for r in stats.groupBy((F.col("cluster") >= 10_000).alias("cs")).agg(F.count("*").alias("g"), F.sum("n").alias("n")).collect()}
        report.append((number, *c.get(False, (0, 0)), *c.get(True, (0, 0)), retained.count()))

    note(1)
    for number, name in enumerate(chunks[1:], 2):
        new = points.where(F.col(chunk) == F.lit(name)).select("id", "vec")
        near = cut(mahalanobis_assign(new, stats.where("cluster < 10000"), 2 * limit).drop("dist"))
        loose = near.where("cluster IS NULL").select("id", "vec")
        more = cut(mahalanobis_assign(loose, stats.where("cluster >= 10000"), 3 * limit).drop("dist"))
        taken = near.where("cluster IS NOT NULL").unionByName(more.where("cluster IS NOT NULL"))
        stats = small(merged(stats, statistics(taken)))
        left = retained.unionByName(more.where("cluster IS NULL").select("id", "vec"))
        if left.limit(2).count() > 1:
            groups = cut(kmeans(left, farthest_first(left, 3 * k), rounds))
            several = sorted(r.cluster for r in groups.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").collect())
            lookup = spark.createDataFrame([(int(c), number_of + j) for j, c in enumerate(several)], "old long, cluster long")
            number_of += len(several)
            again = cut(left.join(groups.withColumnRenamed("cluster", "old"), "id").join(F.broadcast(lookup), "old", "left").select("id", "vec", "cluster"))
        else:
            again = left.withColumn("cluster", F.lit(None).cast("long"))
        retained = again.where("cluster IS NULL").select("id", "vec")
        stats = settled(stats.unionByName(statistics(again.where("cluster IS NOT NULL"))))
        placed = placed.where("cluster IS NOT NULL").unionByName(taken).unionByName(again)
        note(number)
    # every leftover point goes to the nearest discard set
    discard = stats.where("cluster < 10000").select("cluster", F.transform("total", lambda s: s / F.col("n")).alias("centre"))
    last = assign(placed.where("cluster IS NULL OR cluster >= 10000").select("id", "vec"), discard)
    result = placed.where("cluster < 10000").select("id", "cluster").unionByName(last.select("id", "cluster"))
    schema = "round_id long, nof_cluster_discard long, nof_point_discard long, nof_cluster_compression long, nof_point_compression long, nof_point_retained long"
    return result, spark.createDataFrame(report, schema)
