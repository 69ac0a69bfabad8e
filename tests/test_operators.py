"""Micro cases by hand, and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from affinis.functions import residue, trailing_zeros, words
from affinis.operators import baskets, cf, clustering, graph, similarity, sketches, stats


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "u long, v long").withColumn("n", F.lit(1))


def test_words_and_stopwords(spark):
    df = spark.createDataFrame([("The cat, (the) CAT! sat.",), ("",), (None,)], "t string")
    assert rows(stats.top_words(df, "t", ["the"], 5)) == [("cat", 2), ("sat", 1)]
    assert df.select(words(F.col("t")).alias("w")).collect()[0].w == ["the", "cat", "the", "cat", "sat"]


def test_category_avg_null_empty_and_repeated(spark):
    df = spark.createDataFrame([("a, b", 4.0), (None, 1.0), ("a,a", 1.0)], "c string, s double")
    assert rows(stats.category_avg(df, "c", "s", 5)) == [("a", 2.0), ("b", 4.0)]


def test_top_levels_keep_ties(spark):
    df = spark.createDataFrame([(k,) for k in "aabbccd"], "k string")
    assert rows(stats.top_levels(df, "k", 1)) == [("a", 2, 1), ("b", 2, 1), ("c", 2, 1)]


def test_partition_sizes_show_empty_ones(spark):
    df = spark.range(10)
    got = rows(stats.partition_sizes(df, 7, F.lit(1)))
    assert len(got) == 7 and sum(n for _, n in got) == 10


def test_itemsets_agree_with_fp_growth_and_are_closed(spark):
    data = [(b, i) for b, items in enumerate(["abc", "abd", "ab", "c", "abcd"]) for i in items]
    pairs = baskets.pairs(spark.createDataFrame(data, "key long, item string"), "key", "item")
    got = set(rows(baskets.itemsets(baskets.frequent(pairs, 2, 4))))
    assert got == set(rows(baskets.fp_growth(baskets.baskets(pairs, "key", "item"), 2)))
    sets = {frozenset(i.split(",")) for _, i, _ in got}
    assert all(s - {x} in sets for s in sets for x in s if len(s) > 1)
    assert not rows(baskets.itemsets(baskets.frequent(pairs, 9, 3))) and not rows(baskets.fp_growth(baskets.baskets(pairs.limit(0), "key", "item"), 2))


def test_lsh_is_part_of_exact_join(spark):
    data = [(k, i) for k in range(6) for i in range(k, k + 6)]
    p = spark.createDataFrame(data, "key long, item long")
    exact = set(rows(similarity.jaccard_join(p, 0.4)))
    assert {(a, b) for a, b, _ in rows(similarity.lsh_join(p, 0.4, 97, range(1, 350, 7), range(1, 20, 7)))} <= {(a, b) for a, b, _ in exact}
    assert (0, 1, 5 / 7) in exact


def test_pearson_needs_three_and_variance(spark):
    r = spark.createDataFrame(
        [(u, i, float(s)) for i, col in {"x": [1, 2, 3], "y": [2, 4, 6], "flat": [3, 3, 3], "two": [1, 2]}.items() for u, s in enumerate(col)], "user long, item string, stars double"
    )
    assert rows(cf.pearson(r, "item", "user")) == [("x", "y", 1.0)]


def test_predictions(spark):
    rated = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0), (2, 12, 5.0)], "user long, item long, stars double")
    model = spark.createDataFrame([(10, 12, 0.5), (11, 12, 0.5)], "a long, b long, sim double")
    test = spark.createDataFrame([(1, 12), (9, 12)], "user long, item long")
    assert rows(cf.predict_item(test, rated, model)) == [(1, 12, 3.0)]
    users = spark.createDataFrame([(1, 2, 1.0)], "a long, b long, sim double")
    assert rows(cf.predict_user(test, rated, rated, users)) == [(1, 12, 3.0)]


def test_bridge_betweenness_and_communities(spark):
    e = edges(spark, (1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6))
    got = {(u, v): x for u, v, x in rows(graph.edge_betweenness(e))}
    assert got[(3, 4)] == 9.0 and got[(1, 2)] == 1.0
    assert [r.members for r in graph.girvan_newman(e).orderBy("community").collect()] == [[1, 2, 3], [4, 5, 6]]
    assert {c for _, c in rows(graph.connected_components(e))} == {1}
    none = edges(spark, (1, 2)).where("u > 5")
    assert not rows(graph.girvan_newman(none)) and not rows(graph.label_propagation(none))


def test_components_raise_rather_than_split(spark):
    path = edges(spark, *((k, k + 1) for k in range(1, 200)), (300, 301), (301, 301), (None, 5))
    assert {c: sum(x == c for _, x in rows(graph.connected_components(path))) for c in (1, 300)} == {1: 200, 300: 2}
    assert not rows(graph.connected_components(path.limit(0)))
    with pytest.raises(RuntimeError):
        graph.connected_components(path, 2)


def test_betweenness_shares_add_up(spark):
    e = [(a, b) for a in range(12) for b in range(a + 1, 12) if (a * b) % 5 == 1 or b == a + 1]
    adjacent: dict = {}
    for a, b in e:
        adjacent.setdefault(a, set()).add(b)
        adjacent.setdefault(b, set()).add(a)
    want = graph.betweenness(adjacent)
    got = {(u, v): x for u, v, x in rows(graph.edge_betweenness(edges(spark, *e)))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_dense_codes_and_string_items(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (2, "a"), (2, "c"), (3, None)], "key long, item string")
    assert rows(stats.dense_codes(df, "item")) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(stats.dense_codes(df.repartition(3).select((F.col("key") * 10).alias("n")), "n")) == [(10, 0), (20, 1), (30, 2)]
    p = baskets.pairs(df, "key", "item")
    assert rows(similarity.coded(p)) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    assert rows(similarity.lsh_join(similarity.coded(p), 0.5, 97, range(1, 350, 7), range(1, 20, 7))) == [(1, 2, 2 / 3)]


def test_stopwords_may_be_a_table(spark):
    df = spark.createDataFrame([(1, "the cat the hat"), (2, "a cat")], "id long, t string")
    stop = spark.createDataFrame([("the",), ("a",)], "word string")
    assert rows(stats.top_words(df, "t", stop, 5)) == rows(stats.top_words(df, "t", ["the", "a"], 5)) == [("cat", 2), ("hat", 1)]
    twice = spark.createDataFrame([(1, "x x y"), (2, "y")], "id long, t string")
    got = {(k, w): s for k, w, s in rows(similarity.tfidf(twice, "id", "t", stop, 5, compat=True))}
    assert got[(1, "x")] == 2 * (1.0 / 2) ** 2 and got[(1, "y")] == 0.0


def test_son_finds_what_apriori_finds(spark):
    data = [(b, i) for b, items in enumerate(["abc", "abd", "ab", "c", "abcd", "xyz", "xy"]) for i in items]
    b = baskets.baskets(baskets.pairs(spark.createDataFrame(data, "key long, item string"), "key", "item").repartition(3), "key", "item")
    want = rows(baskets.itemsets(baskets.frequent(baskets.pairs(spark.createDataFrame(data, "key long, item string"), "key", "item"), 2, 3)))
    assert sorted(rows(baskets.son(b, 2, 3))) == sorted(want)
    assert set(want) <= {(len(r.items), ",".join(r["items"]), 0)[:2] + (n,) for r in baskets.son_candidates(b, 2, 3, at_once=2).collect() for n in range(8)}
    sets = spark.createDataFrame([(["a", "b"],), (["x", "z"],), (["a", "x"],)], "items array<string>")
    assert {tuple(r["items"]): r.freq for r in baskets.containment_counts(sets, b).collect()} == {("a", "b"): 4, ("x", "z"): 1}
    assert not rows(baskets.son(b.limit(0), 2, 3))


def test_ratings_fold_in_order(spark):
    df = spark.createDataFrame([(1, 10, 4.0, 1), (1, 10, 2.0, 3), (1, 10, 5.0, 2), (2, 10, 3.0, 1)], "user long, item long, stars double, at long")
    assert rows(cf.folded_ratings(df, "user", "item", "stars", "at")) == [(1, 10, 3.25), (2, 10, 3.0)]


def test_pearson_among_candidates(spark):
    r = spark.createDataFrame([(u, i, float((u * i) % 7 + i)) for u in range(6) for i in range(8)], "user long, item long, stars double")
    whole = rows(cf.pearson(r, "user", "item"))
    some = spark.createDataFrame([(a, b) for a, b, _ in whole[::2]], "a long, b long")
    assert rows(cf.pearson(r, "user", "item", among=some)) == whole[::2]


def test_trim_drops_points_of_small_clusters(spark):
    p = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id long, vec array<double>")
    g = spark.createDataFrame([(i, int(i == 9)) for i in range(10)], "id long, cluster long")
    assert [r.id for r in clustering.trim(p, g, 0.2).orderBy("id").collect()] == list(range(9))


def test_sketches_merge(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("s"))
    parts = sketches.distinct_sketch(df, "s", "g")
    assert abs(sketches.merged_distinct(parts).first().n - 1000) < 50 and parts.count() == 3


def test_modularity_of_two_triangles(spark):
    e = edges(spark, (1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6))
    labels = spark.createDataFrame([(k, 1 if k < 4 else 2) for k in range(1, 7)], "id long, label long")
    adjacent = {1: {2, 3}, 2: {1, 3}, 3: {1, 2, 4}, 4: {3, 5, 6}, 5: {4, 6}, 6: {4, 5}}
    assert rows(graph.modularity(e, labels)) == [(round(graph.quality([[1, 2, 3], [4, 5, 6]], adjacent, 7), 6),)]


def test_kmeans_and_bfr_count_every_point(spark):
    p = spark.createDataFrame([(i, [float(i // 10) * 100 + i % 10, 1.0 + i % 3], i % 2) for i in range(40)], "id long, vec array<double>, chunk long")
    assert sorted(r["count"] for r in clustering.kmeans(p.select("id", "vec"), clustering.farthest_first(p.select("id", "vec"), 4), 3).groupBy("cluster").count().collect()) == [10] * 4
    assigned, report = clustering.bfr(p, "chunk", 4)
    assert assigned.select("id").distinct().count() == 40
    for r, seen in zip(report.orderBy("round_id").collect(), (20, 40), strict=True):
        assert r.nof_point_discard + r.nof_point_compression + r.nof_point_retained == seen


def test_bfr_clusters_retained_points_and_merges_compression_sets(spark):
    blob = [[float(a), float(b)] for a in (-1, 0, 1) for b in (-1, 0, 1)]
    chunks = [[*blob, [1000.0, 0.0], [0.0, 1000.0]], [[1001.0, 2.0], [-1000.0, -1000.0]], [[1010.0, 0.0], [1030.0, 40.0]]]
    p = [(c, v) for c, chunk in enumerate(chunks) for v in chunk]
    assigned, report = clustering.bfr(spark.createDataFrame([(i, v, c) for i, (c, v) in enumerate(p)], "id long, vec array<double>, chunk long"), "chunk", 1)
    # round 2: two retained points become a set; round 3: two more do, and that set is merged with the first
    assert rows(report, "round_id") == [(1, 1, 9, 0, 0, 2), (2, 1, 9, 1, 2, 2), (3, 1, 9, 1, 4, 2)]
    assert rows(assigned) == [(i, 0) for i in range(len(p))]


def test_unite_adds_statistics():
    sets = [(10_002, 2, [2040.0], [2040.0**2 / 2 + 200]), (10_001, 2, [2001.0], [2001.0**2 / 2 + 0.5]), (10_003, 2, [10.0], [50.0])]
    assert clustering.unite(sets, 2.0) == [(10_001, 4, [4041.0], [2040.0**2 / 2 + 200 + 2001.0**2 / 2 + 0.5]), (10_003, 2, [10.0], [50.0])]


def test_mahalanobis_without_variance(spark):
    p = spark.createDataFrame([(1, [1.0, 5.0], 0), (2, [3.0, 5.0], 0)], "id long, vec array<double>, cluster long")
    got = rows(clustering.mahalanobis_assign(p.select("id", "vec"), clustering.statistics(p), 4.0).select("id", "cluster", "dist"))
    assert got == [(1, 0, 1.0), (2, 0, 1.0)]


@pytest.mark.parametrize("text", ["", "a", "Las Vegas", "Zürich", "a longer name than eight bytes"])
def test_residue_is_the_big_number_modulo(spark, text):
    got = spark.createDataFrame([(text,)], "s string").select(residue(F.col("s")).alias("x")).first().x
    assert got == int.from_bytes(text.encode(), "big") % 149399


def test_trailing_zeros(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 8, 12)], "x long").select("x", trailing_zeros(F.col("x")).alias("z"))
    assert [r.z for r in df.orderBy("x").collect()] == [1, 0, 3, 2]


def test_bloom_has_no_false_negatives(spark):
    v = spark.createDataFrame([(f"city{k}",) for k in range(50)] + [("",)], "s string")
    assert {r.hit for r in sketches.bloom_probe(v.where("s <> ''"), "s", sketches.bloom_build(v, "s")).collect()} == {1}
    assert sketches.bloom_size(10**9, 3000) == 1


def test_fm_is_in_range(spark):
    v = spark.range(300).select(F.concat(F.lit("v"), "id").alias("s"))
    estimate = sketches.fm_estimate(v, "s").first().estimate
    assert 30 < estimate < 3000 and not math.isnan(estimate)
