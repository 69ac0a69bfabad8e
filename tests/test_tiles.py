"""Pairs of keys with common items, found tile by tile, against brute force; no table of joined rows is made."""

import random

import pytest
from pyspark.sql import functions as F

from affinis.operators import baskets, cf, graph, similarity, tiles


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def crowded(keys=90, items=30, seed=3):
    """Sets whose items are so common that the join makes many rows for each pair."""
    r = random.Random(seed)
    return {k: set(r.sample(range(items), r.randint(4, items))) for k in range(keys)}


def table(spark, sets, kind="long"):
    return spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "key long, item long").withColumn("item", F.col("item").cast(kind))


@pytest.fixture
def unjoined(monkeypatch):
    def joined(*_):
        raise AssertionError("a row for each pair and common item")

    monkeypatch.setattr(similarity, "joined_counts", joined)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_edges_without_a_join_on_common_items(spark, unjoined, kind):
    sets = crowded()
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 12)
    assert rows(graph.cooccurrence(table(spark, sets, kind), 12)) == want


def test_jaccard_without_a_join_on_common_items(spark, unjoined):
    sets = crowded(seed=4)
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = sorted((a, b, sim(a, b)) for a in sets for b in sets if a < b and sim(a, b) >= 0.4)
    assert rows(similarity.jaccard_join(table(spark, sets), 0.4)) == want


def test_sparse_sets_are_joined(spark):
    p = table(spark, {k: {k, k + 1} for k in range(300)})
    assert similarity.tiled(p)[1] == 0 and len(rows(similarity.jaccard_join(p, 0.3))) == 299


def test_correlations_by_tiles_are_those_by_a_join(spark, monkeypatch):
    r, sets = random.Random(5), crowded(seed=5)
    star = {k: (lambda: 3.0) if k % 9 == 0 else (lambda: float(r.randint(1, 3))) if k % 2 else (lambda: 1e3 + r.random()) for k in sets}
    rated = spark.createDataFrame([(k, i, star[k]()) for k, s in sets.items() for i in s], "user long, item long, stars double")
    assert cf.tiled(rated, "user", "item")[1] > 1
    got = rows(cf.pearson(rated, "user", "item"))
    near = rows(cf.pearson_lsh(rated, "user", "item", 10, range(1, 40, 13), range(1, 3)))
    with monkeypatch.context() as m:
        m.setattr(cf.tiles, "pays", lambda *_: False)
        assert got == rows(cf.pearson(rated, "user", "item")) and len(got) > 1000
        assert near == rows(cf.pearson_lsh(rated, "user", "item", 10, range(1, 40, 13), range(1, 3))) and near
    unknown = rated.withColumn("stars", F.when(F.col("user") != 1, F.col("stars")))
    assert cf.tiled(unknown, "user", "item")[1] == 0


def test_forest_keeps_components_in_few_edges(spark):
    r = random.Random(6)
    pairs = [(a, b) for g in range(5) for a, b in ((g + 5 * r.randrange(40), g + 5 * r.randrange(40)) for _ in range(400))] + [(7, 7), (None, 3)]
    e = spark.createDataFrame(pairs, "u long, v long").repartition(3)
    small = graph.forest(e)
    assert small.count() < 3 * 200 and rows(graph.connected_components(small)) == rows(graph.connected_components(e))
    assert not rows(graph.forest(e.limit(0)))


def test_fp_growth_of_a_size_grows_no_larger_sets(spark):
    sets = crowded(60, 9, 7)
    b = baskets.baskets(table(spark, sets), "key", "item")
    want = [r for r in rows(baskets.fp_growth(b, 9)) if r[0] <= 3]
    assert rows(baskets.fp_growth(b, 9, 3)) == want and max(r[0] for r in want) == 3
    assert rows(baskets.fp_growth(b, 9, 1)) == [r for r in want if r[0] == 1]


def test_labels_spread_as_by_hand(spark, monkeypatch):
    r = random.Random(8)
    e = sorted({(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(150)) if a < b})
    near: dict = {}
    for a, b in e:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label = {x: x for x in near}
    for _ in range(5):
        label = {x: min((-sum(label[y] == k for y in n), k) for k in {label[y] for y in n})[1] for x, n in near.items()}
    edges = spark.createDataFrame(e, "u long, v long")
    assert dict(rows(graph.label_propagation(edges, repeated=False))) == dict(rows(graph.label_propagation(edges))) == label
    monkeypatch.setattr(graph, "LABELS", 0)
    assert dict(rows(graph.label_propagation(edges, repeated=False))) == label


def test_betweenness_starts_once_for_vertices_with_the_same_neighbours(spark, monkeypatch):
    r, of, e = random.Random(9), {}, set()
    links = [(a, b) for a in range(9) for b in range(a + 1, 9) if r.random() < 0.4]
    for k in range(40):
        of.setdefault(k % 10, []).append(k)  # 9 has no link but those among its own
    for a, b in links:
        e |= {(min(x, y), max(x, y)) for x in of[a] for y in of[b]}
    e |= {(x, y) for a in (1, 4, 9) for x in of[a] for y in of[a] if x < y}
    near: dict = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    monkeypatch.setattr(graph, "SHIPPED", len(links))  # far fewer than there are edges
    got = rows(graph.edge_betweenness(spark.createDataFrame(sorted(e), "u long, v long")))
    want = graph.betweenness(near)
    assert [x[:2] for x in got] == sorted(want) and len(e) > 4 * len(links)
    assert all(abs(v - want[a, b]) < 1e-9 for a, b, v in got)


def test_communities_need_no_betweenness_in_plain_python(spark, monkeypatch):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6), (7, 8)], "u long, v long")
    got = []
    monkeypatch.setattr(graph, "betweenness", lambda *_: 1 / 0)
    monkeypatch.setattr(graph, "whole", lambda edges, run, _: got.extend(run({1: {2, 3}, 2: {1, 3}, 3: {1, 2, 4}, 4: {3, 5, 6}, 5: {4, 6}, 6: {4, 5}, 7: {8}, 8: {7}})))
    graph.girvan_newman(e)
    assert [g for _, _, g in got] == [[7, 8], [1, 2, 3], [4, 5, 6]]


def test_predictions_without_a_row_for_each_pair_and_item(spark, monkeypatch):
    r, sets = random.Random(10), crowded(seed=10)
    raw = spark.createDataFrame([(k, i, 2.0 if k % 7 == 0 else float(r.randint(1, 5))) for k, s in sets.items() for i in s for _ in range(r.randint(1, 2))], "user long, item long, stars double")
    rated = cf.ratings(raw, "user", "item", "stars").localCheckpoint()
    want = {x[:2]: x[2] for x in rows(cf.predict_user(rated.select("user", "item"), rated, raw, cf.pearson(rated, "user", "item")))}

    def joined(*_):
        raise AssertionError("a row for each pair of users and common item")

    monkeypatch.setattr(cf, "predict_user", joined)
    got = {x[:2]: x[2] for x in rows(cf.predict_own(rated, raw))}
    assert got.keys() == want.keys() and len(got) > 500 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("blocks", [12, 13])
def test_a_block_travels_to_half_of_the_tasks(spark, blocks):
    sets = crowded(seed=11)
    p = table(spark, sets)
    got = tiles.joined(p, "key", "item", blocks, tiles.counted(lambda c, na, nb: c >= 12), "common long, both long")
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 12)
    assert rows(got.select("a", "b", "common")) == want
    assert tiles.dealt(spark.range(blocks).select(F.col("id").cast("int").alias("block")), blocks)[0].count() == blocks * (blocks + 1) // 2


def test_pairs_that_share_a_late_band_are_found():
    import numpy as np

    r = np.random.default_rng(12)

    class Signed:
        def __init__(self):
            self.sig = r.integers(0, 9, (60, 21))

    a, b = Signed(), Signed()
    at, to = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    for n in (1, 3, 7):
        want = [any((a.sig[i, k : k + n] == b.sig[j, k : k + n]).all() for k in range(0, 21, n)) for i, j in zip(at, to, strict=True)]
        assert tiles.sharing(a, b, at, to, n).tolist() == want


def block(r, keys, items, bands):
    """A block of keys with random lists of items, values and signatures."""
    import numpy as np
    import pyarrow as pa

    b = tiles.Block.__new__(tiles.Block)
    sets = [np.sort(r.choice(items, r.integers(3, items), replace=False)) for _ in range(keys)]
    b.keys, b.at, b.items = pa.array(r.permutation(keys)), np.cumsum([0, *map(len, sets)]), np.concatenate(sets)
    b.size, b.mid, b.stars = np.diff(b.at).astype(float), np.zeros(keys), r.integers(1, 4, b.at[-1]).astype(float)
    b.sig = r.integers(0, 9, (keys, bands)).astype(np.uint8)
    b.across = np.ascontiguousarray(b.sig.T)
    return b


@pytest.mark.parametrize("rows", [1, 3])
def test_where_most_pairs_are_found_bands_are_compared_strip_by_strip(monkeypatch, rows):
    import numpy as np

    r = np.random.default_rng(13)
    left, right = block(r, 50, 20, 21), block(r, 70, 20, 21)
    monkeypatch.setattr(tiles, "CELLS", 900)
    monkeypatch.setattr(tiles, "CACHED", 200)
    monkeypatch.setattr(tiles, "sharing", lambda *_: pytest.fail("bands compared pair by pair"))
    found = {}
    for low, start, sums in tiles.strips(left, right, False, True):
        at, to, (sim,) = tiles.banded(tiles.correlated(3), rows)(left, right, sums, low, start)
        found |= dict(zip(zip(at.tolist(), to.tolist(), strict=True), sim.tolist(), strict=True))
    lists = [[dict(zip(b.items[p:q].tolist(), b.stars[p:q].tolist(), strict=True)) for p, q in zip(b.at[:-1], b.at[1:], strict=True)] for b in (left, right)]
    want = {}
    for i, x in enumerate(lists[0]):
        for j, y in enumerate(lists[1]):
            both = sorted(x.keys() & y.keys())
            p, q = np.array([x[k] for k in both]), np.array([y[k] for k in both])
            if len(both) >= 3 and p.std() and q.std() and any((left.sig[i, k : k + rows] == right.sig[j, k : k + rows]).all() for k in range(0, 21, rows)):
                want[i, j] = np.corrcoef(p, q)[0, 1]
    want = {k: v for k, v in want.items() if v > 4e-7}
    assert found.keys() == want.keys() and want and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_numbers_are_rounded_in_a_tile_as_spark_rounds(spark):
    import numpy as np

    x = [k / 128 for k in range(129)] + [k / 1000003 for k in range(0, 1000003, 997)] + [0.1234565, 0.2345675, 0.9999995, 4.9e-7, 5e-7, 0.0, 1.0000000000000002]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert tiles.rounded(np.array(x), 6).tolist() == want
    found = tiles.in_places(lambda *_: (np.arange(len(x)), np.arange(len(x)), [np.array(x)]), 6)(None, None, None, 0, 0)
    assert found[2][0].tolist() == [v for v in want if v > 0] and [x[k] for k in found[0]] == [v for v, w in zip(x, want, strict=True) if w > 0]


def test_similarities_are_rounded_alike_by_tiles_and_by_the_join(spark, monkeypatch):
    # 105 and 119 of 128 items are in both: halves of the sixth place
    sets = crowded(seed=14) | {200: set(range(128)), 201: set(range(105)), 202: set(range(9, 128)), 203: set(range(64))}
    p = table(spark, sets)
    lsh = lambda: rows(similarity.lsh_join(p, 0.4, 10, range(1, 40, 13), range(1, 3), places=6))
    got, near, plain = rows(similarity.jaccard_join(p, 0.4, places=6)), lsh(), rows(similarity.jaccard_join(p, 0.4))
    assert got == sorted(map(tuple, spark.createDataFrame(plain, "a long, b long, sim double").select("a", "b", F.round("sim", 6)).collect()))
    assert (200, 201, 0.820313) in got and (200, 202, 0.929688) in got and near
    monkeypatch.setattr(tiles, "pays", lambda *_: False)
    assert got == rows(similarity.jaccard_join(p, 0.4, places=6)) and near == lsh()


@pytest.mark.parametrize("least", [10, 99])
def test_modularity_of_components_makes_no_edges(spark, monkeypatch, least):
    from affinis.plans import catalog

    r = random.Random(15)
    sets = {k: set(r.sample(range(30 * (k % 3), 30 * (k % 3) + 30), r.randint(4, 25))) for k in range(150)}
    p, call = table(spark, sets), lambda: [x.q for x in catalog.QUERIES["modularity"](spark, "").collect()]
    near = {a: {b for b in sets if a != b and len(sets[a] & sets[b]) >= least} for a in sets}
    near = {a: n for a, n in near.items() if n}
    monkeypatch.setattr(catalog, "event_pairs", lambda *_: p)
    monkeypatch.setattr(graph, "component_modularity", lambda pair_rows, _, whole=graph.component_modularity: whole(pair_rows, least))
    monkeypatch.setattr(graph, "cooccurrence", lambda *_: pytest.fail("edges are made"))
    want = [round(graph.quality(graph.parts(near), near, sum(map(len, near.values())) // 2), 6)] if near else [None]
    assert similarity.tiled(p)[1] > 1 and len(graph.parts(near)) == 3 * bool(near) and call() == want
    monkeypatch.setattr(tiles, "pays", lambda *_: False)
    assert call() == want
