"""Closed-form and brute-force cases of the operators."""

import math
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecloom.functions import stats, text
from vecloom.operators import compare, graph, homology, knn, metrics, project, rips, tasks, topology, trees
from vecloom.queries import graphs

INF = float("inf")


def cloud(spark, x, ids=None, level=0):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(level, int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "level int, point_id long, vec array<double>")


def diagrams(spark, rows):
    return spark.createDataFrame([(d, float(b), float(e)) for d, b, e in rows], "diagram string, birth double, death double")


@pytest.mark.parametrize("offset", [0.0, 1e12])
@pytest.mark.parametrize("block", [3, 512])
def test_knn_ties_duplicates_and_far_origin(spark, offset, block):
    x = np.array([[0, 0], [0, 0], [0, 0], [1, 0], [1, 0], [4, 0], [4, 4], [0, 1]], float) + offset
    ids = [0, 2, 5, 10, 12, 30, 100, 9999]
    got = {}
    for r in knn.exact_knn(cloud(spark, x, ids), 4, block).collect():
        got.setdefault(r["src"], {})[r["rank"]] = (r["dist"], r["dst"])
    for i, p in zip(ids, x, strict=True):
        want = sorted((math.dist(p, q), j) for j, q in zip(ids, x, strict=True) if j != i)[:4]
        assert [got[i][k][1] for k in range(1, 5)] == [j for _, j in want]
        assert [got[i][k][0] for k in range(1, 5)] == pytest.approx([d for d, _ in want])
    assert [d for _, d in sorted(got[0].values())] == [2, 5, 10, 12]


def test_knn_of_few_points(spark):
    assert knn.exact_knn(cloud(spark, [[0.0], [1.0]]), 4).count() == 2


def test_scalar_knn_over_the_full_range(spark):
    points = spark.range(10_000).select(F.col("id").alias("point_id"), (F.col("id") + 1).alias("target"))
    for buckets in (1, 5):
        got = {}
        for r in knn.scalar_knn(points, buckets=buckets).where("src IN (0, 5000)").orderBy("src", "rank").collect():
            got.setdefault(r["src"], []).append(r["dst"])
        assert got == {0: [1, 2, 3, 4], 5000: [4999, 5001, 4998, 5002]}
    assert knn.scalar_knn(points, buckets=5).count() == 40_000


def brute_scalar(rows, k):
    return {(i, r + 1, j, d) for i, x in rows for r, (d, j) in enumerate(sorted((abs(x - y), j) for j, y in rows if j != i)[:k])}


@pytest.mark.parametrize("buckets", [None, 2, 7, 60, 100])
def test_scalar_knn_with_ties_and_thin_ranges(spark, buckets):
    rng = np.random.default_rng(3)
    tied = [(i, 5) for i in range(20)]
    mixed = [(i, int(rng.integers(40)) ** 2) for i in range(120)]
    for rows in (tied, mixed, [(0, 1)], [(0, 1), (1, 1)], [(i, i) for i in range(63)]):
        got = knn.scalar_knn(spark.createDataFrame(rows, "point_id long, target long"), buckets=buckets).collect()
        assert {(r["src"], r["rank"], r["dst"], r["dist"]) for r in got} == brute_scalar(rows, 4)


def test_edge_changes_skip_missing_levels(spark):
    e = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (3, 1, 2), (3, 1, 3)], "level int, a long, b long")
    assert [tuple(r) for r in metrics.edge_changes(e).collect()] == [(3, 1, 1, 1, pytest.approx(1 / 3))]


def test_pair_median_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    for n in (2, 3, 9, 40):
        x = rng.normal(size=(n, 3))
        rows = [(0, i, v.tolist()) for i, v in enumerate(x)] + [(1, i, [1.0, 1.0, 1.0]) for i in range(n)]
        got = {r["level"]: (r["pairs"], r["scale"]) for r in knn.pair_median(spark.createDataFrame(rows, "level int, point_id long, vec array<double>"), block=7, bins=8).collect()}
        want = np.median([np.linalg.norm(x[i] - x[j]) for i in range(n) for j in range(i)])
        assert got == {0: (n * (n - 1) // 2, pytest.approx(want)), 1: (n * (n - 1) // 2, None)}


def test_components_and_partition(spark):
    tree = spark.createDataFrame([(0, 0, 1, 0.1), (0, 1, 2, 0.5), (0, 2, 3, 0.8)], "level int, a long, b long, length double")
    nodes = spark.createDataFrame([(0, i) for i in range(4)], "level int, point_id long")
    for radius, n in ((0.5, 2), (0.8, 1), (0.09, 4)):
        assert graph.threshold_partition(nodes, tree, radius).select("component").distinct().count() == n


def test_long_path_is_one_component(spark):
    nodes = spark.range(60).select(F.lit(0).alias("level"), F.col("id").alias("point_id"))
    edges = spark.range(59).select(F.lit(0).alias("level"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert [r["component"] for r in graph.components(nodes, edges).select("component").distinct().collect()] == [0]


def test_components_of_paths_longer_than_the_rounds(spark):
    """Paths of 3,000 nodes, in order and shuffled, a star, and edges to nodes that aren't there."""
    rng, n = np.random.default_rng(8), 3000
    order = rng.permutation(n)
    edges = [(0, i, i + 1) for i in range(n - 1)] + [(1, int(order[i]), int(order[i + 1])) for i in range(n - 1) if i != 1000] + [(2, 7, i) for i in range(50) if i != 9] + [(2, 9, 70), (2, 70, 7), (2, 3, 3)]
    nodes = [(level, i) for level in (0, 1) for i in range(n)] + [(2, i) for i in range(60)]
    got = graph.components(spark.createDataFrame(nodes, "level int, point_id long"), spark.createDataFrame(edges, "level int, a long, b long")).collect()
    cut = order[:1001]
    want = [(0, i, 0) for i in range(n)] + [(1, i, int(cut.min() if i in set(cut.tolist()) else order[1001:].min())) for i in range(n)] + [(2, i, 0 if i < 50 and i != 9 else i) for i in range(60)]
    assert sorted(tuple(r) for r in got) == want


def test_mst_keeps_zero_lengths():
    _, _, w = graph.mst(np.array([[0.0], [0.0], [1e-12], [1.0]]))
    assert sorted(w) == pytest.approx([0, 1e-12, 1 - 1e-12])


def test_trees_grown_in_rounds(spark):
    rng = np.random.default_rng(6)
    clouds = [rng.normal(size=(70, 3)), np.repeat(rng.normal(size=(9, 2)), 5, 0), np.array([[float(i % 7), float(i // 7)] for i in range(42)])]
    for x in clouds:
        v = cloud(spark, x)
        want = sorted(r["length"] for r in graph.minimum_spanning_trees(v).collect())
        tree = graph.grown_trees(v, block=16).collect()
        assert sorted(r["length"] for r in tree) == pytest.approx(want)
        parts = {i: i for i in range(len(x))}
        for r in tree:  # no cycle
            p, q = parts[r["a"]], parts[r["b"]]
            assert p != q
            parts = {k: p if c == q else c for k, c in parts.items()}
    assert graph.minimum_spanning_trees(cloud(spark, clouds[0]), small=10).count() == 69


def test_ranges(spark):
    rows = spark.createDataFrame([(1, t) for t in (0, 1, 2, 5, 6)], "k int, t int")
    assert sorted((r["start"], r["stop"]) for r in graph.contiguous_ranges(rows, ["k"], "t").collect()) == [(1, 4), (6, 8)]


def test_cliques_of_a_complete_graph(spark):
    e = spark.createDataFrame([(0, i, j) for i in range(6) for j in range(i + 1, 6)], "level int, a long, b long")
    assert [graph.cliques(e, k).count() for k in (3, 4, 5)] == [20, 15, 6]


def test_strong_components(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 2, 3)], "grp long, src long, dst long")
    assert {r["node"]: r["component"] for r in graph.strong_components(e, "grp").collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_strong_components_of_random_graphs(spark):
    """Groups apart by both keys, against the closure of reach."""
    rng = np.random.default_rng(2)
    rows = [(level, label, int(a), int(b)) for level, label in ((0, 1000), (1, 0)) for a, b in rng.integers(0, 25, (32, 2))]
    got = graph.strong_components(spark.createDataFrame(rows, "level int, label int, src long, dst long"), "level", "label").collect()
    for level, label in ((0, 1000), (1, 0)):
        reach = np.eye(25, dtype=bool)
        for lv, lb, a, b in rows:
            if (lv, lb) == (level, label):
                reach[a, b] = True
        for _ in range(5):
            reach = reach | ((reach.astype(int) @ reach.astype(int)) > 0)
        nodes = {v for r in rows if r[:2] == (level, label) for v in r[2:]}
        assert {(r["node"], r["component"]) for r in got if (r["level"], r["label"]) == (level, label)} == {(v, int((reach[v] & reach[:, v]).argmax())) for v in nodes}


def test_betti_and_distances(spark):
    a = diagrams(spark, [("a", 0, 2), ("a", 1, 3), ("a", 2, 2), ("b", 0, 1)])
    steps = [(r["t"], r["betti"]) for r in topology.betti_steps(a.where("diagram = 'a'")).orderBy("t").collect()]
    assert steps == [(0, 1), (1, 2), (2, 1), (3, 0)]
    grid = spark.createDataFrame([("a", float(t)) for t in range(4)], "diagram string, t double")
    assert [r["betti"] for r in topology.betti_grid(a, grid, "diagram").orderBy("t").collect()] == [1, 2, 1, 0]
    assert topology.betti_l1(a).collect()[0]["distance"] == 3
    land = topology.landscape(a.where("diagram = 'a'").drop("diagram"), grid.select("t"), 2)
    assert [[r["height"] for r in land.where(F.col("level") == k).orderBy("t").collect()] for k in (1, 2)] == [[0, 1, 1, 0], [0, 0, 0, 0]]


def test_infinite_bars_are_censored(spark):
    s = topology.diagram_summary(diagrams(spark, [("a", 0, INF), ("a", 0, 2)]), "diagram").collect()[0]
    assert (s["bars"], s["censored"], s["max_life"]) == (2, 1, 2.0)


def test_bands(spark):
    c = spark.createDataFrame([(float(i), v) for i, v in enumerate([0, 1, 1, 0, 1])], "t double, v int")
    assert sorted((r["start"], r["stop"], r["n"]) for r in topology.bands(c, "v", 1, "t").collect()) == [(1, 2, 2), (4, 4, 1)]


def test_bottleneck():
    a, b = np.array([[0, 2], [0.3, 0.5]]), np.array([[0.1, 2.1]])
    assert homology.bottleneck(a, b) == pytest.approx(0.1)
    low, high = homology.bottleneck_bounds(a[:1], b, 0.1, 0.0)
    assert low <= homology.bottleneck(a, b) <= high
    assert homology.bottleneck(np.zeros((0, 2)), np.zeros((0, 2))) == 0


def test_numbers_reduce_as_sets_do(monkeypatch):
    rng = np.random.default_rng(3)
    cells = [(i,) for i in range(30)] + [tuple(sorted(rng.choice(30, 3, replace=False).tolist())) for _ in range(60)]
    every = sorted({c[:k] + c[k + 1 :] for c in cells if len(c) == 3 for k in range(3)} | set(cells), key=lambda c: (len(c), rng.random()))
    number = {c: i for i, c in enumerate(every)}
    columns = [[number[c[:k] + c[k + 1 :]] for k in range(len(c))] if len(c) > 1 else [] for c in every]
    as_numbers = homology.reduced(columns, [len(c) - 1 for c in every])
    monkeypatch.setattr(homology, "DENSE", 0)
    assert sorted(as_numbers) == sorted(homology.reduced(columns, [len(c) - 1 for c in every])) and len(as_numbers) > 60


@pytest.mark.parametrize("dense", [0, 2000, 1 << 31])
def test_coboundaries_give_the_pairs_of_boundaries(monkeypatch, dense):
    """Also where columns of few cells are held as lists, and those of many are not."""
    rng = np.random.default_rng(12)
    n = 40
    e = {(i, j) for i, j in combinations(range(n), 2) if rng.random() < 0.3}
    every = [(i,) for i in range(n)] + sorted(e) + [t for t in combinations(range(n), 3) if all(p in e for p in combinations(t, 2))]
    at = {s: k for k, s in enumerate(every)}
    columns, dim = [[at[f] for f in combinations(c, len(c) - 1)] if len(c) > 1 else [] for c in every], [len(c) - 1 for c in every]
    want = sorted(homology.reduced(columns, dim))
    monkeypatch.setattr(homology, "DENSE", dense)
    assert sorted(homology.paired(columns, dim)) == want and len(want) > 200
    assert homology.paired([], []) == []


def test_times_of_simplices_take_one_pass(spark):
    """Runs of times come from runs of levels: no level is joined to the next."""
    df = spark.createDataFrame([(l, 0, [p]) for p, ls in ((1, (0, 1, 3)), (2, (2,)), (3, (0, 1, 2, 3))) for l in ls], "level int, dim int, simplex array<long>")
    times = graph.zigzag_times(df)
    assert sorted((r["simplex"][0], r["start"], r["stop"]) for r in times.collect()) == [(1, 1, 4), (1, 7, 8), (2, 5, 6), (3, 1, 8)]
    assert "Join" not in times._jdf.queryExecution().optimizedPlan().toString()


def test_rips_of_a_circle_and_a_line():
    t = np.linspace(0, 2 * np.pi, 32, endpoint=False)
    bars = rips.rips_h1(np.stack([np.cos(t), np.sin(t)], 1))
    assert len(bars) == 1 and bars[0, 1] - bars[0, 0] > 1.4
    assert len(rips.rips_h1(np.arange(20.0)[:, None])) == 0
    scaled = rips.rips_h1(7 * np.stack([np.cos(t), np.sin(t)], 1))
    assert scaled == pytest.approx(7 * bars, rel=1e-5)


def test_rips_agrees_with_ranks():
    x = np.random.default_rng(3).normal(size=(14, 2))
    d = knn.distances(x, x)
    for limit in (0.5, 0.9, 1.4):
        edges = [(i, j) for i in range(14) for j in range(i + 1, 14) if np.float32(d[i, j]) <= np.float32(limit)]
        s = [(i,) for i in range(14)] + edges
        e = set(edges)
        s += [(i, j, k) for i, j in edges for k in range(j + 1, 14) if (i, k) in e and (j, k) in e]
        bars = rips.rips_h1(x)
        alive = ((bars[:, 0] <= np.float32(limit)) & (bars[:, 1] > np.float32(limit))).sum()
        assert alive == homology.complex_betti(s)[1]


def test_first_homology_of_every_label(spark, data):
    """Each level and label has the bars of all its points, none left out."""
    got = graphs.t4_rips_h1(spark, data).toPandas()
    e = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, label = np.array(e["embedding"].tolist(), float), e["label"].to_numpy()
    for level in range(4):
        for g in np.unique(label):
            bars = got[(got["level"] == level) & (got["label"] == g)].sort_values(["birth", "death"])[["birth", "death"]].to_numpy()
            np.testing.assert_allclose(bars, rips.rips_h1(x[label == g, 16 * level : 16 * level + 16]), atol=1e-6)


def plain_h1(x, threshold=np.inf):
    """Bars by reducing the whole boundary matrix of the triangles."""
    n, d = len(x), knn.distances(x, x).astype(np.float32)
    edges = sorted((d[i, j], i, j) for i, j in combinations(range(n), 2) if d[i, j] <= threshold)
    at = {(i, j): k for k, (_, i, j) in enumerate(edges)}
    triangles = sorted(sorted((at[a], at[b], at[c]), reverse=True) for i, j, k in combinations(range(n), 3) if all(e in at for e in ((i, j), (i, k), (j, k))) for a, b, c in [((i, j), (i, k), (j, k))])
    pairs = dict(homology.reduced([[]] * n + [[i, j] for _, i, j in edges] + [[n + e for e in t] for t in triangles], [0] * n + [1] * len(edges) + [2] * len(triangles)))
    killers = {v for v in pairs.values()}
    out = [(edges[e][0], edges[triangles[pairs[n + e] - n - len(edges)][0]][0] if n + e in pairs else np.inf) for e in range(len(edges)) if n + e not in killers]
    found = np.array([r for r in out if r[1] > r[0]], float).reshape(-1, 2)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


@pytest.mark.parametrize("seed", range(6))
def test_rips_is_the_whole_matrixs(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(24, 2 + seed % 3))
    if seed % 2:
        x = np.round(x)  # equal lengths and points that coincide
    for threshold in (np.inf, 1.0, 1.6):
        assert rips.rips_h1(x, threshold) == pytest.approx(plain_h1(x, threshold))
    assert rips.rips_h1(x[:1]).shape == rips.rips_h1(x[:0]).shape == (0, 2)


@pytest.mark.parametrize("width", [2, 8])
def test_edges_left_are_those_of_all_points(monkeypatch, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(90, width))
    x[80:] = x[:10]  # repeated points
    x[60:80] = np.round(x[60:80])  # equal lengths
    monkeypatch.setattr(rips, "BLOCK", 32)
    monkeypatch.setattr(rips, "NEAR", 4)
    held, places = [], rips.Cloud.places
    monkeypatch.setattr(rips.Cloud, "places", lambda self, at: held.append(len(at)) or places(self, at))
    cloud = rips.Cloud(x, np.inf)
    rows = places(cloud, np.arange(90))
    want = [e for a in range(90) for e in rows[a, a + 1 :].tolist() if not (np.maximum(rows[a], rows[rips.Cloud.ends(e)[1]]) < e).any()]
    blocks = [np.arange(i, min(i + 32, 90)) for i in range(0, 90, 32)]
    assert sorted(e for at in blocks for e in rips._left(cloud, at).tolist()) == sorted(want)
    assert sum(held) < 90 + 3 * 90  # less than all rows again for every block


def test_columns_are_reduced_once_a_round(spark, monkeypatch):
    """What a round has reduced is written before its two readers."""
    names, staged = [], rips.staged
    monkeypatch.setattr(rips, "staged", lambda df, name: names.append(name) or staged(df, name))
    x = np.random.default_rng(5).normal(size=(40, 3))
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "level int, point_id long, vec array<double>")
    assert rips.h1_intervals(df, chunk=3).count() == len(rips.rips_h1(x))
    assert names.count("rips-reduced") == names.count("rips-columns") - 1 > 0


def test_edges_of_more_points_than_16_bits_tell():
    """Edges of a cloud of 70,000 points keep their order, ends and lengths; lengths that can't be told apart are an error, not a guess."""
    x = np.random.default_rng(7).normal(size=(70_000, 2))
    cloud = rips.Cloud(x, rips._radius(x, np.array([3, 69_000])))
    p = cloud.places([69_999])[0]
    p = np.sort(p[p < rips._LAST])
    a, b = cloud.ends(p, cloud.width)
    far = np.linalg.norm(x[a] - x[69_999], axis=1).astype(np.float32)
    assert len(p) > 65_536 and (b == 69_999).all() and len(set(a.tolist())) == len(p) and (np.diff(far) > -1e-6).all()
    assert rips.lengths_of(p, cloud.width, cloud.base) == pytest.approx(far)
    assert {a for e in rips._left(cloud, np.array([69_999])).tolist() for a in cloud.ends(e, cloud.width)} > {69_999}
    y = np.array([[0.0, 0], [1e-9, 0], [1, 1], [0, 1], [1, 0]])
    assert len(rips.rips_h1(y)) == len(rips.rips_h1(y, ends=17)) == 1
    with pytest.raises(ValueError):
        rips.rips_h1(y, ends=18)


def test_rips_with_longer_ends(spark):
    """Clouds whose edges' ends take 17 or 18 bits have the bars of those with 16; equal points and thresholds too."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(60, 3)), np.repeat(rng.integers(0, 4, size=(20, 2)), 2, 0).astype(float)
    rows = [(cloud, i, x.tolist()) for cloud, v in (("a", a), ("b", b)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "cloud string, point_id long, vec array<double>")
    for ends, threshold in ((17, math.inf), (18, 1.2)):
        got = rips.h1_intervals(df, threshold, ("cloud",), chunk=9, ends=ends).toPandas().sort_values(["birth", "death"])
        for name, x in (("a", a), ("b", b)):
            assert got[got["cloud"] == name][["birth", "death"]].to_numpy() == pytest.approx(rips.rips_h1(x, threshold))
            assert np.array_equal(rips.rips_h1(x, threshold), rips.rips_h1(x, threshold, ends))


def test_a_clouds_last_columns_end_in_one_round(spark, monkeypatch):
    """Columns that give way to others of the last chunk go on at once, not in a round of their own."""
    names, staged = [], rips.staged
    monkeypatch.setattr(rips, "staged", lambda df, name: names.append(name) or staged(df, name))
    x = np.random.default_rng(2).normal(size=(150, 3))
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "level int, point_id long, vec array<double>")
    got = rips.h1_intervals(df, chunk=40).toPandas().sort_values(["birth", "death"])
    assert got[["birth", "death"]].to_numpy() == pytest.approx(rips.rips_h1(x))
    assert names.count("rips-reduced") == 2


@pytest.mark.parametrize("seed", range(4))
def test_triangles_are_looked_for_among_near_points_first(monkeypatch, seed):
    """Most columns of a cloud never see all points; those that must have the bars of the whole matrix."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(28, 3)) if seed % 2 else np.round(rng.normal(size=(28, 2)) * 2) / 2
    want = plain_h1(x)
    for close in (3, 12, 40):
        monkeypatch.setattr(rips, "CLOSE", close)
        assert rips.rips_h1(x) == pytest.approx(want)
    x, whole, row = rng.normal(size=(400, 8)), [], rips.Cloud.row
    monkeypatch.setattr(rips, "CLOSE", 100)
    monkeypatch.setattr(rips.Cloud, "row", lambda self, point: whole.append(point) or row(self, point))
    bars = rips.rips_h1(x)
    assert len(whole) < len(bars)


def test_rips_in_rounds_of_small_chunks(spark, monkeypatch):
    """Columns of many chunks meet and give way until each has a triangle of its own; clouds are apart, keys may be null."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(90, 3)), np.round(rng.normal(size=(40, 2)) * 2) / 2
    rows = [("a", i, x.tolist()) for i, x in enumerate(a)] + [(None, i, x.tolist()) for i, x in enumerate(b)] + [("one", 0, [1.0]), ("two", 0, [1.0]), ("two", 1, [3.0])]
    df = spark.createDataFrame(rows, "cloud string, point_id long, vec array<double>")
    for threshold in (math.inf, 1.2):
        got = rips.h1_intervals(df, threshold, ("cloud",), chunk=3).toPandas().sort_values(["birth", "death"])
        for name, x in (("a", a), (None, b)):
            mine = got[got["cloud"].isna()] if name is None else got[got["cloud"] == name]
            assert mine[["birth", "death"]].to_numpy() == pytest.approx(plain_h1(x, threshold))
        assert not set(got["cloud"].dropna()) - {"a"}


def test_persistence_on_one_grid(spark):
    t = np.linspace(0, 2 * np.pi, 16, endpoint=False)
    x = np.concatenate([np.stack([np.cos(t), np.sin(t)], 1), [[1.0, 0.0]]])  # the first point twice
    v = spark.createDataFrame([(0, i, p.tolist()) for i, p in enumerate(x)], "level int, point_id long, vec array<double>")
    p = topology.persistence(v.select("level").distinct(), graph.minimum_spanning_trees(v), rips.h1_intervals(v)).orderBy("i").toPandas()
    side = 2 * math.sin(math.pi / 16)
    assert len(p) == 301 and p["i"].tolist() == list(range(301)) and p["radius"].iloc[-1] == pytest.approx(1.05 * rips.rips_h1(x)[-1, 1])
    assert (p["betti0"] == np.where(p["radius"] < side, 16, 1)).all()  # the merge of no length is omitted
    assert p["betti1"].max() == 1 and p["betti1"].iloc[0] == p["betti1"].iloc[-1] == 0


def test_zigzag_of_constant_and_changing_complexes():
    circle = [(0,), (1,), (2,), (0, 1), (1, 2), (0, 2)]
    assert homology.zigzag_bars([(s, 0, 6) for s in circle], 6) == [(0, 0, 6), (1, 0, 6)]
    # The triangle fills the loop from time 2 to 4.
    assert homology.zigzag_bars([*[(s, 0, 6) for s in circle], ((0, 1, 2), 2, 4)], 6) == [(0, 0, 6), (1, 0, 2), (1, 4, 6)]
    # Two points joined for a while: one class ends and another begins.
    assert homology.zigzag_bars([((0,), 0, 6), ((1,), 0, 6), ((0, 1), 2, 4)], 6) == [(0, 0, 2), (0, 0, 6), (0, 4, 6)]


def test_zigzag_runs_keep_edges_between_far_ids(spark):
    """A circle whose ids lie far apart stays one class; a point without edges is a run of its own."""
    nodes = spark.createDataFrame([(v, p) for v in range(2) for p in (1, 41, 81, 121, 200)], "level int, point_id long")
    e = spark.createDataFrame([(v, *ab) for v in range(2) for ab in ((1, 41), (41, 81), (81, 121), (1, 121))], "level int, a long, b long")
    got = homology.zigzag_intervals(graphs._component_runs(nodes, e), 2).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 3), (1, 1, 0, 3), (200, 0, 0, 3)]


def test_zigzag_of_a_clique_has_no_class_above_its_points(spark):
    """Four points all joined at both levels: their tetrahedron fills the sphere of its triangles."""
    nodes = spark.createDataFrame([(v, p) for v in range(2) for p in range(4)], "level int, point_id long")
    e = spark.createDataFrame([(v, a, b) for v in range(2) for a, b in combinations(range(4), 2)], "level int, a long, b long")
    assert [tuple(r) for r in homology.zigzag_intervals(graphs._component_runs(nodes, e), 2).collect()] == [(0, 0, 0, 3)]


def test_zigzag_pairs_classes_over_arrivals_and_departures():
    """A class that ends when its circle is cut and one that returns are two; a sphere that opens and closes is one less in dimension meanwhile."""
    circle = [((0,), 0, 9), ((1,), 0, 9), ((2,), 0, 9), ((0, 1), 0, 9), ((1, 2), 0, 9), ((0, 2), 0, 3), ((0, 2), 5, 9)]
    assert homology.zigzag_bars(circle, 9) == [(0, 0, 9), (1, 0, 3), (1, 5, 9)]
    sphere = [(s, 0, 9) for k in (1, 2, 3) for s in combinations(range(4), k) if s != (1, 2, 3)] + [((1, 2, 3), 0, 3), ((1, 2, 3), 5, 9)]
    assert homology.zigzag_bars(sphere, 9) == [(0, 0, 9), (2, 0, 3), (2, 5, 9)]
    assert homology.zigzag_bars([((0,), 0, 9), ((1,), 0, 3), ((1,), 5, 9)], 9) == [(0, 0, 3), (0, 0, 9), (0, 5, 9)]
    assert homology.zigzag_bars([((0,), 0, 9), ((1,), 0, 9), ((0, 1), 0, 3), ((0, 1), 5, 9)], 9) == [(0, 0, 9), (0, 3, 5)]


def test_zigzag_matches_betti_numbers_at_every_time():
    rng = np.random.default_rng(5)
    every = [s for k in range(1, 6) for s in combinations(range(6), k)]
    for _ in range(20):
        levels = []
        for _ in range(4):
            keep = {s for s in every if rng.random() < 0.9}
            levels.append({s for s in keep if all(f in keep for n in range(1, len(s)) for f in combinations(s, n))})
        at = [levels[t // 2] if t % 2 == 0 else levels[t // 2] & levels[t // 2 + 1] for t in range(7)]
        runs = []
        for s in every:
            t = 0
            while t < 7:
                if s in at[t]:
                    u = t
                    while u < 7 and s in at[u]:
                        u += 1
                    runs.append((s, t, u))
                    t = u
                t += 1
        bars = homology.zigzag_bars(runs, 7)
        for t in range(7):
            betti = homology.complex_betti(sorted(at[t]))
            for dim in range(5):
                assert sum(1 for d, b, e in bars if d == dim and b <= t < e) == (betti[dim] if dim < len(betti) else 0)


def test_group_variance(spark):
    x = cloud(spark, [[0, 0, 0], [0, 0, 0], [1, 1, 1], [1, 1, 1]])
    labels = lambda v: spark.createDataFrame([(i, "l", k) for i, k in enumerate(v)], "point_id long, name string, label int")
    assert metrics.group_variance(x, labels([0, 0, 1, 1])).collect()[0]["share"] == 1
    assert metrics.group_variance(x, labels([0, 1, 0, 1])).collect()[0]["share"] == pytest.approx(0)
    assert metrics.group_variance(x, labels([None] * 4)).count() == 0


def test_conditional_fraction_is_null_without_denominator(spark):
    points = spark.createDataFrame([(i, i + 1, i + 1, 1) for i in range(9)], "point_id long, target long, leading_digit int, digit_count int")
    m = metrics.graph_metrics(knn.exact_knn(cloud(spark, [[float(i)] for i in range(9)])), points).collect()[0]
    assert m["cross_length_count"] == 0 and m["same_given_cross"] is None


def test_degenerate_level(spark):
    assert metrics.degeneration(cloud(spark, [[1.0, 1.0]] * 5)).collect()[0]["degenerate"]


def test_pca_matches_a_full_decomposition(spark):
    x = np.random.default_rng(1).normal(size=(200, 6)) * [5, 3, 1, 1, 1, 0.1] + 1e3
    v = cloud(spark, x).repartition(3)
    m = {r["component"]: r for r in project.pca(v, 2).collect()}
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    for k in (1, 2):
        assert m[k]["variance"] == pytest.approx(s[k - 1] ** 2 / 199)
        assert abs(np.dot(m[k]["loadings"], vt[k - 1])) == pytest.approx(1)
    got = project.scores(v, project.pca(v, 2)).groupBy("component").agg(F.avg("score").alias("m")).collect()
    assert all(abs(r["m"]) < 1e-9 for r in got)


def test_spacing_fit():
    assert project.spacing_fit([2, 4, 8]) == pytest.approx((2, 2, 1))
    assert project.spacing_fit([1, 0])[0] == pytest.approx(math.exp(-8), rel=1e-3) and all(math.isnan(v) for v in project.spacing_fit([0, 0]))


def test_agreement_of_partitions(spark):
    rows = spark.createDataFrame([(i // 5, i // 5) for i in range(20)], "a int, b int")
    c = stats.contingency(rows, "a", "b").withColumn("g", F.lit(1))
    assert stats.adjusted_rand(c, "g").collect()[0]["ari"] == 1
    assert stats.adjusted_mutual_information(np.eye(3) * 4) == pytest.approx(1)
    assert abs(stats.adjusted_mutual_information(np.full((2, 2), 25))) < 0.05


def test_merge_curve_ends_in_one_cluster(spark):
    x = cloud(spark, [[0.0], [0.1], [5.0], [5.1]])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "point_id long, label int")
    rows = trees.merge_curve(graph.minimum_spanning_trees(x), labels).orderBy("radius").collect()
    assert rows[-1]["clusters"] == 1 and max(r["ari"] for r in rows) == 1


def test_words_and_digits(spark):
    want = {0: "zero", 1: "one", 19: "nineteen", 20: "twenty", 21: "twenty-one", 40: "forty", 100: "one hundred", 101: "one hundred and one", 234: "two hundred and thirty-four", 999: "nine hundred and ninety-nine", 1000: "one thousand"}
    got = spark.createDataFrame([(n,) for n in want], "n int").select("n", text.number_words(F.col("n")).alias("w")).collect()
    assert {r["n"]: r["w"] for r in got} == want
    cases = [("1234", "reverse4", "4321"), ("1234", "swap_first4", "2134"), ("1234", "swap_last4", "1243"), ("1200", "reverse4", "0021"), ("1020", "swap_first4", "0120"), ("123", "copy4", None)]
    got = spark.createDataFrame(cases, "t string, k string, w string").select("w", text.transform_digits(F.col("t"), F.col("k")).alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)


def test_task_dataset_and_pilot(spark):
    d = tasks.task_dataset(tasks.four_digit_targets(spark)).cache()
    assert d.count() == 12_000 and tasks.pilot_rows(d).count() == 384 and d.select("point_id").distinct().count() == 12_000
    small = {r["target"] for r in tasks.four_digit_targets(spark, 50).collect()}
    assert {1000, 9999} <= small <= {r["target"] for r in tasks.four_digit_targets(spark, 1000).collect()}
    assert d.where("point_id = 0").first()["prompt"].count("=") == 9


def test_a_pilot_takes_in_a_zero(spark):
    d = spark.createDataFrame([(i, "t", 0, 111 + i * 0 if i != 4 else 101) for i in range(10)], "point_id long, task string, context_id int, target long")
    assert [r["point_id"] for r in tasks.pilot_rows(d, 4).orderBy("point_id").collect()] == [0, 4, 6, 9]


def test_records_are_sound_and_a_smoke_run_has_the_same_demonstrations(spark):
    full, smoke = tasks.records(spark), tasks.records(spark, only=tasks.SMOKE)
    assert tasks.bad_records(full).isEmpty() and smoke.count() == 40
    assert smoke.select("prompt").exceptAll(full.select("prompt")).isEmpty()
    assert full.where("leading_digit = 1").count() == 1112 and full.where("leading_digit = 2").count() == 1111


def test_nearest_depth_prefers_the_lower_level(spark):
    lv = spark.createDataFrame([("m", i, i / 4) for i in range(5)], "model string, level int, depth double")
    got = compare.nearest_depth(lv, spark.createDataFrame([(0.125,), (0.9,), (0.0,), (1.0,)], "depth double")).collect()
    assert {r["wanted"]: r["level"] for r in got} == {0.125: 0, 0.9: 4, 0.0: 0, 1.0: 4}


def test_rank_change_contributions_sum_to_the_change_of_rho(spark):
    rng = np.random.default_rng(0)
    rows = [(lv, i, float(rng.normal() + i / 9)) for lv in (0, 1) for i in range(40)]
    s = spark.createDataFrame(rows, "level int, point_id long, score double")
    p = spark.createDataFrame([(i, i + 1) for i in range(40)], "point_id long, target long")
    rho = {r["level"]: r["rho"] for r in stats.spearman(s.join(p, "point_id"), "score", "target", "level").collect()}
    total = compare.rank_changes(s, p, 0, 1).agg(F.sum("contribution")).collect()[0][0]
    assert total == pytest.approx(rho[1] - rho[0])


def test_tied_neighbours_fall_as_in_sql():
    """Vectors of three places have many equal distances: the last digit decides, and SQL has to have the same."""
    rng = np.random.default_rng(21)
    x, y = (np.floor(rng.normal(0, 0.12, (2000, 16)) * 1000) / 1000 for _ in range(2))
    pairs = pd.DataFrame({"i": range(2000), "a": x.tolist(), "b": y.tolist()})
    con = duckdb.connect()
    con.register("pairs", pairs)
    want = con.sql("SELECT list_distance(a::DOUBLE[], b::DOUBLE[]) AS d FROM pairs ORDER BY i").df()["d"].to_numpy()
    assert (knn.paired(x, y, np.arange(2000), np.arange(2000)) == want).all()


def test_pair_median_beside_an_outlier(spark):
    """One far point makes the first bins coarse: they are parted again until few distances are left."""
    x = np.append(np.random.default_rng(8).normal(size=(60, 2)), [[1e7, 0]], 0)
    got = knn.pair_median(cloud(spark, x), block=16, bins=64, room=8).first()
    assert got["scale"] == pytest.approx(np.median([np.linalg.norm(x[i] - x[j]) for i in range(61) for j in range(i)]), rel=1e-12)


def test_forest_takes_what_is_certain_and_asks_the_rest():
    """Two pairs far apart, of which only the pairs' own edges are known: no edge between them is guessed."""
    a, b, length = np.array([0, 2]), np.array([1, 3]), np.array([1.0, 1.0])
    taken, comp, ask = graph.forest(a, b, length, np.ones(4))
    assert len(taken) == 2 and comp.tolist() == [0, 0, 1, 1] and ask.tolist() == [False, False, True, True]
    taken, comp, ask = graph.forest(np.append(a, 1), np.append(b, 2), np.append(length, 5.0), np.array([1.0, 1.0, 5.0, 5.0]))
    assert len(taken) == 3 and not ask.any()


def test_trees_of_far_groups_ask_beyond_their_neighbours(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(20, 2)) + 100 * g for g in range(4)])
    got = sorted(r["length"] for r in graph.grown_trees(cloud(spark, x), block=16, k=3).collect())
    assert got == pytest.approx(sorted(graph.mst(x)[2]))


def test_theta_join_with_and_without_bounds(spark):
    """Parts of three points bound nothing, parts of sixty nearly all: the rows are those of the blocks."""
    v = cloud(spark, np.random.default_rng(4).normal(size=(61, 3)))
    want = {tuple(r)[:4] for r in knn.exact_knn(v).collect()}
    for parts in (1, 20):
        assert {tuple(r)[:4] for r in knn.exact_knn_sql(v, parts=parts).collect()} == want


def test_theta_join_sorts_few_pairs(spark, monkeypatch):
    """Bounds are found in parts of parts, so no step sorts all pairs of a part; rows are those of the blocks, equal points, short and missing components too."""
    x = np.round(np.random.default_rng(5).normal(size=(600, 3)) * 8) / 8  # sums without rounding, so ties are ties
    x[:40] = x[0]
    v = cloud(spark, x)
    want = {tuple(r)[:4] for r in knn.exact_knn(v).collect()}
    kept, staged = [], knn.staged
    monkeypatch.setattr(knn, "staged", lambda df, name: kept.append(name) or staged(df, name))
    more = v.unionByName(spark.createDataFrame([(0, 9000, [1.0]), (0, 9001, [1.0, None, 2.0])], v.schema))
    for few, bounds in ((8, 4), (700, 1)):
        kept.clear()
        assert {tuple(r)[:4] for r in knn.exact_knn_sql(more, parts=1, few=few).collect()} == want
        assert kept.count("theta-bounds") == bounds
