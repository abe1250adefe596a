"""Linkage orders, stored results and their audits, bases and layer features against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import audit, compare, graph, knn, metrics, project, rips, tasks, topology, trees
from vecloom.sources import tables


def vectors(spark, x, level=0):
    return spark.createDataFrame([(level, i, list(map(float, p))) for i, p in enumerate(x)], "level int, point_id long, vec array<double>")


def random_tree(rng, n, ties=False):
    a = np.arange(1, n)
    b = np.array([rng.integers(0, i) for i in a])
    w = rng.integers(1, 6, n - 1).astype(float) if ties else rng.random(n - 1)
    return np.minimum(a, b), np.maximum(a, b), w


def parts_at(n, a, b, w, radius):
    root = list(range(n))
    for i, j, d in zip(a, b, w):
        if d <= radius:
            x, y = root[i], root[j]
            root = [x if r == y else r for r in root]
    return root


@pytest.mark.parametrize("seed", range(6))
def test_clusters_are_runs_of_leaves_and_agree_as_replayed(seed):
    rng = np.random.default_rng(seed)
    n = 40
    a, b, w = random_tree(rng, n, ties=seed % 2 == 1)
    order, merge, lengths = trees.linkage(a, b, w)
    assert sorted(order) == list(range(n)) and sorted(merge) == list(range(n - 1)) and (np.diff(lengths) >= 0).all()
    label = rng.integers(0, 4, n)
    radius, clusters, index = trees.agreement(order, merge, lengths, label[order])
    assert radius.tolist() == sorted(set(w))
    for r, c, i in zip(radius, clusters, index):
        root = parts_at(n, a, b, w, r)
        runs = [root[v] for v in order]
        assert sum(x != y for x, y in zip(runs, runs[1:])) + 1 == len(set(root)) == c
        pairs = lambda k: sum(v * (v - 1) / 2 for v in Counter(k).values())
        same, p, q, every = pairs(zip(root, label)), pairs(root), pairs(label), n * (n - 1) / 2
        assert i == pytest.approx((same - p * q / every) / ((p + q) / 2 - p * q / every))


def test_merge_curve_of_levels(spark):
    x = np.random.default_rng(0).normal(size=(30, 2))
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)], "point_id long, label string")
    tree = graph.minimum_spanning_trees(vectors(spark, x).unionByName(vectors(spark, x[:1], 1)))
    rows = trees.merge_curve(tree, labels).orderBy("radius").collect()
    assert [r["clusters"] for r in rows] == list(range(29, 0, -1)) and rows[-1]["ari"] == pytest.approx(0)


@pytest.mark.parametrize("block", [7, 512])
def test_tree_checks_find_what_is_planted(spark, block):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(40, 3)), np.zeros((2, 3))])
    v = vectors(spark, x)
    tree = graph.minimum_spanning_trees(v).toPandas()
    checks = lambda t: {r["check"]: r["wrong"] for r in trees.tree_checks(v, spark.createDataFrame(t, "level int, a long, b long, length double"), block).collect()}
    assert checks(tree) == {"edges": 0, "parts": 0, "lengths": 0, "cycles": 0}
    assert checks(tree.iloc[1:])["edges"] == checks(tree.iloc[1:])["parts"] == 1
    longer = tree.copy()
    longer.loc[3, "length"] += 1e-3
    assert checks(longer)["lengths"] == 1
    # An edge swapped for a longer one that still makes a tree: each pair between the parts that is nearer than it is found.
    worse = tree.copy()
    k = int(worse["length"].idxmax())
    root = parts_at(42, *(worse.drop(k)[c].to_numpy() for c in "ab"), worse.drop(k)["length"], np.inf)
    d = knn.distances(x, x)
    one, two = [np.flatnonzero(np.array(root) == r) for r in sorted(set(root))]
    far = max(((d[i, j], i, j) for i in one for j in two))
    worse.loc[k, ["a", "b", "length"]] = min(far[1:]), max(far[1:]), far[0]
    worse = worse.astype({"a": int, "b": int})
    assert checks(worse) == {"edges": 0, "parts": 0, "lengths": 0, "cycles": int((d[np.ix_(one, two)] < far[0] - 1e-9).sum())}


def test_audit_finds_what_is_planted(spark):
    rng = np.random.default_rng(2)
    v = vectors(spark, rng.normal(size=(30, 4))).unionByName(vectors(spark, rng.normal(size=(3, 4)), 1))
    points = spark.createDataFrame([(i, i + 1, int(str(i + 1)[0]), len(str(i + 1)), 0) for i in range(30)], "point_id long, target long, leading_digit int, digit_count int, label int")
    k, model = knn.exact_knn(v), project.pca(v, 2)
    moves = metrics.digit_transitions(k, points)
    wrong = lambda *a: {(r["level"], r["check"]): r["wrong"] for r in audit.relation_audit(v, *a, sample=30).collect() if r["wrong"]}
    assert wrong(k, model, moves) == {}
    assert set(wrong(k.where("NOT (src = 3 AND rank = 2 AND level = 0)"), model, moves)) == {(0, "ranks"), (0, "sample"), (0, "totals")}
    longer = k.withColumn("dist", F.when(F.expr("src = 5 AND rank = 1 AND level = 0"), F.col("dist") + 9).otherwise(F.col("dist")))
    assert wrong(longer, model, moves) == {(0, "lengths"): 1, (0, "order"): 1}
    other = k.withColumn("dst", F.when(F.expr("src = 5 AND rank = 1 AND level = 0"), F.col("src")).otherwise(F.col("dst")))
    assert wrong(other, model, moves) == {(0, "self"): 1, (0, "lengths"): 1}  # its distance is the right one
    bent = model.withColumn("loadings", F.when(F.expr("component = 2 AND level = 1"), F.transform("loadings", lambda t: t * 2)).otherwise(F.col("loadings"))).withColumn("ratio", F.when(F.expr("component = 2 AND level = 0"), 2.0).otherwise(F.col("ratio")))
    assert wrong(k, bent, moves) == {(1, "basis"): 1, (0, "ratios"): 1}
    assert wrong(k, model, moves.withColumn("n", F.col("n") + F.expr("CAST(source_digit = 1 AND target_digit = 1 AS INT)"))) == {(0, "totals"): 1, (1, "totals"): 1}


def test_certain_points_keep_their_order(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    for noise in (0.0, 1e-4, 1e-2, 0.3):
        y = x + rng.uniform(-noise, noise, x.shape)
        r = audit.order_report(vectors(spark, x), vectors(spark, y)).first()
        near = lambda z: [sorted((round(math.dist(p, q), 12), j) for j, q in enumerate(z) if j != i) for i, p in enumerate(z)]
        a, b = near(x), near(y)
        assert r["n"] == 60 and r["same_order"] == sum([j for _, j in p[:4]] == [j for _, j in q[:4]] for p, q in zip(a, b))
        assert r["same_set"] == sum({j for _, j in p[:4]} == {j for _, j in q[:4]} for p, q in zip(a, b)) >= r["same_order"]
        assert r["broken"] == 0 and r["certain"] + r["near_ties"] == 60 and r["certain"] <= r["same_order"]
        assert r["least_margin"] == pytest.approx(min(p[4][0] - p[3][0] for p in a))
    assert audit.order_report(vectors(spark, x[:3]), vectors(spark, x[:3])).first()["same_order"] == 3


def test_basis_fits_are_least_squares_by_fold(spark):
    rng = np.random.default_rng(4)
    n = np.concatenate([np.arange(1, 400), rng.choice(np.arange(400, 20000), 500, replace=False)])
    y = np.stack([np.sin(2 * np.pi * n / 100) + n / 5000, rng.normal(size=len(n))], 1)
    rows = [(0, k + 1, int(t), float(v)) for t, p in zip(n, y) for k, v in enumerate(p)]
    df = spark.createDataFrame(rows, "level int, component int, target long, score double").repartition(5)
    got = {(r["basis"], r["split"]): r["r2"] for r in project.basis_fits(df).collect()}
    fold = spark.createDataFrame([(int(t),) for t in n], "target long").select("target", F.pmod(F.xxhash64(F.lit(1729), "target"), F.lit(5)).alias("random"), F.pmod(F.xxhash64(F.lit(1730), F.floor(F.col("target") / 100)), F.lit(5)).alias("block100")).toPandas().set_index("target").loc[n]
    x, bases = project._basis_columns(n, (n - n.mean()) / n.std())
    z = y - y.mean(0)
    assert set(got) == {(b, s) for b in bases for s in ("random", "block100")} and len(bases) == 21
    for name, at in bases.items():
        for split in ("random", "block100"):
            f, error = fold[split].to_numpy(), 0.0
            for k in range(5):
                w = np.linalg.lstsq(x[f != k][:, at], z[f != k], rcond=None)[0]
                error += ((z[f == k] - x[f == k][:, at] @ w) ** 2).sum()
            assert got[name, split] == pytest.approx(1 - error / (z**2).sum(), rel=1e-5, abs=1e-6)
    assert got["helix_T100", "random"] > got["linear", "random"] + 0.05
    # A piece is a line from digit to digit, whatever the length of the number.
    line = x[:, bases["piecewise_digit_lines"]]
    assert np.linalg.matrix_rank(line) == 18


def test_shared_basis_moves_points_as_vectors_move(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4))
    v = vectors(spark, x).unionByName(vectors(spark, x + [3, 0, 0, 0], 1)).unionByName(vectors(spark, rng.normal(size=(80, 4)), 2))
    got = {(r["level"], r["other"]): r for r in project.shared_basis(v, 4, slices=3).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    r = got[0, 1]
    assert r["n"] == 80 and r["displacement"] == pytest.approx(3) and r["pair_correlation"] == pytest.approx(1)
    assert r["scale"] == pytest.approx(math.sqrt(((x - x.mean(0)) ** 2).sum(1).mean())) and r["relative"] == pytest.approx(r["displacement"] / r["scale"])
    stack = np.concatenate([x, x + [3, 0, 0, 0], np.array([q["vec"] for q in v.where("level = 2").orderBy("point_id").collect()])])
    axes = np.linalg.svd(stack - stack.mean(0), full_matrices=False)[2][:1]
    two = {(q["level"], q["other"]): q["displacement"] for q in project.shared_basis(v, 1, slices=3).collect()}
    assert two[0, 1] == pytest.approx(float(abs((axes @ [3, 0, 0, 0])[0])))


def test_layer_features_are_the_diagrams(spark, data):
    c, p = tables.cube(spark, data).where("level < 2 AND point_id < 60"), tables.points(spark, data).where("point_id < 60")
    c = c.unionByName(c.where("level = 1 AND point_id < 2").withColumn("level", F.lit(2)))  # two points: no bar of dimension 1
    k = knn.exact_knn(c)
    tree, h1, scale = graph.minimum_spanning_trees(c), rips.h1_intervals(c), knn.pair_median(c)
    model = project.pca(c, 2)
    axes = model.groupBy("level").agg(F.lit(0.5).alias("rho_pc1"), F.lit(0.25).alias("rho_pc2"), F.max(F.when(F.col("component") == 1, F.col("ratio"))).alias("ev_pc1"), F.max(F.when(F.col("component") == 2, F.col("ratio"))).alias("ev_pc2"))
    row = metrics.whole_row(k, p)
    got = {r["level"]: r for r in topology.layer_features(tree, h1, scale, row, axes).collect()}
    sizes = {r["level"]: r["scale"] for r in scale.collect()}
    bars, merges = h1.toPandas(), tree.toPandas()
    for level in (0, 1):
        r, s = got[level], sizes[level]
        b, m = bars[bars["level"] == level][["birth", "death"]].to_numpy() / s, merges[merges["level"] == level]["length"].to_numpy() / s
        life = b[:, 1] - b[:, 0]
        share = life / life.sum()
        want = {"distance_scale": s, "h0_median": np.median(m), "h0_q90": np.quantile(m, 0.9), "h0_connect": m.max(), "h1_count": len(b), "h1_max": life.max(), "h1_second": np.sort(life)[-2], "h1_median": np.median(life), "h1_q99": np.quantile(life, 0.99), "h1_total": life.sum(), "h1_entropy": -(share * np.log(share)).sum(), "h1_top30_share": np.sort(life)[-30:].sum() / life.sum(), "h1_first_birth": b[:, 0].min(), "h1_last_death": b[:, 1].max(), "h1_raw_max": life.max() * s, "h1_peak_betti": max(((b[:, 0] <= t) & (b[:, 1] > t)).sum() for t in b[:, 0])}
        want |= {f"h1_count_gt_{str(x).replace('.', '_')}": (life > x).sum() for x in topology.LIVES} | {f"h0_components_at_{str(x).replace('.', '_')}": 1 + (m > x).sum() for x in topology.RADII} | {f"h1_betti_at_{str(x).replace('.', '_')}": ((b[:, 0] <= x) & (b[:, 1] > x)).sum() for x in topology.RADII}
        assert {k: r[k] for k in want} == pytest.approx(want)
        assert r["h1_below_rounding"] == (life <= r["h1_rounding_bound"]).sum() and r["depth"] == level / 2
    assert got[2]["h1_count"] == got[2]["h1_peak_betti"] == 0 and got[2]["h1_max"] is None and got[2]["h0_components_at_2_0"] == 1 and got[2]["phase"] == "late"


def test_whole_row_counts_what_its_shares_are_of(spark):
    v = vectors(spark, np.arange(12.0)[:, None]).unionByName(vectors(spark, -np.arange(12.0)[:, None], 3))
    points = spark.createDataFrame([(i, i + 1, int(str(i + 1)[0]), len(str(i + 1))) for i in range(12)], "point_id long, target long, leading_digit int, digit_count int")
    rows = {r["level"]: r for r in metrics.whole_row(knn.exact_knn(v), points).collect()}
    assert rows[0]["overlap"] is rows[0]["overlap_count"] is rows[0]["overlap_denominator"] is None
    assert rows[3]["overlap_denominator"] == 48 and rows[3]["overlap_count"] == round(rows[3]["overlap"] * 48) > 40
    for r in rows.values():
        assert r["same_digit_length"] == pytest.approx(1 - r["cross_length"]) and r["same_given_cross"] == pytest.approx(r["same_cross_count"] / r["cross_length_count"])
        assert r["components"] == 1 and r["largest_share"] == 1 and r["log_gap_min"] <= r["log_gap_q25"] <= r["log_gap_max"]


def test_referential_audit_finds_what_is_planted(spark):
    records = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 1.0)], "k long, total double")
    parts = spark.createDataFrame([(1, 1, 4.0, "a"), (1, 2, 6.0, "b"), (2, 1, 1.0, "a"), (2, 1, 1.0, "a"), (9, 1, 1.0, "a")], "k long, line int, v double, flag string")
    got = {tuple(r) for r in tasks.referential_audit(records, parts, "k", "line", {"total": ("v", 0.5)}, ("line", "flag")).collect()}
    assert got == {("no_parts", 3, 0), ("no_record", 9, 1), ("repeated", 2, 2), ("field total", 2, 2), ("grid 1 b", None, 4), ("grid 2 a", None, 1)}


def test_sides_that_hardly_vary_have_no_association(spark):
    rows = [("flat", i, 1.0 + 1e-14 * i, float(i)) for i in range(5)] + [("steps", i, float(i), float(i * i)) for i in range(5)] + [("both", i, float((i * 3) % 5), float(i)) for i in range(5)]
    got = {r["model"]: r for r in compare.associations(spark.createDataFrame(rows, "model string, level int, x double, y double"), "x", "y").collect()}
    assert got["flat"]["rho"] is None and got["steps"]["rho"] == pytest.approx(1) and got["steps"]["rho_steps"] is None and got["both"]["rho"] is not None


def test_tree_checks_of_a_long_path(spark):
    """A line of 3,000 points, numbered at random: its tree is one path, which labels that spread along it don't cross in time."""
    order = np.random.default_rng(4).permutation(3000).tolist()
    v = spark.createDataFrame([(0, i, [float(x)]) for x, i in enumerate(order)], "level int, point_id long, vec array<double>")
    t = spark.createDataFrame([(0, min(a, b), max(a, b), 1.0) for a, b in zip(order, order[1:], strict=False)], "level int, a long, b long, length double")
    assert {r["check"]: r["wrong"] for r in trees.tree_checks(v, t).collect()} == {"edges": 0, "parts": 0, "lengths": 0, "cycles": 0}
