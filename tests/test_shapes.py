"""Template fitting: halves, registration, judging and controls against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import shapes
from vecloom.queries import shapes as shape_queries


def cloud_rows(spark, clouds):
    rows = [(name, i, *map(float, p)) for name, x in clouds.items() for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "cloud string, point_id long, x double, y double, z double")


def turned(seed):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))[0]


def test_every_level_and_label_is_a_cloud(spark, data):
    sizes = {r["cloud"]: r["count"] for r in shape_queries._clouds(spark, data).groupBy("cloud").count().collect()}
    labels = {r["label"]: r["count"] for r in spark.read.parquet(f"{data}/embeddings.parquet").groupBy("label").count().collect()}
    assert sizes == {f"{v}-{g}": n for v in range(4) for g, n in labels.items()}


def test_halves_share_the_fitting_halfs_frame(spark):
    x = np.random.default_rng(0).normal(size=(3000, 3)) * [3, 2, 1] @ turned(1) + [1e6, -1e6, 5]
    df = cloud_rows(spark, {"a": x, "point": np.ones((4, 3))})
    got = shapes.halves(df).toPandas()
    assert set(got["cloud"]) == {"a"} and len(got) == 3000
    fit, rest = (got[got["fitting"] == v][["x", "y", "z"]].to_numpy() for v in (True, False))
    assert fit.mean(0) == pytest.approx(0, abs=1e-6) and (fit**2).sum(1).mean() == pytest.approx(1)
    c = fit.T @ fit / len(fit)
    assert np.abs(c - np.diag(np.diag(c))).max() < 1e-6 and (np.diff(np.diag(c)) < 0).all()
    assert (rest**2).sum(1).mean() == pytest.approx(1, abs=0.1) and 0.4 < len(fit) / 3000 < 0.6
    swapped = shapes.halves(df, other=True).toPandas().set_index("point_id")["fitting"]
    assert (swapped == ~got.set_index("point_id")["fitting"]).all()


def cost(template, cloud, scale, turn, shift):
    y = scale * template @ turn.T + shift
    d = ((y[:, None] - cloud) ** 2).sum(-1)
    return (d.min(0).mean() + d.min(1).mean()) / 2


@pytest.mark.parametrize("seed", range(4))
def test_registration_is_a_local_best(seed, monkeypatch):
    """No small change of scale, rotation or shift lowers the two-sided mean square, which each step lowers or keeps."""
    rng = np.random.default_rng(seed)
    template, cloud = rng.normal(size=(40, 3)), rng.normal(size=(25, 3)) * [1, 0.7, 0.4]
    starts = np.array([turned(seed * 10 + k) for k in range(6)])
    monkeypatch.setattr(shapes, "STEPS", 200)
    fit = shapes.register(template, cloud, starts)
    base = cost(template, cloud, *fit)
    assert fit[1] @ fit[1].T == pytest.approx(np.eye(3), abs=1e-9)
    for _ in range(60):
        g = rng.normal(size=(3, 3)) * 1e-4
        q = np.linalg.qr(fit[1] + g @ fit[1])
        turn = q[0] * np.sign(np.diag(q[1]))
        scale = float(np.clip(fit[0] * (1 + rng.normal() * 1e-4), *shapes.SCALE))
        assert cost(template, cloud, scale, turn, fit[2] + rng.normal(size=3) * 1e-4) >= base - 2e-6
    costs = []
    for steps in (1, 2, 4, 8):
        monkeypatch.setattr(shapes, "STEPS", steps)
        costs.append(cost(template, cloud, *shapes.register(template, cloud, starts[:1])))
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:]))


def test_registration_undoes_a_similarity():
    template = dict((n, x) for n, _, _, x in shapes.templates(96))["helix_2_1.0"]
    mirror = np.diag([1.0, 1.0, -1.0])
    for turn in (turned(3), turned(3) @ mirror):
        cloud = 1.7 * template @ turn.T + [0.1, -0.2, 0.3]
        scale, r, shift = shapes.register(template, cloud, np.concatenate([[turn @ turned(9) * 0 + turn], shapes._starts("helix_2_1.0", 96)]))
        assert scale == pytest.approx(1.7, abs=1e-6) and cost(template, cloud, scale, r, shift) < 1e-10
    assert shapes.register(template, 50 * template, np.eye(3)[None])[0] == 3.0 and shapes.register(template, template / 50, np.eye(3)[None])[0] == 0.25


def test_starts_are_56_orthogonal_matrices():
    s = shapes._starts("cube_vertices", 64)
    assert s.shape == (56, 3, 3) and np.abs(s @ s.transpose(0, 2, 1) - np.eye(3)).max() < 1e-9
    assert len({tuple(np.round(m.ravel(), 6)) for m in s}) == 56


def test_metrics_are_those_of_all_pairs(spark, monkeypatch):
    """Blocks, counts and minima give what one array of all distances gives."""
    rng = np.random.default_rng(5)
    df = cloud_rows(spark, {"a": rng.normal(size=(700, 3)), "b": np.round(rng.normal(size=(90, 3)), 1)})
    points = shapes.halves(df)
    kinds = {n: x for n, _, _, x in shapes.templates(48)}
    fits = shapes.registered(points, n=48, cap=60)
    got = {(r["cloud"], r["name"]): r for r in shapes.judged(points, fits, n=48, block=50).collect()}
    assert len(got) == 64
    held = points.where("NOT fitting").toPandas()
    for r in fits.collect():
        x = held[held["cloud"] == r["cloud"]][["x", "y", "z"]].to_numpy()
        y = r["scale"] * kinds[r["name"]] @ np.reshape(r["turn"], (3, 3)).T + r["shift"]
        d = np.sqrt(((x[:, None] - y) ** 2).sum(-1))
        to, back = d.min(1), d.min(0)
        want = {"rms": np.sqrt(((to**2).mean() + (back**2).mean()) / 2), "rms_cloud": np.sqrt((to**2).mean()), "rms_template": np.sqrt((back**2).mean()), "p95": np.quantile(to, 0.95), "p99": np.quantile(to, 0.99), "p95_template": np.quantile(back, 0.95), "within": (to <= 0.15).mean(), "coverage": (back <= 0.15).mean(), "line_rms": np.sqrt((x[:, 1:] ** 2).sum(1).mean()), "plane_rms": np.sqrt((x[:, 2] ** 2).mean())}
        one = got[r["cloud"], r["name"]]
        assert {k: one[k] for k in want} == pytest.approx(want, abs=2e-6)
        assert 0 < one["occupancy"] <= len(set(d.argmin(1))) / 48 + 0.1


def test_shapes_fit_their_own_templates_only(spark):
    kinds = {n: x for n, _, _, x in shapes.templates(128)}
    assert len(kinds) == 32
    noise = np.random.default_rng(0).normal(size=(2048, 3)) * 0.02
    tetrahedron = 3 * (kinds["tetrahedron_vertices"].repeat(16, 0) + noise) @ turned(1) + 5
    circle = 0.01 * (kinds["circle"].repeat(16, 0) + noise) @ turned(2) - 900
    f = shapes.fit_all(cloud_rows(spark, {"t": tetrahedron, "c": circle, "one": np.zeros((1, 3)), "flat": np.ones((30, 3))}), n=128)
    rows = {(r["cloud"], r["name"]): r for r in f.collect()}
    assert {c for c, _ in rows} == {"t", "c"} and len(rows) == 64
    assert rows["t", "tetrahedron_vertices"]["passed"] and not rows["t", "circle"]["passed"]
    assert rows["c", "circle"]["passed"] and not rows["c", "sphere"]["passed"]
    near = {r["cloud"]: r["name"] for r in shapes.closest(f).collect()}
    assert near == {"t": "tetrahedron_vertices", "c": "circle"}


def test_controls_keep_moments_or_values(spark):
    x = np.random.default_rng(0).normal(size=(4000, 3)) * [1, 2, 3] @ turned(4) + [10, 0, 0]
    df = cloud_rows(spark, {"a": x, "line": np.outer(np.arange(5.0), [1, 0, 0])})
    null = shapes.null_clouds(df, draws=2, slice_rows=500).toPandas()
    assert len(null) == 4 * (4000 + 5)
    for (cloud, kind, draw), f in null.groupby(["cloud", "kind", "draw"]):
        y, z = f[["x", "y", "z"]].to_numpy(), x if cloud == "a" else np.outer(np.arange(5.0), [1, 0, 0])
        assert sorted(f["point_id"]) == list(range(len(z)))
        if kind == "permuted":
            for k in range(3):
                assert np.array_equal(np.sort(y[:, k]), np.sort(z[:, k]))
        elif cloud == "a":
            assert np.cov(y.T) == pytest.approx(np.cov(z.T), abs=0.6) and y.mean(0) == pytest.approx(z.mean(0), abs=0.2)
        else:
            assert (y[:, 1:] == 0).all()
    a = null[(null["cloud"] == "a") & (null["kind"] == "permuted") & (null["draw"] == 1)][["x", "y", "z"]].to_numpy()
    assert np.abs(np.corrcoef(a.T) - np.eye(3)).max() < 0.08
    again = shapes.null_clouds(df.repartition(7), draws=2, slice_rows=500)
    assert again.orderBy("cloud", "kind", "draw", "point_id").toPandas()["x"].tolist() == pytest.approx(null.sort_values(["cloud", "kind", "draw", "point_id"])["x"].tolist())


def test_study_counts_passes_and_replications(spark):
    fits = spark.createDataFrame([("a", "t", 0.1, True), ("a", "u", 0.2, True), ("b", "t", 0.3, False), ("b", "u", 0.2, False)], "cloud string, name string, rms double, passed boolean")
    again = fits.withColumn("passed", F.col("name") == "t")
    controls = shapes.control_medians(spark.createDataFrame([("gaussian", "t", 1.0, False), ("gaussian", "t", 3.0, False), ("permuted", "u", 2.0, True)], "kind string, name string, rms double, passed boolean"))
    assert {tuple(r) for r in controls.collect()} == {("gaussian", "t", 2, 2.0, 0), ("permuted", "u", 1, 2.0, 1)}
    got = {r["name"]: tuple(r)[1:] for r in shapes.study(fits, again, controls).collect()}
    assert got == {"t": (2, 1, 1, 1, pytest.approx(0.2), 2.0, None), "u": (2, 1, 0, 1, pytest.approx(0.2), None, 2.0)}
