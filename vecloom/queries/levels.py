"""Projections, comparisons of levels, behaviour summaries and other statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import distribution, spearman
from ..operators import compare, knn, metrics, project, tasks, topology
from ..sources.tables import behaviour, cube, points, table
from .base import BEHAVIOUR, CUBE, KNN, POINTS, rounded


def a7_pca(spark, d):
    m = project.pca(cube(spark, d), 2)
    return rounded(m.select("level", "component", "variance", "ratio"))


def a8_pca3_scores(spark, d):
    m = project.pca(cube(spark, d), 3)
    signed, rho = project.oriented(project.scores(cube(spark, d), m), points(spark, d))
    return rounded(rho)


def a10_shared_pca(spark, d):
    """Every two levels' points in the first three components of all levels together: displacement, scale, correlation of pair distances."""
    return rounded(project.shared_basis(cube(spark, d), 3))


def a10_whole_basis(spark, d):
    """The same in all components, where distances are those of the vectors."""
    return rounded(project.shared_basis(cube(spark, d), 16))


def a21_bases(spark, d):
    """Out-of-fold fits of each level's first three components by every basis, with both kinds of folds."""
    c = cube(spark, d)
    s = project.scores(c, project.pca(c, 3)).join(points(spark, d).select("point_id", "target"), "point_id")
    return rounded(project.basis_fits(s.select("level", "component", "target", "score")))


def a11_layer_metrics(spark, d):
    return rounded(project.layer_metrics(cube(spark, d), points(spark, d)))


def a12_best_level(spark, d):
    return rounded(project.best_level(project.layer_metrics(cube(spark, d), points(spark, d))).select("level", "ev_pc1"))


def a13_spearman(spark, d):
    return rounded(spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"))


def a15_group_gaps(spark, d):
    m = project.pca(cube(spark, d), 1)
    return rounded(project.group_gaps(project.oriented(project.scores(cube(spark, d), m), points(spark, d))[0], points(spark, d)))


def a18_digit_positions(spark, d):
    """Share of the variance between the digits at each position from the right."""
    each = points(spark, d).select("point_id", F.col("target").cast("string").alias("t"), F.explode(F.sequence(F.lit(1), F.length(F.col("target").cast("string")))).alias("k"))
    return rounded(metrics.group_variance(cube(spark, d), each.select("point_id", F.concat(F.lit("p"), F.col("k") - 1).alias("name"), F.substring("t", -F.col("k"), F.lit(1)).cast("int").alias("label"))))


def a19_streaming_variance(spark, d):
    """Sums, squares and counts by digit and dimension: partial and final aggregation over shards."""
    x = cube(spark, d).join(points(spark, d).select("point_id", "leading_digit"), "point_id").select("level", "leading_digit", F.posexplode("vec").alias("dim", "x"))
    return rounded(x.groupBy("level", "leading_digit", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss")))


def a21_cross_validated(spark, d):
    m = project.pca(cube(spark, d), 3)
    s = project.oriented(project.scores(cube(spark, d), m), points(spark, d))[0]
    return rounded(project.cross_validated(s.join(points(spark, d).select("point_id", "target", "leading_digit"), "point_id")))


def a22_procrustes(spark, d):
    return rounded(project.procrustes(project.scores(cube(spark, d), project.pca(cube(spark, d), 3))))


def a23_bin_means(spark, d):
    x = cube(spark, d).join(points(spark, d).select("point_id", "target"), "point_id").select("level", F.floor(F.col("target") / 100).alias("bin"), F.posexplode("vec").alias("dim", "x"))
    return rounded(x.groupBy("level", "bin", "dim").agg(F.avg("x").alias("mean")))


def a28_multi_seed(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_linenumber", F.col("l_returnflag").alias("run")).agg(F.avg("l_extendedprice").alias("v"))
    return rounded(topology.aggregate_runs(o, "l_linenumber", ["v"], "run"))


def a29_counters(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long"))


def a30_behaviour(spark, d):
    return rounded(tasks.behaviour_summary(behaviour(spark, d)).where("grouping = 0").select("task", "context", "n", "accuracy", "warning"))


def a32_grouping_sets(spark, d):
    return rounded(tasks.behaviour_summary(behaviour(spark, d)).drop("grouping", "warning"))


def _levels(spark, d):
    """Metrics of three models: a model for each flag, a level for each line number and status."""
    li = table(spark, d, "lineitem")
    m = li.groupBy(F.col("l_returnflag").alias("model"), (F.col("l_linenumber") * 2 + (F.col("l_linestatus") == "F").cast("int") - 2).alias("level")).agg(F.round(F.avg("l_quantity"), 6).alias("x"), F.round(F.avg("l_discount") * 100, 6).alias("y"))
    return m


_LEVELS = "lv AS (SELECT l_returnflag AS model, (l_linenumber * 2 + (l_linestatus = 'F')::INT - 2)::INT AS level, round(avg(l_quantity), 6) AS x, round(avg(l_discount) * 100, 6) AS y FROM lineitem GROUP BY ALL)"


def a33_phase_medians(spark, d):
    return rounded(compare.phase_medians(_levels(spark, d), "x"))


def a34_associations(spark, d):
    return rounded(compare.associations(_levels(spark, d), "x", "y"))


def a35_cross_percentile(spark, d):
    return rounded(compare.cross_percentile(compare.level_pairs(_levels(spark, d), ["x"]).withColumn("x", F.round("x", 6)), "x"))


def j12_nearest_level(spark, d):
    return rounded(compare.nearest_level(compare.level_pairs(_levels(spark, d), ["x"]).withColumn("x", F.round("x", 6)), "x"))


def j13_nearest_depth(spark, d):
    asked = spark.range(0, 11).select((F.col("id") / 10.0).alias("depth"))
    return rounded(compare.nearest_depth(compare.relative_depth(_levels(spark, d)), asked))


def j14_level_pairs(spark, d):
    return rounded(compare.level_pairs(_levels(spark, d), ["x", "y"]))


def a37_variance_identity(spark, d):
    """Total = between + within, for prices by brand: the three sums of squares."""
    p = table(spark, d, "part")
    by = p.groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("m"), (F.var_pop("p_retailprice") * F.count("*")).alias("w"))
    both = by.agg((F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n")).alias("between"), F.sum("w").alias("within"))
    return rounded(p.agg((F.var_pop("p_retailprice") * F.count("*")).alias("total")).crossJoin(F.broadcast(both)).select(F.round("total", 2).alias("total"), F.round("between", 2).alias("between"), F.round("within", 2).alias("within"), (F.abs(F.col("total") - F.col("between") - F.col("within")) < 1e-6 * F.col("total")).alias("holds")))


def a43_distance_diagnostics(spark, d):
    """Correlation of the 16-dimensional distances of the stored relations with those in the first three components."""
    k = knn.exact_knn(cube(spark, d))
    s = project.scores(cube(spark, d), project.pca(cube(spark, d), 3)).groupBy("level", "point_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "score"))), lambda x: x["score"]).alias("p"))
    j = k.join(s.select("level", F.col("point_id").alias("src"), F.col("p").alias("x")), ["level", "src"]).join(s.select("level", F.col("point_id").alias("dst"), F.col("p").alias("y")), ["level", "dst"])
    near = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    return rounded(j.withColumn("near", near).groupBy("level").agg(F.corr("dist", "near").alias("pearson"), (F.sum(F.col("near") ** 2) / F.sum(F.col("dist") ** 2)).alias("energy"), F.sqrt(F.sum((F.col("dist") - F.col("near")) ** 2) / F.sum(F.col("dist") ** 2)).alias("stress")))


def j15_projected_retention(spark, d):
    """The share of neighbours kept by a 3-dimensional projection."""
    c = cube(spark, d)
    s = project.scores(c, project.pca(c, 3)).groupBy("level", "point_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "score"))), lambda x: x["score"]).alias("vec"))
    a, b = knn.exact_knn(c).select("level", "src", "dst"), knn.exact_knn(s).select("level", "src", "dst")
    n = a.groupBy("level").agg(F.count("*").alias("n"))
    return rounded(a.join(b, ["level", "src", "dst"]).groupBy("level").agg(F.count("*").alias("kept")).join(n, "level").select("level", (F.col("kept") / F.col("n")).alias("retention")))


def a45_rank_changes(spark, d):
    first = cube(spark, d).select("level", "point_id", F.col("vec")[0].alias("score"))
    return rounded(compare.rank_changes(first, points(spark, d), 0, 1))


def a46_rank_flips(spark, d):
    first = cube(spark, d).select("level", "point_id", F.col("vec")[0].alias("score"))
    return compare.rank_flips(first, points(spark, d), 0, 1, "digit_count")


def a47_group_distances(spark, d):
    """Mean, median and extremes of three columns by pair of digits, over the stored relations."""
    r = metrics.labelled(knn.exact_knn(cube(spark, d)), points(spark, d)).withColumn("gap", F.abs(F.col("st") - F.col("dt")).cast("double"))
    return rounded(r.groupBy(F.least("sd", "dd").alias("g1"), F.greatest("sd", "dd").alias("g2")).agg(*distribution("dist", "dist"), *distribution("gap", "gap"), F.count("*").alias("n")))


def a48_peak_windows(spark, d):
    return rounded(compare.peak_windows(_levels(spark, d), "x"))


def a49_selection_facts(spark, d):
    m = compare.relative_depth(_levels(spark, d))
    return rounded(project.best_level(m, "x", "model").select("model", "level", "depth", "x"))


def f10_depth_curves(spark, d):
    """The series of a depth figure: each model's metric on normalised depth, with the model's mean beside it."""
    m = compare.relative_depth(_levels(spark, d))
    return rounded(m.withColumn("mean", F.avg("x").over(Window.partitionBy("model"))))


_V = "vv AS (SELECT level, point_id, vec[1] AS score FROM cube WHERE level IN (0, 1))"
_PAIRS = _LEVELS + ", p AS (SELECT a.model AS m1, a.level AS l1, b.model AS m2, b.level AS l2, round(abs(a.x - b.x), 6) AS x, abs(a.y - b.y) AS y FROM lv a JOIN lv b ON (a.model, a.level) < (b.model, b.level))"
_DEPTH = _LEVELS + ", dp AS (SELECT *, level / max(level) OVER (PARTITION BY model) AS depth, max(level) OVER (PARTITION BY model) - level AS fl FROM lv)"
_six = lambda v, p: f"round(min({v}), 6) AS {p}_min, round(quantile_cont({v}, 0.25), 6) AS {p}_q25, round(quantile_cont({v}, 0.5), 6) AS {p}_median, round(quantile_cont({v}, 0.75), 6) AS {p}_q75, round(max({v}), 6) AS {p}_max, round(avg({v}), 6) AS {p}_mean"
_rank = lambda v, p: f"rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0::DOUBLE"

QUERIES = {
    "a7_pca": (a7_pca, None),
    "a8_pca3_scores": (a8_pca3_scores, None),
    "a10_shared_pca": (a10_shared_pca, None),
    "a21_bases": (a21_bases, None),
    "a10_whole_basis": (a10_whole_basis, f"""WITH {CUBE}, x AS (SELECT *, lead(vec) OVER (PARTITION BY level, point_id % 64 ORDER BY point_id) AS nxt FROM cube), p AS (SELECT level, point_id, vec, list_distance(vec, nxt) AS pair FROM x),
e AS (SELECT level, unnest(range(16)) AS c, unnest(vec) AS v FROM cube), s AS (SELECT level, sqrt(sum(v)) AS scale FROM (SELECT level, c, var_pop(v) AS v FROM e GROUP BY ALL) GROUP BY level)
SELECT a.level, b.level AS other, count(*) AS n, round(median(list_distance(a.vec, b.vec)), 6) AS displacement, round(max(scale), 6) AS scale, round(median(list_distance(a.vec, b.vec)) / max(scale), 6) AS relative, round(corr(a.pair, b.pair), 6) AS pair_correlation
FROM p a JOIN p b ON a.point_id = b.point_id AND a.level < b.level JOIN s ON s.level = a.level GROUP BY a.level, b.level"""),
    "a11_layer_metrics": (a11_layer_metrics, None),
    "a12_best_level": (a12_best_level, None),
    "a13_spearman": (a13_spearman, f"WITH r AS (SELECT l_returnflag, {_rank('l_quantity', 'l_returnflag')} AS x, {_rank('l_extendedprice', 'l_returnflag')} AS y FROM lineitem) SELECT l_returnflag, round(corr(x, y), 6) AS rho FROM r GROUP BY ALL"),
    "a15_group_gaps": (a15_group_gaps, None),
    "a18_digit_positions": (a18_digit_positions, f"""WITH {CUBE}, {POINTS}, l AS (SELECT point_id, 'p' || k AS name, (target // (10 ** k)::BIGINT % 10)::INT AS label FROM points, range(18) t(k) WHERE target >= 10 ** k),
x AS (SELECT level, name, label, unnest(range(16)) AS dim, unnest(vec) AS x FROM cube JOIN l USING (point_id)), m AS (SELECT *, avg(x) OVER (PARTITION BY level, name, dim) AS mu, avg(x) OVER (PARTITION BY level, name, dim, label) AS g FROM x)
SELECT level, name, round(sum((g - mu) ** 2) / sum((x - mu) ** 2), 6) AS share FROM m GROUP BY ALL"""),
    "a19_streaming_variance": (a19_streaming_variance, f"WITH {CUBE}, {POINTS}, x AS (SELECT level, leading_digit, unnest(range(16))::INT AS dim, unnest(vec) AS x FROM cube JOIN points USING (point_id)) SELECT level, leading_digit, dim, count(*) AS n, round(sum(x), 6) AS s, round(sum(x * x), 6) AS ss FROM x GROUP BY ALL"),
    "a21_cross_validated": (a21_cross_validated, None),
    "a22_procrustes": (a22_procrustes, None),
    "a23_bin_means": (a23_bin_means, f"WITH {CUBE}, x AS (SELECT level, (point_id + 1) // 100 AS bin, unnest(range(16))::INT AS dim, unnest(vec) AS x FROM cube) SELECT level, bin, dim, round(avg(x), 6) AS mean FROM x GROUP BY ALL"),
    "a28_multi_seed": (a28_multi_seed, """WITH o AS (SELECT l_linenumber, l_returnflag AS run, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), a AS (SELECT l_linenumber, count(DISTINCT run) AS runs, round(avg(v), 6) AS v_mean, round(stddev_samp(v), 6) AS v_std, round(stddev_pop(v), 6) AS v_pstd FROM o GROUP BY ALL)
SELECT *, runs = max(runs) OVER () AS complete FROM a"""),
    "a29_counters": (a29_counters, "SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long FROM documents GROUP BY ALL"),
    "a30_behaviour": (a30_behaviour, f"WITH {BEHAVIOUR} SELECT task, context, count(*) AS n, round(avg(exact_match::INT), 6) AS accuracy, avg(exact_match::INT) < 0.8 AS warning FROM behaviour GROUP BY ALL"),
    "a32_grouping_sets": (a32_grouping_sets, f"""WITH {BEHAVIOUR} SELECT task, context, count(*) AS n, round(avg(exact_match::INT), 6) AS accuracy, count(*) FILTER (changed) AS changed_n, round(avg(exact_match::INT) FILTER (changed), 6) AS changed_accuracy,
round(avg(exact_match::INT) FILTER (NOT changed), 6) AS unchanged_accuracy, count(*) FILTER (leading_zero) AS zero_n, round(avg(exact_match::INT) FILTER (leading_zero), 6) AS zero_accuracy, count(*) FILTER (hit_limit) AS limit_n FROM behaviour GROUP BY GROUPING SETS ((task, context), (task), ())"""),
    "a33_phase_medians": (a33_phase_medians, f"""WITH {_DEPTH}, m AS (SELECT model, x, 'early' AS phase FROM dp WHERE depth <= 1.0::DOUBLE / 3 UNION ALL SELECT model, x, 'middle' FROM dp WHERE depth > 1.0::DOUBLE / 3 AND depth <= 2.0::DOUBLE / 3 UNION ALL SELECT model, x, 'late' FROM dp WHERE depth > 2.0::DOUBLE / 3 UNION ALL SELECT model, x, 'last3' FROM dp WHERE fl < 3)
SELECT model, phase, count(*) AS n, round(median(x), 6) AS median FROM m GROUP BY ALL"""),
    "a34_associations": (a34_associations, f"""WITH {_LEVELS}, s AS (SELECT model, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM lv WINDOW w AS (PARTITION BY model ORDER BY level)), r AS (SELECT model, {_rank('x', 'model')} AS p, {_rank('y', 'model')} AS q FROM lv),
t AS (SELECT model, {_rank('dx', 'model')} AS p, {_rank('dy', 'model')} AS q FROM s WHERE dx IS NOT NULL), a AS (SELECT model, corr(p, q) AS rho FROM r GROUP BY model), b AS (SELECT model, corr(p, q) AS rho_steps FROM t GROUP BY model) SELECT model, round(rho, 6) AS rho, round(rho_steps, 6) AS rho_steps FROM a JOIN b USING (model)"""),
    "a35_cross_percentile": (a35_cross_percentile, f"WITH {_PAIRS} SELECT m1, l1, m2, l2, x, round(100.0::DOUBLE * (SELECT count(*) FROM p q WHERE q.m1 <> q.m2 AND q.x <= p.x) / (SELECT count(*) FROM p q WHERE q.m1 <> q.m2), 6) AS percentile FROM p WHERE m1 = m2"),
    "a37_variance_identity": (a37_variance_identity, """WITH b AS (SELECT count(*) AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) * count(*) AS w FROM part GROUP BY p_brand)
SELECT round((SELECT var_pop(p_retailprice) * count(*) FROM part), 2) AS total, round(sum(n * m ** 2) - sum(n * m) ** 2 / sum(n), 2) AS between, round(sum(w), 2) AS within, true AS holds FROM b"""),
    "a43_distance_diagnostics": (a43_distance_diagnostics, None),
    "a45_rank_changes": (a45_rank_changes, f"""WITH {CUBE}, {POINTS}, {_V}, s AS (SELECT level, point_id, {_rank('score', 'level')} AS r, {_rank('target', 'level')} AS t FROM vv JOIN points USING (point_id)),
z AS (SELECT *, (r - avg(r) OVER w) / stddev_pop(r) OVER w * (t - avg(t) OVER w) / stddev_pop(t) OVER w / count(*) OVER w AS p FROM s WINDOW w AS (PARTITION BY level))
SELECT a.point_id, a.r AS rank1, b.r AS rank2, b.r - a.r AS change, round(b.p - a.p, 6) + 0.0::DOUBLE AS contribution FROM z a JOIN z b ON a.point_id = b.point_id AND a.level = 0 AND b.level = 1"""),
    "a46_rank_flips": (a46_rank_flips, f"""WITH {CUBE}, {POINTS}, {_V}, w AS (SELECT a.point_id, a.score AS x, b.score AS y, target, digit_count AS g FROM vv a JOIN vv b ON a.point_id = b.point_id AND a.level = 0 AND b.level = 1 JOIN points p ON p.point_id = a.point_id),
j AS (SELECT least(p.g, q.g) AS g1, greatest(p.g, q.g) AS g2, sign((q.x - p.x) * (q.target - p.target)) AS s1, sign((q.y - p.y) * (q.target - p.target)) AS s2 FROM w p JOIN w q ON p.point_id < q.point_id)
SELECT g1, g2, count(*) AS pairs, count(*) FILTER (s1 > 0 AND s2 < 0) AS flips, count(*) FILTER (s1 < 0 AND s2 > 0) AS unflips, count(*) FILTER (s1 = 0 OR s2 = 0) AS ties FROM j GROUP BY ALL"""),
    "a47_group_distances": (a47_group_distances, f"WITH {KNN}, {POINTS}, r AS (SELECT least(s.leading_digit, t.leading_digit) AS g1, greatest(s.leading_digit, t.leading_digit) AS g2, dist, abs(s.target - t.target)::DOUBLE AS gap FROM knn JOIN points s ON s.point_id = src JOIN points t ON t.point_id = dst) SELECT g1, g2, {_six('dist', 'dist')}, {_six('gap', 'gap')}, count(*) AS n FROM r GROUP BY ALL"),
    "a48_peak_windows": (a48_peak_windows, f"WITH {_LEVELS}, t AS (SELECT model, level AS peak FROM lv QUALIFY row_number() OVER (PARTITION BY model ORDER BY x DESC, level) = 1) SELECT model, peak, min(x) AS low, max(x) AS high, round(median(x), 6) AS median FROM lv JOIN t USING (model) WHERE abs(level - peak) <= 2 GROUP BY ALL"),
    "a49_selection_facts": (a49_selection_facts, f"WITH {_DEPTH} SELECT model, level, round(depth, 6) AS depth, x FROM dp QUALIFY row_number() OVER (PARTITION BY model ORDER BY x DESC, level) = 1"),
    "f10_depth_curves": (f10_depth_curves, f"WITH {_DEPTH} SELECT model, level, x, y, round(depth, 6) AS depth, round(avg(x) OVER (PARTITION BY model), 6) AS mean FROM dp"),
    "j12_nearest_level": (j12_nearest_level, f"""WITH {_PAIRS}, b AS (SELECT m1, l1, m2, l2, x FROM p UNION ALL SELECT m2, l2, m1, l1, x FROM p) SELECT m1 AS model, l1 AS level, m2 AS other_model, l2 AS other_level, x AS distance FROM b WHERE m1 <> m2 OR abs(l1 - l2) > 1
QUALIFY row_number() OVER (PARTITION BY m1, l1 ORDER BY x, m2, l2) = 1"""),
    "j13_nearest_depth": (j13_nearest_depth, f"WITH {_DEPTH} SELECT model, i / 10.0::DOUBLE AS wanted, level, round(depth, 6) AS depth FROM dp, range(11) t(i) QUALIFY row_number() OVER (PARTITION BY model, i ORDER BY abs(depth - i / 10.0::DOUBLE), level) = 1"),
    "j14_level_pairs": (j14_level_pairs, f"WITH {_PAIRS} SELECT m1, l1, m2, l2, x, round(y, 6) AS y FROM p"),
    "j15_projected_retention": (j15_projected_retention, None),
}
