"""Seeded pairs, centroids, planes, branches and trees of the level cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import contingency
from ..operators import clusters, geometry, graph, knn, metrics, project, topology, trees
from ..sources.tables import cube, intervals, points, table
from ..staging import staged
from .base import CUBE, EDGES, LABELLED, POINTS, rounded
from .graphs import _COMP


def _digits(spark, d):
    return points(spark, d).select("point_id", F.col("leading_digit").alias("label"))


def _pairs(spark, d):
    """Every point with one far from it: a pair a point, by a rule that SQL can follow."""
    p = points(spark, d)
    return p.crossJoin(F.broadcast(p.agg(F.count("*").alias("n")))).select(F.col("point_id").alias("k"), F.col("point_id").alias("i"), F.pmod(F.col("point_id") * 7 + 1, F.col("n")).alias("j")).where("i <> j")


_PAIRS = "pr AS (SELECT vec_id AS i, (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS j FROM embeddings WHERE vec_id <> (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings))"
_DIST = f"{CUBE}, {_PAIRS}, dd AS (SELECT a.level, i AS k, list_distance(a.vec, b.vec) AS d FROM pr JOIN cube a ON a.point_id = i JOIN cube b ON b.point_id = j AND a.level = b.level)"


def j7_seeded_pairs(spark, d):
    """A hundred thousand draws over the points, and how far apart they are at each level."""
    n = table(spark, d, "embeddings").count()
    return rounded(geometry.pair_distances(cube(spark, d), geometry.seeded_pairs(spark, n, 100_000)).groupBy("level").agg(F.count("*").alias("pairs"), F.median("d").alias("median"), F.max("d").alias("largest")))


def t1_seeded_normalisation(spark, d):
    n = table(spark, d, "embeddings").count()
    return rounded(topology.normalisation(cube(spark, d), geometry.seeded_pairs(spark, n, 100_000).select("i", "j")))


def t2_pair_median(spark, d):
    return rounded(knn.pair_median(cube(spark, d)))


def t18_bottleneck_matrix(spark, d):
    return rounded(geometry.bottleneck_matrix(intervals(spark, d), "diagram"))


def a1_metric_row(spark, d):
    """The whole row of a level: metrics, components, overlap with the level before, and agreement by digit."""
    k, p = knn.exact_knn(cube(spark, d)), points(spark, d)
    return rounded(metrics.metric_row(k, p))


def a18_digit_harmonics(spark, d):
    return rounded(geometry.digit_harmonics(cube(spark, d), points(spark, d)))


def a18_carry_steps(spark, d):
    return rounded(geometry.carry_steps(cube(spark, d), points(spark, d)))


def a20_shape_of_scores(spark, d):
    model = project.pca(cube(spark, d), 3)
    s = project.scores(cube(spark, d), model).groupBy("level", "point_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "score"))), lambda x: x["score"]).alias("vec"))
    return rounded(geometry.shape_of_scores(model, metrics.centroids(s, _digits(spark, d))))


def a21_folds(spark, d):
    """Out-of-fold fits of each level's first coordinate by a line and by the leading digit."""
    rows = cube(spark, d).select("level", "point_id", F.lit(1).alias("component"), F.col("vec")[0].alias("score")).join(points(spark, d), "point_id")
    return rounded(project.cross_validated(rows.select("level", "component", "target", "leading_digit", "score")).where("basis <> 'cubic'"))


def a7_pca_moments(spark, d):
    """The sums of all variances and of their squares: the trace and the norm of the covariance."""
    m = project.pca(cube(spark, d), 16)
    return rounded(m.groupBy("level").agg(F.sum("variance").alias("trace"), F.sum(F.col("variance") ** 2).alias("squares"), F.sum("ratio").alias("ratios")))


def a24_pair_correlations(spark, d):
    return rounded(geometry.pair_correlations(cube(spark, d), _pairs(spark, d)))


def a24_subspace_angles(spark, d):
    a = geometry.subspace_angles(project.pca(cube(spark, d), 2))
    return rounded(a.select("level", "previous", F.posexplode("angles").alias("place", "angle")))


def a25_ami(spark, d):
    return rounded(geometry.mutual_information(contingency(points(spark, d), "leading_digit", "label")))


def a27_branches(spark, d):
    s = project.scores(cube(spark, d), project.pca(cube(spark, d), 2))
    return rounded(geometry.branches(s, cube(spark, d), points(spark, d), "label")[1])


def a27_kmeans(spark, d):
    """k-means of every level's first three components for k = 2, 4 and 9: clusters' sizes, inertia, and the silhouette there and of the vectors."""
    c = cube(spark, d)
    s = project.scores(c, project.pca(c, 3)).groupBy("level", "point_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "score"))), lambda x: x["score"]).alias("vec"))
    s, out, partitions, ks = staged(s, "means-scores"), None, [], (2, 4, 9)
    for k in ks:
        labels, centres = clusters.kmeans(s, k)
        partitions.append(staged(labels, "means-labels"))
        one = centres.groupBy("level").agg(F.sum("inertia").alias("inertia"), F.min("n").alias("least"), F.max("n").alias("most")).withColumn("partition", F.lit(len(partitions) - 1)).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    both = clusters.silhouettes_of(s, partitions).join(clusters.silhouettes_of(c, partitions).select("partition", "level", F.col("silhouette").alias("silhouette_full")), ["partition", "level"])
    return rounded(out.join(both, ["partition", "level"]).select("level", "inertia", "least", "most", "n", "clusters", "silhouette", "silhouette_full", "k"))


def a27_label_silhouettes(spark, d):
    """How well the labels part each level's vectors."""
    labels = cube(spark, d).select("level", "point_id").join(points(spark, d).select("point_id", F.col("label").alias("cluster")), "point_id")
    return rounded(clusters.silhouettes(cube(spark, d), labels))


def a36_centroid_statistics(spark, d):
    return rounded(geometry.centroid_statistics(metrics.centroids(cube(spark, d), _digits(spark, d)), cube(spark, d), _digits(spark, d)))


def _parts(spark, d):
    return graph.components(cube(spark, d).select("level", "point_id"), graph.union_graph(knn.exact_knn(cube(spark, d))))


def a38_component_runs(spark, d):
    return geometry.component_runs(_parts(spark, d), points(spark, d))[0]


def a38_component_counts(spark, d):
    return geometry.component_runs(_parts(spark, d), points(spark, d))[1]


def a39_best_radius(spark, d):
    return rounded(geometry.best_radius(trees.merge_curve(graph.minimum_spanning_trees(cube(spark, d)), _digits(spark, d))))


def a40_tree_labels(spark, d):
    return rounded(geometry.tree_labels(graph.minimum_spanning_trees(cube(spark, d)), points(spark, d)))


def a44_relative_errors(spark, d):
    """The cube kept to three places against itself."""
    c = cube(spark, d)
    return rounded(geometry.relative_errors(c, c.withColumn("vec", F.transform("vec", lambda x: F.floor(x * 1000) / 1000)), _pairs(spark, d)))


_RANK = lambda v: f"rank() OVER (PARTITION BY level ORDER BY {v}) + (count(*) OVER (PARTITION BY level, {v}) - 1) / 2.0"
_CENTRES = f"""{CUBE}, {POINTS}, x AS (SELECT level, point_id, leading_digit AS label, unnest(range(16)) AS dim, unnest(vec) AS x FROM cube JOIN points USING (point_id)),
m AS (SELECT *, avg(x) OVER (PARTITION BY level, label, dim) AS g FROM x), c AS (SELECT level, label, list(m ORDER BY dim) AS v FROM (SELECT level, label, dim, avg(x) AS m FROM x GROUP BY ALL) GROUP BY ALL),
p AS (SELECT a.level, a.label AS a, b.label AS b, list_distance(a.v, b.v) AS d, b.label - a.label AS gap FROM c a JOIN c b ON a.level = b.level AND a.label < b.label)"""

QUERIES = {
    "j7_seeded_pairs": (j7_seeded_pairs, None),
    "t1_seeded_normalisation": (t1_seeded_normalisation, None),
    "t2_pair_median": (t2_pair_median, f"WITH {CUBE} SELECT a.level, count(*) AS pairs, round(median(list_distance(a.vec, b.vec)), 6) AS scale FROM cube a JOIN cube b ON a.level = b.level AND a.point_id < b.point_id GROUP BY a.level"),
    "t18_bottleneck_matrix": (t18_bottleneck_matrix, None),
    "a1_metric_row": (a1_metric_row, f"""WITH RECURSIVE {_COMP}, {LABELLED.split(', ', 1)[1].split('<= 4), ', 1)[1]},
s AS (SELECT level, count(DISTINCT src) AS point_count, round(avg((sd = dd)::INT), 6) AS same_leading_digit, round(median(abs(log10(st) - log10(dt))), 6) AS log_gap_median, round(max(abs(log10(st) - log10(dt))), 6) AS log_gap_max,
{", ".join(f"round(avg(CASE WHEN sd = {i} THEN (dd = {i})::INT END), 6) AS same_{i}" for i in range(1, 10))} FROM rel GROUP BY level),
n AS (SELECT level, component, count(*) AS n FROM comp GROUP BY ALL), cc AS (SELECT level, count(*) AS components, round(max(n) / sum(n), 6) AS largest_share FROM n GROUP BY level),
o AS (SELECT n.level, round(count(o.src) / count(DISTINCT n.src) / 4, 6) AS overlap FROM knn n LEFT JOIN knn o ON o.level = n.level - 1 AND o.src = n.src AND o.dst = n.dst WHERE n.level > 0 GROUP BY n.level)
SELECT s.*, components, largest_share, overlap FROM s JOIN cc USING (level) LEFT JOIN o USING (level)"""),
    "a18_digit_harmonics": (a18_digit_harmonics, None),
    "a18_carry_steps": (a18_carry_steps, f"""WITH {CUBE}, s AS (SELECT a.level, b.point_id + 1 AS t, list_distance(a.vec, b.vec) AS d FROM cube a JOIN cube b ON a.level = b.level AND b.point_id = a.point_id + 1)
SELECT level, {", ".join(f"round(median(d) FILTER (t % {k} = 0) / median(d) FILTER (t % 10 <> 0), 6) AS carry_{k}" for k in (10, 100))} FROM s GROUP BY level"""),
    "a20_shape_of_scores": (a20_shape_of_scores, None),
    "a21_folds": (a21_folds, f"""WITH {CUBE}, {POINTS}, r AS (SELECT level, vec[1] AS y, target::DOUBLE AS x, leading_digit AS g, target // 100 % 5 AS fold FROM cube JOIN points USING (point_id)),
f AS (SELECT DISTINCT level, fold FROM r), line AS (SELECT f.level, f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f JOIN r ON r.level = f.level AND r.fold <> f.fold GROUP BY ALL),
mean AS (SELECT f.level, f.fold, g, avg(y) AS m FROM f JOIN r ON r.level = f.level AND r.fold <> f.fold GROUP BY ALL), c AS (SELECT level, avg(y) AS c FROM r GROUP BY level),
s AS (SELECT r.level, sum((y - c) ** 2) AS sst, sum((y - a - b * x) ** 2) AS sl, sum((y - coalesce(m, c)) ** 2) AS sd FROM r JOIN line USING (level, fold) JOIN c USING (level) LEFT JOIN mean USING (level, fold, g) GROUP BY r.level)
SELECT level, 1::INT AS component, 'linear' AS basis, round(1 - sl / sst, 6) AS r2 FROM s UNION ALL SELECT level, 1::INT, 'digit', round(1 - sd / sst, 6) FROM s"""),
    "a7_pca_moments": (a7_pca_moments, f"""WITH {CUBE}, x AS (SELECT level, point_id, unnest(range(16)) AS dim, unnest(vec) AS x FROM cube),
c AS (SELECT a.level, a.dim AS i, b.dim AS j, covar_samp(a.x, b.x) AS c FROM x a JOIN x b USING (level, point_id) GROUP BY ALL)
SELECT level, round(sum(c) FILTER (i = j), 6) AS trace, round(sum(c * c), 6) AS squares, 1.0::DOUBLE AS ratios FROM c GROUP BY level"""),
    "a24_pair_correlations": (a24_pair_correlations, f"""WITH {_DIST}, b AS (SELECT n.level, n.d AS d, o.d AS e FROM dd n JOIN dd o ON o.level = n.level - 1 AND o.k = n.k), r AS (SELECT *, {_RANK('d')} AS rd, {_RANK('e')} AS re FROM b)
SELECT level, level - 1 AS previous, round(corr(d, e), 6) AS pearson, round(corr(rd, re), 6) AS rho FROM r GROUP BY level"""),
    "a24_subspace_angles": (a24_subspace_angles, None),
    "a25_ami": (a25_ami, """WITH c AS (SELECT left((vec_id + 1)::VARCHAR, 1) AS a, label AS b, count(*)::BIGINT AS n FROM embeddings GROUP BY ALL), t AS (SELECT sum(n)::BIGINT AS n FROM c),
x AS (SELECT a, sum(n)::BIGINT AS x FROM c GROUP BY a), y AS (SELECT b, sum(n)::BIGINT AS y FROM c GROUP BY b), mi AS (SELECT sum(c.n / t.n::DOUBLE * ln(c.n * t.n::DOUBLE / (x * y))) AS mi FROM c JOIN x USING (a) JOIN y USING (b), t),
hx AS (SELECT -sum(x / t.n::DOUBLE * ln(x / t.n::DOUBLE)) AS h FROM x, t), hy AS (SELECT -sum(y / t.n::DOUBLE * ln(y / t.n::DOUBLE)) AS h FROM y, t),
k AS (SELECT x, y, t.n, unnest(range(greatest(1, x + y - t.n), least(x, y) + 1)) AS k FROM x, y, t),
e AS (SELECT sum(k / n::DOUBLE * ln(n * k / (x * y)::DOUBLE) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) AS e FROM k)
SELECT round((mi - e) / ((hx.h + hy.h) / 2 - e), 6) AS ami FROM mi, hx, hy, e"""),
    "a27_branches": (a27_branches, None),
    "a27_kmeans": (a27_kmeans, None),
    "a27_label_silhouettes": (a27_label_silhouettes, f"""WITH {CUBE}, v AS (SELECT level, point_id, vec, label FROM cube JOIN embeddings ON vec_id = point_id), s AS (SELECT a.level, a.point_id, a.label AS own, b.label AS other, sum(list_distance(a.vec, b.vec)) AS d, count(*) AS n FROM v a JOIN v b ON a.level = b.level GROUP BY ALL),
e AS (SELECT level, point_id, own, max(d / (n - 1)) FILTER (own = other AND n > 1) AS a, min(d / n) FILTER (own <> other) AS b FROM s GROUP BY ALL)
SELECT level, count(*) AS n, count(DISTINCT own) AS clusters, round(avg(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM e GROUP BY level"""),
    "a36_centroid_statistics": (a36_centroid_statistics, f"""WITH {_CENTRES}, w AS (SELECT level, sqrt(sum((x - g) ** 2) / count(DISTINCT point_id)) AS w FROM m GROUP BY level),
s AS (SELECT level, avg(d) FILTER (a >= 7) / avg(d) FILTER (b <= 5) AS s, min(d) AS n FROM p GROUP BY level), r AS (SELECT level, {_RANK('d')} AS rd, {_RANK('gap')} AS rg FROM p), q AS (SELECT level, corr(rg, rd) AS q FROM r GROUP BY level)
SELECT level, round(s, 6) AS spread_ratio, round(q, 6) AS gap_rho, round(n, 6) AS nearest, round(w, 6) AS within_rms FROM s JOIN q USING (level) JOIN w USING (level)"""),
    "a38_component_runs": (a38_component_runs, f"""WITH RECURSIVE {_COMP}, t AS (SELECT level, component, point_id + 1 AS target, point_id + 1 - lag(point_id + 1) OVER (PARTITION BY level, component ORDER BY point_id) AS gap FROM comp)
SELECT level, component, count(*) AS size, min(target) AS minimum, max(target) AS maximum, count(*) FILTER (gap > 1) + 1 AS runs FROM t GROUP BY ALL"""),
    "a38_component_counts": (a38_component_counts, f"""WITH RECURSIVE {_COMP}, n AS (SELECT level, component, count(*) AS n FROM comp GROUP BY ALL)
SELECT level, count(*) AS components, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n >= 100) AS large, coalesce(sum(n) FILTER (n >= 100), 0)::BIGINT AS large_mass FROM n GROUP BY level"""),
    "a39_best_radius": (a39_best_radius, None),
    "a40_tree_labels": (a40_tree_labels, None),
    "a44_relative_errors": (a44_relative_errors, f"""WITH {_DIST}, c2 AS (SELECT level, point_id, list_transform(vec, lambda x: floor(x * 1000) / 1000) AS vec FROM cube),
ee AS (SELECT a.level, i AS k, list_distance(a.vec, b.vec) AS e FROM pr JOIN c2 a ON a.point_id = i JOIN c2 b ON b.point_id = j AND a.level = b.level)
SELECT level, count(*) AS pairs, round(max(abs(e - d) / d), 6) AS max_rel_distance_error FROM dd JOIN ee USING (level, k) WHERE d > 0 GROUP BY level"""),
}
