"""Neighbour relations and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, graph, knn, metrics
from ..sources.tables import cube, points, table
from .base import CUBE, EDGES, KNN, LABELLED, POINTS, rounded


def j1_exact_knn(spark, d):
    return rounded(knn.exact_knn(cube(spark, d)))


def j1_exact_knn_sql(spark, d):
    return rounded(knn.exact_knn_sql(cube(spark, d)))


def j2_knn_by_group(spark, d):
    """Neighbours within each level's labels, as within a task and context."""
    c = cube(spark, d).join(points(spark, d).select("point_id", "label"), "point_id")
    return rounded(knn.exact_knn_by(c, ("level", "label")))


def j4_scalar_knn(spark, d):
    return knn.scalar_knn(points(spark, d))


def j4_scalar_knn_tied(spark, d):
    """By the label: a value of many points, whose neighbours are the least ids."""
    return knn.scalar_knn(points(spark, d), value="label", buckets=3)


def j5_distance_checks(spark, d):
    """Each level's pairs, a distance for either order: their number, sum and largest, and those that differ or are not 0 on the diagonal."""
    return rounded(knn.distance_checks(cube(spark, d)))


def j8_unknown_ids(spark, d):
    """Ids of the relations that a table of the points of some labels lacks."""
    return metrics.unknown_ids(knn.exact_knn(cube(spark, d)), points(spark, d).where("label < 9"))


def j9_left_defaults(spark, d):
    """Orders' priority by customer, `?` and 0 where a customer has none: the gallery's lookup."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("top"))
    c = table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", F.lit("?")).alias("top"))


def j11_centroid_ranking(spark, d):
    return rounded(metrics.centroid_ranking(metrics.centroids(cube(spark, d), points(spark, d).select("point_id", F.col("leading_digit").alias("label")))))


def j16_neighbour_overlap(spark, d):
    return rounded(knn.neighbour_overlap(knn.exact_knn(cube(spark, d))))


def j16_edge_changes(spark, d):
    return rounded(metrics.edge_changes(graph.union_graph(knn.exact_knn(cube(spark, d)))))


def j17_cross_edges(spark, d):
    return graph.cross_edges(graph.union_graph(knn.exact_knn(cube(spark, d))), points(spark, d), "leading_digit")[0]


def j17_communicators(spark, d):
    return graph.cross_edges(graph.union_graph(knn.exact_knn(cube(spark, d))), points(spark, d), "leading_digit")[1].select("level", "node", "degree", F.array_join(F.col("groups").cast("array<string>"), ",").alias("groups"))


def a1_graph_metrics(spark, d):
    return rounded(metrics.graph_metrics(knn.exact_knn(cube(spark, d)), points(spark, d)))


def a2_digit_transitions(spark, d):
    return rounded(metrics.digit_transitions(knn.exact_knn(cube(spark, d)), points(spark, d)))


def a5_digit_baseline(spark, d):
    return rounded(metrics.digit_baseline(points(spark, d)))


def a6_degeneration(spark, d):
    return rounded(metrics.degeneration(cube(spark, d)))


def _labels(spark, d):
    p = points(spark, d)
    return p.select("point_id", F.expr("stack(3, 'leading_digit', leading_digit, 'digit_count', digit_count, 'label', label) AS (name, label)"))


def a16_group_variance(spark, d):
    return rounded(metrics.group_variance(cube(spark, d), _labels(spark, d).where("name = 'label'")))


def a17_variance_by_label(spark, d):
    return rounded(metrics.group_variance(cube(spark, d), _labels(spark, d)))


def _variance(which: str) -> str:
    return f"""WITH {CUBE}, {POINTS}, l AS (SELECT point_id, 'leading_digit' AS name, leading_digit AS label FROM points UNION ALL SELECT point_id, 'digit_count', digit_count FROM points UNION ALL SELECT point_id, 'label', label FROM points),
x AS (SELECT level, name, label, unnest(range(16)) AS dim, unnest(vec) AS x FROM cube JOIN l USING (point_id) WHERE {which} AND label IS NOT NULL),
m AS (SELECT *, avg(x) OVER (PARTITION BY level, name, dim) AS mu, avg(x) OVER (PARTITION BY level, name, dim, label) AS g FROM x)
SELECT level, name, round(sum((g - mu) ** 2) / sum((x - mu) ** 2), 6) AS share FROM m GROUP BY ALL"""


def a41_equivalence(spark, d):
    """The cube against its copy of three places: the numeric report."""
    c = cube(spark, d)
    return rounded(compare.equivalence(c, c.withColumn("vec", F.transform("vec", lambda x: F.floor(x * 1000) / 1000))))


_six = lambda v, p: f"round(min({v}), 6) AS {p}_min, round(quantile_cont({v}, 0.25), 6) AS {p}_q25, round(quantile_cont({v}, 0.5), 6) AS {p}_median, round(quantile_cont({v}, 0.75), 6) AS {p}_q75, round(max({v}), 6) AS {p}_max, round(avg({v}), 6) AS {p}_mean"

QUERIES = {
    "a1_graph_metrics": (a1_graph_metrics, f"""WITH {LABELLED}, m AS (SELECT level, count(DISTINCT src) AS point_count, count(*) AS relations, round(avg((sd = dd)::INT), 6) AS same_leading_digit,
count(*) FILTER (sn <> dn) AS cross_length_count, round(avg((sn <> dn)::INT), 6) AS cross_length, round(count(*) FILTER (sn <> dn AND sd = dd) / nullif(count(*) FILTER (sn <> dn), 0), 6) AS same_given_cross,
{_six('abs(st - dt)::DOUBLE', 'gap')}, round(avg(abs(log10(st) - log10(dt))), 6) AS log_gap_mean, {_six('dist', 'dist')} FROM rel GROUP BY level),
e AS (SELECT level, least(src, dst) AS a, greatest(src, dst) AS b, bool_or(src < dst) AND bool_or(src > dst) AS mutual FROM knn GROUP BY ALL),
u AS (SELECT level, count(*) AS union_edges, count(*) FILTER (mutual) AS mutual_edges FROM e GROUP BY level)
SELECT m.*, union_edges, mutual_edges, round(2 * mutual_edges / (point_count * 4), 6) AS mutual_fraction FROM m JOIN u USING (level)"""),
    "a2_digit_transitions": (a2_digit_transitions, f"""WITH {LABELLED}, g AS (SELECT l::INT AS level, s::INT AS source_digit, t::INT AS target_digit FROM range(4) a(l), range(1, 10) b(s), range(1, 10) c(t)),
n AS (SELECT level, sd AS source_digit, dd AS target_digit, count(*) AS n FROM rel GROUP BY ALL)
SELECT level, source_digit, target_digit, coalesce(n, 0) AS n, round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY level, source_digit), 0)::DOUBLE, 6) AS share FROM g LEFT JOIN n USING (level, source_digit, target_digit)"""),
    "a5_digit_baseline": (a5_digit_baseline, f"""WITH {POINTS}, t AS (SELECT count(*) AS total FROM points), b AS (SELECT leading_digit, count(*) AS n, (count(*) - 1) / (any_value(total) - 1) AS chance FROM points, t GROUP BY leading_digit)
SELECT leading_digit, n, round(chance, 6) AS chance FROM b UNION ALL SELECT 0, sum(n)::BIGINT, round(sum(n * chance) / sum(n), 6) FROM b"""),
    "a6_degeneration": (a6_degeneration, f"""WITH {CUBE}, x AS (SELECT level, unnest(range(16)) AS dim, unnest(vec) AS x FROM cube), p AS (SELECT level, dim, count(*) AS n, sum(x * x) AS ss, var_pop(x) * count(*) AS cs FROM x GROUP BY ALL),
s AS (SELECT level, sqrt(sum(ss) / max(n)) AS a, sqrt(sum(cs) / max(n)) AS b FROM p GROUP BY level) SELECT level, round(a, 6) AS rms_norm, round(b, 6) AS rms_centred, b <= 1e-7 * greatest(1.0, a) AS degenerate FROM s"""),
    "a16_group_variance": (a16_group_variance, _variance("name = 'label'")),
    "a17_variance_by_label": (a17_variance_by_label, _variance("true")),
    "a41_equivalence": (a41_equivalence, f"""WITH {CUBE}, o AS (SELECT level, vec AS x, list_transform(vec, lambda v: floor(v * 1000) / 1000) AS y FROM cube),
s AS (SELECT level, list_max(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))) AS m, list_distance(x, y) ** 2 AS dd, list_inner_product(x, x) AS xx, list_inner_product(y, y) AS yy, list_inner_product(x, y) AS xy FROM o)
SELECT level, count(*) AS n, round(max(m), 6) AS max_abs, round(sqrt(sum(dd)) / sqrt(sum(xx)), 6) AS rel_l2, round(max(1 - xy / sqrt(xx * yy)), 6) AS cosine_error FROM s GROUP BY level"""),
    "j1_exact_knn": (j1_exact_knn, f"WITH {KNN} SELECT level, src, rank, dst, round(dist, 6) AS dist FROM knn"),
    "j1_exact_knn_sql": (j1_exact_knn_sql, f"WITH {KNN} SELECT level, src, rank, dst, round(dist, 6) AS dist FROM knn"),
    "j2_knn_by_group": (j2_knn_by_group, f"""WITH {CUBE}, g AS (SELECT level, label, point_id, vec FROM cube JOIN embeddings ON vec_id = point_id),
p AS (SELECT a.level, a.label, a.point_id AS src, b.point_id AS dst, list_distance(a.vec, b.vec) AS dist FROM g a JOIN g b ON a.level = b.level AND a.label = b.label AND a.point_id <> b.point_id)
SELECT level, label, src, (row_number() OVER w)::INT AS rank, dst, round(dist, 6) AS dist FROM p WINDOW w AS (PARTITION BY level, label, src ORDER BY dist, dst) QUALIFY row_number() OVER w <= 4"""),
    "j4_scalar_knn": (j4_scalar_knn, f"WITH {POINTS}, p AS (SELECT a.point_id AS src, b.point_id AS dst, abs(a.target - b.target)::DOUBLE AS dist FROM points a JOIN points b ON a.point_id <> b.point_id) SELECT src, (row_number() OVER w)::INT AS rank, dst, dist FROM p WINDOW w AS (PARTITION BY src ORDER BY dist, dst) QUALIFY row_number() OVER w <= 4"),
    "j4_scalar_knn_tied": (j4_scalar_knn_tied, f"WITH {POINTS}, p AS (SELECT a.point_id AS src, b.point_id AS dst, abs(a.label - b.label)::DOUBLE AS dist FROM points a JOIN points b ON a.point_id <> b.point_id) SELECT src, (row_number() OVER w)::INT AS rank, dst, dist FROM p WINDOW w AS (PARTITION BY src ORDER BY dist, dst) QUALIFY row_number() OVER w <= 4"),
    "j5_distance_checks": (j5_distance_checks, f"WITH {CUBE}, p AS (SELECT a.level, a.point_id AS i, b.point_id AS j, list_distance(a.vec, b.vec) AS d, list_distance(b.vec, a.vec) AS e FROM cube a JOIN cube b ON a.level = b.level) SELECT level, count(*) AS pairs, round(sum(d), 6) AS total, round(max(d), 6) AS largest, count(*) FILTER (d <> e) AS asymmetric, count(*) FILTER (i = j AND d <> 0) AS diagonal FROM p GROUP BY level"),
    "j8_unknown_ids": (j8_unknown_ids, f"WITH {KNN} SELECT DISTINCT src AS point_id FROM knn JOIN embeddings ON vec_id = src WHERE NOT label < 9"),
    "j9_left_defaults": (j9_left_defaults, "SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_orderpriority), '?') AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "j11_centroid_ranking": (j11_centroid_ranking, f"""WITH {CUBE}, {POINTS}, x AS (SELECT level, leading_digit AS label, unnest(range(16)) AS dim, unnest(vec) AS x FROM cube JOIN points USING (point_id)),
c AS (SELECT level, label, list(m ORDER BY dim) AS v FROM (SELECT level, label, dim, avg(x) AS m FROM x GROUP BY ALL) GROUP BY ALL), p AS (SELECT a.level, a.label, b.label AS other, list_distance(a.v, b.v) AS dist FROM c a JOIN c b ON a.level = b.level AND a.label <> b.label)
SELECT level, label, (row_number() OVER w)::INT AS rank, other, round(dist, 6) AS dist FROM p WINDOW w AS (PARTITION BY level, label ORDER BY dist, other) QUALIFY row_number() OVER w <= 4"""),
    "j16_neighbour_overlap": (j16_neighbour_overlap, f"WITH {KNN} SELECT n.level, n.level - 1 AS previous, round(count(o.src) / count(DISTINCT n.src) / 4, 6) AS overlap FROM knn n LEFT JOIN knn o ON o.level = n.level - 1 AND o.src = n.src AND o.dst = n.dst WHERE n.level > 0 GROUP BY n.level"),
    "j16_edge_changes": (j16_edge_changes, f"""WITH {EDGES}, o AS (SELECT level + 1 AS level, a, b FROM edges),
k AS (SELECT level, count(*) FILTER (new AND old) AS kept, count(*) FILTER (new AND NOT old) AS gained, count(*) FILTER (old AND NOT new) AS lost FROM (SELECT coalesce(e.level, o.level) AS level, e.level IS NOT NULL AS new, o.level IS NOT NULL AS old FROM edges e FULL JOIN o ON e.level = o.level AND e.a = o.a AND e.b = o.b) WHERE level BETWEEN 1 AND 3 GROUP BY level)
SELECT *, round(kept / (kept + gained + lost), 6) AS jaccard FROM k"""),
    "j17_cross_edges": (j17_cross_edges, f"WITH {EDGES}, {POINTS} SELECT level, a, b, p.leading_digit AS ga, q.leading_digit AS gb FROM edges JOIN points p ON p.point_id = a JOIN points q ON q.point_id = b WHERE p.leading_digit <> q.leading_digit"),
    "j17_communicators": (j17_communicators, f"""WITH {EDGES}, {POINTS}, c AS (SELECT level, a, b, p.leading_digit AS ga, q.leading_digit AS gb FROM edges JOIN points p ON p.point_id = a JOIN points q ON q.point_id = b WHERE p.leading_digit <> q.leading_digit),
e AS (SELECT level, a AS node, gb AS t FROM c UNION ALL SELECT level, b, ga FROM c) SELECT level, node, count(*) AS degree, array_to_string(list_sort(list_distinct(list(t))), ',') AS groups FROM e GROUP BY ALL"""),
}
