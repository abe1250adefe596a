"""Graph queries: union graphs, components, trees, cliques, zigzag runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import adjusted_rand, contingency, purity
from ..operators import audit, graph, homology, knn, metrics, project, rips, topology, trees
from ..sources.tables import LEVELS, cube, points, table
from ..staging import staged
from .base import EDGES, POINTS, rounded

#: The largest dimension of cliques in zigzags.
TOP = 4


def _edges(spark, d):
    return graph.union_graph(knn.exact_knn(cube(spark, d)))


def _nodes(spark, d):
    return cube(spark, d).select("level", "point_id")


def r1_union_graph(spark, d):
    return _edges(spark, d)


def r2_degrees(spark, d):
    k = knn.exact_knn(cube(spark, d))
    return graph.degrees(points(spark, d), k, graph.union_graph(k))


def r3_components(spark, d):
    """Partition sizes and the largest share, by level."""
    c = graph.components(_nodes(spark, d), _edges(spark, d))
    by = c.groupBy("level", "component").agg(F.count("*").alias("n"))
    return rounded(by.groupBy("level").agg(F.count("*").alias("components"), (F.max("n") / F.sum("n")).alias("largest"), F.sum("component").alias("least_ids")))


def r3_component_labels(spark, d):
    return graph.components(_nodes(spark, d), _edges(spark, d))


def r4_strong_components(spark, d):
    """Within each label's induced subgraph of every level: groups are small."""
    k = knn.exact_knn(cube(spark, d))
    p = points(spark, d).select("point_id", "label")
    e = k.join(p.select(F.col("point_id").alias("src"), F.col("label").alias("g")), "src").join(p.select(F.col("point_id").alias("dst"), F.col("label").alias("h")), "dst").where("g = h")
    return graph.strong_components(e.select("level", F.col("g").cast("int").alias("label"), "src", "dst"), "level", "label")


def r5_mst(spark, d):
    """A tree's shape: edges, the sum and the extremes of its lengths (all unique, whatever ties)."""
    t = graph.minimum_spanning_trees(cube(spark, d))
    return rounded(t.groupBy("level").agg(F.count("*").alias("edges"), F.sum("length").alias("total"), F.min("length").alias("least"), F.max("length").alias("most")))


def r5_h0_intervals(spark, d):
    t = graph.minimum_spanning_trees(cube(spark, d))
    return rounded(topology.diagram_summary(graph.h0_intervals(t, cube(spark, d).groupBy("level").count()), "level").select("level", "bars", "censored", "positive", "max_life", "mean_life"))


def r6_threshold_partition(spark, d):
    """Trees cut at the median distance of nearest neighbours: the same parts as all pairs that near give."""
    t = graph.minimum_spanning_trees(cube(spark, d))
    cut = knn.exact_knn(cube(spark, d), 1).agg(F.median("dist")).first()[0]
    c = graph.threshold_partition(_nodes(spark, d), t, cut)
    return c.groupBy("level", "component").agg(F.count("*").alias("n")).groupBy("level").agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))


def r7_merge_curve(spark, d):
    return rounded(trees.merge_curve(graph.minimum_spanning_trees(cube(spark, d)), points(spark, d).select("point_id", F.col("leading_digit").alias("label"))))


def r8_cliques(spark, d):
    s = graph.simplices(_nodes(spark, d), _edges(spark, d), 4)
    return s.groupBy("level", "dim").agg(F.count("*").alias("n"))


def r8_triangles(spark, d):
    return graph.cliques(_edges(spark, d), 3)


def r9_intersections(spark, d):
    s = graph.simplices(_nodes(spark, d), _edges(spark, d), 2)
    return graph.level_intersections(s).groupBy("level", "dim").agg(F.count("*").alias("n"))


def r10_runs(spark, d):
    s = graph.simplices(_nodes(spark, d), _edges(spark, d), 1)
    return graph.zigzag_times(s).groupBy("dim", "start", "stop").agg(F.count("*").alias("n"))


def r10_ranges(spark, d):
    """Runs of consecutive order numbers by priority: gaps and islands over a whole table."""
    return graph.contiguous_ranges(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey")


def _component_runs(nodes, e):
    """(run, simplex, start, stop): the union graphs' zigzag, a run for each component of all levels' edges together, which no simplex crosses."""
    joint = graph.components(nodes.select(F.lit(0).alias("level"), "point_id").distinct(), e.select(F.lit(0).alias("level"), "a", "b").distinct())
    t = graph.zigzag_times(graph.simplices(nodes, e, TOP)).withColumn("point_id", F.col("simplex")[0])
    return t.join(joint.select("point_id", F.col("component").alias("run")), "point_id").select("run", "simplex", (F.col("start") - 1).alias("start"), (F.col("stop") - 1).alias("stop"))


def _zigzag(spark, d):
    return homology.zigzag_intervals(_component_runs(_nodes(spark, d), staged(_edges(spark, d), "zigzag-edges")), LEVELS)


def r11_zigzag(spark, d):
    """Zigzag intervals of the union graphs' complexes, one run for each connected component of all levels' edges together.  Of cliques up to dimension
    4, so classes of dimensions 0 to 3: those of dimension 4 might be filled by cliques that aren't there."""
    return topology.effective_levels(_zigzag(spark, d)).where(F.col("dim") < TOP)


def r11_euler(spark, d):
    """The classes alive at each level, added up with signs by dimension: the complex's Euler characteristic, which its cliques give too."""
    bars = _zigzag(spark, d).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    alive = bars.where((F.col("raw_birth") <= 2 * F.col("level")) & (F.col("raw_death") > 2 * F.col("level")))
    return alive.groupBy("level").agg(F.sum(F.when(F.pmod("dim", F.lit(2)) == 0, 1).otherwise(-1)).alias("euler"))


def o19_tree_checks(spark, d):
    """Stored spanning trees checked against the vectors: number of edges, one part, lengths, and no pair nearer than its path's longest edge."""
    c = cube(spark, d)
    return trees.tree_checks(c, staged(graph.minimum_spanning_trees(c), "stored-trees"))


def a1_whole_row(spark, d):
    """All of a level's row: relations, lengths, both kinds of gaps, components, overlap with its count and denominator, digits."""
    return rounded(metrics.whole_row(knn.exact_knn(cube(spark, d)), points(spark, d)))


def r12_induced_edges(spark, d):
    p = points(spark, d).select("point_id", "label")
    e = _edges(spark, d).join(p.select(F.col("point_id").alias("a"), F.col("label").alias("ga")), "a").join(p.select(F.col("point_id").alias("b"), F.col("label").alias("gb")), "b")
    return e.groupBy("level", F.least("ga", "gb").alias("g1"), F.greatest("ga", "gb").alias("g2")).agg(F.count("*").alias("n"))


def t4_rips_h1(spark, d):
    """First homology of each level's labels, a cloud each: together they hold every point."""
    c = cube(spark, d).join(points(spark, d).select("point_id", "label"), "point_id")
    return rounded(rips.h1_intervals(c, keys=("level", "label")))


def t4_level_h1(spark, d):
    """First homology of whole levels."""
    return rounded(rips.h1_intervals(cube(spark, d)))


def t7_censored_h1(spark, d):
    """First homology up to each label's median neighbour distance, over all levels' labels: classes alive there never die."""
    c = cube(spark, d).join(points(spark, d).select("point_id", "label"), "point_id")
    cut = knn.exact_knn(cube(spark, d), 1).agg(F.median("dist")).first()[0]
    return rounded(rips.h1_intervals(c, threshold=cut * 1.25, keys=("level", "label")).groupBy("level", "label").agg(F.count("*").alias("bars"), F.count_if(F.col("death") == float("inf")).alias("censored"), F.max("birth").alias("last_birth")))


def _persistence(spark, d):
    c = cube(spark, d)
    return topology.persistence(c.select("level").distinct(), staged(graph.minimum_spanning_trees(c), "persistence-trees"), staged(rips.h1_intervals(c), "persistence-h1"))


def t24_layer_features(spark, d):
    """Everything that a level is described by: diagrams in units of its median distance, neighbours and projections."""
    c, p = cube(spark, d), points(spark, d)
    model = project.pca(c, 2)
    rho = project.oriented(project.scores(c, model), p)[1]
    pick = lambda f, v, n: f.groupBy("level").agg(*[F.max(F.when(F.col("component") == i, F.col(v))).alias(f"{n}_pc{i}") for i in (1, 2)])
    axes = pick(rho, "rho", "rho").join(pick(model, "ratio", "ev"), "level")
    row = staged(metrics.whole_row(knn.exact_knn(c), p), "layer-rows")
    return rounded(topology.layer_features(staged(graph.minimum_spanning_trees(c), "layer-trees"), staged(rips.h1_intervals(c), "layer-h1"), staged(knn.pair_median(c), "layer-scales"), row, staged(axes, "layer-axes")))


def o8_audit(spark, d):
    """The stored relation, components and transitions of every level, audited against its vectors."""
    c, p = cube(spark, d), points(spark, d)
    k = knn.exact_knn(c)
    return audit.relation_audit(c, k, staged(project.pca(c, 4), "audit-model"), metrics.digit_transitions(k, p))


def a41_order_report(spark, d):
    """Whether the cube's copy of three places keeps each point's neighbours, and for which points that is certain beforehand."""
    c = cube(spark, d)
    return rounded(audit.order_report(c, c.withColumn("vec", F.transform("vec", lambda x: F.floor(x * 1000) / 1000))))


def t8_persistence(spark, d):
    """H0 without its bars of no length, and H1, on each level's one grid of 301 radii: how many classes are alive at each."""
    return rounded(_persistence(spark, d))


def t25_quotient(spark, d):
    """Distinct vectors and how many points share them: the quotient taken before homology."""
    return cube(spark, d).groupBy("level", "vec").agg(F.count("*").alias("n")).groupBy("level").agg(F.count("*").alias("distinct_vectors"), F.sum("n").alias("points"), F.max("n").alias("most"))


def a25_contingency(spark, d):
    return contingency(points(spark, d), "leading_digit", "label")


def a25_purity(spark, d):
    return rounded(purity(contingency(points(spark, d), "leading_digit", "label")))


def a26_ari(spark, d):
    return rounded(adjusted_rand(contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")))


_COMP = EDGES + """, m AS (SELECT level, a AS x, b AS y FROM edges UNION ALL SELECT level, b, a FROM edges),
reach(level, node, c) AS (SELECT level, point_id, point_id FROM cube UNION SELECT m.level, m.y, r.c FROM reach r JOIN m ON m.level = r.level AND m.x = r.node AND r.c < m.y),
comp AS (SELECT level, node AS point_id, min(c) AS component FROM reach GROUP BY ALL)"""
_CL = EDGES + """, e AS (SELECT level, a, b FROM edges), c3 AS (SELECT x.level, x.a, x.b, y.b AS c FROM e x JOIN e y ON x.level = y.level AND x.b = y.a JOIN e z ON z.level = x.level AND z.a = x.a AND z.b = y.b),
c4 AS (SELECT t.*, e.b AS d FROM c3 t JOIN e ON e.level = t.level AND e.a = t.c SEMI JOIN e e1 ON e1.level = t.level AND e1.a = t.a AND e1.b = e.b SEMI JOIN e e2 ON e2.level = t.level AND e2.a = t.b AND e2.b = e.b),
c5 AS (SELECT t.*, e.b AS f FROM c4 t JOIN e ON e.level = t.level AND e.a = t.d SEMI JOIN e e1 ON e1.level = t.level AND e1.a = t.a AND e1.b = e.b SEMI JOIN e e2 ON e2.level = t.level AND e2.a = t.b AND e2.b = e.b SEMI JOIN e e3 ON e3.level = t.level AND e3.a = t.c AND e3.b = e.b)"""
_TIMES = EDGES + """, s AS (SELECT level, 0 AS dim, [point_id] AS x FROM cube UNION ALL SELECT level, 1, [a, b] FROM edges),
t AS (SELECT dim, x, 2 * level AS t FROM s UNION ALL SELECT p.dim, p.x, 2 * p.level + 1 FROM s p JOIN s q ON q.level = p.level + 1 AND q.x = p.x AND q.dim = p.dim),
g AS (SELECT dim, x, t, t - row_number() OVER (PARTITION BY dim, x ORDER BY t) AS g FROM t), runs AS (SELECT dim, x, (min(t) + 1)::INT AS start, (max(t) + 2)::INT AS stop FROM g GROUP BY dim, x, g)"""

_six = lambda v, p: f"round(min({v}), 6) AS {p}_min, round(quantile_cont({v}, 0.25), 6) AS {p}_q25, round(quantile_cont({v}, 0.5), 6) AS {p}_median, round(quantile_cont({v}, 0.75), 6) AS {p}_q75, round(max({v}), 6) AS {p}_max, round(avg({v}), 6) AS {p}_mean"

QUERIES = {
    "r1_union_graph": (r1_union_graph, f"WITH {EDGES} SELECT * FROM edges"),
    "r2_degrees": (r2_degrees, f"""WITH {EDGES}, i AS (SELECT level, dst AS point_id, count(*) AS in_degree FROM knn GROUP BY ALL), u AS (SELECT level, p AS point_id, count(*) AS union_degree FROM (SELECT level, a AS p FROM edges UNION ALL SELECT level, b FROM edges) GROUP BY ALL)
SELECT level, point_id, coalesce(in_degree, 0) AS in_degree, coalesce(union_degree, 0) AS union_degree FROM cube LEFT JOIN i USING (level, point_id) LEFT JOIN u USING (level, point_id)"""),
    "r3_components": (r3_components, f"WITH RECURSIVE {_COMP}, n AS (SELECT level, component, count(*) AS n FROM comp GROUP BY ALL) SELECT level, count(*) AS components, round(max(n) / sum(n), 6) AS largest, sum(component)::BIGINT AS least_ids FROM n GROUP BY level"),
    "r3_component_labels": (r3_component_labels, f"WITH RECURSIVE {_COMP} SELECT * FROM comp"),
    "r4_strong_components": (r4_strong_components, f"""WITH RECURSIVE {EDGES}, e AS (SELECT k.level, p.label, k.src AS s, k.dst AS d FROM knn k JOIN embeddings p ON p.vec_id = k.src JOIN embeddings q ON q.vec_id = k.dst WHERE p.label = q.label),
n AS (SELECT level, label, s AS v FROM e UNION SELECT level, label, d FROM e),
reach(level, label, a, b) AS (SELECT level, label, v, v FROM n UNION SELECT r.level, r.label, r.a, e.d FROM reach r JOIN e ON e.level = r.level AND e.label = r.label AND e.s = r.b)
SELECT x.level, x.label, x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.level = x.level AND y.label = x.label AND y.a = x.b AND y.b = x.a GROUP BY ALL"""),
    "r5_mst": (r5_mst, None),
    "r5_h0_intervals": (r5_h0_intervals, None),
    "r6_threshold_partition": (r6_threshold_partition, f"""WITH RECURSIVE {EDGES}, c AS (SELECT median(dist) AS r FROM knn WHERE rank = 1), m AS (SELECT level, src AS x, dst AS y FROM pairs, c WHERE dist <= r),
reach(level, node, c) AS (SELECT level, point_id, point_id FROM cube UNION SELECT m.level, m.y, r.c FROM reach r JOIN m ON m.level = r.level AND m.x = r.node AND r.c < m.y),
n AS (SELECT level, component, count(*) AS n FROM (SELECT level, node, min(c) AS component FROM reach GROUP BY ALL) GROUP BY ALL)
SELECT level, count(*) AS components, max(n) AS largest, count(*) FILTER (n = 1) AS singletons FROM n GROUP BY level"""),
    "r7_merge_curve": (r7_merge_curve, None),
    "r8_cliques": (r8_cliques, f"WITH {_CL} SELECT level, 0 AS dim, count(*) AS n FROM cube GROUP BY level UNION ALL SELECT level, 1, count(*) FROM e GROUP BY level UNION ALL SELECT level, 2, count(*) FROM c3 GROUP BY level UNION ALL SELECT level, 3, count(*) FROM c4 GROUP BY level UNION ALL SELECT level, 4, count(*) FROM c5 GROUP BY level"),
    "r8_triangles": (r8_triangles, f"WITH {_CL} SELECT level, a AS v1, b AS v2, c AS v3 FROM c3"),
    "r9_intersections": (r9_intersections, f"WITH {_CL}, s AS (SELECT level, 0 AS dim, [point_id] AS x FROM cube UNION ALL SELECT level, 1, [a, b] FROM e UNION ALL SELECT level, 2, [a, b, c] FROM c3) SELECT p.level, p.dim, count(*) AS n FROM s p JOIN s q ON q.level = p.level + 1 AND q.dim = p.dim AND q.x = p.x GROUP BY ALL"),
    "r10_runs": (r10_runs, f"WITH {_TIMES} SELECT dim, start, stop, count(*) AS n FROM runs GROUP BY ALL"),
    "r10_ranges": (r10_ranges, "WITH g AS (SELECT o_orderpriority, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS g FROM orders) SELECT o_orderpriority, min(o_orderkey) + 1 AS start, max(o_orderkey) + 2 AS stop FROM g GROUP BY o_orderpriority, g"),
    "r11_zigzag": (r11_zigzag, None),
    "r11_euler": (r11_euler, f"WITH {_CL}, n AS (SELECT level, count(*) AS n FROM cube GROUP BY level UNION ALL SELECT level, -count(*) FROM e GROUP BY level UNION ALL SELECT level, count(*) FROM c3 GROUP BY level UNION ALL SELECT level, -count(*) FROM c4 GROUP BY level UNION ALL SELECT level, count(*) FROM c5 GROUP BY level) SELECT level, sum(n)::BIGINT AS euler FROM n GROUP BY level"),
    "o19_tree_checks": (o19_tree_checks, "SELECT l::INT AS level, c AS \"check\", 0::BIGINT AS wrong FROM range(4) t(l), (VALUES ('edges'), ('parts'), ('lengths'), ('cycles')) v(c) WHERE (SELECT count(*) FROM embeddings) > 1"),
    "a1_whole_row": (a1_whole_row, f"""WITH RECURSIVE {_COMP}, {POINTS}, rel AS (SELECT k.*, s.target AS st, s.leading_digit AS sd, s.digit_count AS sn, d.target AS dt, d.leading_digit AS dd, d.digit_count AS dn FROM knn k JOIN points s ON s.point_id = k.src JOIN points d ON d.point_id = k.dst),
mm AS MATERIALIZED (SELECT level, count(DISTINCT src) AS point_count, count(*) AS relations, round(avg((sd = dd)::INT), 6) AS same_leading_digit, round(avg((sn = dn)::INT), 6) AS same_digit_length, count(*) FILTER (sn <> dn) AS cross_length_count, round(avg((sn <> dn)::INT), 6) AS cross_length,
count(*) FILTER (sn <> dn AND sd = dd) AS same_cross_count, round(count(*) FILTER (sn <> dn AND sd = dd) / nullif(count(*) FILTER (sn <> dn), 0), 6) AS same_given_cross, {_six("abs(st - dt)::DOUBLE", "gap")}, {_six("abs(log10(st) - log10(dt))", "log_gap")}, {_six("dist", "dist")},
{", ".join(f"round(avg((sd = dd)::INT) FILTER (sd = {i}), 6) AS same_{i}" for i in range(1, 10))} FROM rel GROUP BY level),
u AS (SELECT level, count(*) AS union_edges, count(*) FILTER (mutual) AS mutual_edges FROM edges GROUP BY level),
q AS (SELECT level, component, count(*) AS n FROM comp GROUP BY ALL), c AS (SELECT level, count(*) AS components, round(max(n) / sum(n), 6) AS largest_share FROM q GROUP BY level),
o AS (SELECT n.level, count(o.src) AS overlap_count, count(*) AS overlap_denominator, round(count(o.src) / count(*), 6) AS overlap FROM knn n LEFT JOIN knn o ON o.level = n.level - 1 AND o.src = n.src AND o.dst = n.dst WHERE n.level > 0 GROUP BY n.level)
SELECT mm.*, union_edges, mutual_edges, round(2 * mutual_edges / relations, 6) AS mutual_fraction, components, largest_share, overlap_count, overlap_denominator, overlap FROM mm JOIN u USING (level) JOIN c USING (level) LEFT JOIN o USING (level)"""),
    "r12_induced_edges": (r12_induced_edges, f"WITH {EDGES} SELECT level, least(p.label, q.label) AS g1, greatest(p.label, q.label) AS g2, count(*) AS n FROM edges JOIN embeddings p ON p.vec_id = a JOIN embeddings q ON q.vec_id = b GROUP BY ALL"),
    "t4_rips_h1": (t4_rips_h1, None),
    "t4_level_h1": (t4_level_h1, None),
    "t7_censored_h1": (t7_censored_h1, None),
    "t8_persistence": (t8_persistence, None),
    "t24_layer_features": (t24_layer_features, None),
    "o8_audit": (o8_audit, "SELECT l::INT AS level, c AS \"check\", 0::BIGINT AS wrong FROM range(4) t(l), (VALUES ('ranks'), ('self'), ('order'), ('lengths'), ('sample'), ('basis'), ('ratios'), ('totals')) v(c) WHERE (SELECT count(*) FROM embeddings) > 0"),
    "a41_order_report": (a41_order_report, """WITH v AS (SELECT l::INT AS level, vec_id AS i, list_transform(embedding[16 * l + 1 : 16 * l + 16], lambda x: x::DOUBLE) AS x FROM embeddings, range(4) t(l)),
w AS (SELECT level, i, x, list_transform(x, lambda c: floor(c * 1000) / 1000) AS y FROM v), m AS (SELECT level, max(list_distance(x, y)) AS m FROM w GROUP BY level),
p AS (SELECT a.level, a.i AS src, b.i AS dst, list_distance(a.x, b.x) AS d, list_distance(a.y, b.y) AS e FROM w a JOIN w b ON a.level = b.level AND a.i <> b.i),
r AS (SELECT *, row_number() OVER (PARTITION BY level, src ORDER BY d, dst) AS rd, row_number() OVER (PARTITION BY level, src ORDER BY e, dst) AS re FROM p),
s AS (SELECT level, src, list(dst ORDER BY rd) FILTER (rd <= 4) AS a, list(dst ORDER BY re) FILTER (re <= 4) AS b, list(d ORDER BY rd) FILTER (rd <= 5) AS ds FROM r WHERE rd <= 5 OR re <= 5 GROUP BY level, src),
g AS (SELECT level, a = b AS o, list_sort(a) = list_sort(b) AS t, list_min(list_transform(range(1, len(ds)), lambda k: ds[k + 1] - ds[k])) AS gap, ds[5] - ds[4] AS margin FROM s)
SELECT level, count(*) AS n, count(*) FILTER (o) AS same_order, count(*) FILTER (t) AS same_set, count(*) FILTER (gap > 4 * m) AS certain, count(*) FILTER (gap > 4 * m AND NOT o) AS broken, count(*) FILTER (NOT gap > 4 * m) AS near_ties, round(min(margin), 6) AS least_margin FROM g JOIN m USING (level) GROUP BY level"""),
    "t25_quotient": (t25_quotient, "WITH x AS (SELECT l::INT AS level, embedding[16 * l + 1 : 16 * l + 16] AS v, count(*) AS n FROM embeddings, range(4) t(l) GROUP BY ALL) SELECT level, count(*) AS distinct_vectors, sum(n)::BIGINT AS points, max(n) AS most FROM x GROUP BY level"),
    "a25_contingency": (a25_contingency, "SELECT left((vec_id + 1)::VARCHAR, 1)::INT AS a, label AS b, count(*) AS n FROM embeddings GROUP BY ALL"),
    "a25_purity": (a25_purity, "WITH c AS (SELECT left((vec_id + 1)::VARCHAR, 1) AS a, label AS b, count(*) AS n FROM embeddings GROUP BY ALL), m AS (SELECT a, max(n) AS m, sum(n) AS n FROM c GROUP BY a) SELECT round(sum(m) / sum(n), 6) AS purity FROM m"),
    "a26_ari": (a26_ari, """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c),
x AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS q FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((s - p * q / (n * (n - 1) / 2)) / ((p + q) / 2 - p * q / (n * (n - 1) / 2)), 6) AS ari FROM t, x, y"""),
}
