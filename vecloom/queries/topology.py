"""Interval analytics over the whole line item table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import topology
from ..sources.tables import cube, intervals, points, table
from .base import CUBE, INTERVALS, rounded


def _layers(spark, d):
    """Layer intervals of the line items: birth by line number, life by quantity."""
    li = table(spark, d, "lineitem")
    return topology.effective_levels(li.select((F.col("l_linenumber") * 2 - 2 + F.pmod("l_partkey", F.lit(2))).cast("long").alias("raw_birth"), (F.col("l_linenumber") * 2 - 2 + F.pmod("l_partkey", F.lit(2)) + F.floor(F.col("l_quantity") / 5)).cast("long").alias("raw_death")))


_LAYERS = """ly AS (SELECT l_linenumber * 2 - 2 + l_partkey % 2 AS raw_birth, l_linenumber * 2 - 2 + l_partkey % 2 + floor(l_quantity / 5)::BIGINT AS raw_death FROM lineitem),
ef AS (SELECT raw_birth, raw_death, raw_birth // 2 AS birth_layer, raw_death // 2 AS death_layer, raw_death // 2 - raw_birth // 2 AS lifetime_layers FROM ly)"""
LEVELS = 9


def t1_normalisation(spark, d):
    n = points(spark, d).agg(F.count("*").alias("n"))
    pairs = points(spark, d).crossJoin(F.broadcast(n)).select(F.col("point_id").alias("i"), F.pmod(F.col("point_id") * 7 + 1, F.col("n")).alias("j")).where("i <> j")
    return rounded(topology.normalisation(cube(spark, d), pairs))


def t6_summary(spark, d):
    return rounded(topology.diagram_summary(intervals(spark, d), "diagram"))


def t24_feature_vector(spark, d):
    return rounded(topology.feature_vector(intervals(spark, d), "diagram"))


def t9_betti_grid(spark, d):
    i = intervals(spark, d)
    return topology.betti_grid(i, topology.uniform_grid(i, 31, 1.0, "diagram").withColumn("t", F.round("t", 6)), "diagram")


def t10_betti_steps(spark, d):
    return topology.betti_steps(intervals(spark, d), "diagram")


def t11_layer_betti(spark, d):
    return topology.layer_betti(_layers(spark, d), LEVELS)


def t12_effective_levels(spark, d):
    return _layers(spark, d).groupBy("raw_birth", "raw_death", "birth_layer", "death_layer", "lifetime_layers").agg(F.count("*").alias("n"))


def t13_persistence_matrix(spark, d):
    return topology.persistence_matrix(_layers(spark, d), LEVELS)


def t14_interlayer(spark, d):
    return rounded(topology.interlayer_persistence(_layers(spark, d), LEVELS))


def t15_interval_counts(spark, d):
    i = _layers(spark, d)
    return rounded(i.agg(F.count("*").alias("features"), F.count_if(F.col("lifetime_layers") > 0).alias("positive"), F.avg("lifetime_layers").alias("mean_lifetime")))


def t16_global_k(spark, d):
    li = table(spark, d, "lineitem")
    return topology.choose_global_k(li.groupBy(F.col("l_linenumber").alias("k"), "l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("n")))


def t17_top_bars(spark, d):
    return rounded(topology.top_bars(intervals(spark, d), 10, "diagram")[0])


def t17_sketch_error(spark, d):
    return rounded(topology.top_bars(intervals(spark, d), 10, "diagram")[1])


def t20_betti_l1(spark, d):
    return rounded(topology.betti_l1(intervals(spark, d)))


def t21_sorted_l1(spark, d):
    return rounded(topology.sorted_death_l1(intervals(spark, d), scale=10_000.0))


def _grid(spark):
    return spark.range(0, 23).select((F.col("id") + 0.25).alias("t"))


def t22_landscape(spark, d):
    i = intervals(spark, d)
    g = _grid(spark).crossJoin(F.broadcast(i.select("diagram").distinct()))
    return rounded(topology.landscape(i, g.select("diagram", "t"), 5, "diagram"))


def t22_landscape_l1(spark, d):
    i = intervals(spark, d)
    one = lambda name: topology.landscape(i.where(F.col("diagram") == name), _grid(spark))
    return rounded(topology.trapezoid_l1(one("A-F"), one("R-F")))


def t23_unit_area(spark, d):
    i = intervals(spark, d)
    total = i.groupBy("diagram").agg(F.sum(F.col("death") - F.col("birth")).alias("area"))
    return rounded(topology.betti_l1(i.join(F.broadcast(total), "diagram"), weight=1 / F.col("area")))


def t19_witness(spark, d):
    i = intervals(spark, d).dropDuplicates()
    kept, _ = topology.top_bars(i.where("diagram = 'A-F'"), 5, "diagram")
    return rounded(topology.witness_lower(kept, i.where("diagram = 'N-O' AND birth >= 0.3")))


def a39_bands(spark, d):
    """Stretches of the Betti curve at which at least a tenth of all bars is alive."""
    b = topology.betti_steps(intervals(spark, d), "diagram")
    n = intervals(spark, d).groupBy("diagram").agg(F.count("*").alias("n"))
    share = b.join(F.broadcast(n), "diagram").withColumn("share", F.col("betti") / F.col("n"))
    return topology.bands(share, "share", 0.1, "t", "diagram")


_STEPS = INTERVALS + """, ev AS (SELECT diagram, birth AS t, 1 AS v FROM intervals WHERE birth < death UNION ALL SELECT diagram, death, -1 FROM intervals WHERE birth < death), st AS (SELECT diagram, t, sum(v) AS v FROM ev GROUP BY ALL),
bt AS (SELECT diagram, t, (sum(v) OVER (PARTITION BY diagram ORDER BY t))::BIGINT AS betti FROM st)"""
_L1 = """dn AS (SELECT DISTINCT diagram FROM iw), pr AS (SELECT a.diagram AS a, b.diagram AS b FROM dn a JOIN dn b ON a.diagram < b.diagram), ew AS (SELECT diagram, birth AS t, w AS v FROM iw UNION ALL SELECT diagram, death, -w FROM iw),
bo AS (SELECT a, b, t, sum(v) AS v FROM (SELECT a, b, t, v FROM pr JOIN ew ON ew.diagram = a UNION ALL SELECT a, b, t, -v FROM pr JOIN ew ON ew.diagram = b) GROUP BY ALL), rn AS (SELECT a, b, sum(v) OVER (PARTITION BY a, b ORDER BY t) AS h, lead(t) OVER (PARTITION BY a, b ORDER BY t) - t AS dt FROM bo)
SELECT a, b, round(sum(abs(h) * dt), 6) AS distance FROM rn GROUP BY ALL"""
_TENTS = "g AS (SELECT i + 0.25::DOUBLE AS t FROM range(23) r(i)), tents AS (SELECT diagram, t, least(t - birth, death - t) AS h FROM g JOIN intervals ON birth < t AND t < death), rk AS (SELECT *, row_number() OVER (PARTITION BY diagram, t ORDER BY h DESC) AS level FROM tents), dn AS (SELECT DISTINCT diagram FROM intervals), ls AS (SELECT dn.diagram, g.t, l::INT AS level, coalesce(h, 0) AS height FROM dn CROSS JOIN g CROSS JOIN range(1, 6) r(l) LEFT JOIN rk ON rk.diagram = dn.diagram AND rk.t = g.t AND rk.level = l)"

QUERIES = {
    "t1_normalisation": (t1_normalisation, f"WITH {CUBE}, dd AS (SELECT a.level, list_distance(a.vec, b.vec) AS x FROM cube a JOIN cube b ON a.level = b.level AND b.point_id = (a.point_id * 7 + 1) % (SELECT count(*) FROM embeddings) AND a.point_id <> b.point_id), m AS (SELECT level, CASE WHEN median(x) > 0 THEN median(x) ELSE max(x) END AS s FROM dd GROUP BY level) SELECT level, round(s, 6) AS scale, s = 0 AS degenerate FROM m"),
    "t6_summary": (t6_summary, f"""WITH {INTERVALS}, l AS (SELECT diagram, birth, death - birth AS life, CASE WHEN death > birth THEN (death - birth) / sum(death - birth) OVER (PARTITION BY diagram) END AS p FROM intervals)
SELECT diagram, count(*) AS bars, 0::BIGINT AS censored, count(*) FILTER (life > 0) AS positive, round(max(life), 6) AS max_life, round(avg(life), 6) AS mean_life, round(sum(life), 6) AS total_life, round(quantile_cont(life, 0.25) FILTER (life > 0), 6) AS q25, round(quantile_cont(life, 0.5) FILTER (life > 0), 6) AS median,
round(quantile_cont(life, 0.75) FILTER (life > 0), 6) AS q75, round(-sum(p * ln(p)) FILTER (p > 0) / ln(count(*) FILTER (life > 0)), 6) AS entropy, round(max(p), 6) AS largest_share, arg_max(birth, (life, -birth)) AS birth_of_longest FROM l GROUP BY diagram"""),
    "t9_betti_grid": (t9_betti_grid, f"WITH {INTERVALS}, m AS (SELECT diagram, max(death) * 1.0::DOUBLE AS top FROM intervals GROUP BY diagram), g AS (SELECT diagram, round(i * top / 30, 6) AS t FROM m, range(31) r(i)) SELECT g.diagram, t, count(birth) AS betti FROM g LEFT JOIN intervals i ON i.diagram = g.diagram AND birth <= t AND t < death GROUP BY ALL"),
    "t24_feature_vector": (t24_feature_vector, f"""WITH {_STEPS}, l AS (SELECT *, death - birth AS life FROM intervals), r AS (SELECT *, row_number() OVER (PARTITION BY diagram ORDER BY life DESC, birth, death) AS r FROM l),
s AS (SELECT diagram, count(*) AS bars, max(life) AS top, sum(life) AS total, min(birth) AS first_birth, max(death) AS last_death, {", ".join(f"quantile_cont(life, {q / 100}) AS q{q}" for q in (25, 50, 75, 90, 99))},
count(*) FILTER (life > 0) AS positive, sum(life * ln(life)) FILTER (life > 0) AS ll, {", ".join(f"count(*) FILTER (life > {x}) AS longer_{str(x).replace('.', '_')}, count(*) FILTER (birth <= {x} AND death > {x}) AS betti_{str(x).replace('.', '_')}" for x in (0.1, 0.5, 1.0))} FROM l GROUP BY diagram),
b AS (SELECT diagram, max(life) FILTER (r = 2) AS second, max(birth) FILTER (r = 1) AS top_birth, max(death) FILTER (r = 1) AS top_death, sum(life) FILTER (r <= 30) AS most FROM r GROUP BY diagram),
p AS (SELECT diagram, betti AS peak_betti, t AS peak_radius FROM bt QUALIFY row_number() OVER (PARTITION BY diagram ORDER BY betti DESC, t) = 1)
SELECT diagram, bars, round(top, 6) AS top, round(total, 6) AS total, round(first_birth, 6) AS first_birth, round(last_death, 6) AS last_death, {", ".join(f"round(q{q}, 6) AS q{q}" for q in (25, 50, 75, 90, 99))}, positive,
longer_0_1, longer_0_5, longer_1_0, betti_0_1, betti_0_5, betti_1_0, round(second, 6) AS second, round(top_birth, 6) AS top_birth, round(top_death, 6) AS top_death, peak_betti, round(peak_radius, 6) AS peak_radius,
round(ln(total) - ll / total, 6) AS entropy, round((ln(total) - ll / total) / ln(positive), 6) AS entropy_share, round(top / second, 6) AS top_ratio, round(top / total, 6) AS top_share, round(most / total, 6) AS most_share
FROM s JOIN b USING (diagram) JOIN p USING (diagram)"""),
    "t10_betti_steps": (t10_betti_steps, f"WITH {_STEPS} SELECT * FROM bt"),
    "t11_layer_betti": (t11_layer_betti, f"WITH {_LAYERS} SELECT l AS level, (SELECT count(*) FROM ef WHERE birth_layer <= l AND l < death_layer) AS betti FROM range({LEVELS}) t(l)"),
    "t12_effective_levels": (t12_effective_levels, f"WITH {_LAYERS} SELECT raw_birth, raw_death, birth_layer, death_layer, lifetime_layers, count(*) AS n FROM ef GROUP BY ALL"),
    "t13_persistence_matrix": (t13_persistence_matrix, f"WITH {_LAYERS}, c AS (SELECT least(greatest(birth_layer, 0), {LEVELS}) AS birth_layer, least(greatest(death_layer, 0), {LEVELS}) AS death_layer FROM ef) SELECT death_layer, birth_layer, count(*) AS n FROM c WHERE birth_layer <> death_layer GROUP BY ALL"),
    "t14_interlayer": (t14_interlayer, f"""WITH {_LAYERS}, ij AS (SELECT i, j FROM range({LEVELS}) a(i), range({LEVELS}) b(j)), c AS (SELECT i, j, count(birth_layer) AS n, count(*) FILTER (birth_layer <= least(i, j) AND death_layer > greatest(i, j)) AS m FROM ij LEFT JOIN ef ON birth_layer <= i AND i < death_layer GROUP BY ALL)
SELECT i AS level, round(avg(coalesce(m / nullif(n, 0), 0)), 6) AS value FROM c GROUP BY i"""),
    "t15_interval_counts": (t15_interval_counts, f"WITH {_LAYERS} SELECT count(*) AS features, count(*) FILTER (lifetime_layers > 0) AS positive, round(avg(lifetime_layers), 6) AS mean_lifetime FROM ef"),
    "t16_global_k": (t16_global_k, "SELECT l_linenumber AS k, count(*) FILTER (l_quantity > 25) AS n FROM lineitem GROUP BY k ORDER BY n DESC, k LIMIT 1"),
    "t17_top_bars": (t17_top_bars, f"WITH {INTERVALS} SELECT diagram, birth, death, round(death - birth, 6) AS life, (row_number() OVER w)::INT AS rank FROM intervals WINDOW w AS (PARTITION BY diagram ORDER BY death - birth DESC, birth, death) QUALIFY row_number() OVER w <= 10"),
    "t17_sketch_error": (t17_sketch_error, f"WITH {INTERVALS}, r AS (SELECT diagram, death - birth AS life, row_number() OVER (PARTITION BY diagram ORDER BY death - birth DESC, birth, death) AS rank FROM intervals) SELECT diagram, round(coalesce(max(life) FILTER (rank > 10), 0) / 2, 6) AS error FROM r GROUP BY diagram"),
    "t19_witness": (t19_witness, f"WITH {INTERVALS}, i AS (SELECT DISTINCT * FROM intervals), k AS (SELECT * FROM i WHERE diagram = 'A-F' QUALIFY row_number() OVER (ORDER BY death - birth DESC, birth, death) <= 5), n AS (SELECT k.birth AS b, k.death AS d, min(greatest(abs(k.birth - i.birth), abs(k.death - i.death))) AS near FROM k, i WHERE i.diagram = 'N-O' AND i.birth >= 0.3::DOUBLE GROUP BY ALL) SELECT round(max(least((d - b) / 2, near)), 6) AS bound FROM n"),
    "t20_betti_l1": (t20_betti_l1, f"WITH {INTERVALS}, iw AS (SELECT *, 1.0::DOUBLE AS w FROM intervals), {_L1}"),
    "t21_sorted_l1": (t21_sorted_l1, f"WITH {INTERVALS}, r AS (SELECT diagram, death, row_number() OVER (PARTITION BY diagram ORDER BY death DESC) AS r FROM intervals), dn AS (SELECT DISTINCT diagram FROM r), pr AS (SELECT a.diagram AS a, b.diagram AS b FROM dn a JOIN dn b ON a.diagram < b.diagram), s AS (SELECT a, b, r, death AS v FROM pr JOIN r ON r.diagram = a UNION ALL SELECT a, b, r, -death FROM pr JOIN r ON r.diagram = b), z AS (SELECT a, b, r, sum(v) AS v FROM s GROUP BY ALL) SELECT a, b, round(sum(abs(v)) / 10000, 6) AS distance FROM z GROUP BY ALL"),
    "t22_landscape": (t22_landscape, f"WITH {INTERVALS}, {_TENTS} SELECT diagram, t, level, round(height, 6) AS height FROM ls"),
    "t22_landscape_l1": (t22_landscape_l1, f"WITH {INTERVALS}, {_TENTS}, df AS (SELECT a.level, a.t, abs(a.height - b.height) AS d FROM ls a JOIN ls b ON a.level = b.level AND a.t = b.t AND a.diagram = 'A-F' AND b.diagram = 'R-F'), ar AS (SELECT level, (lead(t) OVER w - t) * (d + lead(d) OVER w) / 2 AS area FROM df WINDOW w AS (PARTITION BY level ORDER BY t)) SELECT level, round(sum(area), 6) AS distance FROM ar GROUP BY level"),
    "t23_unit_area": (t23_unit_area, f"WITH {INTERVALS}, iw AS (SELECT *, 1 / sum(death - birth) OVER (PARTITION BY diagram) AS w FROM intervals), {_L1}"),
    "a39_bands": (a39_bands, f"WITH {_STEPS}, n AS (SELECT diagram, count(*) AS n FROM intervals GROUP BY diagram), i AS (SELECT bt.*, betti / n AS share, row_number() OVER (PARTITION BY bt.diagram ORDER BY t) AS i FROM bt JOIN n USING (diagram)), g AS (SELECT diagram, t, i - row_number() OVER (PARTITION BY diagram ORDER BY t) AS g FROM i WHERE share >= 0.1) SELECT diagram, min(t) AS start, max(t) AS stop, count(*) AS n FROM g GROUP BY diagram, g"),
}
