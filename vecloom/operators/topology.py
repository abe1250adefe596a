"""Analytics over persistence intervals: Betti curves, landscapes, distances, summaries, layer intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INFINITY = float("inf")


def betti_steps(intervals: DataFrame, *keys: str) -> DataFrame:
    """(keys, t, betti): the exact step function: births and deaths as +1 and -1, summed at each time, then running."""
    finite = F.col("death") < INFINITY
    events = intervals.where("birth < death").select(*keys, F.explode(F.array(F.struct(F.col("birth").alias("t"), F.lit(1).alias("v")), F.struct(F.when(finite, F.col("death")).alias("t"), F.lit(-1).alias("v")))).alias("e"))
    step = events.where("e.t IS NOT NULL").groupBy(*keys, F.col("e.t").alias("t")).agg(F.sum("e.v").alias("v"))
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn("betti", F.sum("v").over(w)).drop("v")


def feature_vector(intervals: DataFrame, key: str, longer: tuple[float, ...] = (0.1, 0.5, 1.0), radii: tuple[float, ...] = (0.1, 0.5, 1.0), most: int = 30) -> DataFrame:
    """(key, ...): what a diagram of finite bars is described by.

    The number of bars, quartiles, tails and sum of their lives, the longest bars and their shares, the entropy of the positive
    lives (also over its largest), bars longer than some lives and alive at some radii, the largest Betti number and the
    first radius that has it.
    """
    i = intervals.withColumn("life", F.col("death") - F.col("birth"))
    life = F.col("life")
    q = F.percentile("life", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.99))))
    positive = F.when(life > 0, life)
    name = lambda x: str(x).replace(".", "_")
    stats = i.groupBy(key).agg(
        F.count("*").alias("bars"), F.max("life").alias("top"), F.sum("life").alias("total"), F.min("birth").alias("first_birth"), F.max("death").alias("last_death"),
        *[q[k].alias(n) for k, n in enumerate(("q25", "q50", "q75", "q90", "q99"))],
        F.count(positive).alias("positive"), F.sum(positive * F.ln(positive)).alias("_l"),
        *[F.count_if(life > x).alias(f"longer_{name(x)}") for x in longer], *[F.count_if((F.col("birth") <= x) & (F.col("death") > x)).alias(f"betti_{name(x)}") for x in radii],
    )
    entropy = F.when(F.col("total") > 0, F.ln("total") - F.col("_l") / F.col("total"))
    w = Window.partitionBy(key).orderBy(F.desc("life"), "birth", "death")
    best = i.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)  # few rows a diagram
    at = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    tops = best.groupBy(key).agg(at(2, "life").alias("second"), at(1, "birth").alias("top_birth"), at(1, "death").alias("top_death"), F.sum("life").alias("_most"))
    steps = betti_steps(intervals, key)
    peak = steps.groupBy(key).agg(F.max(F.struct("betti", -F.col("t"))).alias("p")).select(key, F.col("p.betti").alias("peak_betti"), (-F.col("p.col2")).alias("peak_radius"))
    out = stats.join(F.broadcast(tops), key).join(F.broadcast(peak), key)  # a row a diagram
    out = out.withColumn("entropy", entropy).withColumn("entropy_share", F.when(F.col("positive") > 1, F.col("entropy") / F.ln("positive")))
    return out.withColumn("top_ratio", F.try_divide("top", "second")).withColumn("top_share", F.try_divide("top", "total")).withColumn("most_share", F.try_divide("_most", "total")).drop("_l", "_most")


#: Lives beyond which bars are counted, and radii at which classes are, in units of the scale.
LIVES, RADII = (0.01, 0.02, 0.05, 0.1, 0.2), (0.1, 0.25, 0.5, 1.0, 2.0)


def layer_features(tree: DataFrame, h1: DataFrame, scale: DataFrame, row: DataFrame, axes: DataFrame) -> DataFrame:
    """One row a level: its diagrams of dimensions 0 and 1 in units of its scale, beside its neighbour and projection metrics.

    ``tree(level, length)`` holds the merges, ``h1(level, birth, death)`` finite bars, ``scale(level, scale)`` the median distance, ``row`` a level's
    ``metrics.whole_row`` and ``axes`` its (level, rho_pc1, rho_pc2, ev_pc1, ev_pc2).  Levels without scale have no row; those without bars have zeros and NULLs.
    Lengths are float32, so a life is known to two half units of the last place: ``h1_below_rounding`` counts bars within that.
    """
    sized = scale.where("scale > 0").select("level", "scale")  # a row a level
    unit = lambda f, *cs: f.join(F.broadcast(sized), "level").select("level", *[(F.col(c) / F.col("scale")).alias(c) for c in cs])
    name = lambda x: str(x).replace(".", "_")
    q = F.percentile("length", F.array(F.lit(0.5), F.lit(0.9)))
    h0 = unit(tree, "length").groupBy("level").agg(q[0].alias("h0_median"), q[1].alias("h0_q90"), F.max("length").alias("h0_connect"), *[(1 + F.count_if(F.col("length") > x)).alias(f"h0_components_at_{name(x)}") for x in RADII])
    bars = unit(h1.where(F.col("death") < INFINITY), "birth", "death")
    f = feature_vector(bars, "level", LIVES, RADII)
    renamed = {"bars": "h1_count", "top": "h1_max", "second": "h1_second", "top_ratio": "h1_top_ratio", "q25": "h1_q25", "q50": "h1_median", "q75": "h1_q75", "q90": "h1_q90", "q99": "h1_q99", "top_birth": "h1_top_birth", "top_death": "h1_top_death", "total": "h1_total", "top_share": "h1_top_share", "most_share": "h1_top30_share", "entropy": "h1_entropy", "entropy_share": "h1_entropy_normalized", "peak_betti": "h1_peak_betti", "peak_radius": "h1_peak_scale", "first_birth": "h1_first_birth", "last_death": "h1_last_death"} | {f"longer_{name(x)}": f"h1_count_gt_{name(x)}" for x in LIVES} | {f"betti_{name(x)}": f"h1_betti_at_{name(x)}" for x in RADII}
    f = f.select("level", *[F.col(a).alias(b) for a, b in renamed.items()])
    raw = h1.where(F.col("death") < INFINITY).groupBy("level").agg(F.max(F.col("death") - F.col("birth")).alias("h1_raw_max"), F.max("death").alias("_most"))
    bound = raw.join(F.broadcast(sized), "level").select("level", "h1_raw_max", (F.col("_most") * 2.0**-23 / F.col("scale")).alias("h1_rounding_bound"))
    below = bars.join(F.broadcast(bound), "level").groupBy("level").agg(F.count_if(F.col("death") - F.col("birth") <= F.col("h1_rounding_bound")).alias("h1_below_rounding"))
    out = sized.withColumnRenamed("scale", "distance_scale")
    depth = F.when(F.max("level").over(Window.partitionBy()) > 0, F.col("level") / F.max("level").over(Window.partitionBy())).otherwise(0.0)
    for part in (axes.withColumn("ev_pc12", F.col("ev_pc1") + F.col("ev_pc2")).drop("ev_pc2"), row.select("level", "same_leading_digit", "same_digit_length", F.col("gap_median").alias("neighbor_numeric_gap"), F.col("log_gap_median").alias("neighbor_log_gap")), h0, f, bound, below):
        out = out.join(F.broadcast(part), "level", "left")  # a row a level
    out = out.withColumn("depth", depth)
    out = out.withColumn("phase", F.when(F.col("depth") <= 1 / 3, "early").when(F.col("depth") <= 2 / 3, "middle").otherwise("late"))
    counts = [c for c in out.columns if c.startswith(("h1_count", "h1_betti", "h1_below", "h1_peak_betti"))]
    return out.na.fill(0, counts)


def betti_grid(intervals: DataFrame, grid: DataFrame, *keys: str) -> DataFrame:
    """(keys, t, betti) at the times of ``grid(keys, t)``: intervals with birth <= t < death.

    Grid and event times are merged and summed once, so the cost is a sort and not grid times intervals.
    """
    finite = F.col("death") < INFINITY
    events = intervals.where("birth < death").select(*keys, F.explode(F.array(F.struct(F.col("birth").alias("t"), F.lit(1).alias("v")), F.struct(F.when(finite, F.col("death")).alias("t"), F.lit(-1).alias("v")))).alias("e"))
    events = events.where("e.t IS NOT NULL").groupBy(*keys, F.col("e.t").alias("t")).agg(F.sum("e.v").alias("v")).withColumn("asked", F.lit(False))
    every = events.unionByName(grid.select(*keys, "t", F.lit(0).cast("long").alias("v"), F.lit(True).alias("asked")))
    w = Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    return every.withColumn("betti", F.sum("v").over(w)).where("asked").select(*keys, "t", "betti")


def persistence(levels: DataFrame, tree: DataFrame, h1: DataFrame, steps: int = 301, reach: float = 1.05) -> DataFrame:
    """(level, i, radius, betti0, betti1): classes alive on one grid a level, from 0 to ``reach`` times the last death of either dimension.

    ``tree(level, length)`` gives the merges, of which those of no length are omitted, ``levels(level)`` the class that stays.
    """
    h0 = tree.where("length > 0").select("level", F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.col("length").alias("death"))
    h0 = h0.unionByName(levels.select("level", F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.lit(INFINITY).alias("death")))
    every = h0.unionByName(h1.select("level", F.lit(1).alias("dim"), "birth", "death"))
    last = every.groupBy("level").agg(F.coalesce(F.max(F.when(F.col("death") < INFINITY, F.col("death"))), F.lit(0.0)).alias("last"))
    grid = last.select("level", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"), (F.col("last") * reach / (steps - 1)).alias("step")).withColumn("t", F.col("i") * F.col("step"))
    both = grid.select("level", "i", "t", F.explode(F.array(F.lit(0), F.lit(1))).alias("dim"))
    alive = betti_grid(every, both.select("level", "dim", "t").distinct(), "level", "dim")
    wide = alive.groupBy("level", "t").agg(*[F.max(F.when(F.col("dim") == k, F.col("betti"))).alias(f"betti{k}") for k in (0, 1)])
    return grid.join(wide, ["level", "t"]).select("level", "i", F.col("t").alias("radius"), "betti0", "betti1")


def uniform_grid(intervals: DataFrame, steps: int = 301, reach: float = 1.05, *keys: str) -> DataFrame:
    """(keys, t): ``steps`` times from 0 to ``reach`` times the largest finite death."""
    top = intervals.where(F.col("death") < INFINITY).groupBy(*keys).agg((F.max("death") * reach).alias("top"))
    each = top.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return each.select(*keys, (F.col("i") * F.col("top") / (steps - 1)).alias("t"))


def diagram_summary(intervals: DataFrame, *keys: str) -> DataFrame:
    """Counts, censored bars, lifetimes, their normalised entropy and share of the largest; NULL without a positive lifetime."""
    life = F.when(F.col("death") < INFINITY, F.col("death") - F.col("birth"))
    rows = intervals.withColumn("life", life)
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("p", F.when(F.col("life") > 0, F.col("life") / F.sum("life").over(w)))
    q = F.percentile(F.when(F.col("life") > 0, F.col("life")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    n = F.count_if(F.col("life") > 0)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("bars"), F.count_if(F.col("death") == INFINITY).alias("censored"), n.alias("positive"), F.max("life").alias("max_life"), F.avg("life").alias("mean_life"), F.sum("life").alias("total_life"),
        q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"),
        F.when(n > 1, -F.sum(F.col("p") * F.ln("p")) / F.ln(n)).alias("entropy"), F.max("p").alias("largest_share"), F.max_by("birth", F.struct("life", -F.col("birth"))).alias("birth_of_longest"),
    )


def top_bars(intervals: DataFrame, limit: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` longest bars of a diagram, and (keys, error): half the longest bar left out, which bounds the bottleneck distance to it."""
    ranked = intervals.where(F.col("death") < INFINITY).withColumn("life", F.col("death") - F.col("birth")).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("life"), "birth", "death")))
    error = ranked.groupBy(*keys).agg((F.coalesce(F.max(F.when(F.col("rank") > limit, F.col("life"))), F.lit(0.0)) / 2).alias("error"))
    return ranked.where(F.col("rank") <= limit), error


def betti_l1(intervals: DataFrame, diagram: str = "diagram", weight: Column | None = None) -> DataFrame:
    """(a, b, distance): the integral of the difference of two diagrams' Betti curves, for all pairs a < b of finite diagrams.

    ``weight`` scales a diagram's curve (unit area: 1 over its total lifetime).
    """
    one = intervals.where(F.col("death") < INFINITY).withColumn("w", F.lit(1.0) if weight is None else weight)
    ev = one.select(F.col(diagram).alias("d"), F.explode(F.array(F.struct(F.col("birth").alias("t"), F.col("w").alias("v")), F.struct(F.col("death").alias("t"), (-F.col("w")).alias("v")))).alias("e")).groupBy("d", F.col("e.t").alias("t")).agg(F.sum("e.v").alias("v"))
    names = ev.select("d").distinct()
    pairs = names.select(F.col("d").alias("a")).join(names.select(F.col("d").alias("b")), F.col("a") < F.col("b"))
    both = pairs.join(ev.select(F.col("d").alias("a"), "t", "v"), "a").unionByName(pairs.join(ev.select(F.col("d").alias("b"), "t", (-F.col("v")).alias("v")), "b")).groupBy("a", "b", "t").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("a", "b").orderBy("t")
    run = both.withColumn("h", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("dt", F.lead("t").over(w) - F.col("t"))
    return run.groupBy("a", "b").agg(F.coalesce(F.sum(F.abs("h") * F.col("dt")), F.lit(0.0)).alias("distance"))


def sorted_death_l1(intervals: DataFrame, diagram: str = "diagram", scale: float = 1.0) -> DataFrame:
    """(a, b, distance): the sum of differences of sorted finite deaths, the shorter list filled with zeros."""
    r = intervals.where(F.col("death") < INFINITY).select(F.col(diagram).alias("d"), "death").withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("death"))))
    names = r.select("d").distinct()
    pairs = names.select(F.col("d").alias("a")).join(names.select(F.col("d").alias("b")), F.col("a") < F.col("b"))
    signed = pairs.join(r.withColumnRenamed("d", "a"), "a").select("a", "b", "r", F.col("death").alias("v")).union(pairs.join(r.withColumnRenamed("d", "b"), "b").select("a", "b", "r", -F.col("death")))
    return signed.groupBy("a", "b", "r").agg(F.sum("v").alias("v")).groupBy("a", "b").agg((F.sum(F.abs("v")) / scale).alias("distance"))


def landscape(intervals: DataFrame, grid: DataFrame, top: int = 5, *keys: str) -> DataFrame:
    """(keys, t, level, height): the ``top`` highest tents of a diagram at each grid time."""
    tents = grid.join(intervals.where(F.col("death") < INFINITY), list(keys) or None, "inner") if keys else grid.crossJoin(intervals.where(F.col("death") < INFINITY))
    h = F.least(F.col("t") - F.col("birth"), F.col("death") - F.col("t"))
    ranked = tents.where((F.col("birth") < F.col("t")) & (F.col("t") < F.col("death"))).withColumn("height", h).withColumn("level", F.row_number().over(Window.partitionBy(*keys, "t").orderBy(F.desc("height"))))
    full = grid.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(top))))
    return full.join(ranked.where(F.col("level") <= top).select(*keys, "t", "level", "height"), [*keys, "t", "level"], "left").na.fill(0.0, ["height"])


def trapezoid_l1(a: DataFrame, b: DataFrame, value: str = "height") -> DataFrame:
    """(level, distance) of two landscapes on one grid."""
    j = a.select("t", "level", F.col(value).alias("x")).join(b.select("t", "level", F.col(value).alias("y")), ["t", "level"]).withColumn("d", F.abs(F.col("x") - F.col("y")))
    w = Window.partitionBy("level").orderBy("t")
    return j.withColumn("area", (F.lead("t").over(w) - F.col("t")) * (F.col("d") + F.lead("d").over(w)) / 2).groupBy("level").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("distance"))


def witness_lower(kept: DataFrame, other: DataFrame) -> DataFrame:
    """(bound): a lower bound of the bottleneck distance: the retained bar that is farthest from everything it could be matched to."""
    a = kept.select(F.monotonically_increasing_id().alias("i"), F.col("birth").alias("b1"), F.col("death").alias("d1"))
    far = a.crossJoin(other.select(F.col("birth").alias("b2"), F.col("death").alias("d2"))).groupBy("i", "b1", "d1").agg(F.min(F.greatest(F.abs(F.col("b1") - F.col("b2")), F.abs(F.col("d1") - F.col("d2")))).alias("near"))
    return far.agg(F.max(F.least((F.col("d1") - F.col("b1")) / 2, F.col("near"))).alias("bound"))


def effective_levels(raw: DataFrame) -> DataFrame:
    """Raw zigzag times as levels: floor(time / 2)."""
    return raw.withColumn("birth_layer", F.floor(F.col("raw_birth") / 2)).withColumn("death_layer", F.floor(F.col("raw_death") / 2)).withColumn("lifetime_layers", F.col("death_layer") - F.col("birth_layer"))


def layer_betti(intervals: DataFrame, levels: int) -> DataFrame:
    """(level, betti): intervals [birth, death) that are there at each level of 0 .. levels - 1."""
    clipped = intervals.select(F.greatest("birth_layer", F.lit(0)).cast("long").alias("b"), F.least("death_layer", F.lit(levels)).cast("long").alias("d")).where("b < d")
    there = clipped.select(F.explode(F.sequence("b", F.col("d") - 1)).alias("level")).groupBy("level").agg(F.count("*").alias("betti"))
    every = intervals.sparkSession.range(levels).withColumnRenamed("id", "level")
    return every.join(there, "level", "left").na.fill(0, ["betti"])


def persistence_matrix(intervals: DataFrame, levels: int) -> DataFrame:
    """(death_layer, birth_layer, n) of intervals clipped to the levels, those of no length left out."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(levels)).cast("long")
    return intervals.select(clip(F.col("birth_layer")).alias("birth_layer"), clip(F.col("death_layer")).alias("death_layer")).where("birth_layer <> death_layer").groupBy("death_layer", "birth_layer").agg(F.count("*").alias("n"))


def interlayer_persistence(intervals: DataFrame, levels: int) -> DataFrame:
    """(level, value): over all levels j, the mean share of a level's intervals that are also there at j; 0 where there are none."""
    n = intervals.sparkSession.range(levels)
    alive = lambda lo, hi: (F.col("birth_layer") <= lo) & (F.col("death_layer") > hi)
    pairs = n.select(F.col("id").alias("i")).crossJoin(n.select(F.col("id").alias("j")))
    j = F.broadcast(pairs).join(intervals, (F.col("birth_layer") <= F.col("i")) & (F.col("death_layer") > F.col("i")), "left")
    c = j.groupBy("i", "j").agg(F.count("birth_layer").alias("n"), F.count_if(alive(F.least("i", "j"), F.greatest("i", "j"))).alias("m"))
    return c.groupBy(F.col("i").alias("level")).agg(F.avg(F.coalesce(F.try_divide("m", "n"), F.lit(0.0))).alias("value"))


def choose_global_k(counts: DataFrame) -> DataFrame:
    """(k, n): the k of the largest sum of ``n`` over runs, the smaller of equals."""
    return counts.groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(1)


def normalisation(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(level, scale, degenerate): the median distance of ``pairs(i, j)``, the largest where that is 0."""
    a, b = vectors.select("level", F.col("point_id").alias("i"), F.col("vec").alias("x")), vectors.select("level", F.col("point_id").alias("j"), F.col("vec").alias("y"))
    d = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    m = a.join(pairs, "i").join(b, ["level", "j"]).select("level", d.alias("d")).groupBy("level").agg(F.median("d").alias("median"), F.max("d").alias("largest"))
    return m.select("level", F.when(F.col("median") > 0, F.col("median")).otherwise(F.col("largest")).alias("scale")).withColumn("degenerate", F.col("scale") == 0)


def aggregate_runs(rows: DataFrame, by: str, values: list[str], run: str) -> DataFrame:
    """Mean and sample deviation (NULL for one run) and population deviation of each value, over runs that must cover the same ``by``."""
    out = rows.groupBy(by).agg(F.countDistinct(run).alias("runs"), *[f for v in values for f in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"), F.stddev_pop(v).alias(f"{v}_pstd"))])
    return out.withColumn("complete", F.col("runs") == F.max("runs").over(Window.partitionBy()))


def bands(curve: DataFrame, value: str, least: float, order: str, *keys: str) -> DataFrame:
    """(keys, start, stop, n): stretches of neighbouring rows at which ``value`` is at least ``least``."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = curve.withColumn("_i", F.row_number().over(w)).where(F.col(value) >= least)
    r = r.withColumn("_g", F.col("_i") - F.row_number().over(w))
    return r.groupBy(*keys, "_g").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("n")).drop("_g")
