"""Comparisons of levels and models: nearest depth, pair tables, rank changes and flips, windows around peaks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank, spearman
from ..staging import staged
from .knn import blocks, cells

#: Fixed value: the variation, as a part of the largest size, below which a side counts as constant.
NEARLY = 1e-12


def relative_depth(levels: DataFrame, model: str = "model", level: str = "level") -> DataFrame:
    """Depth of a level from 0 to 1 within its model."""
    return levels.withColumn("depth", F.col(level) / F.nullif(F.max(level).over(Window.partitionBy(model)), F.lit(0)))


def nearest_depth(levels: DataFrame, depths: DataFrame) -> DataFrame:
    """(model, wanted, level, depth): for each wanted depth the level nearest to it, the lower of two.

    An as-of join both ways: levels and wanted depths are merged in order and each takes the last level before and the first after it.
    """
    models = levels.select("model").distinct()
    asked = depths.select(F.col("depth").alias("wanted")).crossJoin(F.broadcast(models)).select("model", F.col("wanted").alias("depth"), F.lit(None).cast("int").alias("level"), F.lit(True).alias("asked"))
    every = levels.select("model", "depth", F.col("level").cast("int").alias("level"), F.lit(False).alias("asked")).unionByName(asked)
    up = Window.partitionBy("model").orderBy("depth", "asked")
    down = Window.partitionBy("model").orderBy(F.desc("depth"), F.desc("asked"))
    own = F.when(~F.col("asked"), F.struct("depth", "level"))
    j = every.withColumn("low", F.last(own, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("high", F.last(own, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))).where("asked")
    dl, dh = F.abs(F.col("depth") - F.col("low.depth")), F.abs(F.col("high.depth") - F.col("depth"))
    take = F.when(F.col("high").isNull() | (dl <= dh), F.col("low")).otherwise(F.col("high"))
    return j.withColumn("t", take).select("model", F.col("depth").alias("wanted"), F.col("t.level").alias("level"), F.col("t.depth").alias("depth"))


def level_pairs(metrics: DataFrame, values: list[str]) -> DataFrame:
    """(m1, l1, m2, l2, <value>): absolute differences for every unordered pair of levels."""
    key = F.struct("model", "level")
    a = metrics.select(key.alias("a"), *[F.col(v).alias(f"{v}_a") for v in values])
    b = metrics.select(key.alias("b"), *[F.col(v).alias(f"{v}_b") for v in values])
    return a.join(b, F.col("a") < F.col("b")).select(F.col("a.model").alias("m1"), F.col("a.level").alias("l1"), F.col("b.model").alias("m2"), F.col("b.level").alias("l2"), *[F.abs(F.col(f"{v}_a") - F.col(f"{v}_b")).alias(v) for v in values])


def nearest_level(pairs: DataFrame, value: str) -> DataFrame:
    """(model, level, other_model, other_level, distance): each level's nearest among other models' levels and its own model's beyond the adjacent ones."""
    both = pairs.select("m1", "l1", "m2", "l2", value).union(pairs.select("m2", "l2", "m1", "l1", value))
    fit = both.where((F.col("m1") != F.col("m2")) | (F.abs(F.col("l1") - F.col("l2")) > 1))
    w = Window.partitionBy("m1", "l1").orderBy(value, "m2", "l2")
    return fit.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("m1").alias("model"), F.col("l1").alias("level"), F.col("m2").alias("other_model"), F.col("l2").alias("other_level"), F.col(value).alias("distance"))


def cross_percentile(pairs: DataFrame, value: str) -> DataFrame:
    """Same-model pairs with the percentage of cross-model pairs at most as far apart.

    Both kinds are sorted once; the share is a running count, not a comparison of every two pairs.
    """
    cross = F.col("m1") != F.col("m2")
    total = pairs.where(cross).agg(F.count("*").alias("total"))
    counts = pairs.groupBy(value).agg(F.count_if(cross).alias("c"))
    run = counts.withColumn("le", F.sum("c").over(Window.orderBy(value))).select(value, "le")
    return pairs.where(~cross).join(run, value).crossJoin(F.broadcast(total)).withColumn("percentile", 100.0 * F.col("le") / F.col("total")).drop("le", "total")


def rank_changes(scores: DataFrame, points: DataFrame, first: int, second: int) -> DataFrame:
    """(point_id, rank1, rank2, change, contribution): how each point moved, and its part of the change of Spearman's rho with the target.

    A contribution is the difference of the products of standardised ranks; they sum to the change of rho.
    """
    s = scores.where(F.col("level").isin(first, second)).join(points.select("point_id", "target"), "point_id").withColumn("r", average_rank("score", "level")).withColumn("t", average_rank("target", "level"))
    w = Window.partitionBy("level")
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)
    s = s.withColumn("p", z("r") * z("t") / F.count("*").over(w))
    a = s.where(F.col("level") == first).select("point_id", F.col("r").alias("rank1"), F.col("p").alias("p1"))
    b = s.where(F.col("level") == second).select("point_id", F.col("r").alias("rank2"), F.col("p").alias("p2"))
    return a.join(b, "point_id").select("point_id", "rank1", "rank2", (F.col("rank2") - F.col("rank1")).alias("change"), (F.col("p2") - F.col("p1")).alias("contribution"))


def rank_flips(scores: DataFrame, points: DataFrame, first: int, second: int, group: str) -> DataFrame:
    """(g1, g2, pairs, flips, unflips, ties) over all pairs of points: concordant with the target at the first level and discordant at the second, and the reverse."""
    wide = scores.where(F.col("level") == first).select("point_id", F.col("score").alias("x")).join(scores.where(F.col("level") == second).select("point_id", F.col("score").alias("y")), "point_id").join(points.select("point_id", "target", F.col(group).alias("g")), "point_id")
    # Blocks of points meet by cell, so a pair of points is never a row.
    row = F.array(*[F.col(c).cast("double") for c in ("x", "y", "target", "g")])
    packed = staged(blocks(wide.select(F.lit(0).alias("level"), "point_id", row.alias("vec"))), "flip-blocks")

    def count(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                p, q = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, 4) for c in ("data", "data2"))
                d = [q[None, :, k] - p[:, None, k] for k in range(3)]
                one, two = np.sign(d[0] * d[2]), np.sign(d[1] * d[2])
                use = np.triu(np.ones(one.shape, bool), 1) if batch.column("x")[i] == batch.column("y")[i] else np.ones(one.shape, bool)
                kind = ((one > 0) & (two < 0)) + 2 * ((one < 0) & (two > 0)) + 4 * ((one == 0) | (two == 0))
                groups, at = np.unique(np.concatenate([p[:, 3], q[:, 3]]), return_inverse=True)
                a, b, size = at[: len(p), None], at[None, len(p) :], len(groups)
                code = (np.minimum(a, b) * size + np.maximum(a, b)) * 8 + kind
                n = np.bincount(code[use], minlength=size * size * 8)
                code = np.flatnonzero(n)
                yield pa.record_batch([pa.array(groups[code // 8 // size]), pa.array(groups[code // 8 % size]), pa.array((code % 8).astype(np.int32)), pa.array(n[code])], ["g1", "g2", "kind", "n"])

    found = cells(packed).where("x <= y").mapInArrow(count, "g1 double, g2 double, kind int, n long")
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    out = found.groupBy("g1", "g2").agg(F.sum("n").alias("pairs"), of(1).alias("flips"), of(2).alias("unflips"), of(4).alias("ties"))
    return out.withColumns({c: F.col(c).cast(wide.schema["g"].dataType) for c in ("g1", "g2")})


def phase_medians(metrics: DataFrame, value: str) -> DataFrame:
    """(model, phase, n, median) of overlapping parts of the depth: thirds, and the last three levels."""
    d = relative_depth(metrics).withColumn("from_last", F.max("level").over(Window.partitionBy("model")) - F.col("level"))
    member = F.array_compact(F.array(F.when(F.col("depth") <= 1 / 3, "early"), F.when((F.col("depth") > 1 / 3) & (F.col("depth") <= 2 / 3), "middle"), F.when(F.col("depth") > 2 / 3, "late"), F.when(F.col("from_last") < 3, "last3")))
    return d.withColumn("phase", F.explode(member)).groupBy("model", "phase").agg(F.count("*").alias("n"), F.median(value).alias("median"))


def associations(metrics: DataFrame, x: str, y: str) -> DataFrame:
    """(model, rho, rho_steps): Spearman of two metrics over the levels, and of their first differences; NULL where either side hardly varies: by no more than
    NEARLY of its largest size."""
    w = Window.partitionBy("model").orderBy("level")
    steps = metrics.withColumn("dx", F.col(x) - F.lag(x).over(w)).withColumn("dy", F.col(y) - F.lag(y).over(w)).where("dx IS NOT NULL")

    def varied(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
        flat = lambda v: F.max(v) - F.min(v) <= NEARLY * F.max(F.abs(v))
        still = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy("model").agg((flat(a) | flat(b)).alias("flat"))
        return spearman(rows, a, b, "model", name=name).join(still, "model").select("model", F.when(~F.col("flat"), F.col(name)).alias(name))

    return varied(metrics, x, y, "rho").join(varied(steps, "dx", "dy", "rho_steps"), "model")


def peak_windows(metrics: DataFrame, value: str, reach: int = 2) -> DataFrame:
    """(model, peak, low, high, median): the level of the largest value and what is within ``reach`` levels of it."""
    top = metrics.withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy(F.desc(value), "level"))).where("r = 1").select("model", F.col("level").alias("peak"))
    near = metrics.join(top, "model").where(F.abs(F.col("level") - F.col("peak")) <= reach)
    return near.groupBy("model", "peak").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.median(value).alias("median"))


def equivalence(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(level, n, max_abs, rel_l2, cosine_error): how far a candidate's vectors are from a reference's."""
    j = reference.join(candidate.withColumnRenamed("vec", "other"), ["level", "point_id"])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    apart = F.zip_with("vec", "other", lambda p, q: p - q)
    per = j.select("level", F.array_max(F.transform(apart, F.abs)).alias("m"), dot(apart, apart).alias("dd"), dot("vec", "vec").alias("xx"), dot("other", "other").alias("yy"), dot("vec", "other").alias("xy"))
    return per.groupBy("level").agg(F.count("*").alias("n"), F.max("m").alias("max_abs"), (F.sqrt(F.sum("dd")) / F.sqrt(F.sum("xx"))).alias("rel_l2"), F.max(1 - F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("cosine_error"))
