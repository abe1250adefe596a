"""Audits of stored results: counts of what is wrong, by check and level, from the results and the vectors they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knn import exact_knn

#: Points of a level whose neighbours are found anew, among all points.
SAMPLE = 20


def _dot(x: Column | str, y: Column | str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _apart(x: Column | str, y: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def relation_audit(vectors: DataFrame, knn: DataFrame, model: DataFrame, transitions: DataFrame, k: int = 4, sample: int = SAMPLE, room: float = 1e-9) -> DataFrame:
    """(level, check, wrong) of a stored relation, projection and table of transitions.

    ``ranks``: points that haven't the ranks 1 to k once each (fewer where a level has no more points); ``self``: relations of a point with itself; ``order``: ranks whose
    distance is less than the one's before; ``lengths``: distances that aren't those of the vectors; ``sample``: of ``sample`` points a level, those whose neighbours, found anew
    among all points, are others; ``basis``: pairs of components that aren't orthonormal; ``ratios``: levels whose shares of variance fall outside 0 to 1 or
    rise; ``totals``: relations that transitions have too many or too few.  The sample is the points of least hash, a bounded number a level, so it is broadcast; all else is
    sums and joins of the whole tables.
    """
    levels = vectors.groupBy("level").agg(F.count("*").alias("n"))
    vec = vectors.select("level", "point_id", "vec")
    per = vec.select("level", F.col("point_id").alias("src")).join(knn.groupBy("level", "src").agg(F.count("*").alias("c"), F.count_distinct("rank").alias("r"), F.min("rank").alias("low"), F.max("rank").alias("high")), ["level", "src"], "left").join(F.broadcast(levels), "level")
    want = F.least(F.lit(k), F.col("n") - 1)
    right = (F.coalesce("c", F.lit(0)) == want) & ((want == 0) | ((F.col("r") == want) & (F.col("low") == 1) & (F.col("high") == want)))
    ranks = per.groupBy("level").agg(F.count_if(~F.coalesce(right, F.lit(False))).alias("wrong"))
    before = F.lag("dist").over(Window.partitionBy("level", "src").orderBy("rank"))
    plain = knn.withColumn("before", before).groupBy("level").agg(F.count_if(F.col("src") == F.col("dst")).alias("self"), F.count_if(F.col("dist") < F.col("before")).alias("order"))
    ends = knn.join(vec.select("level", F.col("point_id").alias("src"), F.col("vec").alias("x")), ["level", "src"], "left").join(vec.select("level", F.col("point_id").alias("dst"), F.col("vec").alias("y")), ["level", "dst"], "left")
    lengths = ends.groupBy("level").agg(F.count_if(F.coalesce(F.abs(_apart("x", "y") - F.col("dist")) > room * (1 + F.col("dist")), F.lit(True))).alias("wrong"))
    chosen = vec.withColumn("r", F.row_number().over(Window.partitionBy("level").orderBy(F.xxhash64("point_id"), "point_id"))).where(F.col("r") <= sample).select("level", F.col("point_id").alias("src"), F.col("vec").alias("x"))
    near = vec.join(F.broadcast(chosen), "level").where("point_id <> src").select("level", "src", F.col("point_id").alias("dst"), _apart("x", "vec").alias("d"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("level", "src").orderBy("d", "dst"))).where(F.col("rank") <= k)
    both = near.join(knn.select("level", "src", "rank", F.col("dst").alias("had"), "dist"), ["level", "src", "rank"], "left")
    # Equal distances may differ in their last digits: another point at the same distance isn't wrong.
    other = F.coalesce((F.col("had") != F.col("dst")) & (F.abs(F.col("dist") - F.col("d")) > room * (1 + F.col("d"))), F.lit(True))
    sampled = both.groupBy("level", "src").agg(F.bool_or(other).alias("w")).groupBy("level").agg(F.count_if("w").alias("wrong"))
    a, b = model.select("level", F.col("component").alias("i"), F.col("loadings").alias("x")), model.select("level", F.col("component").alias("j"), F.col("loadings").alias("y"))
    basis = a.join(b, "level").where("i <= j").groupBy("level").agg(F.count_if(F.abs(_dot("x", "y") - (F.col("i") == F.col("j")).cast("double")) > room).alias("wrong"))
    step = model.withColumn("before", F.lag("ratio").over(Window.partitionBy("level").orderBy("component")))
    ratios = step.groupBy("level").agg((F.max(((F.col("ratio") < -room) | (F.col("ratio") > F.coalesce("before", F.lit(1.0)) + room)).cast("long"))).alias("a"), (F.sum("ratio") > 1 + room).cast("long").alias("b")).select("level", F.greatest("a", "b").alias("wrong"))
    totals = levels.select("level").join(knn.groupBy("level").agg(F.count("*").alias("c")), "level", "left").join(transitions.groupBy("level").agg(F.sum("n").alias("t")), "level", "left").select("level", F.abs(F.coalesce("c", F.lit(0)) - F.coalesce("t", F.lit(0))).alias("wrong"))
    named = {"ranks": ranks, "self": plain.select("level", F.col("self").alias("wrong")), "order": plain.select("level", F.col("order").alias("wrong")), "lengths": lengths, "sample": sampled, "basis": basis, "ratios": ratios, "totals": totals}
    out = None
    for name, f in named.items():
        one = f.select("level", F.lit(name).alias("check"), F.col("wrong").cast("long").alias("wrong"))
        out = one if out is None else out.unionByName(one)
    return out


def order_report(reference: DataFrame, candidate: DataFrame, k: int = 4) -> DataFrame:
    """(level, n, same_order, same_set, certain, broken, near_ties, least_margin): whether a candidate's vectors keep a reference's neighbours.

    A vector that moves by at most m changes no distance by more than 2 m, so points whose distances, up to the k + 1st, lie more than 4 m apart
    keep their order for certain: only the others have to be compared.  ``broken`` counts points that are certain and yet differ, which is never; ``near_ties`` those
    within that room, ``least_margin`` is the least gap between the kth and the k + 1st distance.
    """
    moved = reference.select("level", "point_id", "vec").join(candidate.select("level", "point_id", F.col("vec").alias("other")), ["level", "point_id"])
    most = moved.groupBy("level").agg(F.max(_apart("vec", "other")).alias("m"))

    def lists(v: DataFrame) -> DataFrame:
        return exact_knn(v, k + 1).groupBy("level", "src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "dist"))).alias("near"))

    a, b = lists(reference), lists(candidate).withColumnRenamed("near", "near2")
    first = lambda c: F.transform(F.slice(c, 1, k), lambda r: r["dst"])
    gaps = F.transform(F.sequence(F.lit(1), F.size("near") - 1), lambda i: F.element_at("near", i + 1)["dist"] - F.element_at("near", i)["dist"])
    j = a.join(b, ["level", "src"]).join(F.broadcast(most), "level")  # a row a level
    j = j.select("level", (first("near") == first("near2")).alias("ordered"), (F.array_sort(first("near")) == F.array_sort(first("near2"))).alias("same"), F.when(F.size("near") > 1, F.array_min(gaps)).alias("gap"), F.when(F.size("near") > k, F.element_at("near", k + 1)["dist"] - F.element_at("near", k)["dist"]).alias("margin"), "m")
    certain = F.coalesce(F.col("gap") > 4 * F.col("m"), F.lit(True))
    return j.groupBy("level").agg(F.count("*").alias("n"), F.count_if("ordered").alias("same_order"), F.count_if("same").alias("same_set"), F.count_if(certain).alias("certain"), F.count_if(certain & ~F.col("ordered")).alias("broken"), F.count_if(~certain).alias("near_ties"), F.min("margin").alias("least_margin"))
