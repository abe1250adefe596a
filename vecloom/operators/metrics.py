"""Label and locality statistics of neighbour relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import distribution
from .graph import components, union_graph
from .knn import neighbour_overlap
from .moments import moments, shares

PREVIOUS = "previous"


def labelled(knn: DataFrame, points: DataFrame) -> DataFrame:
    """The relation with both ends' attributes: an inner join on each; ``unknown_ids`` must be empty."""
    side = lambda p, c: points.select(F.col("point_id").alias(c), F.col("target").alias(f"{p}t"), F.col("leading_digit").alias(f"{p}d"), F.col("digit_count").alias(f"{p}n"))
    return knn.join(side("s", "src"), "src").join(side("d", "dst"), "dst")


def unknown_ids(knn: DataFrame, points: DataFrame) -> DataFrame:
    """Neighbour ids that no point has."""
    ids = knn.select(F.col("src").alias("point_id")).union(knn.select("dst"))
    return ids.join(points, "point_id", "left_anti").distinct()


def graph_metrics(knn: DataFrame, points: DataFrame, k: int = 4) -> DataFrame:
    """One row a level: agreement of leading digits, relations across lengths with their own agreement (NULL where
    there are none, and the denominator beside it), gaps of the targets, and the share of mutual neighbours."""
    r = labelled(knn, points)
    same, cross = F.col("sd") == F.col("dd"), F.col("sn") != F.col("dn")
    gap = F.abs(F.col("st") - F.col("dt")).cast("double")
    stats = r.groupBy("level").agg(
        F.countDistinct("src").alias("point_count"), F.count("*").alias("relations"), F.avg(same.cast("double")).alias("same_leading_digit"),
        F.count_if(cross).alias("cross_length_count"), F.avg(cross.cast("double")).alias("cross_length"),
        F.try_divide(F.count_if(cross & same), F.count_if(cross)).alias("same_given_cross"),
        *distribution(gap, "gap"), F.avg(F.abs(F.log10(F.col("st").cast("double")) - F.log10(F.col("dt").cast("double")))).alias("log_gap_mean"), *distribution("dist", "dist"),
    )
    mutual = union_graph(knn).groupBy("level").agg(F.count("*").alias("union_edges"), F.count_if("mutual").alias("mutual_edges"))
    return stats.join(F.broadcast(mutual), "level").withColumn("mutual_fraction", 2 * F.col("mutual_edges") / (F.col("point_count") * k))


def metric_row(knn: DataFrame, points: DataFrame, k: int = 4) -> DataFrame:
    """One row a level: locality, gaps of logarithms, the union graph's components, overlap with the level present before (NULL
    for the first), and for each leading digit the share of its relations that stay within it."""
    r = labelled(knn, points)
    log_gap = F.abs(F.log10(F.col("st").cast("double")) - F.log10(F.col("dt").cast("double")))
    same = F.col("sd") == F.col("dd")
    by_digit = [F.avg(F.when(F.col("sd") == i, same.cast("double"))).alias(f"same_{i}") for i in range(1, 10)]
    stats = r.groupBy("level").agg(F.countDistinct("src").alias("point_count"), F.avg(same.cast("double")).alias("same_leading_digit"), F.median(log_gap).alias("log_gap_median"), F.max(log_gap).alias("log_gap_max"), *by_digit)
    nodes = knn.select("level", F.col("src").alias("point_id")).distinct()
    size = components(nodes, union_graph(knn)).groupBy("level", "component").agg(F.count("*").alias("n"))
    parts = size.groupBy("level").agg(F.count("*").alias("components"), (F.max("n") / F.sum("n")).alias("largest_share"))
    overlap = neighbour_overlap(knn, k).select("level", "overlap")
    return stats.join(F.broadcast(parts), "level").join(F.broadcast(overlap), "level", "left")  # a row a level


def whole_row(knn: DataFrame, points: DataFrame, k: int = 4) -> DataFrame:
    """All of ``graph_metrics`` and ``metric_row`` in one row a level, with the counts behind each share: relations of one length, those across lengths
    that keep the digit, neighbours kept from the level before out of how many (NULL for the first), and the gaps of logarithms in full."""
    r = labelled(knn, points)
    log_gap = F.abs(F.log10(F.col("st").cast("double")) - F.log10(F.col("dt").cast("double")))
    more = r.groupBy("level").agg(F.avg((F.col("sn") == F.col("dn")).cast("double")).alias("same_digit_length"), F.count_if((F.col("sn") != F.col("dn")) & (F.col("sd") == F.col("dd"))).alias("same_cross_count"), *distribution(log_gap, "log_gap"))
    row = metric_row(knn, points, k).drop("point_count", "same_leading_digit", "log_gap_median", "log_gap_max")
    out = graph_metrics(knn, points, k).drop("log_gap_mean").join(F.broadcast(more), "level").join(F.broadcast(row), "level")  # a row a level
    shared = F.round(F.col("overlap") * F.col("relations")).cast("long")
    return out.withColumn("overlap_count", shared).withColumn("overlap_denominator", F.when(F.col("overlap").isNotNull(), F.col("relations"))).withColumn("mutual_fraction", 2 * F.col("mutual_edges") / F.col("relations"))


def digit_transitions(knn: DataFrame, points: DataFrame) -> DataFrame:
    """(level, source_digit, target_digit, n, share) on the full 9 x 9 grid; the share is NULL in an empty row."""
    n = labelled(knn, points).groupBy("level", F.col("sd").alias("source_digit"), F.col("dd").alias("target_digit")).agg(F.count("*").alias("n"))
    nine = F.sequence(F.lit(1), F.lit(9))
    grid = knn.select("level").distinct().select("level", F.explode(nine).alias("source_digit")).select("*", F.explode(nine).alias("target_digit"))
    full = grid.join(n, ["level", "source_digit", "target_digit"], "left").na.fill(0, ["n"])
    return full.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("level", "source_digit"))))


def digit_baseline(points: DataFrame) -> DataFrame:
    """(leading_digit, n, chance): how often a random other point has the digit; with the weighted total as digit 0."""
    total = points.agg(F.count("*").alias("total"))
    by = points.groupBy("leading_digit").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).withColumn("chance", F.try_divide(F.col("n") - 1, F.col("total") - 1))
    all_ = by.agg(F.lit(0).alias("leading_digit"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("chance")) / F.sum("n")).alias("chance"))
    return by.select("leading_digit", "n", "chance").unionByName(all_)


def degeneration(vectors: DataFrame) -> DataFrame:
    """(level, rms_norm, rms_centred, degenerate): whether a level's vectors are all but one point."""
    m = moments(vectors, "level")  # a row a level
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    squares = total("m2") + F.col("n") * total(F.transform("mean", lambda v: v * v))
    out = m.select("level", F.sqrt(squares / F.col("n")).alias("rms_norm"), F.sqrt(total("m2") / F.col("n")).alias("rms_centred"))
    return out.withColumn("degenerate", F.col("rms_centred") <= 1e-7 * F.greatest(F.lit(1.0), F.col("rms_norm")))


def group_variance(vectors: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("level",)) -> DataFrame:
    """(keys, name, share): the share of the variance of the full space between the groups of a label.

    ``labels(point_id, name, label)``; rows with a NULL label take no part; NULL without rows or variance.
    """
    rows = vectors.join(labels.where("label IS NOT NULL"), "point_id")
    return shares(moments(rows, *keys, "name", "label"), *keys, "name")


def centroids(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(level, label, n, centroid) of ``labels(point_id, label)``."""
    return moments(vectors.join(labels, "point_id"), "level", "label").select("level", "label", "n", F.col("mean").alias("centroid"))


def centroid_ranking(centres: DataFrame, k: int = 4) -> DataFrame:
    """(level, label, rank, other, dist): each centroid's nearest others; labels are few, so they are paired."""
    other = centres.select("level", F.col("label").alias("other"), F.col("centroid").alias("c2"))
    d = F.sqrt(F.aggregate(F.zip_with("centroid", "c2", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    w = Window.partitionBy("level", "label").orderBy("dist", "other")
    return centres.join(other, "level").where("label <> other").withColumn("dist", d).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("level", "label", "rank", "other", "dist")


def edge_changes(edges: DataFrame) -> DataFrame:
    """(level, kept, gained, lost, jaccard) of each level's union edges against the level present before it."""
    e = edges.select("level", "a", "b")
    levels = e.select("level").distinct().withColumn("next", F.lead("level").over(Window.orderBy("level"))).where("next IS NOT NULL")  # one row a level
    before = e.join(F.broadcast(levels), "level").select(F.col("next").alias("level"), "a", "b").withColumn("old", F.lit(1))
    later = e.join(F.broadcast(levels.select(F.col("next").alias("level"))), "level").withColumn("new", F.lit(1))
    j = later.join(before, ["level", "a", "b"], "full")
    out = j.groupBy("level").agg(F.count_if(F.expr("new = 1 AND old = 1")).alias("kept"), F.count_if(F.expr("old IS NULL")).alias("gained"), F.count_if(F.expr("new IS NULL")).alias("lost"))
    return out.withColumn("jaccard", F.col("kept") / (F.col("kept") + F.col("gained") + F.col("lost")))
