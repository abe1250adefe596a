"""Template and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import project, shapes
from ..sources.tables import cube, points, table
from ..staging import staged
from .base import rounded


def g16_templates(spark, d):
    """Templates with as many points as each label has: their number, and their mean square radius, which is 1."""
    sizes = points(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return rounded(shapes.template_sizes(sizes))


def _clouds(spark, d):
    """(cloud, point_id, x, y, z): each level's first three components, a cloud for each label."""
    c = cube(spark, d)
    s = project.scores(c, project.pca(c, 3)).groupBy("level", "point_id").agg(*[F.max(F.when(F.col("component") == i, F.col("score"))).alias(n) for i, n in enumerate("xyz", 1)])
    return s.join(points(spark, d).select("point_id", "label"), "point_id").select(F.concat_ws("-", "level", "label").alias("cloud"), "point_id", "x", "y", "z")


def f1_halves(spark, d):
    """The frames of the clouds' fitting halves: centred there, a mean square radius of 1, axes that don't mix and grow smaller."""
    h = shapes.halves(_clouds(spark, d)).where("fitting")
    mean = lambda v: F.round(F.avg(v), 6) + F.lit(0.0)
    return h.groupBy("cloud").agg(*[mean(c).alias(f"mean_{c}") for c in "xyz"], mean(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("size"), *[mean(F.col(a) * F.col(b)).alias(f"mixed_{a}{b}") for a, b in ("xy", "xz", "yz")])


def f6_template_fits(spark, d):
    """Every template on each level's first three components, a cloud for each label."""
    return rounded(shapes.fit_all(_clouds(spark, d)))


def f7_closest(spark, d):
    return shapes.closest(f6_template_fits(spark, d)).select("cloud", "name", "passed")


def _controls(spark, d):
    nulls = staged(shapes.null_clouds(_clouds(spark, d)), "null-clouds")
    fits = shapes.fit_all(nulls.select(F.concat_ws("/", "kind", "draw", "cloud").alias("cloud"), "point_id", "x", "y", "z"))
    return shapes.control_medians(fits.withColumn("kind", F.split("cloud", "/")[0]))


def f7_null_moments(spark, d):
    """What permuted controls keep: a cloud's points, and its coordinates' sums and sums of squares."""
    clouds = staged(_clouds(spark, d), "null-clouds")
    sums = lambda f, *keys: f.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("point_id").alias("ids"), *[v.alias(f"{c}{i}") for c in "xyz" for i, v in enumerate((F.sum(c), F.sum(F.col(c) ** 2)))])
    had = sums(clouds, "cloud").drop("n", "ids")
    got = sums(shapes.null_clouds(clouds).where("kind = 'permuted'"), "cloud", "draw")
    near = [F.abs(got[f"{c}{i}"] - had[f"{c}{i}"]) < 1e-6 for c in "xyz" for i in (0, 1)]
    return got.join(had, "cloud").select("cloud", "draw", "n", "ids", F.array_min(F.array(*near)).alias("kept"))


def f7_control_medians(spark, d):
    """Templates on three Gaussian and three permuted copies of every cloud."""
    return rounded(_controls(spark, d))


def f9_study(spark, d):
    """Each template's record: passes, replication with the halves swapped, clouds it is nearest to, and what controls reach."""
    c = staged(_clouds(spark, d), "study-clouds")
    return rounded(shapes.study(staged(shapes.fit_all(c), "study-fits"), shapes.fit_all(c, other=True), _controls(spark, d)))


def s16_catalogue(spark, d):
    """A union of catalogues with their sizes beside the expected ones."""
    parts = [("region", 5), ("nation", 25), ("customer", None), ("supplier", None), ("part", None), ("orders", None), ("lineitem", None), ("events", None), ("documents", None), ("embeddings", None), ("pages", None), ("benchmark", None), ("labels", None), ("conversations", None)]
    out = None
    for name, want in parts:
        one = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("catalogue"), "n", ((F.col("n") == want) if want else (F.col("n") > 0)).alias("complete"))
        out = one if out is None else out.unionByName(one)
    return out


def s18_centred_slice(spark, d):
    """Published slices: each level's vectors less their mean, as floats, by dimension: how far they spread, and the largest."""
    from ..sources.store import centred

    c = cube(spark, d)
    x = centred(c).select("level", F.posexplode("vec").alias("dim", "x"))
    size = F.abs(F.col("x").cast("double"))
    return x.groupBy("level", "dim").agg(F.count("*").alias("n"), F.round(F.avg(size), 4).alias("spread"), F.round(F.max(size), 4).alias("largest"))


QUERIES = {
    "g16_templates": (g16_templates, "SELECT label, unnest(" + str([t[0] for t in shapes.templates(24)]) + ") AS name, count(*) AS n, 1.0::DOUBLE AS size FROM embeddings GROUP BY label"),
    "f1_halves": (f1_halves, "SELECT l || '-' || label AS cloud, " + ", ".join(f"{v}::DOUBLE AS {c}" for c, v in [*[(f"mean_{c}", 0) for c in "xyz"], ("size", 1), *[(f"mixed_{c}", 0) for c in ("xy", "xz", "yz")]]) + " FROM embeddings, range(4) t(l) GROUP BY l, label"),
    "f6_template_fits": (f6_template_fits, None),
    "f7_closest": (f7_closest, None),
    "f7_null_moments": (f7_null_moments, "SELECT l || '-' || label AS cloud, draw::INT AS draw, count(*) AS n, count(*) AS ids, true AS kept FROM embeddings, range(4) t(l), range(1, 4) r(draw) GROUP BY l, label, draw"),
    "f7_control_medians": (f7_control_medians, None),
    "f9_study": (f9_study, None),
    "s16_catalogue": (s16_catalogue, "SELECT 'region' AS catalogue, count(*) AS n, count(*) = 5 AS complete FROM region UNION ALL SELECT 'nation', count(*), count(*) = 25 FROM nation" + "".join(f" UNION ALL SELECT '{t}', count(*), count(*) > 0 FROM {t}" for t in "customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())),
    "s18_centred_slice": (s18_centred_slice, """WITH x AS (SELECT l::INT AS level, unnest(range(16))::INT AS dim, unnest(embedding[16 * l + 1 : 16 * l + 16])::DOUBLE AS x FROM embeddings, range(4) t(l)),
c AS (SELECT level, dim, abs(x - avg(x) OVER (PARTITION BY level, dim)) AS s FROM x) SELECT level, dim, count(*) AS n, round(avg(s), 4) AS spread, round(max(s), 4) AS largest FROM c GROUP BY ALL"""),
}
