"""Scans of the driver's tables as points, level cubes and interval tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS, WIDTH = 4, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a point: its target (id + 1), the target's leading digit and length, and the label."""
    t = (F.col("vec_id") + 1).cast("string")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), (F.col("vec_id") + 1).alias("target"), F.left(t, F.lit(1)).cast("int").alias("leading_digit"), F.length(t).alias("digit_count"), "label")


def cube(spark: SparkSession, sf_dir: str, levels: int = LEVELS, width: int = WIDTH) -> DataFrame:
    """The level cube: slice ``level`` of every vector, in doubles."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    each = e.select("vec_id", "e", F.explode(F.array(*[F.lit(i) for i in range(levels)])).alias("level"))
    return each.select("level", F.col("vec_id").alias("point_id"), F.slice("e", F.col("level") * width + 1, F.lit(width)).alias("vec"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence-like intervals of the line items: diagram, birth, death, in tenths."""
    li = table(spark, sf_dir, "lineitem")
    birth = F.round(F.col("l_discount") * 100).cast("long")
    life = F.round(F.col("l_tax") * 100).cast("long") + F.pmod(F.col("l_partkey"), F.lit(7))
    return li.select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("diagram"), (birth / 10.0).alias("birth"), ((birth + life) / 10.0).alias("death"))


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a behaviour probe, as the line items stand in for them: task, context, outcomes."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("context"), F.col("l_partkey").alias("target"),
        (F.col("l_quantity") > 12).alias("exact_match"), (F.pmod("l_partkey", F.lit(3)) == 0).alias("changed"),
        (F.pmod("l_suppkey", F.lit(5)) == 0).alias("leading_zero"), (F.col("l_linenumber") >= 6).alias("hit_limit"),
    )
