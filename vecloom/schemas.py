"""Schemas of the tables that operators exchange, and the predicates that rows must meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([T.StructField("point_id", T.LongType()), T.StructField("target", T.LongType()), T.StructField("leading_digit", T.IntegerType()), T.StructField("digit_count", T.IntegerType()), T.StructField("label", T.IntegerType())])
VECTORS = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("point_id", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
KNN = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("src", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("dst", T.LongType()), T.StructField("dist", T.DoubleType())])
INTERVALS = T.StructType([T.StructField("diagram", T.StringType()), T.StructField("birth", T.DoubleType()), T.StructField("death", T.DoubleType())])


def bad_vectors(vectors: DataFrame) -> DataFrame:
    """(level, point_id, problem) of rows no operator can use: null, empty, non-finite or of another length than their level's."""
    dims = vectors.groupBy("level").agg(F.max(F.size("vec")).alias("dim"))
    checked = vectors.join(F.broadcast(dims), "level")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    problem = F.when(F.col("vec").isNull(), "null").when(F.size("vec") == 0, "empty").when(F.size("vec") != F.col("dim"), "length").when(F.exists("vec", odd), "non-finite")
    return checked.select("level", "point_id", problem.alias("problem")).where("problem IS NOT NULL")


def repeated_ids(vectors: DataFrame) -> DataFrame:
    """(level, point_id, n) of ids met more than once in a level."""
    return vectors.groupBy("level", "point_id").agg(F.count("*").alias("n")).where("n > 1")


def missing_ids(vectors: DataFrame, points: DataFrame) -> DataFrame:
    """(level, point_id) expected by ``points`` and absent from a level: an anti join."""
    want = vectors.select("level").distinct().crossJoin(points.select("point_id"))
    return want.join(vectors.select("level", "point_id"), ["level", "point_id"], "left_anti")
