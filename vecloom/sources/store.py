"""Vector stores: Parquet by model and level, ingest of NPZ/NPY shards, CSV and JSON tables, checks and exports."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.moments import moments

VECTORS = "level int, point_id long, vec array<float>"


def write_levels(vectors: DataFrame, path: str, mode: str = "error") -> None:
    """One directory a level, so that reading a level prunes all others.

    Rows are dealt by level and a salt of the id: a level is many files, and a task writes few levels.
    """
    keys = [c for c in ("model", "level") if c in vectors.columns]
    salt = F.pmod(F.xxhash64("point_id"), F.lit(16))
    vectors.repartition(*keys, salt).write.mode(mode).partitionBy(*keys).parquet(path)


def read_level(spark: SparkSession, path: str, level: int, model: str | None = None) -> DataFrame:
    found = spark.read.parquet(path).where(F.col("level") == level)
    return found.where(F.col("model") == model) if model is not None else found


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """NPZ files holding ``hidden`` [level, point, feature] and ``point_ids``, as (level, point_id, vec)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    hidden, ids = z["hidden"], z["point_ids"] if "point_ids" in z else np.arange(z["hidden"].shape[1])
                if hidden.ndim != 3 or len(ids) != hidden.shape[1]:
                    raise ValueError("hidden must be [level, point, feature] with an id for each point")
                for level in range(hidden.shape[0]):
                    yield pd.DataFrame({"level": level, "point_id": ids.astype(np.int64), "vec": list(hidden[level].astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, VECTORS)


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Doubles with 12 significant digits, as a header and rows."""
    text = [F.format_string("%.12g", F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema]
    df.select(*text).write.option("header", True).csv(path)


def infer_rows(rows: DataFrame, infer: Callable[[pd.Series], list[np.ndarray]], input_col: str = "prompt", id_col: str = "point_id") -> DataFrame:
    """Any model as a source: ``infer`` takes a batch of inputs and returns for each its [level, feature] vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = infer(batch[input_col])
            for i, matrix in zip(batch[id_col], found, strict=True):
                yield pd.DataFrame({"level": range(len(matrix)), "point_id": int(i), "vec": list(np.asarray(matrix, np.float32))})

    return rows.select(id_col, input_col).mapInPandas(run, VECTORS)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of every file under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of a manifest(path, sha256) that a table of file hashes doesn't bear out, with the reason."""
    both = manifest.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "left")
    return both.select("path", F.when(F.col("path").contains(".."), "outside").when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("want"), "hash").alias("problem")).where("problem IS NOT NULL")


def centred(vectors: DataFrame) -> DataFrame:
    """Each level's vectors less their mean, cast to floats: a published slice."""
    means = moments(vectors, "level").select("level", "mean")  # a row a level
    return vectors.join(F.broadcast(means), "level").select("level", "point_id", F.zip_with("vec", "mean", lambda a, b: (a - b).cast("float")).alias("vec"))


def read_group(spark: SparkSession, path: str, rows: DataFrame, task: str, context: str, model: str | None = None) -> DataFrame:
    """The stored vectors of one condition's rows: ``rows(point_id, task, context_id)`` of the task and context, at every level.

    The filter on the rows comes first; a model's directory is pruned.  Ids that the store lacks are an error on use, as a missing level would be.
    """
    wanted = rows.where((F.col("task") == task) & (F.col("context_id") == context)).select("point_id", F.lit(True).alias("wanted"))
    found = spark.read.parquet(path)
    found = found.where(F.col("model") == model) if model is not None else found
    joined = found.join(wanted, "point_id", "right")
    stored = F.when(F.col("level").isNull(), F.raise_error(F.concat(F.lit("no stored vector of point "), F.col("point_id")))).otherwise(F.col("wanted"))
    return joined.withColumn("wanted", stored).where("wanted").drop("wanted")
