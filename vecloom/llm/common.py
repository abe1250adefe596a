"""Session, staging and column helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of text, that a kernel takes at once.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Only where a session names none (tests, one machine) is a folder of our own set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage, survives a lost executor, and lets Spark drop the shuffle files
    that made it at the end of the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vecloom/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    try:
        spark.conf.set(cleanup, "true")
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(cleanup)
        else:
            spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    delete_at_exit(spark, path)
    return out


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Lazy plans may read a path until the driver ends; then it goes."""
    atexit.register(_delete, spark, path)


def release(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    if path := getattr(df, "staged_path", None):
        _delete(df.sparkSession, path)


def sliced(batches: Iterator[pa.RecordBatch], column: str | None = None, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and ``size`` bytes of ``column`` (a row at least).

    So a kernel's memory doesn't depend on how many rows the session hands over at once.
    """
    for batch in batches:
        if column is None:
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows)
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, side="right"))
            j = min(max(j, i + 1), i + rows, batch.num_rows)
            yield batch.slice(i, j - i)
            i = j


def bounded_batches(spark: SparkSession) -> None:
    """Bound what is handed to Python at once by bytes, where the session has not set a bound of its own.

    Plans are lazy, so this can't be undone after a call; it is one constant, the same for every operator, and
    changes no result.  Kernels slice what they get, whatever its size.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's own default
        spark.conf.set(key, f"{ARROW_BYTES}b")


def give_back() -> None:
    """Return what a finished task has freed to the system: workers live on, for other queries."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def free_name(taken: Sequence[str], wanted: str) -> str:
    """``wanted``, with underscores added until it clashes with no column (case ignored)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted


def connected(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, label)``, label the least node.

    Every round maps each node to its least neighbour and contracts the graph, so the
    edges shrink geometrically; all rounds are aggregations and joins on staged tables.
    """
    step, maps = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e"), []
    while not step.isEmpty():
        if len(maps) == max_rounds:
            raise RuntimeError("components did not converge")
        ends = step.select(F.col("a").alias("node"), F.col("b").alias("other")).union(step.select("b", "a"))
        m = staged(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), f"{name}-m")
        maps.append(m)
        left = step.join(m.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        both = left.join(m.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        step = staged(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-e")
    if not maps:
        kind = edges.schema["a"].dataType
        return edges.sparkSession.createDataFrame([], "node long, label long").select(F.col("node").cast(kind), F.col("label").cast(kind))
    out = maps[0].select("node", F.col("to").alias("label"))
    for m in maps[1:]:
        out = staged(out.join(m.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"{name}-l")
    return out
