"""A catalogue of materialised results keyed by what they were made from.

An artifact's key is the sha256 of its name, its configuration (canonical JSON), its inputs' keys and the
code's version.  A result is prepared under a name of its own and moved to its key when it is whole, so an interrupted write is
never taken for a result and of two writers the first one's stands; an unchanged result is never made again, and anything that
differs has another key.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


class Catalog:
    def __init__(self, spark: SparkSession, root: str, config: dict, version: str = "1"):
        self.spark, self.root, self.config, self.version = spark, root.rstrip("/"), config, version

    def key(self, name: str, inputs: tuple[str, ...] = ()) -> str:
        return fingerprint([name, self.config, list(inputs), self.version])

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def complete(self, key: str) -> bool:
        """Whether the write committed: Spark's own marker is there."""
        fs, p = self._fs(f"{self.root}/{key}/_SUCCESS")
        return fs.exists(p)

    def get(self, name: str, make: Callable[[], DataFrame], inputs: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
        key = self.key(name, inputs)
        path = f"{self.root}/{key}"
        if not self.complete(key):
            prepared = f"{self.root}/_prepared/{key}-{uuid.uuid4().hex}"
            make().write.parquet(prepared)
            fs, source = self._fs(prepared)
            target = self._fs(path)[1]
            if self.complete(key) or not fs.rename(source, target):
                fs.delete(source, True)  # another writer was first
                self.require(key)
        return self.spark.read.parquet(path), key

    def recover(self) -> int:
        """Delete what interrupted writers have left behind, and tell how much; none may be at work."""
        fs, p = self._fs(f"{self.root}/_prepared")
        n = len(fs.listStatus(p)) if fs.exists(p) else 0
        fs.delete(p, True)
        return n

    def require(self, key: str) -> DataFrame:
        if not self.complete(key):
            raise FileNotFoundError(f"no complete artifact {key}")
        return self.spark.read.parquet(f"{self.root}/{key}")


def merge_receipts(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receipts(key, sha256) delivered once or more: one row a key, and the keys whose deliveries differ."""
    by = receipts.groupBy("key").agg(F.count("*").alias("deliveries"), F.countDistinct("sha256").alias("versions"), F.min("sha256").alias("sha256"))
    return by.where("versions = 1").select("key", "sha256", "deliveries"), by.where("versions > 1").select("key", "versions")


def pending(expected: DataFrame, present: DataFrame, key: str = "key") -> DataFrame:
    return expected.join(present.select(key), key, "left_anti")
