"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's rate is its target share over its own: the mean number of times a document of it
is repeated.  Each document's count inverts the Poisson distribution of that rate at a uniform
number hashed from the seed and the document's id, so a rerun gives the same corpus; the
repetitions are then dealt by another hash over all partitions and sorted by it, a global
shuffle in one exchange.

Targets: ``weights`` by source, or, where none are given, each source's share of documents to
the power ``TEMPERATURE``.  Either is normalised over the sources that the table holds, and the
expected size of the mixture is ``scale`` times the table's.  A source that ``weights`` leaves out gets
none.  Null sources are one source of their own (``weights`` may hold None).  Rows with a null id draw by a hash of
all their columns, so equal ones share a number; rows that repeat an id share its numbers, and are dealt by a hash of
all columns.  An empty table gives no rows; where the table has a column named like one that is added, ours takes
underscores before its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, staged, table

SEED, TEMPERATURE = "mix-1", 0.7
#: A rate above this is split into equal Poisson parts, whose counts add up, so exp(-rate) never underflows.
MOST_RATE = 32.0
#: Steps of one inversion: the tail beyond them is below 2 ** -52 at MOST_RATE.
STEPS = 96


#: Copies of a table of rates that is too large to send to every executor: a source's rows meet any of them.
SALTS = 16


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1): 52 bits of an md5."""
    text = F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column) -> Column:
    """The least k with P(X <= k) > u, by adding the terms of the distribution."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        more = s["cdf"] <= u
        p = s["p"] * rate / k
        return F.struct(F.when(more, k).otherwise(s["k"]).alias("k"), F.when(more, p).otherwise(s["p"]).alias("p"), F.when(more, s["cdf"] + p).otherwise(s["cdf"]).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["k"])


def rates(docs: DataFrame, source_col: str, weights: dict | None, temperature: float, scale: float) -> DataFrame:
    """(source, rate): one row for each source."""
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), temperature))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        n = n.join(given.withColumnRenamed("source", "named"), F.col("source").cast("string").eqNullSafe(F.col("named")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = n.agg(F.sum("n").alias("docs"), F.sum("w").alias("all"))
    return n.join(F.broadcast(total)).select("source", (F.col("w") / F.col("all") * F.col("docs") * F.lit(float(scale)) / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, temperature: float = TEMPERATURE, scale: float = 1.0, seed: str = SEED) -> DataFrame:
    """The repeated, shuffled documents: their columns, ``copy`` (from 1) and ``shuffle_key``."""
    taken = list(docs.columns)
    rate_col, source, salt, count, copy, key = (free_name(taken, n) for n in ("rate", "rate_source", "rate_salt", "copies", "copy", "shuffle_key"))
    rate = staged(rates(docs, source_col, weights, temperature, scale), "op6-rates").select(F.col("source").alias(source), F.col("rate").alias(rate_col))
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), row.cast("string")))
    same = F.col(source_col).eqNullSafe(F.col(source))
    if rate.limit(10_001).count() <= 10_000:  # a table of sources that small is sent to every executor
        found = docs.join(F.broadcast(rate), same, "left")
    else:  # a larger one meets the documents in shuffles, a hot source in several tasks
        rate = rate.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = docs.join(rate, same & (F.pmod(row, F.lit(SALTS)).cast("int") == F.col(salt)), "left")
    r = F.coalesce(F.col(rate_col), F.lit(0.0))
    parts = F.greatest(F.ceil(r / MOST_RATE).cast("int"), F.lit(1))
    one = poisson(r, uniform(seed, ident, F.lit(0)))
    many = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda s, i: s + poisson(r / parts, uniform(seed, ident, i)))
    found = found.withColumn(count, F.when(r <= MOST_RATE, one).otherwise(many)).where(F.col(count) > 0)
    found = found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count)))).withColumn(key, F.xxhash64(F.lit(seed), F.lit("deal"), F.col(id_col), row, F.col(copy)))
    return found.select(*[F.col(f"`{c}`") for c in taken], copy, key).repartition(F.col(key)).sortWithinPartitions(key)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixture, with the columns the documents came with."""
    return mix_sources(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs).select(*docs.columns, "copy")


#: The same inversion as a recursive query; with the default targets no rate reaches MOST_RATE there.
ORACLE_OF = """
n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM {docs} GROUP BY source),
rates AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
terms(source, rate, k, p, cdf) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM terms WHERE k < 96),
drawn AS (SELECT d.*, ('0x' || left(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':0'), 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM {docs} d),
mixed AS (SELECT d.*, (SELECT coalesce(max(k) + 1, 0) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.cdf <= d.u AND t.k < 96) AS n_copies FROM drawn d)
"""
ORACLE = "WITH RECURSIVE " + ORACLE_OF.format(docs="documents") + "SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n_copies::BIGINT + 1))::INT AS copy FROM mixed"
