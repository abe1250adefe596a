"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own characters say so, equal chunks share a verified identifier, and
documents are compared by their ordered lists of identifiers.  A chunk's text moves once,
after a map-side distinct; a document's text never does.

Null text counts as empty.  Rows with equal text form a group whose row of the smallest id
stays (null ids last; of rows that repeat an id, one stays).  An empty table gives no rows.  Only the id and text
columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, staged, table

#: Characters of a chunk: the least, and the most where no boundary comes.
MIN_CHUNK, MAX_CHUNK = 512, 4096
#: A boundary is a space with one of the first letters before and one of the second after it.
BEFORE, AFTER = "dglnsté.", "aceimnpqtw"
_MAX_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def chunks(norm: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The text as an array of content-defined chunks; together they are the text."""
    cut = f"(?s).{{{least},{most - 2}}}?[{BEFORE}] (?=[{AFTER}])|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(cut), F.lit(0))


def recipes(docs: DataFrame, id_col: str, text_col: str, fingerprint=F.xxhash64) -> DataFrame:
    """(doc_id, row, recipe, text_sha256): each row's verified, ordered chunk identifiers."""
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    cut = cut.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks"))
    chunk = cut.select(F.explode("chunks").alias("chunk")).select(fingerprint(F.col("chunk")).alias("print"), "chunk")
    # One row for each different chunk; a fingerprint of two different chunks identifies neither.
    shared = staged(chunk.distinct().groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "op5-shared")
    ids = F.transform("chunks", lambda c: fingerprint(c))
    rows = cut.select("doc_id", F.monotonically_increasing_id().alias("row"), "text_sha256", ids.alias("prints"), *([] if shared.isEmpty() else [F.transform("chunks", lambda c: F.sha2(c, 256)).alias("whole")]))
    if shared.isEmpty():
        return staged(rows.select("doc_id", "row", "text_sha256", F.col("prints").alias("recipe")), "op5-recipes")
    rows = staged(rows, "op5-rows")
    each = rows.select("row", F.posexplode(F.arrays_zip("prints", "whole")).alias("pos", "c")).select("row", "pos", F.col("c.prints").alias("print"), F.col("c.whole").alias("whole"))
    each = each.join(shared.withColumn("clash", F.lit(True)), "print", "left")
    named = each.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("clash"), F.col("whole")).otherwise(F.col("print").cast("string")).alias("id")))), lambda x: x["id"]).alias("recipe"))
    return staged(rows.drop("prints", "whole").join(named, "row", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<string>"))), "op5-recipes")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint=F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    rows = recipes(docs, id_col, text_col, fingerprint)
    order = F.coalesce("doc_id", F.lit(_MAX_ID))
    groups = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"), F.min_by("row", order).alias("keep_row")).where("group_size > 1")
    groups = staged(groups, "op5-groups")
    found = rows.join(groups, "recipe", "left")
    single = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that stay, with the columns they came with, whatever their names.

    A row is known by its id and text, so a whole text moves once; of rows that are equal in both, one stays.
    """
    key = free_name(docs.columns, "row_key")
    of = lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), h)
    kept = staged(exact_dedup(docs).where("kept").select(of(F.col("doc_id"), F.col("text_sha256")).alias(key)), "op5-kept")
    named = docs.withColumn(key, of(F.col("doc_id").cast("long"), F.sha2(normalised(F.col("text")), 256)))
    return named.join(kept.hint("merge"), key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN g USING (text_sha256)
"""
