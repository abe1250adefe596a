"""Ranked lexical search: postings in buckets of terms, joined with the terms of the items, scored in whole numbers.

One pass over the texts makes the postings, a row ``(bucket, term, row, doc_id, tf, n)`` for each term of each document, ordered by
bucket within each file, and a row without a term for each document that has any, which holds its length.  The terms of the items
pass a sieve of fixed size (a bit for each of 2 ** 20 hashes) ahead of that pass, so terms of no item never leave it; a term that
passes by chance meets no item in the join.  Document frequencies, the number of documents and their total length are sums
over the postings.  Matches are summed by item and document, and each item's best are ranked by a window that Spark limits
before it shuffles.

Each row of ``docs`` is a document, and each row of ``items`` an item, also where rows share an id or are alike.  Null and empty texts have no
terms: such documents are not counted, such items find nothing.  Equal scores go by ascending id (null ids last), then by
row.  Texts are read whole, however long.  Empty tables give no rows.  Only the id and text columns are read, so others may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, sliced, staged, table
from .words import batch_words, text_bytes

#: Bits of the sieve, and buckets of terms.
SIEVE_BITS, BUCKETS = 20, 256
#: Bytes of the items' terms that are broadcast; beyond it they meet the postings in a join on salted buckets.
BROADCAST_BYTES, SALTS = 8 << 20, 16
#: The ranking's two constants, and its results for an item.
K1_MILLI, B_PERCENT, TOP = 1000, 50, 50

# Bytes of a term are ASCII letters and digits and all of other characters; letters A-Z are lower-cased, all else parts terms.
_FOLD = np.full(256, 0x20, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _FOLD[_b] = _b
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _counted(column: pa.Array, sieve: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(n of each document from ``first`` on, document, tf, bucket and sieve bit, term) of some documents at a time."""
    data, offsets = text_bytes(column)
    folded = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_FOLD[data]))
    for w in batch_words(folded):
        n = np.diff(w.offset)
        bit = (w.hash >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
        kept = np.arange(len(bit)) if sieve is None else np.flatnonzero(sieve[bit])
        start, size = w.start[kept], w.end[kept] - w.start[kept]
        at = np.concatenate([[0], np.cumsum(size)])
        flat = w.data[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
        terms = pa.LargeStringArray.from_buffers(len(kept), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)).dictionary_encode()
        code = terms.indices.to_numpy().astype(np.int64)
        doc = np.searchsorted(w.offset, kept, side="right") - 1
        width = max(len(terms.dictionary), 1)
        each, first, tf = np.unique(doc * width + code, return_index=True, return_counts=True)
        yield w.first, n, w.first + each // width, tf, bit[kept][first], terms.dictionary.take(pa.array(each % width)).cast(pa.string())


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sieve: bytes | None = None) -> DataFrame:
    """(bucket, term, bit, row, doc_id, tf, n): a row for each term of each document, and one without a term for each document that has any.

    ``sieve`` holds a bit for each hash of a term that is wanted; without it every term is.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if sieve is None else np.unpackbits(np.frombuffer(sieve, np.uint8)).astype(bool)
        names = ["bucket", "term", "bit", "row", "doc_id", "tf", "n"]
        for batch in sliced(batches, "text", 1 << 20):
            row, own = batch.column("row"), batch.column("doc_id")
            for first, n, doc, tf, bit, term in _counted(batch.column("text"), wanted):
                some = first + np.flatnonzero(n)
                every = pa.array(np.concatenate([some, doc]))
                none = pa.nulls(len(some), pa.int32())
                yield pa.record_batch([
                    pa.concat_arrays([none, pa.array((bit % BUCKETS).astype(np.int32))]), pa.concat_arrays([pa.nulls(len(some), pa.string()), term]), pa.concat_arrays([none, pa.array(bit.astype(np.int32))]),
                    row.take(every), own.take(every), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(tf.astype(np.int64))]), pa.array(n[np.concatenate([some, doc]) - first].astype(np.int64)),
                ], names)
        give_back()

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "bucket int, term string, bit int, row long, doc_id long, tf long, n long")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, bucket, term, bit): the different terms of each row of ``items``."""
    found = postings(items, id_col, text_col).where("term IS NOT NULL")
    return staged(found.select(F.col("row").alias("item"), F.col("doc_id").alias("item_id"), "bucket", "term", "bit"), "op11-items")


def sieve_of(terms: DataFrame) -> bytes:
    """The sieve of the items' terms: at most 2 ** SIEVE_BITS numbers reach the driver, however many terms there are."""
    bits = np.zeros(1 << SIEVE_BITS, bool)
    bits[terms.select("bit").distinct().toPandas()["bit"].to_numpy(np.int64)] = True
    return np.packbits(bits).tobytes()


def ranked(index: DataFrame, terms: DataFrame, top: int = TOP, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item, from a table of ``postings`` and the items' ``item_terms``."""
    total = index.where("term IS NULL").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    df = index.where("term IS NOT NULL").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.expr(f"CAST(floor(1000 * ln(CAST({2 * n_docs + 2} AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS LONG)")
    wanted = staged(terms.join(df, ["bucket", "term"]).select("item", "bucket", "term", weight.alias("w")), "op11-weights")
    size = wanted.agg(F.sum(F.octet_length("term") + 32).alias("bytes")).first()["bytes"] or 0
    share = F.expr(f"(1000000000 * tf) DIV ({K1_MILLI} * tf + 20 * ({100 - B_PERCENT} + (({B_PERCENT} * n * {n_docs}) DIV {n_terms})))")
    posts = index.where("term IS NOT NULL").select("bucket", "term", "row", "doc_id", share.alias("share"))
    if size <= broadcast_bytes:
        matches = posts.join(F.broadcast(wanted), ["bucket", "term"])
    else:  # a frequent term's postings are spread over SALTS keys
        spread = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matches = posts.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(spread, ["bucket", "term", "salt"])
    scores = matches.groupBy("item", "row").agg(F.sum(F.col("w") * F.col("share")).alias("score"), F.max("doc_id").alias("doc_id")).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(terms.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Postings of what the items ask for, and each item's best documents."""
    terms = item_terms(items)
    index = staged(postings(docs, sieve=sieve_of(terms)).sortWithinPartitions("bucket", "term"), "op11-postings")
    return ranked(index, terms, top)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM documents),
docs AS (SELECT doc_id, len(t)::BIGINT AS n, t FROM words WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM docs),
posts AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posts, total GROUP BY term, docs),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // terms)))))::BIGINT AS score
FROM asked JOIN weights USING (term) JOIN posts USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 50"""
