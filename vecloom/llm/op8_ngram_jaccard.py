"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

Documents are sets of five-word shingles (a document of fewer words is one shingle of all of
them; one without words has none).  Documents with equal sets are one representative.  Bands
of MinHash values propose clusters of representatives; inside a cluster, pairs are compared
``STEP`` MinHash values at a time and dropped once the posterior probability that their
similarity reaches the threshold is below ``TOLERANCE``; the rest are verified exactly, on the
whole shingle sets.  Large clusters are compared block against block, so no task holds a whole
group and no pair is emitted: a unit of work returns link counts and a spanning forest.  The first comparison has
MinHash values alone and splits clusters, which bands may chain together, into those that its survivors connect; only
their members' shingle sets are made and sent, in blocks of ``BLOCK_BYTES``.

Null text counts as empty; documents without words link to nothing.  Rows that repeat an id
are rows of their own.  A pair of similarity s shares a band with probability
1 - (1 - s^R)^BANDS: 0.99998 at 0.8, more above.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import bounded_batches, connected, free_name, give_back, sliced, staged, table
from .words import U, batch_words, grams, mix

N, THRESHOLD = 5, (4, 5)
BANDS, R = 36, 6
STEP, TOLERANCE = 24, 1e-7
#: Representatives of a block, and bytes of their sets; a unit of work compares two blocks.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Columns of the incidence matrix at a time.
WIDTH = 2048
_rng = np.random.default_rng(8)
_XOR = _rng.integers(0, 1 << 32, BANDS * R, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.integers(0, 1 << 31, BANDS * R, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(h: np.ndarray, n: int = N) -> np.ndarray:
    """The sorted, distinct shingle hashes of a document's word hashes."""
    if not len(h):
        return h
    return np.unique(grams(h, min(n, len(h))))


def minhash(s: np.ndarray) -> np.ndarray:
    """BANDS * R values; equal positions agree with the probability of the Jaccard similarity."""
    low = mix(s).astype(np.uint32)
    out = np.full(len(_XOR), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        part = (low[i : i + 1024, None] ^ _XOR[None, :]) * _MUL[None, :]
        np.minimum(out, part.min(axis=0), out=out)
    return out


def needed(n: int, t: float, tolerance: float) -> int:
    """The fewest matches of ``n`` at which P(similarity >= t) under a flat prior is at least ``tolerance``.

    That posterior is Beta(m + 1, n - m + 1); its tail is P(Binomial(n + 1, t) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


LEAST = [(k, needed(k, THRESHOLD[0] / THRESHOLD[1], TOLERANCE)) for k in range(STEP, BANDS * R + 1, STEP)]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document: a key of its shingle set, the set's size, MinHash values and keys of the bands."""
    for batch in sliced(batches, "text"):
        ids, hashes = batch.column("doc_id"), batch.column("text_hash")
        for w in batch_words(batch.column("text")):
            n, key, size, sign, bands = len(w.offset) - 1, [], [], [], []
            for i in range(n):
                s = shingles(w.hash[w.offset[i] : w.offset[i + 1]])
                m = minhash(s)
                key.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                size.append(len(s))
                sign.append(m.tobytes())
                bands.append(band_keys(m))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(np.concatenate(bands)))
            yield pa.record_batch([ids.slice(w.first, n), hashes.slice(w.first, n), pa.array(key, pa.binary()), pa.array(size, pa.int32()), pa.array(sign, pa.binary()), keys], ["doc_id", "text_hash", "key", "size", "sign", "bands"])
    give_back()


def band_keys(m: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for column in m.reshape(BANDS, R).astype(np.uint64).T:
        out = mix(out * U(0x9E3779B97F4A7C15) + column + U(1))
    return out.view(np.int64)


def surviving(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks of MinHash rows that Bayesian pruning leaves; i < j if they are one block."""
    k, least = LEAST[0]
    got = np.zeros((len(a), len(b)), np.int16)
    for c in range(k):
        got += a[:, c][:, None] == b[:, c][None, :]
    keep = got >= least
    i, j = np.nonzero(np.triu(keep, 1) if same else keep)
    got = got[i, j]
    for (was, _), (k, least) in zip(LEAST, LEAST[1:], strict=False):
        if not len(i):
            break
        got = got + np.count_nonzero(a[i, was:k] == b[j, was:k], axis=1)
        keep = got >= least
        i, j, got = i[keep], j[keep], got[keep]
    return i, j


def overlaps(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the pairs."""
    if len(i) < 4 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    both = [*left, *right]
    values, at = np.unique(np.concatenate(both), return_inverse=True)
    rows = np.repeat(np.arange(len(both)), [len(x) for x in both])
    used = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(used) - 1
    rows, at = rows[used[at]], column[at[used[at]]]
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    for low in range(0, int(used.sum()), WIDTH):
        x, y = np.searchsorted(at, [low, low + WIDTH])
        m = np.zeros((len(both), WIDTH), np.float32)
        m[rows[x:y], at[x:y] - low] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return total[i, j].astype(np.int64)


def _signs(f: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(f["sign"]), np.uint32).reshape(len(f), -1)


def _forest(p: np.ndarray, q: np.ndarray) -> dict[int, int]:
    """For each end of the pairs the least that it is connected with."""
    ids, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    a, b = at[: len(p)], at[len(p) :]
    label = np.arange(len(ids))
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    while (up := label[label]).tolist() != label.tolist():
        label = up
    return dict(zip(ids.tolist(), ids[label].tolist(), strict=True))


def _near(rows: pd.DataFrame) -> pd.DataFrame:
    """What pruning leaves of one block, or of one block with another, as a spanning forest."""
    first, second = rows[rows["side"] == 0], rows[rows["side"] == 1]
    same = not len(second)
    second = first if same else second
    i, j = surviving(_signs(first), _signs(second), same)
    forest = _forest(first["rep"].to_numpy()[i], second["rep"].to_numpy()[j])
    return pd.DataFrame({"rep": list(forest), "root": list(forest.values())}, columns=["rep", "root"]).astype("int64")


def _dealt(member: DataFrame, blocks: str) -> DataFrame:
    """Each row once for every unit of its cluster that its block is in: (cluster, x, y, side) and the row's columns."""
    rest = [c for c in member.columns if c not in ("cluster", blocks)]
    unit = member.withColumn("block", F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return unit.select("cluster", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), (F.col("block") > F.col("with")).cast("int").alias("side"), *rest)


def _unit(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one block, or of one block with another: counts for each representative, and a spanning forest."""
    first, second = rows[rows["side"] == 0], rows[rows["side"] == 1]
    same = not len(second)
    second = first if same else second
    sets = lambda f: [np.frombuffer(x, np.uint64) for x in f["shingles"]]
    a, b = (_signs(first), sets(first)), (_signs(second), sets(second))
    i, j = surviving(a[0], b[0], same)
    if len(i):
        (x, xi), (y, yj) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        inter = overlaps([a[1][k] for k in x], [b[1][k] for k in y], xi, yj)
        na, nb = np.array([len(s) for s in a[1]]), np.array([len(s) for s in b[1]])
        keep = THRESHOLD[1] * inter >= THRESHOLD[0] * (na[i] + nb[j] - inter)
        i, j = i[keep], j[keep]
    r, s = first["rep"].to_numpy(), second["rep"].to_numpy()
    c, d = first["copies"].to_numpy(), second["copies"].to_numpy()
    links: dict[int, int] = {}
    for ids, mine, theirs in ((r, i, d[j]), (s, j, c[i])):
        for k, v in enumerate(np.bincount(mine, weights=theirs, minlength=len(ids))):
            if v:
                links[ids[k]] = links.get(ids[k], 0) + int(v)
    root = _forest(r[i], s[j])
    return pd.DataFrame({"rep": list(links), "links": list(links.values()), "root": [root[k] for k in links]}, columns=["rep", "links", "root"]).astype("int64")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of representatives, of each as many times as its row is repeated."""
    for batch in sliced(batches, "text"):
        rep, want = batch.column("rep"), batch.column("key").to_pylist()
        for w in batch_words(batch.column("text")):
            at, found = [], []
            for i in range(len(w.offset) - 1):
                s = shingles(w.hash[w.offset[i] : w.offset[i + 1]]).tobytes()
                if blake2b(s, digest_size=16).digest() == want[w.first + i]:
                    at.append(w.first + i)
                    found.append(s)
            yield pa.record_batch([rep.take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], ["rep", "shingles"])
    give_back()


def _texts(hashed: DataFrame, member: DataFrame) -> DataFrame:
    """(rep, key, text): the representatives' texts; rows that share an id are told apart by the hashes of theirs."""
    mine = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("text_hash") == F.col("rep_hash")]
    return hashed.join(member.select("rep", "key", "rep_hash", F.col("doc_id").alias("_id")).hint("merge"), mine).select("rep", "key", "text")


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: doc_id, text_hash, key (of its shingle set), size, class_id, n_links, label (of the class)."""
    bounded_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = text.withColumn("text_hash", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    rows = hashed.mapInArrow(_prints, "doc_id long, text_hash binary, key binary, size int, sign binary, bands array<long>")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "op8-rows")
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    reps = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("row", "text_hash"), order).alias("r"), F.count("*").alias("copies"), F.first("size").alias("size"))
    reps = staged(reps.select("key", "doc_id", F.col("r.row").alias("rep"), F.col("r.text_hash").alias("rep_hash"), "copies", "size"), "op8-reps")
    band = rows.join(reps.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), F.explode("bands").alias("band"))
    heads = staged(band.groupBy("band").agg(F.min("rep").alias("head"), F.max("rep").alias("most")).where("head < most").select("band", "head"), "op8-heads")
    clusters = connected(band.join(heads, "band").select(F.col("rep").alias("a"), F.col("head").alias("b")), "op8-near")

    def members(labels: DataFrame, name: str) -> DataFrame:
        """Each labelled representative, with its cluster and the number of blocks that it is compared in."""
        own = staged(labels.select(F.col("node").alias("rep"), F.col("label").alias("cluster")).join(reps, "rep"), f"{name}-own")
        sizes = own.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
        by_count, by_bytes = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("int").alias("set_blocks")
        return staged(own.join(sizes.select("cluster", by_count, by_bytes), "cluster"), name)

    signs = rows.select(F.col("row").alias("rep"), "sign").hint("merge")
    loose = members(clusters, "op8-loose").select("rep", "cluster", "blocks").join(signs, "rep")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # units are few bytes and much work: not to be put together
    near = staged(_dealt(loose, "blocks").repartition(tasks, "cluster", "x", "y").groupBy("cluster", "x", "y").applyInPandas(_near, "rep long, root long"), "op8-pruned")
    member = members(connected(near.select(F.col("rep").alias("a"), F.col("root").alias("b")), "op8-split"), "op8-member")
    # The shingles are made again, from the texts of those representatives alone.  These joins grow with the
    # corpus, so they are merge joins at every size.
    sets = _texts(hashed, member).mapInArrow(_sets, "rep long, shingles binary").dropDuplicates(["rep"])
    unit = member.select("rep", "cluster", "set_blocks", "copies").join(signs, "rep").join(sets.hint("merge"), "rep")
    found = staged(_dealt(unit, "set_blocks").repartition(tasks, "cluster", "x", "y").groupBy("cluster", "x", "y").applyInPandas(_unit, "rep long, links long, root long"), "op8-found")
    labels = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "op8-class")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = staged(reps.join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "op8-known")
    least = known.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    known = staged(known.join(staged(least, "op8-least"), "label").select("key", "label", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).where("n_links > 0"), "op8-linked")
    out = rows.select("doc_id", "text_hash", "key", "size").join(known.hint("merge"), "key", "left")
    return out.select("doc_id", "text_hash", "key", "size", "label", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (least id of the linked class), n_links, n_shingles.

    ``n_links`` counts the other rows of similarity 0.8 or more, rows with an equal set included.
    """
    return classes(docs, id_col, text_col).select("doc_id", "class_id", "n_links", F.col("size").cast("long").alias("n_shingles"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one row stays, of the least id, with its columns, whatever their names.

    Of rows of a class that share that id, the one of the least hash of its text stays; rows that link to nothing all stay.
    """
    key, n, wordy = (free_name(docs.columns, c) for c in ("row_key", "row_number", "has_words"))
    of = lambda i, h: F.concat(F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), h)
    found = staged(classes(docs, "doc_id", "text").select("doc_id", "label", "n_links", of(F.col("doc_id"), F.hex("text_hash")).alias("k")), "op8-classes")
    lone = found.where("n_links = 0").select(F.col("k").alias(key))
    least = found.where("n_links > 0").groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "k")).alias("m")).select(F.col("m.k").alias(key))
    named = docs.withColumn(key, of(F.col("doc_id").cast("long"), F.upper(F.sha2(F.coalesce("text", F.lit("")), 256))))
    named = named.join(lone.unionAll(least).hint("merge"), key, "left_semi")
    # A row without words links to nothing, so its repetitions stay.
    named = named.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(key))).withColumn(wordy, F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return named.where((F.col(n) == 1) | ~F.col(wordy)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
