"""Toxicity: a factorization machine over hashed terms.

Terms are a text's lower-case words and the first ``PREFIX`` letters of longer ones, hashed to
2 ** BITS buckets and counted once a document.  The score is the logistic of a bias, a weight
for each bucket and the inner products of the buckets' factors for each pair, so that a pair
(an insult with a group mention) can weigh more than its two terms.

Training takes at most ``TRAIN_ROWS`` labelled rows, those with the least hash of their id (of rows that repeat an id,
one: that of the least hashed terms); their hashed terms, not their texts, reach the driver.  A bucket gets a weight and
factors if its share differs between the labels by ``LEAST_Z`` standard errors, or if, with no such effect of its own, the share
of its pair with another such word differs by ``PAIR_Z``: so terms that matter only together are learned.  The
model has at most 2 ** BITS rows.

Null and empty texts get the score of the bias.  Labels that are null are left out of training; where a
label is missing altogether every score is the base rate (0.5 without labels).  Rows that repeat
an id are scored each.  The score column takes underscores before its name where the table has one of that name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, bounded_batches, free_name, give_back, sliced, table

BITS, PREFIX = 20, 5
TRAIN_ROWS, LEAST_DOCS, LEAST_Z = 12_000, 3, 5.0
#: Rows of label 1 that hold a pair, its standard errors from label 0, and buckets (a power of two) that pairs are counted in.
PAIR_DOCS, PAIR_Z, PAIR_BITS = 8, 9.0, 23
FACTORS, EPOCHS, RATE, DECAY = 6, 40, 0.15, 1e-5
CUT = 0.7
#: Words that a worker remembers the bucket of.
REMEMBERED = 60_000
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


def bucket(term: str) -> int:
    """Even for words, odd for word beginnings."""
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) >> 33 - BITS << 1 | term.endswith("*")


@dataclass
class Machine:
    buckets: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of documents given as indices into ``buckets``."""
        at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        n = len(rows)
        linear = np.bincount(doc, self.weight[at], n)
        total, square = np.zeros((n, FACTORS)), np.zeros(n)
        v = self.factor[at]
        for k in range(FACTORS):
            total[:, k] = np.bincount(doc, v[:, k], n)
        square = np.bincount(doc, (v * v).sum(1), n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * ((total * total).sum(1) - square), -30, 30)))


def apart(c1: np.ndarray, c0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Standard errors between the shares c1 of n1 and c0 of n0."""
    p = (c1 + c0) / (n1 + n0)
    return (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))


def _pairs(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of each row's values and a bucket of each pair, some two million at a time."""
    one, two, size = [], [], 0

    def some() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = np.concatenate(one).astype(np.int64), np.concatenate(two).astype(np.int64)
        return a, b, (a * 0x9E3779B1 + b * 0x85EBCA77 >> 7) & (1 << PAIR_BITS) - 1

    for r in rows:
        for k in range(len(r) - 1):
            one.append(np.full(len(r) - k - 1, r[k]))
            two.append(r[k + 1 :])
            size += len(r) - k - 1
            if size >= 1 << 21:
                yield some()
                one, two, size = [], [], 0
    if size:
        yield some()


def paired(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The values of pairs whose share of rows is larger under label 1; rows hold values without an effect of their own."""
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return np.zeros(0, np.int64)
    toxic, clean = ([r for r, k in zip(rows, y, strict=True) if k == side] for side in (1, 0))
    # As many rows of label 0 as there are of label 1 tell which pairs are worth counting in all.
    some = clean[:: max(1, len(clean) // len(toxic))]
    c1, c0 = (np.zeros(1 << PAIR_BITS, np.int32) for _ in range(2))
    for c, part in ((c1, toxic), (c0, some)):
        for *_, h in _pairs(part):
            c += np.bincount(h, minlength=len(c)).astype(np.int32)
    strong = np.zeros(1 << PAIR_BITS, bool)
    for k in range(0, len(strong), 1 << 20):
        x, y_ = c1[k : k + (1 << 20)], c0[k : k + (1 << 20)]
        strong[k : k + (1 << 20)] = (x >= PAIR_DOCS) & (apart(x, y_, n1, len(some)) >= PAIR_Z / 2)
    del c1, c0
    found = [np.zeros(0, np.int64)]
    for a, b, h in _pairs(toxic):  # buckets may mix pairs, so those of strong ones are counted again
        at = strong[h]
        found.append(a[at] << 32 | b[at])
    pairs, n_1 = np.unique(np.concatenate(found), return_counts=True)
    pairs, n_1 = pairs[n_1 >= PAIR_DOCS], n_1[n_1 >= PAIR_DOCS]
    named = np.zeros(1 << BITS, bool)
    named[pairs >> 32] = named[pairs & 0xFFFFFFFF] = True
    n_0 = np.zeros(len(pairs), np.int64)
    for a, b, _ in _pairs([r[named[r]] for r in clean]) if len(pairs) else ():
        key = a << 32 | b
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        n_0 += np.bincount(at[pairs[at] == key], minlength=len(pairs))
    good = pairs[apart(n_1, n_0, n1, n0) >= PAIR_Z]
    return np.unique(np.concatenate([good >> 32, good & 0xFFFFFFFF]))


def select(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets that tell the labels apart by themselves or in a pair, in order."""
    n, c1 = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for r, k in zip(rows, y, strict=True):  # a row's buckets are distinct
        n[r] += 1
        c1[r] += int(k)
    alone = (np.abs(apart(c1, n - c1, max(y.sum(), 1), max((1 - y).sum(), 1))) >= LEAST_Z) & (n >= LEAST_DOCS)
    rest = ~alone & (c1 >= PAIR_DOCS)
    rest[1::2] = False  # a beginning goes with its word
    return np.union1d(np.flatnonzero(alone), paired([r[rest[r]] for r in rows], y)).astype(np.int64)


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 2) -> Machine:
    """Train on documents given as arrays of distinct buckets, and labels 0 or 1."""
    y = np.asarray(y, float)
    if not len(y):
        return Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    chosen = select(rows, y)
    place = np.full((1 << BITS) + 1, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    found = [p[p >= 0] for p in (place[r] for r in rows)]
    rng = np.random.default_rng(seed)
    base = min(max(y.mean(), 1e-3), 1 - 1e-3)
    m = Machine(chosen, float(np.log(base / (1 - base))), np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), FACTORS)))
    if not len(chosen):
        return m
    n = len(chosen)
    gw, gv, gb = np.full(n, 1e-4), np.full(m.factor.shape, 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for low in range(0, len(y), 256):
            part = order[low : low + 256]
            own = [found[i] for i in part]
            at, doc = np.concatenate(own), np.repeat(np.arange(len(part)), [len(r) for r in own])
            v = m.factor[at]
            total = np.stack([np.bincount(doc, v[:, k], len(part)) for k in range(FACTORS)], 1)
            margin = m.bias + np.bincount(doc, m.weight[at], len(part)) + 0.5 * ((total * total).sum(1) - np.bincount(doc, (v * v).sum(1), len(part)))
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]
            m.bias -= RATE * (g := error.mean()) / np.sqrt(gb := gb + g * g)
            e = error[doc] / len(part)
            touched = np.flatnonzero(np.bincount(at, minlength=n))
            g = np.bincount(at, e, n)[touched] + DECAY * m.weight[touched]
            gw[touched] += g * g
            m.weight[touched] -= RATE * g / np.sqrt(gw[touched])
            for k in range(FACTORS):
                d = np.bincount(at, e * (total[doc, k] - v[:, k]), n)[touched] + DECAY * m.factor[touched, k]
                gv[touched, k] += d * d
                m.factor[touched, k] -= 0.3 * RATE * d / np.sqrt(gv[touched, k])
    return m


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        rows = [np.unique(np.fromiter((bucket(t) for t in terms(x or "")), np.int32)).tobytes() for x in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "buckets"])
    give_back()


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, train: Column | None = None) -> Machine:
    """Fit on the labelled documents whose id satisfies ``train`` (a condition on ``doc_id``)."""
    bounded_batches(docs.sparkSession)
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    if train is not None:
        chosen = chosen.where(train)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))  # an id of several labels is toxic
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most TRAIN_ROWS pairs of numbers, so they can be broadcast
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = text.join(F.broadcast(chosen), "doc_id")
    # Ids may repeat among documents: each trains once, so what reaches the driver is bounded.
    found = found.select("doc_id", "label", "text").mapInArrow(_hashed, "doc_id long, label int, buckets binary")
    found = found.groupBy("doc_id", "label").agg(F.min("buckets").alias("buckets")).select("label", "buckets").toArrow()
    data = sorted(zip(found.column("buckets").to_pylist(), found.column("label").to_pylist(), strict=True))  # one order, however the tasks ended
    del found
    return fit([np.frombuffer(b, np.int32) for b, _ in data], np.array([y for _, y in data]))


def scored(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The table with a score column, every whole text read."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # at most 2 ** BITS rows

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        place = np.full(1 << BITS, -1, np.int32)
        place[m.buckets] = np.arange(len(m.buckets))
        known: dict[str, int] = {}
        for texts in batches:
            found = []
            for low in range(0, len(texts), ARROW_ROWS):
                rows = []
                for t in texts.iloc[low : low + ARROW_ROWS]:
                    own = set()
                    for term in terms(t) if isinstance(t, str) else ():
                        i = known.get(term)
                        if i is None:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            i = known[term] = int(place[bucket(term)])
                        if i >= 0:
                            own.add(i)
                    rows.append(np.array(sorted(own), np.int64))
                found.append(m.score(rows))
            yield pd.Series(np.concatenate([np.zeros(0), *found]))
        give_back()

    return docs.withColumn(free_name(docs.columns, score_col), score(F.col(text_col).cast("string")))


def held_out(n: int, rest: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == rest


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    machine = trained(docs, labels, train=~held_out(3, 1))
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), machine)
    return found.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not rejected, with the columns they came with, whatever their names."""
    machine = trained(docs, table(spark, sf_dir, "labels"), train=~held_out(3, 1))
    score = free_name(docs.columns, "toxicity_score")
    return scored(docs, machine, score_col=score).where(F.col(score) < CUT).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
