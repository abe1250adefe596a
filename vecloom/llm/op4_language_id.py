"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, all but its letters count as one kind of space, and its 1- to 3-grams are hashed to
2 ** BITS buckets.  Executors count buckets by language over the training rows; the matrix of
log-probabilities (a row a language, 128 KB each) is broadcast, ``PART`` languages at once, and batches
are scored in numpy, part after part.  Ties go to the first language in alphabetical order.

Training takes at most about ``PER_LANGUAGE`` documents of each language, those with the least hash of their id.
Null text and text without a letter get `und` and the score 0; with no language learned all do.
Rows that repeat an id are scored each; rows with a null id are never trained on.  The two columns that are added take
underscores before their names where the table has columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, give_back, sliced, table

BITS, ORDERS = 15, (1, 2, 3)
PER_LANGUAGE, PART, SMOOTHING = 3000, 256, 0.5
#: Characters of a batch scored at once.
CHARS = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Each code point's lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram that holds a letter, and each document's number of letters."""
    raw = " ".join(texts).encode("utf-32-le", "surrogatepass")
    code = letters()[np.frombuffer(raw, np.uint32)].astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(code)]
    at, bucket = [], []
    for n in ORDERS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        some = np.zeros(len(h), bool)
        for k in range(n):
            part = code[k : len(h) + k]
            h = h * np.uint64(0x9E3779B97F4A7C15) + part
            some |= part != 0
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        some &= doc[: len(h)] == doc[n - 1 :]
        at.append(doc[: len(h)][some])
        bucket.append((h[some] >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(at) if at else doc, np.concatenate(bucket) if bucket else doc, np.bincount(doc[code != 0], minlength=len(texts))


def pieces(texts: list[str]) -> Iterator[list[str]]:
    """The texts in lists of about CHARS characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


@dataclass
class Bayes:
    languages: list[str]
    logp: Sequence[np.ndarray]  # languages x buckets
    prior: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for part in pieces(texts):
            n = len(part)
            doc, bucket, found = grams(part)
            total = np.stack([np.bincount(doc, row[bucket], n) for row in self.logp]) + self.prior[:, None] if self.languages else np.zeros((1, n))
            best = total.argmax(0)
            with np.errstate(under="ignore"):
                share = 1 / np.exp(total - total.max(0)).sum(0)
            known = (found > 0) & bool(self.languages)
            names += [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            scores.append(np.where(known, share, 0.0))
        return names, np.concatenate([np.zeros(0), *scores])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        lang = np.array(batch.column("lang").to_pylist(), object)
        text = np.array([t or "" for t in batch.column("text").to_pylist()], object)
        for name in sorted(set(lang)):
            for part in pieces(list(text[lang == name])):
                _, bucket, _ = grams(part)
                values, n = np.unique(bucket, return_counts=True)
                yield pa.record_batch([pa.array([name] * len(values), pa.string()), pa.array(values, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: Column | None = None, per_language: int = PER_LANGUAGE) -> Bayes:
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("doc_id IS NOT NULL AND lang IS NOT NULL")
    if train is not None:
        rows = rows.where(train)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(float(per_language)) / F.col("n")
    sample = rows.join(F.broadcast(sizes), "lang").where(share)  # a row a language
    sizes = sizes.collect()
    if not sizes:
        return Bayes([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    counts = sample.select("lang", "text").mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(r["lang"] for r in sizes)
    row = {name: i for i, name in enumerate(languages)}
    c = np.full((len(languages), 1 << BITS), SMOOTHING, np.float32)
    c[[row[x] for x in counts.column("lang").to_pylist()], counts.column("bucket").to_numpy()] += counts.column("n").to_numpy()
    n = {r["lang"]: r["n"] for r in sizes}
    prior = np.log(np.array([n[x] for x in languages], float) / sum(n.values()))
    return Bayes(languages, np.log(c / c.sum(1, keepdims=True, dtype=np.float64)).astype(np.float32), prior)


def language_id(docs: DataFrame, model: Bayes, text_col: str = "text") -> DataFrame:
    """The table with ``lang_pred`` and ``score``."""
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    parts = range(0, max(1, len(model.languages)), PART)
    sent = [sc.broadcast(model.logp[k : k + PART]) for k in parts]
    languages, prior = model.languages, model.prior

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Bayes(languages, [row for part in sent for row in part.value], prior)
        for text in batches:
            names, score = m.predict([t if isinstance(t, str) else "" for t in text])
            yield pd.DataFrame({"lang_pred": names, "score": score})
        give_back()

    taken = [F.col(f"`{c}`") for c in docs.columns]
    found, name, score = (free_name(docs.columns, n) for n in ("found", "lang_pred", "score"))
    out = docs.select(*taken, predict(F.col(text_col).cast("string")).alias(found))
    return out.select(*taken, F.col(f"{found}.lang_pred").alias(name), F.col(f"{found}.score").alias(score))


def _held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, train=~_held_out())
    found = language_id(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
