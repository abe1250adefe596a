"""Token ids as files: a range-coded container in ascending document order.

Documents are range-partitioned by id and sorted, whole texts encoded with the tokenizers library, an end id added to
each, and written as one shard a partition.  A shard is rows of groups, each a number of whole documents:
their ids and lengths, how many ids the shard holds before them, the group's order-0 table, and the ids as independently
reset, checksummed blocks of the adaptive coder in ``id_coder``.  The container is Parquet, so
Spark's own commit protocol writes it to whatever store the path names.

Texts are cut at single spaces, which no token spans (texts where one may, after a no-break space, are not cut), and each different word of some megabytes of them, if it is not known yet, is
encoded once, and so is each different stem of words that differ by what follows it; the ids are those of the whole text.  Null text counts as empty (the end id alone).  A null id comes first;
rows that repeat an id are documents of their own, in the order of their texts' hashes.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, delete_at_exit, give_back, shared_dir, sliced, table
from .id_coder import decode, encode
from .parts import Words, assembled

END = 0
#: Ids after which a group ends, at the end of a document; a shard's last ids, if fewer than half as many, stay with the group before.
GROUP = 6 << 20
#: Bytes of texts whose different words are encoded once.
BATCH = 16 << 20
#: A batch's document ids, their ids, END after each document's, and how many each has.
Encoded = tuple[list, np.ndarray, np.ndarray]
_GROUPS = "shard int, before long, doc_id array<long>, length array<int>, n long, prior binary, block array<binary>, crc array<long>"


#: A word of letters is cut where ASCII that is neither letter nor digit follows them, as the byte-level pattern always cuts there.
_CUT = r"(?s)^(?P<stem>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<rest>[\n!-/:-@\[-`{-~].*)$"


class Parted:
    """Ids of words from those of their stems and of what follows a stem, so one with a comma isn't encoded anew."""

    def __init__(self, stems: Words, rests: Words, uncut: list[str]):
        self.stems, self.rests, self.uncut, self.kind = stems, rests, uncut, stems.kind

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size): ids that hold those of all ``words``, which differ, and where."""
        parts = pc.extract_regex(words, _CUT)
        cut = parts.is_valid()
        for text in self.uncut:
            cut = pc.and_(cut, pc.invert(pc.match_substring(words, text)))
        stem = pc.dictionary_encode(pc.if_else(cut, pc.struct_field(parts, "stem"), words))
        rest = pc.dictionary_encode(pc.struct_field(parts.filter(cut), "rest"))
        ids, begin, size = self.stems.look(stem.dictionary)
        more, begin_more, size_more = self.rests.look(rest.dictionary)
        at, at_more = stem.indices.to_numpy(), rest.indices.to_numpy()
        begin, size, cut = begin[at], size[at], cut.to_numpy(zero_copy_only=False)
        if len(at_more):
            n = np.column_stack([size[cut], size_more[at_more]]).ravel()
            first = np.column_stack([begin[cut], begin_more[at_more] + len(ids)]).ravel()
            last = np.cumsum(n)
            both = np.concatenate([ids, more])
            begin[cut], size[cut] = len(ids) + (last - n)[::2], n[::2] + n[1::2]
            ids = np.concatenate([ids, both[np.repeat(first - (last - n), n) + np.arange(last[-1])]])
        return ids, begin, size


class Encoder:
    """Whole texts to ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        # Tokens may span a space after some characters (a no-break space, in this vocabulary): texts that have those are encoded whole.
        crossing = [self.tokenizer.decode([i]) for i in range(size) if "\u0120" in (self.tokenizer.id_to_token(i) or "").lstrip("\u0120")]
        self.spanned = sorted({t[k - 1 : k + 1] for t in crossing for k in range(1, len(t)) if t[k] == " " != t[k - 1]})
        self.known = Words(self.words, "<u2")
        form = json.loads(self.tokenizer.to_str())
        if form["normalizer"] is None and (form["pre_tokenizer"] or {}).get("type") == "ByteLevel" and form["pre_tokenizer"]["use_regex"]:
            self.known = Parted(self.known, Words(self.rests, "<u2"), [t["content"] for t in form["added_tokens"]])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each after a space, and where each word's begin."""
        out, begin, n = [], [], 0
        cuts = np.append(np.arange(0, len(words), 64), len(words)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), " ")
        for low in range(0, len(texts), 64):
            for k, e in enumerate(self.tokenizer.encode_batch_fast([f" {t}" for t in texts[low : low + 64].to_pylist()], add_special_tokens=False), low):
                ids = np.array(e.ids, "<u2")
                at = np.flatnonzero(self.spaced[ids])
                # Each word begins with the id of a space, and no other id does: those ids part the words.
                if len(at) != cuts[k + 1] - cuts[k]:
                    found = [np.array(x.ids, "<u2") for x in self.tokenizer.encode_batch_fast([f" {w}" for w in words[cuts[k] : cuts[k + 1]].to_pylist()], add_special_tokens=False)]
                    ids, at = np.concatenate(found), np.cumsum([0, *map(len, found[:-1])])
                out.append(ids)
                begin.append(at + n)
                n += len(ids)
        return np.concatenate([np.zeros(0, "<u2"), *out]), np.concatenate([np.zeros(0, np.int64), *begin])

    def rests(self, rests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all that follows stems, and where each one's begin."""
        found = [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(rests.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u2"), *found]), np.cumsum([0, *map(len, found)])[:-1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END after each text, and how many each text has (uint16, int64)."""
        heads = lambda own, _: [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
        also = np.zeros(len(texts), bool)
        for pair in self.spanned:
            also |= pc.fill_null(pc.match_substring(texts, pair), False).to_numpy(zero_copy_only=False)
        return assembled(texts, self.known, heads, True, END, also)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def grouped(encoded: Iterable[Encoded], least: int) -> Iterator[list[Encoded]]:
    """Batches in groups of ``least`` ids or more; last ones that have fewer than half as many stay in the group before.

    All blocks of a group take the same steps of the coder, so a group of few blocks would cost almost as much as a large one.
    """
    held: list[Encoded] = []
    full = more = 0  # batches that make a group, and the ids of those after
    for batch in encoded:
        held.append(batch)
        more += len(batch[1])
        if full and 2 * more >= least:
            yield held[:full]
            del held[:full]
            full = 0
        if not full and more >= least:
            full, more = len(held), 0
    if held:
        yield held


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the container of all rows to ``path``."""
    bounded_batches(docs.sparkSession)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))

        def group(part: list[Encoded]) -> pa.RecordBatch:
            own, data, lengths = zip(*part, strict=True)
            ids = np.concatenate(data)
            table_, blocks, crcs = encode(ids)
            row = (shard, before, [x for o in own for x in o], np.concatenate(lengths), len(ids), table_, blocks, crcs)
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in _GROUPS.split(", ")])

        encoded = ((batch.column("doc_id").to_pylist(), *e.encode(batch.column("text"))) for batch in sliced(batches, "text", 1 << 20, BATCH))
        for part in grouped(encoded, GROUP):
            yield group(part)
            before += sum(len(x[1]) for x in part)
        give_back()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")  # by both, so rows of one id may lie in several partitions
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(groups, _GROUPS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The container's groups: as written, with ``start``, the number of ids of all groups before."""
    rows = spark.read.schema(_GROUPS).parquet(path)
    # A row for each shard: a shard is a partition of the writer, so there are few.
    ends = rows.groupBy("shard").agg(F.max(F.col("before") + F.col("n")).alias("ids")).orderBy("shard").collect()
    starts, total = [], 0
    for r in ends:
        starts.append((r["shard"], total))
        total += r["ids"]
    base = spark.createDataFrame(starts, "shard int, base long")
    return rows.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("before")).drop("base")


def documents(groups: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document of a container."""
    bounded_batches(groups.sparkSession)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=1):
            for g in batch.to_pylist():
                ids = decode(g["prior"], g["block"], g["crc"], g["n"]).astype("<u4")
                at = np.concatenate([[0], np.cumsum(g["length"])]).astype(np.int64)
                crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
                columns = [pa.array(g["doc_id"], pa.int64()), pa.array(at[:-1] + g["start"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
        give_back()

    return groups.select("doc_id", "length", "n", "prior", "block", "crc", "start").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/vecloom/op1-ids-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    write(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return documents(read(spark, path))
