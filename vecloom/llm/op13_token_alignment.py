"""Alignment of two tokenizers: groups of tokens between common cuts, links of overlapping tokens, and how often id pairs are linked.

A text, with a space before it, is cut into units before each run of spaces, where no token of either vocabulary can cross (where one could, it isn't
cut), and the different units of some megabytes of documents are encoded and aligned once.  The alignment is array work on all of them
together: running sums of token bytes are the ends, the ends that both have are the cuts, a search among the cuts labels the groups, and a
repeat of each token by the number of tokens that it overlaps makes the links.  What a document has is a sum over its units.

Such a slice of documents is written as lists: its documents' units, its units' links as places in the slice's list of different
id pairs, and how often it has each pair.  Its lists are parted into rows of at most ``PART`` values of each, so neither a row nor the rows that Spark
reads or writes at once grow with a slice.  Pairs are summed over the corpus in two stages, by a salted key and then by the key; each
slice gets the counts of its own pairs back by a join, and adds them up by unit and document.  No count of the corpus is broadcast.

Null and empty texts, and those whose tokens' bytes are not the text's (a character that a tokenizer rewrites), have no tokens: zeros and an
empty ``groups_sha256``.  Strings of special tokens are plain text.  Rows that share an id, or are alike, are documents of their own.
A very long text is a slice of its own, whole.  An empty table gives no rows.  Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, sliced, staged, table
from .op1_token_ids import Encoder, default_tokenizer
from .op9_sentencepiece import default_model
from .words import text_bytes

#: Most bytes of a slice's texts (a document at least), and values of a list in a row.
SLICE, PART = 6 << 20, 512
#: Units whose groups are written out at once, units aligned at once, and words encoded at once.
UNITS, ALIGNED, WORDS = 1 << 17, 1 << 15, 1 << 14
SALTS = 16
_LISTS = {"doc_id": "long", "at": "long", "unit": "int", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "link_at": "long", "link": "int", "key": "long", "n": "long"}
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class _Plain(Encoder):
    """The byte-level vocabulary, to which strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True


def _packed(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and where those of each entry begin and how many there are."""
    size = np.array([len(x) for x in found], np.int64)
    return np.frombuffer(b"".join(found), np.uint8), np.cumsum(size) - size, size


def _gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of ``size`` neighbours from each ``begin`` on, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Pair:
    """Both vocabularies: their encoders, the bytes of their entries and where texts may be cut."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = _Plain(path_a)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # A byte stands for itself where it is a visible character of Latin-1, and the others, in order, for the characters from 256 on.
        own = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
        self.bytes_a = _packed([bytes(byte[c] for c in self.a.tokenizer.id_to_token(i) or "" if c in byte) for i in range(self.a.tokenizer.get_vocab_size())])
        piece = lambda i: bytes([int(self.sp.id_to_piece(i)[3:5], 16)]) if self.sp.is_byte(i) else self.sp.id_to_piece(i).replace("▁", " ").encode()
        pieces = [piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes_b = _packed(pieces)
        self.name = [pa.array(map(str, range(len(x[1])))) for x in (self.bytes_a, self.bytes_b)]
        # Bytes that some token holds just before a space inside it: a text isn't cut after them.
        held = [self.bytes_a[0][x : x + n].tobytes() for x, n in zip(*self.bytes_a[1:], strict=True)] + pieces
        self.bound = np.zeros(256, bool)
        self.bound[[t[k - 1] for t in held for k in range(1, len(t)) if t[k] == 0x20]] = True
        self.bound[0x20] = True

    def _words_a(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each after a space, and where each word's begin.  Those that may not stand in a row of words are encoded alone."""
        data, offsets = text_bytes(words)
        size = np.diff(offsets)
        odd = size == 0
        odd[~odd] = self.bound[data[offsets[1:][~odd] - 1]]
        odd |= pc.match_substring(words, " ").to_numpy(zero_copy_only=False)
        ids, begin = self.a.words(words.filter(pa.array(~odd)))
        alone = [np.array(e.ids, "<u2") for e in self.a.tokenizer.encode_batch_fast([f" {w}" for w in words.filter(pa.array(odd)).to_pylist()], add_special_tokens=False)]
        n = np.zeros(len(words), np.int64)
        n[~odd], n[odd] = np.diff(begin, append=len(ids)), [len(x) for x in alone]
        at = np.zeros(len(words), np.int64)
        at[~odd], at[odd] = begin, len(ids) + np.cumsum(n[odd]) - n[odd]
        return np.concatenate([ids, *alone])[_gathered(at, n)].astype("<u2"), np.cumsum(n) - n

    def _words_b(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        mark, ids, sizes = [self.sp.piece_to_id("▁")], [np.zeros(0, "<u2")], [np.zeros(0, np.int64)]
        for low in range(0, len(words), WORDS):
            found = [x or mark for x in self.sp.encode(words.slice(low, WORDS).to_pylist(), num_threads=1)]  # a space alone is its mark
            sizes.append(np.array([len(x) for x in found], np.int64))
            ids.append(np.fromiter(chain.from_iterable(found), "<u2", sizes[-1].sum()))
        size = np.concatenate(sizes)
        return np.concatenate(ids), np.cumsum(size) - size

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(different units less their first space, each unit's number in order, where each text's begin; one more than texts).  A null or empty text has none."""
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        spaced = pc.if_else(some, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), null_handling="replace", null_replacement=""), pa.scalar("", pa.large_string()))
        data, offsets = text_bytes(spaced)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        cut = data == 0x20
        cut[1:] &= ~self.bound[data[:-1]]
        full = np.unique(offsets[:-1][np.diff(offsets) > 0])
        cut[full] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        size = end - begin - 1
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        keep = np.ones(len(data), bool)
        keep[begin] = False
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(at), pa.py_buffer(data[keep])).dictionary_encode()
        return words.dictionary.cast(pa.string()), words.indices.to_numpy().astype(np.int64), np.searchsorted(begin, offsets)

    def aligned(self, words: pa.Array) -> dict[str, np.ndarray | pa.Array]:
        """Of units, each a space and one of ``words``: the numbers of tokens, groups and links, the groups written out, and their links' id pairs."""
        found = [self._aligned(words.slice(low, ALIGNED)) for low in range(0, max(len(words), 1), ALIGNED)]
        return {k: (pa.concat_arrays if k == "written" else np.concatenate)([f[k] for f in found]) for k in found[0]}

    def _aligned(self, words: pa.Array) -> dict[str, np.ndarray | pa.Array]:
        sides = []
        for encode, (data, begin, size) in ((self._words_a, self.bytes_a), (self._words_b, self.bytes_b)):
            ids, first = encode(words)
            n = np.diff(first, append=len(ids))
            ids = ids.astype(np.int64)
            sides.append((ids, n, data[_gathered(begin[ids], size[ids])], size[ids]))
        want = 1 + pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.full(int(want.sum()), 0x20, np.uint8)
        inside = np.ones(len(text), bool)
        inside[np.cumsum(want) - want] = False
        data, offsets = text_bytes(words)
        text[inside] = data[offsets[0] : offsets[-1]]
        # A unit stands if both sides' bytes are its own.
        good = np.ones(len(words), bool)
        for ids, n, own, size in sides:
            total = np.bincount(np.repeat(np.arange(len(words)), n), size, len(words)).astype(np.int64)
            same = total == want
            x, y = np.cumsum(total) - total, np.cumsum(want) - want
            equal = own[_gathered(x[same], total[same])] == text[_gathered(y[same], want[same])]
            wrong = np.repeat(np.flatnonzero(same), want[same])[~equal]
            good &= same
            good[wrong] = False
        out: dict[str, np.ndarray | pa.Array] = {"good": good}
        ends, tokens = [], []
        for k, (ids, n, _, size) in enumerate(sides):
            here = np.repeat(good, n)
            tokens.append(ids[here])
            ends.append(np.cumsum(size[here]))
            out[("n_a", "n_b")[k]] = np.where(good, n, 0)
        cuts = np.intersect1d(ends[0], ends[1], assume_unique=True)
        unit_end = np.cumsum(np.where(good, want, 0))
        per_unit = lambda at: np.diff(np.searchsorted(at, unit_end, side="right"), prepend=0)
        out["n_groups"] = per_unit(cuts)
        # The tokens of B that each token of A overlaps lie side by side.
        start = np.concatenate([[0], ends[0][:-1]]) if len(ends[0]) else ends[0]
        low, high = np.searchsorted(ends[1], start, side="right"), np.searchsorted(ends[1], ends[0], side="left")
        many = high - low + 1
        link_a, link_b = np.repeat(np.arange(len(ends[0])), many), _gathered(low, many)
        out["key"] = tokens[0][link_a] << 16 | tokens[1][link_b]
        out["n_links"] = np.bincount(np.searchsorted(unit_end, ends[0][link_a], side="left"), minlength=len(words)).astype(np.int64)
        # Groups written out: ids by group and side, groups by unit.
        written = []
        for k in (0, 1):
            label = np.searchsorted(cuts, ends[k], side="left")
            at = np.searchsorted(label, np.arange(len(cuts) + 1))
            written.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), self.name[k].take(pa.array(tokens[k]))), ","))
        groups = pc.binary_join_element_wise(*written, "|")
        at = np.concatenate([[0], np.cumsum(out["n_groups"])])
        out["written"] = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), groups), ";")
        return out


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values between each place and the next."""
    total = np.concatenate([[0], np.cumsum(values)]).astype(np.int64)
    return total[at[1:]] - total[at[:-1]]


def _digests(written: pa.Array, unit: np.ndarray, at: np.ndarray, good: np.ndarray) -> list[str]:
    """The digest of each document's groups; '' of one without tokens.  At most UNITS units are written out at once."""
    out = [""] * (len(at) - 1)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(at, at[i] + UNITS, side="right")) - 1)
        if at[i + 1] - at[i] > UNITS:
            j = i + 1
            if good[i]:
                h = sha256()
                for low in range(int(at[i]), int(at[j]), UNITS):
                    part = written.take(pa.array(unit[low : min(low + UNITS, int(at[j]))]))
                    h.update(b";" * int(low > at[i]) + ";".join(part.to_pylist()).encode())
                out[i] = h.hexdigest()
        else:
            lists = pa.LargeListArray.from_arrays(pa.array(at[i : j + 1] - at[i], pa.int64()), written.take(pa.array(unit[at[i] : at[j]])))
            joined = pc.binary_join(lists, ";").to_pylist()
            for k in range(i, j):
                if good[k]:
                    out[k] = sha256(joined[k - i].encode()).hexdigest()
        i = j
    return out


def _parted(number: int, values: dict[str, object]) -> Iterator[pa.RecordBatch]:
    """Rows of a slice: in each, by its place, at most PART values of every list."""
    lists = {k: pa.array(v, _KINDS[_LISTS[k]]) for k, v in values.items()}
    rows = max(-(-len(v) // PART) for v in lists.values())
    cells = {k: pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(rows + 1) * PART, len(v)), pa.int32()), v) for k, v in lists.items()}
    batch = pa.record_batch({"slice": pa.array(np.full(rows, number)), "place": pa.array(np.arange(rows, dtype=np.int32)), **cells})
    for low in range(0, rows, PART):
        yield batch.slice(low, PART)


def slices(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE) -> DataFrame:
    """Rows of each slice of at most ``size`` bytes of documents: documents, units, links and pair counts, as this module's head says."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, number = pair(path_a, path_b), TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def rows() -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches(held).combine_chunks()
            texts = own["text"].combine_chunks()
            words, unit, at = p.units(texts)
            f = p.aligned(words)
            bad = np.concatenate([[0], np.cumsum(~f["good"][unit])])
            good = bad[at[1:]] == bad[at[:-1]]
            times = np.bincount(unit[np.repeat(good, np.diff(at))], minlength=len(words))
            key, link = np.unique(f["key"], return_inverse=True)
            n = np.bincount(link, np.repeat(times, f["n_links"]), len(key)).astype(np.int64)
            docs_ = {c: np.where(good, _summed(f[c][unit], at), 0) for c in ("n_a", "n_b", "n_groups", "n_links")}
            good &= at[1:] > at[:-1]
            return _parted(number, {"doc_id": own["doc_id"].combine_chunks(), "at": at, "unit": unit.astype(np.int32), **docs_, "groups_sha256": _digests(f["written"], unit, at, good), "link_at": np.concatenate([[0], np.cumsum(f["n_links"])]), "link": link.astype(np.int32), "key": key, "n": n})

        full = 0
        for batch in sliced(batches, "text", 1 << 20, max(size // 8, 1)):
            if held and full + batch.column("text").nbytes > size:
                yield from rows()
                held, full, number = [], 0, number + 1
                give_back()
            held.append(batch)
            full += batch.column("text").nbytes
        if held:
            yield from rows()
        give_back()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "slice long, place int, " + ", ".join(f"{k} array<{v}>" for k, v in _LISTS.items()))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(key, links, best): how many links of the corpus hold each id pair, and whether no pair of its second id has more.  ``rows(slice, key, n)``.

    Summed by key and a salt of the slice first: a frequent pair is in every slice.
    """
    first = rows.groupBy("key", F.pmod(F.xxhash64("slice"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    links = first.groupBy("key").agg(F.sum("n").alias("links")).where("links > 0")
    most = F.max("links").over(Window.partitionBy(F.col("key").bitwiseAND(0xFFFF)))  # as many rows as the first vocabulary at most
    return links.select("key", "links", (F.col("links") == most).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    cut = staged(slices(docs, path_a, path_b, id_col, text_col, size), "op13-slices")
    pairs = cut.select("slice", "place", F.posexplode(F.arrays_zip("key", "n")).alias("pos", "p")).select("slice", (F.col("place") * PART + F.col("pos")).alias("pos"), F.col("p.key").alias("key"), F.col("p.n").alias("n"))
    counts = staged(pair_counts(pairs), "op13-counts")
    back = pairs.where("n > 0").select("slice", "pos", "key").join(counts, "key").select(F.col("slice").alias("part"), "pos", "links", "best")

    def total(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place")
        r = {c: left[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("at", "unit", "link_at", "link", "n_links")}
        width = int(r["link"].max()) + 1 if len(r["link"]) else 0
        links, best = np.zeros(width, np.int64), np.zeros(width, np.int64)
        pos = right["pos"].to_numpy()
        links[pos], best[pos] = right["links"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        by_doc = lambda v: np.where(r["n_links"] > 0, _summed(_summed(v[r["link"]], r["link_at"])[r["unit"]], r["at"]), 0)
        same = {c: left[c].combine_chunks().flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        made = same | {"n_best": pa.array(by_doc(best), pa.int64()), "count_sum": pa.array(by_doc(links), pa.int64())}
        names = [f.split()[0] for f in _OUT.split(", ")]
        return pa.table([made[c] for c in names], names)

    return cut.drop("key", "n").groupBy("slice").cogroup(back.groupBy("part")).applyInArrow(total, _OUT)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), default_tokenizer(), default_model())
