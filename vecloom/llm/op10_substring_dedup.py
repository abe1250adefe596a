"""Substring dedup by recompression.

Every text is parsed in rounds: the first names runs of a word, each later one names pairs of
neighbouring symbols, a symbol being the left or the right half by a coin that its own name
tosses.  A name is a 64-bit function of what it stands for, so all executors give equal
symbols equal names, and equal stretches of text share all symbols but a few at either end.

Each window of ``WINDOW`` words has an anchor: the first symbol, of the highest round, that lies
inside it whatever stands around it.  Equal windows have equal anchors, so windows travel to the part
that their anchor's name picks, a stretch of neighbouring windows in one packed record (a window whose
anchor is of a low round, which may be common, goes to a part by its hash too).  There, an anchor and a 64-bit hash
of all words that meet again propose their windows.  A batch first proposes what repeats within itself and sends each
different window once, and a part keeps one of each, so a passage of a third of all documents is never gathered.

What is proposed is verified by its words: a cryptographic digest of every proposed window is counted over the
corpus, and a window whose words occur nowhere else is refuted.  So names and hashes that clash change nothing.

Null text counts as empty.  A document of fewer than WINDOW words is left as it is.  Rows that
repeat an id (or have none) are documents of their own.  The words kept are joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, sliced, staged, table
from .words import BASE, U, Words, batch_words, mix, powers

WINDOW, ROUNDS = 35, 8
#: Anchors of a lower round share a part with others of their hash alone; bits of a window's hash.
LOW_ROUND, BITS = 4, 63
#: Bytes of documents in which repeats are looked for at once, before anything is sent.
BATCH = 1 << 20
#: Bytes of records a part is to hold, and bytes of record for a character of text.
PART_BYTES, PER_CHAR = 16 << 20, 1.8
SEGMENT = np.dtype([("name", "<u8"), ("doc", "<u4"), ("first", "<u4"), ("n", "<u2")])


def window_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of every WINDOW consecutive words, whatever document they are in."""
    p, q = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ U(0x1234567)) * p[: len(h)], out=total[1:])
    n = len(h) - WINDOW + 1
    return mix((total[WINDOW:] - total[:n]) * q[:n])


def anchors(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that start at words ``at``: the name of the anchor and its place.

    ``a`` and ``b`` bound the symbols of the round that lie inside a window and are the same in every
    equal window: a symbol at an edge that may join one outside is given up.
    """
    a, b = at.copy(), at + WINDOW
    name, place = mix(h[a]), a * (ROUNDS + 2)
    # Runs of a word.
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    up = np.cumsum(new) - 1
    length = np.diff(np.append(first, len(h))).astype(np.uint64)
    symbol = np.where(length > 1, mix(h[first] * U(BASE) + length), h[first])
    where, of = first, doc[first]
    a, b = up[a] + 1, up[b - 1]
    live = np.flatnonzero(a < b)
    for r in range(1, ROUNDS + 1):
        a, b = a[live] if r == 1 else a, b[live] if r == 1 else b
        name[live] = mix(symbol[a] + U(r))
        place[live] = where[a] * (ROUNDS + 2) + r
        right = (mix(symbol ^ U(r * 0x9E37)) & U(1)).astype(bool)
        a, b = a + right[a], b - ~right[b - 1]
        keep = a < b
        live, a, b = live[keep], a[keep], b[keep]
        if not len(live) or r == ROUNDS:
            break
        second = np.zeros(len(symbol), bool)
        second[1:] = ~right[:-1] & right[1:] & (of[1:] == of[:-1])
        first = np.flatnonzero(~second)
        up = np.cumsum(~second) - 1
        pair = np.append(second[1:], False)[first]
        left = symbol[first]
        symbol = np.where(pair, mix(left * U(BASE) + symbol[np.minimum(first + 1, len(symbol) - 1)] + U(r)), left)
        where, of = where[first], of[first]
        a, b = up[a], up[b - 1] + 1
    return name, place


def _ranges(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Windows as stretches of neighbouring ones, a row each: document, first, number."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return np.stack([doc[first], start[first], np.diff(np.append(first, len(doc)))], 1).astype("<i8")


def _groups(name: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows with one anchor and hash: an order that brings them together, the place of each group in it, its size."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    other = name[order[1:]] != name[order[:-1]]
    if (same & other).any():  # a hash under two anchors: by both
        order = np.lexsort((h, name))
        same, other = h[order[1:]] == h[order[:-1]], name[order[1:]] != name[order[:-1]]
    new = np.ones(len(order), bool)
    new[1:] = ~same | other
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def _sent(w: Words, ids: np.ndarray, parts: int, bits: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Records of one slice of documents: (part, ids, segments, hashes), and one without ids: the repeats it found itself."""
    count = np.diff(w.offset)
    if not len(w.hash) or count.max() < WINDOW:
        return
    doc = np.repeat(np.arange(len(count)), count)
    start = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :])
    h = (window_hashes(w.hash)[start] >> U(63 - bits)) >> U(1) << U(1)
    name, place = anchors(w.hash, doc, start)
    order, first, times = _groups(name, h)
    again = np.zeros(len(start), bool)
    again[order] = np.repeat(times > 1, times)
    own = doc[start]
    if again.any():
        yield int(ids[0] % parts), b"", b"", _ranges(ids[own[again]], start[again] - w.offset[own[again]]).tobytes()
    keep = np.sort(order[first])
    start, h, own, again, name, place = (x[keep] for x in (start, h, own, again, name, place))
    low = place % (ROUNDS + 2) < LOW_ROUND
    part = mix(name ^ np.where(low, h + U(1), U(0))) % U(parts)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | low[1:]
    at = np.flatnonzero(new)
    segment = np.zeros(len(at), SEGMENT)
    segment["name"], segment["doc"], segment["first"] = name[at], own[at], start[at] - w.offset[own[at]]
    n = np.diff(np.append(at, len(start)))
    segment["n"] = n
    order = np.argsort(part[at], kind="stable")
    worder = np.argsort(np.repeat(part[at], n), kind="stable")
    sorted_part, segment, h = part[at][order], segment[order], (h | again.astype(np.uint64))[worder]
    edge = np.append(0, np.cumsum(segment["n"], dtype=np.int64))
    cut = np.flatnonzero(np.append(True, sorted_part[1:] != sorted_part[:-1]))  # the parts that occur, however many there are
    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(segment)], strict=True):
        s = segment[x:y].copy()
        docs, s["doc"] = np.unique(s["doc"], return_inverse=True)
        yield int(sorted_part[x]), ids[docs].tobytes(), s.tobytes(), h[edge[x] : edge[y]].tobytes()


_RECORD = "part int, ids binary, segments binary, hashes binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "ids", "segments", "hashes"])


class _Part:
    """One of each different window that has come, and whether it has been proposed."""

    def __init__(self):
        self.windows = [np.zeros(0, k) for k in ("<u8", "<u8", "<i8", "<i8")]  # anchor, hash and mark, document, start

    def add(self, ids: list[bytes], segments: list[bytes], hashes: list[bytes]) -> np.ndarray:
        """The windows that are known to repeat by now and have not been proposed."""
        base = np.cumsum([0, *[len(x) // 8 for x in ids]])
        seg = np.frombuffer(b"".join(segments), SEGMENT)
        batch = np.repeat(np.arange(len(ids)), [len(x) // SEGMENT.itemsize for x in segments])
        owner = np.frombuffer(b"".join(ids), "<i8")[base[batch] + seg["doc"]]
        n = seg["n"].astype(np.int64)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(seg["first"], n)
        new = np.repeat(seg["name"], n), np.frombuffer(b"".join(hashes), "<u8"), np.repeat(owner, n), start
        name, h, doc, start = (np.concatenate(x) for x in zip(self.windows, new, strict=True))
        order, first, times = _groups(name, h >> U(1))
        again = np.zeros(len(order), bool)
        again[order] = np.repeat(times > 1, times)
        out = again & (h & U(1) == 0)  # the others are marked: they have been proposed
        keep = order[first]
        # A mark on any of a group is kept on the one that stays.
        marked = np.bitwise_or.reduceat(h[order], first) & U(1) if len(first) else h
        self.windows = [name[keep], (h[keep] >> U(1) << U(1)) | marked | (times > 1).astype(np.uint64), doc[keep], start[keep]]
        return _ranges(doc[out], start[out])


def repeated(docs: DataFrame, parts: int, bits: int = BITS) -> DataFrame:
    """(doc, first, n): stretches of windows that may repeat."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for w in batch_words(batch.column("text"), BATCH):
                rows, size = [], 0
                for row in _sent(w, ids[w.first : w.first + len(w.offset) - 1], parts, bits):
                    rows.append(row)
                    size += sum(map(len, row[1:]))
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)
        give_back()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: dict[int, _Part] = {}
        for batch in sliced(batches, "hashes", 1 << 20, 8 << 20):
            done, came = [], {}
            for p, *data in zip(*[batch.column(c).to_pylist() for c in ("part", "ids", "segments", "hashes")], strict=True):
                if data[0]:
                    for k, x in zip(came.setdefault(p, ([], [], [])), data, strict=True):
                        k.append(x)
                else:
                    done.append(np.frombuffer(data[2], "<i8").reshape(-1, 3))
            done += [part.setdefault(p, _Part()).add(*data) for p, data in came.items()]
            out = np.concatenate([np.zeros((0, 3), np.int64), *done])
            for i in range(0, len(out), 100_000):
                rows = out[i : i + 100_000]
                yield pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2].astype(np.int32))], ["doc", "first", "n"])
        part.clear()
        give_back()

    sent = docs.mapInArrow(send, _RECORD).repartitionById(parts, F.col("part"))
    return sent.mapInArrow(settle, "doc long, first int, n int")


def starts_of(first: np.ndarray, n: np.ndarray, refuted: list[int] = ()) -> np.ndarray:
    """The windows of stretches, each once, without those that are refuted."""
    at = np.unique(np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()))
    return at[~np.isin(at, refuted)] if len(refuted) else at


def kept_words(words: list[bytes], starts: np.ndarray) -> list[bytes]:
    if not len(starts):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))


def digests(words: list[bytes], starts: np.ndarray) -> bytes:
    """16 bytes for each window: a digest of its words."""
    if not len(starts):
        return b""
    text = b" ".join(words)
    at = np.cumsum([0, *[len(x) + 1 for x in words]])
    return b"".join([blake2b(text[x:y], digest_size=16).digest() for x, y in zip(at[starts].tolist(), (at[starts + WINDOW] - 1).tolist(), strict=True)])


_CUT = "doc long, doc_id long, n_words long, n_removed long, kept string, starts binary, digests binary"


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        rows, none = [], np.zeros(0, np.int64)
        lists = batch.column("ranges")
        cut, flat = lists.offsets.to_numpy(), lists.values
        first, length = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        found = [(first[x:y], length[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for doc, i, t, r, no in zip(*[batch.column(c).to_pylist() for c in ("doc", "doc_id")], batch.column("text").cast(pa.binary()).to_pylist(), found, batch.column("refuted").to_pylist(), strict=True):
            words = (t or b"").split()
            starts = starts_of(*r, no or []) if len(r[0]) else none
            kept = kept_words(words, starts)
            text = b" ".join(kept)
            rows.append((doc, i, len(words), len(words) - len(kept), sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"), starts.astype("<u4").tobytes(), digests(words, starts)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _CUT.split(", ")])
    give_back()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "digests"):
        for doc, s, d in zip(*[batch.column(c).to_pylist() for c in ("doc", "starts", "digests")], strict=True):
            n = len(s) // 4
            yield pa.record_batch([pa.array(np.full(n, doc)), pa.array(np.frombuffer(s, "<u4").astype(np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(d)]).cast(pa.binary())], ["doc", "start", "digest"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, bits: int = BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` is the text that is left, or its sha256 if ``digest``.

    ``bits`` of a window's hash are used; fewer cost time and change nothing else.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if slim.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        rows = slim.withColumn("doc", F.col("doc_id"))
    else:  # ids don't tell rows apart: number them
        rows = staged(slim.withColumn("doc", F.monotonically_increasing_id()), "op10-rows")
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(chars * PER_CHAR / PART_BYTES) + 1)
    found = staged(repeated(rows.select("doc", "text"), parts, bits), "op10-repeats")

    def cut(rows: DataFrame, refuted: DataFrame | None = None) -> DataFrame:
        ranges = found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("first", "n")).alias("ranges"))
        joined = rows.join(ranges.hint("merge"), F.col("doc") == F.col("_doc"), "left")
        joined = joined.withColumn("refuted", F.lit(None).cast("array<int>")) if refuted is None else joined.join(refuted.hint("merge"), "doc")
        return joined.select("doc", "doc_id", "text", "ranges", "refuted").mapInArrow(lambda b: _cut(b, digest), _CUT)

    done = staged(cut(rows), "op10-cut")
    each = done.where("octet_length(starts) > 0").select("doc", "starts", "digests").mapInArrow(_windows, "doc long, start int, digest binary")
    alone = each.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc").alias("doc"), F.min("start").alias("start")).where("n = 1")
    refuted = staged(alone.groupBy("doc").agg(F.collect_list("start").alias("refuted")), "op10-refuted")
    if not refuted.isEmpty():  # a hash has clashed: the documents of its windows are cut again
        again = cut(rows.join(refuted.select("doc").hint("merge"), "doc", "left_semi"), refuted)
        done = done.join(refuted.select("doc").hint("merge"), "doc", "left_anti").unionByName(again)
    return done.select("doc_id", "n_words", "n_removed", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


#: Windows as lists of words, counted; too slow on whole large tables, so it serves the tests alone.
BRUTE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
x AS (SELECT s.doc_id, s.i, array_to_string(w.ws[i:i+34], ' ') AS t FROM s JOIN w USING (doc_id)),
r AS (SELECT t FROM x GROUP BY t HAVING count(*) > 1)
SELECT doc_id, i FROM x SEMI JOIN r USING (t)
"""
