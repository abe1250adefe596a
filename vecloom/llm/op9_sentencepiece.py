"""SentencePiece encoding and decoding, for merge-type models, by backtracking.

A text is cut where no piece can cross (before a space mark that follows another character).
A part is encoded from the longest Aho-Corasick match at each position; a match stands if it
and the piece before it, merged again from characters, come out as the same two pieces; a
position from which no match stands is marked in a bitfield and never tried again.  Parts of a
text repeat, so each worker keeps a bounded table of those it has encoded.

Null text counts as empty: begin and end id alone.  Very long texts are encoded whole.  Rows that repeat an id are
encoded each; an empty table gives no rows.  Columns that are added take underscores before their names where the table
has columns of those names.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, give_back, sliced, table
from .parts import Words, assembled

SPACE = "▁"
#: Entries of a worker's table of encoded parts, and of checked pairs of pieces.
PARTS, PAIRS = 60_000, 300_000


class Model:
    """The pieces of a merge-type model, its exact encoder and its decoder."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        crossing = [p for p in self.id if SPACE in p[1:] and p.strip(SPACE)]
        if crossing or len(self.byte) not in (0, 256):
            raise ValueError("pieces that cross a space mark are not supported")
        # Scores must tell pieces apart for pairs of pieces to decide; those that share one are merged directly.
        seen: dict[float, int] = {}
        for p in self.id:
            if len(p) > 1:
                seen[self.score[p]] = seen.get(self.score[p], 0) + 1
        self.tied = {p for p in self.id if len(p) > 1 and seen[self.score[p]] > 1}
        if any(set(p) != {SPACE} for p in self.tied):
            raise ValueError("pieces other than runs of spaces share a score")
        self.match = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.match.add_word(p, (len(p), i))
        self.match.make_automaton()
        self.size = [len(p) for p in self.piece]
        # Two neighbours that no piece holds side by side always part two pieces.
        self.joined = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.shorter: dict[int, int] = {}
        self.sound: dict[int, bool] = {}
        self.pair: dict[int, bool] = {}
        self.forget()
        # What an id stands for in a decoded text; bytes and unknown ids take the slow way.
        self.text = [p.replace(SPACE, " ") for p in self.piece]
        for i in (self.bos, self.eos):
            if i >= 0:
                self.text[i] = ""
        self.known = Words(self.words, "<u4")
        self.special = np.zeros(n, bool)
        self.special[[*self.byte_of, self.unk]] = True

    def forget(self) -> None:
        """Drop what was remembered of texts: a worker outlives the task.  (Of the model it keeps some pairs.)"""
        self.part: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces by repeated merging of the best adjacent pair, leftmost first among equals."""
        symbols, score = list(text), self.score
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbols) and (both := symbols[i] + symbols[j]) in score:
                heapq.heappush(heap, (-score[both], i, both))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not symbols[i] or (j := after[i]) >= len(symbols) or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in symbols if s]

    def whole(self, piece: int) -> bool:
        """Whether merging the piece's characters gives it back."""
        if (found := self.sound.get(piece)) is None:
            found = self.sound[piece] = self.size[piece] == 1 or self.merged(self.piece[piece]) == [self.piece[piece]]
        return found

    def prefix(self, piece: int) -> int:
        """The longest shorter piece that starts the same; -1 if there is none."""
        if (found := self.shorter.get(piece)) is None:
            text = self.piece[piece]
            found = self.shorter[piece] = next((self.id[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.id), -1)
        return found

    def stands(self, left: int, right: int) -> bool:
        """Whether the two pieces, merged again from their characters, come out as themselves."""
        key = left << 32 | right
        if (found := self.pair.get(key)) is None:
            if len(self.pair) >= PAIRS:
                self.pair.clear()
            x, y = self.piece[left], self.piece[right]
            found = self.pair[key] = x[-1] + y[0] not in self.joined or self.merged(x + y) == [x, y]
        return found

    def backtracked(self, text: str) -> list[int]:
        """The ids of a text whose characters are all pieces."""
        if (one := self.id.get(text)) is not None and self.whole(one):
            return [one]
        n, size = len(text), self.size
        length, longest = [0] * n, [-1] * n
        for end, (k, i) in self.match.iter(text):
            at = end - k + 1
            if k > length[at]:
                length[at], longest[at] = k, i
        failed = 0  # bit i: no pieces from position i on stand
        out: list[int] = []
        at, piece = 0, longest[0]
        while at < n:
            while piece >= 0:
                if not failed >> at + size[piece] & 1 and self.whole(piece) and (not out or self.stands(out[-1], piece)):
                    break
                piece = self.prefix(piece)
            if piece >= 0:
                out.append(piece)
                at += size[piece]
                piece = longest[at] if at < n else -1
                continue
            while piece < 0:  # nothing stands here: what came before has to be shorter
                failed |= 1 << at
                piece = out.pop()
                at -= size[piece]
                piece = self.prefix(piece)
        return out

    def encode_part(self, part: str) -> bytes:
        known, joined, n = self.id, self.joined, len(part)
        cuts = [0, *[k for k in range(1, n) if part[k - 1 : k + 1] not in joined], n]
        if len(cuts) > 2:
            return b"".join([self.lookup(part[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])
        if n == 1 and part not in known:
            ids = [self.byte[b] for b in part.encode("utf-8", "surrogatepass")] if self.byte else [self.unk]
        elif part[:2] == SPACE * 2:
            ids = [known[p] for p in self.merged(part)]
        else:
            ids = self.backtracked(part)
        return array("I", ids).tobytes()

    def lookup(self, part: str) -> bytes:
        """The ids of a part, from the table of the latest parts if it is there."""
        found = self.part.get(part)
        if found is None:
            found = self.older.get(part)
            if found is None:
                found = self.encode_part(part)
            if len(part) <= 64:
                if len(self.part) >= PARTS:
                    self.older, self.part = self.part, {}
                self.part[part] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """All ids, begin and end included."""
        out: list[bytes] = []
        if text:
            words = text.replace(SPACE, " ").replace(" ", " " + SPACE).split(" ")
            words[0] = SPACE + words[0]
            if SPACE in words:  # runs of spaces: each goes with the word after it
                joined, run = [], ""
                for w in words:
                    run += w
                    if w != SPACE:
                        joined.append(run)
                        run = ""
                words = [*joined, run] if run else joined
            out = list(map(self.part.get, words))
            if None in out:
                out = [self.lookup(w) if x is None else x for w, x in zip(words, out, strict=True)]
        return np.frombuffer(array("I", [self.bos]).tobytes() + b"".join(out) + array("I", [self.eos]).tobytes(), "<u4")

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each after a space mark, and where each word's begin."""
        found = [self.lookup(SPACE + w) for w in words.to_pylist()]
        size = np.array([len(x) // 4 for x in found], np.int64)
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """All ids of each text, begin and end included: as ``encode`` gives them, each new word of the batch encoded once."""
        begin, nothing = np.array([self.bos], "<u4"), np.zeros(0, "<u4")
        heads = lambda own, whole: [np.concatenate([begin, self.encode(t)[1:-1] if w else nothing]) for t, w in zip(own, whole, strict=True)]
        plain = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        ids, n = assembled(plain, self.known, heads, False, self.eos)
        return np.split(ids, np.cumsum(n)[:-1]) if len(n) else []

    def decode(self, ids: np.ndarray) -> str:
        text = self.text
        if not self.special[ids].any():
            found = "".join([text[i] for i in ids.tolist()])
        else:
            out, run = [], bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(" ⁇ " if i == self.unk else text[i])
            out.append(run.decode("utf-8", "replace"))
            found = "".join(out)
        return found[1:] if found[:1] == " " else found


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", keep_text: bool = True) -> DataFrame:
    """The table with two more columns: the ids and the text decoded from them."""
    bounded_batches(docs.sparkSession)
    names = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    ids_col, decoded_col = free_name(docs.columns, ids_col), free_name(docs.columns, decoded_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in sliced(batches, text_col, 1 << 20, 4 << 20):
            ids = m.encode_all(batch.column(text_col))
            data = [batch.column(f.name) for f in names]
            at = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) for i in ids], out=at[1:])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.record_batch([*data, pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array([m.decode(i) for i in ids], pa.string())], [*[f.name for f in names], ids_col, decoded_col])
        m.forget()
        give_back()

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in names], f"`{ids_col}` array<int>", f"`{decoded_col}` string"])
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's ids and decoded text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in sliced(batches, "text", 1 << 20, 4 << 20):
            n, a, b = [], [], []
            for ids in m.encode_all(batch.column("text")):
                n.append(len(ids))
                a.append(sha256(ids.tobytes()).hexdigest())
                b.append(sha256(m.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        m.forget()
        give_back()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the documents' columns, whatever their names, and the ids, decoded text and number of ids."""
    found = encoded(docs, default_model())
    return found.withColumn(free_name(found.columns, "n_tokens"), F.size(found.columns[-2]).cast("long"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_model())
