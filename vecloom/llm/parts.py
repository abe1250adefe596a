"""Ids of whole texts from those of their words, each different word of a batch encoded once.

No token spans a single space, so a text's ids are those of its parts.  Splitting, telling words apart, finding those that are known
and putting ids together are array operations; only new words reach an encoder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers: some 30 MB of bytes, offsets and ids.
REMEMBERED = 800_000


class Words:
    """Ids of words by the word, from a function that encodes an array of words to all their ids and where each one's begin."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], kind: str):
        self.encode, self.kind = encode, kind
        self.words = pa.array([], pa.string())
        self.ids, self.begin, self.size = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size): ids that hold those of all ``words``, which differ, and where."""
        known = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(known))
        ids, begin = self.encode(new)
        size = np.diff(begin, append=len(ids))
        at = pc.fill_null(known, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[pc.is_null(known).to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        every = np.concatenate([self.ids, ids]), np.concatenate([self.begin, begin + len(self.ids)]), np.concatenate([self.size, size])
        found = every[0], every[1][at], every[2][at]
        if len(self.words) + len(new) > REMEMBERED:  # keep those of this batch: what is frequent is among them
            ids, begin, size = found
            last = np.cumsum(size)
            self.words, self.begin, self.size = words, last - size, size
            self.ids = ids[np.repeat(begin - (last - size), size) + np.arange(size.sum())]
        else:
            self.words, (self.ids, self.begin, self.size) = pa.concat_arrays([self.words, new]), every
        return found


def assembled(texts: pa.Array, words: Words, heads: Callable[[list[str], list[bool]], list[np.ndarray]], first: bool, end: int, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, ``end`` after each, and how many each has.

    ``heads`` gives the ids that a text begins with: of all of it where it has a run of spaces or one at an end, and else of its
    first word if ``first``.  Texts that ``also`` marks are taken whole too.
    """
    if not len(texts):
        return np.zeros(0, words.kind), np.zeros(0, np.int64)
    split = pc.split_pattern(pc.fill_null(texts, ""), " ")
    offset = split.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(split.values.slice(offset[0], offset[-1] - offset[0]))
    offset -= offset[0]
    at = coded.indices.to_numpy().astype(np.int64)
    none = pc.index(coded.dictionary, "").as_py()
    whole = np.zeros(len(texts), bool)
    if none >= 0:
        whole[np.searchsorted(offset, np.flatnonzero(at == none), side="right") - 1] = True
    if also is not None:
        whole |= also
    begin_of = offset[:-1]
    alone = coded.dictionary.take(pa.array(at[begin_of])) if first else pa.array([""] * len(texts))
    own = heads(pc.if_else(pa.array(whole), pc.fill_null(texts, ""), alone).to_pylist(), whole.tolist())
    kept = ~np.repeat(whole, np.diff(offset))
    if first:
        kept[begin_of] = False
    n_words = len(coded.dictionary)
    used = np.zeros(n_words, bool)
    used[at[kept]] = True
    ids, begin, size = words.look(coded.dictionary.filter(pa.array(used)))
    begins, sizes = np.zeros(n_words + len(own) + 1, np.int64), np.zeros(n_words + len(own) + 1, np.int64)
    begins[:n_words][used], sizes[:n_words][used] = begin, size
    sizes[n_words:] = [*map(len, own), 1]
    begins[n_words:] = len(ids) + np.cumsum(sizes[n_words:]) - sizes[n_words:]
    ids = np.concatenate([ids, *own, np.array([end], words.kind)]).astype(words.kind, copy=False)
    # Each text is its head, its other words, and the end.
    n_parts = np.add.reduceat(kept, begin_of).astype(np.int64) + 2
    last = np.cumsum(n_parts)
    order = np.empty(last[-1], np.int64)
    body = np.ones(last[-1], bool)
    body[last - 1] = body[last - n_parts] = False
    order[body], order[last - n_parts], order[last - 1] = at[kept], n_words + np.arange(len(own)), n_words + len(own)
    n = sizes[order]
    ends = np.cumsum(n)
    return ids[np.repeat(begins[order] - (ends - n), n) + np.arange(ends[-1])], np.diff(ends[last - 1], prepend=0)
