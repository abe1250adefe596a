"""An adaptive context-mixing range coder for blocks of token ids below 2 ** 16.

Blocks are independent: each starts from the same prior, so all blocks of a group are coded in
lockstep, one numpy lane a block.  For each id, the id that last followed the two ids before it
(order 2) and the one that last followed the id before it (order 1) are candidates.  The share of the
first candidate mixes, in the logistic domain and with weights that adapt, what order 2, order 1 and
order 0 (the candidate's frequency class) say; the second candidate has a share of the rest; what is left is dealt
by order-0 frequencies: shares of classes of ids that adapt in each block, and within a class those of the group's
table.  An id takes one step of a range coder of 56 bits, whichever of the three it comes from.

Candidates change with every id; shares, weights and classes learn after every ``STEP`` ids, from sums over ``SEEN`` of them.
All arithmetic is on integers, so any machine decodes what another encoded.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np

#: Ids of a block.
BLOCK = 4096
#: Ids after which shares, weights and classes learn, from the first ``SEEN`` of them.
STEP, SEEN = 64, 16
#: Ids of each lane that the coder looks at together: what it holds of them then stays in the cache.
ROWS = 8
SLOTS1, SLOTS2 = 256, 512
#: Classes of a table: at most so many, each of so many slots.
CLASSES, SLOT_BITS = 32, 14
SLOTS = 1 << SLOT_BITS
#: All shares of one step together; the least range before a step.
TOTAL_BITS, LEAST = 36, 1 << 40
_LOW = LEAST - 1
_EDGE = 2047 * 6
_SQUASH = np.array([min(4064, max(32, round(4096 / (1 + math.exp(-max(-4000, min(4000, x)) / 256))))) for x in range(-_EDGE, _EDGE + 1)], np.int16)
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int32)
#: Cells of each share: order 2 by its certainty, order 1 by its certainty and agreement, order 0 by class, second candidate.
_CELLS = (4, 8, CLASSES, 4)
_FIRST = (20000, 12000, 6000, 6000)
#: Of the certainties of orders 2 and 1, the lesser.
_LESS = np.minimum.outer(np.arange(4), np.arange(4))
#: (1 << 32) / (12 + n): a share learns from n ids.
_SHARE = (1 << 32) // (12 + np.arange(SEEN + 1))
#: Numbers as arrays, which NumPy would make of them at every call: certainties << 16, and shifts.
_ONE, _THREE, _FOUR, _CERTAINTY, _SIGN, _ONCE, _TWICE, _MOST = (np.array(x, np.int32) for x in (1, 3, 4, 16, 31, 0x10000, 0x20000, 0x30000))
_HASH1, _HASH2 = np.array(0x9E3779B97F4A7C15, np.uint64), np.array(0xD6E8FEB86659FD93, np.uint64)
_TOP1, _TOP2 = (np.array(64 - (k.bit_length() - 1), np.uint64) for k in (SLOTS1, SLOTS2))


@dataclass
class Table:
    """A group's order-0 frequencies: ids in classes of about equal weight, the most frequent first."""

    ids: np.ndarray  # uint16, by class
    size: np.ndarray  # ids of each class
    share: np.ndarray  # slots of each id; SLOTS in each class

    def __post_init__(self):
        n = len(self.size)
        self.of = np.repeat(np.arange(n), self.size)
        self.klass = np.zeros(1 << 16, np.int32)
        self.klass[self.ids] = self.of
        below = np.cumsum(self.share) - self.share - self.of * SLOTS
        # An id's class, slots below it and slots, in one number.
        self.place = np.zeros(1 << 16, np.int64)
        self.place[self.ids] = self.of << 40 | below << 20 | self.share
        self.slot = np.repeat(self.ids, self.share)

    @classmethod
    def of_ids(cls, ids: np.ndarray) -> Table:
        count = np.bincount(ids, minlength=1 << 16)
        count[0] += 1  # the id that fills the last block
        some = np.flatnonzero(count)
        some = some[np.argsort(-count[some], kind="stable")]
        n, goal, most = count[some], -(-int(count.sum()) // (CLASSES // 2)), (1 << 16) // (CLASSES // 2)
        cut, weight = [0], 0
        for i, c in enumerate(n.tolist()):
            weight += c
            if weight >= goal or i + 1 - cut[-1] >= most:
                cut.append(i + 1)
                weight = 0
        if cut[-1] < len(some):
            cut.append(len(some))
        share = np.empty(len(some), np.int64)
        for x, y in zip(cut, cut[1:], strict=False):
            part = n[x:y]
            share[x:y] = 1 + part * (SLOTS - (y - x)) // part.sum()
            share[x] += SLOTS - share[x:y].sum()
        return cls(some.astype(np.uint16), np.diff(cut), share)

    def to_bytes(self) -> bytes:
        parts = np.array([len(self.size)], "<u4"), self.size.astype("<u4"), self.ids.astype("<u2"), self.share.astype("<u2")
        return zlib.compress(b"".join(p.tobytes() for p in parts), 6)

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        raw = zlib.decompress(data)
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        size = np.frombuffer(raw, "<u4", n, 4).astype(np.int64)
        m = int(size.sum())
        return cls(np.frombuffer(raw, "<u2", m, 4 + 4 * n), size, np.frombuffer(raw, "<u2", m, 4 + 4 * n + 2 * m).astype(np.int64))


class _Model:
    """The state of all lanes; the same for coding and decoding.  Tables of cells hold a row a cell and a column a lane."""

    def __init__(self, lanes: int, table: Table):
        self.n, self.table, self.classes = lanes, table, len(table.size)
        self.lane = np.arange(lanes)
        self.lane32 = self.lane.astype(np.int32)
        # What followed one id, and what followed two, by lane: certainty << 16 | id.
        self.last = np.zeros(lanes * (SLOTS1 + SLOTS2), np.int32)
        self.base1 = self.lane * (SLOTS1 + SLOTS2)
        self.base2, self.base_slot = self.base1 + SLOTS1, self.lane * 256
        self.row = table.klass.astype(np.int64) * lanes
        self.p = [np.full((k, lanes), p, np.int64) for k, p in zip(_CELLS, _FIRST, strict=True)]
        self.weight = [np.full(lanes, 22000, np.int64) for _ in range(3)]
        self.count = np.full((self.classes, lanes), 8, np.int64)
        self.settle()

    def settle(self) -> None:
        """What each cell adds to the mixture, and each class's part of 256, until the next learning."""
        self.st = [_STRETCH.take(p >> 4) for p in self.p[:3]]
        two, one, none = ((st * w >> 16).astype(np.int32) for st, w in zip(self.st, self.weight, strict=True))
        # Of certainties of order 2, of whether both candidates are one, and of certainties of order 1, in this order.
        self.mix = (two[:, None] + (one + _EDGE)).ravel()
        self.mix_class = none.ravel()
        self.second = np.zeros((4, 2, 4, self.n), np.int64)
        self.second[:, 0] = np.clip(self.p[3] >> 4, 32, 4064)[_LESS]
        self.second = self.second.ravel()
        # Quotients of whole numbers that are exact in doubles.
        w = 1 + (self.count * (256 - self.classes) / self.count.sum(0)).astype(np.int64)
        w[0] += 256 - w.sum(0)
        self.part = ((np.cumsum(w, 0) - w << 16) + w).ravel()  # what is below a class, and its part
        self.inverse = np.repeat(np.tile(np.arange(self.classes, dtype=np.uint8), self.n), w.T.ravel())

    def slots(self, one, two, out1, out2) -> None:
        """Places of the order-1 and order-2 entries after the ids ``two``, ``one``."""
        x = one * _HASH1
        np.add((x >> _TOP1).view(np.int64), self.base1, out=out1)
        x += two * _HASH2
        x >>= _TOP2
        np.add(x.view(np.int64), self.base2, out=out2)

    def look(self, c1, c2, k1, k2) -> tuple:
        """Candidates of order 1 and 2 and their certainties << 16: the first, the cells that were asked, and the shares that they give."""
        first = c2 | (c1 & (k2 - _ONE >> _SIGN))  # of order 1 where order 2 has none
        key = (k2 << _THREE | k1) >> _CERTAINTY
        key += ((first ^ c1) - _ONE >> _SIGN) & _FOUR
        key *= self.n
        key += self.lane32
        key, first = key.astype(np.int64), first.astype(np.int64)
        cell = self.row.take(first)
        cell += self.lane
        mixed = self.mix.take(key)
        mixed += self.mix_class.take(cell)
        a = _SQUASH.take(mixed).astype(np.int64)
        low2 = a << 24
        low3 = 4096 - a
        low3 *= self.second.take(key)
        low3 <<= 12
        low3 += low2
        return first, key, cell, a, low2, low3, (1 << TOTAL_BITS) - low3 >> 8

    def learn(self, key, cell, a, hit, hit2, missed) -> None:
        """From arrays of ids (rows) by lanes; ``missed`` holds class and lane of ids that no candidate gave."""
        # How many, how many the first candidate gave and the second gave, and the sum of shares, in one number.
        seen = (1 + (hit.astype(np.int64) << 8) + (hit2.astype(np.int64) << 16) + (a << 24)).ravel()
        by_key = np.bincount(key.ravel(), seen, 32 * self.n).astype(np.int64).reshape(4, 8, self.n)
        by_class = np.bincount(cell.ravel(), seen, CLASSES * self.n).astype(np.int64).reshape(CLASSES, self.n)
        for j, got in enumerate((by_key.sum(1), by_key.sum(0), by_class)):
            h = got >> 8 & 0xFF
            slope = ((4095 * h - (got >> 24)) * self.st[j]).sum(0)
            self.weight[j] = np.clip(self.weight[j] + (slope * 12 >> 15), -(1 << 16), 3 << 15)
            self.p[j] = (self.p[j] * 12 + h * 65535) * _SHARE.take(got & 0xFF) >> 32
        apart = by_key.reshape(4, 2, 4, self.n)[:, 0]
        for k in range(4):
            got = apart[_LESS == k].sum(0)
            h = got >> 16 & 0xFF
            self.p[3][k] = (self.p[3][k] * 12 + h * 65535) * _SHARE.take((got & 0xFF) - (got >> 8 & 0xFF)) >> 32
        self.count += 8 * np.bincount(missed, minlength=self.count.size).reshape(self.count.shape)
        self.settle()


def _after(c: np.ndarray, k: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Entries once ``ids`` have followed: surer by one if they are the candidates, less sure if not, and others from the second time."""
    x = c ^ ids
    sure = (x - _ONE >> _SIGN) & _TWICE
    sure += k
    sure -= _ONCE
    np.maximum(sure, _ONCE, out=sure)
    np.minimum(sure, _MOST, out=sure)
    x &= k - _TWICE >> _SIGN
    x ^= c
    x |= sure
    return x


def _apart(size: int, line: int) -> int:
    """At least ``size``, an odd number of cache lines: lanes that are as far along then don't contend for one place in the cache."""
    return (-(-size // line) | 1) * line


def _lanes(ids: np.ndarray) -> np.ndarray:
    n = -(-len(ids) // BLOCK)
    out = np.zeros((n, BLOCK), np.uint16)
    out.ravel()[: len(ids)] = ids
    return out


def encode(ids: np.ndarray) -> tuple[bytes, list[bytes], list[int]]:
    """The group's table, the ids as coded blocks of BLOCK ids (the last may stand for fewer), and each block's crc32."""
    ids = np.asarray(ids)
    if not len(ids):
        return b"", [], []
    if ids.min() < 0 or ids.max() >= 1 << 16:
        raise ValueError("ids must be below 65536")
    table = Table.of_ids(ids)
    columns = np.ascontiguousarray(_lanes(ids).T)
    n, steps = columns.shape[1], min(BLOCK, len(ids))
    m = _Model(n, table)
    low, span = np.zeros(n, np.int64), np.full(n, 1 << 56, np.int64)
    room = _apart(3 * steps + 2, 16)  # an id takes three words at most
    words, pos = np.zeros(n * room, np.uint32), np.arange(n) * room
    start = pos.copy()
    past = np.zeros((ROWS + 2, n), np.uint64)
    at = np.empty((ROWS, 2, n), np.int64)
    c, k = np.empty((ROWS, 2, n), np.int32), np.empty((ROWS, 2, n), np.int32)
    learnt: list[tuple] = []
    for t in range(0, steps, ROWS):
        if t and t % STEP == 0:
            m.learn(*map(np.concatenate, zip(*learnt, strict=True)))
            learnt.clear()
        now = columns[t : min(t + ROWS, steps)].astype(np.int32)
        h = len(now)
        past[2 : h + 2] = now
        m.slots(past[1 : h + 1], past[:h], at[:h, 0], at[:h, 1])
        for j in range(h):
            e = m.last.take(at[j])
            np.bitwise_and(e, _MOST, out=k[j])
            np.bitwise_xor(e, k[j], out=c[j])
            m.last[at[j]] = _after(c[j], k[j], now[j])
        first, key, cell, a, low2, low3, unit = m.look(c[:h, 0], c[:h, 1], k[:h, 0], k[:h, 1])
        place = table.place.take(now)
        klass = (place >> 40) * n
        klass += m.lane
        hit, hit2 = now == first, now == c[:h, 0]
        part = m.part.take(klass)
        slot = unit * (part & 0xFFFF) >> SLOT_BITS
        lows = np.where(hit, 0, np.where(hit2, low2, low3 + unit * (part >> 16) + slot * (place >> 20 & 0xFFFFF)))
        sizes = np.where(hit, low2, np.where(hit2, low3 - low2, slot * (place & 0xFFFFF)))
        for j in range(h):
            r = span >> TOTAL_BITS
            low += r * lows[j]
            np.multiply(r, sizes[j], out=span)
            short = np.flatnonzero(span < LEAST)
            while len(short):  # twice or more only after an id of very small share
                put, of, left = pos.take(short), low.take(short), span.take(short) << 16
                words[put] = of >> 40
                pos[short], low[short], span[short] = put + 1, (of & _LOW) << 16, left
                short = short[left < LEAST]
        if t % STEP < SEEN:
            learnt.append((key, cell, a, hit, hit2, klass[~(hit | hit2)]))
        past[:2] = past[h : h + 2]
    words[pos] = low + _LOW >> 40
    while len(over := np.flatnonzero(words > 0xFFFF)):  # a carry goes to the word before
        words[over] -= 1 << 16
        words[over - 1] += 1
    data = [words[x : y + 1].astype(">u2").tobytes() for x, y in zip(start.tolist(), pos.tolist(), strict=True)]
    return table.to_bytes(), data, [zlib.crc32(ids[k : k + BLOCK].astype("<u4").tobytes()) for k in range(0, len(ids), BLOCK)]


def _quotient(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of numbers that are not negative."""
    return (x.view(np.uint64) // y.view(np.uint64)).view(np.int64)


def decode(header: bytes, data: list[bytes], crcs: list[int], n: int) -> np.ndarray:
    """The ``n`` ids of coded blocks; a block whose checksum differs is an error."""
    if not data:
        return np.zeros(0, np.uint16)
    table = Table.from_bytes(header)
    lanes, steps = len(data), min(BLOCK, n)
    # The first seven bytes of a block are the coder's first value; what follow are its words.
    width = _apart(max(map(len, data)) // 2 + 8, 32)
    raw = np.zeros((lanes, 2 * width + 8), np.uint8)
    for row, d in zip(raw, data, strict=True):
        row[: len(d)] = np.frombuffer(d, np.uint8)
    x = np.zeros(lanes, np.int64)
    for k in range(7):
        x = x << 8 | raw[:, k]
    words = np.ascontiguousarray(raw[:, 7 : 7 + 2 * width]).view(">u2").astype(np.uint16).ravel()
    m = _Model(lanes, table)
    pos = np.arange(lanes) * width
    span = np.full(lanes, 1 << 56, np.int64)
    columns = np.zeros((BLOCK, lanes), np.uint16)
    two, one = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
    at = np.empty((2, lanes), np.int64)
    # What is drawn by order 0, the second candidate, the first: their ids, and their parts of the range.
    of, under, size = np.empty((3, lanes), np.int64), np.zeros((3, lanes), np.int64), np.empty((3, lanes), np.int64)
    for t in range(0, steps, STEP):
        h = min(STEP, steps - t)
        seen = min(h, SEEN)
        keys, cells, shares, classes = (np.empty((seen, lanes), np.int64) for _ in range(4))
        hits, hits2 = np.empty((seen, lanes), bool), np.empty((seen, lanes), bool)
        for j in range(h):
            m.slots(one, two, at[0], at[1])
            e = m.last.take(at)
            k = e & _MOST
            c = e ^ k
            of[2], key, cell, a, low2, low3, unit = m.look(c[0], c[1], k[0], k[1])
            of[1] = c[0]
            r = span >> TOTAL_BITS
            below2 = np.multiply(r, low2, out=size[2])
            below3 = r * low3
            np.subtract(below3, below2, out=size[1])
            under[1] = below2
            pick = ((x < below2).view(np.int8) + (x < below3).view(np.int8)).astype(np.int64)
            pick *= lanes
            pick += m.lane
            p = x - below3
            np.maximum(p, 0, out=p)
            ru = r * unit
            klass = m.inverse.take(np.minimum(_quotient(p, ru), 255) + m.base_slot).astype(np.int64)
            place_of = klass * lanes
            place_of += m.lane
            part = m.part.take(place_of)
            ru *= part >> 16
            p -= ru
            unit *= part & 0xFFFF
            unit >>= SLOT_BITS
            r *= unit
            inner = _quotient(p, r)
            np.minimum(inner, SLOTS - 1, out=inner)
            klass <<= SLOT_BITS
            inner += klass
            of[0] = drawn = table.slot.take(inner)
            place = table.place.take(drawn)
            np.multiply(r, place & 0xFFFFF, out=size[0])
            place >>= 20
            place &= 0xFFFFF
            place *= r
            place += ru
            np.add(place, below3, out=under[0])
            now = of.take(pick)
            x -= under.take(pick)
            span = size.take(pick)
            short = np.flatnonzero(span < LEAST)
            while len(short):
                get, left = pos.take(short), span.take(short) << 16
                x[short] = x.take(short) << 16 | words.take(get, mode="clip")
                pos[short], span[short] = get + 1, left
                short = short[left < LEAST]
            columns[t + j] = now
            m.last[at] = _after(c, k, now.astype(np.int32))
            two, one = one, now.view(np.uint64)
            if j < seen:
                keys[j], cells[j], shares[j], classes[j], hits[j], hits2[j] = key, cell, a, place_of, now == of[2], now == of[1]
        m.learn(keys, cells, shares, hits, hits2, classes[~(hits | hits2)])
    ids = np.ascontiguousarray(columns.T).ravel()[:n]
    for k, crc in enumerate(crcs):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k}: checksum differs")
    return ids
