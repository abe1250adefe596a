"""Exact top-k inner products by best-first search of M-trees.

Vectors are quantised to integers and dealt to the nearest of a bounded sample of pivots, a crowded
pivot's vectors over several trees, so no tree grows with the data.  A tree is bulk-loaded: pages of at most
``PAGE`` entries, each entry with its routing vector, covering radius and distance to its parent.
A search keeps the pages in order of the most that they can hold: by the triangle inequality no
x within r of a routing vector p scores more than q.p + |q| r.  Before q.p is computed, the stored
distance to the parent o gives the bound q.o + |q| (d(p, o) + r); an entry that it rules out is never looked at.
A bounded sample of the rows gives each query a first k-th best score, so most pages are ruled out at once.

Queries are rows, packed into blocks; the trees' roots are rows, packed into pages.  Blocks meet pages in one join, which
leaves, for each tree, the queries that it may answer; those meet the tree in another, some blocks at a time.  Nothing
but a sample is sent to every executor, and the plan is the same however many queries there are.

Vectors that are null, or hold a null or a non-finite component, take no part; vectors of different lengths
don't score against each other; an empty vector scores 0 against empty ones.  Rows that repeat an id are candidates each,
but never for a query of their own id; of rows that repeat a query's id, the least vector (by length, then bytes) asks.
Sums are exact for components of any size: where doubles would not do, candidates are scored in whole numbers.  A score
beyond a long is null, and ranked by its value all the same.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bounded_batches, sliced, staged, table

SCALE = 256
#: Components of vectors that are not wide: below this in size, and their number times its square is below 2 ** 53.
NARROW = 1 << 22
PAGE, TREE = 512, 8192
SAMPLE, PIVOTS, QUERIES = 4096, 128, 2048
#: Blocks of queries that meet a tree at once.
SLICE = 8


def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, wide, v): the vectors that take part, as little-endian int32, or as doubles if they are wide."""
    for batch in sliced(batches, rows=4096):
        ids, out, own, dims, wides = batch.column("vec_id").to_pylist(), [], [], [], []
        column = batch.column("v")
        for i, x in enumerate(column):
            if not x.is_valid or x.values.null_count or ids[i] is None:
                continue
            a = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(a).all():
                continue
            with np.errstate(over="ignore"):
                a = np.clip(np.floor(SCALE * a), -np.finfo(float).max, np.finfo(float).max)
            most = np.abs(a).max(initial=0)
            wide = bool(most >= NARROW or len(a) * most * most >= 1 << 53)
            own.append(ids[i])
            dims.append(len(a))
            wides.append(wide)
            out.append(a.astype("<f8" if wide else "<i4").tobytes())
        yield pa.record_batch([pa.array(own, pa.int64()), pa.array(dims, pa.int32()), pa.array(wides, pa.bool_()), pa.array(out, pa.binary())], ["vec_id", "dim", "wide", "v"])


def matrix(rows: list[bytes], dim: int, wide: bool = False) -> np.ndarray:
    """Rows as doubles."""
    return np.frombuffer(b"".join(rows), "<f8" if wide else "<i4").reshape(len(rows), dim).astype(np.float64)


@dataclass
class Tree:
    """Pages in arrays; node i's entries are child nodes or, in a leaf, rows, ``low[i]`` to ``high[i]``."""

    routing: np.ndarray  # routing vector of each node
    radius: np.ndarray
    parent: np.ndarray  # distance to the parent's routing vector
    low: np.ndarray
    high: np.ndarray
    leaf: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    offset: np.ndarray  # each row's distance to its leaf's routing vector

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        return cls(**np.load(io.BytesIO(data)))


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(-1))


def partition(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Routing rows chosen far apart, and the one that each row is nearest to."""
    chosen = [int(distances(x, x.mean(0)).argmin())]
    near, to = distances(x, x[chosen[0]]), np.zeros(len(x), np.int64)
    while len(chosen) < parts:
        far = int(near.argmax())
        if near[far] == 0:
            break
        d = distances(x, x[far])
        to[d < near] = len(chosen)
        near = np.minimum(near, d)
        chosen.append(far)
    return x[chosen], to


def build(ids: np.ndarray, x: np.ndarray) -> Tree:
    """Bulk-load: split rows around far-apart routing vectors until a page holds them."""
    order, nodes = [], []  # node: [routing, rows, parent, low, high, leaf]
    nodes.append([x.mean(0), np.arange(len(x)), 0.0, 0, 0, False])
    i = 0
    while i < len(nodes):
        routing, rows, *_ = nodes[i]
        if len(rows) <= PAGE:
            nodes[i][5] = True
        else:
            pivots, to = partition(x[rows], max(2, min(PAGE, -(-len(rows) * 2 // PAGE))))
            groups = [rows[to == k] for k in range(len(pivots))]
            if len(pivots) == 1:  # equal vectors: pages of them
                groups = [rows[k : k + PAGE * max(1, len(rows) // PAGE**2)] for k in range(0, len(rows), PAGE * max(1, len(rows) // PAGE**2))]
                if len(groups) == 1:
                    groups = np.array_split(rows, PAGE)
                pivots = np.repeat(pivots, len(groups), 0)
            nodes[i][3] = len(nodes)
            nodes += [[p, g, float(distances(p, routing)), 0, 0, False] for p, g in zip(pivots, groups, strict=True) if len(g)]
            nodes[i][4] = len(nodes)
        i += 1
    n = 0
    radius = np.array([distances(x[g], p).max() for p, g, *_ in nodes])
    offset = []
    for node in nodes:
        if node[5]:
            node[3], node[4] = n, n + len(node[1])
            n = node[4]
            order.append(node[1])
            offset.append(distances(x[node[1]], node[0]))
    rows = np.concatenate(order)
    column = lambda k, kind: np.array([node[k] for node in nodes], kind)
    return Tree(np.array([node[0] for node in nodes]), radius, column(2, float), column(3, np.int64), column(4, np.int64), column(5, bool), ids[rows], x[rows], np.concatenate(offset))


def exact(x: np.ndarray, y: np.ndarray) -> int:
    return sum(int(a) * int(b) for a, b in zip(x.tolist(), y.tolist(), strict=True))


_NINES = str.maketrans("0123456789", "9876543210")


def ordered(value: int) -> str:
    """A text that sorts as the number does: its sign, its length and its digits, those of a negative one turned round."""
    digits = str(abs(value))
    text = f"{len(digits):05d}{digits}"
    return f"1{text}" if value >= 0 else f"0{text.translate(_NINES)}"


def search(t: Tree, query: int, q: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
    """The k best (score, -id) of a tree for one query, none below ``floor``, its own id left out."""
    most = float(np.abs(t.rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q)
    if not most < 1e150:  # bounds would not be numbers: every row is scored
        return heapq.nlargest(k, ((exact(x, q), -int(v)) for x, v in zip(t.rows, t.ids, strict=True) if v != query))
    whole = most < 1 << 53  # doubles are exact
    size = float(np.sqrt(q @ q))
    slack = 1e-9 * (1 + size * (t.radius[0] + float(np.abs(t.routing[0]).max(initial=0)) * len(q)))
    best: list[tuple[int, int]] = []
    least = floor
    top = float(q @ t.routing[0])
    heap = [(-(top + size * t.radius[0]), 0, top)]
    while heap:
        bound, i, own = heapq.heappop(heap)
        if -bound + slack < least:
            break
        low, high = t.low[i], t.high[i]
        if t.leaf[i]:
            may = own + size * t.offset[low:high] + slack >= least
            if 4 * np.count_nonzero(may) > len(may):  # a page as it lies costs less than to pick its rows
                at, score = np.arange(low, high), t.rows[low:high] @ q
                score[~may] = -np.inf
            else:
                at = low + np.flatnonzero(may)
                score = t.rows[at] @ q
            good = [g for g in np.flatnonzero(score >= least - (0 if whole else slack)) if t.ids[at[g]] != query]
            if whole and len(good) > k:  # scores are sums already: few are the best
                cut = np.partition(score[good], len(good) - k)[len(good) - k]
                good = [g for g in good if score[g] >= cut]
            for s, v in sorted(((int(score[g]) if whole else exact(t.rows[at[g]], q), -int(t.ids[at[g]])) for g in good), reverse=True)[:k]:
                if len(best) < k:
                    heapq.heappush(best, (s, v))
                elif (s, v) > best[0]:
                    heapq.heapreplace(best, (s, v))
            if len(best) == k:
                least = max(least, float(best[0][0]) - (0 if whole else slack))
        else:
            at = low + np.flatnonzero(own + size * (t.parent[low:high] + t.radius[low:high]) + slack >= least)
            mine = t.routing[at] @ q
            most = mine + size * t.radius[at]
            for g in np.flatnonzero(most + slack >= least):
                heapq.heappush(heap, (-float(most[g]), int(at[g]), float(mine[g])))
    return best


def floors(q: np.ndarray, ids: np.ndarray, sample: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best reaches for sure: the sample's k-th, its own id left out."""
    if len(sample) <= k:
        return np.full(len(q), -np.inf)
    score = q @ sample.T
    score[ids[:, None] == own[None, :]] = -np.inf
    return np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k]


def index(vectors: DataFrame, some: pd.DataFrame) -> DataFrame:
    """(tree, dim, wide, data): every vector in one of the trees, written to the shared folder; ``some`` is a sample."""
    spark = vectors.sparkSession
    total = vectors.count()
    pivots = {}
    for (dim, wide), f in some.groupby(["dim", "wide"]):
        pivots[int(dim), bool(wide)] = partition(_bounded(matrix(list(f["v"]), int(dim), bool(wide))), min(PIVOTS, 1 + total // 2048))[0]
    sent = spark.sparkContext.broadcast(pivots)  # at most PIVOTS vectors for each length

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=4096):
            dims, wide, v = batch.column("dim").to_numpy(), batch.column("wide").to_numpy(zero_copy_only=False), batch.column("v").to_pylist()
            to = np.zeros(len(v), np.int32)
            for dim, w in {*zip(dims.tolist(), wide.tolist(), strict=True)}:
                at = np.flatnonzero((dims == dim) & (wide == w))
                if (p := sent.value.get((dim, w))) is not None:
                    x = _bounded(matrix([v[i] for i in at], dim, w))
                    to[at] = ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
            yield pa.record_batch([*[batch.column(c) for c in ("vec_id", "dim", "wide", "v")], pa.array(to)], ["vec_id", "dim", "wide", "v", "pivot"])

    own = staged(vectors.mapInArrow(dealt, "vec_id long, dim int, wide boolean, v binary, pivot int"), "op7-dealt")
    trees = own.groupBy("dim", "wide", "pivot").agg(F.ceil(F.count("*") / TREE).cast("int").alias("trees"))
    split = own.join(F.broadcast(trees), ["dim", "wide", "pivot"])  # at most PIVOTS rows for each length
    split = split.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("trees")).cast("int"))

    def grown(f: pd.DataFrame) -> pd.DataFrame:
        dim, wide = int(f["dim"].iloc[0]), bool(f["wide"].iloc[0])
        f = f.sort_values(["vec_id", "v"])
        t = build(f["vec_id"].to_numpy(np.int64), matrix(list(f["v"]), dim, wide))
        return pd.DataFrame({"tree": pd.Series([f"{dim}-{wide}-{f['pivot'].iloc[0]}-{f['part'].iloc[0]}"], dtype=object), "dim": [dim], "wide": [wide], "data": [t.to_bytes()]})

    return staged(split.groupBy("dim", "wide", "pivot", "part").applyInPandas(grown, "tree string, dim int, wide boolean, data binary"), "op7-trees")


def _bounded(x: np.ndarray) -> np.ndarray:
    """For choosing pivots: components too large for squares count as large."""
    return np.clip(x, -1e100, 1e100)


def _packed(ids: np.ndarray, q: np.ndarray, floor: np.ndarray) -> list[bytes]:
    return [ids.astype("<i8").tobytes(), q.astype("<f8").tobytes(), floor.astype("<f8").tobytes()]


def _unpacked(ids: bytes, q: bytes, floor: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(q, "<f8").reshape(len(i), -1) if len(q) else np.zeros((len(i), 0)), np.frombuffer(floor, "<f8")


def _pages(roots: DataFrame, pages: int) -> DataFrame:
    """(dim, page, trees, centre, radius): the roots of some trees in a row."""

    def page(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("tree")
        return pd.DataFrame({"dim": [f["dim"].iloc[0]], "page": [f["page"].iloc[0]], "trees": [list(f["tree"])], "centre": [b"".join(f["centre"])], "radius": [f["radius"].to_numpy("<f8").tobytes()]})

    dealt = roots.withColumn("page", F.pmod(F.xxhash64("tree"), F.lit(pages)).cast("int"))
    return dealt.groupBy("dim", "page").applyInPandas(page, "dim int, page int, trees array<string>, centre binary, radius binary")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, rows=1):
        t = Tree.from_bytes(batch.column("data")[0].as_py())
        yield pa.record_batch([batch.column("tree"), batch.column("dim"), pa.array([t.routing[0].astype("<f8").tobytes()], pa.binary()), pa.array([float(t.radius[0])])], ["tree", "dim", "centre", "radius"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a block of queries and a page of roots: the trees that may answer, and the queries they may."""
    for batch in sliced(batches, rows=1):
        r = batch.to_pylist()[0]
        ids, q, floor = _unpacked(r["ids"], r["q"], r["floor"])
        radius = np.frombuffer(r["radius"], "<f8")
        centre = np.frombuffer(r["centre"], "<f8").reshape(len(radius), -1) if len(r["centre"]) else np.zeros((len(radius), 0))
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.sqrt((q * q).sum(1))[:, None]
            most = q @ centre.T + size * radius[None, :]
            slack = 1e-9 * (1 + size * (radius + np.abs(centre).max(1, initial=0) * q.shape[1])[None, :])
            may = ~(most + slack < floor[:, None])
        rows = [(tree, r["block"] // SLICE, *_packed(ids[m], q[m], floor[m])) for tree, m in zip(r["trees"], may.T, strict=True) if m.any()]
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["tree", "slice", "ids", "q", "floor"])


def top_k(table_: DataFrame, queries: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that satisfy ``queries``, a condition on ``vec_id``."""
    spark = table_.sparkSession
    bounded_batches(spark)
    vectors = table_.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    vectors = staged(vectors.mapInArrow(quantised, "vec_id long, dim int, wide boolean, v binary"), "op7-vectors")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toPandas()
    trees = index(vectors, sample)
    roots = staged(trees.mapInArrow(_roots, "tree string, dim int, centre binary, radius double"), "op7-roots")
    pages = roots.count() // PAGE + 1
    wanted = staged(vectors.where(queries).groupBy("vec_id").agg(F.min(F.struct("dim", "wide", "v")).alias("m")).select("vec_id", "m.*"), "op7-queries")
    blocks = wanted.count() // QUERIES + 1
    sent = spark.sparkContext.broadcast(sample)  # at most SAMPLE rows

    def packed(f: pd.DataFrame) -> pd.DataFrame:
        dim = int(f["dim"].iloc[0])
        q = np.concatenate([matrix([v], dim, w) for v, w in zip(f["v"], f["wide"], strict=True)])
        ids = f["vec_id"].to_numpy(np.int64)
        s = sent.value[sent.value["dim"] == dim]
        x = np.concatenate([np.zeros((0, dim)), *[matrix([v], dim, w) for v, w in zip(s["v"], s["wide"], strict=True)]])
        with np.errstate(over="ignore", invalid="ignore"):
            floor = floors(q, ids, x, s["vec_id"].to_numpy(), k)
            floor = floor - 1e-9 * (1 + np.abs(q).max(1, initial=0) * np.abs(x).max(initial=0) * dim)  # sums may be rounded
        floor = np.where(np.isfinite(floor), floor, -np.inf)
        row = _packed(ids, q, floor)
        return pd.DataFrame({"dim": [dim], "block": [f["block"].iloc[0]], "ids": [row[0]], "q": [row[1]], "floor": [row[2]]})

    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asking = staged(dealt.groupBy("dim", "block").applyInPandas(packed, "dim int, block int, ids binary, q binary, floor binary"), "op7-asking")
    met = asking.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))).join(_pages(roots, pages).hint("shuffle_hash"), ["dim", "page"])
    asked = staged(met.select("block", "ids", "q", "floor", "trees", "centre", "radius").mapInArrow(_asked, "tree string, slice int, ids binary, q binary, floor binary"), "op7-asked")
    ready = trees.select("tree", "data").join(asked.select(F.col("tree").alias("tree"), F.col("slice").alias("slice")).distinct(), "tree")

    def answer(key: tuple, tree: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        t, rows = Tree.from_bytes(tree["data"].iloc[0]), []
        for ids, q, floor in zip(asked["ids"], asked["q"], asked["floor"], strict=True):
            for i, x, f in zip(*_unpacked(ids, q, floor), strict=True):
                rows += [(int(i), -v, s) for s, v in search(t, int(i), x, k, float(f))]
        fits = [s if -(1 << 63) <= s < 1 << 63 else None for *_, s in rows]
        return pd.DataFrame({"query_id": [r[0] for r in rows], "vec_id": [r[1] for r in rows], "score": pd.array(fits, "Int64"), "place": pd.Series([ordered(r[2]) for r in rows], dtype=object)})

    found = ready.groupBy("tree", "slice").cogroup(asked.groupBy("tree", "slice")).applyInPandas(answer, "query_id long, vec_id long, score long, place string")
    w = Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
