"""What spanning trees say of single linkage: the order of its leaves, agreement with labels at every merge, and checks of stored trees.

Leaves lie in such an order that every cluster of single linkage is a run of neighbours; between two neighbours stands the merge that
joins what ends with the one and what begins with the other.  A merge's clusters reach to the next later merge on either side, and the longest
edge on the tree's path between two leaves is the largest merge between them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .graph import components
from .knn import BLOCK, BLOCK_BYTES, SPREAD, half_cells, paired, places, squares

#: Labels whose counts along the leaves are held at once.
LABELS = 64


def linkage(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the leaves in order, the merge after each but the last, the merges' lengths, which ascend) of a tree's edges."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    by = np.lexsort((b, a, length))
    ends = code.reshape(2, -1)[:, by].T.tolist()
    up, last, after, merge = list(range(len(ids))), list(range(len(ids))), [-1] * len(ids), [-1] * len(ids)

    def top(i: int) -> int:
        path = []
        while up[i] != i:
            path.append(i)
            i = up[i]
        for p in path:
            up[p] = i
        return i

    for k, (i, j) in enumerate(ends):
        i, j = top(i), top(j)  # a cluster goes by its first leaf
        after[last[i]], merge[last[i]] = j, k
        up[j], last[i] = i, last[j]
    order, at = [], next(i for i in range(len(ids)) if up[i] == i)
    while at >= 0:
        order.append(at)
        at = after[at]
    return ids[order], np.array([merge[i] for i in order[:-1]], np.int64), np.asarray(length)[by]


def reaches(merge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest on either side where a later merge stands; -1 and the number of places where none does."""
    n = len(merge)
    low, high, open_ = np.full(n, -1), np.full(n, n), []
    for i, m in enumerate(merge.tolist()):
        while open_ and merge[open_[-1]] < m:
            high[open_.pop()] = i
        if open_:
            low[i] = open_[-1]
        open_.append(i)
    return low, high


def agreement(order: np.ndarray, merge: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(radius, clusters, adjusted Rand index) after each different merge length; ``label`` are codes in the order of the leaves."""
    n, place = len(order), np.arange(len(merge))
    low, high = reaches(merge)
    together, same = (place - low) * (high - place).astype(float), np.zeros(len(merge))
    sizes = np.bincount(label)
    for first in range(0, len(sizes), LABELS):
        upto = np.zeros((min(LABELS, len(sizes) - first), n + 1))
        np.cumsum(label == np.arange(first, first + len(upto))[:, None], axis=1, out=upto[:, 1:])
        same += ((upto[:, place + 1] - upto[:, low + 1]) * (upto[:, high + 1] - upto[:, place + 1])).sum(0)
    by = np.argsort(merge)
    together, same = np.cumsum(together[by]), np.cumsum(same[by])
    labelled, every = (sizes * (sizes - 1) / 2).sum(), n * (n - 1) / 2
    expected, largest = together * labelled / every, (together + labelled) / 2
    index = np.divide(same - expected, largest - expected, out=np.ones(len(same)), where=largest != expected)
    ends = np.append(lengths[1:] != lengths[:-1], True)
    return lengths[ends], (n - 1 - place)[ends], index[ends]


def merge_curve(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """(level, radius, clusters, ari): agreement of single linkage with ``labels(point_id, label)``, a row for each distinct merge length."""
    joined = tree.join(labels.select(F.col("point_id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("point_id").alias("b"), F.col("label").alias("lb")), "b")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        order, merge, lengths = linkage(f["a"].to_numpy(), f["b"].to_numpy(), f["length"].to_numpy())
        ids, first = np.unique(np.concatenate([f["a"], f["b"]]), return_index=True)
        code = np.unique(np.concatenate([f["la"], f["lb"]])[first], return_inverse=True)[1]
        radius, clusters, index = agreement(order, merge, lengths, code[np.searchsorted(ids, order)])
        return pd.DataFrame({"level": np.int32(f["level"].iloc[0]), "radius": radius, "clusters": clusters, "ari": index})

    return joined.groupBy("level").applyInPandas(run, "level int, radius double, clusters long, ari double")


def tree_checks(vectors: DataFrame, tree: DataFrame, block: int | None = None, room: float = 1e-9) -> DataFrame:
    """(level, check, wrong) of stored trees ``tree(level, a, b, length)``, nothing built anew.

    ``edges``: how many the tree has too few or too many; ``parts``: components beyond one; ``lengths``: edges whose length isn't that of their ends' vectors;
    ``cycles``: pairs of points nearer to each other than the longest edge on the tree's path between them, which no pair is in a least tree.  The last is asked only of levels
    whose edges make one tree.  Points are dealt into blocks in the order of the leaves, so a path's longest edge is a maximum over a stretch: of both blocks' own parts
    and of what lies between them.
    """
    tree = tree.select("level", "a", "b", "length")
    nodes = vectors.select("level", "point_id")
    sizes = nodes.groupBy("level").agg(F.count("*").alias("n"))
    edges = sizes.join(tree.groupBy("level").agg(F.count("*").alias("m")), "level", "left").select("level", F.lit("edges").alias("check"), F.abs(F.coalesce("m", F.lit(0)) - F.col("n") + 1).alias("wrong"))
    parts = components(nodes, tree.where("a <> b")).where("point_id = component").groupBy("level").agg((F.count("*") - 1).alias("wrong")).select("level", F.lit("parts").alias("check"), "wrong")
    found = staged(edges.unionByName(parts), "tree-shape")
    end = lambda c, v: vectors.select("level", F.col("point_id").alias(c), F.col("vec").alias(v))
    far = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    off = tree.join(end("a", "x"), ["level", "a"], "left").join(end("b", "y"), ["level", "b"], "left").withColumn("off", F.coalesce(F.abs(far - F.col("length")) > room * (1 + F.col("length")), F.lit(True)))
    lengths = off.groupBy("level").agg(F.count_if("off").alias("wrong")).select("level", F.lit("lengths").alias("check"), "wrong")
    whole = found.groupBy("level").agg(F.sum("wrong").alias("w")).where("w = 0").select("level")  # a row a level

    def leaves(f: pd.DataFrame) -> pd.DataFrame:
        order, merge, long_ = linkage(f["a"].to_numpy(), f["b"].to_numpy(), f["length"].to_numpy())
        return pd.DataFrame({"level": np.int32(f["level"].iloc[0]), "point_id": order, "place": np.arange(len(order)), "gap": np.append(long_[merge], 0.0)})

    placed = staged(tree.join(F.broadcast(whole), "level").groupBy("level").applyInPandas(leaves, "level int, point_id long, place long, gap double"), "tree-leaves")
    # Blocks as of neighbours: a part of a level, between BLOCK rows and BLOCK_BYTES; floats travel as floats where nothing is lost.
    exact = vectors.where(F.exists("vec", lambda v: v.cast("float").cast("double") != v.cast("double"))).isEmpty()
    most = F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.max(F.size("vec")), F.lit(1))))
    rows = F.greatest(F.lit(BLOCK), F.least(most, F.ceil(F.count("*") / SPREAD))) if block is None else F.lit(block)
    length = vectors.groupBy("level").agg(rows.cast("long").alias("rows"))
    rows = placed.join(vectors.select("level", "point_id", F.col("vec").cast("array<float>" if exact else "array<double>").alias("vec")), ["level", "point_id"]).join(F.broadcast(length), "level").withColumn("block", F.floor(F.col("place") / F.col("rows")).cast("int"))
    rows = rows.groupBy("level", "block").agg(F.array_sort(F.collect_list(F.struct("place", "point_id", "vec", "gap"))).alias("r"))
    rows = rows.select("level", "block", F.transform("r", lambda r: r["point_id"]).alias("ids"), F.flatten(F.transform("r", lambda r: r["vec"])).alias("data"), F.transform("r", lambda r: r["gap"]).alias("gaps"))
    tops = rows.groupBy("level").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", F.array_max("gaps").alias("m")))), lambda s: s["m"]).alias("tops"), F.count("*").cast("int").alias("blocks"))
    packed = staged(rows.join(F.broadcast(staged(tops, "tree-tops")), "level"), "tree-cells")  # a row a level: a number a block

    def nearer(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                x, y = (get(c).astype(float).reshape(n, -1) for c, n in (("data", len(get("ids"))), ("data2", len(get("ids2")))))
                k, m = batch.column("x")[i].as_py(), batch.column("y")[i].as_py()
                p, q = get("gaps"), get("gaps2")
                wrong = 0
                if k != m:
                    between = get("tops")[k + 1 : m].max(initial=0.0)
                    ahead, behind = np.maximum(np.maximum.accumulate(p[::-1])[::-1], between), np.maximum.accumulate(np.append(0.0, q[:-1]))
                for low in range(0, len(x), BLOCK):
                    part = x[low : low + BLOCK]
                    if k == m:
                        path = np.zeros((len(part), len(y) - low))
                        for j in range(len(part)):
                            np.maximum.accumulate(p[low + j : -1], out=path[j, j + 1 :])
                    for low2 in range(low if k == m else 0, len(y), BLOCK):
                        other = y[low2 : low2 + BLOCK]
                        least = path[:, low2 - low : low2 - low + BLOCK] if k == m else np.maximum(ahead[low : low + BLOCK, None], behind[low2 : low2 + BLOCK])
                        least = np.maximum(least - room * (1 + least), 0)
                        # Products propose, with room for their rounding; differences decide.
                        near = least * least
                        near *= 1 + 1e-8
                        row, col = places((squares(part, other) < near) & (least > 0))
                        wrong += int((paired(part, other, row, col) < least[row, col]).sum())
                yield pa.record_batch([pa.array([batch.column("level")[i].as_py()], pa.int32()), pa.array([wrong], pa.int64())], ["level", "wrong"])

    pairs = half_cells(packed, "gaps", "tops").mapInArrow(nearer, "level int, wrong long")
    cycles = pairs.groupBy("level").agg(F.sum("wrong").alias("wrong")).select("level", F.lit("cycles").alias("check"), "wrong")
    return found.unionByName(lengths).unionByName(cycles)
