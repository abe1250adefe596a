"""Means and squared deviations of vectors by group: summed in the tasks, so what moves is a row for each group and task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _merged(n: int, mean: np.ndarray, m2: np.ndarray, m: int, other: np.ndarray, o2: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Two parts' counts, means and squared deviations as one's."""
    d = other - mean
    return n + m, mean + d * (m / (n + m)), m2 + o2 + d * d * (n * m / (n + m))


def moments(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, mean, m2): of ``rows(keys, vec)``, with ``m2`` the sums of squared deviations by component.

    No vector is exploded and none moves; parts are merged about their own means, so clouds far from the origin lose nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "n long, mean array<double>, m2 array<double>"
    names = [*keys, "n", "mean", "m2"]

    def partial(batches):
        sums: dict = {}
        for f in batches:
            for key, g in f.groupby(list(keys), dropna=False):
                x = np.array(g["vec"].tolist(), np.float64)
                mean = x.mean(0)
                part = len(x), mean, ((x - mean) ** 2).sum(0)
                sums[key] = _merged(*sums[key], *part) if key in sums else part
        yield pd.DataFrame([(*key, n, mean.tolist(), m2.tolist()) for key, (n, mean, m2) in sums.items()], columns=names)

    def final(f: pd.DataFrame) -> pd.DataFrame:
        out = None
        for n, mean, m2 in zip(f["n"], f["mean"], f["m2"], strict=True):
            part = int(n), np.array(mean), np.array(m2)
            out = _merged(*out, *part) if out else part
        return pd.DataFrame([(*[f[k].iloc[0] for k in keys], out[0], out[1].tolist(), out[2].tolist())], columns=names)

    return rows.select(*keys, "vec").mapInPandas(partial, schema).groupBy(*keys).applyInPandas(final, schema)


def shares(groups: DataFrame, *keys: str) -> DataFrame:
    """(keys, share): the part of the squared deviations that lies between the groups of ``moments``; NULL without any."""
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}

    def share(f: pd.DataFrame) -> pd.DataFrame:
        n, means = f["n"].to_numpy(float), np.array(f["mean"].tolist())  # a row a label
        between = float((n[:, None] * (means - n @ means / n.sum()) ** 2).sum())
        within = float(sum(np.sum(m) for m in f["m2"]))
        total = between + within
        return pd.DataFrame([(*[f[k].iloc[0] for k in keys], min(max(between / total, 0.0), 1.0) if total > 0 else None)], columns=[*keys, "share"])

    return groups.groupBy(*keys).applyInPandas(share, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "share double")
