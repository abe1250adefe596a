"""Principal components and what is read off them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import spearman


def covariance(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, mean, cov): sums of products in one partial aggregation over Arrow batches, centred on a group's first row.

    A task sends one row for each group it saw: what moves grows with groups and tasks, not with points.
    """

    def partial(batches):
        sums: dict = {}
        for f in batches:
            groups = f.groupby(list(keys)) if keys else [((), f)]
            for key, g in groups:
                x = np.array(g["vec"].tolist(), np.float64)
                shift = sums[key][0] if key in sums else x[0]
                x = x - shift
                n, s, p = sums[key][1:] if key in sums else (0, 0.0, 0.0)
                sums[key] = (shift, n + len(x), s + x.sum(0), p + x.T @ x)
        rows = [(*(key if isinstance(key, tuple) else (key,)), int(n), sh.tolist(), s.tolist(), p.ravel().tolist()) for key, (sh, n, s, p) in sums.items()]
        yield pd.DataFrame(rows, columns=[*keys, "n", "shift", "s", "p"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    head = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    parts = vectors.select(*keys, "vec").mapInPandas(partial, head + "n long, shift array<double>, s array<double>, p array<double>")

    def final(f: pd.DataFrame) -> pd.DataFrame:
        shift, n, s, p = None, 0, 0.0, 0.0
        for m, sh, t, q in zip(f["n"], f["shift"], f["s"], f["p"], strict=True):
            sh, t, q = np.array(sh), np.array(t), np.array(q).reshape(len(sh), -1)
            if shift is None:
                shift = sh
            d = sh - shift  # the part's sums about the first part's shift
            n, s, p = n + m, s + t + m * d, p + q + np.outer(d, t) + np.outer(t, d) + m * np.outer(d, d)
        cov = (p - np.outer(s, s) / n) / max(n - 1, 1)
        return pd.DataFrame([{**{k: f[k].iloc[0] for k in keys}, "n": n, "mean": (shift + s / n).tolist(), "cov": cov.ravel().tolist()}])

    return parts.groupBy(*keys).applyInPandas(final, head + "n long, mean array<double>, cov array<double>")


def pca(vectors: DataFrame, k: int = 2, keys: tuple[str, ...] = ("level",)) -> DataFrame:
    """(keys, component, loadings, variance, ratio, mean): the k leading components of each group, by the covariance's eigenvectors."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in f.to_dict("records"):
            d = len(row["mean"])
            values, basis = np.linalg.eigh(np.array(row["cov"]).reshape(d, d))
            values = np.maximum(values, 0)
            total = values.sum()
            for i in range(min(k, d)):
                v = basis[:, d - 1 - i]
                v = v * (1.0 if v[np.abs(v).argmax()] > 0 else -1.0)
                out.append({**{c: row[c] for c in keys}, "component": i + 1, "loadings": v.tolist(), "variance": values[d - 1 - i], "ratio": values[d - 1 - i] / total if total > 0 else None, "mean": row["mean"]})
        return pd.DataFrame(out, columns=[*keys, "component", "loadings", "variance", "ratio", "mean"])

    head = "".join(f"`{c}` {kinds[c]}, " for c in keys)
    return covariance(vectors, *keys).mapInPandas(lambda it: map(solve, it), head + "component int, loadings array<double>, variance double, ratio double, mean array<double>")


def scores(vectors: DataFrame, model: DataFrame, keys: tuple[str, ...] = ("level",)) -> DataFrame:
    """(keys, point_id, component, score): centred projections, signs as the model's."""
    sized = model.select(*keys, "component", "loadings", "mean")
    joined = vectors.join(F.broadcast(sized), list(keys))  # k rows for each group
    centred = F.zip_with("vec", "mean", lambda x, m: x - m)
    dot = F.aggregate(F.zip_with(centred, "loadings", lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
    return joined.select(*keys, "point_id", "component", dot.alias("score"))


def oriented(scores_: DataFrame, points: DataFrame, keys: tuple[str, ...] = ("level",)) -> tuple[DataFrame, DataFrame]:
    """Scores with each component's sign such that it rises with the target, and (keys, component, rho)."""
    joined = scores_.join(points.select("point_id", "target"), "point_id")
    rho = spearman(joined, "score", "target", *keys, "component")
    signed = scores_.join(F.broadcast(rho), [*keys, "component"]).withColumn("score", F.when(F.col("rho") < 0, -F.col("score")).otherwise(F.col("score"))).drop("rho")
    return signed, rho.withColumn("rho", F.abs("rho"))


def group_gaps(scores_: DataFrame, points: DataFrame, group: str = "digit_count") -> DataFrame:
    """(level, grp, mean, gap): group means of the first component and the distance to the group before."""
    means = scores_.where("component = 1").join(points.select("point_id", F.col(group).alias("grp")), "point_id").groupBy("level", "grp").agg(F.avg("score").alias("mean"))
    return means.withColumn("gap", F.abs(F.col("mean") - F.lag("mean").over(Window.partitionBy("level").orderBy("grp"))))


def spacing_fit(gaps: np.ndarray) -> tuple[float, float, float]:
    """(beta, scale, r2) of gaps d_i = scale * beta ** i: the scale in closed form, log beta in [-8, 8] by golden section on a bracket."""
    d = np.asarray(gaps, float)
    i = np.arange(len(d))
    if len(d) < 2 or not np.isfinite(d).all() or not d.any():
        return float("nan"), float("nan"), float("nan")

    def fit(t: float) -> tuple[float, float]:
        u = np.exp(t * i - np.max(t * i))
        s = float(d @ u / (u @ u))
        return float(((d - s * u) ** 2).sum()), s * float(np.exp(-np.max(t * i)))

    grid = np.linspace(-8, 8, 161)
    best = int(np.argmin([fit(t)[0] for t in grid]))
    a, b = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    g = (5**0.5 - 1) / 2
    while b - a > 1e-12:
        c, e = b - g * (b - a), a + g * (b - a)
        if fit(c)[0] < fit(e)[0]:
            b = e
        else:
            a = c
    t = (a + b) / 2
    sse, s = fit(t)
    sst = float(((d - d.mean()) ** 2).sum())
    return float(np.exp(t)), s, 1 - sse / sst if sst > 0 else float("nan")


def layer_metrics(vectors: DataFrame, points: DataFrame, group: str = "digit_count") -> DataFrame:
    """(level, ev_pc1, rho, beta, scale, r2): one row a level; NULL where a value is undefined."""
    model = pca(vectors, 1)
    signed, rho = oriented(scores(vectors, model), points)
    gaps = group_gaps(signed, points, group).where("gap IS NOT NULL").groupBy("level").agg(F.transform(F.array_sort(F.collect_list(F.struct("grp", "gap"))), lambda s: s["gap"]).alias("gaps"))

    @F.pandas_udf("struct<beta: double, scale: double, r2: double>")
    def fitted(g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([spacing_fit(x) for x in g], columns=["beta", "scale", "r2"]).astype(float)

    out = model.select("level", F.col("ratio").alias("ev_pc1")).join(rho.where("component = 1").select("level", "rho"), "level").join(gaps, "level", "left").withColumn("f", fitted("gaps"))
    return out.select("level", "ev_pc1", "rho", *[F.when(~F.isnan(f"f.{c}"), F.col(f"f.{c}")).alias(c) for c in ("beta", "scale", "r2")])


def best_level(metrics: DataFrame, value: str = "ev_pc1", group: str | None = None) -> DataFrame:
    """The level of the largest finite value, the first of equals."""
    w = Window.partitionBy(*([group] if group else [])).orderBy(F.desc(value), "level")
    return metrics.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def procrustes(scores_: DataFrame, keys: tuple[str, ...] = ("level",)) -> DataFrame:
    """(level, other, similarity): nuclear norm of the cross-covariance of two levels' centred, Frobenius-normalised scores."""
    mean = scores_.groupBy("level", "component").agg(F.avg("score").alias("m"), (F.var_pop("score") * F.count("score")).alias("ss"))
    size = mean.groupBy("level").agg(F.sqrt(F.sum("ss")).alias("size"))
    z = scores_.join(F.broadcast(mean), ["level", "component"]).join(F.broadcast(size), "level").select("level", "point_id", "component", ((F.col("score") - F.col("m")) / F.col("size")).alias("z"))
    other = z.select(F.col("level").alias("other"), "point_id", F.col("component").alias("c2"), F.col("z").alias("z2"))
    cross = z.join(other, "point_id").where("level < other").groupBy("level", "other", "component", "c2").agg(F.sum(F.col("z") * F.col("z2")).alias("v"))

    def norm(f: pd.DataFrame) -> pd.DataFrame:
        m = f.pivot(index="component", columns="c2", values="v").fillna(0).to_numpy()
        return pd.DataFrame({"level": [f["level"].iloc[0]], "other": [f["other"].iloc[0]], "similarity": [float(np.linalg.svd(m, compute_uv=False).sum())]})

    return cross.groupBy("level", "other").applyInPandas(norm, "level int, other int, similarity double")


def cross_validated(points: DataFrame, folds: int = 5, degree: int = 3) -> DataFrame:
    """(level, component, basis, r2): out-of-fold fits of scores by the target: a line, a polynomial, and means by leading digit.

    ``points`` holds level, component, target, leading_digit, score; a fold is a block of 100 targets dealt round.
    Tasks sum one product matrix of all bases a fold, which is all that moves; a fold's prediction uses the sums of the others.
    """
    scale = points.groupBy("level", "component").agg(F.avg("target").alias("m"), F.stddev_pop("target").alias("s"), F.avg("score").alias("y"))
    rows = points.join(F.broadcast(scale), ["level", "component"])  # a row a level and component
    spans = {"linear": slice(0, 2), "cubic": slice(2, degree + 3), "digit": slice(degree + 3, degree + 13)}
    keys = ["level", "component", "fold"]

    def partial(batches):
        sums: dict = {}
        for f in batches:
            f = f.assign(fold=(f["target"] // 100) % folds)
            for key, g in f.groupby(keys):
                u = ((g["target"] - g["m"]) / g["s"].where(g["s"] > 0, 1.0)).to_numpy(float)
                y = (g["score"] - g["y"]).to_numpy(float)
                x = np.concatenate([np.vander(u, 2), np.vander(u, degree + 1), np.eye(10)[g["leading_digit"].to_numpy(int)], y[:, None]], 1)
                sums[key] = sums.get(key, 0) + x.T @ x
        yield pd.DataFrame([(*key, p.ravel().tolist()) for key, p in sums.items()], columns=[*keys, "p"])

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        size = degree + 14
        by = np.zeros((folds, size, size))
        for k, p in zip(f["fold"], f["p"], strict=True):
            by[int(k)] += np.array(p).reshape(size, size)
        total, out = by.sum(0), []
        for name, at in spans.items():
            sse = 0.0
            for own in by:
                rest = total - own
                w = np.linalg.lstsq(rest[at, at], rest[at, -1], rcond=None)[0]
                sse += own[-1, -1] - 2 * w @ own[at, -1] + w @ own[at, at] @ w
            out.append((f["level"].iloc[0], f["component"].iloc[0], name, 1 - sse / total[-1, -1] if total[-1, -1] > 0 else None))
        return pd.DataFrame(out, columns=["level", "component", "basis", "r2"])

    sums = rows.select("level", "component", "target", "leading_digit", "score", "m", "s", "y").mapInPandas(partial, "level int, component int, fold int, p array<double>")
    return sums.groupBy("level", "component").applyInPandas(fit, "level int, component int, basis string, r2 double")



def shared_basis(vectors: DataFrame, k: int = 3, slices: int = 64) -> DataFrame:
    """(level, other, n, displacement, scale, relative, pair_correlation): two levels' points in one basis, for every pair of levels.

    All levels' vectors are stacked for the components.  ``displacement`` is the median distance of a point from itself, ``scale`` the root mean square radius
    of the first level's points about their mean, ``relative`` the one over the other, and ``pair_correlation`` that of the distances between pairs of points in the two levels.
    Pairs are each point and the next of its slice of ids, modulo ``slices``: as many as points, and no task orders them all.
    """
    one = vectors.select(F.lit(0).alias("stack"), "level", "point_id", "vec")
    model = pca(one.select("stack", "point_id", "vec"), k, ("stack",))
    center = model.groupBy("stack").agg(F.first("mean").alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("component", "loadings"))), lambda c: c["loadings"]).alias("axes"))  # one row
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    placed = one.join(F.broadcast(center), "stack").withColumn("off", F.zip_with("vec", "mean", lambda p, q: p - q)).select("level", "point_id", F.transform("axes", lambda a: dot("off", a)).alias("p"))
    far = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    nxt = F.lead("p").over(Window.partitionBy("level", F.pmod("point_id", F.lit(slices))).orderBy("point_id"))
    placed = placed.withColumn("pair", far("p", nxt))
    spread = placed.select("level", F.posexplode("p").alias("c", "v")).groupBy("level", "c").agg(F.var_pop("v").alias("v")).groupBy("level").agg(F.sqrt(F.sum("v")).alias("scale"))  # a row a level
    a, b = placed, placed.select(F.col("level").alias("other"), "point_id", F.col("p").alias("q"), F.col("pair").alias("pair2"))
    j = a.join(b, "point_id").where("level < other").withColumn("d", far("p", "q"))
    out = j.groupBy("level", "other").agg(F.count("*").alias("n"), F.median("d").alias("displacement"), F.corr("pair", "pair2").alias("pair_correlation")).join(F.broadcast(spread), "level")
    return out.select("level", "other", "n", "displacement", "scale", F.try_divide("displacement", "scale").alias("relative"), "pair_correlation")


#: The periods of the harmonic bases.
PERIODS = (2, 5, 10, 100, 1000, 3000, 10000)


def _basis_columns(n: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, dict[str, list[int]]]:
    """Every column that a basis uses, for positive targets n and their standard scores u, and which are whose."""
    size = np.floor(np.log10(n) + 1e-9).astype(int)
    lead = n // 10**size
    own = np.eye(9)[lead - 1]
    within = (n / 10.0**size - lead) - 0.4995
    parts = {"power": np.stack([u**k for k in range(4)], 1), "lead": own, "slope": own * within[:, None]}
    for k in (1, 10, 100):
        parts[f"digit{k}"] = np.eye(10)[n // k % 10][:, 1:]
    for p in PERIODS:
        angle = 2 * np.pi * (n % p) / p
        parts[f"T{p}"] = np.cos(angle)[:, None] if p == 2 else np.stack([np.cos(angle), np.sin(angle)], 1)
    at, low = {}, 0
    for k, v in parts.items():
        at[k] = list(range(low, low + v.shape[1]))
        low += v.shape[1]
    line = at["power"][:2]
    pieces = at["lead"] + at["slope"]
    bases = {"linear": line, "cubic": at["power"], "leading_digit": at["lead"], "piecewise_digit_lines": pieces, "decimal_digits": at["lead"] + at["digit1"] + at["digit10"] + at["digit100"]}
    for p in PERIODS:
        bases[f"helix_T{p}"] = line + at[f"T{p}"]
        bases[f"within_digit_T{p}"] = pieces + at[f"T{p}"]
    bases["generalized_decimal"] = line + [c for p in (2, 5, 10, 100, 1000) for c in at[f"T{p}"]]
    bases["generalized_plus_global_bend"] = bases["generalized_decimal"] + at["T10000"]
    return np.concatenate(list(parts.values()), 1), bases


def basis_fits(points: DataFrame, folds: int = 5, seed: int = 1729, block: int = 100) -> DataFrame:
    """(level, basis, split, r2): out-of-fold fits of all of a level's components by the target, for every basis and both ways of folding.

    ``points`` holds level, component, target (positive), score.  ``random`` deals targets into folds by hash, ``block100`` stretches of a hundred.  A task keeps, for each
    level, split and fold, the triangular factor of its rows, columns of all bases and components side by side; factors of parts are stacked and factored again, in a tree,
    and a fold is predicted from the factor of the others.  No product of columns is formed, so ill-conditioned bases lose no digits.  R2 is over all components, about their means.
    """
    kept = points.select("level", "component", F.col("target").cast("long").alias("target"), "score")
    scale = kept.groupBy("level").agg(F.avg("target").alias("m"), F.stddev_pop("target").alias("s"))
    center = kept.groupBy("level", "component").agg(F.avg("score").alias("y"))
    wide = kept.join(F.broadcast(center), ["level", "component"]).groupBy("level", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", (F.col("score") - F.col("y")).alias("v")))), lambda c: c["v"]).alias("y"))
    dealt = lambda what, salt: F.pmod(F.xxhash64(F.lit(seed + salt), what), F.lit(folds)).cast("int")
    rows = wide.join(F.broadcast(scale), "level").withColumn("f", F.explode(F.array(F.struct(F.lit("random").alias("split"), dealt(F.col("target"), 0).alias("fold")), F.struct(F.lit("block100").alias("split"), dealt(F.floor(F.col("target") / block), 1).alias("fold")))))
    keys = ["level", "split", "fold"]
    schema = "level int, split string, fold int, wide int, r array<double>"

    def factor(x: np.ndarray) -> np.ndarray:
        return np.linalg.qr(x, mode="r")

    def partial(batches):
        held: dict = {}
        for f in batches:
            for key, g in f.groupby(keys):
                s = g["s"].to_numpy(float)
                x, _ = _basis_columns(g["target"].to_numpy(np.int64), (g["target"] - g["m"]).to_numpy(float) / np.where(s > 0, s, 1.0))
                part = np.concatenate([x, np.array(g["y"].tolist(), float)], 1)
                held[key] = factor(np.concatenate([held[key], part]) if key in held else part)
        yield pd.DataFrame([(*k, v.shape[1], v.ravel().tolist()) for k, v in held.items()], columns=[*keys, "wide", "r"])

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        r = factor(np.concatenate([np.array(v).reshape(-1, w) for v, w in zip(f["r"], f["wide"], strict=True)]))
        return pd.DataFrame([(*[f[k].iloc[0] for k in keys], r.shape[1], r.ravel().tolist())], columns=[*keys, "wide", "r"])

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        own = [np.array(v).reshape(-1, w) for v, w in zip(f["r"], f["wide"], strict=True)]
        width, bases = _basis_columns(np.array([1]), np.array([0.0]))
        width = width.shape[1]
        total = sum(float((r[:, width:] ** 2).sum()) for r in own)
        out = []
        for name, at in bases.items():
            error = 0.0
            for k, mine in enumerate(own):
                rest = factor(np.concatenate([r for i, r in enumerate(own) if i != k])) if len(own) > 1 else np.zeros_like(mine)
                w = np.linalg.lstsq(rest[:, at], rest[:, width:], rcond=None)[0]
                error += float(((mine[:, width:] - mine[:, at] @ w) ** 2).sum())
            out.append((f["level"].iloc[0], name, f["split"].iloc[0], 1 - error / total if total > 0 else None))
        return pd.DataFrame(out, columns=["level", "basis", "split", "r2"])

    parts = rows.select(*[F.col("f.split").alias("split"), F.col("f.fold").alias("fold")], "level", "target", "m", "s", "y").mapInPandas(partial, schema)
    by_fold = parts.groupBy(*keys).applyInPandas(merged, schema)
    return by_fold.groupBy("level", "split").applyInPandas(fit, "level int, basis string, split string, r2 double")
