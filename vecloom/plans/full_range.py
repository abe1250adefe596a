"""The full-range study as one plan: neighbours, graph, metrics, projections and overlaps of every level."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph, knn, metrics, project
from .catalog import Catalog


def study(catalog: Catalog, points: DataFrame, vectors: DataFrame, k: int = 4) -> dict[str, DataFrame]:
    """Named results; each is made once for a configuration, and degenerate levels take no part in any."""
    shape, a = catalog.get("degeneration", lambda: metrics.degeneration(vectors))
    valid = vectors.join(shape.where("NOT degenerate").select("level"), "level", "left_semi")
    near, b = catalog.get("knn", lambda: knn.exact_knn(valid, k), (a,))
    edges, c = catalog.get("edges", lambda: graph.union_graph(near), (b,))
    stats, _ = catalog.get("metrics", lambda: metrics.whole_row(near, points, k), (b,))
    model, e = catalog.get("pca", lambda: project.pca(valid, 2), (a,))
    scores, _ = catalog.get("scores", lambda: project.oriented(project.scores(valid, model), points)[0], (e,))
    overlap, _ = catalog.get("overlap", lambda: knn.neighbour_overlap(near, k), (b,))
    transitions, _ = catalog.get("transitions", lambda: metrics.digit_transitions(near, points), (b,))
    return {"degeneration": shape, "knn": near, "edges": edges, "metrics": stats, "pca": model, "scores": scores, "overlap": overlap, "transitions": transitions}
