"""The SQL of the base tables, for the oracles, and rounding for comparable doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINTS = "points AS (SELECT vec_id AS point_id, vec_id + 1 AS target, left((vec_id + 1)::VARCHAR, 1)::INT AS leading_digit, length((vec_id + 1)::VARCHAR)::INT AS digit_count, label FROM embeddings)"
CUBE = "cube AS (SELECT l::INT AS level, vec_id AS point_id, list_transform(embedding[16 * l + 1 : 16 * l + 16], lambda x: x::DOUBLE) AS vec FROM embeddings, range(4) t(l))"
KNN = CUBE + """, pairs AS (SELECT a.level, a.point_id AS src, b.point_id AS dst, list_distance(a.vec, b.vec) AS dist FROM cube a JOIN cube b ON a.level = b.level AND a.point_id <> b.point_id),
knn AS (SELECT level, src, (row_number() OVER w)::INT AS rank, dst, dist FROM pairs WINDOW w AS (PARTITION BY level, src ORDER BY dist, dst) QUALIFY row_number() OVER w <= 4)"""
EDGES = KNN + ", edges AS (SELECT level, least(src, dst) AS a, greatest(src, dst) AS b, bool_or(src < dst) AS low_to_high, bool_or(src > dst) AS high_to_low, bool_or(src < dst) AND bool_or(src > dst) AS mutual FROM knn GROUP BY ALL)"
LABELLED = KNN + ", " + POINTS + """, rel AS (SELECT k.*, s.target AS st, s.leading_digit AS sd, s.digit_count AS sn, d.target AS dt, d.leading_digit AS dd, d.digit_count AS dn
FROM knn k JOIN points s ON s.point_id = k.src JOIN points d ON d.point_id = k.dst)"""
INTERVALS = """intervals AS (SELECT l_returnflag || '-' || l_linestatus AS diagram, round(l_discount * 100)::BIGINT / 10.0::DOUBLE AS birth,
(round(l_discount * 100)::BIGINT + round(l_tax * 100)::BIGINT + l_partkey % 7) / 10.0::DOUBLE AS death FROM lineitem)"""
BEHAVIOUR = """behaviour AS (SELECT l_returnflag AS task, l_linestatus AS context, l_partkey AS target, l_quantity > 12 AS exact_match, l_partkey % 3 = 0 AS changed,
l_suppkey % 5 = 0 AS leading_zero, l_linenumber >= 6 AS hit_limit FROM lineitem)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places, negative zero as zero: what two engines agree on."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema])
