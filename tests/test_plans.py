"""Stores, the catalogue, the study, the stream and the entry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import schemas
from vecloom.operators import tasks
from vecloom.plans import catalog, full_range
from vecloom.sources import store, tables
from vecloom.streaming import ingest


def test_level_store_prunes_and_round_trips(spark, data, tmp_path):
    c = tables.cube(spark, data)
    store.write_levels(c, f"{tmp_path}/v")
    got = store.read_level(spark, f"{tmp_path}/v", 2)
    assert got.count() == c.where("level = 2").count()
    assert "PartitionFilters: [isnotnull(level" in got._jdf.queryExecution().toString()


def test_npz_and_infer_sources(spark, tmp_path):
    x = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    np.savez(tmp_path / "a.npz", hidden=x, point_ids=np.array([5, 6, 7], np.int32))
    rows = store.read_npz(spark, str(tmp_path / "a.npz")).orderBy("level", "point_id").collect()
    assert [(r["level"], r["point_id"]) for r in rows] == [(0, 5), (0, 6), (0, 7), (1, 5), (1, 6), (1, 7)] and rows[-1]["vec"] == [20, 21, 22, 23]
    prompts = spark.createDataFrame([(1, "ab"), (2, "c")], "point_id long, prompt string")
    got = store.infer_rows(prompts, lambda s: [np.full((2, 3), len(t)) for t in s]).collect()
    assert len(got) == 4 and {tuple(r["vec"]) for r in got} == {(2, 2, 2), (1, 1, 1)}


def test_manifest(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"x")
    found = store.file_hashes(spark, str(tmp_path / "f"))
    one = found.collect()[0]
    manifest = spark.createDataFrame([(one["path"], one["sha256"]), (one["path"] + "x", "0"), ("../y", "0")], "path string, sha256 string")
    assert sorted(r["problem"] for r in store.verify_manifest(manifest, found).collect()) == ["missing", "outside"]


def test_validators(spark):
    rows = [(0, 1, [1.0, 2.0]), (0, 2, [1.0]), (0, 3, [float("nan"), 1.0]), (0, 4, None), (0, 1, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "level int, point_id long, vec array<double>")
    assert {r["point_id"]: r["problem"] for r in schemas.bad_vectors(v).collect()} == {2: "length", 3: "non-finite", 4: "null"}
    assert [r["point_id"] for r in schemas.repeated_ids(v).collect()] == [1]


def test_catalogue_makes_a_result_once(spark, tmp_path):
    made = []
    c = catalog.Catalog(spark, str(tmp_path), {"k": 4})
    make = lambda: made.append(1) or spark.range(3)
    assert c.get("a", make)[0].count() == 3 and c.get("a", make)[0].count() == 3 and len(made) == 1
    assert catalog.Catalog(spark, str(tmp_path), {"k": 5}).key("a") != c.key("a")
    with pytest.raises(FileNotFoundError):
        c.require("nosuch")


def test_catalogue_leaves_no_half_results(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path), {"k": 4})

    def fails():
        return spark.range(3).select(F.raise_error(F.lit("stopped")).alias("x"))

    with pytest.raises(Exception, match="stopped"):
        c.get("a", fails)
    assert not c.complete(c.key("a")) and c.recover() == 1 and c.recover() == 0

    def late():  # another writer ends while this one works
        c.get("b", lambda: spark.range(5))
        return spark.range(7)

    assert c.get("b", late)[0].count() == 5 and c.recover() >= 0


def test_rows_of_a_condition(spark, tmp_path):
    v = spark.createDataFrame([(0, level, i, [float(i)]) for level in range(2) for i in range(6)], "model int, level int, point_id long, vec array<double>")
    store.write_levels(v.drop("model"), f"{tmp_path}/v")
    rows = spark.createDataFrame([(i, "copy" if i % 2 else "reverse", "a") for i in range(6)] + [(9, "copy", "b")], "point_id long, task string, context_id string")
    got = store.read_group(spark, f"{tmp_path}/v", rows, "copy", "a").collect()
    assert sorted((r["level"], r["point_id"]) for r in got) == [(level, i) for level in range(2) for i in (1, 3, 5)]
    with pytest.raises(Exception, match="no stored vector of point 9"):
        store.read_group(spark, f"{tmp_path}/v", rows, "copy", "b").collect()


def test_json_and_csv_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1 + 0.2, "a,b"), (2, None, 'q"')], "i long, x double, s string")
    store.write_csv(df, f"{tmp_path}/csv")
    got = store.read_csv(spark, f"{tmp_path}/csv", "i long, x double, s string").orderBy("i").collect()
    assert [(r["i"], r["x"]) for r in got] == [(1, 0.3), (2, None)] and got[0]["s"] == "a,b"
    (tmp_path / "rows.json").write_text('[{"i": 1, "s": "x"},\n {"i": 2, "s": null}]')
    assert sorted(tuple(r) for r in store.read_json_rows(spark, f"{tmp_path}/rows.json", "i long, s string").collect()) == [(1, "x"), (2, None)]


def test_costs(spark):
    assert spark.range(1).select(tasks.reservation_cost(F.lit(60.0), F.lit(2.0)).alias("c")).first()["c"] == pytest.approx(750)


def test_receipts(spark):
    good, bad = catalog.merge_receipts(spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2")], "key string, sha256 string"))
    assert [r["key"] for r in good.collect()] == ["a"] and [r["key"] for r in bad.collect()] == ["b"]


def test_study_skips_degenerate_levels(spark, data, tmp_path):
    few = tables.points(spark, data).where("point_id < 60")
    v = tables.cube(spark, data).where("point_id < 60 AND level < 2")
    flat = v.where("level = 0").withColumn("level", F.lit(9)).withColumn("vec", F.transform("vec", lambda x: F.lit(1.0)))
    out = full_range.study(catalog.Catalog(spark, str(tmp_path), {"k": 4}), few, v.unionByName(flat))
    assert sorted(r["level"] for r in out["metrics"].collect()) == [0, 1] and out["knn"].count() == 480


def test_stream_takes_a_row_once(spark, tmp_path):
    rows = spark.createDataFrame([("m", 0, 1, [1.0])], "model string, level int, point_id long, vec array<float>").withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    for _ in range(2):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() == 4
