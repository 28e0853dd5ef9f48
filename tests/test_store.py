import pytest
from pyspark.sql import functions as F

from gridstat.functions import grids as A
from gridstat.operators import matrix as M
from gridstat.sources.store import DatasetReader, DatasetWriter, FeatureStore, load_stats, padded, save_stats, write_report


def batch(spark, lo, hi):
    ids = spark.range(lo, hi).withColumnRenamed("id", "sample_id")
    grids = ids.select("sample_id", F.lit(4).alias("h"), F.lit(4).alias("w"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i + F.col("sample_id")).cast("double")).alias("data"))
    steps = grids.withColumns({"realization": F.lit(0), "t": F.explode(F.array(F.lit(0), F.lit(1)))})
    return {
        "params": ids.withColumn("params", F.array(F.col("sample_id") / 10.0, F.lit(0.5))), "inputs": grids, "outputs": steps, "metrics": steps.select("sample_id", "realization", "t", F.array_max("data").alias("top")),
        "samples": ids.withColumns({"ic_type": F.lit("noise"), "grid_size": F.lit(4)}),
    }


def test_dataset_round_trip(spark, tmp_path):
    w = DatasetWriter(spark, str(tmp_path / "d"), 6)
    w.write_batch(**batch(spark, 0, 3))
    w.write_batch(**batch(spark, 3, 6))
    w.write_metadata({"seed": 1, "grid": {"h": 4}})
    r = DatasetReader(spark, str(tmp_path / "d"))
    assert r.num_samples() == 6
    assert r.get_parameters((2, 4)).count() == 2 and r.get_inputs([1, 5]).count() == 2
    assert r.get_trajectory(4, 0).count() == 2
    assert r.get_metadata() == {"seed": 1, "grid": {"h": 4}}
    assert r.shape_info().first().asDict() == {"samples": 6, "realizations": 1, "steps": 2, "h": 4, "w": 4}
    assert r.get_sample_columns("ic_type", ids=(0, 1)).first()["ic_type"] == "noise"
    assert r.compatible_with(r) and [m["top"] for m in r.get_metrics(4, 0).collect()] == [19.0, 19.0]
    with pytest.raises(ValueError):
        w.write_batch(**batch(spark, 5, 6))  # written before


def test_overflow_and_uneven_batches_are_errors(spark, tmp_path):
    w = DatasetWriter(spark, str(tmp_path / "d"), 2)
    with pytest.raises(ValueError):
        w.write_batch(**batch(spark, 0, 3))
    b = batch(spark, 0, 2)
    with pytest.raises(ValueError):
        w.write_batch(params=b["params"].limit(1), samples=b["samples"])
    with pytest.raises(ValueError):
        w.write_batch(other=b["params"])


def test_a_write_that_fails_between_tables_leaves_nothing(spark, tmp_path):
    """The third table can't be written; the first two are, but no reader sees them, and the batch written again replaces them."""
    w, r = DatasetWriter(spark, str(tmp_path / "d"), 9), DatasetReader(spark, str(tmp_path / "d"))
    w.write_batch(**batch(spark, 0, 3))
    broken = batch(spark, 3, 6)
    broken["outputs"] = broken["outputs"].withColumn("t", F.expr("assert_true(sample_id < 4)").cast("int"))
    with pytest.raises(Exception):  # noqa: B017  the task's own error
        w.write_batch(**broken)
    assert w.manifest.files.exists("inputs/batch=000001") and not w.manifest.files.exists("samples/batch=000001")
    assert r.num_samples() == 3 and r.get_inputs().count() == 3 and r.get_outputs().count() == 6
    assert w.write_batch(**batch(spark, 4, 7)) == "000001"
    assert r.num_samples() == 6 and sorted(x["sample_id"] for x in r.get_inputs().collect()) == [0, 1, 2, 4, 5, 6]
    with pytest.raises(ValueError):
        w.write_batch("000001", **batch(spark, 7, 8))  # committed
    with pytest.raises(ValueError):
        w.write_batch("overlap", **batch(spark, 6, 8))  # sample 6 is there
    assert r.num_samples() == 6 and w.discard_uncommitted() == [f"{t}/batch=overlap" for t in ("params", "inputs", "outputs", "metrics", "samples")]
    assert w.write_batch("3", **batch(spark, 3, 4)) == "3" and r.get_parameters((3, 4)).count() == 1 and r.get_parameters((8, 9)).count() == 0


def test_an_entry_is_there_whole_or_not_at_all(spark, tmp_path):
    w = DatasetWriter(spark, str(tmp_path / "d"), 9)
    w.write_batch(params=batch(spark, 0, 1)["params"])
    with pytest.raises(FileExistsError):
        w.manifest.commit({"batch": "000000", "tables": [], "n": 0, "least": None, "top": None})
    assert w.manifest.files.names("manifest") == ["batch-000000.json"] and w.manifest.batches()[0]["n"] == 1
    with pytest.raises(ValueError):
        DatasetReader(spark, str(tmp_path / "d")).get_inputs()


def test_features_round_trip(spark, tmp_path):
    s = FeatureStore(spark, str(tmp_path / "f"))
    rows = spark.createDataFrame([(0, "a", 1.0), (0, "b", float("nan"))], "sample_id long, feature string, value double")
    s.write("spectral", "summary", rows)
    with pytest.raises(Exception):  # noqa: B017  Spark's own error for an existing path
        s.write("spectral", "summary", rows)
    s.write("spectral", "summary", rows, overwrite=True)
    s.write("temporal", "summary", rows)
    assert s.families() == ["spectral", "temporal"] and s.registry().count() == 4
    s.write("spectral", "summary", rows.where("feature = 'a'"), overwrite=True)
    assert s.registry().count() == 3
    s.write("spectral", "summary", rows, overwrite=True)
    assert s.read("spectral", "summary", ["a"]).count() == 1
    both = {r["feature"]: r["value"] for r in s.combined({"spectral": "summary", "temporal": "summary"}).collect()}
    assert both == {"spectral::a": 1.0, "spectral::b": 0.0, "temporal::a": 1.0, "temporal::b": 0.0}


def test_padding_and_reports(spark, tmp_path):
    v = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert v.select(padded(F.col("v"), 3)).first()[0] == [1.0, 2.0, 0.0] and v.select(padded(F.col("v"), 1)).first()[0] == [1.0]
    for kind in ("json", "csv"):
        write_report(spark.range(3), str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    with pytest.raises(ValueError):
        write_report(spark.range(3), str(tmp_path / "x"), "xml")


def test_series_and_inputs_beside_features(spark, tmp_path):
    DatasetWriter(spark, str(tmp_path / "d"), 3).write_batch(**batch(spark, 0, 3))
    s = FeatureStore(spark, str(tmp_path / "f"))
    s.write("temporal", "steps", spark.createDataFrame([(0, 1, "a", 2.0), (0, 0, "a", 1.0), (1, 0, "a", 3.0)], "sample_id long, t int, feature string, value double"))
    assert {r["sample_id"]: r["series"] for r in s.series("temporal", "steps").collect()} == {0: [1.0, 2.0], 1: [3.0]}
    s.write("spectral", "summary", spark.createDataFrame([(0, "b", 4.0), (2, "b", 5.0)], "sample_id long, feature string, value double"))
    got = {r["sample_id"]: (r["features"], len(r["data"])) for r in s.with_inputs(DatasetReader(spark, str(tmp_path / "d")), {"spectral": "summary"}).collect()}
    assert got == {0: ({"spectral::b": 4.0}, 16), 2: ({"spectral::b": 5.0}, 16)}


def test_statistics_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(i, "a", float(i)) for i in range(5)], "sample_id long, feature string, value double")
    save_stats(M.standard_stats(df), str(tmp_path / "s"), "standard")
    back = M.apply_standard(df, load_stats(spark, str(tmp_path / "s"), "standard"))
    assert sorted(r["value"] for r in back.collect()) == pytest.approx(sorted(r["value"] for r in M.standardize(df).collect()))
    with pytest.raises(ValueError):
        load_stats(spark, str(tmp_path / "s"), "robust")


def test_grids_are_padded_on_all_sides(spark):
    df = spark.createDataFrame([(2, 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "h int, w int, data array<double>")
    got = df.select(A.padded(A.Grid(F.col("h"), F.col("w"), F.col("data")), 4)).first()[0]
    assert got == [0, 0, 0, 0, 1, 2, 3, 0, 4, 5, 6, 0, 0, 0, 0, 0]
    assert df.select(A.padded(A.Grid(F.col("h"), F.col("w"), F.col("data")), 2)).first()[0] == [1, 2, 3, 4, 5, 6]
