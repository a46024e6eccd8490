"""Matrices in npz files: round trips, ranges of rows, files of other makers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from triplewright.sources import npz


def test_a_round_trip_of_several_partitions(spark, tmp_path):
    df = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").repartition(5)
    npz.write_matrix(df, str(tmp_path / "m"), "vec_id", "embedding")
    assert len(list((tmp_path / "m").glob("part-*.npz"))) == 5 and not list((tmp_path / "m").glob("_*"))
    back = npz.read_matrix(spark, str(tmp_path / "m"), rows=37)
    assert back.rdd.getNumPartitions() >= 10
    want = {r["vec_id"]: r["embedding"] for r in df.collect()}
    assert {r["row"]: r["values"] for r in back.collect()} == want
    assert np.load(next((tmp_path / "m").glob("part-*.npz")))["arr"].shape[1] == 64
    npz.write_matrix(df.limit(3), f"file://{tmp_path}/m", "vec_id", "embedding")
    assert npz.read_matrix(spark, f"file://{tmp_path}/m").count() == 3
    npz.write_matrix(df.limit(2), str(tmp_path / "m"), "vec_id", "embedding", mode="append")
    assert npz.read_matrix(spark, str(tmp_path / "m")).count() == 5


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("kind", [np.float16, np.float32, np.float64])
def test_files_that_numpy_wrote(spark, tmp_path, save, kind):
    a = np.random.default_rng(1).normal(size=(5000, 3)).astype(kind)
    save(tmp_path / "x.npz", arr=a)
    rows = npz.read_matrix(spark, str(tmp_path / "x.npz"), rows=1234).orderBy("row").collect()
    assert [r["row"] for r in rows] == list(range(5000)) and {r["file"] for r in rows} == {"x.npz"}
    assert np.array_equal(np.array([r["values"] for r in rows], np.float32), a.astype(np.float32))


def test_deep_arrays_and_empty_ones_and_none(spark, tmp_path):
    np.savez(tmp_path / "t.npz", arr=np.arange(24.0).reshape(2, 3, 4))
    assert [r["values"] for r in npz.read_matrix(spark, str(tmp_path / "t.npz")).orderBy("row").collect()] == [list(range(12)), list(range(12, 24))]
    np.savez(tmp_path / "e.npz", arr=np.zeros((0, 4)))
    assert npz.read_matrix(spark, str(tmp_path / "e.npz")).count() == 0
    with pytest.raises(Exception, match="missing"):
        npz.read_matrix(spark, str(tmp_path / "missing")).count()
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "i long, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        npz.write_matrix(ragged, str(tmp_path / "r"), "i", "v")
    npz.write_matrix(ragged.where(F.lit(False)), str(tmp_path / "none"), "i", "v")
    assert npz.read_matrix(spark, str(tmp_path / "none")).count() == 0
