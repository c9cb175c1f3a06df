import numpy as np
import pytest
from docloom.sources import npy
from docloom.sources.io import RowMismatch


def rows_of(df):
    return [(r.row, list(r.vector)) for r in df.orderBy("row").collect()]


@pytest.mark.parametrize("dtype", ["<f2", "<f4", ">f4", "<f8", "<i4", ">i8"])
def test_files_of_numpy(spark, tmp_path, dtype):
    matrix = (np.arange(21 * 5) - 40).reshape(21, 5).astype(dtype)
    np.save(tmp_path / "m.npy", matrix)
    df = npy.read_npy(spark, str(tmp_path / "m.npy"), partition_bytes=4 * matrix.itemsize * 5)
    assert df.rdd.getNumPartitions() == 6
    assert rows_of(df) == list(enumerate(matrix.tolist()))


def test_what_is_no_table_of_vectors(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.arange(3.0))
    assert rows_of(npy.read_npy(spark, f"file:{tmp_path}/one.npy")) == [(0, [0.0]), (1, [1.0]), (2, [2.0])]
    for name, matrix in (("f", np.asfortranarray(np.ones((3, 2)))), ("cube", np.ones((2, 2, 2))), ("text", np.array(["a"]))):
        np.save(tmp_path / f"{name}.npy", matrix)
        with pytest.raises(Exception, match="no table of vectors"):
            npy.read_npy(spark, str(tmp_path / f"{name}.npy")).collect()
    with pytest.raises(ValueError, match="different widths"):
        npy.parts_of(str(tmp_path / "mixed")) if (tmp_path / "mixed").mkdir() or [
            np.save(tmp_path / "mixed" / f"{n}.npy", np.ones((2, n))) for n in (2, 3)
        ] else None
    short = (tmp_path / "one.npy").read_bytes()[:-8]
    (tmp_path / "short.npy").write_bytes(short)
    with pytest.raises(Exception, match="ends before row"):
        npy.read_npy(spark, str(tmp_path / "short.npy")).collect()


def test_parts_keep_the_order(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    df = spark.range(1000, numPartitions=7).selectExpr("id", "array(cast(id as float), cast(-id as float), 0.5f) AS v")
    npy.write_npy(df.orderBy("id"), path)
    assert rows_of(npy.read_npy(spark, path, 500)) == [(i, [i, -i, 0.5]) for i in range(1000)]
    loaded = np.concatenate([np.load(p.path) for p in npy.parts_of(path)[0]])
    assert loaded.dtype == np.float32 and loaded[:, 0].tolist() == list(range(1000))
    # what a failed task has left does not count; appending and overwriting do
    np.save(tmp_path / "m" / "part-000000-00009-left.npy", np.ones((5, 3), np.float32))
    npy.write_npy(df.filter("id < 2"), path, "append")
    assert npy.read_npy(spark, path).count() == 1002
    npy.write_npy(df.filter("id < 2"), path)
    assert rows_of(npy.read_npy(spark, path)) == [(0, [0, 0, 0.5]), (1, [1, -1, 0.5])]
    npy.write_npy(df.filter("id < 0"), path)
    assert rows_of(npy.read_npy(spark, path)) == []


def test_parts_are_bounded(tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    monkeypatch.setattr(npy, "PART_BYTES", 10 * 2 * 8)
    monkeypatch.setattr(npy.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 3)})))
    writer = npy.NpyWriter(str(tmp_path / "w"), StructType([StructField("v", ArrayType(DoubleType()))]), True)
    batch = pa.RecordBatch.from_arrays([pa.array([[float(i), 1.0] for i in range(25)], pa.list_(pa.float64()))], names=["v"])
    message = writer.write(iter([batch, batch]))
    assert [n for _, n in message.parts] == [10] * 5
    writer.commit([None, message])
    assert np.concatenate([np.load(p.path) for p in npy.parts_of(str(tmp_path / "w"))[0]])[:, 0].tolist() == [*range(25)] * 2


def test_faulty_vectors(spark, tmp_path):
    path = str(tmp_path / "m")
    for rows in ([([1.0],), (None,)], [([1.0, None],)], [([1.0],), ([1.0, 2.0],)]):
        with pytest.raises(Exception, match="is null|different widths"):
            npy.write_npy(spark.createDataFrame(rows, "v array<double>"), path)
    with pytest.raises(Exception, match="one array column"):
        npy.write_npy(spark.range(3), path)


def test_vectors_with_ids(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = [(i * 7 % 50, [float(i), 1.0], "x") for i in range(50)]
    npy.save_vectors(spark.createDataFrame(rows, "chunk_id long, embedding array<double>, row string"), path)
    got = npy.load_vectors(spark, path).collect()
    assert sorted((r.chunk_id, list(r.embedding)) for r in got) == sorted((i, v) for i, v, _ in rows)
    assert all(r.row == r.chunk_id for r in got)
    npy.write_npy(spark.range(1).selectExpr("array(1D, 2D) AS v"), f"{path}/matrix", "append")
    with pytest.raises(RowMismatch):
        npy.load_vectors(spark, path)
