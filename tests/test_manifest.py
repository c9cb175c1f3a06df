import pytest
from docloom.functions.lineage import fresh_path
from docloom.sources import io
from pyspark.sql import functions as F


def maker(spark, made, n, fail=False):
    def make():
        made.append(n)
        rows = spark.range(100, numPartitions=4).withColumn("n", F.lit(n))
        return rows.withColumn("n", F.when(F.col("id") == 99, F.raise_error(F.lit("dies"))).otherwise(F.col("n"))) if fail else rows

    return make


def test_a_write_that_dies_is_made_again(spark):
    path, made = fresh_path(spark, "stage"), []
    with pytest.raises(Exception, match="dies"):
        io.materialise(spark, path, maker(spark, made, 1, fail=True))
    # what a failed writer can leave: a folder with some files and no manifest
    spark.range(3).withColumn("n", F.lit(0)).write.mode("overwrite").parquet(path)
    assert io.read_manifest(spark, path) == {}
    for _ in range(2):
        assert {r.n for r in io.materialise(spark, path, maker(spark, made, 2)).collect()} == {2}
    assert made == [1, 2]


def test_other_settings_and_changed_inputs_make_it_again(spark):
    source, path, made = fresh_path(spark, "source"), fresh_path(spark, "stage"), []
    spark.range(5).write.parquet(source)
    ask = lambda n, settings: io.materialise(spark, path, maker(spark, made, n), settings, [source]).first().n
    assert [ask(1, {"a": 1, "b": 2}), ask(2, {"b": 2, "a": 1}), ask(3, {"a": 2, "b": 2})] == [1, 1, 3]
    spark.range(7).write.mode("append").parquet(source)
    assert [ask(4, {"a": 2, "b": 2}), ask(5, {"a": 2, "b": 2})] == [4, 4]
    assert made == [1, 3, 4]


def test_a_broken_manifest_counts_as_none(spark):
    path = fresh_path(spark, "stage")
    io.materialise(spark, path, maker(spark, [], 1))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{io.MANIFEST}")
    file = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    file.write(bytearray(b'{"made_of": "'))
    file.close()
    made = []
    assert io.materialise(spark, path, maker(spark, made, 2)).first().n == 2 and made == [2]
