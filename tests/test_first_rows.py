import pytest
from docloom.sources import io


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("rows") / "t.parquet")
    df = spark.range(1000).selectExpr("id", "concat('text ', id) AS file", "id * 2 AS doc_ord", "5 AS place")
    df.repartitionByRange(10, "id").sortWithinPartitions("id").write.parquet(at)
    return at


def rows_read(df):
    """Rows that the scan of the table gave, from the metrics of the plan that ran."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif plan.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            if plan.nodeName().startswith("Scan parquet"):
                n += plan.metrics().apply("numOutputRows").value()
            kids = plan.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return n


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 555, 1000, 5000])
def test_first_rows(spark, path, n):
    got = sorted((r.doc_ord, r.id, r.file, r.place) for r in io.first_rows(spark, path, n).collect())
    assert got == [(i, i, f"text {i}", 5) for i in range(min(n, 1000))]


def test_reads_only_the_first_files(spark, path):
    sizes = [c for _, c in io.first_files(spark, path, 10**9)[0]]
    assert sum(sizes) == 1000 and len(sizes) == 10
    first = io.first_rows(spark, path, 5)
    assert rows_read(first) == sizes[0]
    assert io.first_files(spark, path, 5)[1] == 1
    assert io.first_files(spark, path, sizes[0] + 1)[1] == 5
    assert rows_read(io.first_rows(spark, path, sizes[0] + sizes[1])) == sizes[0] + sizes[1]
    assert "Exchange hashpartitioning" not in first._jdf.queryExecution().toString()


def test_later_files_are_not_opened(spark, tmp_path):
    at = tmp_path / "t"
    spark.range(40).repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(str(at))
    for file in sorted(at.glob("part-*"))[5:]:
        file.write_bytes(b"broken")
        (at / f".{file.name}.crc").unlink()
    assert sorted(r.id for r in io.first_rows(spark, str(at), 7).collect()) == list(range(7))
    with pytest.raises(Exception, match="(?i)parquet|footer|file"):
        io.first_rows(spark, str(at), 39).collect()
