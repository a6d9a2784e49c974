"""Operators beyond what the registered queries show."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import aggregates as A
from larkspur.operators import relational as R
from larkspur.operators import windows as W
from larkspur.session import shared_folder
from larkspur.sources import files, tables
from larkspur.sources.changes import ConcurrentChange, VersionedTable
from tests.compare import same


def test_union_of_different_widths_is_refused(spark):
    with pytest.raises(ValueError, match="different number of columns"):
        R.union(spark.range(1), spark.range(1).selectExpr("id", "id as b"))


def test_union_types(spark):
    df = R.union(spark.sql("select cast(1 as decimal(5,2)) x"), spark.sql("select cast(2 as decimal(10,4)) y"), spark.sql("select null"))
    assert df.schema["x"].dataType.simpleString() == "decimal(10,4)" and df.count() == 3


def test_scalar_subquery(spark):
    assert R.scalar(spark.range(0)).collect()[0][0] is None
    assert R.scalar(spark.range(3, 4)).collect()[0][0] == 3
    with pytest.raises(Exception, match="more than 1 row"):
        R.scalar(spark.range(2)).collect()


def test_broadcast_only_below_the_limit(spark):
    big, small = spark.range(1000), spark.range(10).withColumnRenamed("id", "k")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(R.equi_join(big, small, F.col("id") == F.col("k")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" not in plan(R.equi_join(big, small, F.col("id") == F.col("k"), limit=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 10").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_window_argument_errors(spark):
    w = Window.orderBy("id")
    for make in (lambda: W.ntile(0, w), lambda: W.nth_value("id", 0, w), lambda: W.percentile_cont(2, "id", w)):
        with pytest.raises(ValueError):
            make()


def test_moda_ties(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 9), (1, 9), (1, 4), (2, None)], "g int, v int")
    # 1 and 9 tie; the average is 4.8, 1 is nearer.
    assert sorted(A.moda(df, ["g"], "v").collect()) == [(1, 1), (2, None)]


def test_group_concat_of_nothing_is_null(spark):
    df = spark.createDataFrame([(1, None)], "g int, v string")
    assert df.groupBy("g").agg(A.group_concat("v").alias("c")).first()["c"] is None


def test_versioned_table_keeps_readers_and_refuses(spark):
    table = VersionedTable(spark, shared_folder(spark))
    table.create(spark.range(5))
    before = table.read()
    table.delete(F.col("id") > 2)
    assert before.count() == 5 and table.read().count() == 3
    with pytest.raises(ValueError, match="exists"):
        table.create(spark.range(1))
    table.rollback()
    assert table.read().count() == 5
    with pytest.raises(ValueError, match="roll back"):
        table.rollback()


def test_a_crash_between_write_and_rename_leaves_the_table(spark, monkeypatch):
    table = VersionedTable(spark, shared_folder(spark))
    table.create(spark.range(5))
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda state: (_ for _ in ()).throw(OSError("the driver is gone")))
        with pytest.raises(OSError):
            table.insert(spark.range(5, 7))
    assert VersionedTable(spark, table.path).read().count() == 5
    state = table.state()
    table.insert(spark.range(5, 7))
    with pytest.raises(ConcurrentChange):
        table._publish(state | {"version": state["version"] + 1})
    assert table.read().count() == 7 and table.state()["version"] == 2


def test_many_inserts_are_one_scan(spark):
    table = VersionedTable(spark, shared_folder(spark))
    table.create(spark.range(0))
    for k in range(6):
        table.insert(spark.range(k, k + 1))
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan and sorted(r[0] for r in table.read().collect()) == list(range(6))


def test_dropped_partitions_come_back_with_a_rollback(spark):
    table = VersionedTable(spark, shared_folder(spark), partition_by="g")
    table.create(spark.range(10).selectExpr("id", "if(id < 9, id % 3, null) as g"))
    table.insert(spark.range(20, 23).selectExpr("id", "id % 3 as g"))
    table.drop_partition(1)
    assert sorted(r["id"] for r in table.read().collect()) == [0, 2, 3, 5, 6, 8, 9, 20, 21] and table.read().columns == ["id", "g"]
    table.insert(spark.range(40, 41).selectExpr("id", "1L as g"))
    assert table.read().where("g = 1").count() == 1
    table.rollback()
    table.rollback()
    assert table.read().count() == 13


def test_group_concat_orders_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "", 1), (2, "b", 1), (2, "a", 2), (2, "b", None), (3, None, 1)], "g int, v string, k int")
    found = df.groupBy("g").agg(A.group_concat("v", order_by=[A.Descending("k")]).alias("c"), A.group_concat("v", order_by=[F.col("k")], distinct=True).alias("d")).collect()
    assert sorted(tuple(r) for r in found) == [(1, "", ""), (2, "a,b,b", "b,a"), (3, None, None)]


def test_sum_distinct_keeps_integers_and_decimals(spark):
    df = spark.createDataFrame([(9007199254740993, 1), (2, 1), (2, 1)], "v long, g int")
    w = Window.partitionBy("g")
    assert {r[0] for r in df.select(W.sum_distinct("v", w)).collect()} == {9007199254740995}
    assert {str(r[0]) for r in df.select(W.sum_distinct(F.col("v").cast("decimal(20,2)"), w, "decimal(38,2)")).collect()} == {"9007199254740995.00"}


def test_keyless_aggregates_scan_in_parallel(spark):
    from larkspur.operators import udaf

    plan = udaf.aggregate_with(spark.range(0, 100, 1, 8), [], ["id"], udaf.AverageOfMode() if hasattr(udaf, "AverageOfMode") else type("S", (), {"reset": lambda self: 0, "next": lambda self, s, v: s + v, "merge": lambda self, a, b: a + b, "evaluate": float})(), "s")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 1" not in text


def test_binary_load(spark, tmp_path):
    import struct

    (tmp_path / "rows.bin").write_bytes(b"".join(struct.pack("<iq4sd", *r) for r in [(1, 2, b"ab\0\0", 1.5), (-(1 << 31), -(1 << 63), b"wxyz", float("nan"))]))
    df = files.load_binary(spark, str(tmp_path / "rows.bin"), "a int, b bigint, c char(4), d double")
    assert [tuple(r) for r in df.collect()] == [(1, 2, "ab", 1.5), (None, None, "wxyz", None)]


def test_load_error_limit(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1|a\nx|b\ny|c\n")
    with pytest.raises(files.LoadError):
        files.load_text(spark, str(tmp_path / "x.txt"), "id int, s string", max_errors=1)
    assert files.load_text(spark, str(tmp_path / "x.txt"), "id int, s string").count() == 1


def test_nested_parquet_is_refused(spark):
    with pytest.raises(files.LoadError):
        files.load_parquet(spark, "/root/testdata/sf0.001/embeddings.parquet")


def test_another_engine_keeps_nulls_quotes_and_empty_texts(spark):
    rows = [(1, "a"), (2, None), (3, ""), (None, 'say "x", y'), (5, "é\nz")]
    df = spark.createDataFrame(rows, "k bigint, s string").repartition(2)
    url = files.derby_archive(df, "things")
    for _ in range(2):  # the archive stays
        found = files.cross_engine(spark, url, "select * from things", driver=files.DERBY)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(rows, key=repr)


def test_percentiles_over_whole_partitions(spark, duck):
    rows = [(g, float((i * 37) % 101) / (1 + (g or 0)) if i % 7 else None) for g in (0, 1, None) for i in range(10 + 13 * (g or 0))] + [(2, None), (2, None), (3, 4.5)]
    df = spark.createDataFrame(rows, "g int, x double")
    found = W.with_partition(df, ["g"], W.percentiles(df, ["g"], "x", c=("cont", 0.3), d=("disc", 0.7), a=("disc", 0), z=("cont", 1), m=("cont", 0.5)))
    duck.execute("create or replace table given (g int, x double)")
    duck.executemany("insert into given values (?, ?)", rows)
    same(found, duck, "select g, x, quantile_cont(x, 0.3) over w as c, quantile_disc(x, 0.7) over w as d, quantile_disc(x, 0) over w as a, quantile_cont(x, 1) over w as z, median(x) over w as m from given window w as (partition by g)")
    with pytest.raises(ValueError):
        W.percentiles(df, ["g"], "x", c=("cont", 2))


def test_no_row_carries_its_partition(spark):
    """A list of the partition's values in every row takes the square of a partition's rows."""
    from larkspur import plans

    plans.load()
    df = plans.runnable(plans.PLANS["window_percentiles"])(spark, "/root/testdata/sf0.001")
    assert "collect_list" not in df._jdf.queryExecution().executedPlan().toString()


def test_place_of_rows_beyond_an_extent_and_in_several_files(spark, tmp_path):
    """Beyond 2 ** 23 rows of one file, and in its second file, a table without partition directories is still one slice."""
    spark.range((1 << 23) + 10, numPartitions=1).write.parquet(f"{tmp_path}/long")
    spark.range(10, numPartitions=3).write.parquet(f"{tmp_path}/files")
    for name in ("long", "files"):
        df = spark.read.parquet(f"{tmp_path}/{name}")
        assert [tuple(r) for r in df.select(tables.idb_partition(df).alias("p")).distinct().collect()] == [("0.0.1",)]


def test_place_is_the_partition_directory(spark, tmp_path):
    spark.createDataFrame([(1, "b c", 1), (2, "b c", 2), (3, "a%", 1), (4, None, 1)], "i int, k string, m int").repartition(2).write.partitionBy("k", "m").parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    found = {r["i"]: r["p"] for r in df.select("i", tables.idb_partition(df).alias("p")).collect()}
    assert len(set(found.values())) == 4 and set(found.values()) == {f"{i}.0.1" for i in range(4)} and found[3] < found[1] < found[2]


@pytest.mark.parametrize("name", ["window_regression", "window_statistics"])
def test_aggregates_over_whole_partitions_gather_no_rows(spark, name):
    from larkspur import plans

    plans.load()
    df = plans.runnable(plans.PLANS[name])(spark, "/root/testdata/sf0.001")
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    if name == "window_regression":
        assert "partial_covar_pop" in df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_null_partition_get_its_aggregates(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 5.0), (None, 7.0), (2, None)], "g int, x double")
    found = W.with_partition(df, ["g"], W.per_partition(df, ["g"], m=F.avg("x"), n=F.count("x")))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, 2.0, 3.0, 2), (1, 4.0, 3.0, 2), (None, 5.0, 6.0, 2), (None, 7.0, 6.0, 2), (2, None, None, 0)], key=repr)


def test_pairs_of_one_key_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 50)
    monkeypatch.setattr(R, "TASK_PAIRS", 10_000)
    nan = float("nan")
    left = [(i, 1 if i % 10 else None if i % 20 else i % 3, (i * 7919) % 1000 / 10) for i in range(900)] + [(900, 1, None), (901, 1, nan), (902, 1, 5.0), (903, 1, 5.0)]
    right = [(i, 1 if i % 10 else i % 4, (i * 104_729) % 1000 / 10) for i in range(700)] + [(700, 1, None), (701, 1, nan), (702, 1, 5.0), (703, None, 50.0)]
    a, b = spark.createDataFrame(left, "a int, k int, v double"), spark.createDataFrame(right, "b int, l int, w double")
    found = R.less_join(a, b, ("k", "l"), (F.col("v"), F.col("w") - 1)).select("a", "b")
    big = lambda v: (1, 0.0) if v != v else (0, v)  # noqa: E731  NaN is the largest
    want = sorted((i, j) for i, k, v in left for j, m, w in right if k is not None and k == m and v is not None and w is not None and big(v) < big(w - 1))
    assert sorted(map(tuple, found.collect())) == want
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < len(want) / 5
