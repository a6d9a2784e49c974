"""Load, unload, change, partition and describe tables; streams. Each writes below a new shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.plans import plan
from larkspur.session import shared_folder
from larkspur.sources import files, tables
from larkspur.sources.changes import VersionedTable, with_auto_increment
from larkspur.sources.tables import Tables
from larkspur.streaming.batches import insert_stream, stream_parquet, windowed


@plan("select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def load_delimited_text(t: Tables) -> DataFrame:
    path = shared_folder(t.spark)
    files.unload_text(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return files.load_text(t.spark, path, "c_custkey bigint, c_name varchar(25), c_acctbal double, c_mktsegment char(10)").select("c_custkey", "c_name", "c_acctbal", F.rtrim("c_mktsegment").alias("c_mktsegment"))


@plan("select * from (values (1, 'a|b', 1.5::double), (2, null, null), (4, 'lon', 2)) v(id, s, x)")
def load_text_with_errors(t: Tables) -> DataFrame:
    path, errors = shared_folder(t.spark), shared_folder(t.spark)
    t.rows([("id|s|x",), ('1|"a|b"|1.5',), ("2|\\N|\\N",), ("x|bad|1",), ("4|long|2",)], "value string").coalesce(1).write.text(path)
    return files.load_text(t.spark, path, "id int, s varchar(3), x double", enclosed='"', skip_lines=1, max_errors=1, errors_to=errors)


@plan("select p_partkey, p_name, p_retailprice from part")
def load_parquet(t: Tables) -> DataFrame:
    return files.load_parquet(t.spark, t.path("part")).select("p_partkey", "p_name", "p_retailprice")


@plan("select 'CREATE TABLE r (r_regionkey INT, r_name VARCHAR(2000))' as ddl")
def parquet_ddl(t: Tables) -> DataFrame:
    return t.constant(ddl=files.ddl_of_parquet(t.spark, t.path("region"), "r"))


@plan("select c_mktsegment, count(*) as n, count(*) filter (c_acctbal < 0) as poor from (select c_mktsegment, case when c_custkey % 7 = 0 then 0 else c_acctbal end as c_acctbal from customer where c_nationkey <> 3 union all select 'NEW', -1) group by 1")
def insert_update_delete(t: Tables) -> DataFrame:
    table = VersionedTable(t.spark, shared_folder(t.spark))
    table.create(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"))
    table.update({"c_acctbal": F.lit(0)}, F.col("c_custkey") % 7 == 0)
    table.delete(F.col("c_nationkey") == 3)
    table.insert(t.rows([(-1, 99, "NEW", -1.0)], "c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double"))
    return table.read().groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("poor"))


@plan("select n_name as label, count(*) as n from supplier join nation on s_nationkey = n_nationkey where s_suppkey not in (select l_suppkey from lineitem where l_quantity = 50 and l_discount = 0.1 and l_linenumber = 1) group by 1")
def update_delete_with_join(t: Tables) -> DataFrame:
    table = VersionedTable(t.spark, shared_folder(t.spark))
    table.create(t.supplier.select("s_suppkey", "s_nationkey", F.lit("").alias("label")))
    table.update_join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), ["s_nationkey"], {"label": F.col("src_n_name")})
    gone = t.lineitem.where("l_quantity = 50 and l_discount = 0.1 and l_linenumber = 1").select(F.col("l_suppkey").alias("s_suppkey"))
    table.delete_join(gone, ["s_suppkey"])
    return table.read().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@plan("select 25::bigint as before, 0::bigint as truncated, 25::bigint as rolled_back")
def truncate_and_rollback(t: Tables) -> DataFrame:
    table = VersionedTable(t.spark, shared_folder(t.spark))
    table.create(t.nation)
    before = table.read().count()
    table.truncate()
    empty = table.read().count()
    table.rollback()
    return t.constant(before=F.lit(before).cast("bigint"), truncated=F.lit(empty).cast("bigint"), rolled_back=F.lit(table.read().count()).cast("bigint"))


@plan("select n_nationkey, n_name as label, 7::bigint as extra from nation")
def alter_table(t: Tables) -> DataFrame:
    table = VersionedTable(t.spark, shared_folder(t.spark))
    table.create(t.nation)
    table.add_column("extra", "bigint", 7)
    table.drop_column("n_regionkey")
    table.rename_column("n_name", "label")
    return table.read()


@plan("select o_orderstatus, count(*) as n from orders where o_orderstatus = 'F' group by 1")
def partition_disable_drop(t: Tables) -> DataFrame:
    table = VersionedTable(t.spark, shared_folder(t.spark), partition_by="o_orderstatus")
    table.create(t.orders)
    table.disable("P")
    table.drop_partition("O")
    return table.read().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@plan("select o_orderstatus as partition, count(*) as n_rows, o_orderstatus <> 'P' as enabled from orders group by 1")
def partition_show(t: Tables) -> DataFrame:
    table = VersionedTable(t.spark, shared_folder(t.spark), partition_by="o_orderstatus")
    table.create(t.orders)
    table.disable("P", "F")
    table.enable("F")
    return table.partitions()


@plan("select 3::bigint as n_files, count(*) as n from orders")
def redistribute_data(t: Tables) -> DataFrame:
    table = VersionedTable(t.spark, shared_folder(t.spark))
    table.create(t.orders)
    table.redistribute(3)
    rows = table.read().select(F.col("_metadata.file_path").alias("f"))
    return rows.agg(F.count_distinct("f").alias("n_files"), F.count(F.lit(1)).alias("n"))


@plan("select o_orderkey, row_number() over (order by o_orderkey) + 99 as id from orders")
def auto_increment(t: Tables) -> DataFrame:
    return with_auto_increment(t.orders.select("o_orderkey"), "id", 100, ["o_orderkey"])


@plan("select 'region' as table_name, 2 as n_columns, count(*) as n_rows from region union all select 'nation', 3, count(*) from nation")
def information_schema_tables(t: Tables) -> DataFrame:
    return tables.tables_of(t.spark, t.folder, "region", "nation")


@plan("select codec, count(*) as n from nation, (values ('none'), ('snappy'), ('lz4')) c(codec) group by 1")
def write_compressed(t: Tables) -> DataFrame:
    """Each compression that a table may have, written and read again."""
    out = None
    for codec in ("none", "snappy", "lz4"):
        path = shared_folder(t.spark)
        t.nation.write.option("compression", {"none": "uncompressed", "lz4": "lz4_raw"}.get(codec, codec)).parquet(path)
        n = t.spark.read.parquet(path).groupBy(F.lit(codec).alias("codec")).agg(F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.union(n)
    return out


@plan("select o_orderstatus, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1")
def insert_from_select(t: Tables) -> DataFrame:
    """Four inserts by the hash of the key, so a row of any key is in one."""
    table = VersionedTable(t.spark, shared_folder(t.spark))
    table.create(t.orders.limit(0))
    for r in range(4):
        table.insert(t.orders.where(F.pmod(F.hash("o_orderkey"), F.lit(4)) == r))
    table.compact()
    return table.read().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@plan("select '0.0.1' as place, o_orderstatus, count(*) as n from orders group by all")
def idb_partition(t: Tables) -> DataFrame:
    orders = t.orders
    return orders.select(tables.idb_partition(orders).alias("place"), "o_orderstatus").groupBy("place", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@plan("select t as table_name, 1::bigint as n_files, true as filled from (values ('region'), ('orders')) v(t)")
def information_schema_files(t: Tables) -> DataFrame:
    return tables.files_of(t.spark, t.folder, "region", "orders").groupBy("table_name").agg(F.count(F.lit(1)).alias("n_files"), (F.sum("bytes") > 0).alias("filled"))


@plan("select * from (values ('region', 'r_regionkey', 1, 'int'), ('region', 'r_name', 2, 'string')) v(table_name, column_name, ordinal_position, data_type)")
def information_schema_columns(t: Tables) -> DataFrame:
    return tables.columns_of(t.spark, t.folder, "region").drop("is_nullable")


@plan("select 'o_orderkey' as column_name, count(*) as n_rows, min(o_orderkey)::varchar as min_value, max(o_orderkey)::varchar as max_value from orders")
def information_schema_extents(t: Tables) -> DataFrame:
    e = tables.extents(t.spark, t.folder, "orders").where("column_name = 'o_orderkey'")
    return e.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows"), F.min(F.col("min_value").cast("bigint")).cast("string").alias("min_value"), F.max(F.col("max_value").cast("bigint")).cast("string").alias("max_value"))


@plan("select 'o_orderkey' as column_name, count(*) as n_rows, 0::bigint as n_nulls, count(distinct o_orderkey) as n_distinct, true as is_unique from orders union all select 'o_custkey', count(*), 0, count(distinct o_custkey), false from orders")
def analyze_table(t: Tables) -> DataFrame:
    return tables.analyze(t.orders, "o_orderkey", "o_custkey")


@plan("select p_type as value, count(*) as n from part group by 1 order by n desc, value limit 3")
def analyze_most_common(t: Tables) -> DataFrame:
    return tables.most_common(t.part, "p_type", 3)


@plan("select n_nationkey, n_name from nation")
def stream_insert(t: Tables) -> DataFrame:
    """Micro-batch insertion: files of a folder, each appended once."""
    source, target, state = (shared_folder(t.spark) for _ in range(3))
    t.nation.select("n_nationkey", "n_name").repartition(3).write.parquet(source)
    table = VersionedTable(t.spark, target)
    table.create(t.nation.limit(0).select("n_nationkey", "n_name"))
    insert_stream(stream_parquet(t.spark, source, 1), table, state).awaitTermination()
    return table.read()


@plan("select time_bucket(interval 6 hour, ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def window_tumbling_batch(t: Tables) -> DataFrame:
    """The batch form of the streaming window."""
    made = windowed(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "6 hours")
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
