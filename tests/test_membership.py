"""Filters against their SQL where the table holds more items than a filter of the default shape."""

import duckdb
import pytest

import __spark_entry__ as entry
from aerovigil.operators import membership as B


@pytest.fixture(scope="module")
def wide(tmp_path_factory, sf):
    """A lineitem table with five times the nodes, all of them flooding."""
    folder = tmp_path_factory.mktemp("wide")
    duckdb.execute(f"""copy (select * replace ('R' as l_returnflag, l_orderkey + i * 100000 as l_orderkey, l_partkey * 64 + 63 as l_partkey,
        (l_orderkey * 7 + l_linenumber) % 400 + i * 400 as l_suppkey) from '{sf}/lineitem.parquet', range(0, 5) r(i))
        to '{folder}/lineitem.parquet' (format parquet)""")
    return str(folder)


def same_as_sql(spark, sf, name):
    got = sorted(tuple(r) for r in entry.queries()[name](spark, sf).collect())
    columns = ", ".join(entry.queries()[name](spark, sf).columns)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    return got == sorted(con.execute(f"select {columns} from ({entry.oracle_sql()[name]})").fetchall())


def test_the_first_bit_lies_in_the_first_block(spark):
    shape = B.BloomShape(64, 3, 50, 0.01)
    items = spark.range(50).selectExpr("cast(id as string) as item")
    blocks = B.build(items, "item", shape)
    assert [r.block for r in blocks.collect()] == [1]
    assert B.probe(items, "item", blocks, shape).where("not maybe_present").count() == 0


@pytest.mark.parametrize("name", ["c27_bloom_bits", "e8_bloom_probe", "c27_bloom_summary"])
def test_filters_grow_with_their_nodes_in_sql_too(spark, wide, name):
    assert same_as_sql(spark, wide, name)
