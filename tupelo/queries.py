"""The reference queries over the driver's tables, each in the dialect, with SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .sources.catalog import Catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class Sample:
    """text: in the dialect; sql: its oracle; casts: SQL types of output columns, where the two differ."""

    text: str
    sql: str
    names: tuple[str, ...] = ()
    #: Tables made from the driver's, by name: the table and SQL for its columns.
    made: Mapping[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    methods: Mapping[tuple[str, str], str] = field(default_factory=dict)
    casts: Mapping[str, str] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = Catalog(spark).parquet_dir(sf_dir, *TABLES)
        for name, (of, columns) in self.made.items():
            catalog.register(name, catalog.table(of).selectExpr(*columns))
        engine = Engine(spark, catalog)
        out = engine.query(self.text, self.methods, list(self.names) or None)
        return out.withColumns({c: out[c].cast(t) for c, t in self.casts.items()}) if self.casts else out


_FOUR = "FROM customer,orders,lineitem,part WHERE customer.c_custkey=orders.o_custkey,orders.o_orderkey=lineitem.l_orderkey,lineitem.l_partkey=part.p_partkey"
_FOUR_SQL = "FROM customer, orders, lineitem, part WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey"
_RANGE = ',part.p_retailprice<"950",part.p_retailprice>"905"'
_RANGE_SQL = " AND p_retailprice < 950 AND p_retailprice > 905"
#: Prices as the dialect's own REAL, which has 32 bits.
_REAL = {"price": ("part", ("p_partkey", "CAST(p_retailprice AS FLOAT) AS amount"))}
_REAL_SQL = "SELECT p_partkey, CAST(CAST(p_retailprice AS REAL) AS DOUBLE) AS amount FROM part WHERE CAST(p_retailprice AS REAL)"
_PAIR = "SELECT customer.c_custkey,customer.c_name,customer.c_nationkey,orders.o_orderkey,orders.o_orderstatus FROM customer,orders WHERE customer.c_custkey=orders.o_custkey"
_PAIR_SQL = "SELECT c_custkey, c_name, c_nationkey, o_orderkey, o_orderstatus FROM customer, orders WHERE c_custkey = o_custkey"

SAMPLES: dict[str, Sample] = {
    "scan_star": Sample("SELECT * FROM customer", "SELECT * FROM customer"),
    "project": Sample("SELECT customer.c_custkey,customer.c_nationkey,customer.c_name FROM customer", "SELECT c_custkey, c_nationkey, c_name FROM customer"),
    "filter_int_eq": Sample('SELECT customer.c_custkey,customer.c_name FROM customer WHERE customer.c_nationkey="1"', "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 1"),
    "filter_range_and": Sample('SELECT part.p_partkey,part.p_size FROM part WHERE part.p_size<"40",part.p_size>"10"', "SELECT p_partkey, p_size FROM part WHERE p_size < 40 AND p_size > 10"),
    "filter_string_lt": Sample('SELECT customer.c_custkey,customer.c_mktsegment FROM customer WHERE customer.c_mktsegment<"HOUSEHOLD"', "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'HOUSEHOLD'"),
    "filter_string_ge": Sample('SELECT customer.c_custkey,customer.c_mktsegment FROM customer WHERE customer.c_mktsegment>="HOUSEHOLD"', "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'HOUSEHOLD'"),
    "filter_real_le": Sample('SELECT customer.c_custkey,customer.c_acctbal FROM customer WHERE customer.c_acctbal<="1000.5"', "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 1000.5"),
    "filter_real_gt": Sample('SELECT supplier.s_suppkey,supplier.s_acctbal FROM supplier WHERE supplier.s_acctbal>"-10.25"', "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > -10.25"),
    **{
        f"filter_real32_{name}": Sample(f'SELECT price.p_partkey,price.amount FROM price WHERE price.amount{op}"{value}"', f"{_REAL_SQL} {sql} CAST({value} AS REAL)", made=_REAL, casts={"amount": "double"})
        for name, op, sql, value in (("eq", "=", "=", "905.1"), ("ne", "!=", "<>", "905.1"), ("lt", "<", "<", "950.3"), ("le", "<=", "<=", "950.3"), ("gt", ">", ">", "1e3"), ("ge", ">=", ">=", "1000.1"))
    },
    "filter_ne": Sample('SELECT orders.o_orderkey,orders.o_orderstatus FROM orders WHERE orders.o_orderstatus!="F"', "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"),
    "filter_col_col": Sample("SELECT lineitem.l_orderkey,lineitem.l_linenumber,lineitem.l_quantity FROM lineitem WHERE lineitem.l_quantity=lineitem.l_linenumber", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = l_linenumber"),
    "join_2": Sample(_PAIR, _PAIR_SQL),
    **{f"join_2_{m}": Sample(_PAIR, _PAIR_SQL, methods={("customer", "orders"): m}) for m in ("nested", "block_nested", "sort_merge", "hash")},
    "join_nested": Sample("SELECT nation.n_name,region.r_name FROM nation,region WHERE nation.n_regionkey=region.r_regionkey", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", methods={("nation", "region"): "nested"}),
    "join_3": Sample("SELECT * FROM customer,orders,lineitem WHERE customer.c_custkey=orders.o_custkey,orders.o_orderkey=lineitem.l_orderkey", "SELECT * FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey"),
    "join_4": Sample(f"SELECT * {_FOUR}", f"SELECT * {_FOUR_SQL}"),
    "join_4_range": Sample(f"SELECT * {_FOUR}{_RANGE}", f"SELECT * {_FOUR_SQL}{_RANGE_SQL}"),
    "join_4_range_project": Sample(f"SELECT customer.c_nationkey,part.p_retailprice {_FOUR}{_RANGE}", f"SELECT c_nationkey, p_retailprice {_FOUR_SQL}{_RANGE_SQL}"),
    "join_composite": Sample("SELECT supplier.s_suppkey,customer.c_custkey FROM supplier,customer WHERE supplier.s_nationkey=customer.c_nationkey,supplier.s_suppkey=customer.c_custkey", "SELECT s_suppkey, c_custkey FROM supplier, customer WHERE s_nationkey = c_nationkey AND s_suppkey = c_custkey"),
    "join_theta": Sample("SELECT nation.n_nationkey,region.r_regionkey FROM nation,region WHERE nation.n_regionkey<region.r_regionkey", "SELECT n_nationkey, r_regionkey FROM nation, region WHERE n_regionkey < r_regionkey"),
    "join_mixed": Sample("SELECT orders.o_orderkey,lineitem.l_linenumber FROM orders,lineitem WHERE orders.o_orderkey=lineitem.l_orderkey,orders.o_totalprice>lineitem.l_extendedprice", "SELECT o_orderkey, l_linenumber FROM orders, lineitem WHERE o_orderkey = l_orderkey AND o_totalprice > l_extendedprice"),
    "cross": Sample("SELECT nation.n_name,region.r_name FROM nation,region", "SELECT n_name, r_name FROM nation, region"),
    "cross_filtered": Sample('SELECT nation.n_name,region.r_name FROM nation,region WHERE nation.n_nationkey<"3"', "SELECT n_name, r_name FROM nation, region WHERE n_nationkey < 3"),
    "distinct": Sample("SELECT DISTINCT customer.c_nationkey FROM customer", "SELECT DISTINCT c_nationkey FROM customer"),
    "distinct_multi": Sample("SELECT DISTINCT orders.o_orderstatus,orders.o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "distinct_star": Sample("SELECT DISTINCT * FROM nation", "SELECT DISTINCT * FROM nation"),
    "group_distinct": Sample("SELECT customer.c_nationkey FROM customer GROUPBY customer.c_nationkey", "SELECT c_nationkey FROM customer GROUP BY c_nationkey"),
    "group_subset": Sample("SELECT orders.o_orderstatus FROM orders GROUPBY orders.o_orderstatus,orders.o_orderpriority", "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus, o_orderpriority"),
    "group_then_distinct": Sample("SELECT DISTINCT orders.o_orderstatus FROM orders GROUPBY orders.o_orderstatus,orders.o_orderpriority", "SELECT DISTINCT o_orderstatus FROM orders GROUP BY o_orderstatus, o_orderpriority"),
    "order_asc": Sample("SELECT * FROM customer ORDERBY customer.c_custkey ASC", "SELECT * FROM customer ORDER BY c_custkey"),
    "order_desc_multi": Sample("SELECT customer.c_nationkey,customer.c_custkey FROM customer ORDERBY customer.c_nationkey,customer.c_custkey DESC", "SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey DESC"),
    "order_hidden": Sample("SELECT customer.c_name FROM customer ORDERBY customer.c_custkey", "SELECT c_name FROM customer ORDER BY c_custkey"),
    "join_4_order": Sample(f"SELECT * {_FOUR}{_RANGE} ORDERBY part.p_retailprice", f"SELECT * {_FOUR_SQL}{_RANGE_SQL} ORDER BY p_retailprice"),
    "group_max": Sample(f'SELECT customer.c_nationkey,MAX(part.p_retailprice) {_FOUR},part.p_retailprice<"950" GROUPBY customer.c_nationkey', f"SELECT c_nationkey, max(p_retailprice) AS max_price {_FOUR_SQL} AND p_retailprice < 950 GROUP BY c_nationkey", names=("c_nationkey", "max_price")),
    "aggs": Sample(
        "SELECT lineitem.l_linenumber,MAX(lineitem.l_quantity),MIN(lineitem.l_quantity),SUM(lineitem.l_quantity),COUNT(lineitem.l_quantity),AVG(lineitem.l_quantity) FROM lineitem GROUPBY lineitem.l_linenumber",
        "SELECT l_linenumber, max(l_quantity) AS mx, min(l_quantity) AS mn, CAST(sum(l_quantity) AS DOUBLE) AS sm, count(l_quantity) AS ct, avg(l_quantity) AS av FROM lineitem GROUP BY l_linenumber",
        names=("l_linenumber", "mx", "mn", "sm", "ct", "av"),
    ),
    "agg_sum_int": Sample("SELECT SUM(customer.c_nationkey),AVG(customer.c_nationkey) FROM customer", "SELECT CAST(sum(c_nationkey) AS BIGINT) AS s, avg(c_nationkey) AS a FROM customer", names=("s", "a")),
    "agg_string": Sample("SELECT MIN(customer.c_name),MAX(customer.c_name),COUNT(customer.c_name) FROM customer", "SELECT min(c_name) AS lo, max(c_name) AS hi, count(c_name) AS n FROM customer", names=("lo", "hi", "n")),
    "agg_order": Sample("SELECT orders.o_orderpriority,COUNT(orders.o_orderkey) FROM orders GROUPBY orders.o_orderpriority ORDERBY COUNT(orders.o_orderkey) DESC", "SELECT o_orderpriority, count(o_orderkey) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC", names=("o_orderpriority", "n")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: s.run for name, s in SAMPLES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s.sql for name, s in SAMPLES.items()}
