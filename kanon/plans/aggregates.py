"""Ordered aggregates and flagged unions over lineitem / orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from kanon.operators import aggregates as AG
from kanon.plans.catalog import query
from kanon.sources.tables import read_table


@query("ordered_concat", """
select l_orderkey, nullif(string_agg(cast(l_partkey as varchar), ', ' order by l_linenumber, l_partkey, l_suppkey)
                          filter (where l_returnflag = 'R'), '') as concat
from lineitem group by l_orderkey""")
def q_ordered_concat(spark, sf):
    """Part keys of returned lines per order, in line order (ties by part, supplier); none → NULL."""
    li = read_table(spark, sf, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return AG.ordered_concat(li, "l_orderkey", F.col("l_partkey").cast("string"), order,
                             where=F.col("l_returnflag") == "R")


@query("json_agg_ordered", """
select l_orderkey, cast(to_json(list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_returnflag': l_returnflag}
                                     order by l_linenumber, l_partkey, l_suppkey)) as varchar) as json
from lineitem group by l_orderkey""")
def q_json_agg_ordered(spark, sf):
    """A10: the lines of each order as an ordered JSON array of objects."""
    li = read_table(spark, sf, "lineitem")
    return AG.json_agg_ordered(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_returnflag"],
                               ["l_linenumber", "l_partkey", "l_suppkey"])


_CODE_SQL = "lpad(cast(l_suppkey % 100 as varchar), 2, '0') || l_linestatus"


@query("main_code_fallback", f"""
select l_partkey, coalesce(min({_CODE_SQL}) filter (where l_returnflag = 'R'), min({_CODE_SQL})) as main_code
from lineitem group by l_partkey""")
def q_main_code_fallback(spark, sf):
    """The smallest code among main (returned) lines of a part, else among all its lines."""
    li = read_table(spark, sf, "lineitem")
    code = F.concat(F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"), F.col("l_linestatus"))
    return AG.main_code(li, "l_partkey", code, F.col("l_returnflag") == "R")


@query("union_all_flagged", """
select l_partkey, l_orderkey, l_linenumber, true as is_main from lineitem where l_returnflag = 'R'
union all
select l_partkey, l_orderkey, l_linenumber, false as is_main from lineitem where l_returnflag <> 'R'""")
def q_union_all_flagged(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")
    main = li.filter(F.col("l_returnflag") == "R").drop("l_returnflag")
    other = li.filter(F.col("l_returnflag") != "R").drop("l_returnflag")
    return AG.union_flagged(main, other)


@query("union_sources", """
select o_custkey, '{' || array_to_string(list_sort(list_distinct(flatten(list(
    case when o_orderstatus = 'F' then ['CEIDG'] when o_orderstatus = 'O' then ['CEIDG', 'KRS'] else ['KRS'] end)))), ',') || '}'
    as registry_sources
from orders group by o_custkey""")
def q_union_sources(spark, sf):
    """Distinct union of per-row source arrays per customer."""
    o = read_table(spark, sf, "orders")
    src = (F.when(F.col("o_orderstatus") == "F", F.array(F.lit("CEIDG")))
           .when(F.col("o_orderstatus") == "O", F.array(F.lit("CEIDG"), F.lit("KRS")))
           .otherwise(F.array(F.lit("KRS"))))
    u = AG.union_sources(o.select("o_custkey", src.alias("registry_sources")), "o_custkey", "registry_sources")
    return u.select("o_custkey", F.concat(F.lit("{"), F.array_join("registry_sources", ","), F.lit("}"))
                    .alias("registry_sources"))


@query("newest_topk", """
select o_orderkey, o_orderdate from orders order by o_orderdate desc nulls last, o_orderkey asc limit 10""")
def q_newest_topk(spark, sf):
    """L4: the 10 newest orders (NULL dates count as oldest; ties keep key order)."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return AG.newest(o, "o_orderdate", 10, "o_orderkey")
