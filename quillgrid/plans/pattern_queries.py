"""Queries over cyclic patterns of orders and over the structure of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import patterns, tables
from quillgrid.plans import views as v


def _trade(spark: SparkSession, folder: str) -> DataFrame:
    """``c, p, s``: who returned which part of which supplier."""
    items = v.table(spark, folder, "lineitem").filter("l_returnflag = 'R'")
    orders = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return items.join(orders, "l_orderkey").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("c"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"),
    )


def trade_triangles(spark: SparkSession, folder: str) -> DataFrame:
    """Customer, part and supplier of whom each two met in some returned item, not always in the same one."""
    trade = _trade(spark, folder)
    pairs = [trade.select(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ("cp", "ps", "cs")]
    return patterns.triangles(pairs[0].unionByName(pairs[1]).unionByName(pairs[2]))


_TRADE_SQL = """with trade as (select concat('c', o_custkey) c, concat('p', l_partkey) p, concat('s', l_suppkey) s
 from lineitem join orders on o_orderkey = l_orderkey where l_returnflag = 'R')"""

TRADE_TRIANGLES_SQL = _TRADE_SQL + """
select cp.c a, cp.p b, ps.s c from (select distinct c, p from trade) cp join (select distinct p, s from trade) ps on ps.p = cp.p
join (select distinct c, s from trade) cs on cs.c = cp.c and cs.s = ps.s"""


def trade_four_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of suppliers (or of customers) that share two or more on the other side, and the four-cycles that these make."""
    return patterns.four_cycles(_trade(spark, folder).select("c", "s"))


TRADE_FOUR_CYCLES_SQL = _TRADE_SQL + """,
e as (select distinct c a, s b from trade), ends as materialized (select a, b from e union all select b, a from e),
d as materialized (select a node, count(*) n from ends group by a),
paths as (select t.b top, o.b far from ends t join ends o on o.a = t.a
 join d dm on dm.node = t.a join d dt on dt.node = t.b join d df on df.node = o.b
 where (dm.n, dm.node) < (dt.n, dt.node) and (df.n, df.node) < (dt.n, dt.node))
select least(top, far) a, greatest(top, far) b, count(*) between, count(*) * (count(*) - 1) // 2 cycles
from paths group by top, far having count(*) > 1"""


def _statement_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """A statement per order: a line of five blocks per item, and a note over columns 1 to 4 under returned ones."""
    # An item is shuffled once, and not each of its blocks.
    items = tables.together(v.table(spark, folder, "lineitem"), ["l_orderkey"])
    fields = [("l_partkey", 0), ("l_quantity", 1), ("l_extendedprice", 2), ("l_shipdate", 3), ("l_linestatus", 4)]
    y = 30.0 * F.col("l_linenumber")
    blocks = []
    for name, i in fields:
        text = F.col(name).cast("int").cast("string") if i in (1, 2) else F.substring(F.col(name).cast("string"), 1, 10)
        width = 6.0 * F.length(text)
        # Numbers are flush right in their column.
        x0 = F.lit(100.0 * i + 80) - width if i in (0, 1, 2) else F.lit(100.0 * i)
        blocks.append(F.struct(x0.alias("x0"), y.alias("y0"), (x0 + width).alias("x1"), (y + 10).alias("y1"), text.alias("text")))
    note = F.struct(F.lit(100.0).alias("x0"), (y + 14).alias("y0"), F.lit(460.0).alias("x1"), (y + 24).alias("y1"), F.lit("returned").alias("text"))
    all_blocks = F.concat(F.array(*blocks), F.when(F.col("l_returnflag") == "R", F.array(note)).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")))
    return items.select("l_orderkey", F.explode(all_blocks).alias("block")).select("l_orderkey", "block.*")


def statement_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every block of the statements with its row, column and spans."""
    # An item has six blocks at most.
    items = v.table(spark, folder, "lineitem").filter("l_orderkey is not null")
    large = tables.large_tables(items, ["l_orderkey"], tables.LARGE_TABLE // 6)
    cells = tables.extract_cells(_statement_blocks(spark, folder), ["l_orderkey"], large=large)
    return cells.select("l_orderkey", "row_no", "row_span", "col_no", "col_span", "text")


_BLOCKS_SQL = """with items as (select *, 30.0::double * l_linenumber y from lineitem),
flush as (select l_orderkey, y, unnest([{'i': 0, 't': l_partkey::varchar}, {'i': 1, 't': l_quantity::int::varchar},
  {'i': 2, 't': trunc(l_extendedprice)::int::varchar}]) f from items),
plain as (select l_orderkey, y, unnest([{'i': 3, 't': substr(l_shipdate::varchar, 1, 10)}, {'i': 4, 't': l_linestatus}]) f from items),
blocks as materialized (
 select l_orderkey, 100.0 * f.i + 80 - 6.0 * length(f.t) x0, y y0, 100.0 * f.i + 80.0::double x1, y + 10 y1, f.t as text from flush
 union all select l_orderkey, 100.0 * f.i, y, 100.0 * f.i + 6.0 * length(f.t), y + 10, f.t from plain
 union all select l_orderkey, 100.0, y + 14, 460.0, y + 24, 'returned' from items where l_returnflag = 'R')"""


def _bands_sql(name: str, low: str, high: str, extent: str) -> str:
    return f""",
{name}_places as (select l_orderkey, pos, sum(step) step from (select l_orderkey, {low}::double pos, {extent} step from blocks
  union all select l_orderkey, {high}::double, -({extent}) from blocks) group by l_orderkey, pos),
{name}_cover as (select *, sum(step) over w cover, lead(pos) over w until from {name}_places window w as (partition by l_orderkey order by pos)),
{name}_dense as (select *, cover > {tables.GAP_SHARE} * max(cover) over (partition by l_orderkey) dense from {name}_cover),
{name}_begin as (select *, dense and not coalesce(lag(dense) over (partition by l_orderkey order by pos), false) begins from {name}_dense),
{name}_numbered as (select *, sum(begins::int) over (partition by l_orderkey order by pos) band from {name}_begin),
{name}_bands as (select l_orderkey, band, min(pos) lo, max(until) hi from {name}_numbered where dense group by l_orderkey, band),
{name}_lists as materialized (select l_orderkey, list({{'lo': lo, 'hi': hi}}) bands from {name}_bands group by l_orderkey)"""


STATEMENT_CELLS_SQL = _BLOCKS_SQL + _bands_sql("r", "y0", "y1", "x1 - x0") + _bands_sql("c", "x0", "x1", "y1 - y0") + """,
placed as (select b.*, len(r.bands) rn, len(c.bands) cn,
 len(list_filter(r.bands, lambda k: k.hi <= y0)) r0, len(list_filter(r.bands, lambda k: k.lo < y1)) - 1 r1,
 len(list_filter(c.bands, lambda k: k.hi <= x0)) c0, len(list_filter(c.bands, lambda k: k.lo < x1)) - 1 c1
 from blocks b join r_lists r using (l_orderkey) join c_lists c using (l_orderkey))
select l_orderkey, least(r0, rn - 1)::int row_no, greatest(1, r1 - r0 + 1)::int row_span,
 least(c0, cn - 1)::int col_no, greatest(1, c1 - c0 + 1)::int col_span, "text" from placed"""

QUERIES = {
    "trade_triangles": trade_triangles,
    "trade_four_cycles": trade_four_cycles,
    "statement_cells": statement_cells,
}
ORACLES = {
    "trade_triangles": TRADE_TRIANGLES_SQL,
    "trade_four_cycles": TRADE_FOUR_CYCLES_SQL,
    "statement_cells": STATEMENT_CELLS_SQL,
}
