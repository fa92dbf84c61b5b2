"""Event tables built from the driver's parquet tables, and the same in SQL.

``lineitem`` rows play the cells, one supplier is one sample; ``supplier`` with
its nation and region is the sample sheet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["sample_id", "cell_id"]
#: Columns that order the cells of a sample without ties.
CELL_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("sample_id"),
        F.concat_ws(
            "|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.col("l_quantity").cast("long").cast("string"), cents.cast("string"),
        ).alias("cell_id"),
        "l_orderkey", "l_linenumber", "l_partkey",
        *FEATURES,
        (F.col("l_returnflag") == "R").alias("gate_r"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("gate_o"),
        F.when(F.col("l_quantity") < 5, -1)
        .otherwise(F.floor(F.col("l_quantity") / 10).cast("int")).alias("cluster"),
        (F.col("l_extendedprice") / 1000.0).alias("x"),
        ((F.col("l_quantity") - 25.0) * 0.1 + F.col("l_tax")).alias("y"),
    )


CELLS = """cells as (select concat('s', cast(l_suppkey as varchar)) sample_id,
  concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    cast(l_quantity as bigint), cast(round(l_extendedprice * 100) as bigint)) cell_id,
  l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag = 'R' gate_r, case when l_linestatus = 'O' then 1 else 0 end gate_o,
  case when l_quantity < 5 then -1 else cast(floor(l_quantity / 10) as integer) end "cluster",
  l_extendedprice / 1000.0 x, (l_quantity - 25.0) * 0.1 + l_tax y
  from lineitem)"""


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample; a supplier in debt has a blank group."""
    tune(spark)
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    ending = F.when(F.col("s_acctbal") < 5000, ".fcs").otherwise(".DAF")
    number = F.col("s_suppkey").cast("string")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("s"), number, ending).alias("file_name"),
            F.concat(F.lit("sample_"), number).alias("sample_id"),
            F.when(F.col("s_acctbal") < 0, " ").otherwise(F.col("r_name")).alias("group"),
            F.col("n_name").alias("replicate"),
        )
    )


SHEET = """sheet as (select concat('s', cast(s_suppkey as varchar),
    case when s_acctbal < 5000 then '.fcs' else '.DAF' end) file_name,
  concat('s', cast(s_suppkey as varchar)) stem,
  concat('sample_', cast(s_suppkey as varchar)) sample_id,
  case when s_acctbal < 0 then ' ' else r_name end "group", n_name replicate
  from supplier join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey)"""


def labelled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with display labels and their sheet columns."""
    from ..operators.filters import labelled
    from ..operators.joins import attach_sheet

    return attach_sheet(labelled(cells(spark, sf_dir)), sheet(spark, sf_dir))


LABELLED = (
    CELLS + ",\n" + SHEET + """,
labelled as (select c.sample_id, c.cell_id, c.l_quantity, c.l_extendedprice, c.l_discount, c.l_tax,
  c.x, c.y, c.gate_o, c.gate_r, case when c."cluster" = -1 then 'Noise' else cast(c."cluster" as varchar) end "cluster",
  s."group", s.replicate from cells c left join sheet s on c.sample_id = s.stem)"""
)


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and line items as files whose headers differ."""
    from ..operators.schema import concat_df

    tune(spark)
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("orders_"), F.col("o_orderstatus")).alias("file"),
        F.col("o_totalprice").alias("Area_Ch01"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("R1 & PMN"),
    )
    items = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("items_"), F.col("l_returnflag")).alias("file"),
        F.col("l_extendedprice").alias("Area_Ch01"),
        F.col("l_quantity").alias("Std.Dev._Ch03"),
        F.col("l_discount").alias("Modulation_M01_Ch01"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("All"),
        (F.col("l_tax") > 0.04).alias("Taxed"),
    )
    return concat_df(orders, items, join="outer")


MIXED = """mixed as (select concat('orders_', o_orderstatus) file, o_totalprice "Area_Ch01",
  case when o_orderpriority = '1-URGENT' then 1 else 0 end "R1 & PMN", cast(null as double) "Std.Dev._Ch03",
  cast(null as double) "Modulation_M01_Ch01", cast(null as integer) "All", cast(null as boolean) "Taxed"
  from orders
  union all
  select concat('items_', l_returnflag), l_extendedprice, null, l_quantity, l_discount,
  case when l_linestatus = 'O' then 1 else 0 end, l_tax > 0.04 from lineitem)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature names in the naming convention, from the part table."""
    tune(spark)
    number = F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0")
    kind = F.when(F.col("p_retailprice") > 930, "Raw Max Pixel").otherwise("Area")
    place = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("_M"), number)).otherwise(
        F.concat(F.lit("_Ch"), number)
    )
    return (
        table(spark, sf_dir, "part")
        .select(F.concat(kind, F.lit("_"), F.col("p_name"), place).alias("feature"))
        .distinct()
    )


CATALOGUE = """catalogue as (select distinct concat(
  case when p_retailprice > 930 then 'Raw Max Pixel' else 'Area' end, '_', p_name,
  case when p_type = 'ECONOMY' then '_M' else '_Ch' end,
  lpad(cast(p_size % 12 + 1 as varchar), 2, '0')) feature from part)"""


def dirty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with missing and infinite values where a tax or discount is zero."""
    base = cells(spark, sf_dir)
    inf = F.lit(float("inf"))
    return base.withColumns(
        {
            "l_discount": F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")),
            "l_tax": F.when(F.col("l_tax") == 0, F.when(F.col("gate_r"), inf).otherwise(-inf)).otherwise(F.col("l_tax")),
        }
    )


DIRTY = (
    CELLS + """,
dirty as (select * replace (
  case when l_discount = 0 then null else l_discount end as l_discount,
  case when l_tax = 0 then case when gate_r then 'inf'::double else '-inf'::double end else l_tax end as l_tax)
  from cells)"""
)
