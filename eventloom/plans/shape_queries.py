"""Queries: projections, filters, unions, samples and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import cluster_label, draw_order, file_stem, q
from ..operators import filters, joins, ordering, quality, scaling, schema
from .registry import query
from .tables import (
    CATALOGUE,
    CELL_ORDER,
    CELLS,
    DIRTY,
    FEATURES,
    KEY,
    MIXED,
    SHEET,
    catalogue,
    cells,
    dirty_cells,
    mixed_files,
    sheet,
    table,
)

DIGITS = 6


def rounded(df, *columns, digits: int = DIGITS):
    return df.withColumns({c: F.round(q(c), digits) for c in columns})


# ---- projections -----------------------------------------------------------


@query(
    "P1_header_normalise",
    f"""with {CELLS} select sample_id, cell_id, l_quantity "Area_plus_Length",
    l_discount "Leukocytes_and_Erys", l_tax "TminusCells" from cells""",
)
def p1(spark, d):
    return schema.normalise_header(
        cells(spark, d).select(
            "sample_id", "cell_id",
            F.col("l_quantity").alias(" Area + Length"),
            F.col("l_discount").alias("Leukocytes & Erys "),
            F.col("l_tax").alias("T-Cells"),
        )
    )


@query(
    "P2_rename_variables",
    f"""with {CELLS} select sample_id "Donor", cell_id, l_quantity "Area CD4" from cells""",
)
def p2(spark, d):
    base = cells(spark, d).select("sample_id", "cell_id", "l_quantity")
    renamed = schema.rename_variables(base, {"sample_id": "Donor", "l_quantity": "Area CD4"})
    return schema.rename_variables(renamed, {"Donor": "X", "absent": "Y"})


@query("P3_drop_variables", f"with {CELLS} select sample_id, cell_id, l_quantity, l_tax from cells")
def p3(spark, d):
    base = cells(spark, d).select("sample_id", "cell_id", *FEATURES)
    return schema.drop_variables(base, "l_extendedprice", "l_discount")


@query("P4_save_feature", f"with {CELLS} select cell_id, l_tax, l_quantity from cells")
def p4(spark, d):
    return schema.save_feature(cells(spark, d), "cell_id", "l_tax", "l_quantity")


@query(
    "P5_add_metadata",
    f"""with {CELLS} select sample_id, cell_id, 'JBZ' "Donor", l_quantity * 2 "Area2" from cells""",
)
def p5(spark, d):
    base = cells(spark, d)
    values = base.select(*KEY, (F.col("l_quantity") * 2).alias("Area2"))
    constant = schema.add_metadata(base.select(*KEY), "Donor", "JBZ")
    return schema.add_metadata_rows(constant, values, KEY, "Area2")


@query(
    "P7_weighted_features",
    f"""with {CELLS} select cell_id, l_quantity * 2 l_quantity, l_tax * 2 l_tax, l_discount from cells""",
)
def p7(spark, d):
    base = cells(spark, d).select("cell_id", "l_quantity", "l_tax", "l_discount")
    return schema.weighted_features(base, ["l_quantity", "l_tax"], 2)


@query(
    "P8_row_index",
    f"""with {CELLS} select cell_id, row_number() over (order by l_orderkey, l_linenumber, l_partkey,
    l_quantity, l_extendedprice) - 1 "Index" from cells""",
)
def p8(spark, d):
    base = cells(spark, d).select("cell_id", *CELL_ORDER)
    return schema.add_index(base, CELL_ORDER).select("cell_id", "Index")


@query(
    "W1_sample_index",
    f"""with {CELLS} select sample_id, cell_id, row_number() over (partition by sample_id order by
    l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 cell_index from cells""",
)
def w1(spark, d):
    base = cells(spark, d).select(*KEY, *CELL_ORDER)
    return ordering.with_position(base, ["sample_id"], CELL_ORDER).select(*KEY, "cell_index")


MIXED_COLUMNS = ["Area_Ch01", "R1 & PMN", "Std.Dev._Ch03", "Modulation_M01_Ch01", "All", "Taxed"]

#: (file, feature) and (file, population) rows of the mixed files, in SQL.
FILE_COLUMNS = (
    MIXED + """,
file_columns as (select file, feature from (
  select file, count("Area_Ch01") "Area_Ch01", count("R1 & PMN") "R1 & PMN", count("Std.Dev._Ch03") "Std.Dev._Ch03",
    count("Modulation_M01_Ch01") "Modulation_M01_Ch01", count("All") "All", count("Taxed") "Taxed" from mixed group by file)
  unpivot (n for feature in ("Area_Ch01", "R1 & PMN", "Std.Dev._Ch03", "Modulation_M01_Ch01", "All", "Taxed"))
  where n > 0),
gates as (
  select file, 'All' population from mixed where "All" is not null group by file
    having min("All") = 0 and max("All") = 1
  union all select file, 'Taxed' from mixed group by file having count("Taxed") > 0
  union all select file, 'R1 & PMN' from mixed group by file having count("R1 & PMN") > 0)"""
)


def _file_columns(spark, d):
    return quality.columns_per_file(mixed_files(spark, d), "file", MIXED_COLUMNS)


def _file_gates(spark, d):
    """Gates of each file, among the columns the file has."""
    found = quality.gate_columns(mixed_files(spark, d), "file")
    have = _file_columns(spark, d).withColumnRenamed("feature", "population")
    return found.join(have, ["file", "population"], "left_semi")


@query(
    "P9_feature_catalogue",
    f"""with {FILE_COLUMNS} select feature, count(distinct file) n_files,
    count(distinct file) = (select count(distinct file) from file_columns) in_all_files
    from file_columns where feature not in (select population from gates) group by feature""",
)
def p9(spark, d):
    return schema.feature_catalogue(_file_columns(spark, d), _file_gates(spark, d))


@query(
    "P10_default_exclusion",
    f"""with {CATALOGUE} select feature, not (contains(feature, 'Raw') or contains(feature, 'Max Pixel')
    or contains(feature, 'All') or contains(feature, 'Time')) included from catalogue""",
)
def p10(spark, d):
    return schema.feature_selection(catalogue(spark, d))


@query(
    "P11_channel_filter",
    f"""with {CATALOGUE} select feature, not (contains(feature, 'Raw') or
    regexp_matches(feature, '(Ch04|M04|Ch11|M11)$')) included from catalogue""",
)
def p11(spark, d):
    return schema.feature_selection(catalogue(spark, d), ["Ch04", "Ch11"])


@query(
    "P12_feature_list_import",
    f"""with {CATALOGUE} , names as (select distinct trim(p_name) || '_Ch03' n from part
    union select distinct 'Area_' || p_name || '_Ch03' from part)
    select n feature, n in (select feature from catalogue) available from names""",
)
def p12(spark, d):
    part = table(spark, d, "part")
    plain = part.select(F.concat(F.lit("  "), "p_name", F.lit("_Ch03 ")).alias("Included"))
    full = part.select(F.concat(F.lit("Area_"), "p_name", F.lit("_Ch03")).alias("Included"))
    return schema.import_feature_list(plain.union(full), catalogue(spark, d), "included")


@query(
    "P14_numeric_columns",
    f"with {CELLS} select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, "
    f"l_discount, l_tax, gate_o, \"cluster\", x, y from cells",
)
def p14(spark, d):
    from ..functions.columns import numeric_columns

    base = cells(spark, d)
    return base.select(*numeric_columns(base))


@query(
    "P15_column_range",
    f"with {CELLS} select l_quantity, l_extendedprice, l_discount, l_tax from cells",
)
def p15(spark, d):
    base = cells(spark, d)
    return base.select(*schema.column_range(base, "l_quantity", "l_tax"))


# ---- filters ---------------------------------------------------------------


@query("F1_select_condition", f"with {CELLS} select sample_id, cell_id, l_tax from cells where l_quantity = 7")
def f1(spark, d):
    return filters.select_condition(cells(spark, d), "l_quantity", 7.0).select(*KEY, "l_tax")


@query(
    "F2_population_gate",
    f"""with {MIXED} select file, count(*) n, round(sum("Area_Ch01"), 2) area from mixed
    where "All" = 1 or file like 'orders%' group by file""",
)
def f2(spark, d):
    mixed = mixed_files(spark, d)
    gated = filters.population_gate(mixed, "All", ~F.col("file").startswith("orders"))
    return gated.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("Area_Ch01"), 2).alias("area")
    )


@query(
    "F2_gate_report",
    f"""with {MIXED} select file, count(*) n_events,
    count(*) filter (file like 'orders%' or "All" = 1) n_kept, file not like 'orders%' has_gate,
    case when file like 'orders%' then 'gate absent - all events kept' else 'gated' end note
    from mixed group by file""",
)
def f2_report(spark, d):
    has = ~F.col("file").startswith("orders")
    return filters.gate_report(mixed_files(spark, d), "All", has, "file")


@query(
    "F3_drop_events",
    f"""with {CELLS}, i as (select cell_id, row_number() over (order by l_orderkey, l_linenumber, l_partkey,
    l_quantity, l_extendedprice) - 1 "Index" from cells) select * from i where "Index" not between 10 and 2999""",
)
def f3(spark, d):
    return filters.drop_events(p8(spark, d), 10, 2999)


@query(
    "F4_missing_features",
    f"""with {FILE_COLUMNS}, w as (select unnest(['Area_Ch01', 'Std.Dev._Ch03', 'Modulation_M01_Ch01']) feature),
    f as (select distinct file from file_columns),
    m as (select f.file, w.feature from f, w where not exists (select 1 from file_columns c
      where c.file = f.file and c.feature = w.feature))
    select file, list_sort(list(feature)) missing from m group by file""",
)
def f4(spark, d):
    return filters.missing_features(
        _file_columns(spark, d), ["Area_Ch01", "Std.Dev._Ch03", "Modulation_M01_Ch01"]
    )


@query(
    "F5_find_cells",
    """with ids as (select distinct o_custkey id from orders)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_orderkey in (select id from ids)""",
)
def f5(spark, d):
    texts = table(spark, d, "orders").select(
        F.concat(F.col("o_custkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_custkey").cast("string")).alias("t")
    )
    ids = filters.id_list(texts, "t")
    events = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return filters.find_cells(events, ids, "l_orderkey")[0]


@query(
    "F5_missing_cells",
    """select distinct o_custkey l_orderkey from orders
    where o_custkey not in (select l_orderkey from lineitem)""",
)
def f5_missing(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return filters.find_cells(table(spark, d, "lineitem"), ids, "l_orderkey")[1]


@query(
    "F6_value_window",
    f"with {CELLS} select cell_id, x, y from cells where x >= 20 and x <= 60 and y <= 0.5",
)
def f6(spark, d):
    return filters.value_window(cells(spark, d), (20, 60), (None, 0.5)).select("cell_id", "x", "y")


@query("F7_valid_group", f"""with {SHEET} select file_name, "group" from sheet where trim("group") <> ''""")
def f7(spark, d):
    return filters.with_group(sheet(spark, d)).select("file_name", "group")


@query(
    "F8_finite_rows",
    f"with {DIRTY} select cell_id, l_discount, l_tax from dirty where l_discount is not null and not isinf(l_tax)",
)
def f8(spark, d):
    return filters.finite_rows(dirty_cells(spark, d), ["l_discount", "l_tax"]).select(
        "cell_id", "l_discount", "l_tax"
    )


@query(
    "F9_validity_split",
    f"""with {SHEET} select file_name, trim("group") <> '' is_valid from sheet""",
)
def f9(spark, d):
    return filters.with_validity(sheet(spark, d), "group").select("file_name", "is_valid")


@query(
    "F10_blank_sample_ids",
    f"""with {SHEET} select count(*) n_rows, count(*) filter (trim("group") = '') n_blank from sheet""",
)
def f10(spark, d):
    return filters.blank_sample_ids(sheet(spark, d), "group")


@query("F11_cluster_list", f"""with {CELLS} select cell_id, "cluster" from cells where "cluster" in (1, 4)""")
def f11(spark, d):
    return filters.keep_clusters(cells(spark, d), [1, 4]).select("cell_id", "cluster")


@query(
    "F12_minimum_counts",
    f"""with {CELLS} select count(*) n_rows, count(distinct sample_id) n_groups, cast(4 as bigint) n_features,
    count(*) >= 100 and count(distinct sample_id) >= 2 passes from cells""",
)
def f12(spark, d):
    return filters.guard_counts(cells(spark, d), FEATURES, "sample_id")


# ---- unions and populations ------------------------------------------------


@query(
    "U1_concat_inner",
    """select o_orderkey k, o_totalprice v from orders union all select l_orderkey, l_extendedprice from lineitem""",
)
def u1(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "o_custkey")
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"), "l_tax")
    return schema.concat_df(a, b)


@query("U1_concat_outer", f"with {MIXED} select * from mixed")
def u1_outer(spark, d):
    return mixed_files(spark, d)


@query(
    "U2_sample_union",
    f"""with {CELLS} select sample_id, count(*) n, round(avg(l_quantity), 6) mean_quantity from cells
    where gate_r or gate_o = 1 group by sample_id""",
)
def u2(spark, d):
    base = cells(spark, d).select("sample_id", "l_quantity", "gate_r", "gate_o")
    one = filters.population_gate(base, "gate_r")
    two = filters.population_gate(base.filter(~F.col("gate_r")), "gate_o")
    return schema.concat_df(one, two).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), DIGITS).alias("mean_quantity")
    )


@query(
    "U3_population_sets",
    f"""with {FILE_COLUMNS} select population, count(distinct file) n_files,
    count(distinct file) = (select count(distinct file) from mixed) common from gates group by population""",
)
def u3(spark, d):
    return quality.population_sets(_file_gates(spark, d), mixed_files(spark, d))


@query(
    "A20_gate_columns",
    f"with {FILE_COLUMNS} select file, population from gates",
)
def a20(spark, d):
    return _file_gates(spark, d)


# ---- samples ---------------------------------------------------------------


@query(
    "L1_select_events",
    f"""with {CELLS}, s as (select cell_id, l_quantity from cells order by md5(concat_ws('|', cell_id, '1')) limit 1000)
    select * from s""",
)
def l1(spark, d):
    return ordering.select_events(cells(spark, d).select("cell_id", "l_quantity"), 1000, ["cell_id"])


@query(
    "L2_cap_per_sample",
    f"""with {CELLS} select sample_id, cell_id, l_quantity from cells qualify row_number() over
    (partition by sample_id order by md5(concat_ws('|', sample_id, cell_id, '42'))) <= 300""",
)
def l2(spark, d):
    base = cells(spark, d).select(*KEY, "l_quantity")
    return ordering.cap_per_group(base, ["sample_id"], KEY, 300)


@query(
    "L2_cap_report",
    f"""with {CELLS} select sample_id, count(*) n_before, cast(600 as bigint) n_after from cells
    group by sample_id having count(*) > 600""",
)
def l2_report(spark, d):
    return ordering.cap_report(cells(spark, d), "sample_id", 600)


@query(
    "L3_adaptive_cap",
    f"""with {CELLS} select sample_id, cell_id from cells qualify row_number() over
    (partition by sample_id order by md5(concat_ws('|', sample_id, cell_id, '42'))) <= 200""",
)
def l3(spark, d):
    n = ordering.adaptive_cap(len(FEATURES))
    return ordering.cap_per_group(cells(spark, d).select(*KEY), ["sample_id"], KEY, n)


@query(
    "L4_global_cap",
    f"""with {CELLS} select sample_id, cell_id from cells
    order by md5(concat_ws('|', sample_id, cell_id, '42')) limit 3000""",
)
def l4(spark, d):
    return ordering.cap_total(cells(spark, d).select(*KEY), KEY, 3000)


@query("L7_sorted_listing", f"with {CATALOGUE} select feature from catalogue order by feature desc")
def l7(spark, d):
    return ordering.sorted_listing(catalogue(spark, d), "feature", descending=True)


# ---- scaling ---------------------------------------------------------------


@query(
    "N1_stand_scaler",
    f"""with {CELLS} select cell_id, {", ".join(
        f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) {c}" for c in FEATURES)} from cells""",
)
def n1(spark, d):
    base = cells(spark, d).select("cell_id", *FEATURES)
    return rounded(scaling.stand_scaler(base, "l_quantity", "l_tax"), *FEATURES)


@query(
    "N2_minmax_norm",
    f"""with {CELLS} select cell_id, {", ".join(
        f"round(({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()), 6) {c}" for c in FEATURES)} from cells""",
)
def n2(spark, d):
    base = cells(spark, d).select("cell_id", *FEATURES)
    return rounded(scaling.minmax_norm(base, "l_quantity", "l_tax"), *FEATURES)


def _quantile_sql() -> str:
    """Interpolated position from below and above on exact landmarks."""
    parts = []
    for c in FEATURES:
        parts.append(
            f"""g_{c} as (select unnest(range(0, 1000)) j, unnest(quantile_cont({c},
              list_transform(range(0, 1000), lambda i: i / 999.0))) v from cells),
            d_{c} as (select distinct {c} x from cells),
            u_{c} as (select x, max(j) j from d_{c} join (select v, max(j) j from g_{c} group by v) g on g.v <= x group by x),
            l_{c} as (select x, min(j) j from d_{c} join (select v, min(j) j from g_{c} group by v) g on g.v >= x group by x),
            p_{c} as (select u.x,
              (u.j + case when u.j < 999 then (u.x - a.v) / (b.v - a.v) else 0 end) / 999.0 up,
              (l.j - case when l.j > 0 then (e.v - u.x) / (e.v - f.v) else 0 end) / 999.0 down
              from u_{c} u join l_{c} l on u.x = l.x join g_{c} a on a.j = u.j
              left join g_{c} b on b.j = u.j + 1 join g_{c} e on e.j = l.j left join g_{c} f on f.j = l.j - 1)"""
        )
    chosen = ", ".join(f"round(0.5 * (p_{c}.up + p_{c}.down), 5) {c}" for c in FEATURES)
    joins_ = " ".join(f"join p_{c} on p_{c}.x = cells.{c}" for c in FEATURES)
    return f"with {CELLS}, {', '.join(parts)} select cell_id, {chosen} from cells {joins_}"


@query("N3_quant_scaler", _quantile_sql())
def n3(spark, d):
    base = cells(spark, d).select("cell_id", *FEATURES)
    return rounded(scaling.quant_scaler(base, "l_quantity", "l_tax"), *FEATURES, digits=5)


_RANK = "round((2 * (rank() over (order by {0}) - 1) + count(*) over (partition by {0}) - 1) / 2.0 / (count(*) over () - 1), 6) {0}"


@query(
    "N3_rank_scaler",
    f"with {CELLS} select cell_id, " + ", ".join(_RANK.format(c) for c in ("l_quantity", "l_extendedprice", "l_discount")) + ", l_tax from cells",
)
def n3_rank(spark, d):
    base = cells(spark, d).select("cell_id", *FEATURES)
    scaled = scaling.quant_scaler(base, "l_quantity", "l_discount", mode="rank")
    return rounded(scaled, "l_quantity", "l_extendedprice", "l_discount")


@query(
    "N3_sketch_error",
    f"with {CELLS} select 'l_extendedprice' feature, count(*) n, true near from cells",
)
def n3_sketch(spark, d):
    """Sketched quantiles beside exact ranks: every row within the stated error, and what
    two neighbouring landmarks leave between them."""
    base = cells(spark, d).select(F.col("l_extendedprice").alias("v"), F.col("l_extendedprice").alias("w"))
    ranked = scaling.quant_scaler(base, "v", "v", mode="rank")
    both = scaling.quant_scaler(ranked, "w", "w", mode="sketch")
    within = F.abs(F.col("v") - F.col("w")) <= 1 / scaling.SKETCH_ACCURACY + 1 / (scaling.LANDMARKS - 1)
    return both.agg(F.count(F.lit(1)).alias("n"), F.bool_and(within).alias("near")).select(
        F.lit("l_extendedprice").alias("feature"), "n", "near"
    )


@query(
    "N4_clip_outliers",
    f"""with {CELLS} select cell_id, round(greatest(least(l_extendedprice,
      avg(l_extendedprice) over () + 1.5 * stddev_samp(l_extendedprice) over ()),
      avg(l_extendedprice) over () - 1.5 * stddev_samp(l_extendedprice) over ()), 4) l_extendedprice from cells""",
)
def n4(spark, d):
    base = cells(spark, d).select("cell_id", "l_extendedprice")
    return rounded(scaling.clip_outliers(base, width=1.5), "l_extendedprice", digits=4)


@query(
    "N5_infinite_to_null",
    f"""with {DIRTY} select cell_id, case when isinf(l_tax) then null else l_tax end l_tax from dirty""",
)
def n5(spark, d):
    return scaling.infinite_to_null(dirty_cells(spark, d).select("cell_id", "l_tax"))


@query(
    "N6_rescale_importance",
    """with t as (select l_suppkey feature, sum(l_quantity) importance from lineitem group by 1),
    s as (select *, (importance - min(importance) over ()) / (max(importance) over () - min(importance) over ()) n from t)
    select feature, importance, round(n, 6) importance_normalized, round(n * 100 / sum(n) over (), 6) percentage_importance from s""",
)
def n6(spark, d):
    sums = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("feature")).agg(
        F.sum("l_quantity").alias("importance")
    )
    return rounded(
        scaling.rescale_importance(sums), "importance_normalized", "percentage_importance"
    )


@query(
    "N7_standardise_selected",
    f"""with {DIRTY}, c as (select cell_id, l_discount, case when isinf(l_tax) then null else l_tax end l_tax from dirty)
    select cell_id, round((l_discount - avg(l_discount) over ()) / stddev_pop(l_discount) over (), 6) l_discount,
    round((l_tax - avg(l_tax) over ()) / stddev_pop(l_tax) over (), 6) l_tax from c""",
)
def n7(spark, d):
    chosen = ["l_discount", "l_tax"]
    base = dirty_cells(spark, d).select("cell_id", *chosen)
    return rounded(scaling.standardise(scaling.infinite_to_null(base), chosen), *chosen)


# ---- text rules ------------------------------------------------------------


@query(
    "X1_replace_values",
    f"""with {CELLS} select cell_id, replace(replace(cast("cluster" as varchar), '1', 'A'), '-A', 'noise') "cluster" from cells""",
)
def x1(spark, d):
    base = cells(spark, d).select("cell_id", "cluster")
    return joins.replace_values(base, "cluster", {1: "A", "-A": "noise"})


@query(
    "X1_map_values",
    f"""with {CELLS} select cell_id, case when "cluster" = 1 then 'A' when "cluster" = 4 then 'B'
    else cast("cluster" as varchar) end "cluster" from cells""",
)
def x1_exact(spark, d):
    base = cells(spark, d).select("cell_id", "cluster")
    return joins.map_values(base, "cluster", {1: "A", 4: "B"})


@query("X2_strip_ending", f"with {SHEET} select file_name, stem from sheet")
def x2(spark, d):
    return sheet(spark, d).select("file_name", file_stem(F.col("file_name")).alias("stem"))


@query(
    "X3_cluster_label",
    f"""with {CELLS} select cell_id, case when "cluster" = -1 then 'Noise' else cast("cluster" as varchar) end label from cells""",
)
def x3(spark, d):
    return cells(spark, d).select("cell_id", cluster_label(F.col("cluster")).alias("label"))


@query(
    "X4_auto_sample_ids",
    """with have as (select distinct cast(l_suppkey as varchar) f, l_suppkey k from lineitem),
    every as (select distinct cast(o_custkey as varchar) f from orders)
    select f file_name, 'sample_' || cast((select max(k) from have) + row_number() over (order by f) as varchar) sample_id,
    '' "group", '' replicate from every where f not in (select f from have)""",
)
def x4(spark, d):
    number = F.col("l_suppkey").cast("string")
    have = table(spark, d, "lineitem").select(
        F.concat(number, F.lit(".daf")).alias("file_name"),
        F.concat(F.lit("sample_"), number).alias("sample_id"),
        F.lit("").alias("group"),
    ).distinct()
    files = table(spark, d, "orders").select(
        F.concat(F.col("o_custkey").cast("string"), F.lit(".fcs")).alias("file_name")
    )
    return joins.auto_sample_rows(have, files)


@query(
    "X5_fill_sample_id",
    f"""with {SHEET} select file_name, case when trim("group") = '' then file_name else trim("group") end sample_id from sheet""",
)
def x5(spark, d):
    blank = sheet(spark, d).select("file_name", F.trim("group").alias("sample_id"))
    return joins.fill_sample_id(blank)
