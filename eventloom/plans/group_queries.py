"""Queries: joins, cluster composition, group statistics, profiles, plot data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import file_stem
from ..operators import clusters, filters, importance, joins, ordering, plotdata, quality, schema
from .registry import query
from .shape_queries import DIGITS, rounded
from .tables import (
    CELL_ORDER,
    CELLS,
    DIRTY,
    FEATURES,
    KEY,
    LABELLED,
    SHEET,
    cells,
    dirty_cells,
    labelled_cells,
    sheet,
    table,
)

# ---- joins -----------------------------------------------------------------


@query(
    "J1_attach_sheet",
    f"""with {CELLS}, {SHEET} select c.sample_id, c.cell_id, c.x, c.y, s.stem file_name, s."group", s.replicate
    from cells c left join sheet s on c.sample_id = s.stem""",
)
def j1(spark, d):
    """No sample id matches here, so the file name decides."""
    return joins.attach_sheet(cells(spark, d).select(*KEY, "x", "y"), sheet(spark, d))


@query(
    "J1_attach_sheet_by_id",
    f"""with {CELLS}, {SHEET} select 'sample_' || substr(c.sample_id, 2) sample_id, c.cell_id, s.stem file_name,
    s."group", s.replicate from cells c left join sheet s on c.sample_id = s.stem""",
)
def j1_id(spark, d):
    events = cells(spark, d).select(
        F.regexp_replace("sample_id", "^s", "sample_").alias("sample_id"), "cell_id",
        F.lit("replaced").alias("replicate"),
    )
    return joins.attach_sheet(events, sheet(spark, d))


@query(
    "J2_reattach_sheet",
    f"""with {CELLS}, {SHEET} select c.sample_id || '.fcs' file_name, c.cell_id, 'own' "group", s.replicate
    from cells c left join sheet s on c.sample_id = s.stem""",
)
def j2(spark, d):
    events = cells(spark, d).select(
        F.concat("sample_id", F.lit(".fcs")).alias("file_name"), "cell_id", F.lit("own").alias("group")
    )
    return joins.reattach_sheet(events, sheet(spark, d).drop("sample_id"))


@query(
    "J3_lookup_features",
    f"with {CELLS} select sample_id, cell_id, x, y, case when gate_r then l_tax end l_tax, "
    f"case when gate_r then l_quantity end q2 from cells",
)
def j3(spark, d):
    base = cells(spark, d)
    features = base.filter("gate_r").select(*KEY, "l_tax", F.col("l_quantity").alias("q2"))
    return joins.lookup_features(base.select(*KEY, "x", "y"), features, KEY)


@query(
    "J4_labels_with_features",
    f"""with {CELLS} select sample_id, cell_id, "cluster", l_discount from cells where gate_o = 1""",
)
def j4(spark, d):
    base = cells(spark, d)
    features = base.filter("gate_o = 1").select(*KEY, "l_discount")
    return joins.lookup_features(base.select(*KEY, "cluster"), features, KEY, "inner")


@query(
    "J5_concat_variables",
    """with a as (select p_partkey k, p_size "Height" from part),
    b as (select p_partkey + 500 k, p_retailprice "Perimeter" from part)
    select coalesce(a.k, b.k) k, "Height", "Perimeter" from a full join b on a.k = b.k""",
)
def j5(spark, d):
    part = table(spark, d, "part")
    a = part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("Height"))
    b = part.select((F.col("p_partkey") + 500).alias("k"), F.col("p_retailprice").alias("Perimeter"))
    return joins.concat_variables(["k"], a, b)


@query(
    "J6_pair_by_order",
    f"""with {CELLS},
    f as (select sample_id, cell_id, row_number() over (partition by sample_id order by
      md5(concat_ws('|', cell_id, '42'))) - 1 p from cells),
    e as (select sample_id, x, y, row_number() over (partition by sample_id order by
      md5(concat_ws('|', cell_id, '43'))) - 1 p from cells where gate_r),
    n as (select sample_id, max(p) m from e group by sample_id)
    select f.sample_id, f.cell_id, e.x, e.y from f join n on f.sample_id = n.sample_id
    join e on e.sample_id = f.sample_id and e.p = least(f.p, n.m)""",
)
def j6(spark, d):
    base = cells(spark, d)
    points = base.filter("gate_r").select(*KEY, "x", "y")
    return joins.pair_by_order(base.select(*KEY), points, "sample_id", ["cell_id"], ["cell_id"])


@query(
    "J8_check_sheet",
    f"""with {CELLS}, {SHEET}, a as (select distinct stem from sheet where trim("group") <> ''),
    b as (select distinct case when sample_id like '%7' then 'lost' else '' end || sample_id stem from cells)
    select coalesce(a.stem, b.stem) stem, case when a.stem is null then 'only in data'
    when b.stem is null then 'only in sheet' else 'matched' end status from a full join b on a.stem = b.stem""",
)
def j8(spark, d):
    lost = F.when(F.col("sample_id").endswith("7"), "lost").otherwise("")
    files = cells(spark, d).select(F.concat(lost, "sample_id", F.lit(".fcs")).alias("file_name"))
    return joins.check_sheet(filters.with_group(sheet(spark, d)), files)


@query(
    "J9_attach_labels",
    f"""with {CELLS} select sample_id, cell_id, x, case when gate_r then "cluster" end "cluster" from cells""",
)
def j9(spark, d):
    base = cells(spark, d)
    labels = base.filter("gate_r").select(*KEY, "cluster")
    return joins.attach_labels(base.select(*KEY, "x"), labels, KEY)


@query(
    "J10_sample_groups",
    f"""with {CELLS}, {SHEET} select distinct c.sample_id, trim(s."group") "group" from cells c
    join sheet s on c.sample_id = s.stem where trim(s."group") <> ''""",
)
def j10(spark, d):
    samples = cells(spark, d).select("sample_id").distinct()
    twice = sheet(spark, d)
    twice = twice.withColumn("line", F.lit(1)).union(
        twice.withColumn("group", F.lit("later")).withColumn("line", F.lit(2))
    )
    return joins.sample_groups(samples, twice, "group", ["line"])


@query(
    "J11_new_files",
    f"""with {CELLS}, {SHEET} select distinct sample_id file_name from cells
    where sample_id not in (select stem from sheet where trim("group") <> '')""",
)
def j11(spark, d):
    files = cells(spark, d).select(F.concat("sample_id", F.lit(".fcs")).alias("file_name"))
    return joins.new_files(files, filters.with_group(sheet(spark, d)))


@query(
    "Q6_duplicate_sheet_rows",
    """select regexp_replace(o_orderstatus || cast(o_custkey as varchar), 'x', '') file_name, count(*) n_rows
    from orders group by 1 having count(*) > 1""",
)
def q6(spark, d):
    files = table(spark, d, "orders").select(
        F.concat("o_orderstatus", F.col("o_custkey").cast("string"), F.lit(".FCS")).alias("file_name")
    )
    return joins.duplicate_sheet_rows(files)


# ---- cluster composition ---------------------------------------------------


@query(
    "A1_cluster_sizes",
    f"""with {LABELLED} select "cluster", count(*) n, round(count(*) * 100.0 / sum(count(*)) over (), 6) pct
    from labelled group by "cluster\"""",
)
def a1(spark, d):
    return rounded(clusters.cluster_sizes(filters.labelled(cells(spark, d))), "pct")


@query(
    "A2_sample_summary",
    f"""with {CELLS}, c as (select "cluster", sample_id, count(*) n from cells group by 1, 2),
    r as (select *, row_number() over (partition by "cluster" order by n desc, sample_id) r,
      count(*) over (partition by "cluster") k from c)
    select "cluster", string_agg(sample_id || ': ' || n, ', ' order by r) ||
      case when max(k) > 3 then ' (+' || (max(k) - 3) || ' more)' else '' end samples
    from r where r <= 3 group by "cluster\"""",
)
def a2(spark, d):
    return clusters.sample_summary(cells(spark, d))


_A3 = f"""with {LABELLED}, g as (select "cluster", "group", count(*) n from labelled where trim("group") <> '' group by 1, 2)"""


@query(
    "A3_cluster_by_group",
    _A3 + """ select "cluster", "group", n, round(n * 100.0 / sum(n) over (partition by "cluster"), 6) pct from g""",
)
def a3(spark, d):
    return rounded(clusters.cluster_by_group(labelled_cells(spark, d)), "pct")


@query(
    "A4_cluster_group_grid",
    f"""with {LABELLED}, f as (select * from labelled where trim("group") <> ''),
    g as (select "cluster", "group", count(*) n from f group by 1, 2)
    select k."cluster", v."group", coalesce(g.n, 0) n,
      round(coalesce(g.n * 100.0 / sum(g.n) over (partition by k."cluster"), 0), 6) pct
    from (select distinct "cluster" from f) k cross join (select distinct "group" from f) v
    left join g on g."cluster" = k."cluster" and g."group" = v."group\"""",
)
def a4(spark, d):
    return rounded(clusters.cluster_group_grid(labelled_cells(spark, d)), "pct")


_SHARES = f"""with {LABELLED}, g as (select * from labelled where trim("group") <> '' and gate_o = 1),
  t as (select sample_id, "group", count(*) n from g group by 1, 2),
  k as (select distinct "cluster" from g),
  c as (select sample_id, "cluster", count(*) c from g group by 1, 2),
  shares as (select t.sample_id, t."group", k."cluster", coalesce(c.c, 0) * 100.0 / t.n pct from t cross join k
    left join c on c.sample_id = t.sample_id and c."cluster" = k."cluster")"""


def _shares(spark, d):
    gated = filters.population_gate(labelled_cells(spark, d), "gate_o")
    return clusters.sample_shares(filters.with_group(gated), carry=["group"])


@query("A11_sample_share", _SHARES + """ select sample_id, "group", "cluster", round(pct, 6) pct from shares""")
def a11(spark, d):
    return rounded(_shares(spark, d), "pct")


@query(
    "A12_group_share",
    _SHARES + """ select "cluster", "group", round(avg(pct), 6) mean,
    round(coalesce(stddev_samp(pct), 0) / sqrt(count(*)), 6) sem, count(*) n from shares group by 1, 2""",
)
def a12(spark, d):
    stats = clusters.group_statistics(_shares(spark, d), "pct", ["cluster", "group"], with_values=False)
    return rounded(stats, "mean", "sem")


@query(
    "A12_group_values",
    _SHARES + """ select "cluster", "group", array_to_string(list_transform(list_sort(list(pct)),
    lambda v: printf('%.4f', v + 1e-9)), ';') vals from shares group by 1, 2""",
)
def a12_values(spark, d):
    stats = clusters.group_statistics(_shares(spark, d), "pct", ["cluster", "group"])
    text = F.transform("values", lambda v: F.format_string("%.4f", v + 1e-9))
    return stats.select("cluster", "group", F.array_join(text, ";").alias("vals"))


_MOMENTS = """, m as (select "cluster", "group" g, avg(pct) m, var_samp(pct) v, count(*) n from shares group by 1, 2 having count(*) > 1),
  pairs as (select a."cluster", a.g group1, b.g group2, a.n n1, b.n n2, a.m - b.m diff, a.v v1, b.v v2
    from m a join m b on a."cluster" = b."cluster" and a.g < b.g)"""

_STUDENT = _SHARES + _MOMENTS + """, tests as (select *, diff / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
  * (1.0 / n1 + 1.0 / n2)), 0) t, cast(n1 + n2 - 2 as double) df from pairs)"""


@query(
    "A13_group_t_test",
    _STUDENT + """ select "cluster", group1, group2, n1, n2, round(t, 6) t, df from tests""",
)
def a13(spark, d):
    return rounded(clusters.group_tests(_shares(spark, d), "pct"), "t")


# The t density by Simpson's rule over 2000 steps from 0 to |t|.
_P = """, places as (select *, unnest(range(2001)) i from tests),
  heights as (select * exclude (i), i, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())
    * (1 + (t * i / 2000) * (t * i / 2000) / df) ** (-(df + 1) / 2) h from places),
  sums as (select * exclude (i, h), sum(h * case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) s
    from heights group by all),
  ps as (select * exclude (s), case when t is not null then greatest(0, 1 - 2 * abs(t) / 6000 * s) end p from sums)"""


@query(
    "A13_group_p_value",
    _STUDENT + _P + """ select "cluster", group1, group2, n1, n2, round(t, 6) t, df, round(p, 6) p from ps""",
)
def a13_p(spark, d):
    tests = clusters.with_p_value(clusters.group_tests(_shares(spark, d), "pct"))
    return rounded(tests, "t", "p")


@query(
    "A14_significance",
    """with t as (select l_suppkey, l_linenumber, sum(l_discount * l_tax) / sum(l_tax + 0.0001) p from lineitem group by 1, 2),
    m as (select l_suppkey, l_linenumber, case when p < 0.001 then '***' when p < 0.01 then '**'
      when p < 0.05 then '*' end marker from t) select * from m where marker is not null""",
)
def a14(spark, d):
    """The marker on a column of numbers in [0, 1] that stand for p-values."""
    p = F.sum(F.col("l_discount") * F.col("l_tax")) / F.sum(F.col("l_tax") + 0.0001)
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(p.alias("p"))
    return clusters.with_significance(rows).drop("p")


@query(
    "A14_significant_pairs",
    f"""with {CELLS}, long as (select gate_o, "cluster", unnest([{{'v': 'x', 'n': x}}, {{'v': 'l_tax', 'n': l_tax}}, {{'v': 'l_discount', 'n': l_discount}}]) u
      from cells), m as (select u.v || gate_o "cluster", "cluster" g, avg(u.n) m, var_samp(u.n) v, count(*) n from long group by 1, 2 having count(*) > 1),
    tests as (select a."cluster", a.g group1, b.g group2, a.n n1, b.n n2, cast(a.n + b.n - 2 as double) df,
      (a.m - b.m) / nullif(sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 0) t
      from m a join m b on a."cluster" = b."cluster" and a.g < b.g)""" + _P + """
    select "cluster", group1, group2, n1, n2, round(t, 6) t, df, round(p, 6) p,
      case when p < 0.001 then '***' when p < 0.01 then '**' else '*' end marker from ps where p < 0.05""",
)
def a14_pairs(spark, d):
    """Features that differ between clusters of cells, apart by gate; and such that do not."""
    base = cells(spark, d)
    long = base.select("gate_o", F.col("cluster").alias("group"), "x", "l_tax", "l_discount").unpivot(
        ["gate_o", "group"], ["x", "l_tax", "l_discount"], "feature", "value"
    )
    table_ = long.select(F.concat("feature", F.col("gate_o").cast("string")).alias("cluster"), "group", "value")
    tests = clusters.with_p_value(clusters.group_tests(table_, "value"))
    return rounded(clusters.with_significance(tests), "t", "p")


_WELCH = _SHARES + _MOMENTS + """, tests as (select *, diff / nullif(sqrt(v1 / n1 + v2 / n2), 0) t,
  (v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / nullif(v1 * v1 / n1 / n1 / (n1 - 1) + v2 * v2 / n2 / n2 / (n2 - 1), 0) df from pairs)"""


@query(
    "A15_welch_test",
    _WELCH + """ select "cluster", group1, group2, n1, n2, round(t, 6) t, round(df, 6) df from tests""",
)
def a15(spark, d):
    return rounded(clusters.group_tests(_shares(spark, d), "pct", equal_variance=False), "t", "df")


@query(
    "A15_holm_adjustment",
    """with p as (select l_suppkey, l_linenumber, avg(l_tax) * avg(l_tax) p from lineitem group by 1, 2),
    r as (select *, least(1.0, (count(*) over (partition by l_linenumber)
      - row_number() over (partition by l_linenumber order by p) + 1) * p) raw from p)
    select l_suppkey, l_linenumber, round(max(raw) over (partition by l_linenumber order by p
      rows unbounded preceding), 6) p_adj from r""",
)
def a15_holm(spark, d):
    """Holm on a column of numbers in [0, 1] that stand for p-values."""
    p = (F.avg("l_tax") * F.avg("l_tax")).alias("p")
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(p)
    return rounded(clusters.with_adjusted_p(rows, ["l_linenumber"]).drop("p"), "p_adj")


@query(
    "A15_welch_adjusted",
    _WELCH + _P + """, r as (select *, least(1.0, (count(p) over () - row_number() over (order by p nulls last) + 1) * p) raw from ps),
    a as (select *, case when p is not null then max(raw) over (order by p nulls last rows unbounded preceding) end p_adj from r)
    select "cluster", group1, group2, n1, n2, round(t, 6) t, round(df, 6) df, round(p, 6) p, round(p_adj, 6) p_adj,
      case when p_adj < 0.001 then '***' when p_adj < 0.01 then '**' when p_adj < 0.05 then '*' end marker from a""",
)
def a15_full(spark, d):
    tests = clusters.group_tests(_shares(spark, d), "pct", equal_variance=False)
    adjusted = clusters.with_adjusted_p(clusters.with_p_value(tests))
    marked = clusters.with_significance(adjusted, "p_adj", only_significant=False)
    return rounded(marked, "t", "df", "p", "p_adj")


@query(
    "A16_mean_se",
    f"""with {LABELLED}, c as (select sample_id, "group", "cluster", count(*) n from labelled where trim("group") <> '' group by 1, 2, 3)
    select "cluster", "group", round(avg(n), 6) mean, round(coalesce(stddev_samp(n), 0) / sqrt(count(*)), 6) sem,
    count(*) n from c group by 1, 2""",
)
def a16(spark, d):
    counts = (
        filters.with_group(labelled_cells(spark, d))
        .groupBy("sample_id", "group", "cluster")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return rounded(clusters.group_statistics(counts, "n", ["cluster", "group"], False), "mean", "sem")


# ---- profiles --------------------------------------------------------------

_LONG = f"""long as (select sample_id, "cluster", feature, v from
  (select sample_id, "cluster", l_quantity, l_extendedprice, l_discount, l_tax from cells)
  unpivot (v for feature in (l_quantity, l_extendedprice, l_discount, l_tax)))"""

_PROFILE = f"""with {CELLS}, {_LONG}, profile as (select "cluster", feature, avg(v) mean from long group by 1, 2)"""


def _profile(spark, d):
    return clusters.cluster_means(cells(spark, d), FEATURES)


@query("A5_cluster_means", _PROFILE + """ select "cluster", feature, round(mean, 6) mean from profile""")
def a5(spark, d):
    return rounded(_profile(spark, d), "mean")


@query(
    "A6_sample_weighted_means",
    f"""with {CELLS}, {_LONG}, m as (select sample_id, feature, avg(v) m from long group by 1, 2),
    n as (select "cluster", sample_id, count(*) n from cells group by 1, 2)
    select "cluster", feature, round(sum(n * m) / sum(n), 6) mean from n join m on n.sample_id = m.sample_id group by 1, 2""",
)
def a6(spark, d):
    base = cells(spark, d)
    return rounded(clusters.sample_weighted_means(base, base, FEATURES), "mean")


_SCORES = _PROFILE + """, o as (select a."cluster", a.feature, any_value(a.mean) v, avg(b.mean) mu, stddev_pop(b.mean) sd
    from profile a join profile b on a.feature = b.feature and a."cluster" <> b."cluster" group by 1, 2),
  scores as (select "cluster", feature, case when sd > 0 then abs((v - mu) / sd) when mu <> 0 then abs(v - mu) else abs(v) end score from o)"""


@query("A7_distinguishing_scores", _SCORES + """ select "cluster", feature, round(score, 5) score from scores""")
def a7(spark, d):
    return rounded(clusters.distinguishing_scores(_profile(spark, d)), "score", digits=5)


@query(
    "A8_top_features",
    _SCORES + """, r as (select *, row_number() over (partition by "cluster" order by score desc, feature) r from scores)
    select cast("cluster" as varchar) "Cluster", """
    + ", ".join(
        f"""coalesce(max(case when r = {i} then feature end), '') "Top{i}_Feature",
        coalesce(max(case when r = {i} then printf('%.4f', score) end), '') "Top{i}_Score\""""
        for i in range(1, 6)
    )
    + """ from r group by "cluster\"""",
)
def a8(spark, d):
    return clusters.top_features(clusters.distinguishing_scores(_profile(spark, d)))


@query(
    "A9_heatmap_matrix",
    _PROFILE + """ select feature, """
    + ", ".join(f"""round(max(case when "cluster" = {k} then mean end), 6) "{k}\"""" for k in range(-1, 6))
    + " from profile group by feature",
)
def a9(spark, d):
    wide = clusters.profile_matrix(_profile(spark, d), clusters=list(range(-1, 6)))
    return rounded(wide, *[str(k) for k in range(-1, 6)])


@query(
    "A10_profile_z",
    _PROFILE + """ select "cluster", feature, round(mean, 6) mean,
    round(coalesce((mean - avg(mean) over (partition by feature)) / nullif(stddev_pop(mean) over (partition by feature), 0), 0), 5) z from profile""",
)
def a10(spark, d):
    scored = rounded(clusters.profile_z(_profile(spark, d)), "z", digits=5)
    return rounded(scored, "mean")


@query(
    "A17_correlation_importance",
    f"""with {DIRTY}, v as (select x, y, unnest([{{'f': 'l_quantity', 'v': l_quantity}}, {{'f': 'l_extendedprice', 'v': l_extendedprice}},
      {{'f': 'l_discount', 'v': l_discount}}]) u from dirty where gate_r)
    select u.f feature, round(abs(corr(u.v, x)), 6) x_impact, round(abs(corr(u.v, y)), 6) y_impact,
    round(corr(u.v, x), 6) x_correlation, round(corr(u.v, y), 6) y_correlation from v where u.v is not null group by u.f""",
)
def a17(spark, d):
    base = dirty_cells(spark, d)
    points = base.filter("gate_r").select(*KEY, "x", "y")
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    found = importance.correlation_importance(points, base.select(*KEY, *features), features, KEY)
    return rounded(found, "x_impact", "y_impact", "x_correlation", "y_correlation")


@query(
    "A17_sample_moments",
    f"""with {CELLS}, c as (select avg(x) mx, avg(y) my from cells where gate_r and gate_o = 1),
    e as (select sample_id, count(*)::double m, sum(x - mx) sx, sum(y - my) sy, sum((x - mx) ** 2) sxx, sum((y - my) ** 2) syy
      from cells, c where gate_r and gate_o = 1 group by 1),
    t as (select avg(l_tax) mid from cells),
    f as (select sample_id, count(*)::double n, sum(l_tax - mid) sf, sum((l_tax - mid) ** 2) sff from cells, t group by 1),
    s as (select sum(m * n) w, sum(m * sf) f, sum(m * sff) ff, sum(n * sx) x, sum(n * sxx) xx, sum(n * sy) y, sum(n * syy) yy,
      sum(sf * sx) fx, sum(sf * sy) fy from e join f on e.sample_id = f.sample_id),
    r as (select (fx / w - f / w * x / w) / sqrt((ff / w - (f / w) ** 2) * (xx / w - (x / w) ** 2)) rx,
      (fy / w - f / w * y / w) / sqrt((ff / w - (f / w) ** 2) * (yy / w - (y / w) ** 2)) ry from s)
    select 'l_tax' feature, round(abs(rx), 5) x_impact, round(abs(ry), 5) y_impact,
    round(rx, 5) x_correlation, round(ry, 5) y_correlation from r""",
)
def a17_moments(spark, d):
    """The sample-only join, from per-sample sums."""
    base = cells(spark, d)
    points = base.filter("gate_r and gate_o = 1").select("sample_id", "x", "y")
    found = importance.sample_correlation(points, base.select("sample_id", "l_tax"), ["l_tax"])
    return rounded(found, "x_impact", "y_impact", "x_correlation", "y_correlation", digits=5)


@query(
    "A18_limit_clusters",
    f"""with {CELLS}, t as (select "cluster" from cells group by 1 order by count(*) desc, "cluster" limit 3)
    select cell_id, "cluster", case when "cluster" in (select "cluster" from t) then "cluster" else -1 end cluster_limited from cells""",
)
def a18(spark, d):
    return clusters.limit_clusters(cells(spark, d).select("cell_id", "cluster"), 3)


@query("A19_clusters_found", f"""with {CELLS} select count(distinct "cluster") filter ("cluster" <> -1) n_clusters from cells""")
def a19(spark, d):
    return clusters.clusters_found(cells(spark, d))


@query(
    "A21_embedding_diagnostics",
    f"""with {DIRTY}, g as (select case when not isinf(l_tax) then l_tax end x0, l_discount y0 from dirty),
    v as (select case when x0 is not null and y0 is not null then x0 end x, case when x0 is not null and y0 is not null then y0 end y from g)
    select count(*) n_rows, count(*) filter (x is null) n_invalid, round(var_samp(x), 9) var_x, round(var_samp(y), 9) var_y,
    round(corr(x, y), 6) corr_xy, var_samp(x) < 1e-10 flat_x, var_samp(y) < 1e-10 flat_y, abs(corr(x, y)) > 0.99 collinear,
    count(*) filter (x is null) > 0.1 * count(*) many_invalid from v""",
)
def a21(spark, d):
    points = dirty_cells(spark, d).select(F.col("l_tax").alias("x"), F.col("l_discount").alias("y"))
    found = rounded(quality.embedding_diagnostics(points), "corr_xy")
    return rounded(found, "var_x", "var_y", digits=9)


@query("A22_value_domain", f"with {DIRTY} select min(l_discount) low, max(l_discount) high from dirty")
def a22(spark, d):
    return quality.value_domain(dirty_cells(spark, d), "l_discount")


@query(
    "A23_factor_index",
    f"""with {SHEET} select cast(row_number() over (order by "group") - 1 as integer) palette_index, "group" from (select distinct "group" from sheet)""",
)
def a23(spark, d):
    return quality.factor_index(sheet(spark, d), "group")


_DRAWN = f"""with {CELLS}, drawn as (select "cluster", sample_id, cell_id from cells qualify row_number() over
  (partition by "cluster" order by md5(concat_ws('|', sample_id, cell_id, '42'))) <= 100)"""


@query(
    "L5_cluster_cells",
    _DRAWN + f""", i as (select sample_id, cell_id, row_number() over (partition by sample_id order by
    l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 cell_index from cells)
    select case when "cluster" = -1 then 'Noise' else cast("cluster" as varchar) end "Cluster", i.sample_id "Sample_ID",
    i.cell_index "Cell_Index" from drawn join i on i.cell_id = drawn.cell_id and i.sample_id = drawn.sample_id""",
)
def l5(spark, d):
    base = cells(spark, d)
    drawn = clusters.cluster_cells(base.select("cluster", *KEY), KEY)
    placed = ordering.with_position(base.select(*KEY, *CELL_ORDER), ["sample_id"], CELL_ORDER)
    found = joins.lookup_features(drawn, placed.select(*KEY, "cell_index"), KEY, "inner")
    return filters.labelled(found).select(
        F.col("cluster").alias("Cluster"), F.col("sample_id").alias("Sample_ID"),
        F.col("cell_index").alias("Cell_Index"),
    )


@query("A24_cells_exported", _DRAWN + """ select "cluster", count(*) n from drawn group by 1""")
def a24(spark, d):
    base = cells(spark, d).select("cluster", *KEY)
    return clusters.cells_exported(clusters.cluster_cells(base, KEY))


@query(
    "A25_sample_means",
    f"with {CELLS} select sample_id, {', '.join(f'round(avg({c}), 6) {c}' for c in FEATURES)} from cells group by 1",
)
def a25(spark, d):
    return rounded(clusters.sample_means(cells(spark, d), FEATURES), *FEATURES)


@query(
    "U4_stack_importance",
    """select l_suppkey feature, sum(l_quantity) importance, 'X' dimension from lineitem group by 1
    union all select l_suppkey, cast(count(*) as double), 'Y' from lineitem group by 1""",
)
def u4(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("feature"))
    return schema.stack_importance(
        per.agg(F.sum("l_quantity").alias("importance")),
        per.agg(F.count(F.lit(1)).cast("double").alias("importance")),
    )


# ---- plot data -------------------------------------------------------------


@query(
    "G1_categorical_scatter",
    f"""with {LABELLED} select x, y, "group", case trim("group") when 'ASIA' then 0 when 'EUROPE' then 1 end palette_index from labelled""",
)
def g1(spark, d):
    return plotdata.categorical_scatter(labelled_cells(spark, d), "group", ["ASIA", "EUROPE"])


@query(
    "G2_linear_scatter",
    f"""with {CELLS} select x, y, l_quantity "value", round((l_quantity - min(l_quantity) over ()) /
    (max(l_quantity) over () - min(l_quantity) over ()), 6) scaled from cells""",
)
def g2(spark, d):
    return rounded(plotdata.linear_scatter(cells(spark, d), "l_quantity"), "scaled")


@query(
    "G3_highlighted_cells",
    f"""with {CELLS}, t as (select "cluster" from cells group by 1 order by count(*) desc, "cluster" limit 2)
    select l_orderkey, cell_id, x, y, case when "cluster" in (select "cluster" from t) then "cluster" else -1 end cluster_limited
    from cells where l_orderkey in (select o_custkey from orders)""",
)
def g3(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    base = cells(spark, d).select("l_orderkey", "cell_id", "x", "y", "cluster")
    return plotdata.highlighted_cells(base, ids, "l_orderkey", 2)[0].drop("cluster")


@query(
    "G4_density_raster",
    f"""with {CELLS}, b as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from cells),
    p as (select least(63, cast(floor((x - (select x0 from b)) * 64 / ((select x1 from b) - (select x0 from b))) as integer)) bin_x,
      least(63, cast(floor((y - (select y0 from b)) * 64 / ((select y1 from b) - (select y0 from b))) as integer)) bin_y, l_tax from cells)
    select bin_x, bin_y, count(*) n, round(avg(l_tax), 6) mean_value from p group by 1, 2""",
)
def g4(spark, d):
    return rounded(plotdata.density_raster(cells(spark, d), 64, "l_tax"), "mean_value")


@query("G7_cluster_scatter", f"""with {LABELLED} select x, y, "cluster" from labelled""")
def g7(spark, d):
    return plotdata.cluster_scatter(cells(spark, d))
