"""Behaviour of the table operators on small frames with known results."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventloom.operators import clusters, filters, joins, ordering, plotdata, quality, scaling, schema
from eventloom.sources import csv


def test_header_is_normalised(spark):
    df = spark.createDataFrame([(5.0, "1")], "`Area + Length` double, ` Leukocytes & Erys ` string")
    assert schema.normalise_header(df).columns == ["Area_plus_Length", "Leukocytes_and_Erys"]
    with pytest.raises(ValueError):
        schema.normalise_header(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"))


def test_rename_is_all_or_nothing(base, capsys):
    assert schema.rename_variables(base, {"Area_Ch01": "Area CD4"}).columns[0] == "Area CD4"
    kept = schema.rename_variables(base, {"Area_Ch01": "A", "absent": "B"})
    assert kept.columns == base.columns
    assert "absent" in capsys.readouterr().out


def test_select_condition(base):
    assert rows(filters.select_condition(base, "Donor", "JBZ")) == [(5.7, "JBZ", 1)]
    with pytest.raises(ValueError, match="Column 'X' does not exist"):
        filters.select_condition(base, "X", 1)
    with pytest.raises(ValueError, match="Value 'ZZZ' does not exist in column 'Donor'"):
        filters.select_condition(base, "Donor", "ZZZ")


def test_select_events(base):
    with pytest.raises(ValueError, match="'100' is larger than the number of rows \\(3\\)"):
        ordering.select_events(base, 100, ["File_Number"])
    assert ordering.select_events(base, 1, ["File_Number"]).count() == 1
    picked = [r["File_Number"] for r in ordering.select_events(base, 2, ["File_Number"]).collect()]
    assert picked == sorted(picked)


def test_drop_and_save(base):
    assert schema.drop_variables(base, "Donor").columns == ["Area_Ch01", "File_Number"]
    assert schema.save_feature(base, "Donor").columns == ["Donor"]
    for fn in (schema.drop_variables, schema.save_feature):
        with pytest.raises(ValueError, match="do not exist"):
            fn(base, "X")


def test_metadata_on_empty_table(spark, base):
    with pytest.raises(ValueError, match="Dataframe is empty."):
        schema.add_metadata(base.limit(0), "a", 1)
    assert {r["a"] for r in schema.add_metadata(base, "a", 1).collect()} == {1}


def test_concat_variables(spark, base):
    a = spark.createDataFrame([(1, 7), (2, 9), (4, 0)], "File_Number long, Height long")
    out = joins.concat_variables(["File_Number"], base, a)
    assert [r[0] for r in rows(out, "File_Number")] == [1, 2, 3, 4]
    assert [r["Height"] for r in out.orderBy("File_Number").collect()] == [7, 9, None, 0]
    with pytest.raises(ValueError):
        joins.concat_variables(["File_Number"], base, base)


def test_concat_rows_with_index(spark, base):
    more = spark.createDataFrame([(10.0, "KBH", 4)], base.schema)
    out = schema.concat_df(base, more, index_order=["File_Number"])
    assert [(r["File_Number"], r["Index"]) for r in out.orderBy("Index").collect()] == [(1, 0), (2, 1), (3, 2), (4, 3)]
    part = schema.concat_df(base, more.drop("Donor"))
    assert part.columns == ["Area_Ch01", "File_Number"]
    assert schema.concat_df(base, more.drop("Donor"), join="outer").filter("Donor is null").count() == 1


def test_replace_values(base):
    out = joins.replace_values(base, "Donor", {"JBZ": "1", "IKH": "2", "LME": "3"})
    assert [r["Donor"] for r in out.orderBy("File_Number").collect()] == ["1", "2", "3"]
    digits = joins.replace_values(base.withColumn("n", F.col("File_Number") * 10), "n", {1: "A"})
    assert digits.orderBy("File_Number").first()["n"] == "A0"
    assert joins.map_values(base, "File_Number", {1: "A"}).orderBy("Area_Ch01").first()["File_Number"] == "A"


def test_weighted(base):
    out = schema.weighted_features(base, ["Area_Ch01", "File_Number"], 2)
    assert rows(out, "File_Number") == [(11.4, "JBZ", 2), (28.0, "IKH", 4), (19.2, "LME", 6)]


@pytest.fixture
def five(spark):
    data = [(i, 10 * i, 1000 * i) for i in range(1, 6)]
    return spark.createDataFrame(data, "c1 long, c2 long, c3 long")


def test_scalers(five):
    z = [r["c1"] for r in scaling.stand_scaler(five).orderBy("c1").collect()]
    assert z == pytest.approx([-math.sqrt(2), -math.sqrt(0.5), 0, math.sqrt(0.5), math.sqrt(2)])
    quarters = [0.0, 0.25, 0.5, 0.75, 1.0]
    for scaler in (scaling.minmax_norm, scaling.quant_scaler):
        assert [r["c2"] for r in scaler(five).orderBy("c2").collect()] == quarters
        part = scaler(five, "c1", "c2").orderBy("c3").collect()
        assert [r["c1"] for r in part] == quarters and part[0]["c3"] == 1000
    with pytest.raises(ValueError, match="is after last column"):
        scaling.minmax_norm(five, "c3", "c1")
    with pytest.raises(ValueError, match="First column 'x' does not exist"):
        scaling.stand_scaler(five, "x", "c1")
    with pytest.raises(ValueError, match="empty"):
        scaling.stand_scaler(five.limit(0))


def test_bad_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1.0, 3.0), (nan, 3.0), (inf, 3.0), (3.0, 3.0), (None, 3.0)], "v double, c double"
    )
    assert [r["v"] for r in scaling.infinite_to_null(df).collect()] == [1.0, None, None, 3.0, None]
    finite = filters.finite_rows(df, ["v"])
    assert sorted(r["v"] for r in finite.collect()) == [1.0, 3.0]
    scaled = scaling.standardise(finite, ["v", "c"]).orderBy("v").collect()
    assert [(r["v"], r["c"]) for r in scaled] == [(-1.0, 0.0), (1.0, 0.0)]
    assert {r["c"] for r in scaling.minmax_norm(finite).collect()} == {None}
    q = scaling.quant_scaler(df.replace(inf, 2.0), "v", "v").filter("v is not null")
    assert sorted(r["v"] for r in q.collect()) == [0.0, 0.5, 1.0]


def test_quantiles_with_ties_match_interpolation(spark):
    import numpy as np

    values = [float(v) for v in [1, 1, 1, 2, 3, 3, 9, 9, 9, 9, 11]]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    grid = np.percentile(values, np.linspace(0, 100, len(values)))
    refs = np.linspace(0, 1, len(values))
    want = {
        v: 0.5 * (np.interp(v, grid, refs) - np.interp(-v, -grid[::-1], -refs[::-1])) for v in values
    }
    got = sorted(r["v"] for r in scaling.quant_scaler(df).collect())
    assert got == pytest.approx(sorted(want[v] for v in values))


def test_drop_events(spark):
    df = spark.range(10).withColumnRenamed("id", "Index")
    assert [r[0] for r in filters.drop_events(df, 2, 7).collect()] == [0, 1, 8, 9]
    for first, last in ((20, 3), (3, 20), (5, 2)):
        with pytest.raises(ValueError):
            filters.drop_events(df, first, last)


def test_gate_keeps_files_without_it(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 0), ("b", None), ("c", 0)], "sample_id string, Live int"
    )
    has = F.col("sample_id") != "b"
    assert [r[0] for r in rows(filters.population_gate(df, "Live", has), "sample_id")] == ["a", "b"]
    notes = {r["sample_id"]: r["note"] for r in filters.gate_report(df, "Live", has).collect()}
    assert notes["c"].startswith("skipped") and notes["b"].startswith("gate absent")
    assert filters.population_gate(df, "absent").count() == 4


def test_id_list(spark):
    df = spark.createDataFrame([("100, 200",), ("1-3, x, 7",)], "t string")
    assert sorted(r["id"] for r in filters.id_list(df, "t").collect()) == [1, 2, 3, 7, 100, 200]
    cells = spark.range(5).withColumnRenamed("id", "cell")
    found, missing = filters.find_cells(cells, filters.id_list(df, "t"), "cell")
    assert sorted(r[0] for r in found.collect()) == [1, 2, 3]
    assert sorted(r[0] for r in missing.collect()) == [7, 100, 200]


def test_name_rules(spark):
    names = ["Area_M04", "Area_Ch04", "Area_M040", "Max(Ch04", "xCh04y", "Raw Max", "Bkgd_Ch01", "Time", "R1 & PMN"]
    df = spark.createDataFrame([(n,) for n in names], "feature string")
    kept = {r["feature"] for r in schema.feature_selection(df, ["Ch04"]).filter("included").collect()}
    assert kept == {"xCh04y", "R1 & PMN"}
    assert [r[0] for r in df.filter(quality.is_gate_name(F.col("feature"))).collect()] == ["R1 & PMN"]


def test_gate_columns(spark):
    df = spark.createDataFrame(
        [("a", 0, 1.0, True, 5.0, 1), ("a", 1, 1.0, True, 0.0, 1), ("b", 0, 0.0, False, 1.0, 0), ("b", 1, 1.0, True, 0.5, 1)],
        "sample_id string, All int, half double, flag boolean, area double, R12 int",
    )
    found = {tuple(r) for r in quality.gate_columns(df).collect()}
    assert found == {("a", "All"), ("a", "flag"), ("a", "R12"), ("b", "All"), ("b", "half"), ("b", "flag"), ("b", "R12")}
    sets = {r["population"]: r["common"] for r in quality.population_sets(quality.gate_columns(df), df, "sample_id").collect()}
    assert sets == {"All": True, "flag": True, "R12": True, "half": False}


def test_import_feature_list(spark):
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "feature string")
    one = spark.createDataFrame([("a, b\nz",)], "INCLUDED string")
    got = {tuple(r) for r in schema.import_feature_list(one, known, "included").collect()}
    assert got == {("a", True), ("b", True), ("z", False)}
    many = spark.createDataFrame([("a, b",), (" c ",), (None,)], "Included string")
    got = {tuple(r) for r in schema.import_feature_list(many, known, "included").collect()}
    assert got == {("a, b", False), ("c", True)}
    with pytest.raises(ValueError):
        schema.accepted_features(schema.import_feature_list(known.select(F.lit("q").alias("included")), known, "included"))


def test_sheet_joins(spark):
    cells = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "sample_id string, x double")
    sheet = spark.createDataFrame(
        [("s1.daf", "sample_1", "A"), ("s1.DAF", "sample_1", "B"), ("s3.fcs", "sample_3", " ")],
        "file_name string, sample_id string, group string",
    )
    out = joins.attach_sheet(cells, sheet)
    assert out.count() == 2  # duplicate sheet rows do not multiply cells
    got = {r["sample_id"]: r["group"] for r in out.collect()}
    assert got["s2"] is None and got["s1"] in ("A", "B")
    assert [r[0] for r in joins.duplicate_sheet_rows(sheet).collect()] == ["s1"]
    files = spark.createDataFrame([("s1.fcs",), ("s2.fcs",)], "file_name string")
    assert {tuple(r) for r in joins.check_sheet(sheet, files).collect()} == {
        ("s1", "matched"), ("s2", "only in data"), ("s3", "only in sheet")
    }
    assert joins.auto_sample_rows(sheet, files).count() == 0  # groups are filled in
    blank = sheet.withColumn("group", F.lit(""))
    assert rows(joins.auto_sample_rows(blank, files)) == [("s2", "sample_4", "", "")]


def test_profile_scores(spark):
    two = spark.createDataFrame([(1, "f", 5.0), (2, "f", 3.0), (1, "g", 2.0), (2, "g", 0.0)], "cluster int, feature string, mean double")
    got = {(r[0], r[1]): r[2] for r in clusters.distinguishing_scores(two).collect()}
    assert got == {(1, "f"): 2.0, (2, "f"): 2.0, (1, "g"): 2.0, (2, "g"): 2.0}
    one = two.filter("cluster = 1")
    assert {r["score"] for r in clusters.distinguishing_scores(one).collect()} == {0.0}
    flat = spark.createDataFrame([(i, "f", 0.1 * 3) for i in range(4)], "cluster int, feature string, mean double")
    assert {r["z"] for r in clusters.profile_z(flat).collect()} == {0.0}
    top = clusters.top_features(clusters.distinguishing_scores(two)).orderBy("Cluster").first()
    assert (top["Top1_Feature"], top["Top1_Score"], top["Top3_Feature"]) == ("f", "2.0000", "")


def test_most_frequent_ties(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "cluster string")
    kept = {r["cluster_limited"] for r in clusters.limit_clusters(df, 2).collect()}
    assert kept == {"a", "b", "Other"}
    numbers = spark.createDataFrame([(1,), (1,), (2,)], "cluster int")
    assert {r["cluster_limited"] for r in clusters.limit_clusters(numbers, 1).collect()} == {1, -1}
    with pytest.raises(ValueError, match="not found"):
        clusters.limit_clusters(df, 2, "nope")


def test_shares_count_zeros(spark):
    df = spark.createDataFrame([("s", "1"), ("s", "1"), ("t", "2"), ("t", "1")], "sample_id string, cluster string")
    got = {(r[0], r[1]): r[2] for r in clusters.sample_shares(df).collect()}
    assert got == {("s", "1"): 100.0, ("s", "2"): 0.0, ("t", "1"): 50.0, ("t", "2"): 50.0}


def test_t_test_values(spark):
    # Values from the published tables of the t distribution.
    known = [(2.228139, 10.0, 0.05), (3.169273, 10.0, 0.01), (1.959964, 1e7, 0.05), (12.706205, 1.0, 0.05), (0.0, 5.0, 1.0)]
    df = spark.createDataFrame([(t, d) for t, d, _ in known], "t double, df double")
    got = [r["p"] for r in clusters.with_p_value(df).collect()]
    assert got == pytest.approx([p for _, _, p in known], abs=2e-6)


def test_group_tests(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [3.0, 5.0, 7.0]
    data = [("1", "A", v) for v in a] + [("1", "B", v) for v in b] + [("1", "C", 9.0)]
    df = spark.createDataFrame(data, "cluster string, group string, v double")
    row = clusters.with_p_value(clusters.group_tests(df, "v")).collect()
    assert len(row) == 1  # one value is too few
    # Pooled variance (3 * 5/3 + 2 * 4) / 5 = 2.6, difference of means -2.5.
    assert row[0]["t"] == pytest.approx(-2.5 / math.sqrt(2.6 * (1 / 4 + 1 / 3))) and row[0]["df"] == 5.0
    welch = clusters.group_tests(df, "v", equal_variance=False).first()
    e1, e2 = 5 / 12, 4 / 3
    assert welch["df"] == pytest.approx((e1 + e2) ** 2 / (e1**2 / 3 + e2**2 / 2))
    same = spark.createDataFrame([("1", g, 2.0) for g in "AABB"], "cluster string, group string, v double")
    assert clusters.with_p_value(clusters.group_tests(same, "v")).first()["p"] is None


def test_adjustments(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,), (None,)], "p double")

    def got(method):
        return [r["p_adj"] for r in clusters.with_adjusted_p(df, method=method).filter("p is not null").orderBy("p").collect()]

    assert got("holm") == pytest.approx([0.02, 0.03, 0.06, 0.06])
    assert got("BH") == pytest.approx([0.02, 0.02, 0.04, 0.04])
    assert got("bonferroni") == pytest.approx([0.02, 0.04, 0.12, 0.16])


def test_raster_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.5, 0.5)], "x double, y double")
    got = {(r["bin_x"], r["bin_y"]): r["n"] for r in plotdata.density_raster(df, 2).collect()}
    assert got == {(0, 0): 1, (1, 1): 2}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_positions_do_not_depend_on_partitions(spark, parts):
    # One sample holds most rows, many of them identical.
    data = [("hot", i % 5) for i in range(900)] + [("cold", i) for i in range(20)]
    df = spark.createDataFrame(data, "s string, v int").repartition(parts)
    out = ordering.with_position(df, ["s"], ["v"], "i")
    for s, n in (("hot", 900), ("cold", 20)):
        got = [(r["v"], r["i"]) for r in out.filter(F.col("s") == s).orderBy("i").collect()]
        assert [i for _, i in got] == list(range(n))
        assert [v for v, _ in got] == sorted(v for v, _ in got)


@pytest.mark.parametrize("wide", [False, True])
def test_both_sampling_ways_agree(spark, wide):
    df = spark.range(2000).selectExpr("id", "case when id < 1500 then 'hot' else 'cold' end s").repartition(7)
    from eventloom.functions.columns import draw_order

    got = ordering.first_n(df, ["s"], draw_order(["id"], 42), 50, wide=wide)
    import hashlib

    want = set()
    for lo, hi in ((0, 1500), (1500, 2000)):
        want |= set(sorted(range(lo, hi), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())[:50])
    assert {r["id"] for r in got.collect()} == want


def test_csv_round_trip(spark, tmp_path, base):
    csv.save_csv(base, str(tmp_path / "a"))
    assert sorted(rows(csv.read_csv(spark, str(tmp_path / "a")))) == sorted(rows(base))


def test_gate_default_reads_which_files_have_it(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", None), ("c", 0)], "sample_id string, Live int")
    assert [tuple(r) for r in filters.population_gate(df, "Live").orderBy("sample_id").collect()] == [("a", 1), ("b", None)]


def test_null_label_takes_no_place(spark):
    df = spark.createDataFrame([(v,) for v in [None] * 3 + [1, 1, 2]], "cluster int")
    got = clusters.limit_clusters(df, 2).filter("cluster is not null").collect()
    assert sorted(r["cluster_limited"] for r in got) == [1, 1, 2]


def test_csv_doubled_quotes(spark, tmp_path):
    df = spark.createDataFrame([('x "y" z', 1)], "name string, n int")
    csv.save_csv(df, str(tmp_path / "a"))
    assert rows(csv.read_csv(spark, str(tmp_path / "a"))) == rows(df)


@pytest.mark.parametrize("mode", ["landmarks", "rank", "sketch"])
def test_quantile_modes(spark, mode):
    from eventloom.operators import scaling

    rows = [(float(v), None if v == 3 else float(v * v), "t") for v in (1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "a double, b double, t string").coalesce(1)
    out = scaling.quant_scaler(df, "a", "b", mode=mode).orderBy("a").collect()
    assert [r["a"] for r in out] == pytest.approx([0, 0.25, 0.5, 0.75, 1], abs=1e-3)
    assert [r["b"] for r in out if r["b"] is not None] == pytest.approx([0, 1 / 3, 2 / 3, 1], abs=1e-3)
    assert out[0]["t"] == "t" and sum(r["b"] is None for r in out) == 1


def test_ranks_of_ties_and_single_values(spark):
    from eventloom.operators import scaling

    df = spark.createDataFrame([(0.0, 7.0), (-0.0, 7.0), (2.0, 7.0), (2.0, 7.0), (9.0, float("nan"))], "a double, b double")
    out = scaling.quant_scaler(df, "a", "b", mode="rank").orderBy("a").collect()
    assert [r["a"] for r in out] == [0.125, 0.125, 0.625, 0.625, 1.0]
    assert sorted(r["b"] for r in out if r["b"] is not None) == [0.5] * 4
    with pytest.raises(ValueError, match="one of"):
        scaling.quant_scaler(df, "a", "b", mode="exact")
