import struct

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventloom.sources import csv, fcs, files, runs, tables
from eventloom.streaming import arrivals


def write_fcs(path, names, data, datatype="F", order="<", extra=None, bits=None, ranges=None):
    n, width = len(data), len(names)
    kind = {"F": "f4", "D": "f8", "I": "u2"}[datatype]
    size = {"F": 32, "D": 64, "I": 16}[datatype]
    words = {"$PAR": width, "$TOT": n, "$DATATYPE": datatype, "$MODE": "L",
             "$BYTEORD": "1,2,3,4" if order == "<" else "4,3,2,1"}
    for i, name in enumerate(names, 1):
        words |= {f"$P{i}N": name.replace("/", "//"), f"$P{i}B": size, f"$P{i}R": (ranges or [1 << 18] * width)[i - 1], f"$P{i}E": "0,0"}
    words |= extra or {}
    text = ("/" + "/".join(f"{k}/{v}" for k, v in words.items()) + "/").encode()
    body = np.asarray(data).astype(order + kind).tobytes()
    start = 58 + len(text)
    head = "FCS3.1    " + "".join(f"{v:>8}" for v in (58, start - 1, start, start + len(body) - 1, 0, 0))
    path.write_bytes(head.encode() + text + body)


def test_fcs_types_and_ranges(spark, tmp_path):
    rng = np.random.default_rng(0)
    small, big = rng.normal(size=(1000, 2)), rng.normal(size=(300, 3))
    write_fcs(tmp_path / "a.fcs", ["Area_Ch01", "X_/_Y"], small, "D")
    write_fcs(tmp_path / "b.FCS", ["Area_Ch01", "X_/_Y", "Gain"], big, "F", ">", {"$P3G": "2"})
    write_fcs(tmp_path / "c.fcs", ["Area_Ch01", "Log"], [[1029, 512], [3, 0]], "I", "<", {"$P2E": "4,1"}, ranges=[1024, 1024])
    out = fcs.read_fcs(spark, str(tmp_path), task_bytes=800)
    assert out.columns == ["sample_id", "cell_index", "Area_Ch01", "Gain", "Log", "X_/_Y"]
    got = out.filter("sample_id = 'a'").orderBy("cell_index").toPandas()
    assert list(got["cell_index"]) == list(range(1000))
    np.testing.assert_array_equal(got["Area_Ch01"], small[:, 0])
    assert got["Log"].isna().all()
    got = out.filter("sample_id = 'b'").orderBy("cell_index").toPandas()
    np.testing.assert_allclose(got["Gain"], big[:, 2].astype("f4") / 2.0, rtol=1e-6)
    got = out.filter("sample_id = 'c'").orderBy("cell_index").toPandas()
    assert list(got["Area_Ch01"]) == [5.0, 3.0]  # 1029 needs more bits than the range has
    np.testing.assert_allclose(got["Log"], [100.0, 1.0])


def test_fcs_errors(spark, tmp_path):
    (tmp_path / "bad.fcs").write_bytes(b"nothing here")
    write_fcs(tmp_path / "ok.fcs", ["A"], [[1.0]])
    with pytest.raises(ValueError, match="bad.fcs"):
        fcs.read_fcs(spark, str(tmp_path))
    assert fcs.read_fcs(spark, str(tmp_path), on_error="skip").count() == 1
    assert {r["file"] for r in fcs.fcs_headers(spark, str(tmp_path)).filter("error is not null").collect()} == {"bad.fcs"}


def test_folder_with_two_headers(spark, tmp_path):
    (tmp_path / "f1.csv").write_text("c1,c2\n0,a\n1,b\n")
    (tmp_path / "f2.CSV").write_text("c1,c3\n2,c\n3,d\n")
    (tmp_path / "notes.txt").write_text("c9\n1\n")
    out = csv.read_files(spark, str(tmp_path))
    assert out.columns == ["c1", "c2", "c3", "file"]
    assert rows(out, "c1") == [(0, "a", None, "f1.csv"), (1, "b", None, "f1.csv"), (2, None, "c", "f2.CSV"), (3, None, "d", "f2.CSV")]
    assert csv.read_files(spark, str(tmp_path), join="inner").columns == ["c1", "file"]
    indexed = csv.read_files(spark, str(tmp_path), add_index=True)
    assert [(r["Index"], r["c1"]) for r in indexed.orderBy("Index").collect()] == [(i, i) for i in range(4)]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert csv.read_files(spark, str(empty)).columns == []


def test_index_over_many_blocks(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("v\n" + "\n".join(str(i) for i in range(20000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        out = csv.read_csv(spark, str(path), add_index=True)
        assert out.filter("v <> Index").count() == 0 and out.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sheet(spark, tmp_path):
    blank = tables.read_sheet(spark, str(tmp_path / "none"))
    assert rows(blank) == [("", "", "", "")]
    sheet = spark.createDataFrame([("a.fcs", "1", "g", "r")], blank.schema)
    tables.write_sheet(sheet, str(tmp_path / "sheet"))
    assert rows(tables.read_sheet(spark, str(tmp_path / "sheet"))) == [("a.fcs", "1", "g", "r")]
    with pytest.raises(ValueError, match="file_name"):
        tables.require_sheet(sheet.drop("file_name"))


def test_embedding_falls_back_to_csv(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, 1.5, 2.5)], "sample_id string, cell_index long, x double, y double")
    df.write.option("header", True).csv(str(tmp_path / "tsne_embedding.csv"))
    assert rows(tables.read_embedding(spark, str(tmp_path), "t-SNE").select("x", "y")) == [(1.5, 2.5)]
    tables.write_embedding(df, str(tmp_path), "t-SNE")
    assert rows(tables.read_embedding(spark, str(tmp_path), "t-SNE")) == rows(df)
    with pytest.raises(ValueError, match="Unknown method"):
        tables.write_embedding(df, str(tmp_path), "X")


def test_run_state(spark, tmp_path):
    updates = spark.createDataFrame(
        [("r1", "2024-01-01", "UMAP", ["a"]), ("r1", "2024-01-02", None, ["b"]), ("r1", "2024-01-03", "t-SNE", None), ("r2", "2024-01-01", None, None)],
        "run_id string, t string, m string, features array<string>",
    ).selectExpr("run_id", "cast(t as timestamp) timestamp", "case when m is not null then named_struct('method', m, 'params', map('k', '1')) end dimensionality_reduction", "features")
    path = str(tmp_path / "runs")
    runs.append_updates(updates, path)
    state = runs.current_runs(runs.read_updates(spark, path))
    got = {r["run_id"]: (r["dimensionality_reduction"], r["features"], r["features_count"]) for r in state.collect()}
    assert got["r1"][0]["method"] == "t-SNE" and got["r1"][1:] == (["a"], 1)
    listing = [tuple(r) for r in runs.run_catalogue(state).collect()]
    assert listing == [("r2", "Unknown", 0, "No", "2024-01-01"), ("r1", "t-SNE", 0, "No", "2024-01-03")]


def test_pending(spark):
    src = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "stem string, modified int")
    done = spark.createDataFrame([("a", 9), ("b", 1)], "stem string, modified int")
    assert sorted(r["stem"] for r in files.pending_files(src, done).collect()) == ["b", "c"]


def test_arrivals(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "s1.csv").write_text("v\n1\n2\n")
    out = {k: str(tmp_path / k) for k in ("events", "sheet", "state", "counts", "cstate")}

    def schema():
        return spark.createDataFrame([], "v int").schema

    def run():
        stream = arrivals.arriving_events(spark, str(folder), schema(), kind="csv")
        arrivals.ingest(stream, out["events"], out["sheet"], out["state"], once=True).awaitTermination()
        stream = arrivals.arriving_events(spark, str(folder), schema(), kind="csv")
        arrivals.count_status(stream, out["counts"], out["cstate"], once=True).awaitTermination()

    run()
    (folder / "s2.csv").write_text("v\n7\n")
    run()
    assert spark.read.parquet(out["events"]).agg(F.sum("v")).first()[0] == 10
    sheet = arrivals.latest_sheet(spark, out["sheet"])
    assert [tuple(r)[:2] for r in sheet.orderBy("sample_id").collect()] == [("s1", "sample_1"), ("s2", "sample_2")]
    assert rows(spark.read.parquet(out["counts"]), "file_name") == [("s1", 2), ("s2", 1)]


def test_fcs_incomplete_files_raise(spark, tmp_path):
    for name in ("twice", "cut"):
        (tmp_path / name).mkdir()
    write_fcs(tmp_path / "twice" / "a.fcs", ["A", "A"], [[1.0, 2.0]])
    with pytest.raises(ValueError, match="repeat"):
        fcs.read_fcs(spark, str(tmp_path / "twice"))
    path = tmp_path / "cut" / "a.fcs"
    write_fcs(path, ["A"], [[1.0], [2.0], [3.0]], "D")
    path.write_bytes(path.read_bytes()[:-8])
    with pytest.raises(Exception, match="data end before"):
        fcs.read_fcs(spark, str(tmp_path / "cut")).collect()
