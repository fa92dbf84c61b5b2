"""Queries: readers, writers, manifests and streams.

Each writes a file set derived from the driver tables to the shared folder and
reads it back through the source under test.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import q
from ..operators import clusters, filters
from ..operators.ordering import spread
from ..session import scratch_path
from ..sources import csv, fcs, files, runs, tables
from ..streaming import arrivals
from .group_queries import _SCORES, _profile
from .registry import query
from .shape_queries import rounded
from .tables import CELLS, KEY, SHEET, cells, sheet, table

# ---- CSV -------------------------------------------------------------------


@query(
    "S1_read_csv",
    """select l_suppkey, l_quantity "Area_plus_Length", l_returnflag "Leukocytes_and_Erys" from lineitem""",
)
def s1(spark, d):
    path = scratch_path(spark, "csv")
    csv.save_csv(
        table(spark, d, "lineitem").select(
            "l_suppkey", F.col("l_quantity").alias("Area + Length"),
            F.col("l_returnflag").alias("Leukocytes & Erys"),
        ),
        path,
    )
    return csv.read_csv(spark, path)


@query(
    "S1_read_csv_index",
    """select o_orderkey k, row_number() over (order by o_orderkey) - 1 "Index" from orders""",
)
def s1_index(spark, d):
    """Files written in key order: the index in file order is the key's rank."""
    path = scratch_path(spark, "csv")
    csv.save_csv(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).orderBy("k"), path)
    return csv.read_csv(spark, path, add_index=True)


def _mixed_folder(spark: SparkSession, d: str) -> str:
    """One folder of CSV files with two headers."""
    path = scratch_path(spark, "csv-mixed")
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("c1"), F.col("o_totalprice").alias("c 2")
    )
    items = table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("c3"), F.col("l_orderkey").alias("c1")
    )
    orders.write.option("header", True).csv(path)
    items.write.mode("append").option("header", True).csv(path)
    return path


@query(
    "S2_read_files_outer",
    """select c1, "c_2", c3, count(*) n from (select o_orderkey c1, o_totalprice "c_2", null c3 from orders
    union all select l_orderkey, null, l_quantity from lineitem) group by all""",
)
def s2(spark, d):
    found = csv.read_files(spark, _mixed_folder(spark, d))
    return found.groupBy("c1", "c_2", "c3").agg(F.count("file").alias("n"))


@query(
    "S2_read_files_inner",
    """select c1, count(*) n from (select o_orderkey c1 from orders union all select l_orderkey from lineitem) group by 1""",
)
def s2_inner(spark, d):
    found = csv.read_files(spark, _mixed_folder(spark, d), join="inner")
    return found.groupBy("c1").agg(F.count("file").alias("n"))


@query(
    "S2_read_files_index",
    """select count(*) n, count(*) n_index, count(*) - 1 top from (select 1 from orders union all select 1 from lineitem)""",
)
def s2_index(spark, d):
    found = csv.read_files(spark, _mixed_folder(spark, d), add_index=True)
    return found.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("Index").alias("n_index"), F.max("Index").alias("top")
    )


@query("S8_save_csv", f"with {CELLS} select sample_id, cell_id, x, gate_r from cells")
def s8(spark, d):
    path = scratch_path(spark, "csv")
    wanted = cells(spark, d).select(*KEY, "x", "gate_r")
    csv.save_csv(wanted, path)
    return csv.read_csv(spark, path, schema=wanted.schema)


# ---- FCS -------------------------------------------------------------------


#: Bytes of events in a written file, at about which the next one begins.
FILE_BYTES = 8 << 20


def _write_fcs(df: DataFrame, folder: str, datatype: str = "D", file_bytes: int = FILE_BYTES) -> None:
    """FCS files of bounded size, at least one per partition with rows, through Arrow's file systems."""
    names = df.columns
    width = {"D": 64, "F": 32}[datatype]

    def write_file(target: str, pieces: list[bytes], size: int) -> int:
        from pyarrow import fs

        n = size // (width // 8 * len(names))
        words = {
            "$PAR": len(names), "$TOT": n, "$DATATYPE": datatype, "$MODE": "L",
            "$BYTEORD": "1,2,3,4", "$NEXTDATA": 0,
        }
        for i, name in enumerate(names, 1):
            words |= {f"$P{i}N": name.replace("|", "||"), f"$P{i}B": width, f"$P{i}R": 262144, f"$P{i}E": "0,0"}
        text = ("|" + "|".join(f"{k}|{v}" for k, v in words.items()) + "|").encode()
        start = 58 + len(text)
        end = start + size - 1
        shown = (start, end) if end < 10**8 else (start, 0)
        head = "FCS3.1    " + "".join(f"{v:>8}" for v in (58, start - 1, *shown, 0, 0))
        system, inner = (
            (fs.LocalFileSystem(), target) if target.startswith("/") else fs.FileSystem.from_uri(target)
        )
        system.create_dir(inner.rsplit("/", 1)[0])
        with system.open_output_stream(inner) as out:
            out.write(head.encode() + text)
            for piece in pieces:
                out.write(piece)
        return n

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, size, files, written = [], 0, 0, 0

        def flush() -> int:
            ending = f"-{files}" if files else ""
            return write_file(f"{folder}/part{part}{ending}.fcs", held, size)

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch.to_numpy(dtype=f"<f{width // 8}").tobytes())
            size += len(held[-1])
            if size >= file_bytes:
                written += flush()
                held, size, files = [], 0, files + 1
        if held:
            written += flush()
        if written:
            yield pd.DataFrame({"n": [written]})

    df.mapInPandas(write, "n long").agg(F.sum("n")).collect()


@query(
    "S3_read_fcs",
    """select l_quantity, count(*) n, count(*) n_keys, round(sum(l_extendedprice), 2) price, round(sum(l_tax), 4) tax from lineitem group by 1""",
)
def s3(spark, d):
    folder = scratch_path(spark, "fcs")
    items = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_tax")
    _write_fcs(spread(items), folder)
    events = fcs.read_fcs(spark, folder, task_bytes=1 << 18)
    return events.groupBy("l_quantity").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("sample_id", "cell_index").alias("n_keys"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.round(F.sum("l_tax"), 4).alias("tax"),
    )


# ---- sheets, embeddings, labels, results -----------------------------------


@query("S4_read_sheet", f"""with {SHEET} select file_name, sample_id, "group", replicate from sheet""")
def s4(spark, d):
    path = scratch_path(spark, "sheet")
    sheet(spark, d).write.option("header", True).option("ignoreTrailingWhiteSpace", False).option(
        "ignoreLeadingWhiteSpace", False
    ).csv(path)
    return tables.read_sheet(spark, path)


@query("S5_write_sheet", f"""with {SHEET} select file_name, sample_id, trim("group") "group", replicate from sheet where trim("group") <> ''""")
def s5(spark, d):
    path = scratch_path(spark, "sheet")
    tables.write_sheet(filters.with_group(sheet(spark, d)), path)
    return tables.read_sheet(spark, path)


@query("V1_sheet_contract", f"""with {SHEET} select file_name from sheet""")
def v1(spark, d):
    return tables.require_sheet(sheet(spark, d)).select("file_name")


@query("S6_embedding_table", f"with {CELLS} select sample_id, cell_id, x, y from cells")
def s6(spark, d):
    root = scratch_path(spark, "embedding")
    tables.write_embedding(cells(spark, d).select(*KEY, "x", "y"), root, "UMAP")
    return tables.read_embedding(spark, root, "UMAP")


@query("S7_label_table", f"""with {CELLS} select sample_id, cell_id, "cluster" from cells""")
def s7(spark, d):
    path = scratch_path(spark, "labels")
    tables.write_labels(cells(spark, d), path, KEY)
    return tables.read_labels(spark, path)


@query("S11_result_table", _SCORES + """ select "cluster", feature, round(score, 4) score from scores""")
def s11(spark, d):
    root = scratch_path(spark, "results")
    scores = rounded(clusters.distinguishing_scores(_profile(spark, d)), "score", digits=4)
    tables.write_result(scores, root, "scores")
    return tables.read_result(spark, root, "scores", scores.schema)


# ---- runs ------------------------------------------------------------------


def _updates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as updates of runs (one run per customer)."""
    orders = table(spark, d, "orders")
    step = lambda method: F.struct(
        F.col(method).alias("method"),
        F.create_map(F.lit("n_neighbors"), F.col("o_orderkey").cast("string")).alias("params"),
    )
    return orders.select(
        F.concat(F.lit("run_"), F.col("o_custkey").cast("string")).alias("run_id"),
        # Distinct times: the day, plus the order number as microseconds.
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).alias("timestamp"),
        F.when(F.col("o_orderstatus") == "O", F.array(F.struct(
            F.col("o_orderpriority").alias("name"), F.lit("p").alias("original_path"),
            F.col("o_orderkey").alias("size")))).alias("daf_files"),
        F.when(F.col("o_orderstatus") == "F", step("o_orderpriority")).alias("dimensionality_reduction"),
        F.when(F.col("o_totalprice") > 400000, step("o_orderstatus")).alias("clustering"),
        F.when(F.col("o_totalprice") > 100000, F.array("o_orderpriority")).alias("features"),
        F.when(F.col("o_totalprice") > 200000, F.col("o_orderstatus")).alias("population"),
    )


_RUNS = """u as (select 'run_' || o_custkey run_id, o_orderdate + to_microseconds(o_orderkey) ts, * from orders),
  r as (select run_id, max(ts) ts,
    arg_max(o_orderpriority, ts) filter (o_orderstatus = 'O') file,
    arg_max(o_orderpriority, ts) filter (o_orderstatus = 'F') method,
    arg_max(o_orderstatus, ts) filter (o_totalprice > 400000) clustering,
    arg_min(o_orderpriority, ts) filter (o_totalprice > 100000) feature,
    arg_min(o_orderstatus, ts) filter (o_totalprice > 200000) population from u group by 1)"""


@query(
    "S9_run_state",
    f"""with {_RUNS} select run_id, file, method, clustering, feature, population,
    case when feature is null then 0 else 1 end features_count from r""",
)
def s9(spark, d):
    path = scratch_path(spark, "runs")
    updates = _updates(spark, d)
    runs.append_updates(updates.filter("timestamp < '1997-01-01'"), path)
    runs.append_updates(updates.filter("timestamp >= '1997-01-01'"), path)
    state = runs.current_runs(runs.read_updates(spark, path))
    return state.select(
        "run_id",
        F.try_element_at("daf_files", F.lit(1))["name"].alias("file"),
        q("dimensionality_reduction")["method"].alias("method"),
        q("clustering")["method"].alias("clustering"),
        F.try_element_at("features", F.lit(1)).alias("feature"),
        "population",
        "features_count",
    )


@query(
    "S10_run_catalogue",
    f"""with {_RUNS} select run_id, coalesce(method, 'Unknown') method, case when file is null then 0 else 1 end n_files,
    case when clustering is null then 'No' else 'Yes' end clustering, strftime(ts, '%Y-%m-%d') "date" from r""",
)
def s10(spark, d):
    path = scratch_path(spark, "runs")
    runs.append_updates(_updates(spark, d), path)
    return runs.run_catalogue(runs.current_runs(runs.read_updates(spark, path)))


@query(
    "S14_pending_files",
    """with t as (select o_custkey stem, max(o_orderdate) done from orders where o_orderstatus = 'F' group by 1)
    select o_orderkey, o_custkey stem from orders left join t on o_custkey = stem where done is null or done <= o_orderdate""",
)
def s14(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("stem"), F.col("o_orderdate").alias("modified"), "o_orderstatus"
    )
    pending = files.pending_files(orders, orders.filter("o_orderstatus = 'F'").select("stem", "modified"))
    return pending.select("o_orderkey", "stem")


# ---- streams ---------------------------------------------------------------


def _arriving_folder(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The events table as a set of arriving files."""
    folder = scratch_path(spark, "arriving")
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    events.repartition(4, "event_id").write.parquet(folder)
    return folder, events


@query("ST1_ingest_arrivals", """select event_type, count(*) n, round(sum(value), 2) total from events group by 1""")
def st1(spark, d):
    folder, events = _arriving_folder(spark, d)
    out = scratch_path(spark, "bronze")
    stream = arrivals.arriving_events(spark, folder, events.schema, files_per_batch=2)
    arrivals.ingest(stream, out + "/events", out + "/sheet", out + "/state", once=True).awaitTermination()
    stored = spark.read.parquet(out + "/events")
    return stored.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query("ST1_arrival_sheet")
def st1_sheet(spark, d):
    folder, events = _arriving_folder(spark, d)
    out = scratch_path(spark, "bronze")
    stream = arrivals.arriving_events(spark, folder, events.schema, files_per_batch=1)
    arrivals.ingest(stream, out + "/events", out + "/sheet", out + "/state", once=True).awaitTermination()
    return arrivals.latest_sheet(spark, out + "/sheet")


@query("ST2_status_counts", "select event_type, count(*) n_events from events group by 1")
def st2(spark, d):
    folder, events = _arriving_folder(spark, d)
    out = scratch_path(spark, "status")
    stream = arrivals.arriving_events(spark, folder, events.schema, files_per_batch=2)
    arrivals.count_status(stream, out + "/counts", out + "/state", by="event_type", once=True).awaitTermination()
    return spark.read.parquet(out + "/counts")
