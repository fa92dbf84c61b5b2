"""CSV readers and writer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q
from ..operators.schema import normalise_header
from ..session import pin
from .files import list_files, read_range

_HEADER_STEP = 1 << 16


def _scan(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None):
    # A doubled quote inside quotes stands for one quote.
    reader = spark.read.option("header", True).option("nanValue", "NaN").option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(paths)
    return reader.option("inferSchema", True).csv(paths)


def with_file_position(
    raw: DataFrame, name: str, per_file: bool, file: str | None = None
) -> DataFrame:
    """Row number in file order, 0-based, of a file scan; optionally the file's
    name.

    A file is read in blocks. Rows are numbered inside their block and the
    table of blocks (one row per split) supplies the offset, so neither a large
    file nor the whole scan meets in one task. The scan is written once: a
    second scan may be split differently.
    """
    columns = [q(c) for c in raw.columns]
    named = [F.col("_metadata.file_name").alias(file)] if file else []
    staged = pin(
        raw.select(
            *columns,
            *named,
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "scan",
    )
    blocks = staged.groupBy("_file", "_block").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    order = Window.orderBy("_file", "_block")
    if per_file:
        order = Window.partitionBy("_file").orderBy("_block")
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("_file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    position = (F.col("_row") - F.col("_first") + F.col("_before")).alias(name)
    kept = columns + ([q(file)] if file else [])
    return staged.join(offsets, ["_file", "_block"]).select(*kept, position)


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | None = None,
    normalize: bool = True,
    add_index: bool = False,
    index_name: str = "Index",
) -> DataFrame:
    """One CSV file (or files with one header).

    Types are inferred in an extra pass unless a schema is given.
    """
    raw = _scan(spark, path, schema)
    if add_index:
        raw = with_file_position(raw, index_name, per_file=False)
    return normalise_header(raw) if normalize else raw


def _first_line(path: str) -> str:
    """First line of a file, however long it is."""
    data, at = b"", 0
    while b"\n" not in data:
        part = read_range(path, at, _HEADER_STEP)
        if not part:
            break
        data, at = data + part, at + len(part)
    return data.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")


def file_headers(spark: SparkSession, folder: str, pattern: str = "*.[cC][sS][vV]") -> DataFrame:
    """(path, file, header) of the CSV files in a folder; only headers are read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(header=[_first_line(p) for p in pdf["path"]])

    files = list_files(spark, folder, pattern).select("path", "file")
    return files.mapInPandas(read, "path string, file string, header string")


def _common_type(kinds: set[T.DataType]) -> T.DataType:
    """Type that holds all values of a column whose files disagree."""
    if len(kinds) == 1:
        return next(iter(kinds))
    if all(isinstance(k, (T.IntegerType, T.LongType)) for k in kinds):
        return T.LongType()
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.DoubleType()
    return T.StringType()


def read_files(
    spark: SparkSession,
    folder: str,
    *,
    join: str = "outer",
    normalize: bool = True,
    add_index: bool = False,
    index_name: str = "Index",
) -> DataFrame:
    """Every CSV file of a folder with its name in the last column ``file``.

    Files are scanned per distinct header, because one scan over files with
    different headers would match columns by position.
    """
    if join not in ("inner", "outer"):
        raise ValueError("join must be 'inner' or 'outer'")
    groups = (
        file_headers(spark, folder)
        .groupBy("header")
        .agg(F.array_sort(F.collect_list("path")).alias("paths"))
        .orderBy("header")
    )
    scans = []
    for row in groups.toLocalIterator():  # one row per distinct header
        raw = _scan(spark, row["paths"], None)
        if add_index:
            raw = with_file_position(raw, "_position", per_file=True, file="file")
        else:
            raw = raw.select("*", F.col("_metadata.file_name").alias("file"))
        scans.append(normalise_header(raw) if normalize else raw)
    if not scans:
        print(f"No CSV files found in: {folder}")
        return spark.createDataFrame([], T.StructType([]))
    names = [c for s in scans for c in s.columns]
    if join == "inner":
        names = [c for c in scans[0].columns if all(c in s.columns for s in scans)]
    names = [c for c in dict.fromkeys(names) if c not in ("file", "_position")]
    kinds = {
        c: _common_type({s.schema[c].dataType for s in scans if c in s.columns}) for c in names
    }
    extra = ["_position"] if add_index else []
    aligned = [
        s.select(*[q(c).cast(kinds[c]).alias(c) for c in names if c in s.columns], "file", *extra)
        for s in scans
    ]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)
    if add_index:
        sizes = out.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(
            Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        )
        starts = sizes.select("file", F.coalesce(before, F.lit(0)).alias("_start"))
        index = (F.col("_position") + F.col("_start")).alias(index_name)
        return out.join(starts, "file").select(index, *[q(c) for c in names], "file")
    return out.select(*[q(c) for c in names], "file")


def save_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index column, one file per partition."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
