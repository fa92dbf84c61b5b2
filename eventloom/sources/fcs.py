"""Flow Cytometry Standard files (S3), after the public FCS 3.1 standard.

Files are not opened whole. A header pass reads the first bytes of each file;
events are fixed-width, so the data segment is cut into byte ranges that
become independent tasks. A single huge file spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pin
from .files import list_files, read_range

#: Fixed values of the standard: header length and the offset fields in it.
HEADER_BYTES = 58
_TEXT_START, _TEXT_END, _DATA_START, _DATA_END = (10, 18), (18, 26), (26, 34), (34, 42)

HEADER_SCHEMA = (
    "path string, file string, sample_id string, n_events long, data_start long, datatype string, "
    "big_endian boolean, bits array<int>, channels array<string>, ranges array<double>, "
    "decades array<double>, offsets array<double>, gains array<double>, error string"
)


def parse_text(segment: bytes) -> dict[str, str]:
    """Keywords of a TEXT segment; a doubled delimiter stands for itself."""
    text = segment.decode("utf-8", errors="replace")
    mark = text[0]
    body = text[1:].rstrip("\x00\r\n ")
    body = body[:-1] if body.endswith(mark) else body
    parts = [p.replace("\x00", mark) for p in body.replace(mark * 2, "\x00").split(mark)]
    return {k.strip().upper(): v.strip() for k, v in zip(parts[0::2], parts[1::2])}


def read_header(path: str) -> dict:
    """Layout of one file."""
    head = read_range(path, 0, HEADER_BYTES)
    if len(head) < HEADER_BYTES or not head.startswith(b"FCS"):
        raise ValueError("not an FCS file")
    start, end, data_start, data_end = (
        int(head[a:b].decode().strip() or 0) for a, b in (_TEXT_START, _TEXT_END, _DATA_START, _DATA_END)
    )
    words = parse_text(read_range(path, start, end - start + 1))
    # Offsets beyond eight digits stand in the TEXT segment.
    data_start = data_start or int(words.get("$BEGINDATA", "0"))
    n = int(words["$PAR"])

    def each(letter: str, default: str) -> list[str]:
        return [words.get(f"$P{i}{letter}", default) for i in range(1, n + 1)]

    scales = [e.split(",") for e in each("E", "0,0")]
    decades = [float(s[0]) for s in scales]
    low = [float(s[1]) or 1.0 for s in scales]
    names = each("N", "")
    if len(set(names)) < n:
        raise ValueError("channel names repeat")
    if int(words.get("$NEXTDATA", "0") or 0):
        raise ValueError("more than one data set in the file")
    gains = [float(g) or 1.0 for g in each("G", "1")]
    if "$TIMESTEP" in words:
        step = float(words["$TIMESTEP"])
        gains = [1.0 / step if name.lower() == "time" else g for name, g in zip(names, gains)]
    return {
        "n_events": int(words["$TOT"]),
        "data_start": data_start,
        "datatype": words["$DATATYPE"].upper(),
        "big_endian": words.get("$BYTEORD", "1,2,3,4").startswith(("4", "2,1")),
        "bits": [int(b) for b in each("B", "32")],
        "channels": names,
        "ranges": [float(r) for r in each("R", "0")],
        "decades": decades,
        "offsets": low,
        "gains": gains,
        "error": None,
    }


def fcs_headers(spark: SparkSession, folder: str, pattern: str = "*.[fF][cC][sS]") -> DataFrame:
    """One row per file; a file that cannot be read carries its error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = dict.fromkeys(
            "n_events data_start datatype big_endian bits channels ranges decades offsets gains error".split()
        )
        for pdf in batches:
            rows = []
            for path, file, stem in zip(pdf["path"], pdf["file"], pdf["stem"]):
                row = {"path": path, "file": file, "sample_id": stem}
                try:
                    row |= read_header(path)
                except Exception as problem:
                    row |= empty | {"error": str(problem)}
                rows.append(row)
            yield pd.DataFrame(rows)

    files = list_files(spark, folder, pattern).select("path", "file", "stem")
    return files.mapInPandas(read, HEADER_SCHEMA)


def header_columns(headers: DataFrame) -> DataFrame:
    """(file, feature) rows from the headers alone."""
    return headers.select("file", F.explode("channels").alias("feature"))


def decode(block: bytes, datatype: str, big_endian: bool, bits: list[int]) -> np.ndarray:
    """Events of a byte block as an (events, channels) array of doubles."""
    order = ">" if big_endian else "<"
    if datatype in ("F", "D"):
        width = {"F": "f4", "D": "f8"}[datatype]
        return np.frombuffer(block, order + width).reshape(-1, len(bits)).astype("f8")
    if datatype != "I" or any(b % 8 or b > 64 for b in bits):
        raise ValueError(f"unsupported data type {datatype} with {bits} bits")
    sizes = [b // 8 for b in bits]
    raw = np.frombuffer(block, "u1").reshape(-1, sum(sizes))
    out = np.empty((len(raw), len(bits)))
    at = 0
    for j, size in enumerate(sizes):
        part = raw[:, at : at + size]
        part = part[:, ::-1] if big_endian else part
        padded = np.zeros((len(raw), 8), "u1")
        padded[:, :size] = part
        out[:, j] = padded.view("<u8")[:, 0]
        at += size
    return out


def to_values(events: np.ndarray, head: dict) -> np.ndarray:
    """Integer masks, logarithmic amplification and gain of each channel."""
    for j, (top, decades, low, gain) in enumerate(
        zip(head["ranges"], head["decades"], head["offsets"], head["gains"])
    ):
        if head["datatype"] == "I" and top > 0:
            # Bits above the declared range are not part of the value.
            mask = (1 << max(int(np.ceil(np.log2(top))), 1)) - 1
            events[:, j] = events[:, j].astype("u8") & np.uint64(mask)
        if decades > 0 and top > 0:
            events[:, j] = 10 ** (decades * events[:, j] / top) * low
        elif gain not in (0.0, 1.0):
            events[:, j] = events[:, j] / gain
    return events


def read_fcs(
    spark: SparkSession,
    folder: str,
    *,
    pattern: str = "*.[fF][cC][sS]",
    task_bytes: int = 32 << 20,
    on_error: str = "raise",
) -> DataFrame:
    """S3: events of all files, keyed by ``sample_id`` and ``cell_index``.

    Columns are the union of the channels; a channel a file lacks is null.
    ``on_error='skip'`` leaves unreadable files out (see :func:`fcs_headers`).
    """
    headers = pin(fcs_headers(spark, folder, pattern), "fcs-headers")
    if on_error == "raise":
        bad = headers.filter("error is not null").select("file", "error").first()
        if bad:
            raise ValueError(f"{bad['file']}: {bad['error']}")
    good = headers.filter("error is null")
    # Bounded: the distinct channel names.
    names = [
        r["feature"] for r in header_columns(good).select("feature").distinct().orderBy("feature").collect()
    ]
    event_bytes = F.aggregate("bits", F.lit(0), lambda a, b: a + b) / 8
    step = F.greatest(F.lit(1), F.floor(F.lit(task_bytes) / event_bytes)).cast("long")
    ranges = (
        good.filter("n_events > 0")
        .withColumn("step", step)
        .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_events") - 1, F.col("step"))))
        .withColumn("count", F.least(F.col("step"), F.col("n_events") - F.col("first")))
    )
    schema = T.StructType(
        [T.StructField("sample_id", T.StringType()), T.StructField("cell_index", T.LongType())]
        + [T.StructField(n, T.DoubleType()) for n in names]
    )

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head in batch.to_pylist():
                width = sum(head["bits"]) // 8
                start = head["data_start"] + head["first"] * width
                block = read_range(head["path"], start, head["count"] * width)
                if len(block) < head["count"] * width:
                    raise ValueError(f"{head['file']}: the data end before the last event")
                events = to_values(
                    decode(block, head["datatype"], head["big_endian"], head["bits"]), head
                )
                n = len(events)
                index = np.arange(head["first"], head["first"] + n)
                at = {c: j for j, c in enumerate(head["channels"])}
                columns = [pa.array([head["sample_id"]] * n, pa.string()), pa.array(index, pa.int64())]
                for name in names:
                    if name in at:
                        columns.append(pa.array(np.ascontiguousarray(events[:, at[name]])))
                    else:
                        columns.append(pa.nulls(n, pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=["sample_id", "cell_index", *names])

    # Ranges are spread evenly; each is one bounded read.
    spread = ranges.repartition(
        max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "first"
    )
    return spread.mapInArrow(load, schema)


def convert_to_table(spark: SparkSession, folder: str, out: str, **options) -> DataFrame:
    """S3: decode a folder once into Parquet; later reads use the table."""
    read_fcs(spark, folder, **options).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
