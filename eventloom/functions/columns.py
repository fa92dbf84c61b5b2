"""Small column expressions: quoting, type selection, labels, name rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")

#: File endings that do not belong to a sample's name.
SAMPLE_FILE_ENDINGS = r"(?i)\.(daf|fcs|csv)$"

#: Header replacements, applied in this order after trimming.
HEADER_REPLACEMENTS = ((" ", "_"), ("&", "and"), ("+", "plus"), ("-", "minus"))


def quoted(name: str) -> str:
    """A column name safe to put into ``F.col`` (dots, blanks, symbols)."""
    return "`" + name.replace("`", "``") + "`"


def q(name: str) -> Column:
    return F.col(quoted(name))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns, in table order."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Column(s) {missing} do not exist.")


def clean_header(name: str) -> str:
    out = name.strip()
    for old, new in HEADER_REPLACEMENTS:
        out = out.replace(old, new)
    return out


def nan_to_null(column: Column) -> Column:
    return F.nanvl(column, F.lit(None).cast("double"))


def finite_or_null(column: Column) -> Column:
    """±Inf (and NaN) become null."""
    return F.when(~column.isin(INF, -INF) & ~F.isnan(column), column)


def file_stem(column: Column) -> Column:
    """Sample name of a file name."""
    return F.regexp_replace(column, SAMPLE_FILE_ENDINGS, "")


def is_filled(column: Column) -> Column:
    """True unless null, blank or the text ``nan``."""
    text = F.trim(column.cast("string"))
    return F.coalesce((text != "") & (F.lower(text) != "nan"), F.lit(False))


def cluster_label(column: Column) -> Column:
    """Cluster number as text; -1 reads ``Noise``."""
    return F.when(column == -1, F.lit("Noise")).otherwise(column.cast("string"))


def draw_order(keys: Iterable[str], seed: int) -> Column:
    """Pseudo-random but reproducible order of rows identified by ``keys``."""
    return F.md5(F.concat_ws("|", *[q(k).cast("string") for k in keys], F.lit(str(seed))))


def stars(p: Column) -> Column:
    """Significance marker; null when not significant."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
