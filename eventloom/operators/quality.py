"""Gate detection, population sets and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q, quoted
from .ordering import with_position

#: Names that always mean a population.
GATE_NAMES = ("Live", "Singlet", "Dead", "Doublet", "Focused", "Viable")


def is_gate_name(name: Column) -> Column:
    """A20, by name: ``R<digits>``, ``R...&...`` or a known name."""
    return name.rlike(r"^R([0-9]+$|.*&)") | name.isin(*GATE_NAMES)


def gate_columns(df: DataFrame, file: str | None = "sample_id") -> DataFrame:
    """Columns that are populations, per file.

    One aggregate for all columns: a numeric column is a gate when both 0 and 1
    occur and nothing else does.
    """
    checks, names = [], []
    for f in df.schema.fields:
        if f.name in (file, "sample_id"):
            continue
        names.append(f.name)
        if isinstance(f.dataType, T.BooleanType):
            test = F.lit(True)
        elif isinstance(f.dataType, T.NumericType):
            v = q(f.name).cast("double")
            test = F.coalesce(
                (F.min(v) == 0) & (F.max(v) == 1) & F.bool_and(v.isin(0.0, 1.0)), F.lit(False)
            )
        else:
            test = F.lit(False)
        checks.append((test | is_gate_name(F.lit(f.name))).alias(f.name))
    keys = [q(file)] if file else []
    wide = df.groupBy(*keys).agg(*checks)
    long = wide.unpivot(
        [quoted(file)] if file else [], [quoted(n) for n in names], "population", "is_gate"
    )
    return long.filter("is_gate").drop("is_gate")


def population_sets(gates: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:
    """Each population with the number of files that have it.

    ``common`` marks those present in every file.
    """
    total = files.agg(F.count_distinct(q(file))).scalar()
    counted = gates.groupBy("population").agg(F.count_distinct(q(file)).alias("n_files"))
    return counted.withColumn("common", F.col("n_files") == total)


def embedding_diagnostics(df: DataFrame) -> DataFrame:
    """Spread, collinearity and invalid share of the coordinates.

    The correlation is left out where one coordinate has no spread.
    """
    x, y = q("x").cast("double"), q("y").cast("double")
    bad = x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y) | F.abs(x).isin(float("inf")) | F.abs(y).isin(float("inf"))
    gx, gy = F.when(~bad, x), F.when(~bad, y)
    sums = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad).alias("n_invalid"),
        F.var_samp(gx).alias("var_x"),
        F.var_samp(gy).alias("var_y"),
        F.covar_samp(gx, gy).alias("_cov"),
    )
    # cov / (sx * sy) equals corr and does not divide by zero inside the aggregate.
    corr = F.try_divide(F.col("_cov"), F.sqrt(F.col("var_x") * F.col("var_y")))
    return (
        sums.withColumn("corr_xy", corr)
        .drop("_cov")
        .withColumn("flat_x", F.coalesce(F.col("var_x") < 1e-10, F.lit(True)))
        .withColumn("flat_y", F.coalesce(F.col("var_y") < 1e-10, F.lit(True)))
        .withColumn("collinear", F.coalesce(F.abs("corr_xy") > 0.99, F.lit(False)))
        .withColumn("many_invalid", F.col("n_invalid") > 0.1 * F.col("n_rows"))
    )


def value_domain(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value."""
    v = F.nanvl(q(column).cast("double"), F.lit(None).cast("double"))
    return df.agg(F.min(v).alias("low"), F.max(v).alias("high"))


def factor_index(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in order, with a 0-based palette index; nulls have none.

    The values are numbered by a range sort and the number of values in each sorted
    part, so that no task holds them all.
    """
    values = df.select(q(column).alias(column)).where(q(column).isNotNull()).distinct()
    placed = with_position(values, [], [column], "palette_index")
    return placed.select(F.col("palette_index").cast("int").alias("palette_index"), q(column))


def columns_per_file(df: DataFrame, file: str, columns: Sequence[str]) -> DataFrame:
    """(file, feature) rows: which of ``columns`` carry a value in each file."""
    wide = df.groupBy(q(file).alias("file")).agg(
        *[(F.count(q(c)) > 0).alias(c) for c in columns]
    )
    long = wide.unpivot(["file"], [quoted(c) for c in columns], "feature", "_has")
    return long.filter("_has").drop("_has")
