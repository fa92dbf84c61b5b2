"""Sample sheets, embeddings, labels and result tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q

#: Columns of a sample sheet.
SHEET_COLUMNS = ("file_name", "sample_id", "group", "replicate")

#: Embedding methods and their table names.
METHOD_NAMES = {"DensMAP": "densmap", "UMAP": "umap", "t-SNE": "tsne"}


def require_sheet(sheet: DataFrame) -> DataFrame:
    """V1: a sheet must name its files."""
    if "file_name" not in sheet.columns:
        raise ValueError("The sample sheet must contain a 'file_name' column.")
    return sheet


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet as text columns; one blank row where there is none yet."""
    if not _exists(spark, path):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in SHEET_COLUMNS])
        return spark.createDataFrame([("",) * len(SHEET_COLUMNS)], schema)
    return require_sheet(spark.read.option("header", True).csv(path))


def write_sheet(sheet: DataFrame, path: str) -> None:
    """A sheet has one row per file and is kept in one CSV part."""
    require_sheet(sheet).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_embedding(df: DataFrame, root: str, method: str) -> None:
    """Coordinates under the method's name."""
    if method not in METHOD_NAMES:
        raise ValueError(f"Unknown method: {method}")
    df.write.mode("overwrite").parquet(f"{root}/method={METHOD_NAMES[method]}")


def read_embedding(spark: SparkSession, root: str, method: str) -> DataFrame:
    """The Parquet table of a method, else its CSV export."""
    name = METHOD_NAMES[method]
    path = f"{root}/method={name}"
    if _exists(spark, path):
        return spark.read.parquet(path)
    return (
        spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/{name}_embedding.csv")
    )


def write_labels(df: DataFrame, path: str, key: list[str], cluster: str = "cluster") -> None:
    """Cluster per row key."""
    df.select(*[q(k) for k in key], q(cluster).cast("int").alias("cluster")).write.mode(
        "overwrite"
    ).parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """S7."""
    return spark.read.parquet(path)


def write_result(df: DataFrame, root: str, name: str, kind: str = "csv") -> str:
    """A result table (top features, cluster cells, heatmap data) by name."""
    path = f"{root}/{name}"
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unknown format: {kind}")
    return path


def read_result(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A CSV result with the types it was written with."""
    try:
        return spark.read.option("header", True).schema(schema).csv(f"{root}/{name}")
    except AnalysisException as problem:
        raise ValueError(f"No result '{name}'") from problem


def embedding_rows(df: DataFrame) -> DataFrame:
    """Coordinates with their key."""
    return df.select("sample_id", "cell_index", F.col("x").cast("double"), F.col("y").cast("double"))
