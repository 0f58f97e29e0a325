"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, state_path

SF_NAME = "{}/{}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(SF_NAME.format(sf_dir.rstrip("/"), name))


#: Spark's own defaults, and what the operators need so that a batch of long texts stays small in a Python worker.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"),
}


def ready(df: DataFrame) -> SparkSession:
    """The frame's session, after making sure that Python workers can import this package.

    Arrow batches are made smaller if the session has Spark's defaults; a value that somebody chose stays.
    """
    spark = df.sparkSession
    ship_package(spark)
    for key, (default, value) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: its lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = state_path(spark, "llm", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash; null text becomes empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the rows are measured to hold at most ``most_bytes``; else the planner's shuffle join.

    The measure is a full count of the bytes of all columns as text (and 16 for
    each row), not an estimate, so the hint rests on what is really sent.
    """
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(16))
    size = df.agg(F.sum(width).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(df) if size <= most_bytes else df
