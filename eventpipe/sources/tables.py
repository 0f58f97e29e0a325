"""Parquet table scans. Column pruning and filter pushdown happen in the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SPREAD_ROWS = 8_192


def spread(df: DataFrame, by: list[str], rows: int = SPREAD_ROWS) -> DataFrame:
    """``df`` dealt over partitions of about ``rows`` rows by a hash of ``by``, ahead of work that is heavy for each row.

    A table of short rows is one file of one row group, and so one task, however much is made of each row. The
    rows are shuffled while they are short, without a sort. ``by`` should tell the rows apart.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *by)


TEXT_PARTITION_BYTES = 32 << 20


def text_partitions(df: DataFrame, col: str) -> int:
    """How many partitions hold ``TEXT_PARTITION_BYTES`` of a text column each; never fewer than shuffles have.

    The column is measured as it is in memory: text that repeats is compressed many times over in files and shuffles, so their sizes say little.
    """
    from pyspark.sql import functions as F

    held = df.agg(F.sum(F.octet_length(col).cast("long"))).first()[0] or 0
    return max(-(-held // TEXT_PARTITION_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved page snapshots ``page_id, url, html`` (the live fetch, re-aimed as a scan)."""
    return table(spark, sf_dir, "pages")


def read_html_folder(spark: SparkSession, path: str) -> DataFrame:
    """A folder of saved ``.html`` files as ``page_id, url, html`` (one row per file)."""
    from pyspark.sql import functions as F

    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.html").text(path)
    return raw.select(
        F.xxhash64(F.input_file_name()).alias("page_id"),
        F.input_file_name().alias("url"),
        F.col("value").alias("html"),
    )


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Raw stored files as ``path, length, modificationTime`` (content is never read)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")


def write_bucketed_pages(pages: DataFrame, table_name: str, buckets: int) -> DataFrame:
    """Save page snapshots as a table bucketed and sorted by ``url``; returns the table.

    Joins on ``url`` against it (the extract stage) then shuffle only the other
    side: the page HTML, by far the largest data, stays where it was written. The
    table lives in the session's warehouse (shared storage on a cluster). Write it
    once per snapshot load, not per query.
    """
    spark = pages.sparkSession
    (
        pages.select("page_id", "url", "html")
        .write.mode("overwrite")
        .bucketBy(buckets, "url")
        .sortBy("url")
        .format("parquet")
        .saveAsTable(table_name)
    )
    return spark.table(table_name)
