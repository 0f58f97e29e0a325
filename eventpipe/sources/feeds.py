"""Event feeds in JSON, XML or CSV (S10) and the nested event catalogue.

Files are read by Spark's own readers with a declared schema (no inference);
feed text already in a column is parsed by ``from_json`` / ``from_xml`` /
``from_csv``, so batch files and message payloads share one schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("json", "xml", "csv")
CORRUPT = "_corrupt_record"


def read_feed(spark: SparkSession, path: str, fmt: str, schema: str, row_tag: str = "event", multiline: bool = False) -> DataFrame:
    """A feed folder or file as rows of ``schema`` and ``_corrupt_record``, which holds the text of a bad record (else null)."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown feed format {fmt!r}; use one of {FORMATS}")
    r = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "json":
        return r.option("multiLine", multiline).json(path)
    if fmt == "xml":
        return r.option("rowTag", row_tag).xml(path)
    return r.option("header", True).option("multiLine", multiline).option("escape", '"').csv(path)


def read_catalogue(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """The listing page's event catalogue: a JSON array of nested events (multi-line), or JSON lines."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def write_catalogue(events: DataFrame, path: str, per_line: int = 500) -> None:
    """The catalogue as text files of JSON arrays, one array of at most ``per_line`` events a line.

    Each line is a document of the page's form, and the files still split by line
    (read them with ``multiline=False``).
    """
    line = F.floor(F.monotonically_increasing_id() / per_line)
    each = events.select(line.alias("line"), F.struct(*events.columns).alias("event"))
    each.groupBy("line").agg(F.to_json(F.collect_list("event")).alias("value")).select("value").write.text(path)


def write_feed(df: DataFrame, path: str, fmt: str, row_tag: str = "event") -> None:
    """Write rows as a feed folder in ``fmt`` (one file per task; CSV with a header)."""
    w = df.write.mode("overwrite")
    if fmt == "json":
        w.json(path)
    elif fmt == "xml":
        w.option("rowTag", row_tag).xml(path)
    elif fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown feed format {fmt!r}; use one of {FORMATS}")


def parse_feed(text: Column, fmt: str, schema: str) -> Column:
    """Struct of ``schema`` from one feed record held as text."""
    if fmt == "json":
        return F.from_json(text, schema)
    if fmt == "xml":
        return F.from_xml(text, schema)
    if fmt == "csv":
        return F.from_csv(text, schema)
    raise ValueError(f"unknown feed format {fmt!r}; use one of {FORMATS}")


def to_feed_text(record: Column, fmt: str) -> Column:
    if fmt == "json":
        return F.to_json(record)
    if fmt == "xml":
        return F.to_xml(record)
    if fmt == "csv":
        return F.to_csv(record)
    raise ValueError(f"unknown feed format {fmt!r}; use one of {FORMATS}")
