"""Sequence numbers within a key (W1) and the delivery schedule.

A plain ``row_number`` over one key sends every row of that key to one task, so
one venue holding a third of the rows would sort in one task. Here the rows are
range-partitioned on ``(key, order...)``: a hot key spreads over many
partitions. Each partition numbers its rows in sorted order
(``monotonically_increasing_id`` low bits), a tiny table of per
``(key, partition)`` counts gives each partition its offset by a prefix sum,
and a join adds it back. That table has at most ``#keys + #partitions`` rows; it
is broadcast when its measured bytes are under ``broadcast_bytes``, else
joined by shuffle on ``(key, partition)``, which cannot skew either. The
decision measures the checkpointed count table itself, so the bound is exact.

The numbered rows are used twice (counts, and the join back), and two range
exchanges over the same input may draw different bounds (the partitioner's
resampling seed depends on the RDD id), so the numbered rows are checkpointed
once to the shared checkpoint folder and both branches read that copy. The
order must be total (unique within a key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import BROADCAST_MAX_BYTES, bounded_broadcast

_LOW_BITS = (1 << 33) - 1

DELAY_STEP_SECONDS = 15  # fixed value: spacing of successive extract messages in one run


def _cols(names) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def number_within(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str = "seq",
    partitions: int | None = None,
    broadcast_bytes: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """Adds ``out`` = 1, 2, ... per ``keys`` in ``order``, without a one-task window: one plan at every size."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *_cols(keys + order)).sortWithinPartitions(*_cols(keys + order))
    tagged = (
        ranged.withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright(F.col("_mid"), 33))
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
    )
    ensure_checkpoint_dir(spark)
    tagged = tagged.checkpoint(eager=True)
    stats = tagged.groupBy(*keys, "_part").agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").checkpoint()
    joined = tagged.join(bounded_broadcast(stats, max_bytes=broadcast_bytes), [*keys, "_part"])
    seq = (F.col("_local") - F.col("_first") + F.col("_before") + F.lit(1)).cast("long")
    return joined.withColumn(out, seq).drop("_mid", "_part", "_local", "_first", "_before")


def row_number_within(df: DataFrame, keys: list[str], order: list[str], out: str = "seq") -> DataFrame:
    """The plain window form: one task per key (the tests compare with it)."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(out, F.row_number().over(w).cast("long"))


def with_schedule(df: DataFrame, run_ts: str, seq_col: str = "seq", step: int = DELAY_STEP_SECONDS) -> DataFrame:
    """``delay_s = seq * step``; ``deliver_at = run_ts + delay_s`` (the Nth message is due N*15 s later)."""
    delay = (F.col(seq_col) * F.lit(step)).cast("long")
    run = F.to_timestamp_ntz(F.lit(run_ts))
    return df.withColumn("delay_s", delay).withColumn("deliver_at", F.timestamp_add("SECOND", delay, run))
