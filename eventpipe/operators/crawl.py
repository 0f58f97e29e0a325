"""Dedup of discovered URLs (A2, W3, J4) and the depth-bounded follow.

Dedup shuffles on the full ``(venue, url)`` key with map-side partial
aggregation, never on the host alone, so one large host does not skew it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def first_seen(links: DataFrame, key: list[str] = ("venue", "abs_url"), order=("depth", "src_url", "pos")) -> DataFrame:
    """First occurrence per key wins (``LoadOrStore``): one row per key, earliest by ``order``.

    ``min_by`` on a struct is a hash aggregate with a partial map-side step, so a
    key that appears millions of times is reduced before the shuffle.
    """
    key = list(key)
    order = list(order)
    carried = [c for c in links.columns if c not in key]
    ordered = F.struct(*[F.col(c) for c in order])
    best = F.min_by(F.struct(*[F.col(c) for c in carried]), ordered).alias("_first")
    return links.groupBy(*key).agg(best).select(*key, "_first.*")


def distinct_count(links: DataFrame, by: list[str], col: str, out: str) -> DataFrame:
    """Distinct URLs per venue (exact ``count(distinct)``: two aggregation steps, both partial)."""
    return links.groupBy(*by).agg(F.count_distinct(col).alias(out))


def drop_visited(found: DataFrame, visited: DataFrame, on: list[str]) -> DataFrame:
    """URLs not seen before: ``left_anti`` against the visited table."""
    return found.join(visited.select(*on).distinct(), on, "left_anti")


class VisitedTable:
    """URLs of earlier runs (J4) as a table bucketed and sorted by ``url``, which grows by one delta a run.

    ``unseen`` joins a run's URLs to it on the buckets, so that only the run is shuffled and
    the visited URLs, by far the larger side, are read where they lie. A bucket holds about
    64 MB of the first run's URLs unless their number is given; ``rebucket`` writes a grown table anew.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.wanted = spark, name, buckets

    def buckets(self) -> int | None:
        """The table's number of buckets; None before the first run."""
        if not self.spark.catalog.tableExists(self.name):
            return None
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").where("col_name = 'Num Buckets'").collect()
        return int(rows[0]["data_type"])

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, found: DataFrame, url_col: str = "url") -> DataFrame:
        """The rows of ``found`` whose URL no earlier run has; a null URL was never visited."""
        if self.buckets() is None:
            return found
        # merge: the planner may else broadcast either side; repeated URLs of the table do not multiply an anti join
        return found.join(self.read().select(F.col("url").alias("_visited")).hint("merge"), F.col(url_col) == F.col("_visited"), "left_anti")

    def add(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """Append the run's URLs that the table lacks, each once, and return them; a repeated run appends nothing."""
        ensure_checkpoint_dir(self.spark)
        new = self.unseen(urls.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).distinct()).checkpoint()
        n = self.buckets()
        if n is None:
            size = new.agg(F.sum(F.octet_length("url").cast("long"))).first()[0] or 0
            n = self.wanted or max(1, -(-size // (64 << 20)))
        elif new.isEmpty():
            return new
        new.repartition(n, "url").write.mode("append").bucketBy(n, "url").sortBy("url").format("parquet").saveAsTable(self.name)
        return new

    def rebucket(self, name: str, buckets: int) -> VisitedTable:
        """The same URLs as a new table with another number of buckets."""
        other = VisitedTable(self.spark, name, buckets)
        other.add(self.read())
        return other


def follow(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = 2,
    src: str = "src",
    dst: str = "dst",
) -> DataFrame:
    """Breadth-first reach from ``seeds`` (column ``node``): one row ``node, depth`` per node.

    Seeds are depth 1. Each round joins the frontier to the edges, drops nodes
    already reached (``left_anti``) and keeps the rest as the next frontier, so a
    cyclic graph ends when no new node appears. ``max_depth=None`` walks to
    exhaustion. Each round's result is checkpointed to the shared checkpoint
    folder, so lineage stays one round deep and a lost executor recomputes one
    round only; the reached set is the union of those per-round checkpoints, so
    nothing is rewritten twice.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    # The distinct edge list is built once and checkpointed: every round reads it
    # instead of rebuilding it. It is not pre-partitioned by node on purpose: the
    # per-round shuffle join lets AQE split a hub node that holds a third of all
    # edges, which a co-partitioned (shuffle-free) join would leave in one task.
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct().checkpoint()
    reached = seeds.select("node").distinct().withColumn("depth", F.lit(1)).checkpoint()
    frontier = reached
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(e, "node").select(F.col("next").alias("node")).distinct()
        new = step.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        frontier = new
    return reached
