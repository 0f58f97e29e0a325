"""``EventStore``: the storage interface (U4) as one Parquet table, partitioned by the bucket of the pathname.

Layout: ``<path>/of=<n>/bucket=<b>/``, written by plain Spark writes. A put-if-absent
appends the keys that its buckets lack, so what Spark has committed is there and
nothing else is: a put that died before its commit left nothing, one that died
after it left whole rows, and the next put finds them stored. Overwrite and delete
rewrite the buckets they touch and no other (``partitionOverwriteMode=dynamic``); a
bucket that loses its last object keeps a row without a pathname, which readers skip.

Each put has a write token (``writer``, ``batch_id``), a fresh one unless the caller names
it. A retry under the same token changes nothing, and a token that is used again
with other content is refused. The number of buckets is fixed when the store is
made: given, or so that a bucket holds 64 MB of the first put; ``rebucket`` writes a
grown store anew. Writers run one at a time, and not while a reader lists files: Parquet has no
compare-and-set, and a rewritten bucket is replaced folder by folder.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.zones import ntz_text
from ..session import ensure_checkpoint_dir
from . import store as ST

OBJECT_COLUMNS = (
    "pathname string, url string, download_url string, access string, content_type string, "
    "cache_control_max_age int, size long, uploaded_at string, etag string, body string, writer string, batch_id long"
)
_PARTS = ["of", "bucket"]


class EventStore:
    def __init__(self, spark: SparkSession, path: str, base_url: str, buckets: int | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.base_url = base_url
        self.wanted = buckets

    # ------------------------------------------------------------ table
    def _table(self) -> DataFrame | None:
        if not ST.path_exists(self.spark, self.path):
            return None
        return self.spark.read.schema(f"{OBJECT_COLUMNS}, of int, bucket int").parquet(self.path)

    def buckets(self) -> int | None:
        """The store's number of buckets, from its folders; None before the first put."""
        table = self._table()
        files = table.inputFiles() if table is not None else []
        return int(re.search(r"/of=(\d+)/", files[0])[1]) if files else None

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """All objects, or those of some buckets, of which alone files are then read."""
        table = self._table()
        if table is None:
            return self.spark.createDataFrame([], OBJECT_COLUMNS)
        if touched is not None:
            table = table.where(F.col("bucket").isin(touched))
        return table.where("pathname is not null").drop(*_PARTS)

    def _bucketed(self, rows: DataFrame, n: int) -> DataFrame:
        columns = [F.col(c.split()[0]) for c in OBJECT_COLUMNS.split(", ")]
        return rows.select(*columns, F.lit(n).alias("of"), ST.key_bucket("pathname", n).alias("bucket"))

    def _touched(self, keys: DataFrame, n: int) -> list[int]:
        return sorted(r[0] for r in keys.select(ST.key_bucket("pathname", n)).distinct().collect())  # at most n ids

    def _append(self, rows: DataFrame, n: int) -> None:
        self._bucketed(rows, n).write.mode("append").partitionBy(*_PARTS).parquet(self.path)

    def _rewrite(self, rows: DataFrame, touched: list[int], n: int) -> None:
        """Put ``rows`` in place of the touched buckets' content."""
        kept = self.spark.createDataFrame([(b,) for b in touched], "bucket int").withColumn("of", F.lit(n))
        out = self._bucketed(rows, n).unionByName(kept, allowMissingColumns=True).checkpoint()
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTS).parquet(self.path)

    def rebucket(self, path: str, buckets: int) -> EventStore:
        """The store's objects as a new store with another number of buckets."""
        other = EventStore(self.spark, path, self.base_url, buckets)
        other._append(self.read(), buckets)
        return other

    # ------------------------------------------------------------ writes
    def put(
        self,
        docs: DataFrame,
        order: str,
        overwrite: bool = False,
        add_random_suffix: bool = False,
        access: str = ST.DEFAULT_ACCESS,
        content_type: str | None = None,
        cache_max_age: int = 0,
        writer: str | None = None,
        batch_id: int = 0,
    ) -> tuple[DataFrame, DataFrame]:
        """Put documents ``pathname, body, uploaded_at?, <order>``; returns ``(written, rejected)``.

        ``writer`` and ``batch_id`` are the put's write token; name them to make a retry
        of the same put harmless. A named token with other content raises ``ValueError``.
        """
        ensure_checkpoint_dir(self.spark)
        writer = writer or f"put-{uuid.uuid4().hex}"
        if add_random_suffix:
            docs = docs.withColumn("pathname", ST.with_suffix(F.col("pathname"), F.col(order), token=f"{writer}/{batch_id}"))
        if "uploaded_at" not in docs.columns:
            now_utc = F.timestamp_add("MICROSECOND", F.unix_micros(F.current_timestamp()), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
            docs = docs.withColumn("uploaded_at", F.concat(ntz_text(now_utc), F.lit("Z")))
        n = self.buckets() or self.wanted or ST.store_buckets(docs.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0)
        touched = self._touched(docs, n)
        current = self.read(touched)
        tag = {"writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("long")}
        if overwrite:
            latest = ST.last_wins(docs, order)
            rows = ST.object_rows(latest, self.base_url, access, content_type, cache_max_age).withColumns(tag).checkpoint()
            self._rewrite(ST.put_overwrite(current, rows.drop(order), order="batch_id"), touched, n)
            return rows, docs.limit(0).withColumn("reason", F.lit(None).cast("string"))
        mine = (F.col("writer") == F.lit(writer)) & (F.col("batch_id") == F.lit(batch_id))
        accepted, rejected = ST.put_if_absent(current.where(~mine).select("pathname"), docs, order=order)
        rows = ST.object_rows(accepted, self.base_url, access, content_type, cache_max_age).withColumns(tag).checkpoint()
        rejected = rejected.checkpoint()
        own = self.read().where(mine).select("pathname", "etag")
        if own.isEmpty():
            self._append(rows, n)
        else:  # the token is stored: only a retry of the same put may use it
            new = rows.select("pathname", "etag")
            if not (new.exceptAll(own).isEmpty() and own.exceptAll(new).isEmpty()):
                raise ValueError(f"write token ({writer}, {batch_id}) was used for other content")
        return rows, rejected

    def delete(self, keys: DataFrame, key_col: str = "key") -> None:
        """Delete by pathname or URL; an empty key set changes nothing.

        The keys' pathnames are looked up first (two narrow columns of the store), then their buckets are rewritten.
        """
        n = self.buckets()
        if n is None or keys.isEmpty():
            return
        ensure_checkpoint_dir(self.spark)
        names = self.read().select("pathname", "url")
        gone = names.join(ST.delete_keys(names, keys, self.base_url, key_col=key_col), "pathname", "left_anti").select("pathname").checkpoint()
        touched = self._touched(gone, n)
        if touched:
            self._rewrite(self.read(touched).join(gone, "pathname", "left_anti"), touched, n)

    # ------------------------------------------------------------ reads
    def get(self, pathnames: DataFrame) -> DataFrame:
        return ST.get_objects(self.read(), pathnames)

    def list(self, prefix: str = "", limit: int = 0, cursor: str = "") -> DataFrame:
        return ST.list_objects(self.read(), prefix=prefix, limit=limit, cursor=cursor)
