"""The event store as DataFrame operations.

A stored object is a row ``pathname, url, download_url, access, content_type,
cache_control_max_age, size, uploaded_at, etag, body``. Every write is keyed on
``pathname``:

* put-if-absent: first write wins inside the batch (``min_by``, a partial
  aggregate, so a name written a million times is reduced map-side), then a
  ``left_anti`` against the stored keys; the losers come back with a reason.
* overwrite: the newest incoming row per key replaces the stored one.
* suffix: a suffix from a hash of the key and the writer's row key, so a retried
  task writes the same name.

Joins are shuffles on the full pathname; AQE splits a skewed key and turns a
small side into a broadcast at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir

DEFAULT_ACCESS = "public"  # fixed value: the reference's default visibility
DEFAULT_LIST_LIMIT = 1000
SUFFIX_LENGTH = 16
CONTENT_TYPES = {".json": "application/json", ".html": "text/html", ".txt": "text/plain", ".xml": "application/xml", ".csv": "text/csv"}


def _located(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _located(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _located(spark, path)
    return fs.getFileStatus(p).isDirectory()


def key_bucket(key_col: str, buckets: int):
    """Bucket of a key: ``pmod(xxhash64(key), buckets)`` (stable across runs and engines' retries)."""
    return F.pmod(F.xxhash64(F.col(key_col)), F.lit(buckets)).cast("int")


def store_buckets(n_bytes: int, bucket_bytes: int = 64 << 20) -> int:
    """Buckets for a store that is to hold ``n_bytes``: the least power of two whose buckets hold ``bucket_bytes`` each."""
    return 1 << (max(1, -(-n_bytes // bucket_bytes)) - 1).bit_length()


def inferred_content_type(pathname: Column) -> Column:
    """Content type from the extension, as a store infers it when none is given."""
    ext = F.lower(F.regexp_extract(pathname, r"(\.[^./]*)$", 1))
    out = F.lit("application/octet-stream")
    for e, t in reversed(list(CONTENT_TYPES.items())):
        out = F.when(ext == e, F.lit(t)).otherwise(out)
    return out


def with_suffix(pathname: Column, row_key: Column, length: int = SUFFIX_LENGTH, token: str | None = None) -> Column:
    """``name.json`` -> ``name-<hash>.json``; the hash covers the name, the writer's row key and the write token.

    A retried task or put writes the same name; two puts (two tokens) never share one.
    """
    parts = [pathname, row_key.cast("string")] + ([F.lit(token)] if token else [])
    digest = F.substring(F.sha2(F.concat_ws("#", *parts), 256), 1, length)
    stem = F.regexp_extract(pathname, r"^(.*?)(\.[^./]*)?$", 1)
    ext = F.regexp_extract(pathname, r"^(.*?)(\.[^./]*)?$", 2)
    return F.concat(stem, F.lit("-"), digest, ext)


def object_rows(
    docs: DataFrame,
    base_url: str,
    access: str = DEFAULT_ACCESS,
    content_type: str | None = None,
    cache_max_age: int = 0,
) -> DataFrame:
    """Adds the object metadata a put returns (K6, K7, K9): url, download URL, size, etag, options."""
    url = F.concat(F.lit(base_url), F.col("pathname"))
    ctype = F.lit(content_type) if content_type else inferred_content_type(F.col("pathname"))
    return (
        docs.withColumn("url", url)
        .withColumn("download_url", F.concat(url, F.lit("?download=1")))
        .withColumn("access", F.lit(access))
        .withColumn("content_type", ctype)
        .withColumn("cache_control_max_age", F.when(F.lit(cache_max_age) > 0, F.lit(cache_max_age)).cast("int"))
        .withColumn("size", F.octet_length("body").cast("long"))
        .withColumn("etag", F.md5(F.col("body")))
    )


def first_wins(incoming: DataFrame, order: str, key: str = "pathname") -> DataFrame:
    """One row per key: the earliest by ``order`` (ties are not allowed: ``order`` is a row key)."""
    other = [c for c in incoming.columns if c != key]
    win = F.min_by(F.struct(*[F.col(c) for c in other]), F.col(order)).alias("_w")
    return incoming.groupBy(key).agg(win).select(key, "_w.*")


def last_wins(incoming: DataFrame, order: str, key: str = "pathname") -> DataFrame:
    other = [c for c in incoming.columns if c != key]
    win = F.max_by(F.struct(*[F.col(c) for c in other]), F.col(order)).alias("_w")
    return incoming.groupBy(key).agg(win).select(key, "_w.*")


def not_stored(rows: DataFrame, stored: DataFrame, key: str = "pathname") -> DataFrame:
    """The rows whose key is not stored."""
    return rows.join(stored.select(key).distinct(), key, "left_anti")


def accept_new(stored: DataFrame, incoming: DataFrame, order: str, key: str = "pathname") -> DataFrame:
    """The incoming rows that a put-if-absent writes: the first row of each key that is not stored."""
    return not_stored(first_wins(incoming, order, key), stored, key)


def rejected_puts(stored: DataFrame, incoming: DataFrame, order: str, key: str = "pathname") -> DataFrame:
    """The incoming rows that a put-if-absent does not write, with ``reason``.

    One narrow row per key (its first row's order, and whether the key is stored) is
    checkpointed first, so the rows meet it in a plain join of two shuffles, which AQE
    splits where one key holds many of the rows.
    """
    ensure_checkpoint_dir(incoming.sparkSession)
    first = incoming.groupBy(key).agg(F.min(order).alias("_win"))
    known = stored.select(key).distinct().withColumn("_exists", F.lit(True))
    verdict = first.join(known, key, "left").checkpoint()
    lost = F.col("_exists").isNotNull() | (F.col(order) != F.col("_win"))
    reason = F.when(F.col("_exists").isNotNull(), F.lit("exists")).otherwise(F.lit("duplicate_in_batch"))
    return incoming.join(verdict, key).where(lost).withColumn("reason", reason).drop("_exists", "_win")


def put_if_absent(stored: DataFrame, incoming: DataFrame, order: str, key: str = "pathname") -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: new keys are written once; existing keys are never replaced.

    ``rejected`` has every incoming row that was not written, with ``reason``
    ``exists`` (the key is stored) or ``duplicate_in_batch`` (an earlier row of
    the batch took the key).
    """
    return accept_new(stored, incoming, order, key), rejected_puts(stored, incoming, order, key)


def write_sorted(objects: DataFrame, path: str, key: str = "pathname") -> DataFrame:
    """Write objects as files that each hold one sorted range of keys, and read them back.

    Prefix and cursor filters on the result reach the Parquet scan, where the files'
    and row groups' bounds skip what lies outside.
    """
    objects.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(path)
    return objects.sparkSession.read.schema(objects.schema).parquet(path)


class KeyRanges:
    """Objects in files of one sorted key range each, with an index of the files' bounds beside them.

    A page opens the files that can hold its keys and no other, wherever in the store it
    begins: the index (one row a file, in ``_ranges`` below the objects, which scans skip)
    gives the files after the cursor in key order until they hold a page and one row more.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "pathname"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    @classmethod
    def write(cls, objects: DataFrame, path: str, key: str = "pathname") -> KeyRanges:
        out = cls(objects.sparkSession, path, objects.schema, key)
        written = write_sorted(objects, out.path, key)
        bounds = written.where(F.col(key).isNotNull()).groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")
        )
        bounds.write.parquet(f"{out.path}/_ranges")
        return out

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def files(self, prefix: str = "", limit: int = 0, cursor: str = "", default_limit: int = DEFAULT_LIST_LIMIT) -> list[str]:
        """The files of one page, in key order.

        At most as many index rows as a page has keys come to the driver, and two more: every file holds
        a key, and only the first and the last may lie partly outside the page.
        """
        n = limit if limit > 0 else default_limit
        bounds = self.spark.read.schema("file string, lo string, hi string, n long").parquet(f"{self.path}/_ranges")
        if cursor:
            bounds = bounds.where(F.col("hi") > F.lit(cursor))
        if prefix:
            bounds = bounds.where((F.col("hi") >= F.lit(prefix)) & ((F.col("lo") <= F.lit(prefix)) | F.col("lo").startswith(prefix)))
        out, held = [], 0
        for k, r in enumerate(bounds.orderBy("lo", "hi").limit(n + 2).collect()):
            out.append(f"{self.path}/{r['file']}")
            held += r["n"] if k or not (cursor or prefix) else 0  # of the first file it is not known how much lies after the cursor
            if held > n:
                break
        return out

    def page(self, prefix: str = "", limit: int = 0, cursor: str = "", default_limit: int = DEFAULT_LIST_LIMIT) -> DataFrame:
        """``list_objects`` over the page's own files."""
        files = self.files(prefix, limit, cursor, default_limit)
        found = self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)
        return list_objects(found, prefix, limit, cursor, default_limit, self.key)


def put_overwrite(stored: DataFrame, incoming: DataFrame, order: str, key: str = "pathname") -> DataFrame:
    """The table after an overwrite put: the newest incoming row per key, else the stored row."""
    latest = last_wins(incoming, order, key)
    kept = stored.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def get_objects(stored: DataFrame, pathnames: DataFrame, key: str = "pathname") -> DataFrame:
    """Many gets as one join: every requested key, with ``found`` and the stored body."""
    return pathnames.select(key).distinct().join(stored, key, "left").withColumn("found", F.col("body").isNotNull())


def list_objects(stored: DataFrame, prefix: str = "", limit: int = 0, cursor: str = "", default_limit: int = DEFAULT_LIST_LIMIT, key: str = "pathname") -> DataFrame:
    """One listing page ordered by key: prefix filter (pushed to the scan), keyset cursor, limit.

    Fetches ``limit + 1`` rows (``TakeOrderedAndProject``, a bounded top-k), so
    ``has_more`` and ``next_cursor`` need no second pass. Zero limit means the
    default page size.
    """
    n = limit if limit > 0 else default_limit
    page = stored
    if prefix:
        page = page.where(F.col(key).startswith(prefix))
    if cursor:
        page = page.where(F.col(key) > F.lit(cursor))
    top = page.orderBy(key).limit(n + 1)
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = top.withColumn("_rank", F.row_number().over(Window.orderBy(key)))
    ranked = ranked.withColumn("has_more", F.max("_rank").over(w) > n)
    ranked = ranked.where(F.col("_rank") <= n)
    ranked = ranked.withColumn("next_cursor", F.when(F.col("has_more"), F.max(key).over(w)).otherwise(F.lit("")))
    return ranked.drop("_rank")


def delete_keys(stored: DataFrame, keys: DataFrame, base_url: str, key_col: str = "key", key: str = "pathname") -> DataFrame:
    """The table after deleting by pathname or URL; an empty key list changes nothing.

    A URL key is compared with the stored ``url`` and, under the current base URL, as
    a pathname: two equi ``left_anti`` joins rather than an OR condition (which would
    be a nested loop).
    """
    k = F.col(key_col)
    as_path = F.when(k.startswith(base_url), F.substring(k, len(base_url) + 1, 1 << 30)).otherwise(k)
    left = stored.join(keys.select(as_path.alias(key)).distinct(), key, "left_anti")
    return left.join(keys.select(k.alias("url")).distinct(), "url", "left_anti").select(*stored.columns) if "url" in stored.columns else left


LIST_RESPONSE_SCHEMA = (
    "blobs array<struct<url: string, downloadUrl: string, pathname: string, size: bigint, uploadedAt: string, etag: string>>, "
    "cursor string, hasMore boolean"
)


def explode_listing(responses: DataFrame, col: str = "response") -> DataFrame:
    """List responses -> one row per object; an unparsable ``uploadedAt`` gives a null instant.

    An empty page gives no object. A response that is not JSON gives one row without an
    object and with ``reason`` = ``malformed``, and ends no job: a caller that takes the
    listing for the whole store checks that no row has a reason (``listing_errors``).
    """
    schema = LIST_RESPONSE_SCHEMA + ", _corrupt string"
    r = responses.withColumn("_r", F.from_json(F.col(col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    none = F.array(F.lit(None).cast("struct<url: string, downloadUrl: string, pathname: string, size: bigint, uploadedAt: string, etag: string>"))
    ex = r.select(
        F.col("_r.cursor").alias("cursor"), F.col("_r.hasMore").alias("has_more"), F.when(bad, F.lit("malformed")).alias("reason"),
        F.explode(F.when(bad, none).otherwise(F.col("_r.blobs"))).alias("b"),
    )
    rfc = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    ts = F.when(F.col("b.uploadedAt").rlike(rfc), F.try_to_timestamp(F.col("b.uploadedAt")))
    return ex.select(
        F.col("b.pathname").alias("pathname"),
        F.col("b.url").alias("url"),
        F.col("b.downloadUrl").alias("download_url"),
        F.col("b.size").alias("size"),
        F.col("b.uploadedAt").alias("uploaded_at"),
        F.unix_millis(ts).alias("uploaded_ms"),
        F.col("b.etag").alias("etag"),
        "cursor",
        "has_more",
        "reason",
    )


def listing_errors(responses: DataFrame, id_col: str, col: str = "response") -> DataFrame:
    """Error rows (``stage, url, reason``) of list responses that cannot be read."""
    found = responses.select(F.col(id_col).cast("string").alias("url"), F.from_json(F.col(col), LIST_RESPONSE_SCHEMA + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return found.where(F.col("r").isNull() | F.col("r._corrupt").isNotNull()).select(F.lit("listing").alias("stage"), "url", F.lit("malformed").alias("reason"))


def put_errors(rejected: DataFrame, key: str = "pathname") -> DataFrame:
    """Error rows of puts that were not written."""
    return rejected.select(F.lit("store").alias("stage"), F.col(key).alias("url"), "reason")
