"""Store queries. Incoming: one document per part, keyed ``event-<partkey div 2>.json``, so
every key is put twice. Stored before: one document per supplier, about half of them
under keys that parts put too. Lists, gets and deletes read a stored table of all
documents, written once for each session and folder. Oracles compute the same from
``part`` and ``supplier``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store as ST
from ..session import state_path
from ..sources import derived
from ..sources.tables import spread, table
from . import params
from .extraction import PART_EVENTS_CTE, START_DATE_SQL, document_sql

BASE = params.OBJECT_BASE_URL
_WRITTEN: dict = {}


def _incoming(spark, sf):
    return derived.part_documents(table(spark, sf, "part"))


def _stored(spark, sf):
    return derived.supplier_documents(table(spark, sf, "supplier"))


def _ranges(spark, sf):
    """All documents of ``part`` (the first of each key), as a stored table of key ranges."""
    place = (spark.sparkContext.applicationId, sf)
    if place not in _WRITTEN:
        first = ST.first_wins(_incoming(spark, sf), order="p_partkey")
        rows = ST.object_rows(first, BASE, access="private", content_type="application/json")
        _WRITTEN[place] = ST.KeyRanges.write(rows, state_path(spark, "objects"))
    return _WRITTEN[place]


def _objects(spark, sf):
    return _ranges(spark, sf).read()


def put_if_absent(spark, sf):
    accepted = ST.accept_new(_stored(spark, sf), _incoming(spark, sf), order="p_partkey")
    return ST.object_rows(accepted, BASE).select("pathname", "p_partkey", "etag")


def put_rejected(spark, sf):
    incoming = derived.part_documents(spread(table(spark, sf, "part"), ["p_partkey"])).select("pathname", "p_partkey")
    rejected = ST.rejected_puts(_stored(spark, sf), incoming, order="p_partkey")
    return rejected.select("pathname", "p_partkey", "reason")


def put_overwrite(spark, sf):
    table_after = ST.put_overwrite(_stored(spark, sf).select("pathname", "body"), _incoming(spark, sf).select("pathname", "p_partkey", "body"), order="p_partkey")
    return ST.object_rows(table_after, BASE).select("pathname", "p_partkey", "etag")


def put_suffixed(spark, sf):
    inc = _incoming(spark, sf)
    return inc.select(ST.with_suffix(F.col("pathname"), F.col("p_partkey")).alias("pathname"), "p_partkey")


def put_metadata(spark, sf):
    """The extract stage's puts: private, JSON content type, no cache header."""
    accepted = ST.accept_new(_stored(spark, sf), _incoming(spark, sf), order="p_partkey")
    rows = ST.object_rows(accepted, BASE, access="private", content_type="application/json")
    return rows.select("pathname", "access", "content_type", "cache_control_max_age")


def object_metadata(spark, sf):
    return _objects(spark, sf).select("pathname", "url", "download_url", "content_type", "size", "etag")


def get_objects(spark, sf):
    """One get for each part key as a name: about half of them are stored."""
    wanted = table(spark, sf, "part").select(F.concat(F.lit("event-"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("pathname"))
    got = ST.get_objects(_objects(spark, sf).select("pathname", "body"), wanted)
    return got.select("pathname", "found", "body")


def list_objects(spark, sf):
    return _objects(spark, sf).select("pathname", "size", "uploaded_at", "etag")


def list_by_prefix(spark, sf):
    s = _objects(spark, sf)
    return s.where(F.col("pathname").startswith(params.LIST_PREFIX)).select("pathname", "size", "etag")


def list_page(spark, sf):
    return _ranges(spark, sf).page(limit=params.LIST_LIMIT).select("pathname", "has_more", "next_cursor")


def list_next_page(spark, sf):
    page = _ranges(spark, sf).page(limit=params.LIST_LIMIT, cursor=params.LIST_CURSOR)
    return page.select("pathname", "has_more", "next_cursor")


def list_prefix_page(spark, sf):
    """A page within a prefix, from its middle."""
    page = _ranges(spark, sf).page(params.LIST_PREFIX, params.LIST_LIMIT, params.LIST_PREFIX + "3")
    return page.select("pathname", "has_more", "next_cursor")


def delete_objects(spark, sf):
    """Delete by name (one key per supplier) and by URL (one per customer); some are not stored."""
    name = lambda key, step: F.concat(F.lit("event-"), (F.col(key) * step).cast("string"), F.lit(".json"))
    by_name = table(spark, sf, "supplier").select(name("s_suppkey", 20).alias("key"))
    by_url = table(spark, sf, "customer").select(F.concat(F.lit(BASE), name("c_custkey", 3)).alias("key"))
    remaining = ST.delete_keys(_objects(spark, sf), by_name.unionByName(by_url), BASE)
    return remaining.select("pathname", "etag")


def _responses(spark, sf):
    """List responses of the provider's shape, 100 part keys per page (bounded groups).

    The parts of a page meet while they are short: a task writes the documents of its own pages only.
    """
    part = table(spark, sf, "part").withColumn("page", (F.col("p_partkey") / 100).cast("long"))
    rows = ST.object_rows(derived.part_documents(spread(part, ["page"]), keep=("page",)), BASE)
    blob = F.struct(
        F.col("url"), F.col("download_url").alias("downloadUrl"), F.col("pathname"), F.col("size"),
        F.col("uploaded_at").alias("uploadedAt"), F.col("etag"),
    )
    grouped = rows.groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct(F.col("p_partkey"), blob.alias("b")))).alias("items"),
        F.max("pathname").alias("cursor"),
    )
    body = F.to_json(F.struct(F.transform("items", lambda x: x["b"]).alias("blobs"), F.col("cursor"), F.lit(True).alias("hasMore")))
    return grouped.select(body.alias("response"))


def listing_explode(spark, sf):
    return ST.explode_listing(_responses(spark, sf)).select("pathname", "size", "uploaded_at", "uploaded_ms", "etag")


QUERIES = {
    "put_if_absent": put_if_absent,
    "put_rejected": put_rejected,
    "put_overwrite": put_overwrite,
    "put_suffixed": put_suffixed,
    "put_metadata": put_metadata,
    "object_metadata": object_metadata,
    "get_objects": get_objects,
    "list_objects": list_objects,
    "list_by_prefix": list_by_prefix,
    "list_page": list_page,
    "list_next_page": list_next_page,
    "list_prefix_page": list_prefix_page,
    "delete_objects": delete_objects,
    "listing_explode": listing_explode,
}

# ---------------------------------------------------------------- oracle SQL (DuckDB)

_UPLOADED = (
    "CASE WHEN p_size % 17 = 0 THEN 'not-a-time' ELSE "
    "concat(strftime(TIMESTAMP '2024-04-05 19:12:36' + to_minutes(p_partkey), '%Y-%m-%dT%H:%M:%S'), '.679Z') END"
)

STORE_CTE = f"""{PART_EVENTS_CTE},
docs AS (
  SELECT p_partkey, p_size, 'event-' || CAST(p_partkey // 2 AS VARCHAR) || '.json' AS pathname,
         {document_sql('title', START_DATE_SQL, 'url', 'price')} AS body, {_UPLOADED} AS uploaded_at
  FROM part_events
),
stored AS (
  SELECT 'event-' || CAST(s_suppkey * 20 AS VARCHAR) || '.json' AS pathname,
         {document_sql('s_name', f"'{derived.SUPPLIER_START}'", "concat('https://supplier.example.com/', CAST(s_suppkey AS VARCHAR))", 'CAST(trunc(s_acctbal) AS BIGINT)')} AS body
  FROM supplier
),
winners AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pathname ORDER BY p_partkey) AS rn FROM docs) WHERE rn = 1
),
objects AS (
  SELECT *, '{BASE}' || pathname AS url, '{BASE}' || pathname || '?download=1' AS download_url,
         'application/json' AS content_type, CAST(octet_length(encode(body)) AS BIGINT) AS size, md5(body) AS etag
  FROM winners
)"""


def _with(body: str) -> str:
    return f"WITH {STORE_CTE}\n{body}"


def _page(cursor: str, prefix: str = "") -> str:
    where = f"WHERE pathname > '{cursor}' AND starts_with(pathname, '{prefix}')"
    n = params.LIST_LIMIT
    return _with(
        f"SELECT pathname, has_more, CASE WHEN has_more THEN max(pathname) OVER () ELSE '' END AS next_cursor FROM ("
        f"SELECT pathname, (SELECT count(*) FROM objects {where}) > {n} AS has_more FROM objects {where} ORDER BY pathname LIMIT {n})"
    )


ORACLES = {
    "put_if_absent": _with("SELECT pathname, p_partkey, md5(body) AS etag FROM winners WHERE pathname NOT IN (SELECT pathname FROM stored)"),
    "put_rejected": _with(
        "SELECT d.pathname, d.p_partkey, CASE WHEN d.pathname IN (SELECT pathname FROM stored) THEN 'exists' ELSE 'duplicate_in_batch' END AS reason "
        "FROM docs d JOIN winners w ON d.pathname = w.pathname "
        "WHERE d.pathname IN (SELECT pathname FROM stored) OR d.p_partkey <> w.p_partkey"
    ),
    "put_overwrite": _with(
        "SELECT pathname, p_partkey, md5(body) AS etag FROM ("
        "SELECT *, row_number() OVER (PARTITION BY pathname ORDER BY p_partkey DESC) AS r FROM docs) WHERE r = 1 "
        "UNION ALL SELECT pathname, NULL, md5(body) FROM stored WHERE pathname NOT IN (SELECT pathname FROM docs)"
    ),
    "put_suffixed": _with(
        "SELECT concat(regexp_extract(pathname, '^(.*?)(\\.[^./]*)?$', 1), '-', "
        "substring(sha256(concat(pathname, '#', CAST(p_partkey AS VARCHAR))), 1, 16), "
        "regexp_extract(pathname, '^(.*?)(\\.[^./]*)?$', 2)) AS pathname, p_partkey FROM docs"
    ),
    "put_metadata": _with(
        "SELECT pathname, 'private' AS access, 'application/json' AS content_type, CAST(NULL AS INTEGER) AS cache_control_max_age "
        "FROM winners WHERE pathname NOT IN (SELECT pathname FROM stored)"
    ),
    "object_metadata": _with("SELECT pathname, url, download_url, content_type, size, etag FROM objects"),
    "get_objects": _with(
        "SELECT w.pathname, s.body IS NOT NULL AS found, s.body FROM (SELECT DISTINCT 'event-' || CAST(p_partkey AS VARCHAR) || '.json' AS pathname FROM part) w "
        "LEFT JOIN objects s ON w.pathname = s.pathname"
    ),
    "list_objects": _with("SELECT pathname, size, uploaded_at, etag FROM objects"),
    "list_by_prefix": _with(f"SELECT pathname, size, etag FROM objects WHERE starts_with(pathname, '{params.LIST_PREFIX}')"),
    "list_page": _page(""),
    "list_next_page": _page(params.LIST_CURSOR),
    "list_prefix_page": _page(params.LIST_PREFIX + "3", params.LIST_PREFIX),
    "delete_objects": _with(
        "SELECT pathname, etag FROM objects WHERE pathname NOT IN (SELECT pathname FROM stored) "
        "AND pathname NOT IN (SELECT 'event-' || CAST(c_custkey * 3 AS VARCHAR) || '.json' FROM customer)"
    ),
    "listing_explode": _with(
        "SELECT pathname, CAST(octet_length(encode(body)) AS BIGINT) AS size, uploaded_at, "
        "CASE WHEN uploaded_at = 'not-a-time' THEN NULL ELSE epoch_ms(CAST(uploaded_at AS TIMESTAMPTZ)) END AS uploaded_ms, "
        "md5(body) AS etag FROM docs"
    ),
}
