"""Message decode (S3-S5), routing (P11, J1, J2), checks (P12, P13), dead letters (T5),
metrics (A4) and the fan-out outcome (A1).

A message ends in exactly one outcome: ``malformed`` (the body does not decode),
``unknown_venue`` (no registry entry) or ``accepted``. The registry is a small
dimension and is broadcast after a row-bound check; everything else is narrow, except the metric
aggregates, which combine map-side before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.codec import b64decode_text
from .joins import bounded_broadcast
from ..functions.strict_json import strict_decode

SCRAPE_FIELDS = ("venue",)
EXTRACT_FIELDS = ("venue", "url")
ENVELOPE_SCHEMA = "messageId string, receiptHandle string, body string"


#: A flat object of lower-case keys and strings without escapes, as the publishers write it.
PLAIN_RE = r'^\{(?:"[a-z]++":"[^"\\\x00-\x1f]*+"(?:,(?=")|(?=\})))*+\}\z'


def decode_messages(df: DataFrame, body_col: str = "body", fields=EXTRACT_FIELDS) -> DataFrame:
    """Adds ``decode_ok, decode_error`` and one string column per field ('' when absent, as the reference).

    A body of the plain form in which a field stands at most once is read by native
    expressions; the others (escapes, white space, other types, other cases, repeats,
    faults) go through the strict decoder, in a branch of their own.
    """
    body, once = F.col(body_col), F.lit(True)
    for f in fields:
        once = once & (F.regexp_count(body, F.lit(f'[{{,]"{f}":')) <= 1)
    plain = F.coalesce(body.rlike(PLAIN_RE) & once, F.lit(False))
    read = df.where(plain).withColumn("decode_ok", F.lit(True)).withColumn("decode_error", F.lit(None).cast("string"))
    for f in fields:
        read = read.withColumn(f, F.regexp_extract(body, f'[{{,]"{f}":"([^"]*+)"', 1))
    d = df.where(~plain).withColumn("_d", strict_decode(body, {f: "string" for f in fields}))
    d = d.withColumn("decode_ok", F.col("_d.ok")).withColumn("decode_error", F.col("_d.reason"))
    for f in fields:
        d = d.withColumn(f, F.when(F.col("decode_ok"), F.coalesce(F.col(f"_d.{f}"), F.lit(""))))
    return read.unionByName(d.drop("_d"))


def decode_envelopes(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Line JSON ``{messageId, receiptHandle, body(base64)}`` -> ``message_id, receipt_handle, payload, b64_ok``."""
    env = F.from_json(F.col(line_col), ENVELOPE_SCHEMA)
    out = lines.withColumn("_e", env).select(
        "*",
        F.col("_e.messageId").alias("message_id"),
        F.col("_e.receiptHandle").alias("receipt_handle"),
        b64decode_text(F.col("_e.body")).alias("payload"),
    )
    return out.withColumn("b64_ok", F.col("payload").isNotNull()).drop("_e")


def with_registry(decoded: DataFrame, registry: DataFrame) -> DataFrame:
    """Left join to the registry (broadcast after a row-bound check; a registry is one row per venue spec)."""
    reg = registry.select(F.col("venue").alias("_rv"), "base_url")
    return decoded.join(bounded_broadcast(reg), F.col("venue") == F.col("_rv"), "left").withColumn(
        "known_venue", F.col("_rv").isNotNull()
    ).drop("_rv")


def route(decoded: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``outcome``: ``malformed``, ``unknown_venue`` or ``accepted``."""
    r = with_registry(decoded, registry)
    outcome = (
        F.when(~F.col("decode_ok"), F.lit("malformed"))
        .when(~F.col("known_venue"), F.lit("unknown_venue"))
        .otherwise(F.lit("accepted"))
    )
    return r.withColumn("outcome", outcome)


def accepted_with_venue(decoded: DataFrame, registry: DataFrame) -> DataFrame:
    """Messages joined to their venue definition (inner, broadcast)."""
    return decoded.where(F.col("decode_ok")).join(bounded_broadcast(registry.select("venue", "base_url")), "venue")


def unknown_venues(decoded: DataFrame, registry: DataFrame) -> DataFrame:
    """Decoded messages whose venue has no registry entry (left anti, broadcast)."""
    return decoded.where(F.col("decode_ok")).join(bounded_broadcast(registry.select("venue")), "venue", "left_anti")


def required_field_violations(decoded: DataFrame, fields=EXTRACT_FIELDS, id_col: str = "message_id") -> DataFrame:
    """One row per decoded message and required field that is empty."""
    checks = F.array(*[F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f)) for f in fields])
    return (
        decoded.where(F.col("decode_ok"))
        .select(id_col, F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("field"))
    )


def key_contract(df: DataFrame, body_col: str = "body", expected=EXTRACT_FIELDS, id_col: str = "message_id") -> DataFrame:
    """Producer/consumer key drift: ``missing_keys`` and ``extra_keys`` per object body that differs."""
    want = F.array(*[F.lit(k) for k in expected])
    spelled = lambda keys: F.array_join(F.array_sort(keys), ",")

    def compared(keys):
        return F.struct(spelled(F.array_except(want, keys)).alias("missing_keys"), spelled(F.array_except(keys, want)).alias("extra_keys"))

    # behind a generator the body's keys are read once; as plain columns they would be copied into every use
    found = F.filter(F.array(F.json_object_keys(F.col(body_col))), lambda k: k.isNotNull())
    out = df.select(id_col, F.inline(F.transform(found, compared)))
    return out.where((F.col("missing_keys") != "") | (F.col("extra_keys") != ""))


def contract_violations(df: DataFrame, registry: DataFrame, body_col: str = "body", expected=EXTRACT_FIELDS, id_col: str = "message_id") -> DataFrame:
    """P13 as one table ``(id, violation, detail)``: bodies with missing or extra keys, and messages for a venue that the registry lacks."""
    drift = key_contract(df, body_col, expected, id_col)
    named = F.array(*[F.struct(F.lit(k).alias("violation"), F.col(k).alias("detail")) for k in ("missing_keys", "extra_keys")])
    keys = drift.select(id_col, F.inline(F.filter(named, lambda v: v["detail"] != "")))
    unknown = unknown_venues(decode_messages(df, body_col, expected), registry)
    return keys.unionByName(unknown.select(id_col, F.lit("unknown_venue").alias("violation"), F.col("venue").alias("detail")))


def message_errors(routed: DataFrame, id_col: str = "message_id") -> DataFrame:
    """Error rows (``stage, url, reason``) of messages that end without success; ``url`` names the message."""
    return routed.where(F.col("outcome") != "accepted").select(F.lit("decode").alias("stage"), F.col(id_col).alias("url"), F.col("outcome").alias("reason"))


def publish_errors(attempts: DataFrame, run_col: str, venue_col: str, failed_col: str) -> DataFrame:
    """Error rows of publishes that failed; ``url`` names the run and the venue."""
    return attempts.where(failed_col).select(F.lit("publish").alias("stage"), F.concat_ws("/", run_col, venue_col).alias("url"), F.lit("publish_failed").alias("reason"))


def dead_letters(routed: DataFrame, id_col: str = "message_id", body_col: str = "body") -> DataFrame:
    """Messages that can never succeed, kept with a reason instead of being dropped."""
    return routed.where(F.col("outcome") != "accepted").select(
        id_col, F.col("outcome").alias("reason"), F.col(body_col).alias("body")
    )


def run_metrics(routed: DataFrame, by=("venue", "outcome")) -> DataFrame:
    return routed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


OUTCOMES = ("accepted", "malformed", "unknown_venue")
OTHER_VENUES = ""  # what the registry lacks is counted together


def observed(routed: DataFrame, venues: list[str], observation: Observation) -> DataFrame:
    """A4 in the pass that writes: the frame with its counts per registered venue and outcome as observed metrics.

    The counts are there when an action has run through the frame; nothing is read a second time. They are as many
    numbers as venues times outcomes, and unknown and malformed messages are one venue, ``OTHER_VENUES``.
    """
    known = F.col("venue").isin(venues)
    counts = []
    for v in [*venues, OTHER_VENUES]:
        of = F.coalesce(known, F.lit(False)) & (F.col("venue") == v) if v else ~F.coalesce(known, F.lit(False))
        counts += [F.count_if(of & (F.col("outcome") == o)).alias(f"{v}/{o}") for o in OUTCOMES]
    return routed.observe(observation, *counts)


def observed_counts(observation: Observation) -> dict[tuple[str, str], int]:
    """``{(venue, outcome): n}`` of what has passed, without zeros; waits for the action."""
    return {tuple(k.rsplit("/", 1)): n for k, n in observation.get.items() if n}


def publish_outcome(attempts: DataFrame, run_col: str, venue_col: str, failed_col: str, registry: DataFrame) -> DataFrame:
    """Per run: ``ok`` or ``partial failure`` and the sorted failed venues; one failure never stops the rest.

    Only venues of the registry are published to, so other attempts do not count and
    ``collect_set`` holds at most one name per registered venue.
    """
    known = bounded_broadcast(registry.select(F.col("venue").alias(venue_col)))
    attempts = attempts.join(known, venue_col, "left_semi")
    failed = F.array_sort(F.collect_set(F.when(F.col(failed_col), F.col(venue_col))))
    return (
        attempts.groupBy(run_col)
        .agg(F.count(F.lit(1)).alias("n_published"), failed.alias("_failed"))
        .select(
            run_col,
            "n_published",
            F.when(F.size("_failed") > 0, F.lit("partial failure")).otherwise(F.lit("ok")).alias("status"),
            F.array_join("_failed", ",").alias("failed"),
        )
    )
