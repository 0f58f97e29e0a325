"""Message decode, envelopes, routing and contract checks (FIXTURES.md §3, messages)."""

from pyspark.sql import functions as F

from eventpipe.functions.codec import b64encode
from eventpipe.operators import routing as R
from eventpipe.specs import registry_frame


def test_routing_outcomes(spark):
    rows = [
        ("1", '{"venue":"vega","url":"https://vega.dk/event/example"}'),
        ("2", '{"venue":"vega","url":'),
        ("3", '{"venue":"nowhere","url":"u"}'),
        ("4", '{"venue":"","url":"u"}'),
        ("5", '{"name":"vega","url":"u"}'),
        ("6", '{"venue":"vega","url":""}'),
        ("7", '{"venue":5}'),
        ("8", '{"venue":"vega"} tail'),
        ("9", '{"venue":"richter"}'),
    ]
    msgs = spark.createDataFrame(rows, "message_id string, body string")
    dec = R.decode_messages(msgs)
    routed = {r.message_id: r.outcome for r in R.route(dec, registry_frame(spark)).collect()}
    assert routed == {
        "1": "accepted", "2": "malformed", "3": "unknown_venue", "4": "unknown_venue", "5": "unknown_venue",
        "6": "accepted", "7": "malformed", "8": "malformed", "9": "accepted",
    }
    viol = sorted((r.message_id, r.field) for r in R.required_field_violations(dec).collect())
    assert ("4", "venue") in viol and ("5", "venue") in viol and ("6", "url") in viol and ("9", "url") in viol
    contract = {r.message_id: (r.missing_keys, r.extra_keys) for r in R.key_contract(msgs).collect()}
    assert contract["5"] == ("venue", "name")
    assert contract["7"] == ("url", "")
    assert "1" not in contract


def test_contract_of_published_bodies(spark):
    """Each body the fan-out publishes decodes to a registered venue (the reference's contract test)."""
    reg = registry_frame(spark)
    bodies = reg.select(F.col("venue").alias("message_id"), F.to_json(F.struct("venue")).alias("body"))
    dec = R.decode_messages(bodies, fields=R.SCRAPE_FIELDS)
    assert R.route(dec, reg).where(F.col("outcome") != "accepted").count() == 0
    assert reg.count() > 0


def test_envelope_round_trip(spark):
    payload = '{"check":"local-test-1"}'
    lines = spark.createDataFrame([(payload,)], "p string").select(
        F.to_json(F.struct(F.lit("fake-msg-1").alias("messageId"), F.lit("fake-lease-1").alias("receiptHandle"), b64encode(F.col("p")).alias("body"))).alias("line")
    )
    bad = spark.createDataFrame([('{"messageId":"m2","receiptHandle":"h2","body":"!!notbase64"}',)], "line string")
    got = {r.message_id: (r.receipt_handle, r.payload, r.b64_ok) for r in R.decode_envelopes(lines.unionByName(bad)).collect()}
    assert got["fake-msg-1"] == ("fake-lease-1", payload, True)
    assert got["m2"] == ("h2", None, False)


def test_long_body_base64_has_no_line_breaks(spark):
    df = spark.createDataFrame([("x" * 500,)], "t string")
    assert "\n" not in df.select(b64encode(F.col("t")).alias("b")).first().b


def test_publish_outcome(spark):
    attempts = spark.createDataFrame(
        [("r1", "vega", False), ("r1", "richter", True), ("r1", "jazz", True), ("r2", "vega", False), ("r2", "nobody", True)],
        "run_id string, venue string, failed boolean",
    )
    registry = spark.createDataFrame([("vega",), ("richter",), ("jazz",)], "venue string")
    got = {r.run_id: (r.status, r.failed, r.n_published) for r in R.publish_outcome(attempts, "run_id", "venue", "failed", registry).collect()}
    assert got == {"r1": ("partial failure", "jazz,richter", 3), "r2": ("ok", "", 1)}


ODD_BODIES = [
    '{"venue":"v","url":"u"}', '{"url":"u","venue":"v"}', '{"venue":"v"}', "{}", '{"venue":"","url":""}', '{"venue":"v","url":"u","more":"x"}',
    '{"venue":"v","venue":"w"}', '{"venue":"v","Venue":"w"}', '{"VENUE":"v"}', '{ "venue":"v"}', '{"venue":"v",}', '{"venue":"v"}x', '{"venue":"v"}\n', '{"venue":"v","url":null}',
    '{"venue":1}', '{"venue":"a\\u0041"}', '{"venue":"a\tb"}', '{"venue":"\u00e9","url":"\U0001f600"}', "", " ", "null", "[]", '"x"', '{"venue":"v","x":{}}', '{"venue":"v" ,"url":"u"}',
    None, '{"venue"', '{"venue":"v","url":"{,\\"venue\\":"}', '{"venue":"v","url":",venue:"}', '{"n":' + "9" * 5000 + ',"venue":"v"}', '{"venue":' + "9" * 5000 + "}",
]


def test_plain_bodies_are_read_as_the_strict_decoder_reads_them(spark):
    from eventpipe.functions.strict_json import decode_fields
    from eventpipe.operators import routing as R

    df = spark.createDataFrame(list(enumerate(ODD_BODIES)), "i int, body string")
    for fields in (R.EXTRACT_FIELDS, R.SCRAPE_FIELDS):
        want = [decode_fields(b, {f: "string" for f in fields}) for b in ODD_BODIES]
        got = {r.i: r for r in R.decode_messages(df, "body", fields).collect()}
        assert len(got) == len(ODD_BODIES)
        for i, w in enumerate(want):
            assert got[i].decode_ok == w["ok"], ODD_BODIES[i]
            assert [got[i][f] for f in fields] == [(w[f] or "") if w["ok"] else None for f in fields], ODD_BODIES[i]


def test_plain_bodies_stay_in_the_jvm(spark):
    """The plan is a union: the branch of plain bodies has no Python node."""
    from eventpipe.operators import routing as R

    plan = R.decode_messages(spark.createDataFrame([('{"venue":"v"}',)], "body string"))._jdf.queryExecution().executedPlan().toString()
    native, strict = plan.split("Union", 1)[1].split("ArrowEvalPython", 1)
    assert "regexp_extract(" in native and "ArrowEvalPython" not in native and "regexp_extract(" not in strict


def test_contract_names_unknown_venues(spark):
    from eventpipe.operators import routing as R

    df = spark.createDataFrame([("a", '{"venue":"v","url":"u"}'), ("b", '{"venue":"x","url":"u"}'), ("c", '{"name":"v"}'), ("d", "no")], "message_id string, body string")
    registry = spark.createDataFrame([("v", "https://v")], "venue string, base_url string")
    got = sorted(tuple(r) for r in R.contract_violations(df, registry).collect())
    assert got == [("b", "unknown_venue", "x"), ("c", "extra_keys", "name"), ("c", "missing_keys", "url,venue"), ("c", "unknown_venue", "")]

