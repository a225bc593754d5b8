"""Rule by rule: one change to a valid event, and what it must be told."""

import copy
import json

import pytest

from eventloom.model import Limits
from eventloom.operators import parsing, validation

GOOD = {
    "schemaVersion": "1.0.0",
    "eventId": "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11",
    "type": "track",
    "occurredAt": "2024-02-29T10:00:00.000Z",
    "name": "cart.item_added",
    "source": {"appId": "shop", "platform": "web", "env": "prod"},
    "actor": {"userId": "u1"},
}


def event(**changes):
    made = copy.deepcopy(GOOD)
    for path, value in changes.items():
        target, keys = made, path.split("__")
        for key in keys[:-1]:
            target = target.setdefault(key, {})
        if value is KeyError:
            target.pop(keys[-1], None)
        else:
            target[keys[-1]] = value
    return made


def nested(levels):
    value = 1
    for level in range(levels):
        value = {f"k{level}": value}
    return value


CONSENT = {"analytics": True, "experimentation": False, "personalization": True,
           "timestamp": "2024-01-01T00:00:00Z"}
DEPTH = "Properties must not exceed depth of 3"

# (event, [(path below the event, code)])
CASES = {
    "valid": (event(), []),
    "version": (event(schemaVersion="2.0.0"), [("schemaVersion", "invalid_literal")]),
    "version_number": (event(schemaVersion=1), [("schemaVersion", "invalid_literal")]),
    "id_missing": (event(eventId=KeyError), [("eventId", "invalid_type")]),
    "id_bad": (event(eventId="123"), [("eventId", "invalid_string")]),
    "id_line_end": (event(eventId=GOOD["eventId"] + "\n"), [("eventId", "invalid_string")]),
    "id_upper": (event(eventId=GOOD["eventId"].upper()), []),
    "type_unknown": (event(type="click", eventId="x"), [("type", "invalid_union_discriminator")]),
    "type_missing": (event(type=KeyError), [("type", "invalid_union_discriminator")]),
    "time_offset": (event(occurredAt="2024-01-01T00:00:00+01:00"),
                    [("occurredAt", "invalid_string")]),
    "time_date": (event(occurredAt="2024-01-01"), [("occurredAt", "invalid_string")]),
    "time_no_day": (event(occurredAt="2023-02-29T00:00:00Z"), [("occurredAt", "invalid_string")]),
    "time_hour": (event(occurredAt="2024-01-01T24:00:00Z"), [("occurredAt", "invalid_string")]),
    "time_nanos": (event(occurredAt="2024-01-01T00:00:00.123456789Z"), []),
    "time_line_end": (event(occurredAt="2024-01-01T00:00:00Z\n"), [("occurredAt", "invalid_string")]),
    "name_line_end": (event(name="cart.item\n"), [("name", "invalid_string")]),
    "name_upper": (event(name="Cart"), [("name", "invalid_string")]),
    "name_dot": (event(name="cart."), [("name", "invalid_string")]),
    "name_missing": (event(name=KeyError), [("name", "invalid_type")]),
    "source_missing": (event(source=KeyError), [("source", "invalid_type")]),
    "source_text": (event(source="web"), [("source", "invalid_type")]),
    "app_empty": (event(source__appId=""), [("source.appId", "too_small")]),
    "app_255": (event(source__appId="a" * 255), []),
    "app_256": (event(source__appId="a" * 256), [("source.appId", "too_big")]),
    "app_surrogates": (event(source__appId="\U0001f600" * 128), [("source.appId", "too_big")]),
    "platform": (event(source__platform="tv"), [("source.platform", "invalid_enum_value")]),
    "env_missing": (event(source__env=KeyError), [("source.env", "invalid_type")]),
    "version_null": (event(source__appVersion=None), [("source.appVersion", "invalid_type")]),
    "actor_empty": (event(actor={}), [("actor", "custom")]),
    "actor_blank": (event(actor={"userId": "", "sessionId": "s"}), [("actor", "custom")]),
    "actor_number": (event(actor={"userId": 5}), [("actor.userId", "invalid_type")]),
    "actor_long_blank": (event(actor={"userId": "", "sessionId": "s" * 256}),
                         [("actor.sessionId", "too_big"), ("actor", "custom")]),
    "context_null": (event(context=None), [("context", "invalid_type")]),
    "context_extra": (event(context={"anything": {"Deep": [[1]]}, "locale": "l" * 50}), []),
    "locale_51": (event(context={"locale": "l" * 51}), [("context.locale", "too_big")]),
    "page_url": (event(context={"page": {"url": "u" * 2049}}), [("context.page.url", "too_big")]),
    "page_text": (event(context={"page": "x"}), [("context.page", "invalid_type")]),
    "device_list": (event(context={"device": []}), [("context.device", "invalid_type")]),
    "consent": (event(consent=CONSENT), []),
    "consent_text": (event(consent={**CONSENT, "analytics": "true"}),
                     [("consent.analytics", "invalid_type")]),
    "consent_number": (event(consent={**CONSENT, "analytics": 1}),
                       [("consent.analytics", "invalid_type")]),
    "consent_time": (event(consent={**CONSENT, "timestamp": "now"}),
                     [("consent.timestamp", "invalid_string")]),
    "key_underscore": (event(properties={"_x": 1}), [("properties", "custom")]),
    "key_in_array": (event(properties={"a": [{"Bad": 1}]}), [("properties", "custom")]),
    "depth_3": (event(properties=nested(3)), []),
    "depth_4": (event(properties=nested(4)), [("properties", "custom")]),
    "depth_4_empty": (event(properties={"a": {"b": {"c": {}}}}), []),
    "depth_array": (event(properties={"a": [[[1]]]}), [("properties", "custom")]),
    "depth_array_ok": (event(properties={"a": [[1]]}), []),
    "keys_50": (event(properties={f"k{i}": i for i in range(50)}), []),
    "keys_51": (event(properties={f"k{i}": i for i in range(51)}), [("properties", "custom")]),
    "array_100": (event(properties={"a": [1] * 100}), []),
    "array_101": (event(properties={"a": [1] * 101}), [("properties", "custom")]),
    "text_2048": (event(properties={"a": "x" * 2048}), []),
    "text_2049": (event(properties={"a": "x" * 2049}), [("properties", "custom")]),
    "text_escapes": (event(properties={"a": "\\\"\n\u0001" * 512}), []),
    "text_escapes_over": (event(properties={"a": "\\\"\n\u0001" * 512 + "x"}),
                          [("properties", "custom")]),
    "long_key": (event(properties={"k" * 3000: 1}), []),
    "deep_long_text": (event(properties={"a": {"b": {"c": {"d": ["x" * 3000]}}}}),
                       [("properties", "custom"), ("properties", "custom")]),
    "properties_list": (event(properties=[1]), [("properties", "invalid_type")]),
    "identify": (event(type="identify", name="Not Checked", properties={"_x": 1}), []),
    "identify_traits": (event(type="identify", traits={"Bad": 1}), [("traits", "custom")]),
    "track_traits_ignored": (event(traits={"Bad": 1}), []),
    "several": (event(schemaVersion="9", actor={}, name="X"),
                [("schemaVersion", "invalid_literal"), ("actor", "custom"),
                 ("name", "invalid_string")]),
    "not_an_object": (17, [("", "invalid_type")]),
}

ENVELOPES = {
    "ok": ({"schemaVersion": "1.0.0", "events": [GOOD]}, []),
    "sent": ({"schemaVersion": "1.0.0", "sentAt": "2024-01-01T00:00:00Z", "events": [GOOD]}, []),
    "sent_bad": ({"schemaVersion": "1.0.0", "sentAt": "soon", "events": [GOOD]},
                 [("sentAt", "invalid_string")]),
    "version": ({"schemaVersion": "3", "events": [GOOD]}, [("schemaVersion", "invalid_literal")]),
    "none": ({"schemaVersion": "1.0.0", "events": []}, [("events", "too_small")]),
    "missing": ({"schemaVersion": "1.0.0"}, [("events", "invalid_type")]),
    "hundred": ({"schemaVersion": "1.0.0", "events": [GOOD] * 100}, []),
    "many": ({"schemaVersion": "1.0.0", "events": [GOOD] * 101}, [("events", "too_big")]),
    "list": ([GOOD], [("schemaVersion", "invalid_literal"), ("events", "invalid_type")]),
}


def check(spark, bodies, limits=None):
    df = spark.createDataFrame([(k, v) for k, v in bodies.items()], "batch_id string, body string")
    opened = parsing.open_envelopes(parsing.parse_bodies(df))
    return validation.validate_batches(opened, limits)


@pytest.fixture(scope="module")
def found(spark):
    bodies = {k: json.dumps({"schemaVersion": "1.0.0", "events": [GOOD, e]}, ensure_ascii=False)
              for k, (e, _) in CASES.items()}
    bodies |= {f"envelope:{k}": json.dumps(body) for k, (body, _) in ENVELOPES.items()}
    rows = validation.validation_issues(check(spark, bodies)).orderBy("issue_index").collect()
    issues = {k: [] for k in bodies}
    for row in rows:
        issues[row.batch_id].append(row)
    return issues


@pytest.mark.parametrize("case", CASES)
def test_event_rule(found, case):
    got = [(i.path, i.code) for i in found[case]]
    want = [("events.1" + (f".{path}" if path else ""), code) for path, code in CASES[case][1]]
    assert got == want
    assert all(i.event_index == 1 for i in found[case])


@pytest.mark.parametrize("case", ENVELOPES)
def test_envelope_rule(found, case):
    assert [(i.path, i.code) for i in found[f"envelope:{case}"]] == ENVELOPES[case][1]


def test_messages(found):
    assert found["depth_4"][0].message == DEPTH
    assert found["consent_number"][0].message == "Expected boolean, received number"
    assert found["version_null"][0].message == "Expected string, received null"
    assert found["properties_list"][0].message == "Expected object, received array"
    assert found["id_missing"][0].message == "Required"


def test_rejects_without_envelope(spark):
    df = spark.createDataFrame(
        [("a", None), ("b", ""), ("c", "{"), ("d", '{"a":1,}'), ("e", "{}")],
        "batch_id string, body string")
    got = {r.batch_id: r.reject for r in parsing.parse_bodies(df).collect()}
    assert got == {"a": parsing.MISSING_BODY, "b": parsing.MISSING_BODY,
                   "c": parsing.INVALID_JSON, "d": parsing.INVALID_JSON, "e": None}


def test_payload_size_counts_the_stripped_envelope(spark):
    padded = {"schemaVersion": "1.0.0", "events": [event(junk="j" * 5000)]}
    full = {"schemaVersion": "1.0.0", "events": [event(context={"kept": "j" * 5000})]}
    bodies = {"stripped": json.dumps(padded), "kept": json.dumps(full)}
    checked = check(spark, bodies, Limits(max_payload=2048))
    got = {r.batch_id: r.rule for r in validation.validation_issues(checked).collect()}
    assert got == {"kept": "payload_size"}


def test_payload_size_is_exact(spark):
    body = {"schemaVersion": "1.0.0", "events": [event(context={"pad": "é" * 3000})]}
    text = json.dumps(body, ensure_ascii=False, separators=(",", ":"))
    bodies = {"b": json.dumps(body, ensure_ascii=False)}
    for limit, over in ((len(text), False), (len(text) - 1, True)):
        checked = check(spark, bodies, Limits(max_payload=limit))
        assert bool(checked.select("issues").first().issues) is over


def test_gate_rejects_the_whole_batch(spark):
    body = json.dumps({"schemaVersion": "1.0.0", "events": [GOOD, event(name="X"), GOOD]})
    checked = check(spark, {"b": body})
    row = validation.gate_batches(checked).first()
    assert (row.accepted, row.failed, row.error_event_id) == (False, 3, "batch")
    assert row.error.startswith("Validation failed: Event name must be")
    assert validation.accepted_events(checked).count() == 0


def test_normalised_event(spark):
    sent = [
        event(actor={"userId": "u", "sessionId": "s1"}),
        event(actor={"userId": "u", "sessionId": "s1"}, context={"sessionId": "", "x": 1}),
        event(actor={"userId": "u", "sessionId": "s1"}, context={"sessionId": "s2"}),
        event(extra=1, context={"page": {"url": "/", "other": 2}, "own": {"A": [1]}}),
    ]
    body = json.dumps({"schemaVersion": "1.0.0", "events": sent})
    rows = validation.accepted_events(check(spark, {"b": body})).orderBy("event_index").collect()
    assert [(r.session_id, r.actor_session_id) for r in rows] == [
        ("s1", None), ("s1", None), ("s2", "s1"), (None, None)]
    assert json.loads(rows[0].context) == {"sessionId": "s1"}
    assert json.loads(rows[1].context) == {"sessionId": "s1", "x": 1}
    assert json.loads(rows[3].context) == {"page": {"url": "/"}, "own": {"A": [1]}}


def test_limits_are_capped():
    with pytest.raises(ValueError):
        Limits(max_events=101)
    with pytest.raises(ValueError):
        Limits(max_depth=0)


def test_lower_limits_apply(spark):
    body = json.dumps({"schemaVersion": "1.0.0", "events": [event(properties=nested(2))]})
    checked = check(spark, {"b": body}, Limits(max_depth=1))
    assert checked.select("issues").first().issues[0].message == \
        "Properties must not exceed depth of 1"
