"""Cursors, redaction and small expressions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions.cursors import decode_cursor, encode_cursor, sort_key
from eventloom.operators import normalise
from eventloom.plans.paging import read_cursor

# Documents and what is left of them.
HIDE = [
    ({"password": "x", "name": "n"}, {"password": "[REDACTED]", "name": "n"}),
    ({"apiKey": "x", "API_KEY": 1, "monkey": "m"},
     {"apiKey": "[REDACTED]", "API_KEY": "[REDACTED]", "monkey": "[REDACTED]"}),
    ({"a": {"userEmail": "e", "b": {"c": {"token": 1, "ok": None}}}},
     {"a": {"userEmail": "[REDACTED]", "b": {"c": {"token": "[REDACTED]", "ok": None}}}}),
    ({"list": [{"ssn": 1, "x": 2}, 3, [{"ssn": 4}]]},
     {"list": [{"ssn": "[REDACTED]", "x": 2}, 3, [{"ssn": 4}]]}),
    ({"description": {"deep": 1}}, {"description": "[REDACTED]"}),
    ({"session": None, "e": {}, "l": []}, {"session": "[REDACTED]", "e": {}, "l": []}),
    ({"plain": "the token is in the text"}, {"plain": "the token is in the text"}),
]
DEEP = {"a": {"b": {"c": {"d": {"e": {"f": {"secret": 1, "g": [{"phone": 2}]}}}}}}}
DEEP_HIDDEN = {"a": {"b": {"c": {"d": {"e": {"f": {
    "secret": "[REDACTED]", "g": [{"phone": "[REDACTED]"}]}}}}}}}


def test_redact(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(HIDE)], "i int, d string")
    got = {r.i: json.loads(r.d) for r in normalise.redact(df, "d").collect()}
    assert got == {i: want for i, (_, want) in enumerate(HIDE)}


def test_redact_any_depth(spark):
    df = spark.createDataFrame([(json.dumps(DEEP),), ("not json token",), (None,)], "d string")
    got = [r.d for r in normalise.redact(df, "d").collect()]
    assert json.loads(got[0]) == DEEP_HIDDEN
    assert got[1:] == ["not json token", None]


def test_redact_sees_through_escapes(spark):
    texts = [r'{"p\u0061ssword":"hunter2"}', r'{"\u0054oken":1,"a":"\u0061"}',
             '{"a":' * 12 + r'{"p\u0061ssword":"hunter2"}' + "}" * 12]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = [json.loads(r.d) for r in normalise.redact(df, "d").collect()]
    assert got[0] == {"password": "[REDACTED]"}
    assert got[1] == {"Token": "[REDACTED]", "a": "a"}
    assert "hunter2" not in json.dumps(got[2])


def test_redact_any_depth_by_brute_force(spark):
    rng = random.Random(3)
    names = ["a", "b", "userToken", "Email", "n"]

    def make(depth):
        kind = rng.randrange(4) if depth else 3
        if kind == 0:
            return {rng.choice(names): make(depth - 1) for _ in range(3)}
        if kind == 1:
            return [make(depth - 1) for _ in range(2)]
        return {rng.choice(names): make(depth - 1)} if kind == 2 else rng.randrange(9)

    def hidden(value):
        if isinstance(value, dict):
            return {k: "[REDACTED]" if "token" in k.lower() or "email" in k.lower() else hidden(v)
                    for k, v in value.items()}
        if isinstance(value, list):
            return [hidden(v) if isinstance(v, dict) else v for v in value]
        return value

    documents = [{"top": make(14)} for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i int, d string")
    got = {r.i: json.loads(r.d) for r in normalise.redact(df, "d").collect()}
    assert got == {i: hidden(d) for i, d in enumerate(documents)}


def test_redact_leaves_no_way_round(spark):
    """Text that only looks like JSON, or only a lenient parser reads, shows nothing hidden."""
    depth = 1200
    texts = [
        '{"password":"hunter2","password":"x"}',
        '{"a":{"token":"hunter2","b":1,"token":2}}',
        '{"a":1,"list":[{"x":{"password":"hunter2"}}],"a":2}',
        '{"user":{"password":"hunter2","na',
        '{"a":[1,2,{"pass\\u0077ord":"hunter2"',
        '{"a":' * depth + '{"password":"hunter2"}' + "}" * depth,
        '[{"password":"hunter2","n":1},{"n":[{"ssn":"hunter2"}]}]',
        '[{"a":{"b":{"c":{"d":{"e":{"password":"hunter2"}}}}}},3]',
        '{"' + "x" * 50_000 + '":1,"secret" : "hunter2"',
    ]
    kept = ['{"a":1,"a":2}', "a shipment: the token is lost", '[1,2', '["password","token"]', '"password"', "", "{"]
    df = spark.createDataFrame(list(enumerate(texts + kept)), "i int, d string")
    got = {r.i: r.d for r in normalise.redact(df, "d").collect()}
    assert not [t for t in map(got.get, range(len(texts))) if "hunter2" in t]
    assert got[0] == got[5] == "[REDACTED]"
    assert json.loads(got[6]) == [{"password": "[REDACTED]", "n": 1}, {"n": [{"ssn": "[REDACTED]"}]}]
    assert json.loads(got[7])[1] == 3
    assert [got[len(texts) + i] for i in range(len(kept))] == kept


def test_cursor_round_trip(spark):
    made = spark.range(200).select(
        F.concat(F.lit("app-ü"), F.col("id")).alias("app"),
        F.lit("2024-01-01T00:00:00.5Z").alias("iso"), F.col("id").cast("string").alias("event"),
    ).withColumn("cursor", encode_cursor(F.col("app"), sort_key(F.col("iso"), F.col("event"))))
    rows = made.withColumn("c", decode_cursor(F.col("cursor"))).collect()
    for row in rows:
        assert row.c.valid and row.c.app_id == row.app and row.c.event_id == row.event
        assert not set(row.cursor) & set("+/=\r\n")
        at, event_id = read_cursor(row.cursor)
        assert (at.isoformat(), event_id) == ("2024-01-01T00:00:00.500000", row.event)


@pytest.mark.parametrize("bad", ["", "***", "e30", "bm90IGpzb24", "eyJwayI6ImEiLCJzayI6IiJ9"])
def test_bad_cursor(spark, bad):
    with pytest.raises(ValueError):
        read_cursor(bad)
    row = spark.createDataFrame([(bad,)], "c string").select(decode_cursor(F.col("c")).alias("c"))
    assert row.first().c.valid is False
