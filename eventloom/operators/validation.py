"""Contract checks as column expressions.

A batch stays one row: its events are checked inside the row, so the verdict on a
whole batch needs no shuffle.  The result is a list of issues per batch, in the
order in which the contract's fields are declared.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import variants as V
from eventloom.functions.scalars import blank_to_null, contains_any, instant, utf16_units
from eventloom.model import CONSENT, EVENT_FIELDS, ISSUE, Limits
from eventloom.operators import rules
from eventloom.operators.rules import ACTOR_MEMBERS, CONSENT_FLAGS, PAGE_MEMBERS

EVENT_MEMBERS = (
    "schemaVersion", "eventId", "type", "occurredAt", "name", "source", "actor",
    "context", "consent", "properties", "traits",
)
SOURCE_MEMBERS = ("appId", "platform", "env", "appVersion")
CONTEXT_MEMBERS = ("sessionId", "locale", "timezone", "page", "userAgent", "device")
CONSENT_MEMBERS = (*CONSENT_FLAGS, "timestamp")

# Re-writing can widen a number such as 1e20 to its digits, at most this many times.
WIDENING = 6

# Words that hide a message, and what is shown instead.
SENSITIVE_WORDS = ("password", "token", "secret", "key", "authorization")
HIDDEN_MESSAGE = "Validation error occurred"


# ---------------------------------------------------------------- reading

def _open_event(event: Column) -> Column:
    return F.struct(event.alias("raw"), V.fields_of(event, EVENT_MEMBERS).alias("m"))


def _open_parts(e: Column) -> Column:
    m = e["m"]
    context = V.fields_of(m["context"], CONTEXT_MEMBERS)
    return F.struct(
        e["raw"].alias("raw"),
        m.alias("m"),
        V.fields_of(m["source"], SOURCE_MEMBERS).alias("source"),
        V.fields_of(m["actor"], ACTOR_MEMBERS).alias("actor"),
        context.alias("context"),
        V.fields_of(m["consent"], CONSENT_MEMBERS).alias("consent"),
    )


def _leaves(part: Column, names: tuple[str, ...]) -> Column:
    return F.when(
        part.isNotNull(), F.struct(*[V.leaf(part[n]).alias(n) for n in names])
    )


def _kind_unless(opened: Column, value: Column) -> Column:
    """The kind of a value that should be an object and is not."""
    return F.when(opened.isNull(), V.kind_of(value))


def _read_leaves(e: Column) -> Column:
    """Every checked value with its kind.

    A parsed value drags the key dictionary of the whole body along, so only the
    free-form parts are kept as such.
    """
    m, context = e["m"], e["context"]
    page = V.fields_of(context["page"], PAGE_MEMBERS)
    typed_consent = F.try_variant_get(m["consent"], "$", CONSENT.simpleString())
    return F.struct(
        m.isNotNull().alias("is_object"),
        _kind_unless(m, e["raw"]).alias("raw_kind"),
        *[V.leaf(m[n]).alias(n) for n in ("schemaVersion", "eventId", "type", "occurredAt", "name")],
        _leaves(e["source"], SOURCE_MEMBERS).alias("source"),
        _leaves(e["actor"], ACTOR_MEMBERS).alias("actor"),
        _leaves(context, ("sessionId", "locale", "timezone", "userAgent")).alias("context"),
        V.bind(page, lambda p: _leaves(p, PAGE_MEMBERS)).alias("page"),
        _leaves(e["consent"], CONSENT_MEMBERS).alias("consent"),
        *[_kind_unless(e[n], m[n]).alias(f"{n}_kind")
          for n in ("source", "actor", "context", "consent")],
        F.when(context["page"].isNotNull(), _kind_unless(page, context["page"]))
        .alias("page_kind"),
        F.when(context["device"].isNotNull(),
               _kind_unless(V.as_map(context["device"]), context["device"])).alias("device_kind"),
        typed_consent.alias("typed_consent"),
        m["context"].alias("context_value"),
        m["properties"].alias("properties_value"),
        m["traits"].alias("traits_value"),
        F.to_json(m["properties"]).alias("properties_json"),
        F.to_json(m["traits"]).alias("traits_json"),
    )


def read_events(events: Column) -> Column:
    """Array of parsed events with every checked value and its kind."""
    opened = F.transform(events, _open_event)
    parts = F.transform(opened, _open_parts)
    return F.transform(parts, _read_leaves)


# Codes whose failure stops the checks of the object around them.
_STOPPING_CODES = (
    "invalid_type", "invalid_literal", "invalid_enum_value", "invalid_union_discriminator",
)


def _payload_units() -> Column:
    """Size of the envelope once unknown members are gone, as re-written JSON.

    Only measured where the body could reach the limit at all.
    """
    stripped = F.transform("__read", lambda e: F.struct(*_stripped_members(e)))
    text = F.to_json(F.struct(
        F.col("__version")["text"].alias("schemaVersion"),
        F.col("__sent")["text"].alias("sentAt"),
        stripped.alias("events"),
    ))
    return utf16_units(text)


def _stripped_members(e: Column) -> list[Column]:
    identify = e["type"]["text"] == "identify"

    def texts(part: str, names: tuple[str, ...]) -> Column:
        return F.struct(*[e[part][n]["text"].alias(n) for n in names]).alias(part)

    return [
        *[e[n]["text"].alias(n) for n in ("schemaVersion", "eventId", "type", "occurredAt")],
        F.when(~identify, e["name"]["text"]).alias("name"),
        texts("source", SOURCE_MEMBERS),
        texts("actor", ACTOR_MEMBERS),
        stripped_context(e["context_value"]).alias("context"),
        e["typed_consent"].alias("consent"),
        F.when(~identify, e["properties_value"]).alias("properties"),
        F.when(identify, e["traits_value"]).alias("traits"),
    ]


def stripped_context(context: Column, session_id: Column | None = None) -> Column:
    """The context with unknown keys kept, unknown keys of ``page`` dropped and,
    if given, ``sessionId`` set."""
    members = F.transform_values(
        V.as_map(context),
        lambda key, value: F.when(
            key == "page",
            F.to_variant_object(F.map_filter(V.as_map(value), lambda k, _: k.isin(*PAGE_MEMBERS))),
        ).otherwise(value),
    )
    if session_id is not None:
        members = F.map_concat(
            F.map_filter(
                F.coalesce(members, F.create_map().cast(V.MAP_OF_VARIANT)),
                lambda k, _: k != "sessionId",
            ),
            F.create_map(F.lit("sessionId"), session_id.cast("variant")),
        )
    return F.to_variant_object(members)


@dataclass(frozen=True)
class _Checks:
    read: Column
    issues: Column
    payload: Column
    parsed: Column


@lru_cache(maxsize=8)
def _checks(limits: Limits, application: str) -> _Checks:
    """The check expressions, built once per limits and Spark application: a stream
    then does not rebuild them for each micro-batch."""
    no_issue = F.array().cast(f"array<{ISSUE.simpleString()}>")
    per_event = F.coalesce(F.expr(rules.event_issues(limits)), no_issue)
    return _Checks(
        read=read_events(F.col("events")),
        issues=F.concat(F.expr(rules.envelope_issues(limits)), per_event),
        payload=_payload_units(),
        parsed=F.transform("__read", parsed_event),
    )


def validate_batches(
    df: DataFrame, limits: Limits | None = None, body: str = "body"
) -> DataFrame:
    """Adds ``issues``, ``parsed`` and ``event_count`` to opened envelopes (see
    ``open_envelopes``).

    ``issues`` lists every broken rule; ``parsed`` holds the typed, normalised
    events and is only meaningful for a batch without issues.  ``body`` names the
    request text, whose size spares measuring small payloads.
    """
    limits = limits or Limits()
    checks = _checks(limits, df.sparkSession.sparkContext.applicationId)
    read = df.withColumns({
        "__version": V.leaf(F.col("schema_version")),
        "__sent": V.leaf(F.col("sent_at")),
        "__read": checks.read,
        "event_count": F.coalesce(F.size("events"), F.lit(0)),
        "__list_kind": F.when(F.col("events").isNull(), V.kind_of(F.col("events_value"))),
        "__listed": F.col("events").isNotNull(),
    })
    checked = read.withColumn("__issues", checks.issues)
    stopped = F.exists("__issues", lambda i: i["code"].isin(*_STOPPING_CODES))
    oversize = (
        (F.octet_length(body) * WIDENING > limits.max_payload)
        & ~stopped
        & (checks.payload > limits.max_payload)
    )
    size_issue = F.expr(rules.payload_issue(limits, "__oversize"))
    return checked.withColumn("__oversize", oversize).withColumns({
        "issues": F.concat("__issues", size_issue),
        "parsed": checks.parsed,
    }).drop("__version", "__sent", "__read", "__issues", "__oversize", "__list_kind", "__listed")


def parsed_event(e: Column) -> Column:
    """The typed event: unknown keys dropped, session id in its canonical place."""
    kind = e["type"]["text"]
    actor_session = e["actor"]["sessionId"]["text"]
    context_session = e["context"]["sessionId"]["text"]
    moved = blank_to_null(actor_session).isNotNull() & blank_to_null(context_session).isNull()
    identify = kind == "identify"
    columns = {
        "app_id": e["source"]["appId"]["text"],
        "event_id": e["eventId"]["text"],
        "type": kind,
        "name": F.when(~identify, e["name"]["text"]),
        "occurred_at": instant(e["occurredAt"]["text"]),
        "occurred_at_iso": e["occurredAt"]["text"],
        "schema_version": e["schemaVersion"]["text"],
        "platform": e["source"]["platform"]["text"],
        "env": e["source"]["env"]["text"],
        "app_version": e["source"]["appVersion"]["text"],
        "user_id": e["actor"]["userId"]["text"],
        "anonymous_id": e["actor"]["anonymousId"]["text"],
        "actor_session_id": F.when(~moved, actor_session),
        "session_id": F.when(moved, actor_session).otherwise(context_session),
        "context": F.when(moved, F.to_json(stripped_context(e["context_value"], actor_session)))
        .when(e["page"].isNotNull(), F.to_json(stripped_context(e["context_value"])))
        .otherwise(F.to_json(e["context_value"])),
        "consent": e["typed_consent"],
        "properties": F.when(~identify, e["properties_json"]),
        "traits": F.when(identify, e["traits_json"]),
    }
    return F.struct(*[columns[f.name].cast(f.dataType).alias(f.name) for f in EVENT_FIELDS])


# ---------------------------------------------------------------- consumers

def validation_issues(validated: DataFrame) -> DataFrame:
    """One row per broken rule, with its rank inside the batch.

    The outer form is deliberate: for an inner explode the optimizer would add a
    non-empty filter, push it below the checks and so evaluate them several times.
    """
    return validated.select(
        "batch_id", F.posexplode_outer("issues").alias("issue_index", "issue")
    ).where("issue IS NOT NULL").select("batch_id", "issue_index", "issue.*")


def first_message(issues: Column) -> Column:
    return F.get(issues, F.lit(0))["message"]


def sanitize_messages(df: DataFrame, message: str = "message") -> DataFrame:
    """Replaces any message that mentions a secret-looking word."""
    hidden = contains_any(F.lower(F.col(message)), SENSITIVE_WORDS)
    return df.withColumn(message, F.when(hidden, HIDDEN_MESSAGE).otherwise(F.col(message)))


def gate_batches(validated: DataFrame) -> DataFrame:
    """Verdict per batch: one bad event rejects the whole batch."""
    bad = F.size("issues") > 0
    return validated.select(
        "batch_id",
        (~bad).alias("accepted"),
        F.when(bad, F.col("event_count")).otherwise(0).alias("failed"),
        F.when(bad, "batch").alias("error_event_id"),
        F.when(bad, F.concat(F.lit("Validation failed: "), first_message(F.col("issues"))))
        .alias("error"),
    )


def accepted_events(validated: DataFrame, *keep: str) -> DataFrame:
    """The typed events of clean batches; rejected batches yield no row."""
    clean = F.when(F.size("issues") == 0, F.col("parsed"))
    return validated.select(
        "batch_id", *keep, F.posexplode(clean).alias("event_index", "event")
    ).select("batch_id", *keep, "event_index", "event.*")
