"""The contract's rules as SQL expressions over a read event.

The rules make one large expression.  As SQL text Spark parses it in one call; built
node by node it would take tens of thousands of calls to the JVM.

Inside an expression an issue is one string, ``rule, code, path, message``.  The message
comes last, so it may hold any character.
"""

from __future__ import annotations

from eventloom.model import (
    ENVIRONMENTS,
    EVENT_TYPES,
    IDENTIFIER_MAX,
    ISO_PATTERN,
    LOCALE_MAX,
    NAME_PATTERN,
    PAGE_FIELD_MAX,
    PLATFORMS,
    SCHEMA_VERSION,
    TIMEZONE_MAX,
    UUID_PATTERN,
    Limits,
)

# Fixed values of the wire contract: these member names, and the messages and codes of all
# issues below.
ACTOR_MEMBERS = ("userId", "anonymousId", "sessionId")
PAGE_MEMBERS = ("url", "path", "referrer", "title")
CONSENT_FLAGS = ("analytics", "experimentation", "personalization")

SEP = "\u0001"
NONE = "CAST(array() AS ARRAY<STRING>)"


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` evaluated once under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def issue(rule: str, path: str, message: str, code: str) -> str:
    return quote(SEP.join((rule, code, path, message)))


def issue_with(rule: str, path: str, message_sql: str, code: str) -> str:
    return f"concat({quote(SEP.join((rule, code, path, '')))}, {message_sql})"


def compact(checks: list[str]) -> str:
    return f"array_compact(array({', '.join(checks)}))"


def none_of(checks: list[str]) -> str:
    return f"coalesce({', '.join(checks)}) IS NULL"


def unpack(packed: str, index: str, prefix: str) -> str:
    part = (
        f"named_struct('event_index', {index}, 'rule', part[0], 'path', concat({prefix}, part[2]),"
        " 'message', part[3], 'code', part[1])"
    )
    return f"transform({packed}, text -> {bind(f'split(text, {quote(SEP)}, 4)', 'part', part)})"


def cases(*branches: tuple[str, str], other: str = "NULL") -> str:
    body = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    return f"CASE {body} ELSE {other} END"


# ---------------------------------------------------------------- conditions

def described(kind: str) -> str:
    plain = f"substring_index({kind}, '<', 1)"
    return cases(
        (f"{plain} IN ('STRING', 'BOOLEAN', 'OBJECT', 'ARRAY')", f"lower({plain})"),
        (f"{plain} = 'VOID'", "'null'"), other="'number'")


def too_long(text: str, limit: int) -> str:
    """UTF-8 never takes fewer bytes than UTF-16 units, so short text stops early."""
    units = f"length(encode({text}, 'UTF-16LE')) / 2"
    return f"(octet_length({text}) > {limit} AND {units} > {limit})"


def not_iso(text: str) -> str:
    day = f"try_to_timestamp(substring({text}, 1, 10), 'yyyy-MM-dd')"
    return (f"({text} IS NOT NULL AND NOT ({text} RLIKE {quote(ISO_PATTERN)}"
            f" AND {day} IS NOT NULL))")


def not_matching(text: str, pattern: str) -> str:
    return f"({text} IS NOT NULL AND NOT {text} RLIKE {quote(pattern)})"


# ---------------------------------------------------------------- checks of one member

def wrong_type(rule: str, path: str, expected: str, kind: str) -> str:
    received = f"concat({quote(f'Expected {expected}, received ')}, {described(kind)})"
    return issue_with(rule, path, cases((f"{kind} IS NULL", "'Required'"), other=received),
                      "invalid_type")


def text_check(rule: str, path: str, value: str, *checks: tuple[str, str, str],
               required: bool = False) -> str:
    """Type first, then the given (failed, message, code) checks."""
    bad = f"{value}.kind != 'STRING'"
    if required:
        bad = f"({value}.kind IS NULL OR {bad})"
    return cases(
        (bad, wrong_type(rule, path, "string", f"{value}.kind")),
        *[(failed, issue(rule, path, message, code)) for failed, message, code in checks])


def at_most(value: str, limit: int) -> tuple[str, str, str]:
    return (too_long(f"{value}.text", limit),
            f"String must contain at most {limit} character(s)", "too_big")


def sized(rule: str, path: str, value: str, limit: int) -> str:
    return text_check(rule, path, value, at_most(value, limit))


def choice(rule: str, path: str, value: str, options: tuple[str, ...]) -> str:
    listed = " | ".join(f"'{o}'" for o in options)
    unknown = (f"concat({quote(f'Invalid enum value. Expected {listed}, received ')},"
               f" {quote(chr(39))}, {value}.text, {quote(chr(39))})")
    allowed = ", ".join(quote(o) for o in options)
    return cases(
        (f"({value}.kind IS NULL OR {value}.kind != 'STRING')",
         wrong_type(rule, path, listed, f"{value}.kind")),
        (f"{value}.text NOT IN ({allowed})", issue_with(rule, path, unknown, "invalid_enum_value")))


def literal(rule: str, path: str, value: str, wanted: str) -> str:
    same = f"coalesce({value}.kind = 'STRING' AND {value}.text = {quote(wanted)}, FALSE)"
    return cases((f"NOT {same}", issue(
        rule, path, f'Invalid literal value, expected "{wanted}"', "invalid_literal")))


# ---------------------------------------------------------------- the event

def event_issues(limits: Limits) -> str:
    """Issues of all events in ``__read``; an unknown type hides all other checks."""
    listed = " | ".join(f"'{t}'" for t in EVENT_TYPES)
    allowed = ", ".join(quote(t) for t in EVENT_TYPES)
    known = f"coalesce(e.`type`.kind = 'STRING' AND e.`type`.text IN ({allowed}), FALSE)"
    packed = cases(
        ("NOT e.is_object", f"array({wrong_type('event_type', '', 'object', 'e.raw_kind')})"),
        (f"NOT {known}", f"""array({issue(
            "event_type", ".type", f"Invalid discriminator value. Expected {listed}",
            "invalid_union_discriminator")})"""),
        other=_member_issues(limits))
    prefix = "concat('events.', CAST(i AS STRING))"
    return f"flatten(transform(__read, (e, i) -> {unpack(packed, 'i', prefix)}))"


def _member_issues(limits: Limits) -> str:
    head = [
        literal("schema_version", ".schemaVersion", "e.schemaVersion", SCHEMA_VERSION),
        text_check("event_id", ".eventId", "e.eventId", (
            not_matching("e.eventId.text", UUID_PATTERN), "Invalid uuid", "invalid_string"),
            required=True),
        text_check("occurred_at", ".occurredAt", "e.occurredAt", (
            not_iso("e.occurredAt.text"), "Invalid datetime", "invalid_string"), required=True),
    ]
    source = [
        text_check("source", ".source.appId", "e.source.appId",
                   ("e.source.appId.text = ''", "String must contain at least 1 character(s)",
                    "too_small"),
                   at_most("e.source.appId", IDENTIFIER_MAX), required=True),
        choice("source", ".source.platform", "e.source.platform", PLATFORMS),
        choice("source", ".source.env", "e.source.env", ENVIRONMENTS),
        sized("source", ".source.appVersion", "e.source.appVersion", IDENTIFIER_MAX),
    ]
    readable = " AND ".join(
        f"coalesce(e.actor.{name}.kind = 'STRING', TRUE)" for name in ACTOR_MEMBERS)
    nobody = ("coalesce(nullif(e.actor.userId.text, ''), nullif(e.actor.anonymousId.text, ''))"
              " IS NULL")
    actor = [
        *[sized("actor", f".actor.{n}", f"e.actor.{n}", IDENTIFIER_MAX) for n in ACTOR_MEMBERS],
        cases((f"{readable} AND {nobody}", issue(
            "actor", ".actor", "At least one of userId or anonymousId must be present",
            "custom"))),
    ]
    context = [
        sized("context", ".context.sessionId", "e.context.sessionId", IDENTIFIER_MAX),
        sized("context", ".context.locale", "e.context.locale", LOCALE_MAX),
        sized("context", ".context.timezone", "e.context.timezone", TIMEZONE_MAX),
        cases(("e.page_kind IS NOT NULL",
               wrong_type("context", ".context.page", "object", "e.page_kind"))),
        *[cases(("e.page IS NOT NULL", sized(
            "context", f".context.page.{n}", f"e.page.{n}", PAGE_FIELD_MAX)))
          for n in PAGE_MEMBERS],
        sized("context", ".context.userAgent", "e.context.userAgent", PAGE_FIELD_MAX),
        cases(("e.device_kind IS NOT NULL",
               wrong_type("context", ".context.device", "object", "e.device_kind"))),
    ]
    consent = [
        *[cases((f"(e.consent.{n}.kind IS NULL OR e.consent.{n}.kind != 'BOOLEAN')", wrong_type(
            "consent", f".consent.{n}", "boolean", f"e.consent.{n}.kind")))
          for n in CONSENT_FLAGS],
        text_check("consent", ".consent.timestamp", "e.consent.timestamp", (
            not_iso("e.consent.timestamp.text"), "Invalid datetime", "invalid_string"),
            required=True),
    ]
    name = text_check("event_name", ".name", "e.name", (
        not_matching("e.name.text", NAME_PATTERN),
        "Event name must be lowercase snake_case with optional dot namespaces",
        "invalid_string"), required=True)

    def part(label: str, checks: list[str], required: bool) -> str:
        wrong = f"array({wrong_type(label, f'.{label}', 'object', f'e.{label}_kind')})"
        absent = [] if required else [(f"e.{label}_kind IS NULL", NONE)]
        return cases((f"e.{label} IS NOT NULL", compact(checks)), *absent, other=wrong)

    def clean(label: str, checks: list[str], required: bool) -> str:
        absent = "FALSE" if required else f"e.{label}_kind IS NULL"
        return cases((f"e.{label} IS NOT NULL", none_of(checks)), other=absent)

    identify = "e.`type`.text = 'identify'"
    parts = (("source", source, True), ("actor", actor, True), ("context", context, False),
             ("consent", consent, False))
    # Most events are clean: that is told without a list per part.
    fine = " AND ".join([none_of(head), *(clean(*p) for p in parts), f"({identify} OR {none_of([name])})"])
    whole = "concat(" + ", ".join([
        compact(head), *(part(*p) for p in parts), cases((identify, NONE), other=compact([name])), "body"]) + ")"
    body = cases((identify, _open_part_issues("traits", limits)), other=_open_part_issues("properties", limits))
    return bind(body, "body", cases((fine, "body"), other=whole))


# ---------------------------------------------------------------- free-form objects

def _opened(values: str) -> str:
    """The objects and arrays among ``values``, opened one level."""
    one = ("named_struct('members', try_variant_get(v, '$', 'map<string,variant>'),"
           " 'items', try_variant_get(v, '$', 'array<variant>'))")
    return (f"filter(transform({values}, v -> {one}),"
            " c -> c.members IS NOT NULL OR c.items IS NOT NULL)")


def _children(level: str) -> str:
    return f"flatten(transform({level}, c -> coalesce(map_values(c.members), c.items)))"


def _open_part_issues(part: str, limits: Limits) -> str:
    """Keys, sizes and depth at every level the depth limit admits; string lengths at
    any depth."""
    path = f".{part}"
    message = f"{part.capitalize()} must not exceed depth of {limits.max_depth}"

    def rule(name: str) -> str:
        return "traits" if part == "traits" else name

    def shape(name: str) -> str:
        return issue(rule(name), path, message, "custom")

    def check(k: int) -> str:
        here = f"level{k}"
        bad_key = (f"exists({here}, c -> exists(map_keys(c.members),"
                   f" name -> NOT name RLIKE {quote(NAME_PATTERN)}))")
        verdicts = [
            (f"exists({here}, c -> size(map_keys(c.members)) > {limits.max_keys})",
             shape("keys_per_level")),
            (bad_key, shape("property_key")),
            (f"exists({here}, c -> size(c.items) > {limits.max_array})", shape("array_length")),
        ]
        if k == limits.max_depth:
            return cases(*verdicts,
                         (f"size({_children(here)}) > 0", shape("property_depth")))
        below = bind(_opened(_children(here)), f"level{k + 1}",
                     cases((f"size(level{k + 1}) > 0", check(k + 1))))
        if k == 0:
            below = cases((nested, below))
        return cases(*verdicts, other=below)

    value, json = f"e.{part}_value", f"e.{part}_json"
    # Text without a second brace and without a bracket has nothing below its first level.
    nested = f"locate('{{', {json}, 2) > 0 OR locate('[', {json}) > 0"
    root = "array(named_struct('members', root, 'items', CAST(NULL AS ARRAY<VARIANT>)))"
    # An escaped literal never takes fewer bytes than the UTF-16 units it stands for.
    over = f"octet_length(s) > {limits.max_string} AND {_literal_units('s')} > {limits.max_string}"
    long_text = cases((
        f"octet_length({json}) > {limits.max_string} AND"
        f" exists({_string_literals(json)}, s -> {over})",
        issue(rule("string_length"), path,
              f"String values must not exceed {limits.max_string} characters", "custom")))
    wrong = wrong_type(rule("properties"), path, "object", f"schema_of_variant({value})")
    opened = bind(f"try_variant_get({value}, '$', 'map<string,variant>')", "root", cases(
        ("root IS NULL", f"array({wrong})"),
        other=compact([bind(root, "level0", check(0)), long_text])))
    return cases((f"{value} IS NULL", NONE), other=opened)


def _string_literals(json: str) -> str:
    """Every string *value* of a JSON text, at any depth, still escaped.

    Escaped backslashes and quotes become control characters, which JSON text cannot
    hold raw; what is left splits cleanly at the quotes.  Odd pieces are literals, and
    a literal followed by a colon is a key.
    """
    backslash, escaped_quote = quote("\\\\"), quote('\\"')
    plain = (f"replace(replace({json}, {backslash}, {quote(chr(1))}),"
             f" {escaped_quote}, {quote(chr(2))})")
    tagged = ("transform(pieces, (piece, at) -> named_struct('text', piece, 'is_value',"
              " at % 2 = 1 AND NOT startswith(get(pieces, at + 1), ':')))")
    values = f"transform(filter({tagged}, t -> t.is_value), t -> t.text)"
    split = f"split({plain}, {quote(chr(34))}, -1)"
    return bind(split, "pieces", values)


def _literal_units(literal_text: str) -> str:
    """UTF-16 length of an escaped literal once unescaped."""
    flat = f"regexp_replace({literal_text}, {quote(chr(92) * 2 + 'u[0-9a-fA-F]{4}')}, 'x')"
    flat = f"regexp_replace({flat}, {quote(chr(92) * 2 + '.')}, 'x')"
    return f"length(encode({flat}, 'UTF-16LE')) / 2"


# ---------------------------------------------------------------- the envelope

def envelope_issues(limits: Limits) -> str:
    count = "event_count"
    sizes = cases(
        ("NOT __listed", wrong_type("batch_size", "events", "array", "__list_kind")),
        (f"{count} < {limits.min_events}", issue(
            "batch_size", "events",
            f"Batch must contain at least {limits.min_events} event", "too_small")),
        (f"{count} > {limits.max_events}", issue(
            "batch_size", "events",
            f"Batch must not exceed {limits.max_events} events per request", "too_big")))
    packed = compact([
        literal("schema_version", "schemaVersion", "__version", SCHEMA_VERSION),
        text_check("sent_at", "sentAt", "__sent", (
            not_iso("__sent.text"), "Invalid datetime", "invalid_string")),
        sizes,
    ])
    return unpack(packed, "CAST(NULL AS INT)", "''")


def payload_issue(limits: Limits, oversize: str) -> str:
    """The one issue of an oversize payload, as a list."""
    packed = cases((oversize, f"""array({issue(
        "payload_size", "", f"Payload size must not exceed {limits.max_payload} bytes",
        "custom")})"""), other=NONE)
    return unpack(packed, "CAST(NULL AS INT)", "''")
