"""Key-based redaction of JSON documents."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import variants as V
from eventloom.functions.scalars import contains_any

# A member is hidden if its name contains one of these, in any case.
SENSITIVE_FRAGMENTS = (
    "password", "token", "secret", "key", "authorization", "cookie", "session", "apiKey",
    "api_key", "writeKey", "write_key", "analyticsWriteKey", "analytics_write_key",
)
PII_FRAGMENTS = (
    "email", "phone", "phoneNumber", "phone_number", "ssn", "creditCard", "credit_card",
    "address", "ipAddress", "ip_address", "ip",
)
REDACTED = "[REDACTED]"

_FRAGMENTS = tuple(dict.fromkeys(f.lower() for f in SENSITIVE_FRAGMENTS + PII_FRAGMENTS))

UNROLLED_LEVELS = 4


def _hidden(key: Column) -> Column:
    return V.bind(F.lower(key), lambda k: contains_any(k, _FRAGMENTS))


def _redact_members(members: Column, levels: int) -> Column:
    hidden = F.lit(REDACTED).cast("variant")
    return F.to_variant_object(F.transform_values(
        members,
        lambda key, value: F.when(_hidden(key), hidden).otherwise(_redact_inner(value, levels - 1)),
    ))


def _redact_inner(value: Column, levels: int) -> Column:
    """Objects are entered, and objects directly inside an array; an array inside an
    array stays as it is."""
    if levels == 0:
        return value

    def item(v: Column) -> Column:
        return V.bind(V.as_map(v), lambda m: F.when(
            m.isNotNull(), _redact_members(m, levels)).otherwise(v))

    return V.bind(
        F.struct(V.as_map(value).alias("members"), V.as_array(value).alias("items")),
        lambda c: F.when(c["members"].isNotNull(), _redact_members(c["members"], levels))
        .when(c["items"].isNotNull(), F.to_variant_object(F.transform(c["items"], item)))
        .otherwise(value),
    )


def _deeper_than(document: Column, levels: int) -> Column:
    """Does any container sit ``levels`` or more below the root?"""

    def below(opened: Column, left: int) -> Column:
        inner = V.containers(V.children(opened))
        if left == 1:
            return F.size(inner) > 0
        return V.bind(inner, lambda found: F.when(
            F.size(found) > 0, below(found, left - 1)).otherwise(F.lit(False)))

    return below(V.containers(F.array(document)), levels)


def _names_hidden(text: Column) -> Column:
    """Is there a quoted name of a member that is hidden, or an escape that could spell one?

    It reads text that is no JSON, or not quite, so it goes by quotes and colons alone.
    """
    inside = "|".join([re.escape(f) for f in _FRAGMENTS] + [r"\\u"])
    return text.rlike(rf'(?is)"[^"]*(?:{inside})[^"]*"\s*:')


def redaction(text: Column) -> Column:
    """(out, deep): the text with hidden members replaced, or that it needs ``redact_deep``.

    A document is parsed once, and only if a fragment occurs in it, or an escape that could
    spell one.  Text that cannot be read as JSON (cut off, with a name twice in an object, nested
    beyond the parser) is hidden whole if a hidden name is in it, and else stays as it is.
    """
    # Letters can only be written as themselves or as a \u escape.
    suspect = text.contains("\\u") | V.bind(F.lower(text), lambda t: contains_any(t, _FRAGMENTS))

    def told(out: Column, deep: Column | None = None) -> Column:
        return F.struct(out.cast("string").alias("out"),
                        (F.lit(False) if deep is None else deep).alias("deep"))

    def opened(document: Column) -> Column:
        def replaced(c: Column) -> Column:
            return F.when(c["members"].isNotNull(), F.to_json(_redact_members(c["members"], UNROLLED_LEVELS))) \
                .when(c["items"].isNotNull(), F.to_json(_redact_inner(document, UNROLLED_LEVELS))).otherwise(text)

        parts = F.struct(V.as_map(document).alias("members"), V.as_array(document).alias("items"))
        return F.when(document.isNull(), told(F.when(_names_hidden(text), F.lit(REDACTED)).otherwise(text))) \
            .when(_deeper_than(document, UNROLLED_LEVELS), told(F.lit(None), F.lit(True))) \
            .otherwise(told(V.bind(parts, replaced)))

    return F.when(suspect, V.bind(F.try_parse_json(text), opened)).otherwise(told(text))


def redact_json(df: DataFrame, column: str) -> DataFrame:
    """JSON text with hidden members replaced, at any depth, also in a top-level array.

    Objects nested deeper than the unrolled levels go through a Python pass, which sees only
    those documents.
    """
    text, work = F.col(column), "__redaction"
    found = df.withColumn(work, redaction(text))
    deep = F.col(f"{work}.deep")
    return found.withColumn(column, F.when(deep, redact_deep(F.when(deep, text))).otherwise(F.col(f"{work}.out"))) \
        .drop(work)


@F.pandas_udf(T.StringType())
def redact_deep(texts: pd.Series) -> pd.Series:
    """The same for documents of any depth, by a list of open members instead of recursion.

    Members come out by name, as parsed JSON writes them everywhere else; what does not fit
    Python's own limits of nesting is hidden whole.
    """
    def one(text: str) -> str:
        document = json.loads(text)
        whole = document if isinstance(document, list) else [document]
        opened = [v for v in whole if isinstance(v, dict)]
        while opened:
            members = opened.pop()
            for name, value in members.items():
                if any(f in name.lower() for f in _FRAGMENTS):
                    members[name] = REDACTED
                elif isinstance(value, dict):
                    opened.append(value)
                elif isinstance(value, list):
                    opened += [v for v in value if isinstance(v, dict)]
        return json.dumps(document, ensure_ascii=False, separators=(",", ":"), sort_keys=True)

    def safe(text: str) -> str:
        try:
            return one(text)
        except RecursionError:
            return REDACTED

    return texts.map(safe, na_action="ignore")
