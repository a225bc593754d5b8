"""Opaque page cursors: unpadded base64url over a two-field JSON object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.scalars import instant
from eventloom.functions.variants import bind


def sort_key(occurred_at_iso: Column, event_id: Column) -> Column:
    return F.concat_ws("#", occurred_at_iso, event_id)


def encode_cursor(pk: Column, sk: Column) -> Column:
    text = F.to_json(F.struct(pk.alias("pk"), sk.alias("sk")))
    # Sessions that still chunk base64 output put CR/LF every 76 characters.
    plain = F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_")
    return F.rtrim(plain, F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """Struct of the cursor's parts and whether it is well formed.

    ``pk`` may be an old composite ``app#x``; only the part before ``#`` counts.
    ``occurred_at`` and ``event_id`` are NULL unless the sort key has two parts.
    """
    url = F.rtrim(F.translate(cursor, "-_", "+/"), F.lit("="))
    # Each step is bound, so that it, and the cursor itself, is worked out once and not once per use.
    text = bind(url, lambda u: F.try_validate_utf8(F.try_to_binary(
        F.concat(u, F.repeat(F.lit("="), F.pmod(F.lit(4) - F.length(u), F.lit(4)))), F.lit("base64"))
        .cast("string")))
    fields = bind(F.try_parse_json(text), lambda body: F.struct(
        _string_field(body, "pk").alias("pk"), _string_field(body, "sk").alias("sk")))
    return bind(fields, lambda f: _parts(f["pk"], f["sk"]))


def _parts(pk: Column, sk: Column) -> Column:
    valid = F.coalesce((pk != "") & (sk != ""), F.lit(False))
    parts = F.split(sk, "#", -1)
    two = valid & (F.size(parts) == 2)
    return F.struct(
        valid.alias("valid"),
        F.when(valid, F.split(pk, "#", -1)[0]).alias("app_id"),
        F.when(valid, sk).alias("sk"),
        F.when(two, parts[0]).alias("occurred_at_iso"),
        F.when(two, instant(parts[0])).alias("occurred_at"),
        F.when(two, parts[1]).alias("event_id"),
    )


def _string_field(body: Column, name: str) -> Column:
    return bind(F.try_variant_get(body, f"$.{name}", "variant"), lambda value: F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")))
