"""Raw request strings to typed requests and their issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.cursors import decode_cursor
from eventloom.functions.scalars import instant, is_iso, strip
from eventloom.model import EVENT_TYPES, Limits

MICROS_PER_DAY = 86_400_000_000


def _list_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ",", -1), lambda p: strip(p)), lambda p: p != "")


def normalise_requests(df: DataFrame, now: Column) -> DataFrame:
    """Text to typed values, before any check."""
    digits = F.regexp_extract("limit", r"^\s*([+-]?\d+)", 1)
    lowered = F.lower("sort")
    no_end = F.col("to").isNull() | (F.col("to") == "")
    end = F.when(
        no_end & (F.col("from") != ""), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    ).otherwise(F.col("to"))
    return df.withColumns({
        "to": end,
        "limit_no": F.when(F.col("limit").isNotNull(), digits.try_cast("bigint")),
        "types": F.when(F.col("types").isNotNull(), _list_of(F.col("types"))),
        "names": F.when(F.col("names").isNotNull(), _list_of(F.col("names"))),
        "sort": F.when(lowered.isin("asc", "desc"), lowered).otherwise(F.col("sort")),
    })


def _issue(path: str | Column, message: str | Column, code: str) -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        as_column(path).alias("path"), as_column(message).alias("message"),
        F.lit(code).alias("code"))


def _field_issues(limits: Limits) -> Column:
    found: list[Column] = []

    def required(name: str, path: str, bad: Column, message: str, code: str) -> None:
        found.append(F.when(F.col(name).isNull(), _issue(path, "Required", "invalid_type"))
                     .when(bad, _issue(path, message, code)))

    required("app_id", "appId", F.col("app_id") == "", "appId is required", "too_small")
    required("from", "from", ~is_iso(F.col("from")),
             "from must be a valid ISO 8601 datetime", "invalid_string")
    found.append(F.when(~is_iso(F.col("to")), _issue(
        "to", "to must be a valid ISO 8601 datetime", "invalid_string")))
    head = F.filter(F.array(*found), lambda i: i.isNotNull())

    listed = " | ".join(f"'{t}'" for t in EVENT_TYPES)
    wrong_types = F.filter(
        F.transform("types", lambda t, i: F.when(~t.isin(*EVENT_TYPES), _issue(
            F.concat(F.lit("types."), i.cast("string")),
            F.concat(F.lit(f"Invalid enum value. Expected {listed}, received '"), t, F.lit("'")),
            "invalid_enum_value"))),
        lambda i: i.isNotNull())

    rest: list[Column] = [
        F.when(F.size(name) == 0, _issue(
            name, f"{name} array must not be empty if provided", "custom"))
        for name in ("types", "names")
    ]
    for name, path in (("user_id", "userId"), ("anonymous_id", "anonymousId"),
                       ("session_id", "sessionId")):
        rest.append(F.when(F.col(name) == "", _issue(
            path, "String must contain at least 1 character(s)", "too_small")))
    number = F.col("limit_no")
    rest.append(
        F.when(F.col("limit").isNotNull() & number.isNull(),
               _issue("limit", "Expected number, received string", "invalid_type"))
        .when(number < 1, _issue("limit", "limit must be at least 1", "too_small"))
        .when(number > limits.max_page,
              _issue("limit", f"limit must not exceed {limits.max_page}", "too_big")))
    rest.append(F.when(~F.col("sort").isin("asc", "desc"), _issue(
        "sort",
        F.concat(F.lit("Invalid enum value. Expected 'asc' | 'desc', received '"),
                 F.col("sort"), F.lit("'")),
        "invalid_enum_value")))
    none = F.array().cast("array<struct<path:string,message:string,code:string>>")
    return F.concat(
        head, F.coalesce(wrong_types, none),
        F.filter(F.array(*rest), lambda i: i.isNotNull()))


def _range_issues(limits: Limits) -> Column:
    """Order and width of the time range; text that is no time fails both."""
    start, end = F.col("start"), F.col("end")
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    readable = start.isNotNull() & end.isNotNull()
    ordered = F.coalesce(readable & (micros > 0), F.lit(False))
    narrow = F.coalesce(
        readable & (micros <= limits.max_window_days * MICROS_PER_DAY), F.lit(False))
    return F.filter(
        F.array(
            F.when(~ordered, _issue("to", "to must be after from", "custom")),
            F.when(~narrow, _issue(
                "from", f"Date range must not exceed {limits.max_window_days} days", "custom")),
        ),
        lambda i: i.isNotNull(),
    )


def validate_requests(df: DataFrame, now: Column, limits: Limits | None = None) -> DataFrame:
    """Typed requests with ``issues``; a request without issues may be answered.

    The range rules are skipped where a field is unreadable, as they would have
    nothing to compare.  The cursor is looked at last, in requests that are right otherwise.
    """
    limits = limits or Limits()
    typed = normalise_requests(df, now).withColumns({
        "start": instant(F.col("from")),
        "end": instant(F.col("to")),
    })
    found = typed.withColumn("__fields", _field_issues(limits))
    stopped = F.exists(
        "__fields", lambda i: i["code"].isin("invalid_type", "invalid_enum_value"))
    none = F.array().cast("array<struct<path:string,message:string,code:string>>")
    given = F.coalesce(F.col("cursor") != "", F.lit(False))
    readable = decode_cursor(F.col("cursor"))["occurred_at"].isNotNull()
    wrong_cursor = F.array(_issue("cursor", "Invalid pagination cursor", "custom"))
    return found.withColumn(
        "issues",
        F.concat("__fields", F.when(~stopped, _range_issues(limits)).otherwise(none)),
    ).withColumn(
        "issues",
        F.when((F.size("issues") == 0) & given & ~readable, wrong_cursor).otherwise(F.col("issues")),
    ).withColumns({
        "limit": F.coalesce("limit_no", F.lit(limits.default_page)).cast("int"),
        "sort": F.coalesce("sort", F.lit("desc")),
    }).drop("__fields", "limit_no", "from", "to")


def request_issues(validated: DataFrame) -> DataFrame:
    return validated.select(
        "request_id", F.posexplode_outer("issues").alias("issue_index", "issue")
    ).where("issue IS NOT NULL").select("request_id", "issue_index", "issue.*")


def valid_requests(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("issues") == 0).drop("issues")
