"""Typed reads of raw log fields, as Catalyst expressions only."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

ISO = "iso"
DEFAULT_FORMATS = (
    ISO,
    "dd/MMM/yyyy:HH:mm:ss Z",
    "dd/MMM/yyyy:HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
)


def to_number(col: Column) -> Column:
    """Text as double, or null where the text is not a plain number.

    Java reads ``1d``, ``0x1p3`` and ``NaN`` as doubles; a log reader should not, so any
    letter but the exponent makes the field null.
    """
    return F.when(~col.rlike("[A-DF-Za-df-z]"), col.try_cast("double"))


def numeric(df: DataFrame, name: str) -> Column:
    """A column as double; text is read, numbers are taken as they are."""
    col = F.col(name)
    return to_number(col) if df.schema[name].dataType == T.StringType() else col.cast("double")


def utc_naive(instant: Column) -> Column:
    """Zoned instant -> naive UTC time, whatever the session time zone is."""
    seconds = (F.unix_micros(instant) / F.lit(1e6)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds)


_OFFSET = r"\s*([+-]\d{2}):?(\d{2})$"


def _iso(text: Column) -> Column:
    """ISO time; one with an offset or ``Z`` is an instant and becomes UTC."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}\S*\s*(Z|[+-]\d{2}:?\d{2})$")
    instant = utc_naive(F.regexp_replace(text, _OFFSET, "$1:$2").try_cast("timestamp"))
    return F.when(zoned, instant).when(text.rlike(r"^\d{4}-\d{2}-\d{2}"),
                                       text.try_cast("timestamp_ntz"))


def parse_datetime(text: Column, formats=DEFAULT_FORMATS) -> Column:
    """First format that reads ``text``; null when none does."""
    attempts = []
    for fmt in formats:
        if fmt == ISO:
            attempts.append(_iso(text))
        elif fmt.endswith("Z"):
            attempts.append(utc_naive(F.try_to_timestamp(text, F.lit(fmt))))
        else:  # an explicit zone keeps the session's daylight-saving rules out of it
            attempts.append(utc_naive(F.try_to_timestamp(
                F.concat(text, F.lit(" +0000")), F.lit(fmt + " Z"))))
    return F.coalesce(*attempts)


def day_hour(day: Column, hour: Column) -> Column:
    """Naive time of an hour of a day (``date_trunc`` would pass through the session time
    zone)."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def flag(condition: Column) -> Column:
    """1/0; an unknown condition counts as 0 and stays in every denominator."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def contains_any(text: Column, tokens) -> Column:
    hits = [text.contains(t) for t in tokens]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


# ---- client address -------------------------------------------------------------

# First octets treated as private.
PRIVATE_FIRST_OCTETS = (10, 192, 172)


def first_octet(ip: Column) -> Column:
    """First octet of a four-part address, else null."""
    return F.when(occurrences(ip, ".") == 3,
                  F.substring_index(ip, ".", 1).try_cast("int"))


def is_private(octet: Column) -> Column:
    return flag(octet.isin(*PRIVATE_FIRST_OCTETS))


def subnet_class(octet: Column) -> Column:
    return (F.when(octet.isNull(), "Unknown").when(octet < 128, "A")
            .when(octet < 192, "B").otherwise("C"))


# ---- request URI ----------------------------------------------------------------

# Attack signatures, matched anywhere in the URI regardless of case.
ATTACK_TOKENS = {
    "sql_injection": ("union", "select", "insert", "delete", "drop", "script"),
    "xss": ("<script", "javascript:", "onload="),
    "traversal": ("../", "..\\"),
}
# How each signature is reported.
ATTACK_LABELS = {
    "sql_injection": "SQL Injection attempts",
    "xss": "XSS attempts",
    "traversal": "Directory traversal",
}


def attack_flag(uri: Column, kind: str) -> Column:
    """Signatures are plain tokens, so substring search replaces a regex per row."""
    return flag(contains_any(F.lower(uri), ATTACK_TOKENS[kind]))


def file_extension(uri: Column) -> Column:
    found = F.regexp_extract(uri, r"[.]([a-zA-Z0-9]+)$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("none"))
