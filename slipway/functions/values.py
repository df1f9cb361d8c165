"""Column builders for loosely typed sensor values (VARIANT leaves).

Sensor fields carry strings, booleans, numbers or nested values. Numbers are always doubles. The text form of
a number follows the shortest-digits convention with an exponent from 1e+06 upwards and below 1e-04.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted text forms.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPECIAL_NUMBER_PATTERN = r"(?i)^[+-]?(inf|infinity|nan)$"
DURATION_PATTERN = r"^[+-]?(0|((\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h))+)$"
RFC3339_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
NUMERIC_KINDS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
UNIT_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def quoted(s: Column) -> Column:
    escaped = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def parse_number(s: Column) -> Column:
    """Text to double, or NULL when the text is not exactly a number (no blanks, no type suffix)."""
    plain = s.try_cast("double")
    special = (
        F.when(F.lower(s).contains("nan"), F.lit(float("nan")))
        .when(s.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    return F.when(s.rlike(NUMBER_PATTERN) & (F.abs(plain) < float("inf")), plain).when(
        s.rlike(SPECIAL_NUMBER_PATTERN), special
    )


def number_text(d: Column) -> Column:
    """Shortest-digits text of a double, derived from the JVM's text form by one rewrite per magnitude."""
    s, size = d.cast("string"), F.abs(d)

    def rewrite(text: Column, *steps: tuple[str, str]) -> Column:
        for pattern, replacement in steps:
            text = F.regexp_replace(text, pattern, replacement)
        return text

    strip = ((r"0+$", ""), (r"\.$", ""))
    return (
        F.when(F.isnan(d), F.lit("NaN"))
        .when(size == float("inf"), F.when(d > 0, "+Inf").otherwise("-Inf"))
        .when((size < 1e6) & ((size >= 1e-3) | (size == 0)), rewrite(s, (r"\.0$", "")))
        .when((size >= 1e6) & (size < 1e7), F.concat(
            rewrite(s, (r"^(-?\d)(\d{6})\.(\d+)$", "$1.$2$3"), *strip), F.lit("e+06")))
        .when((size >= 1e-4) & (size < 1e-3), rewrite(s, (r"(\d)\.(\d*)E-4$", "0.000$1$2"), strip[0]))
        .otherwise(rewrite(s, (r"\.0E", "E"), (r"E(\d)$", "e+0$1"), (r"E(\d+)$", "e+$1"), (r"E-(\d)$", "e-0$1"),
                           (r"E-", "e-")))
    )


def kind(v: Column) -> Column:
    """Type name of a VARIANT leaf; NULL and variant null are both ``VOID``."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def is_number(v: Column) -> Column:
    return kind(v).rlike(NUMERIC_KINDS)


def text(v: Column, k: Column | None = None) -> Column:
    """String content of a VARIANT leaf, NULL for any other type."""
    return F.when((kind(v) if k is None else k) == "STRING", F.try_variant_get(v, "$", "string"))


def number(v: Column, k: Column | None = None) -> Column:
    """Double of a number or a numeric string; NULL for booleans, nulls and everything else."""
    k = kind(v) if k is None else k
    return F.when(k.rlike(NUMERIC_KINDS), F.try_variant_get(v, "$", "double")).otherwise(
        F.when(k == "STRING", parse_number(F.try_variant_get(v, "$", "string"))))


def printed(v: Column, k: Column | None = None) -> Column:
    """Text form used by equality checks and messages."""
    k = kind(v) if k is None else k
    return (
        F.when(k == "VOID", F.lit("<nil>"))
        .when(k == "STRING", F.try_variant_get(v, "$", "string"))
        .when(k == "BOOLEAN", F.try_variant_get(v, "$", "string"))
        .when(k.rlike(NUMERIC_KINDS), number_text(F.try_variant_get(v, "$", "double")))
        .otherwise(F.to_json(v))
    )


def field(data: Column, name: Column) -> Column:
    return F.try_element_at(data, F.coalesce(name, F.lit("")))


def has_field(data: Column, name: Column) -> Column:
    return F.map_contains_key(data, F.coalesce(name, F.lit("")))


def duration_seconds(s: Column) -> Column:
    """``1h30m`` style text to seconds; NULL when the text (or the empty string) is no duration."""
    parts = F.regexp_extract_all(s, F.lit(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"), F.lit(0))
    units = F.create_map(*[x for k, v in UNIT_SECONDS.items() for x in (F.lit(k), F.lit(v))])

    def seconds(part: Column) -> Column:
        amount = F.regexp_extract(part, r"^[\d.]+", 0).cast("double")
        return amount * F.element_at(units, F.regexp_extract(part, r"[a-zµμ]+$", 0))

    total = F.aggregate(parts, F.lit(0.0), lambda acc, part: acc + seconds(part))
    return F.when(s.rlike(DURATION_PATTERN), F.when(s.startswith("-"), -total).otherwise(total))


def duration_micros(s: Column) -> Column:
    return F.round(duration_seconds(s) * 1e6).cast("bigint")


def duration_text(micros: Column) -> Column:
    """Microseconds to text such as ``26h0m0s``, ``1.5s`` or ``20ms``."""
    a = F.abs(micros)
    sign = F.when(micros < 0, "-").otherwise("")

    def plain(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")

    seconds = plain((a % 60_000_000) / F.lit(1e6))
    minutes = (F.floor(a / 60_000_000) % 60).cast("bigint")
    hours = F.floor(a / 3_600_000_000).cast("bigint")
    return (
        F.when(a == 0, F.lit("0s"))
        .when(a < 1000, F.concat(sign, a.cast("string"), F.lit("µs")))
        .when(a < 1_000_000, F.concat(sign, plain(a / F.lit(1e3)), F.lit("ms")))
        .when(a < 60_000_000, F.concat(sign, seconds, F.lit("s")))
        .when(a < 3_600_000_000, F.concat(sign, minutes.cast("string"), F.lit("m"), seconds, F.lit("s")))
        .otherwise(
            F.concat(sign, hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m"), seconds, F.lit("s"))
        )
    )


def rfc3339(s: Column) -> Column:
    """RFC 3339 text to TIMESTAMP, NULL when a time or zone is missing or out of range."""
    return F.when(s.rlike(RFC3339_PATTERN), F.replace(s, F.lit(","), F.lit(".")).try_cast("timestamp"))


def rfc3339_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def valid_date(s: Column) -> Column:
    """``YYYY-MM-DD`` text to DATE, NULL otherwise."""
    return F.when(s.rlike(DATE_PATTERN), s.try_cast("date"))


def epoch_ms_value(v: Column, *, scale_seconds: bool = True) -> Column:
    """``updatedAt`` style value to epoch milliseconds.

    Values between 0 and 1e12 are seconds when ``scale_seconds``; text must be a plain integer.
    """
    raw = F.when(is_number(v), F.try_variant_get(v, "$", "double").cast("bigint")).otherwise(
        F.when(text(v).rlike(r"^[+-]?\d+$"), text(v).try_cast("bigint"))
    )
    if not scale_seconds:
        return raw
    return F.when((raw > 0) & (raw < 1_000_000_000_000), raw * 1000).otherwise(raw)


def non_null_text(s: Column) -> Column:
    """TRUE for a present, non-empty string."""
    return F.coalesce(s != "", F.lit(False))


def first_bytes(text: Column, n: int) -> Column:
    """The longest prefix of whole code points in at most ``n`` bytes of UTF-8."""
    b = text.cast("binary")

    def splits(k: int) -> Column:
        return F.substring(b, k + 1, 1).between(F.expr("X'80'"), F.expr("X'BF'"))

    cut = F.when(~splits(n), n).when(~splits(n - 1), n - 1).when(~splits(n - 2), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(text) <= n, text).otherwise(b.substr(F.lit(1), cut).cast("string"))
