"""Scalar expressions and row predicates over catalogue columns. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
SCAN_DATE_PATTERN = "yyyy-MM-dd HH:mm:ss"
SCAN_DATE_REGEX = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\z"
LENIENT_DATE_REGEX = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\z"
PLAY_MARKET = "play.google.com"
KB, MB, GB = 1024, 1024**2, 1024**3
# The characters that Unicode counts as white space.
WHITE_SPACE = (
    " \t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def parse_detection(raw: Column) -> Column:
    """Detection count as BIGINT; NULL where the text is not an integer."""
    return raw.try_cast("bigint")


def parse_scan_date(raw: Column, strict: bool = False) -> Column:
    """Scan date as a timestamp. Text that does not fit becomes NULL, or an error when ``strict``.

    The lenient form checks the shape and then casts, which takes a third less time than
    ``try_to_timestamp`` with a pattern; the cast alone would also take dates without a time, fractions and zones.
    """
    if strict:
        return F.to_timestamp(raw, SCAN_DATE_PATTERN)
    return F.when(raw.rlike(SCAN_DATE_REGEX), raw.try_cast("timestamp"))


def trimmed_market(market: Column) -> Column:
    """Market without surrounding white space (``trim`` alone would take spaces only)."""
    return F.trim(market, F.lit(WHITE_SPACE))


def period(scan_ts: Column, granularity: str) -> Column:
    """Period label: an integer year, ``2021-Q3``, or ``2021-07``."""
    year = F.year(scan_ts)
    if granularity == "quarter":
        return F.concat(year.cast("string"), F.lit("-Q"), F.quarter(scan_ts).cast("string"))
    if granularity == "month":
        return F.concat(year.cast("string"), F.lit("-"), F.lpad(F.month(scan_ts).cast("string"), 2, "0"))
    return year.cast("bigint")


def format_size(size_bytes: Column) -> Column:
    """Readable size with two decimals in the largest unit that fits, else plain bytes.

    Integer arithmetic, with ties rounded to even: ``format_string`` would round 1.125 up.
    """

    def unit(divisor: int, name: str) -> Column:
        rest = (size_bytes % divisor) * 100
        digits = F.floor(rest / F.lit(float(divisor)))
        over = (rest % divisor) * 2
        hundredths = F.floor(size_bytes / F.lit(float(divisor))) * 100 + digits
        up = F.when((over > divisor) | ((over == divisor) & (hundredths % 2 == 1)), 1).otherwise(0)
        total = hundredths + up
        whole = F.floor(total / F.lit(100.0)).cast("string")
        return F.concat(whole, F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"), F.lit(f" {name}"))

    return (
        F.when(size_bytes >= GB, unit(GB, "GB"))
        .when(size_bytes >= MB, unit(MB, "MB"))
        .when(size_bytes >= KB, unit(KB, "KB"))
        .when(size_bytes.isNotNull(), F.concat(size_bytes.cast("string"), F.lit(" bytes")))
    )


def target_path(cls: Column, sha256: Column) -> Column:
    """Path of a wanted file below the download root; NULL where there is no hash to ask for."""
    return F.when(F.length(sha256) > 0, F.concat(cls, F.lit("/"), F.lower(sha256), F.lit(".apk")))


def content_hash(content: Column) -> Column:
    """SHA-256 of file content, lower-case hex; the empty string where there is no content to hash."""
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def timestamp_like(text: str, dtype: T.DataType) -> Column:
    """Literal of the column's own timestamp type, so that comparing needs no cast and can be pushed down."""
    return F.lit(text).cast(dtype)


def is_play_market(market: Column) -> Column:
    """Exactly the Play market once trimmed; a list of several markets does not match."""
    return trimmed_market(market) == PLAY_MARKET


def has_detection(raw: Column) -> Column:
    """Neither NULL nor the empty string."""
    return raw.isNotNull() & (raw != "")


def is_malware_lenient(raw: Column, threshold: int) -> Column:
    """Row predicate on raw text: missing counts as -1, text that is no integer is never malware."""
    score = F.when(has_detection(raw), parse_detection(raw)).otherwise(F.lit(-1))
    return F.coalesce(score >= threshold, F.lit(False))


def is_within_date_range(raw: Column, date_start: str, date_end: str) -> Column:
    """Row predicate on raw text: false where the date is missing or does not parse.

    Unlike the column parser it takes months, days and times of one digit.
    """
    ts = F.when(raw.rlike(LENIENT_DATE_REGEX), F.try_to_timestamp(raw, F.lit("yyyy-M-d H:m:s")))
    low, high = F.lit(date_start).cast("timestamp"), F.lit(date_end).cast("timestamp")
    return F.coalesce(ts.between(low, high), F.lit(False))
