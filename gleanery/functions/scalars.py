"""Scalar functions as Columns; all take columns or their names and run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that count as booleans, in any case.
TRUE_WORDS = ("TRUE", "YES", "ON")
FALSE_WORDS = ("FALSE", "NO", "OFF")
DAY, SECOND = "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'"
#: One extra pattern stops day roll-over: text must match before it is parsed.
_DAY_TEXT, _SECOND_TEXT = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
#: Decimal and hexadecimal floating-point literals, infinities and NaN, with an optional type suffix.
_NUMBER = r"^[\x00-\x20]*[+-]?(NaN|Infinity|((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)[fFdD]?)[\x00-\x20]*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java_trim(x) -> Column:
    """Drop all characters up to U+0020 at both ends."""
    return F.regexp_replace(_c(x), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def boolean_word(x) -> Column:
    """TRUE/YES/ON and FALSE/NO/OFF in any case; null otherwise."""
    word = F.upper(_c(x))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def number(x) -> Column:
    """A floating-point literal as double; null otherwise."""
    return F.when(_c(x).rlike(_NUMBER), F.regexp_replace(java_trim(x), "[fFdD]$", "").try_cast("double"))


def integer(x) -> Column:
    """An optional sign and digits within 64 bits; null otherwise."""
    return F.when(_c(x).rlike(r"^[+-]?\d+$"), _c(x).try_cast("bigint"))


def oai_date(x) -> Column:
    """A strict UTC day or second as timestamp; null otherwise. A day is its midnight."""
    x = _c(x)
    day = F.when(x.rlike(_DAY_TEXT), F.try_to_timestamp(x, F.lit(DAY)))
    second = F.when(x.rlike(_SECOND_TEXT), F.try_to_timestamp(x, F.lit(SECOND)))
    return F.coalesce(day, second)


def oai_text(ts, seconds: bool = True) -> Column:
    return F.date_format(_c(ts), SECOND if seconds else DAY)


def index_text(ts) -> Column:
    """Milliseconds and Z, as stored in an index."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stored_instant(x) -> Column:
    """A stored ISO instant (with Z) as timestamp; null for anything else."""
    x = _c(x)
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?Z$"), x.try_cast("timestamp"))


def http_date(x) -> Column:
    """The date of an HTTP header as timestamp; null otherwise."""
    rest = F.regexp_extract(_c(x), r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2} GMT)$", 1)
    return F.try_to_timestamp(F.nullif(rest, F.lit("")), F.lit("dd MMM yyyy HH:mm:ss z"))


def epoch_millis(ms) -> Column:
    return F.when(_c(ms) >= 0, F.timestamp_millis(_c(ms)))


def mime(content_type) -> Column:
    """The bare media type, in lower case; null if there is none."""
    return F.nullif(F.lower(F.trim(F.substring_index(_c(content_type), ";", 1))), F.lit(""))


def charset(content_type) -> Column:
    return F.nullif(F.regexp_extract(F.lower(_c(content_type)), r"charset\s*=\s*\"?([^;\"\s]+)", 1), F.lit(""))


def split_list(x) -> Column:
    """Parts between commas, semicolons and blanks; distinct, none empty."""
    return F.array_distinct(F.filter(F.split(_c(x), r"[,;\s]+"), lambda p: p != ""))


def no_fragment(url) -> Column:
    return F.substring_index(_c(url), "#", 1)


def base_directory(url) -> Column:
    """The URL up to its last slash."""
    return F.regexp_replace(_c(url), "[^/]*$", "")


def last_segment(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def prefixed(prefix: str, x) -> Column:
    return F.concat(F.lit(prefix), _c(x).cast("string"))


def rolled_date(year, month, day) -> Column:
    """A date whose month and day may lie outside their range and then roll over."""
    return F.date_add(F.add_months(F.make_date(_c(year), F.lit(1), F.lit(1)), _c(month) - 1), _c(day) - 1)


def byte_size(text: str) -> int:
    """A size with a unit, such as 5MB; a bare number means bytes."""
    units = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "p": 1 << 50, "pb": 1 << 50}
    digits = text.strip().rstrip("bBkKmMgGtTpP ")
    unit = text.strip()[len(digits) :].strip().lower()
    return int(float(digits) * units[unit])


def host_port(text: str, default_port: int) -> tuple[str, int]:
    """host, host:port, [v6] or [v6]:port; a bare v6 address has the default port."""
    text = text.strip()
    if text.startswith("["):
        host, bracket, rest = text[1:].partition("]")
        if not bracket or (rest and not rest.startswith(":")):
            raise ValueError(f"bad address: {text}")
        port = rest[1:]
    elif text.count(":") == 1:
        host, _, port = text.partition(":")
    else:
        host, port = text, ""
    number_ = int(port) if port else default_port
    if not host or not 0 <= number_ <= 65535:
        raise ValueError(f"bad address: {text}")
    return host, number_
