"""Date and clock scalars as Column expressions; dates keep their written zone, so they stay strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import _c, trim_space

#: English names of months and weekdays, and words and zones that lines with dates hold.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
SHORT_WEEKDAYS = "mon tue tues wed thu thurs fri sat sun".split()
DATE_WORDS = "updated published posted last modified on at am pm hour hours minute minutes day days ago original of".split()
ZONES = "gmt utc bst cet cest ist aest jst".split()
RETRY_LIMIT_MS = 15 * 60 * 1000


def _month_names() -> dict[str, int]:
    """Every month's number by its name, its first three letters, and sept."""
    names = {m: i for i, m in enumerate(MONTHS, 1)}
    return names | {m[:3]: i for m, i in names.items()} | {"sept": 9}


def month_number(name: Column) -> Column:
    """Two digits for an English month name or its short form; null otherwise."""
    names = F.create_map(*[F.lit(v) for m, i in sorted(_month_names().items()) for v in (m, f"{i:02d}")])
    return F.try_element_at(names, F.lower(name))


def _mask(x: Column) -> Column:
    """The value with every digit as 9: its shape."""
    return F.translate(x, "012345678", "999999999")


def _numeric_date(v: Column) -> Column:
    """A date of digits alone: dashed, with or without a clock, or run together; null for other shapes."""
    shape = _mask(v)
    clock, rest = F.substring(v, 12, 5), F.substr(v, F.lit(17))
    timed = F.substring(shape, 11, 6).isin("T99:99", " 99:99")
    seconds = F.substring(_mask(rest), 1, 3) == ":99"
    second = F.when(seconds, F.substring(rest, 2, 2)).otherwise("00")
    tail = F.when(seconds, F.regexp_replace(F.substr(rest, F.lit(4)), r"^\.\d+", "")).otherwise(rest)
    tail = F.ltrim(tail)
    sign, offset = F.substring(tail, 1, 1), _mask(F.substr(tail, F.lit(2)))
    zone = (
        F.when(sign == "Z", "Z")
        .when(sign.isin("+", "-") & offset.startswith("99:99"), F.substring(tail, 1, 6))
        .when(sign.isin("+", "-") & offset.startswith("9999"), F.concat(F.substring(tail, 1, 3), F.lit(":"), F.substring(tail, 4, 2)))
        .otherwise("")
    )
    dashed = F.when(timed, F.concat(F.substring(v, 1, 10), F.lit("T"), clock, F.lit(":"), second, zone)).otherwise(F.substring(v, 1, 10))
    bare = F.replace(shape, F.lit("T"), F.lit(""))
    run = F.length(bare).isin(8, 12, 14) & (F.replace(bare, F.lit("9"), F.lit("")) == "") & ((bare == shape) | (F.locate("T", shape) == 9) & (F.length(bare) > 8))
    return F.when(shape.startswith("9999-99-99"), dashed).when(run, F.concat_ws("-", F.substring(v, 1, 4), F.substring(v, 5, 2), F.substring(v, 7, 2)))


def _once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _spelled_date(words: Column) -> Column:
    """Three words in a row that are month, day, year, or day, month, year."""
    at = F.when(F.size(words) > 2, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    word = lambda i, k: F.get(words, i + k)
    month = lambda w: month_number(F.regexp_extract(w, r"([A-Za-z]+)[.]?,?$", 1))
    day = lambda w: F.nullif(F.regexp_extract(w, r"(?i)(\d{1,2})(?:st|nd|rd|th)?[.]?,?$", 1), F.lit(""))
    year = lambda w: F.nullif(F.regexp_extract(w, r"^(\d{4})", 1), F.lit(""))
    date = lambda y, m, d: F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.concat_ws("-", y, m, F.lpad(d, 2, "0")))
    first = lambda f: F.try_element_at(F.filter(F.transform(at, f), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(first(lambda i: date(year(word(i, 2)), month(word(i, 0)), day(word(i, 1)))), first(lambda i: date(year(word(i, 2)), month(word(i, 1)), day(word(i, 0)))))


def normalize_date(x: Column | str) -> Column:
    """ISO form of a value that is, or plainly spells, a date; null otherwise."""
    return _once(trim_space(x), lambda v: F.coalesce(_numeric_date(v), _once(F.split(v, r"\s+"), _spelled_date)))


def iso_micros(x: Column | str) -> Column:
    """Microseconds of a canonical UTC timestamp of 0 to 6 fraction digits; null where it is none.

    Impossible dates are none: the parsed time must spell the same seconds.
    """
    s = _c(x)
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z$"
    seconds = F.try_to_timestamp(F.when(s.rlike(shape), F.substring(s, 1, 19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    fraction = F.rpad(F.regexp_extract(s, r"\.(\d{1,6})Z$", 1), 6, "0")
    return F.unix_micros(F.to_timestamp_ltz(seconds)) + F.when(s.contains("."), fraction.cast("long")).otherwise(0)


def is_date_line(x: Column | str) -> Column:
    """A line of at most 100 characters with a digit, in which fewer than three characters belong to no date, time or word like "updated".

    Runs of letters and digits are looked up whole; of a run that is no date
    word its letters are left over, and so is any mark that dates don't have.
    """
    s = F.replace(F.replace(F.lower(_c(x)), F.lit("a.m"), F.lit("am")), F.lit("p.m"), F.lit("pm"))
    known = [*_month_names(), *WEEKDAYS, *SHORT_WEEKDAYS, *DATE_WORDS, *ZONES]
    american = r"^[a-z]?[ecmp][sd]t$"  # est, pdt, aedt: a coast's letter before standard or daylight time
    runs = F.regexp_extract_all(s, F.lit("[a-z0-9_]+"), 0)
    unknown = F.filter(runs, lambda w: ~w.isin(known) & ~w.rlike(american))
    letters = F.aggregate(unknown, F.lit(0), lambda n, w: n + F.length(F.translate(w, "0123456789", "")))
    marks = F.length(F.regexp_replace(s, r"[a-z0-9_\s.,:;|/·•@\-–—()]+", ""))
    return (F.length(_c(x)) <= 100) & s.rlike("[0-9]") & (letters + marks < 3)


def next_stamp(now_ms: Column | str, previous_ms: Column | str) -> Column:
    """Now, or one millisecond after the previous stamp."""
    return F.greatest(_c(now_ms), _c(previous_ms) + 1)


def retry_delay_ms(interval_ms: Column | str, failures: Column | str) -> Column:
    """The interval doubled for each failure, 16 times at most, up to 15 minutes."""
    return F.least(_c(interval_ms) * F.pow(F.lit(2), F.least(_c(failures), F.lit(16))), F.lit(RETRY_LIMIT_MS)).cast("long")
