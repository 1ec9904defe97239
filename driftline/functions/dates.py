"""Dates: printed fragments, precision, due dates, rounding rules."""

from __future__ import annotations

import functools
import re
import unicodedata
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names as the parsers of printed dates read them, in full, by three letters, or as "sept".
MONTH_NAMES = "january february march april may june july august september october november december".split()
MONTH = "(?:" + "|".join(x for m in MONTH_NAMES for x in dict.fromkeys((m, *(["sept"] if m == "september" else []), m[:3]))) + ")"
#: Pieces of printed dates: what follows a day number, what parts month and day, what joins the ends of a range.
ORDINAL, GAP, DASH = r"(?:st|nd|rd|th)?", r"(?:\.\s*|\s+)", r"\s*[-–—]\s*"


def _date(y: Column, m: Column, d: Column) -> Column:
    """A date of three integers, or null if they make none."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


_NAMED, _CLOSING = rf"(?P<m>{MONTH})", rf"(?P<m2>{MONTH})"
#: The ways in which a date is printed, the most specific first, and how much of it each states.
PRINTED = (
    ("day", r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})(?![\d-])"),
    ("day", rf"{_NAMED}{GAP}(?P<d>\d{{1,2}}){ORDINAL}{DASH}(?:{_CLOSING}\.?\s+)?\d{{1,2}}{ORDINAL},?\s+(?P<y>\d{{4}})\b"),
    ("day", rf"{_NAMED}{GAP}(?P<d>\d{{1,2}}){ORDINAL},?\s+(?P<y>\d{{4}})\b"),
    ("day", rf"(?P<d>\d{{1,2}}){ORDINAL}\s+{_NAMED}\.?,?\s+(?P<y>\d{{4}})\b"),
    ("month", rf"{_NAMED}\.?,?\s+(?P<y>\d{{4}})\b"),
    ("month", r"(?P<y>\d{4})-(?P<m>\d{1,2})(?!\d|-)"),
    ("inferred", rf"{_NAMED}{GAP}(?P<d>\d{{1,2}}){ORDINAL}(?!\d)"),
    ("inferred", rf"(?P<d>\d{{1,2}}){ORDINAL}\s+{_NAMED}\.?(?!\w)"),
    ("year", r"^\W*(?P<y>20\d{2})\b"),
)
#: Before each: what must be there, a month's name or a year and a dash.
_PRINTED = [("month" if "(?:january" in pattern else "iso" if "-" in pattern else "", precision, re.compile(pattern, re.IGNORECASE)) for precision, pattern in PRINTED]
_SHORT = tuple(m[:3] for m in MONTH_NAMES)
_ANY_MONTH, _ANY_DIGIT, _ANY_ISO = re.compile("|".join(_SHORT), re.IGNORECASE), re.compile(r"\d"), re.compile(r"\d{4}-\d")
DATE = "value date, precision string, text string, month int, day int, year_missing boolean"


def _month_number(name: str | None) -> int | None:
    if name is None or name.isdigit():
        return int(name) if name else None
    return next(i for i, m in enumerate(MONTH_NAMES, 1) if m.startswith(name[:3].lower()))


def _names_month(text: str) -> bool:
    if not text.isascii():
        return bool(_ANY_MONTH.search(text))
    low = text.lower()
    for m in _SHORT:
        if m in low:
            return True
    return False


def read_date(text: str | None) -> tuple | None:
    """Value, precision, text, month, day and whether the year is missing; see ``parse_date_fragment``."""
    if not text or not _ANY_DIGIT.search(text):
        return None
    has = {"month": _names_month(text), "iso": "-" in text and _ANY_ISO.search(text), "": True}
    for need, precision, pattern in _PRINTED:
        if not has[need] or not (found := pattern.search(text)):
            continue
        part = found.groupdict()
        year, month, day = (int(part["y"]) if part.get("y") else None), _month_number(part.get("m")), (int(part["d"]) if part.get("d") else None)
        if year is None:
            return None, precision, found[0], month, day, True
        if part.get("m2") and _month_number(part["m2"]) < month:
            year -= 1  # a range over the turn of the year begins in the year before
        try:
            value = date(year, month or 1, day or 1)
        except ValueError:
            continue
        return value, precision, found[0], month, day, False
    return None


def _read_dates(texts: pd.Series) -> pd.DataFrame:
    rows = [read_date(t) or (None,) * 6 for t in texts]
    columns = dict(zip([c.split()[0] for c in DATE.split(", ")], zip(*rows, strict=True), strict=True)) if rows else {}
    return pd.DataFrame({c.split()[0]: pd.Series(columns.get(c.split()[0], []), dtype={"int": "Int32", "boolean": "boolean"}.get(c.split()[1], object)) for c in DATE.split(", ")})


def parse_date_fragment(text: Column) -> Column:
    """struct(value, precision, text, month, day, year_missing) of the date that a text states; null if none.

    The most specific kind that the text holds wins: day with year (also as a range, which means its first day), month
    with year, year-month, day without year (``inferred``, no value), and a year at the beginning of the text. The patterns
    run compiled, in Arrow batches: as expressions of the JVM they are more code than Spark can compile into one stage.
    """
    found = F.pandas_udf(_read_dates, DATE)(text)
    return F.when(found["precision"].isNotNull(), found)


def with_year(parsed: Column, year: Column) -> Column:
    """A parsed date whose year was missing, in the year that its surroundings give; others, and days that the year lacks, as they are."""
    value = _date(year, parsed["month"], F.coalesce(parsed["day"], F.lit(1)))
    made = F.struct(value.alias("value"), F.when(parsed["day"].isNotNull(), "day").otherwise("month").alias("precision"), parsed["text"].alias("text"), parsed["month"].alias("month"), parsed["day"].alias("day"), F.lit(False).alias("year_missing"))
    return F.when(parsed["year_missing"] & parsed["month"].isNotNull() & value.isNotNull(), made).otherwise(parsed)


def stated_alone(text: Column, found: Column) -> Column:
    """Whether the date stands by itself: not glued to a word, number, hyphen, underscore, slash or dot before it."""
    at = F.instr(text, found)
    return (at > 0) & ((at == 1) | ~F.substring(text, at - 1, 1).rlike(r"(?U)[\w/.-]"))


def in_year(parsed: tuple, year: int | None) -> tuple:
    """``with_year`` of what ``read_date`` gives."""
    _, _, text, month, day, year_missing = parsed
    if not year_missing or year is None or month is None:
        return parsed
    try:
        return date(year, month, 1 if day is None else day), "month" if day is None else "day", text, month, day, False
    except ValueError:
        return parsed


@functools.lru_cache(1024)
def _glues(before: str) -> bool:
    """Whether a character is a word's, a slash, dot or hyphen, by what the JVM's ``(?U)[\\w/.-]`` takes for one."""
    if before.isascii():
        return before.isalnum() or before in "_/.-"
    return unicodedata.category(before) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Me", "Mc", "Nd", "Pc") or any(a <= before <= b for a, b in _LETTERED)


#: Symbols that count as letters: circled and squared ones, and joiners.
_LETTERED = (("\u200c", "\u200d"), ("\u24b6", "\u24e9"), ("\U0001f130", "\U0001f149"), ("\U0001f150", "\U0001f169"), ("\U0001f170", "\U0001f189"))


def is_alone(text: str, found: str) -> bool:
    """``stated_alone`` of texts in Python."""
    at = text.find(found)
    return at == 0 or at > 0 and not _glues(text[at - 1])


def stated_date(value: Column) -> Column:
    """``YYYY[-MM[-DD]]`` as struct(value, precision); anything else is null."""
    y, m, d = (F.regexp_extract(value, r"^\s*(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?\s*$", i) for i in (1, 2, 3))
    full = F.try_to_date(F.concat(y, F.lit("-"), F.when(m == "", "01").otherwise(m), F.lit("-"), F.when(d == "", "01").otherwise(d)), "yyyy-MM-dd")
    return F.struct(F.when(y != "", full).alias("value"), F.when(full.isNotNull() & (y != ""), F.when(m == "", "year").when(d == "", "month").otherwise("day")).alias("precision"))


def period_end(day: Column, precision: Column) -> Column:
    """Last day that a date of this precision may mean."""
    return F.when(precision == "month", F.last_day(day)).when(precision == "year", F.make_date(F.year(day), F.lit(12), F.lit(31))).otherwise(day)


def due_date(dates: Column, as_of: Column) -> Column:
    """The nearest date not before ``as_of``, else the latest one."""
    ahead = F.array_min(F.filter(dates, lambda d: d >= as_of))
    return F.coalesce(ahead, F.array_max(dates))


def card_due_date(facts: Column, as_of: Column) -> Column:
    """struct(value, precision) of the date that a card is about: the due date among its stated sunset and effective dates.

    ``facts`` are structs ``kind, value, value_date, precision``. Inferred dates never lead; without any date the value is null, the precision ``day``.
    """
    dated = F.filter(facts, lambda f: f["value_date"].isNotNull() & f["kind"].isin("sunset_date", "effective_date") & (f["precision"] != "inferred"))
    best = due_date(F.transform(dated, lambda f: f["value_date"]), as_of)
    first = F.get(F.filter(dated, lambda f: f["value_date"] == best), F.lit(0))
    return F.struct(best.alias("value"), F.coalesce(first["precision"], F.lit("day")).alias("precision"))


def score_due_date(facts: Column, kinds: tuple[str, ...], as_of: Column) -> Column:
    """The due date that scoring takes: of all facts of the kinds, inferred ones too, read from ``value`` where no date is given."""
    dates = F.transform(F.filter(facts, lambda f: f["kind"].isin(*kinds)), lambda f: F.coalesce(f["value_date"], F.try_to_date(f["value"], "yyyy-MM-dd")))
    return due_date(F.filter(dates, lambda d: d.isNotNull()), as_of)


def half_up(x: Column) -> Column:
    """floor(x + 0.5)."""
    return F.floor(x + 0.5)


def relevance(x: Column) -> Column:
    """Half-even rounding, clamped to 0..100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(x, 0).cast("int")))
