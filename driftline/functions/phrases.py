"""Words for readers: Russian plurals, dates with their distance, first letters, slugs, names and fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of "day", months of a date and of a month by itself, notes, and what a fence marker looks like.
DAY_FORMS = ("день", "дня", "дней")
GENITIVE = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
NOMINATIVE = "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь".split()
YEAR_NOT_STATED = "год не указан в источнике"
MARKER = r"(?i)=*\s*(?:BEGIN|END)\s+MATERIAL[^\n]*"


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The form that a number takes in Russian."""
    tail = F.abs(n) % 100
    last = tail % 10
    return F.when(tail.between(11, 14), many).when(last == 1, one).when(last.between(2, 4), few).otherwise(many)


def count_phrase(n: Column, forms: tuple[str, str, str]) -> Column:
    return F.concat_ws(" ", n.cast("string"), plural(n, *forms))


def distance_phrase(day: Column, today: Column) -> Column:
    """today, tomorrow, yesterday, or the number of days."""
    n = F.datediff(day, today)
    near = F.when(n == 0, "сегодня").when(n == 1, "завтра").when(n == -1, "вчера")
    return near.when(n > 0, F.concat_ws(" ", F.lit("через"), count_phrase(n, DAY_FORMS))).otherwise(F.concat_ws(" ", count_phrase(-n, DAY_FORMS), F.lit("назад")))


def format_date(day: Column, today: Column, precision: Column) -> Column:
    """A date as messages print it: near days by their name, others with the distance; coarse and inferred dates without it."""
    name = lambda names: F.element_at(F.array(*map(F.lit, names)), F.month(day))
    plain = F.concat_ws(" ", F.dayofmonth(day).cast("string"), name(GENITIVE))
    near = F.abs(F.datediff(day, today)) <= 1
    full = F.when(near, distance_phrase(day, today)).otherwise(F.concat_ws(", ", plain, distance_phrase(day, today)))
    return F.when(precision == "year", F.year(day).cast("string")).when(precision == "month", F.concat_ws(" ", name(NOMINATIVE), F.year(day).cast("string"))).when(precision == "inferred", F.concat(plain, F.lit(f" ({YEAR_NOT_STATED})"))).otherwise(full)


def sentence(text: Column) -> Column:
    """Blanks collapsed, the first letter raised unless the first word is a model name (lower case, a digit, joined parts)."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    first = F.regexp_replace(F.substring_index(t, " ", 1), "[:,.]+$", "")
    identifier = first.rlike(r"(?U)^[a-z][\w.@/-]*$") & first.rlike(r"\d") & first.rlike("[-./]")
    return F.when(identifier, t).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30)))


def neutralize(text: Column) -> Column:
    """A material without anything that could close its fence in a prompt."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), MARKER, "[marker removed]"), "={5,}", "---")


def source_slug(full_name: Column) -> Column:
    """Id of the source that a repository becomes."""
    return F.concat(F.lit("gh_"), F.lower(F.translate(full_name, "/-", "__")))


def run_id(at: Column, salt: Column) -> Column:
    """Time stamp and six hex digits of a salt (a random one for new runs)."""
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.substring(F.sha2(salt, 256), 1, 6))


def human_name(value: Column, label: Column) -> Column:
    """The configured label, else the slug spelt out."""
    return F.coalesce(F.when(F.trim(label) != "", label), sentence(F.regexp_replace(value, "[_-]+", " ")))
