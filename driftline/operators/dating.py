"""When an event happened, and why that matters: the page decides, a model's reading only points at it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions import dates as D
from driftline.functions import phrases as P
from driftline.functions import text as T
from driftline.operators import evidence as E

#: Wordings that call a deadline off, and that say a thing stays alive; clauses of the text for readers.
CALLS_OFF = r"(?iU)\b(отмен\w+|не\s+будет|не\s+состо\w+|сохран\w+|оста[её]тся|остаются|продлен\w+|перенес\w+|отложен\w+)\b"
KEEPS_ALIVE = r"(?iU)\b(оста[её]тся\s+активн\w+|останется\s+активн\w+|получит\s+статус\s+активн\w+|актив(?:на|ен|ным)\b|не\s+ранее|не\s+раньше|not\s+sooner)\b"
BREAKS, ENDANGERS, TOUCHES = "работающий код перестанет работать без правки", "затрагивает безопасность", "затронуто: "
PRODUCTS = 3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def printed_in(day: Column, precision: Column, text: Column) -> Column:
    """Whether a text prints a date in one of the forms that changelogs use; ``text`` is folded already."""
    exact = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d", "MMM.d")
    coarse = ("yyyy-MM", "MMMM yyyy", "yyyy")
    held = lambda forms: F.greatest(*[F.contains(text, F.lower(F.date_format(day, f))) for f in forms])
    return F.coalesce(F.when(precision.isin("month", "year"), held(coarse)).otherwise(held(exact)), F.lit(False))


def resolve_date(event_date: Column, printed: Column, text: Column, item_date: Column, item_precision: Column, published: Column) -> Column:
    """struct(value, precision, reason) of an event: what the page prints, else the collector's date; the reason says what was refused.

    ``event_date`` is the model's ISO reading, ``printed`` its pointer into the page. A pointer that the page does not hold,
    a date without one that is printed nowhere, and a pointer that is no date are refused. A date without its year takes
    the year of the item (``item_date``, else ``published``) and says so (``inferred``).
    """
    said = F.trim(F.coalesce(printed, F.lit("")))
    stated = D.stated_date(F.coalesce(event_date, F.lit("")))
    parts = F.struct(
        said.alias("said"),
        stated.alias("stated"),
        D.parse_date_fragment(said).alias("parsed"),
        (E.verify_evidence(said, text) == "").alias("held"),
        T.normalize_for_match(text).alias("page"),
        F.year(F.coalesce(item_date, F.to_date(published))).alias("year"),
        item_date.alias("item"),
        item_precision.alias("item_precision"),
    )
    none = F.lit(None)

    def out(v: Column, p: Column | str, reason: str | None = None) -> Column:
        return F.struct(v.cast("date").alias("value"), (F.lit(p) if isinstance(p, str) else p).alias("precision"), F.lit(reason).cast("string").alias("reason"))

    def decide(x: Column) -> Column:
        value, precision, parsed = x["stated"]["value"], x["stated"]["precision"], x["parsed"]
        fallback = lambda reason=None: F.when(x["item"].isNotNull(), out(x["item"], x["item_precision"], reason)).otherwise(out(none, "day", reason))
        known = value.isNotNull() & (x["item"].eqNullSafe(value) | printed_in(value, precision, x["page"]))
        pointed = F.when(~x["held"], fallback("date_not_in_source"))
        pointed = pointed.when(parsed["value"].isNotNull(), out(parsed["value"], parsed["precision"]))
        pointed = pointed.when(F.coalesce(parsed["year_missing"], F.lit(False)), out(D.with_year(parsed, x["year"])["value"], "inferred"))
        pointed = pointed.when(known, out(value, precision)).when(value.isNotNull(), fallback("date_not_printed")).otherwise(fallback())
        bare = F.when(value.isNull(), fallback()).when(known, out(value, precision)).otherwise(fallback("date_without_quote"))
        return F.when(x["said"] == "", bare).otherwise(pointed)

    return _let(parts, decide)


def fact_date(value: Column, quote: Column, item_date: Column, published: Column) -> Column:
    """struct(value, precision) of a dated fact: read from its value, else from its quote; a missing year is the item's, and said to be."""
    read = lambda text: D.parse_date_fragment(F.trim(F.coalesce(text, F.lit(""))))
    parts = F.struct(read(value).alias("a"), read(quote).alias("b"), F.year(F.coalesce(item_date, F.to_date(published))).alias("year"))

    def decide(x: Column) -> Column:
        def of(p: Column) -> Column:
            placed = F.struct(D.with_year(p, x["year"])["value"].alias("value"), F.lit("inferred").alias("precision"))
            return F.when(p["value"].isNotNull(), F.struct(p["value"].alias("value"), p["precision"].alias("precision"))).when(p["year_missing"], placed)

        return F.coalesce(of(x["a"]), of(x["b"]), F.struct(F.lit(None).cast("date").alias("value"), F.lit("day").alias("precision")))

    return _let(parts, decide)


def why_it_matters(change_type: Column, statement: Column, due: Column, subject: Column, products: Column, as_of: Column) -> Column:
    """Why a card deserves attention, from verified facts alone: the deadline, what breaks, and the first products."""
    said, n = F.coalesce(statement, F.lit("")), F.datediff(due, as_of)
    head = F.when(F.coalesce(subject, F.lit("")) != "", F.concat(subject, F.lit(": "))).otherwise("")
    named = F.concat(F.lit("дата, о которой идёт речь — "), F.dayofmonth(due).cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, P.GENITIVE)), F.month(due)))
    ahead = F.concat(F.lit("срок наступает через "), P.count_phrase(n, P.DAY_FORMS))
    gone = F.concat(F.lit("срок истёк "), P.count_phrase(-n, P.DAY_FORMS), F.lit(" назад"))
    deadline = F.when(due.isNotNull(), F.concat(head, F.when(said.rlike(CALLS_OFF), named).when(n > 0, ahead).when(n < 0, gone).otherwise("срок сегодня")))
    harm = F.when(change_type.isin("deprecation", "breaking_change") & ~said.rlike(KEEPS_ALIVE), BREAKS).when(change_type == "security", ENDANGERS)
    some = F.slice(F.array_distinct(F.coalesce(products, F.expr("cast(array() as array<string>)"))), 1, PRODUCTS)
    touched = F.when(F.size(some) > 0, F.concat(F.lit(TOUCHES), F.array_join(some, ", ")))
    clauses = F.filter(F.array(deadline, harm, touched), lambda c: c.isNotNull())
    return F.array_join(F.transform(clauses, P.sentence), ". ")
