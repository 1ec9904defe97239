"""Surfaces: context notes, headlines and the texts that channels get."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Months in the genitive, ordinals of a note, size of a message, cards it shows.
GENITIVE = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
ORDINALS = {2: "второй", 3: "третий", 4: "четвёртый", 5: "пятый"}
MESSAGE_CHARS = 4096
NOTIFICATION_CHARS = 40
CARDS = 5
#: Lengths of headlines, the endings and prepositions that open a dependent tail, and a change type as predicate and preposition.
HEADLINE_MIN, HEADLINE_COMFORT, HEADLINE_LONG = 15, 110, 130
TAIL = r"(?:[а-яё]{4,}(?:ая|яя|уя|юя|ые|ый|ое|ых|ее|ие|его|ей|ем|ую|ою|им|ыми|ими)|с|со|для|при|без|ради|вместо)\b"
PREDICATES = {
    "deprecation": ("объявляет об отключении", ""), "breaking_change": ("вносит ломающее изменение", "в"), "pricing": ("меняет цену", "на"), "limits": ("меняет лимиты", "в"),
    "security": ("публикует изменение в безопасности", "для"), "release": ("выпускает", ""), "other": ("сообщает об изменении", "в"),
}
ROUTINE = ("release", "other")


def day_month(day: Column) -> Column:
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(F.array(*map(F.lit, GENITIVE)), F.month(day)))


def context_note(vendor: Column, type_label: Column, change_type: Column, label: Column, shown: Column, dated: Column, total: Column, earliest: Column, as_of: Column) -> Column:
    """"N-th time since D", or null: routine type, no pattern, fewer than two dated records, or nothing before today."""
    count = F.greatest(F.coalesce(total, shown), shown) + 1
    names = F.create_map(*[x for k, v in ORDINALS.items() for x in (F.lit(k), F.lit(v))])
    head = F.coalesce(F.concat(F.try_element_at(names, count.cast("int")), F.lit(" раз")), F.concat(count.cast("string"), F.lit("-й раз")))
    since = F.concat(F.lit("с "), day_month(earliest), F.when(F.year(earliest) == F.year(as_of), "").otherwise(F.concat(F.lit(" "), F.year(earliest).cast("string"), F.lit(" года"))))
    silent = label.isNull() | (label == "not_found_in_corpus") | change_type.isin(*ROUTINE) | (dated < 2) | (earliest >= as_of)
    return F.when(~silent, F.concat(vendor, F.lit(": "), F.lower(type_label), F.lit(", "), head, F.lit(" "), since, F.lit(".")))


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_url(url: Column) -> Column:
    return F.when(url.rlike(r"^https?://[^\s\"<>]+$"), url).otherwise("#")


def shorten(text: Column, n: Column | int) -> Column:
    """Cut at the last blank before ``n`` characters, with an ellipsis."""
    n = F.lit(n)
    cut = F.regexp_replace(F.substring(text, F.lit(1), n - 1), r"\s+\S*$", "")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("…")))


def first_claim(statement: Column) -> Column:
    """The first clause of a statement; parentheses go above 110 characters, and above 130 a dependent tail from its first comma on."""
    first = F.get(F.split(F.trim(statement), r"(?<=[.!?;])\s+", 2), F.lit(0))
    first = F.trim(F.regexp_replace(F.regexp_replace(F.trim(first), r"^[,;]+|[,;]+$", ""), r"\.+$", ""))

    def clause(first: Column) -> Column:
        bare = F.trim(F.regexp_replace(first, r"\s*\([^()]{0,120}\)", ""))
        return F.when(F.length(first) > HEADLINE_COMFORT, _let(bare, lambda b: F.when(F.length(b) >= HEADLINE_MIN, b).otherwise(first))).otherwise(first)

    def without_tail(clause: Column) -> Column:
        head = F.regexp_extract(clause, rf"(?isU)^(.{{{HEADLINE_MIN},}}?), {TAIL}", 1)
        return F.when(F.length(clause) > HEADLINE_LONG, _let(head, lambda h: F.when(h != "", F.regexp_replace(h, r"[ ,]+$", "")).otherwise(clause))).otherwise(clause)

    return _let(_let(first, clause), without_tail)


def _reads_as_claim(text: Column) -> Column:
    return F.coalesce((F.length(text) >= HEADLINE_MIN) & text.rlike("(?iu)[а-яё]"), F.lit(False))


def headline_subject(product: Column, facts: Column) -> Column:
    """What a change is about: the product, else the first affected product among the facts, else the first subject of one; null if none."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    affected = F.get(F.filter(facts, lambda f: (f["kind"] == "affected_product") & filled(f["value"]).isNotNull()), F.lit(0))["value"]
    named = F.get(F.filter(facts, lambda f: filled(f["subject"]).isNotNull()), F.lit(0))["subject"]
    return F.coalesce(filled(product), filled(affected), filled(named))


def headline_date(facts: Column, subject: Column) -> Column:
    """"с D month Y года": the subject's first date, or the only day that all dates name; only days and months that are stated count."""
    dated = F.filter(facts, lambda f: f["value_date"].isNotNull() & f["kind"].isin("sunset_date", "effective_date") & f["precision"].isin("day", "month"))
    pick = lambda rows: F.get(F.array_sort(F.transform(rows, lambda f, i: F.struct(f["value_date"].alias("d"), i.alias("i"), f["precision"].alias("p")))), F.lit(0))
    owned = lambda rows: F.filter(rows, lambda f: F.coalesce(F.trim(f["subject"]) == subject, F.lit(False)))
    one = lambda rows: F.size(F.array_distinct(F.transform(rows, lambda f: f["value_date"]))) == 1
    first = lambda rows: F.get(F.transform(rows, lambda f: F.struct(f["value_date"].alias("d"), F.lit(0).alias("i"), f["precision"].alias("p"))), F.lit(0))
    chosen = _let(dated, lambda rows: _let(owned(rows), lambda own: F.when(F.size(own) > 0, pick(own)).when(one(rows), first(rows))))
    day = lambda c: F.when(c["p"] == "day", F.concat(F.dayofmonth(c["d"]).cast("string"), F.lit(" "))).otherwise("")
    return _let(chosen, lambda c: F.concat(F.lit("с "), day(c), F.element_at(F.array(*map(F.lit, GENITIVE)), F.month(c["d"])), F.lit(" "), F.year(c["d"]).cast("string"), F.lit(" года")))


def composed_headline(vendor: Column, change_type: Column, type_label: Column, product: Column, facts: Column) -> Column:
    """Who did what with what, since when, from fields; without a vendor "type: subject", and null without that."""
    names = lambda n: F.create_map(*[F.lit(x) for k, v in PREDICATES.items() for x in (k, v[n])])
    kind = F.when(F.trim(change_type).isin(*PREDICATES), F.trim(change_type)).otherwise("other")
    does, to = F.element_at(names(0), kind), F.nullif(F.element_at(names(1), kind), F.lit(""))
    who = F.nullif(F.trim(vendor), F.lit(""))

    def about(subject: Column) -> Column:
        head = F.when(who.isNotNull(), F.concat_ws(" ", who, does, F.when(subject.isNotNull(), to), subject)).when(F.nullif(F.trim(change_type), F.lit("")).isNotNull(), F.concat(F.coalesce(type_label, F.trim(change_type)), F.lit(": "), subject))
        return _let(head, lambda h: F.when(h.isNotNull(), F.concat_ws(" ", h, headline_date(facts, subject))))

    return _let(headline_subject(product, facts), about)


def headline(statement: Column, vendor: Column, change_type: Column, type_label: Column, product: Column, facts: Column, title: Column) -> Column:
    """The first claim of the statement if it reads as one, else a headline composed from the fields if that does, else the title.

    ``facts`` are structs ``kind, value, subject, value_date, precision``.
    """
    facts = F.coalesce(facts, F.expr("cast(array() as array<struct<kind:string,value:string,subject:string,value_date:date,precision:string>>)"))
    claim, composed = first_claim(statement), composed_headline(vendor, change_type, type_label, product, facts)
    return _let(claim, lambda c: F.when(_reads_as_claim(c), c).otherwise(_let(composed, lambda h: F.when(_reads_as_claim(h), h).otherwise(title))))


def select_cards(signals: DataFrame) -> DataFrame:
    """What a digest shows: lead and standard items, or else the first quiet day or failure."""
    return signals.filter((F.col("signal_type") == "digest_item") & F.col("tier").isin("lead", "standard") | (F.col("signal_type") != "digest_item") & (F.col("rank") == 1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, as a variable, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fit_message(lead: Column, rows: Column, footer: Column, limit: int = MESSAGE_CHARS, gap: str = "\n\n") -> Column:
    """struct(message, fits, shown): a message of a lead card, compact rows and a footer, ``gap`` between them, shrunk by whole units until it fits.

    ``lead`` is a struct ``headline, url, summary (array), context, why``. Units go in this order: sentences of the summary
    but the first, the context, the reason, rows from the last, the summary, and at last the headline is halved down to
    ``NOTIFICATION_CHARS``; the address and the footer always stay. The states are laid out in order with the size of each
    from running sums, and only the first that fits is built, so nothing is cut inside a tag or an address.
    """
    some = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    sums = lambda parts: F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x) + 1))
    none = F.expr("cast(array() as array<int>)")
    own = F.struct(
        F.transform(F.coalesce(lead["summary"], F.expr("cast(array() as array<string>)")), escape).alias("texts"), rows.alias("rows"), escape(lead["context"]).alias("context"), escape(lead["why"]).alias("why"),
        lead["headline"].alias("headline"), lead["url"].alias("url"), F.coalesce(footer, F.lit("")).alias("footer"),
    )

    def state(s: Column, c: bool, w: bool, r: Column, h: Column) -> Column:
        return F.struct(s.cast("int").alias("s"), F.lit(c).alias("c"), F.lit(w).alias("w"), r.cast("int").alias("r"), h.cast("int").alias("h"))

    def states(v: Column) -> Column:
        n, k, full = F.size(v["texts"]), F.size(v["rows"]), F.length(v["headline"])
        one, zero = F.least(n, F.lit(1)), F.lit(0)
        down = lambda top, low: F.when(top > low, F.sequence(top - 1, low, F.lit(-1))).otherwise(none)
        halves = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.greatest(F.lit(NOTIFICATION_CHARS), F.floor(full / F.pow(F.lit(2.0), i)).cast("int")))
        return F.concat(
            F.array(state(n, True, True, k, full)),
            F.transform(down(n, one), lambda s: state(s, True, True, k, full)),
            F.array(state(one, False, True, k, full), state(one, False, False, k, full)),
            F.transform(down(k, zero), lambda r: state(one, False, False, r, full)),
            F.array(state(zero, False, False, zero, full)),
            F.transform(F.array_distinct(F.filter(halves, lambda h: h < full)), lambda h: state(zero, False, False, zero, h)),
        )

    def chars(v: Column, m: Column, x: Column) -> Column:
        part = lambda size: F.when(size > 0, size + len(gap)).otherwise(0)
        optional = lambda shown, c: F.when(shown & some(c), F.length(c) + len(gap)).otherwise(0)
        head = F.length(escape(shorten(v["headline"], x["h"]))) + 1 + F.length(v["url"])
        return head + part(F.get(m["text_sums"], x["s"]) - 1) + optional(x["c"], v["context"]) + optional(x["w"], v["why"]) + part(F.get(m["row_sums"], x["r"]) - 1) + optional(F.lit(True), v["footer"])

    def build(v: Column, x: Column) -> Column:
        lines = lambda parts, m, by: F.nullif(F.array_join(F.slice(parts, F.lit(1), m), by), F.lit(""))
        optional = lambda shown, c: F.when(shown & some(c), c)
        head = F.concat(escape(shorten(v["headline"], x["h"])), F.lit("\n"), v["url"])
        return F.concat_ws(gap, head, lines(v["texts"], x["s"], " "), optional(x["c"], v["context"]), optional(x["w"], v["why"]), lines(v["rows"], x["r"], "\n"), optional(F.lit(True), v["footer"]))

    def shrunk(v: Column) -> Column:
        measured = F.struct(sums(v["texts"]).alias("text_sums"), sums(v["rows"]).alias("row_sums"), states(v).alias("states"))
        fitting = lambda m: F.struct(F.get(F.filter(m["states"], lambda x: chars(v, m, x) <= limit), F.lit(0)).alias("fits"), F.element_at(m["states"], -1).alias("last"))
        return _let(_let(measured, fitting), lambda f: _let(F.coalesce(f["fits"], f["last"]), lambda x: F.struct(build(v, x).alias("message"), f["fits"].isNotNull().alias("fits"), (x["r"] + 1).alias("shown"))))

    return _let(own, shrunk)


def messages(signals: DataFrame, by: str = "run_id", cards: int = CARDS, limit: int = MESSAGE_CHARS) -> DataFrame:
    """``message, fits, shown`` per run with the first cards by rank (0 last), shrunk until it fits (see ``fit_message``).

    Columns read: ``rank, title, url`` and, where there are such, ``summary`` (array), ``context`` and ``why`` of the lead.
    """
    own = {"summary": "cast(array() as array<string>)", "context": "cast(null as string)", "why": "cast(null as string)"}
    full = signals.withColumns({c: F.expr(e) for c, e in own.items() if c not in signals.columns}).withColumn("_r", F.when(F.col("rank") == 0, 1 << 30).otherwise(F.col("rank")))
    card = F.struct("_r", "title", "url", F.coalesce("summary", F.expr(own["summary"])).alias("summary"), "context", "why")
    grouped = full.filter(F.col("_r") <= cards).groupBy(by).agg(F.array_sort(F.collect_list(card)).alias("_c"))  # at most ``cards`` of a run
    first = F.get("_c", F.lit(0))
    lead = F.struct(F.concat(F.lit("• "), first["title"]).alias("headline"), safe_url(first["url"]).alias("url"), first["summary"].alias("summary"), first["context"].alias("context"), first["why"].alias("why"))
    rows = F.transform(F.slice("_c", F.lit(2), F.lit(1 << 20)), lambda c: F.concat(F.lit("• "), escape(shorten(c["title"], 600)), F.lit("\n"), safe_url(c["url"])))
    named = grouped.select(by, lead.alias("lead"), rows.alias("rows"))
    return named.select(by, fit_message(F.col("lead"), F.col("rows"), F.lit(""), limit, "\n").alias("m")).select(by, "m.*")


def mail(signals: DataFrame, by: str = "run_id") -> DataFrame:
    """A plain mail per run: all cards in rank order, with their number and the first title as the subject."""
    line = F.concat(F.lit("- "), F.col("title"), F.lit("\n  "), safe_url(F.col("url")))
    rows = signals.withColumn("_l", line).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "title", "_l"))).alias("_c"))
    subject = F.concat(F.size("_c").cast("string"), F.lit(" - "), F.get("_c", F.lit(0))["title"])
    return rows.select(by, subject.alias("subject"), F.array_join(F.transform("_c", lambda c: c["_l"]), "\n").alias("body"))


def site(signals: DataFrame, by: str = "run_id") -> DataFrame:
    """One HTML page per run: cards in rank order, escaped."""
    card = F.concat(F.lit('<article><h2><a href="'), escape(safe_url(F.col("url"))), F.lit('">'), escape(F.col("title")), F.lit("</a></h2></article>"))
    rows = signals.withColumn("_card", card).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "_card"))).alias("_c"))
    return rows.select(by, F.concat(F.lit("<!DOCTYPE html><main>"), F.array_join(F.transform("_c", lambda c: c["_card"]), ""), F.lit("</main>")).alias("html"))


def funnel_day(signals: Column, checked: Column) -> Column:
    """Kind of a run's outcome."""
    return F.when(signals > 0, "digest_item").when(checked > 0, "quiet_day").otherwise("run_failure")
