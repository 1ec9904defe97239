"""Pages in the shapes that sources have, read to dated sections."""

from __future__ import annotations

import random
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from driftline.functions import dates as D
from driftline.sources import pages

BODY = "<p>A body that is long enough to stay.</p>"


def stack_page():
    """Headings of random levels with and without years, and the day that each should have."""
    rng = random.Random(4)
    headings, html = [], ""
    for n in range(60):
        level, year = rng.randint(1, 6), rng.choice([None, None, 2021 + rng.randrange(5)])
        headings.append((level, year))
        html += f"<h{level} id='h{n}'>{f'May {year}' if year else 'April 4'}</h{level}>{BODY}"
    want = {}
    for i, (level, year) in enumerate(headings):
        found, low = year, level
        for above, other in reversed(headings[:i]):  # the rule as a walk upward
            if not found and above < low:
                low, found = above, other
        want[f"h{i}"] = date(year, 5, 1) if year else date(found, 4, 4) if found else None
    return html, want


STACK, STACK_WANT = stack_page()
MONTHS = "<h2>August, 2026</h2><div id='x'><div>Aug 14</div><p>Thing shipped to everyone today</p></div><div>Aug 12</div><p>Short</p><h2>July 2026</h2><div>Jul 30</div><p>Something else that shipped</p>"
PROSE = "<h2 id='p'>Prices</h2><p>Rates rise on March 3, 2024 for all. Built since 2019 by us. See acme-2024-08-06 for more. They fall on April 4, 2025!</p>"
PAGES = {
    "ends": ("<h2 id='a'>May 1, 2024</h2><p>First body that is long enough.</p><h3>Detail</h3><p>More of it.</p><h2>June 2, 2024</h2><p>Second body that is long.</p><h1>Other</h1><p>Not part.</p>", None),
    "years": (f"<h1>Log</h1><h2>2025</h2><h3>March 3</h3>{BODY}<h4>Part</h4>{BODY}<h3>March 1</h3>{BODY}<h2>2024</h2><h3>Dec 14</h3>{BODY}<h2>Notes</h2><h3>Dec 1</h3>{BODY}", None),
    "siblings": (f"<h2>January 5, 2026</h2>{BODY}<h2>Dec 14</h2>{BODY}<h1>Old</h1><h3>2023</h3>{BODY}<h2>May 5</h2>{BODY}", None),
    "stack": (STACK, None),
    "table": (
        """<h2 id='t'>Models</h2><table><tr><th>Model</th><th>Retirement date</th><th>Deprecated</th></tr>
        <tr><td>acme-1</td><td>May 6, 2024</td><td>2023-01-02</td></tr><tr><td>acme-2</td><td>2024-07-08</td><td>N/A</td></tr><tr><td>acme-3</td><td>none</td><td>March 4</td></tr></table>""",
        None,
    ),
    "months": (MONTHS, None),
    "hinted": (MONTHS, "month_then_day"),
    "led": ("<h3>v1.2</h3><p>Released: 2024-03-06</p><p>Fixes of all kinds.</p><h3>v1.1</h3><p>Released: 2024-02-01</p><p>Other fixes.</p>", "nothing known"),
    "index": (
        r'<script>x=[{\"title\":\"A\",\"url\":\"/a\",\"date\":\"2024-01-02\"},{"title":"A","url":"/a2","date":"2024-01-02"},{"title":"B","slug":"b","publishedAt":"2024-02-03"},{broken:1}, {"label":"2025-11-25","pages":[{"p":1}]}, {"name":"gpt-2024-08-06","pages":[]}]</script>',
        None,
    ),
    "prose": (PROSE, None),
    "deep": ("<div>" * 3000 + "<h2>May 1, 2024</h2>" + BODY + "</div>" * 3000, None),
    "long": ("".join(f"<h2 id='i{i}'>2024-01-{1 + i % 28:02d}</h2>{BODY}" for i in range(2000)), None),
    "null": (None, None),
    "empty": ("", None),
    "undated": ("<p>Nothing dated in here at all.</p>", "sections"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"https://x.example.com/{k}", h, hint, "clash") for k, (h, hint) in PAGES.items()]
    df = spark.createDataFrame(rows, "url string, html string, hint string, page string").repartition(3)
    out: dict = {k: [] for k in PAGES}
    for r in pages.page_sections(df, hint="hint").collect():
        out[(r.page_section or r.url).split("#")[0].rsplit("/", 1)[-1] if not r.url.endswith("/a") else "index"].append(r)
    return {k: sorted(v, key=lambda r: (str(r.event_date), r.title)) for k, v in out.items()}


def test_headings_end_at_the_next_dated_or_higher_one(found):
    got = found["ends"]
    assert [(r.title, r.anchor, r.event_date, r.date_precision, r.way) for r in got] == [("May 1, 2024", "a", date(2024, 5, 1), "day", "headings"), ("June 2, 2024", None, date(2024, 6, 2), "day", "headings")]
    assert got[0].raw_text == "May 1, 2024\nFirst body that is long enough.\nDetail\nMore of it." and "Not part" not in got[1].raw_text
    assert got[0].url == "https://x.example.com/ends#a" and got[0].page_section == "https://x.example.com/ends"
    assert [r.event_date for r in found["deep"]] == [date(2024, 5, 1)] and len({r.anchor for r in found["long"]}) == 2000


def test_year_comes_from_enclosing_headings_only(found):
    got = {r.title: (r.event_date, r.date_precision, r.year_from) for r in found["years"]}
    assert got == {"March 3": (date(2025, 3, 3), "day", "2025"), "March 1": (date(2025, 3, 1), "day", "2025"), "Dec 14": (date(2024, 12, 14), "day", "2024"), "Dec 1": (None, "inferred", None)}
    # a sibling's year does not leak, nor does that of a heading below a closed one
    got = {r.title: r.event_date for r in found["siblings"]}
    assert got["Dec 14"] is None and got["May 5"] is None and got["January 5, 2026"] == date(2026, 1, 5)
    assert {r.anchor: r.event_date for r in found["stack"]} == STACK_WANT


def test_tables_take_the_best_column(found):
    assert [(r.title, r.event_date, r.raw_text, r.way, r.anchor) for r in found["table"]] == [
        ("Models - acme-1", date(2023, 1, 2), "acme-1 | May 6, 2024 | 2023-01-02", "tables", "t"),
        ("Models - acme-2", date(2024, 7, 8), "acme-2 | 2024-07-08 | N/A", "tables", "t"),
    ]


def test_marks_under_headings(found):
    assert {r.way for r in found["months"]} == {"headings"}  # the dated headings have bodies, so they are the sections
    assert {r.event_date: (r.title, r.year_from, r.anchor, r.way) for r in found["hinted"]} == {
        date(2026, 8, 14): ("Aug 14 - Thing shipped to everyone today", "August, 2026", "x", "marks"),
        date(2026, 8, 12): ("Aug 12 - Short", "August, 2026", None, "marks"),
        date(2026, 7, 30): ("Jul 30 - Something else that shipped", "July 2026", None, "marks"),
    }
    assert [(r.title, r.event_date, r.raw_text) for r in found["led"]] == [("v1.1", date(2024, 2, 1), "v1.1\nReleased: 2024-02-01\nOther fixes."), ("v1.2", date(2024, 3, 6), "v1.2\nReleased: 2024-03-06\nFixes of all kinds.")]


def test_embedded_index(found):
    at = "https://x.example.com/index"
    assert [(r.title, r.url, r.event_date, r.raw_text, r.page_section) for r in found["index"]] == [
        ("A", "https://x.example.com/a", date(2024, 1, 2), "2024-01-02 | A | /a", None),
        ("B", at, date(2024, 2, 3), "2024-02-03 | B | b", at),
        ("2025-11-25", at, date(2025, 11, 25), "2025-11-25 | 2025-11-25", at),
    ]


def test_sentences(found):
    assert [(r.title, r.raw_text, r.way) for r in found["prose"]] == [("Prices - March 3, 2024", "Rates rise on March 3, 2024 for all.", "sentences"), ("Prices - April 4, 2025", "They fall on April 4, 2025!", "sentences")]
    assert found["null"] == found["empty"] == found["undated"] == []


def test_window_and_most_sentences(spark):
    rows = spark.createDataFrame([("a", PROSE), ("b", f"<h2>March 2024</h2>{BODY}<h2>May 5</h2>{BODY}<h2>February 2024</h2>{BODY}")], "url string, html string")
    got = pages.page_sections(rows, since=F.lit(date(2024, 3, 31)), most_sentences=1).collect()
    assert {(r.url, r.event_date) for r in got} == {("b", date(2024, 3, 1)), ("b", None)}
    assert pages.page_sections(spark.createDataFrame([], "url string, html string")).collect() == []


def test_content_root_leaves_chrome_out(spark):
    article = "<article><h1>Title</h1><p>" + "Words of the article. " * 12 + "</p></article>"
    html = f"<html><head><title> The  page </title></head><body><nav>Menu</nav><div class='side'>{'Chrome around it. ' * 5}</div>{article}<footer>2020</footer></body></html>"
    rows = spark.createDataFrame([(html,), (None,), ("",), ("<p>short <b>text<p>two",), ("<main>too short</main><p>all of the body</p>",)], "html string")
    got = [r.t for r in rows.select(pages.html_to_text(F.col("html")).alias("t")).collect()]
    assert got[0].title == "The page" and got[0].text == "Title\n" + ("Words of the article. " * 12).strip()
    assert [(t.title, t.text) for t in got[1:]] == [("", ""), ("", ""), ("", "short text\ntwo"), ("", "too short\nall of the body")]


def planned(spark, monkeypatch, html, **how):
    """Plans of what ``page_sections`` stores and of what it returns, and the rows."""
    stored, keep = [], pages.materialise
    monkeypatch.setattr(pages, "materialise", lambda df: stored.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    rows = spark.range(40, numPartitions=1).select(F.concat(F.lit("https://x/"), "id").alias("url"), F.format_string(html, "id").alias("html"))
    out = pages.page_sections(rows, **how)
    return [*stored, out._jdf.queryExecution().executedPlan().toString()], out.collect()


def test_rows_of_tables_are_cut_where_the_page_is(spark, monkeypatch):
    plans, rows = planned(spark, monkeypatch, "<h2>Models</h2><table><tr><th>Model</th><th>Date</th></tr><tr><td>acme-%s</td><td>May 6, 2024</td></tr></table>")
    assert [p.count("Exchange") for p in plans] == [1, 0] and not any("Window" in p or "Join" in p for p in plans)
    assert len(rows) == 40 and {(r.title, r.event_date, r.way) for r in rows} == {(f"Models - acme-{i}", date(2024, 5, 6), "tables") for i in range(40)}


def test_cells_of_a_wide_row_are_read_in_one_pass():
    row = "".join(f"<td>c{i}</td>" for i in range(20_000))
    began = time.monotonic()
    parts = pages.read_page(f"<table><tr>{row}</tr></table>")[1].parts
    assert time.monotonic() - began < 5
    assert [p["title"] for p in parts if p["kind"] == "cell"] == [f"c{i}" for i in range(20_000)]
    assert pages.read_page("<table><tr><td>a</td><td hidden>b</td><th>c</th></tr></table>")[1].text == "a | c\n"


def test_marks_are_cut_where_the_page_is(spark, monkeypatch):
    html = "<h3>v%s</h3><p>Released: 2024-03-06</p><p>Fixes of all.</p><div>Mar 5, 2024</div><p>A line of more than twenty characters</p>"
    plans, rows = planned(spark, monkeypatch, html, most_sentences=1)
    assert [p.count("Exchange") for p in plans] == [1, 0] and not any("Window" in p or "Join" in p for p in plans)
    assert sorted((r.title, r.event_date, r.way) for r in rows) == sorted(x for i in range(40) for x in ((f"v{i}", date(2024, 3, 6), "marks"), ("Mar 5, 2024 - A line of more than twenty characters", date(2024, 3, 5), "marks")))


def test_dates_stand_alone_in_python_as_they_do_in_the_jvm(spark):
    rows = spark.range(1, 0x20000).filter("id < 55296 or id > 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') as c")
    rows = rows.filter(~F.col("c").rlike(r"\p{Cn}"))  # Python may know characters that the JVM doesn't
    got = rows.select("c", D.stated_alone(F.concat("c", F.lit("2024-01-02")), F.lit("2024-01-02")).alias("alone")).collect()
    assert len(got) > 80_000
    wrong = [hex(ord(r.c)) for r in got if r.alone != D.is_alone(f"{r.c}2024-01-02", "2024-01-02")]
    assert wrong == []


def test_sections_of_headings_are_cut_where_the_page_is(spark, monkeypatch):
    plans, rows = planned(spark, monkeypatch, f"<h2>May 2024</h2><h3 id='d%s'>May 4</h3>{BODY}<h2 id='s'>Dec 14</h2>{BODY}")
    assert [p.count("Exchange") for p in plans] == [1, 0] and not any("Window" in p or "Join" in p for p in plans)
    want = [(f"d{i}", date(2024, 5, 4), "May 2024") for i in range(40)] + [("s", None, None)] * 40
    assert sorted(((r.anchor, r.event_date, r.year_from) for r in rows), key=str) == sorted(want, key=str)


def test_plain_markup_makes_the_tree_that_the_parser_makes():
    def shape(node):
        return node if isinstance(node, str) else (node.tag, node.attrs, [shape(c) for c in node.children])

    for html in (STACK, MONTHS, PROSE, "x<P>a<p ID='q' class=\"a 'b'\">b<br>c</div><ul><li>d<li>e</ul> > <h2>f", "<table><tr><td>a<td>b<tr><th>c</table>", "", "<p a=''>", "a < b <p>", "<p>&amp;</p>", "<br/><p>x", "<script><p></script>", "<p title='<b>'>"):
        plain, parsed = pages._Tree(), pages._Tree()
        plain.read(html)
        parsed.feed(html)
        parsed.close()
        assert shape(plain.root) == shape(parsed.root) and plain.contained == parsed.contained
