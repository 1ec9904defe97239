"""Pages, channels and journals in the shapes that sources have."""

from __future__ import annotations

from datetime import datetime

from driftline.sources import parsers


def test_channel_posts(spark):
    post = '<div data-post="chan/{n}"><div class="tgme_message_text js">{text}</div><time datetime="2024-01-0{n}T10:00:00+00:00"></time></div>'
    page = post.format(n=1, text="One<br>two") + post.format(n=2, text="") + post.format(n=3, text="three &amp; four")
    got = parsers.channel_posts(spark.createDataFrame([(page,), (page,), (None,)], "html string")).orderBy("message_id").collect()
    assert [(r.channel, r.message_id, r.text, r.published, r.requires_corroboration) for r in got] == [("chan", 1, "One\ntwo", datetime(2024, 1, 1, 10), True), ("chan", 3, "three & four", datetime(2024, 1, 3, 10), True)]


def test_journal_skips_bad_lines(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"seq": 1, "kind": "a"}\nnot json\n{"seq": 2, "kind": "b"}\n')
    assert [r.seq for r in parsers.read_journal(spark, str(tmp_path / "j.jsonl"), "seq long, kind string").orderBy("seq").collect()] == [1, 2]
