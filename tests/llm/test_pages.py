"""Main text of pages, and archives there and back."""

import base64
import hashlib

import pytest

from footfall.llm import main_text, warc

MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer>&copy; all rights reserved, more text, and more.</footer>"
LONG = "A sentence with several words, a comma, and some length to it. " * 4


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x:y}}</style></head><body>{body}</body></html>"


CASES = {
    "article": (page(f"{MENU}<article><h1>Head &amp; line</h1><p>{LONG}</p><p>Short.</p></article>{FOOT}"),
                f"Head & line\n\n{LONG.strip()}\n\nShort."),
    "container": (
        page(f'<div id="top"><a href=x>Home</a> <a href=y>More</a></div><div class="content"><p>{LONG}</p>'
             f'<ul><li>one</li><li>two</li></ul><div class="ads">Buy now, cheap, today</div><p>End.</p></div>'
             f'<div class="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>{FOOT}'),
        f"{LONG.strip()}\n\none\n\ntwo\n\nEnd."),
    "unclosed": (page(f"<article><p><b>One {LONG}<br><p>Two.<p>Three</article>"), f"One {LONG.strip()}\n\nTwo.\n\nThree"),
    "inline": (page("<article><p>a<b>b</b>c <i>d</i>\n\t e&nbsp;f&#233;&lt;g</p></article>"), "abc d e fé<g"),
    "script": (page('<article><p>Text, here.</p><script>var t="</p><p>no";</script><form><p>No</p></form></article>'), "Text, here."),
    "comment": (page("<article><p>A<!-- <p>hidden</p> -->B</p></article>"), "AB"),
    "attributes": (page('<article title="a > b"><p data-x=\'<p>\'>Text.</p></article>'), "Text."),
    "sidebar": (page(f'<aside>{LONG}</aside><div class="cookie-notice">{LONG}</div><main><p>{LONG}</p></main>'), LONG.strip()),
    "hidden": (page(f'<main><p style="display: none">{LONG}</p><p hidden>x</p><p>Seen, yes.</p></main>'), "Seen, yes."),
    "link list": (page(f'<main><p>{LONG}</p><ul><li><a href=a>First other page</a></li><li><a href=b>Second other page</a></li></ul></main>'), LONG.strip()),
    "plain": ("only text, no tags", "only text, no tags"),
    "open tag at the end": ("<p>Text, ok.</p><div class", "Text, ok."),
    "none": (page(MENU + FOOT), ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, want = CASES[name]
    assert main_text.main_text(html) == want


def test_odd_markup_is_read_in_linear_time():
    for html in ("<div " * 20_000, '<a "' * 20_000 + ">", "<div>" * 20_000 + "deep" + "</div>" * 20_000, "<" * 50_000):
        main_text.main_text(html)
    assert main_text.main_text("<div>" * 2_000 + "deep, text" + "</div>" * 2_000) == "deep, text"


@pytest.mark.parametrize("name", ["content has-sidebar", "main with-sidebar", "post no-comments", "main sidebar-right", "layout-sidebar"])
def test_wrappers_named_for_what_stands_beside_the_article(name):
    html = page(f'{MENU}<div class="{name}"><p>{LONG}</p><div class="sidebar"><p>Other, text.</p></div></div>{FOOT}')
    assert LONG.strip() in main_text.main_text(html)


def test_article_in_a_page_wide_form():
    html = page(f'<p>Top line.</p><form id="aspnetForm">{MENU}<div><p>{LONG}</p><p>{LONG}</p></div></form>')
    assert f"{LONG.strip()}\n\n{LONG.strip()}" in main_text.main_text(html)
    talk = page(f'<article><p>Short, true.</p></article><div class="comments">{f"<p>{LONG}</p>" * 9}</div>')
    assert main_text.main_text(talk) == "Short, true."


def test_long_attribute_values_are_no_text():
    state = "<p>x > y</p>, " * 2_000
    assert main_text.main_text(f'<article data-state="{state}"><p class="a"">Text, here.</p><a href="b">c</a></article>').startswith("Text, here.")
    assert "x" not in main_text.main_text(f"<article data-state = '{state}'><p>Text, here.</p></article>").replace("Text", "")


def test_deep_elements_are_judged_like_others():
    deep = f'<nav>{LONG}</nav><p hidden>{LONG}</p><div class="comments">{LONG}</div><ul><li>one, more<li>two, more</ul>'
    html = f'<main>{"<div>" * 1_000}<p>Deep, text.</p>{deep}{"</div>" * 1_000}<p>After.</p></main><p>{LONG}</p>'
    assert main_text.main_text(html) == "Deep, text.\n\none, more\n\ntwo, more\n\nAfter."


def test_deep_pages_are_read_in_linear_time():
    import time

    for part in ("<div>a, b", "<p><td><div>a", "<span><div>x</div>", "<b>x</i>", '<a b="', "<a =' >"):
        begin = time.perf_counter()
        main_text.main_text(part * 30_000)
        assert time.perf_counter() - begin < 30, part


A, B = '<a href="a">The first source</a>', '<a href="b">The second source</a>'
LINKED = {
    "list between paragraphs": (f"<p>{LONG}</p><ul><li>{A}</li><li>{B}</li></ul><p>End.</p>",
                                ["The first source", "The second source", "End."]),
    "section of sources": (f"<p>{LONG}</p><section><h2>Sources</h2><ul><li>{A}</li><li>{B}</li></ul></section>",
                           ["Sources", "The first source", "The second source"]),
    "list under a heading": (f"<p>{LONG}</p><h3>Notes and references</h3><ol><li>{A}<li>{B}</ol>",
                             ["Notes and references", "The first source", "The second source"]),
    "sentence": (f"<p>{LONG}</p><div>See {A} and {B}.</div>", ["See The first source and The second source."]),
    "other pages": (f"<p>{LONG}</p><section><h2>More to read</h2><ul><li>{A}</li><li>{B}</li></ul></section>", []),
    "before the text": (f"<h1>Head</h1><ul><li>{A}</li><li>{B}</li></ul><p>{LONG}</p>", None),
}


@pytest.mark.parametrize("name", LINKED)
def test_link_rich_parts_of_an_article_stay(name):
    body, more = LINKED[name]
    want = ["Head", LONG.strip()] if more is None else [LONG.strip(), *more]
    for html in (f"{MENU}<article>{body}</article>{FOOT}", f'{MENU}<div class="content">{body}</div>{FOOT}'):
        assert main_text.main_text(page(html)) == "\n\n".join(want)


def test_extract(spark):
    rows = [(1, "u", CASES["article"][0], 5), (1, "u", CASES["article"][0], 5), (None, None, None, 5), (3, "v", "<p>é, " * 40_000, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = main_text.extract(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 1] == [CASES["article"][1]] * 2
    assert main_text.extract(df.limit(0)).count() == 0


PAGES = [
    (4, "http://a/", "same"), (2, "http://b/ x\r\ny", "same"), (2, "http://c/", "same"), (9, None, "same"),
    (5, "u", None), (6, "u", ""), (None, "u", "only"), (None, "u", "same"), (7, "u", "é" * 100_000),
    (8, "u", "é" * 100_000), (10, "u", "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\n" * 50), (11, "u", "\r\n\r\n"),
]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 3, b"x") for r in rows], "page_id long, url string, html string, size int, data binary")


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        least = first.get(html or "")
        revisit = least is not None and page_id != least
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [7, 1000, warc.CHUNK_BYTES])
def test_round_trip(spark, chunk):
    rows = PAGES if chunk > 7 else [r for r in PAGES if len(r[2] or "") < 5000]
    got = warc.round_trip(pages_of(spark, rows), chunk_bytes=chunk).drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
    assert warc.round_trip(pages_of(spark, []), chunk_bytes=chunk).count() == 0


def test_small_payloads_need_not_be_revisits(spark):
    got = warc.round_trip(pages_of(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), 3).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [
        (1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_archives_are_warc_files(spark):
    chunks = warc.write_archives(pages_of(spark, PAGES), chunk_bytes=1000).collect()
    seen = 0
    for archive in {r["archive"] for r in chunks}:
        rows = sorted((r for r in chunks if r["archive"] == archive), key=lambda r: (r["record"], r["chunk"]))
        data = b"".join(warc.archive_stream(rows))
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(fields[b"Content-Length"])
            assert data[size : size + 4] == b"\r\n\r\n"
            data = data[size + 4 :]
            seen += 1
    assert seen == len(PAGES)


def test_a_damaged_or_cut_record_is_refused(spark):
    head = warc.record_head("r", 1, "u", 4, warc.base32_sha1(hashlib.sha1(b"abcd").digest()), None, False, "d")
    good = warc.RecordReader()
    for byte in head + b"abcd\r\n\r\n":
        good.feed(bytes([byte]))
    assert good.finish()[2] == 4
    for payload in (b"abcx\r\n\r\n", b"ab"):
        reader = warc.RecordReader()
        reader.feed(head)
        reader.feed(payload)
        with pytest.raises(ValueError):
            reader.finish()
    reader = warc.RecordReader()
    reader.feed(head)
    with pytest.raises(ValueError):
        reader.feed(b"ab", hashlib.sha1(b"xx").hexdigest())


URLS = ["https://x.example/é b", "https://x.example/%20 %C3%A9", "a%20b", "a b", "", " ", None, "x\r\nWARC-Type: revisit", "ü" * 5000]


def test_urls_come_back_as_given(spark):
    rows = [(i, u, f"page {i}") for i, u in enumerate(URLS)]
    got = warc.round_trip(pages_of(spark, rows)).collect()
    assert {r["page_id"]: r["url"] for r in got} == dict(enumerate(URLS))


def test_records_that_cross_files_or_come_out_of_order(spark, tmp_path):
    rows = [(i, "u", f"{i} " * 400) for i in range(60)]
    chunks = warc.write_archives(pages_of(spark, rows).coalesce(2), chunk_bytes=100).collect()
    want = sorted(tuple(r) for r in warc.round_trip(pages_of(spark, rows), chunk_bytes=100).collect())
    for number, order in enumerate((chunks, chunks[::-1], chunks[1::2] + chunks[::2])):
        spark.createDataFrame(order, warc.CHUNKS).repartitionByRange(7, "chunk").write.parquet(f"{tmp_path}/{number}")
        got = warc.read_archives(spark.read.parquet(f"{tmp_path}/{number}"))
        assert sorted(tuple(r) for r in got.collect()) == want
    with pytest.raises(Exception, match="damaged or missing|ends before its length|does not match"):
        warc.read_archives(spark.createDataFrame(chunks[:5] + chunks[6:], warc.CHUNKS)).collect()
