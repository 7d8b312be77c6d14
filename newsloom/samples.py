"""Literal inputs that the core queries and their SQL share: edge cases that the tables lack."""

from __future__ import annotations

URLS = [
    "", "https://a.example/", "https://a.example/news/index.html", "https://a.example/a/12345", "https://a.example/2024/01/x", "https://a.example/news/2024/12", "https://a.example/big-story-of-the-day",
    "https://a.example/content_123456", "https://a.example/a/b/c", "https://a.example/news/x", "https://a.example/v1.2/a/123456", "http://host.example:8080/p;v=1?q=2#f", "//cdn.example/x/y.js",
    "https://news.a.com.cn/2024-01/15/story_1234567.shtml", "https://b.co.uk/2024-01-15/man-bites-dog", "https://facebook.com/x", "https://m.youtube.com/w", "mailto:x@a.example", "javascript:void(0)", "#top", "tel:1",
    "https://a.example/6#breaknews", "https://a.example/?p=3", "https://a.example/?page=3&x=1", "https://a.example/page/2/", "https://a.example/159140_2.shtml", "https://a.example/article_1.html", "https://a.example/x_100.html",
    "https://a.example/wp-admin/x", "https://a.example/cdn-cgi/x", "https://a.example/photo.JPG", "https://a.example/node_77", "https://a.example/topic_5/a1b2c3d4e5", "https://a.example/news/a1b2c3d4", "https://a.example/News/world/local/abcdefghijklmno",
    "https://a.example/news/tag/list", "https://user:pw@a.example/p_9/q", "relative/path", "https://co.uk/x", "https://localhost/a/b", "https://a.example/login/2024/05/big-story-of-the-day-is-here",
]
PAIRS = [
    ("https://news.a.com.cn/x/1", "https://www.a.com.cn/"), ("https://b.com.cn/x", "https://a.com.cn/"), ("https://x.com.example/q", "https://y.example/"), ("https://cyan.com/a", "https://cyan.net/"),
    ("https://host.example:8080/a", "https://host.example/"), ("https://a.example/a", ""), ("", "https://a.example/"), ("https://facebook.com/a", "https://facebook.com/"), ("https://a.co.uk/x", "https://b.a.co.uk/"), ("https://a.example/search/x", "https://a.example/"),
]
TEMPLATES = [
    ("news/<number>", "news/<number>"), ("news/<number>", "sport/<number>"), ("news/<number>", "news/<slug>"), ("<number>/<slug>", "<date>/<slug>"), ("news", "news/<number>/<slug>"), ("a/b/<mixed>", "a/b/<number>"), ("a/b/c", "a/x/c"), ("", "<slug>"), ("<slug>", "news"),
]
TITLES = [
    "{{x}}", "${x} news today", "<%=t%> more", "{%b%} more", "null", "loading...", "four", "five5", "　padded title　", "1. Foo bar", "【12】Foo bar", "· Foo bar", "2024年报告", "Foo bar 2024-01-02 10:00", "(3) Foo", "[Foo] bar",
    "1234 hours ago Storm hits", "12 mins Storm", "   ", "»►▶ Foo", "Foo  bar\tbaz",
]
TIMES = [
    "2024-12-30 10:00", "12-345", "3-4 and 5月6日", "2024年1月2日", "5月6日", "10:30", "3 小时前", "5分钟前发布", "7 minutes ago", "7 minutes agog", "昨天 10 点", "Just now", "发布于2024-01-01", "2024/1/2", "2024-1-2 3:4", "2024-01-02 03:04:05", "2024-13-45",
    "Updated: 2024-02-29", "date: 2023-02-29", "nothing here", "20240102",
]
NAMES = ["", "GB2312", " latin1 ", '"UTF-8"', "ISO-8859-1", "ascii", "x-euc-cn", "windows-1251", "'gbk'"]
#: Nodes of small pages as (page, node, parent, is a lit link): a list and a single link, a page with one lit link, two
#: links side by side, and a link deeper than boundaries reach.
NODES = [
    *((1, n, p, n in (8, 9, 10, 12)) for n, p in ((1, 0), (2, 1), (3, 1), (4, 3), (5, 4), (6, 4), (7, 4), (8, 5), (9, 6), (10, 7), (11, 3), (12, 11), (13, 2))),
    *((2, n, p, n == 2) for n, p in ((1, 0), (2, 1))),
    *((3, n, p, n in (3, 5)) for n, p in ((1, 0), (2, 1), (3, 2), (4, 3), (5, 2))),
    *((4, n, n - 1, n == 14) for n in range(1, 15)), (4, 15, 1, True),
]
#: Sample and candidate URLs of a page, around the least similarity: (page, is a sample, URL).
SIMILAR_ROWS = [
    *((1, "1", f"https://a.example/news/2024/{n}.html") for n in (123456, 123457, 123458)), *((1, "0", f"https://a.example/{p}") for p in ("news/2024/999999.html", "news/2024/some-long-slug.html", "news/2024/story_77.html", "sport/2024/123456.html", "news/123456.html", "news/2024/01/123456.html", "news/2024/999999.php", "about", "")),
    (1, "0", "https://b.example/news/2024/999999.html"), (1, "0", "https://m.a.example/news/2024/5.html"),
    *((2, "1", f"https://c.example/p/{x}") for x in ("a1b2c3d4e5", "f6a7b8c9d0")), *((2, "0", f"https://c.example/p/{x}") for x in ("0a1b2c3d4e", "man-bites-dog", "77", "x/77")),
]
#: Fetched bytes: (id, body in hexadecimal digits, content type).
BODIES = [
    (1, "636166c3a9", "text/html; charset=utf-8"), (2, "636166e9", "text/html; charset=ISO-8859-1"), (3, "d6d0b9fa", "text/html; charset=gb2312"), (4, "d6d0b9fa", "text/html; charset=utf-8"),
    (5, "3c6d65746120636861727365743d67626b3ed6d0b9fa", None), (6, "", "text/html; charset=utf-8"), (7, None, None), (8, "e4b8ade59bbd", "text/html; charset=UTF8"),
]
_ITEM = '<li class="item"><a href="{url}">{title}</a> <span class="date">{time}</span></li>'
_STORIES = [
    ("/news/2024/0102/100001.html", "Harbour council opens the second footbridge", "2024-01-02 10:30"), ("/news/2024/0102/100002.html", "Ferry operator &amp; union agree on a new timetable", "2 hours ago"),
    ("/news/2024/0101/100003.html", "School board measures the noise near the market", "yesterday"), ("/news/2024/0101/100004.html", "Orchard trust replaces its offer without a quorum", "2024-01-01"),
    ("/news/2023/1231/100005.html", "Allotment owners archive a notice from the water board", "2023-12-31 08:00:00"), ("/news/2024/0102/100001.html", "Harbour council opens the second footbridge again", "2024-01-02 11:00"),
]
#: A list page with navigation and a footer around its items, one of them linked twice; a page without links; no page.
LISTS = [
    (1, "https://kel.example/news/", '<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/about">About us</a></li></ul></nav><main><ul class="news-list">' + "".join(_ITEM.format(url=u, title=t, time=w) for u, t, w in _STORIES) + '</ul></main><footer><a href="/contact">Contact the editors</a></footer></body></html>'),
    (2, "https://kel.example/empty/", "<html><body><p>Nothing here today.</p></body></html>"), (3, "https://kel.example/none/", None),
]
_TEXT = "<p>The council opened the footbridge on Tuesday, a year later than planned, after two rounds of repairs.</p><p>Owners of the allotments had asked for it since the ferry was cut.</p>"
#: Article pages of two of the items.
STORIES = [
    ("https://kel.example/news/2024/0102/100001.html", f'<html lang="en"><head><title>Footbridge opens | Kel</title><meta property="og:title" content="Footbridge opens"><meta name="author" content="N. Brawen"></head><body><article><h1>Footbridge opens</h1>{_TEXT}</article></body></html>'),
    ("https://kel.example/news/2024/0101/100004.html", "<html><body></body></html>"),
]
#: The UTC second at which the literal pages were fetched and from which literal relative times count: 2024-01-02 04:30:00.
FETCHED = 1704169800
