from __future__ import annotations

import random

import pytest

from newsloom.llm.mainbody import foreign_lines, line_flags, own_lines, page_lines

OWN = [
    "The school board published the bridge survey in the district of Kel, after a long debate.",
    "Under new management, the river police questioned a new timetable for the people of Thun.",
    "Kelska: the food bank audited the plan",
    "A short entry of a list.",
    "The water board presented the drainage map on the road to Kel, despite heavy rain and wind.",
]
MENU, NOTICES, RELATED = ["Home", "Sport", "Politics", "Weather"], ["Share this story with your friends", "All rights reserved by The Kel Post."], ["Another headline about a bridge", "One more headline about the rain in Kel."]
BYLINE = "By Kel Thun, The Kel Post staff writer"


def page(layout: str) -> str:
    links = lambda xs: "".join(f'<li><a href="/x">{x}</a></li>' for x in xs)
    p, h, li = (lambda t: f"<p>{t}</p>"), (lambda t: f"<h2>{t}</h2>"), (lambda t: f"<ul><li>{t}</li></ul>")
    text = p(OWN[0]) + p(OWN[1]) + h(OWN[2]) + li(OWN[3]) + f"<blockquote>{OWN[4]}</blockquote>"
    if layout == "div":
        return f'<html><body><div id="a"><ul>{links(MENU)}</ul></div><div id="b"><h1>T</h1><div class="q">{BYLINE}</div>{text}<p class="z">{NOTICES[0]}</p></div><div id="c"><h3>Read more</h3><ul>{links(RELATED)}</ul></div><div id="d"><p>{NOTICES[1]}</p></div></body></html>'
    if layout == "table":
        br = "<br><br>".join(OWN)
        return f"<html><body><table><tr><td><ul>{links(MENU)}</ul></td></tr><tr><td><h1>T</h1><font><div>{BYLINE}</div>{br}<br><br><div><span>{NOTICES[0]}</span></div></font></td><td><h3>Read more</h3><ul>{links(RELATED)}</ul></td></tr><tr><td><p>{NOTICES[1]}</p></td></tr></table>"
    return f"<body><nav>{links(MENU)}</nav><main><article><h1>T</h1><p>{BYLINE}<p>{OWN[0]}<p>{OWN[1]}<h2>{OWN[2]}</h2><ul><li>{OWN[3]}</ul><p>{OWN[4]}<p>{NOTICES[0]}</article></main><aside><h3>Read more</h3><ul>{links(RELATED)}</ul></aside><footer>{NOTICES[1]}</footer>"


@pytest.mark.parametrize("layout", ["div", "table", "article"])
def test_own_text_is_kept(layout):
    lines = [*MENU, BYLINE, *OWN, NOTICES[0], "Read more", *RELATED, NOTICES[1]]
    repeated = [x in MENU or x in NOTICES or x == "Read more" for x in lines]
    assert [x for x, f in zip(lines, line_flags("\n".join(lines), page(layout), repeated, "The Kel Post"), strict=True) if f] == OWN


def test_cut_off_page_and_broken_markup():
    lines = [*MENU, *OWN, NOTICES[1]]
    html = page("div")
    cut = html[: html.index(OWN[1]) + 20]
    flags = line_flags("\n".join(lines), cut, [x in MENU or x in NOTICES for x in lines], "The Kel Post")
    assert [x for x, f in zip(lines, flags, strict=True) if f] == OWN
    for html in ("", "<", "<![x", "<p", "text only", "<script>" * 50, "<div>" * 2000 + "x"):
        assert len(own_lines(page_lines(html))) == len(page_lines(html))


def test_table_cases(spark):
    rng = random.Random(1)
    lines = [*MENU, BYLINE, *OWN, NOTICES[0], "Read more", *RELATED, NOTICES[1]]
    rows = [(1, "https://a.example/1", "\n".join(lines), page("div"), "y")]
    rows += [(k, f"https://a.example/{k}", "\n".join([*MENU, f"Story {rng.random()} of the day.", *NOTICES, "Read more"]), None, "y") for k in range(2, 8)]
    rows += [(9, None, None, "<p>x</p>", "y"), (10, "https://a.example/10", "", "<p>x</p>", "y"), (11, "https://a.example/11", "a\n\nb", "", "y")]
    df = spark.createDataFrame(rows, "article_id bigint, url string, content string, raw_html string, repeated string")
    sites = spark.createDataFrame([("a.example", "The Kel Post", "en")], "host string, source string, lang string")
    found = sorted((r.article_id, r.line_no) for r in foreign_lines(df, sites).collect())
    assert found == [(1, k) for k, x in enumerate(lines, 1) if x not in OWN]
    assert foreign_lines(df.limit(0), sites).count() == 0
