from __future__ import annotations

import collections
import random

import numpy as np
import pytest

from newsloom.llm.repeated import cut, hashes, normal, repeated_lines, without_lines

NOTICES = ["All rights reserved by A.", "Share this story (12 shares)", "Sport", "ニュース", "a" * 900]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for k in range(120):
        host = rng.choice(["a.example"] * 3 + ["b.example", "www.c.example"])
        lines = [f"{rng.choice(['One', 'Two', 'Three'])} sentence number {rng.randrange(10**6)} of {rng.random()}" for _ in range(3)]
        lines += [n.replace("12", str(rng.randrange(99))).upper() if rng.random() < 0.3 else n for n in NOTICES if rng.random() < 0.4]
        rng.shuffle(lines)
        out.append((k, f"https://{host}/{rng.randrange(100)}", rng.choice(["\n", "\n\n", " \n\t"]).join(lines)))
    return out + [(200, "https://a.example/1", None), (201, "https://a.example/1", ""), (202, None, "Sport"), (203, "no host", "Sport"), (204, "https://a.example/2", "\n 123 \n")]


def brute(rows) -> set[tuple[int, int]]:
    host = lambda u: u.split("/")[2].removeprefix("www.") if u and "//" in u else ""
    urls, lines = collections.defaultdict(set), collections.defaultdict(set)
    for _, u, t in rows:
        if t and host(u):
            urls[host(u)].add(u)
            for x in t.split("\n"):
                lines[host(u), normal(x)].add(u)
    return {(i, k) for i, u, t in rows if t and host(u) for k, x in enumerate(t.split("\n"), 1) if normal(x) and len(lines[host(u), normal(x)]) >= max(3, 0.1 * len(urls[host(u)]))}


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "z") for r in rows], "article_id bigint, url string, content string, key string")
    found = repeated_lines(df)
    expected = brute(rows)
    assert {(r.article_id, r.line_no) for r in found.collect()} == expected and len(expected) > 50
    left = {r.article_id: r.content for r in without_lines(df, found).collect()}
    texts = {i: t for i, _, t in rows}
    for i, t in texts.items():
        assert left[i] == (t if not t else "\n".join(x for k, x in enumerate(t.split("\n"), 1) if (i, k) not in expected))
    assert repeated_lines(df.limit(0)).count() == 0


def test_chunks_of_a_line_do_not_depend_on_its_neighbours():
    rng = random.Random(3)
    line = "".join(rng.choice("abcdef ghij") for _ in range(700)).strip()
    seen = set()
    for before in ("", "x", "other words before it"):
        keys, chunk_keys, of_line = cut([before, line, "after"])
        seen.add((int(keys[1]), tuple(chunk_keys[of_line == 1].tolist())))
    assert len(seen) == 1 and len(next(iter(seen))[1]) > 3


def test_hashes_tell_pieces_apart():
    points = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint32)
    a, b, c = hashes(points, np.array([0, 3, 6])).tolist()
    assert a == b != c
