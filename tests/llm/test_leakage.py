from __future__ import annotations

import random

import numpy as np
import pytest

from newsloom.llm.leakage import ItemSuffixes, find_leaks, leaks_of, remove_leaking, suffix_matches
from newsloom.llm.textcodes import code_points, folding

WORDS = "orchard trust replaced compensation offer without quorum cinema collective footbridge afternoon allotment owners seed archive notice signal workshop school meals tender Thursday talks which following best describes decision harbour council ferry operator measured bridge survey despite heavy rain".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    items = [(k, sentence(rng, 35)) for k in range(6)] + [(6, "渚嵩采石公司周末期间否决了补偿方案应要求支持沚峤审计小组通过了埭璟的排水图随后前往洺漪谁来承担峤岑的租金调查"), (7, None), (8, "...")]
    text = dict(items)
    filler = lambda: sentence(rng, 60)
    third = text[3].split(" ")
    docs = [
        (0, f"{filler()}. {text[0]}. {filler()}", {0}),
        (1, f"{filler()} {text[1].upper().replace(' ', '  —  ')} {filler()}", {1}),
        (2, " ".join(text[2].split(" ")[:22]) + " " + filler(), {2}),
        (3, filler() + " " + " ".join([*third[:9], "CHANGED", *third[10:20], *third[21:]]) + filler(), {3}),
        (4, " ".join(text[4].split(" ")[:9]) + " " + filler(), set()),
        (5, filler(), set()),
        (6, "本报讯" + text[6][:40] + "。完。", {6}),
        (7, None, set()),
        (8, "", set()),
        (9, f"{text[0]} {text[5]}", {0, 5}),
        (10, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text[4]), {4}),
    ]
    d = spark.createDataFrame([(i, t, "z") for i, t, _ in docs], "doc_id bigint, text string, share string")
    q = spark.createDataFrame(items, "item_id bigint, text string")
    return d, q, {(i, k) for i, _, ks in docs for k in ks}


def test_finds_exactly_the_planted_leaks(tables):
    docs, items, expected = tables
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()} == expected


def test_removal_and_empty_tables(tables):
    docs, items, expected = tables
    leaks = find_leaks(docs, items)
    assert remove_leaking(docs, leaks).count() == 11 - len({d for d, _ in expected})
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def test_suffix_array_equals_brute_force():
    rng = random.Random(2)
    text = "".join(rng.choice("abcd") for _ in range(3000))
    items = ItemSuffixes([0, 1], [text[500:560], "".join(rng.choice("abcd") for _ in range(60))])
    shard = folding()[code_points(text)]
    suffix, place = suffix_matches(shard, items)
    found = set(zip(suffix.tolist(), place.tolist(), strict=True))
    expected = set()
    for k in items.deep.tolist():
        q = items.strings[items.owner[k]]
        piece = q[items.place[k] : items.place[k] + 24]
        at = text.find(piece)
        while at >= 0:
            expected.add((k, at))
            at = text.find(piece, at + 1)
    assert expected <= found and all(items.strings[items.owner[k]][items.place[k] : items.place[k] + 24] == text[p : p + 24] for k, p in found)
    assert np.all(items.lengths == 60)


def test_an_edited_half_beside_repeated_sentences():
    rng = random.Random(5)
    name = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    sentence, runs = name(80), [name(30) for _ in range(6)]
    held = ItemSuffixes([1], [sentence + "".join(runs)])
    half = "".join(r + name(5) for r in runs)
    assert [x[:2] for x in leaks_of([name(40).join([sentence] * 8) + name(60) + half], held)] == [(0, 0)]
    assert not leaks_of([name(40).join([sentence] * 8)], held)


def test_a_half_with_a_change_in_every_line_of_words():
    rng = random.Random(6)
    name = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    runs = [name(18) for _ in range(20)]
    seed = name(26)  # the one verbatim match of seed depth, 7 % of the item
    assert [x[:2] for x in leaks_of([seed + "".join(name(3) + r for r in runs)], ItemSuffixes([1], [seed + "".join("q" + r for r in runs)]))] == [(0, 0)]


def test_short_items():
    held = ItemSuffixes([1, 2, 3, 4], ["What is the capital city?", "한국의 수도는 어느 도시입니까", "Oslo?", "Which of these rivers is longer?"])
    docs = ["Quiz: what is the CAPITAL city - answers below", "문제: 한국의 수도는 어느 도시입니까? 답", "They live in Oslo", "A capital", "which of these rivers", "rivers", "어느 도시"]
    assert sorted(x[:2] for x in leaks_of(docs, held)) == [(0, 0), (1, 1), (2, 2), (4, 3)]


def test_places_and_longest_match():
    rng = random.Random(8)
    item = sentence(rng, 30)
    text = f"{sentence(rng, 12)}. — «{item.upper()}»! {sentence(rng, 9)}"
    [(row, which, share, matched, begin, end)] = leaks_of([None, text], ItemSuffixes([7], [item]))
    assert (row, which, share) == (1, 0, 1.0) and matched == sum(c.isalnum() for c in item) and text[begin:end] == item.upper()
    changed = item.split(" ")
    changed[10] = "Zebra"
    [(_, _, share, matched, begin, end)] = leaks_of([" ".join(changed)], ItemSuffixes([7], [item]))
    assert 0.9 < share < 1 and matched < sum(c.isalnum() for c in item) and (begin, end) == (0, len(" ".join(changed)))
