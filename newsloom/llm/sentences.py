"""Sentence boundaries by cascading tables of break and no-break rules.

A rule is a pair of regular expressions, one for the text before a position and one for the text
after it, and says whether the position is a boundary.  Positions are tried after every end mark
with its closing quotes and brackets (and, in Thai, at every space).  The rules of a position come
from a cascade of tables: those of its language, those of its script, then those that hold for
all; the first rule that matches decides, and a position that no rule matches is no boundary.  A
block that changes its script, or a long one its language, has a cascade for each part.

Before that, the text is cut into blocks at line breaks that end a headline, a list entry or a
paragraph; a line break inside a sentence (hard-wrapped text) is ordinary white space.  Positions
within a quotation or a bracket are no boundaries; the position after a quotation is judged by
where the quotation began: one that opens its sentence is followed by its reporting clause.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of context that a rule sees on either side.
CONTEXT = 28
#: Width up to which lines of a text can be hard-wrapped.
WRAP_WIDTH = 120
#: Letters (a third of it in dense scripts) of another script that make a part of a block.
PART = 60
#: Characters of a stretch in Latin script that is told apart by its function words.
STRETCH = 300

BREAK, JOIN = True, False


def compiled(pattern: str) -> re.Pattern:
    """Vietnamese capitals and small letters alternate in U+1EA0..U+1EF9, so no range holds either."""
    capitals, small = ("".join(map(chr, range(0x1EA0 + k, 0x1EFA, 2))) for k in (0, 1))
    return re.compile(pattern.replace("Ạ-Ỹ", capitals + "ĂĨŨƠƯ").replace("ạ-ỹ", small))


UP = r"(?:[\"'“„«»「『(\[¿¡—–-]\s?)*[A-ZÀ-ÖØ-ÞĀĂĐĨŨƠƯẠ-ỸА-ЯЁ0-9]"
LOW = r"\s*[\"'“„«»)\]]*[a-zß-öø-ÿāăđĩũơưạ-ỹа-яё]"
ANY = r""
END = r"(?:[.!?…]+[\"'”’“»)\]]*)$"

# Tables of (break?, before, after).  Abbreviations are fixed values, by language.
ENGLISH = [
    (JOIN, r"\b(?:Dr|Mr|Mrs|Ms|Prof|Rev|Gen|Sen|Rep|Capt|Sgt|Lt|Col|Hon|Messrs|Mt|Ft|St|vs|approx|ca|cf|al|Fig|Eq|Vol|Ch|Sec|pp|Nos|e\.g|i\.e|a\.k\.a|viz)\.$", ANY),
    (JOIN, r"\b(?:No|Art|p|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)\.$", r"\s*\d"),
    (JOIN, r"\b(?:Inc|Corp|Co|Ltd|etc|a\.m|p\.m|Jr|U\.S|U\.K|U\.N|E\.U)\.$", r"\s*(?:[a-z,;:)\d]|[—–-]\s)"),
    (JOIN, r"\b(?:U\.S|U\.K|U\.N|E\.U)\.$", ANY),
]
GERMAN = [
    (JOIN, r"\b(?:Dr|Prof|Hr|Fr|Fa|St|Nr|Abs|Art|Bd|Kap|Abb|Tab|bzw|ca|evtl|ggf|inkl|zzgl|vgl|lt|gem|sog|Mio|Mrd|Tsd|Str|[zZ]|z\.\s?B|d|u|d\.\s?h|u\.\s?a|i\.\s?d|o\.\s?ä|[Ss]|geb|gest|röm|ehem)\.$", ANY),
    (BREAK, r"[^\d.,]\d{1,3}\.$", r"\s+(?:Der|Die|Das|Den|Dem|Ein|Eine|Wer|Was|Wie|Am|Im|In|An|Auf|Nach|Vor|Mit|Und|Aber|Es|Er|Sie|Wir|Ich|Für|Ohne|Trotz|Unter|Gegen|Zum|Zur|Bei|Während|Dr)\b"),
    (JOIN, r"(?:^|[^\d.,])\d{1,3}\.$", r"\s+[A-ZÄÖÜa-zäöü]"),
    (JOIN, r"\b(?:usw|etc|u\.\s?dgl|h|a|B)\.$", r"\s*[a-zäöüß,;:)\d]"),
    (JOIN, r"\b[zdui]\.\s?[BhaR]\.$", ANY),
]
FRENCH = [
    (JOIN, r"\b(?:M|MM|Mme|Mlle|Dr|Pr|Me|Mgr|St|Ste|env|réf|art|av|bd|cf|chap|éd|fig|n°|p|pp|t|vol|tél|J\.-C)\.$", ANY),
    (JOIN, r"\b(?:etc|S\.A|hab|max|min)\.$", r"\s*[a-zà-ÿ,;:)]"),
]
SPANISH = [
    (JOIN, r"\b(?:Dr|Dra|Sr|Sra|Srta|Lic|Ing|Prof|D|Dña|Ud|Uds|aprox|art|arts|pág|págs|núm|vol|cap|av|avda|tel|EE\.\s?UU|p\.\s?ej)\.$", ANY),
    (JOIN, r"\b(?:etc|S\.A|S\.L|a\.\s?m|p\.\s?m|cía)\.$", r"\s*[a-zà-ÿ,;:)]"),
]
PORTUGUESE = [
    (JOIN, r"\b(?:Dr|Dra|Sr|Sra|Srta|Prof|Profa|Eng|Exmo|Exma|aprox|art|arts|pág|págs|núm|nº|vol|cap|av|tel|séc|p\.\s?ex)\.$", ANY),
    (JOIN, r"\b(?:etc|S\.A|Ltda|Cia)\.$", r"\s*[a-zà-ÿ,;:)]"),
]
VIETNAMESE = [
    (JOIN, r"\b(?:TP|Tp|TS|ThS|GS|PGS|BS|KS|ĐH|Q|P|Mr|Ms|Dr|tr)\.$", ANY),
    (JOIN, r"\bv\.v\.$", r"\s*[a-zà-ỹ,;:)]"),
]
RUSSIAN = [
    (JOIN, r"\b(?:ул|пр|просп|пер|пл|д|кв|корп|стр|гл|рис|табл|инж|Инж|проф|Проф|акад|д-р|г-н|г-жа|св|им|тов|см|ср|напр|т|тел|№|обл|р-н|пос|с)\.$", ANY),
    (JOIN, r"\bт\.\s?[екдпч]\.$", r"\s*[а-яё,;:)]"),
    (JOIN, r"\b(?:руб|коп|тыс|млн|млрд|г|гг|в|вв|др|пр|чел|экз|кг|км|м|ч|мин|сек)\.$", r"\s*[а-яё,;:)]"),
]
HINDI = [
    (JOIN, r"(?:डॉ|श्री|श्रीमती|प्रो|लि|कं|रु|पं|नं)\.$", ANY),
]
LOWER_ABBREVIATIONS = "dr|dra|mr|mrs|ms|prof|st|sr|sra|no|nr|art|vs|approx|ca|i\\.e|e\\.g|a\\.k\\.a|inc|corp|co|etc|u\\.s|a\\.m|p\\.m|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec|fa|mio|lt|env|réf|aprox|pág|tp|ts|ул|инж|руб|г|т|usw|m|mme|s\\.a|z|d|u|p"
LATIN_AND_CYRILLIC = [
    (JOIN, r"^\s*\(?\d{1,3}\.$", r"\s"),  # the number of a list entry
    (JOIN, r"(?:^|[^\w.])[A-ZÀ-ÞА-ЯЁ]\.$", r"\s*[A-ZÀ-ÞА-ЯЁ]"),  # an initial
    (JOIN, r"\d[.]$", r"\d"),
    (JOIN, END, r"\s*[,;:]"),
    (JOIN, END, r"\s*[—–]\s*[a-zß-öø-ÿāăđĩũơưạ-ỹа-яё]"),  # a reporting clause after a dash
    (JOIN, r"\)$", r"\s*[—–]"),
    (JOIN, r"(?:Co|Inc|Corp|Ltd)\.$", r"\s*[—–]"),
    (BREAK, END, r"\s+" + UP),
    (BREAK, r"(?:[a-zß-öø-ÿạ-ỹа-яё%)\]”»’“]|\d)(?:[.!?…]+[\"'”’»)\]]*)$", r"(?:[\"'“„«¿¡—(]\s?)*[A-ZÀ-ÖØ-ÞĐẠ-ỸА-ЯЁ](?!\.)"),  # no space after the mark
    (BREAK, END, r"\s*[぀-ヿ一-鿿฀-๿ऀ-ॿ]"),
    (JOIN, r"\b(?:" + LOWER_ABBREVIATIONS + r")\.$", ANY),
    (BREAK, r"[^\W\d_]{3,}[.!?]$|[\d)%][.!?]$", r"\s+[a-zß-öø-ÿāăđĩũơưạ-ỹа-яё][^A-ZÀ-ÖØ-ÞĐẠ-ỸА-ЯЁ.!?]{24,}[.!?]"),  # a lower-cased passage
    (BREAK, END, r"\s+[¿¡•*#@&]|\s+[^\w\s,;:)\]a-zа-я]*\s*" + UP),
]
LOWER_CASE = [
    (JOIN, r"(?:^|[^\w.])[a-zа-яё]\.$", ANY),
    (JOIN, r"\b(?:" + LOWER_ABBREVIATIONS + r")\.$", ANY),
    (JOIN, r"\.\.+$|…$", ANY),
    (JOIN, r"[\"”’“»]$", ANY),
    (BREAK, END, r"\s+\S"),
]
CJK = [
    (JOIN, r"(?:…|⋯)+$", ANY),
    (JOIN, r"\.$", r"\S"),
    (BREAK, r"[。！？!?｡]+[”’」』）)\"]*$", ANY),
    (BREAK, r"[.]$", r"\s"),
]
DEVANAGARI = [
    (BREAK, r"[।॥?!？！]+[”’\"')]*$", ANY),
    (BREAK, r"[.]$", r"\s"),
]
THAI = [
    (JOIN, r"[—–:,(\-/•*]$", ANY),
    (JOIN, ANY, r"\s*(?:[—–:,;()/\-]|ๆ|ฯ)"),
    (JOIN, r"(?:ดร|พ\.ศ|รศ|ผศ)\.$", ANY),
    (BREAK, r"[฀-๿\d%”\"’)?!.]$", r"\s+[฀-๿“\"‘(\dA-Z]"),
]
STRONG = [(BREAK, r"[।॥。！？]+[”’」』）)\"]*$", ANY)]

CASCADES = {
    "en": [ENGLISH, LATIN_AND_CYRILLIC, STRONG],
    "de": [GERMAN, LATIN_AND_CYRILLIC, STRONG],
    "fr": [FRENCH, LATIN_AND_CYRILLIC, STRONG],
    "es": [SPANISH, LATIN_AND_CYRILLIC, STRONG],
    "pt": [PORTUGUESE, LATIN_AND_CYRILLIC, STRONG],
    "vi": [VIETNAMESE, LATIN_AND_CYRILLIC, STRONG],
    "ru": [RUSSIAN, LATIN_AND_CYRILLIC, STRONG],
    "hi": [HINDI, DEVANAGARI, LATIN_AND_CYRILLIC],
    "zh": [CJK, LATIN_AND_CYRILLIC],
    "th": [THAI, LATIN_AND_CYRILLIC, STRONG],
    "lower": [LOWER_CASE, STRONG],
    "": [ENGLISH, GERMAN[:1] + GERMAN[3:], FRENCH, SPANISH, PORTUGUESE, VIETNAMESE, LATIN_AND_CYRILLIC, STRONG],
}
TABLES = {k: [(b, compiled(x).search, compiled(y).match) for table in v for b, x, y in table] for k, v in CASCADES.items()}

#: Frequent short words that tell Latin-script languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in for a is with by on at from has was",
    "de": "der die das und den dem ein eine mit auf für von nach im am zum zur bei ist",
    "fr": "le la les des du et une un à pour dans sur avec est de par au aux",
    "es": "el la los las de y en un una por para con del su se al",
    "pt": "o a os as de e em um uma para com do da no na ao por dos das",
    "vi": "của và là các những cho trong với một được tại không đã người ở về sau",
}
WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
LANGUAGES_OF = {w: tuple(k for k, known in WORDS.items() if w in known) for known in WORDS.values() for w in known}
SCRIPTS = re.compile(r"([฀-๿]+)|([ऀ-ॿ]+)|([぀-ヿ一-鿿]+)|([Ѐ-ӿ]+)|([A-Za-zÀ-ɏẠ-ỹ]+)")
LETTER = re.compile("[A-Za-z]")
CANDIDATE = re.compile(r"[.!?…。！？।॥｡]+(?:\s?»|['”’»」』）)\]])*")
#: Full-width letters and digits, read as their ordinary forms.
NARROW = {0xFEE0 + c: c for c in (*range(48, 58), *range(65, 91), *range(97, 123), 46, 44)}
WIDE = re.compile(r"[Ａ-Ｚａ-ｚ]")
INNER_END = re.compile(r"[.!?](?:\s?»|[\"”“])?,?\s+\S")
SPACED_OPEN_END = re.compile(r"[A-Za-zÀ-ɏẠ-ỹА-яё0-9,;%]$")
UNCASED_OPEN_END = re.compile(r"[぀-ヿ一-鿿，、ऀ-ॿ]$")
THAI_GAP = re.compile(r"(?<=[฀-๿\d%”\"’)?!.])[^\S\n]+(?=\S)")
PAIRS = re.compile(r"[„“”«»「」『』（）()\"]")
CLOSERS = {"„": "“”", "“": "”", "«": "»", "「": "」", "『": "』", "（": "）)", "(": ")）", "\"": "\""}
OPENERS = {c: [o for o in CLOSERS if c in CLOSERS[o]] for closers in CLOSERS.values() for c in closers}
BULLET = re.compile(r"[-*•·▪◦‣]\s|\d{1,3}[.)]\s")
DATELINE = re.compile(r"\s*[—–]\s")
LINE_END = re.compile(r"[.!?…。！？।॥]['\"”’“»」』）)\]]*$")
LOWER_START = compiled(r"[a-zß-öø-ÿāăđĩũơưạ-ỹа-яё]")
UPPER = compiled(r"[A-ZÀ-ÖØ-ÞĐẠ-ỸА-ЯЁ]")
LOWER = compiled(r"[a-zß-öø-ÿđạ-ỹа-яё]")


def language(block: str) -> str:
    """Rule cascade of a block, or of a part: by its script, in Latin script by function words."""
    n = [0] * 6
    if block.isascii():
        n[5] = bool(LETTER.search(block))
    else:
        for m in SCRIPTS.finditer(block):
            n[m.lastindex] += m.end() - m.start()
    top = max(range(1, 6), key=n.__getitem__)
    if n[top] == 0:
        return ""
    if n[3] * 3 >= n[5] and n[3] >= n[1] and n[3] >= n[2] and n[3] > n[4]:
        return "zh"
    if top in (4, 5):
        if not UPPER.search(block):
            return "lower"
        if top == 4:
            return "ru"
        hits = function_words(block)
        best = max(hits, key=hits.__getitem__)
        return best if hits[best] else ""
    return {1: "th", 2: "hi", 3: "zh"}[top]


def function_words(block: str) -> dict[str, int]:
    hits = dict.fromkeys(WORDS, 0)
    for w in block.lower().split():
        for lang in LANGUAGES_OF.get(w, ()):
            hits[lang] += 1
    return hits


def script_parts(block: str) -> list[tuple[int, int]]:
    """Spans of a block by script: the cheapest ones if a letter of another script costs one and a change costs PART."""
    if block.isascii():
        return [(0, len(block))]
    runs = [(m.start(), m.lastindex, (m.end() - m.start()) * (3 if m.lastindex == 3 else 1)) for m in SCRIPTS.finditer(block)]
    n = [0] * 6
    for _, script, weight in runs:
        n[script] += weight
    if sum(n) - max(n) <= PART:
        return [(0, len(block))]
    cost, came = [0] * 6, []
    for _, script, weight in runs:
        least = min(range(1, 6), key=cost.__getitem__)
        came.append([k if cost[k] <= cost[least] + PART else least for k in range(6)])
        cost = [min(c, cost[least] + PART) + (weight if k != script else 0) for k, c in enumerate(cost)]
    state, cuts = min(range(1, 6), key=cost.__getitem__), [len(block)]
    for (start, _, _), of in zip(reversed(runs), reversed(came), strict=True):
        if of[state] != state:
            cuts.append(start)
            state = of[state]
    cuts = [0, *sorted(c for c in cuts if c)]
    return list(zip(cuts, cuts[1:], strict=False))


def cascades(block: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind): the parts of a block and the rule cascade of each.

    A long part in Latin script is told by function words stretch by stretch; a stretch whose words do
    not clearly tell another language has that of the whole part.
    """
    out = []
    for a, b in script_parts(block):
        kind = language(block[a:b])
        if kind not in WORDS or b - a < 2 * STRETCH:
            out.append((a, b, kind))
            continue
        ends = [m.end() for m in CANDIDATE.finditer(block, a, b)] + [b]
        for end in ends:
            if end == b or end - a >= STRETCH and b - end >= STRETCH:
                hits = function_words(block[a:end])
                best = max(hits, key=hits.__getitem__)
                out.append((a, end, best if hits[best] > 2 * hits[kind] else kind))
                a = end
    return out


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans that no sentence crosses: headlines, list entries, paragraphs."""
    lines, at = [], 0
    for line in re.split(r"\n|[\u2028\u2029\x0b\x0c]", text):
        lines.append((at, at + len(line), line.strip()))
        at += len(line) + 1
    ends = continued = 0
    cased = bool(UPPER.search(text))
    for k, ((_, _, a), (_, _, b)) in enumerate(zip(lines, lines[1:], strict=False)):
        if a and b and len(a) <= WRAP_WIDTH and not BULLET.match(b):
            ends += 1
            if not LINE_END.search(a):
                latin = LOWER_START.match(b) and cased and (LOWER.search(a) and a[-1] != ":")
                cjk = k and UNCASED_OPEN_END.search(a) and not BULLET.match(a) and not LOWER_START.match(b)
                continued += bool(latin or cjk)
    wrapped = continued and continued * 8 >= ends
    begin = None
    for k, (start, stop, line) in enumerate(lines):
        if begin is None:
            begin = start
        follows = lines[k + 1][2] if k + 1 < len(lines) else ""
        if line and follows and not BULLET.match(follows):
            entry = bool(BULLET.match(lines[k][2])) or (begin < start and bool(BULLET.match(text[begin : begin + 8].lstrip())))
            if wrapped and len(line) <= WRAP_WIDTH and not (entry and not LOWER_START.match(follows)):
                continue
            if not LINE_END.search(line) and line[-1] != ":":
                leak = k == 0 and not UPPER.search(follows) and len(follows) > 60  # a lower-cased passage under a headline
                if LOWER_START.match(follows) and LOWER.search(line) and not leak:
                    continue
                if follows[0] in "–—" and follows[1:2] == " ":
                    continue
                words = line.rsplit(None, 1)
                if words[-1].lower() in LANGUAGES_OF and len(words) > 1:  # no headline ends with such a word
                    continue
                running = k or len(line) > WRAP_WIDTH or INNER_END.search(line)
                if running and not entry and SPACED_OPEN_END.search(line) and len(line) >= WRAP_WIDTH // 3 and LOWER.search(line):
                    continue
                if (k or wrapped) and not entry and UNCASED_OPEN_END.search(line) and not LOWER_START.match(follows):
                    continue
            if line[-1] == "," and follows[0].isalnum():
                continue
        yield begin, stop
        begin = None


def pairs(block: str) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans of quotations and brackets, outermost only; places of all closing marks.  An opening mark that nothing closes has no span."""
    found: list[tuple[int, int]] = []
    closing: set[int] = set()
    stack: list[tuple[int, str]] = []
    waiting = dict.fromkeys(CLOSERS, 0)
    for m in PAIRS.finditer(block):
        c, i = m[0], m.start()
        if any(waiting[o] for o in OPENERS.get(c, ())):
            while True:  # what was opened since is never closed
                opened, by = stack.pop()
                waiting[by] -= 1
                if c in CLOSERS[by]:
                    break
            found.append((opened, i))
            closing.add(i)
        elif c in CLOSERS:
            stack.append((i, c))
            waiting[c] += 1
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out, closing


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Offsets of the sentences of a text, in code points, end excluded."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    plain = text.translate(NARROW) if WIDE.search(text) else text
    for first, stop in blocks(plain):
        block = plain[first:stop]
        parts = cascades(block)
        for k, (a, b, kind) in enumerate(parts):
            part = block[a:b]
            if kind not in ("lower", "zh", "hi", "th", "") and not LOWER.search(part) and len(part.lower()) == len(part):
                parts[k], block = (a, b, "lower"), block[:a] + part.lower() + block[b:]
        spans, closing = pairs(block)
        marks = set()
        for m in CANDIDATE.finditer(block):
            i = m.end()
            while i in closing:
                i += 1
            marks.add(i)
        for a, b, kind in parts:
            if kind == "th":  # a gap before the next part included
                marks.update(m.start() for m in THAI_GAP.finditer(block, a, b + 1))
        begin = near = at = 0
        for i in sorted(marks):
            if i >= len(block):
                continue
            while parts[at][1] < i:
                at += 1
            kind = parts[at][2]
            inside = closed = None
            while near < len(spans) and spans[near][1] < i - 3:
                near += 1
            for k in range(near, len(spans)):
                a, b = spans[k]
                if a >= i:
                    break
                if i <= b:
                    inside = True
                    break
                if i - b <= 3 and not block[b + 1 : i].strip(" .!?…。！？।"):
                    closed = (a, b)
            if inside:
                continue
            if closed is not None and i == closed[1] + 1:
                a, b = closed
                opens = not block[begin:a].strip(" \t\r\n\xa0—–-•*")
                after = block[i : i + 6].lstrip()
                if opens and kind != "th" and after and not UPPER.match(after.lstrip("“„«\"(¿¡—– ") or " "):
                    continue  # its reporting clause follows
                if block[a] in "(（" and not opens:
                    continue  # a remark in brackets within the sentence
                if kind == "zh" and block[a] not in "(（" and block[max(0, a - 1) : a] not in ("：", ":", "，", ","):
                    continue
                if not opens and kind in ("zh", "hi") and block[b - 1] in "。！？।?!":
                    out.append((first + begin, first + i))
                    begin = i
                    continue
            if i - begin < 45 and DATELINE.match(block, i):
                continue
            before = block[max(0, i - CONTEXT, begin) : i]
            for breaks, x, y in TABLES[kind]:
                if x(before) and y(block, i):
                    if breaks:
                        out.append((first + begin, first + i))
                        begin = i
                    break
        out.append((first + begin, first + len(block)))
    trimmed = []
    for a, b in out:
        part = text[a:b]
        lead = len(part) - len(part.lstrip())
        body = part.strip()
        if body:
            trimmed.append((a + lead, a + lead + len(body)))
    return trimmed


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, start_char, end_char)`` of every sentence.  One narrow pass, no shuffle.

    Null, empty and blank texts give no row; a text without any boundary is one sentence; repeated
    rows give repeated rows; texts of any length are cut whole; an empty table gives an empty
    result.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, max(batch.num_rows, 1), 2000):
                part = batch.slice(begin, 2000)
                found = [sentences(t) for t in part.column(1).to_pylist()]
                rows = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], [id_col, "start_char", "end_char"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start_char bigint, end_char bigint")
