"""Text decoded with the wrong character encoding: find it, and restore it where it can be.

A multinomial classifier over hashed byte bigrams is trained on clean lines of the corpus and on
the same lines garbled by every encoding chain (true encoding, wrong encoding, times).  Its summed
log odds of garbled against clean are run over every field; only fields that hold a passage with a
clear excess are looked at line by line.  There the classifier predicts the chain, the chain is
inverted, and the inversion counts only if it decodes strictly and reads like clean text.  What no
chain restores is still reported if characters are lost (U+FFFD) or the odds are overwhelming.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.sites import sample_texts
from newsloom.llm.textcodes import chunks

#: Hashed byte bigrams; rows of articles sampled to train on; characters of clean text used a language, and of these garbled.
BUCKETS, SAMPLE_ROWS, LANGUAGE_CHARS, GARBLED_CHARS = 8192, 2500, 400_000, 30_000
#: Excess log odds of a passage from which a field is looked at, and from which a line is garbled
#: though nothing restores it.
GATE, CERTAIN = 3.0, 14.0
#: Lines whose restoration a process remembers.
KNOWN_LINES = 20_000

# Fixed values: (true encoding, wrong encoding, times).
CHAINS = [
    ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 1), ("utf-8", "mac_roman", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1), ("utf-8", "cp1251", 1), ("utf-8", "koi8-r", 1),
    ("utf-8", "cp866", 1), ("utf-8", "gbk", 1), ("utf-8", "gb18030", 1), ("utf-8", "cp932", 1), ("utf-8", "big5", 1), ("utf-8", "cp949", 1), ("utf-8", "cp874", 1), ("utf-8", "cp1250", 1), ("utf-8", "iso8859-15", 1),
    ("utf-8", "latin-1", 2), ("utf-8", "cp1252", 2),
    ("cp1251", "latin-1", 1), ("cp1251", "cp1252", 1), ("cp1251", "koi8-r", 1), ("cp1251", "cp866", 1), ("koi8-r", "cp1251", 1), ("koi8-r", "latin-1", 1), ("koi8-r", "cp1252", 1), ("cp866", "cp1251", 1), ("cp1251", "mac_roman", 1),
    ("gbk", "latin-1", 1), ("gbk", "cp1252", 1), ("gbk", "utf-8", 1), ("gbk", "cp932", 1), ("big5", "gbk", 1), ("euc_jp", "latin-1", 1), ("euc_jp", "cp1252", 1), ("euc_jp", "gbk", 1), ("cp932", "latin-1", 1), ("cp932", "cp1252", 1), ("cp932", "utf-8", 1), ("cp932", "gbk", 1), ("euc_jp", "utf-8", 1), ("euc_jp", "cp932", 1),
    ("cp874", "latin-1", 1), ("cp874", "cp1252", 1), ("cp874", "utf-8", 1), ("cp1252", "utf-8", 1), ("cp1252", "mac_roman", 1), ("cp1252", "cp437", 1), ("cp1252", "cp1251", 1), ("mac_roman", "cp1252", 1), ("cp850", "cp1252", 1), ("cp1258", "cp1252", 1), ("cp1251", "utf-8", 1), ("koi8-r", "utf-8", 1),
]

WRONG = sorted({c[1] for c in CHAINS})

# Letters outside ASCII that clean lines of a language use.
ALPHABETS = {
    "en": "éèïöüç",
    "de": "äöüßÄÖÜ",
    "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ",
    "es": "áéíóúüñÁÉÍÓÚÜÑºª",
    "pt": "áâãàçéêíóôõúüÁÂÃÀÇÉÊÍÓÔÕÚÜºª",
    "vi": "àáâãèéêìíòóôõùúýăđĩũơưÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝĂĐĨŨƠƯ",
}
MARKS = "’‘“”„«»–—…·•¿¡№°§€ "


def single_byte_fix(name: str) -> dict[int, int]:
    """Bytes that a Windows code page leaves undefined are read as the control characters they are in Latin-1."""
    out = {}
    for b in range(256):
        try:
            bytes([b]).decode(name)
        except UnicodeDecodeError:
            out[b] = b
    return out


WINDOWS = {n: single_byte_fix(n) for n in ("cp1252", "cp1251", "cp1250", "cp874", "cp1258")}
#: Bytes of the characters of these code pages and of the control characters.
BACK = {n: {ord(bytes([b]).decode(n)) if b not in fixed else b: b for b in range(256)} for n, fixed in WINDOWS.items()}


def misread(raw: bytes, wrong: str) -> str:
    """Decode as a careless reader does: undefined bytes pass through, broken sequences become U+FFFD."""
    if wrong in WINDOWS:
        return "".join(bytes([b]).decode(wrong) if b not in WINDOWS[wrong] else chr(b) for b in raw) if WINDOWS[wrong].keys() & set(raw) else raw.decode(wrong)
    return raw.decode(wrong, "replace")


def unread(text: str, wrong: str) -> bytes:
    """The bytes that ``misread`` decoded; raises UnicodeEncodeError if there are none."""
    if wrong in BACK:
        return codecs.charmap_encode(text, "strict", BACK[wrong])[0]
    return text.encode(wrong)


def garble(text: str, chain: tuple[str, str, int]) -> str | None:
    true, wrong, times = chain
    try:
        for _ in range(times):
            text = misread(text.encode(true), wrong)
        return text
    except UnicodeEncodeError:
        return None


def invert(text: str, chain: tuple[str, str, int]) -> str | None:
    """The text before it went through the chain, or None unless that decodes strictly."""
    true, wrong, times = chain
    try:
        for _ in range(times):
            text = unread(text, wrong).decode(true)
        return text
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def is_clean(line: str, lang: str) -> bool:
    """Does a line look like text of its language as it should be?  Labels training lines only."""
    if "�" in line or len(line) < (12 if lang not in ("zh", "ja") else 4) or re.search(r"[\x80-\x9f-]", line):
        return False
    other = [c for c in line if not c.isascii() and c not in MARKS]
    if lang in ALPHABETS:
        extra = ALPHABETS[lang]
        return all(c in extra or (lang == "vi" and "Ạ" <= c <= "ỹ") for c in other) and not re.search("[ÃÂâ][\xa0-\xbf‘’“”€]", line)
    if lang == "ru":
        return all("Ѐ" <= c <= "џ" for c in other) and not re.search("[а-я][А-Я]", line) and len(other) > len(line) // 3
    if lang == "th":
        return all("฀" <= c <= "๿" for c in other) and len(other) > len(line) // 3
    if lang == "hi":
        return all("ऀ" <= c <= "ॿ" or c in "‌‍" for c in other) and len(other) > len(line) // 3
    try:
        line.encode("gb2312" if lang == "zh" else "euc_jp")
        return len(other) > len(line) // 3 and (lang == "zh" or bool(re.search("[぀-ゟ]", line)))
    except UnicodeEncodeError:
        return False


def hashed(pair: np.ndarray) -> np.ndarray:
    return (pair * np.uint32(2654435761)) >> np.uint32(19)


def bigrams(raw: np.ndarray) -> np.ndarray:
    """Hashed byte bigrams of an array of bytes."""
    return hashed((raw[:-1].astype(np.uint32) << np.uint32(8)) | raw[1:])


def telling_bigrams(text: str) -> np.ndarray:
    """Hashed byte bigrams of the UTF-8 form, without those of two ASCII bytes: no chain changes these, so they tell nothing."""
    raw = np.frombuffer(f"\n{text}\n".encode("utf-8", "surrogatepass"), np.uint8)
    return bigrams(raw)[(raw[:-1] > 127) | (raw[1:] > 127)]


@dataclass
class Model:
    odds: np.ndarray  # log odds garbled : clean of each bigram, all chains and languages together
    weights: np.ndarray  # log probability by class and bigram
    classes: list[tuple[str, str, int] | None]  # chain of each class; None: clean text of a language
    clean: np.ndarray  # rows of weights that are clean text

    def __post_init__(self):
        pair = np.arange(1 << 16, dtype=np.uint32)
        telling = (pair >> 8 > 127) | (pair & 255 > 127)
        #: log odds of every two bytes; those of two ASCII bytes tell nothing
        self.pair_odds = np.where(telling, self.odds[hashed(pair)], 0.0).astype(np.float32)
        self.by_bigram = np.ascontiguousarray(self.weights.T)
        self.garbled = np.array([c is not None for c in self.classes])
        self.chains = [c for c in CHAINS if c in self.classes]
        self.of_chain = [np.array([k for k, c in enumerate(self.classes) if c == chain]) for chain in self.chains]

        self._known: dict[str, tuple] = {}  # lines restored by this process; to know them only saves work

    def __getstate__(self) -> tuple:
        return self.odds, self.weights, self.classes, self.clean

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def restore(self, line: str) -> tuple[str, tuple[str, str, int] | None, float]:
        """``restore_line``, once for equal lines."""
        found = self._known.get(line)
        if found is None:
            if len(self._known) > KNOWN_LINES:
                self._known.clear()
            found = self._known[line] = restore_line(line, self)
        return found

    def line_scores(self, line: str) -> np.ndarray:
        return self.by_bigram[telling_bigrams(line)].sum(0)

    def sums(self, flat: np.ndarray) -> np.ndarray:
        """Running sums of the log odds of an array of bytes."""
        pair = flat[:-1].astype(np.uint16)
        pair <<= np.uint16(8)
        pair |= flat[1:]
        return np.cumsum(self.pair_odds[pair], dtype=np.float64)

    def clean_score(self, line: str) -> tuple[float, int]:
        """Log probability as clean text of the best language, and how many of the bigrams that language has not shown."""
        idx = telling_bigrams(line)
        if not len(self.clean):
            return 0.0, 0
        rows = self.clean[:, idx]
        best = int(rows.sum(1).argmax())
        return float(rows[best].sum()), int((rows[best] <= self.clean[best].min() + 1e-6).sum())

    def passage(self, line: str) -> tuple[str, float]:
        """The passage of a line with the largest summed log odds, and that sum."""
        raw = f"\n{line}\n".encode("utf-8", "surrogatepass")
        b = np.frombuffer(raw, np.uint8)
        sums = np.concatenate([[0.0], self.sums(b)])
        low = np.minimum.accumulate(sums)
        end = int(np.argmax(sums - low))
        begin = int(np.argmin(sums[: end + 1]))
        while begin > 0 and raw[begin] & 0xC0 == 0x80:
            begin -= 1
        end = min(end + 1, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        return raw[begin:end].decode("utf-8", "ignore").strip("\n"), float(sums.max() if end == 0 else (sums - low).max())

    def excess(self, texts: list[str]) -> np.ndarray:
        """Largest summed log odds of any passage of each text; none in ASCII alone."""
        out = np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if not t.isascii()]
        if some:
            out[some] = self._excess([texts[i] for i in some])
        return out

    def _excess(self, texts: list[str]) -> np.ndarray:
        raw = [f"\n{t}\n".encode("utf-8", "surrogatepass") for t in texts]
        flat = np.frombuffer(b"".join(raw) + b"\n", np.uint8)
        sums = self.sums(flat)
        lengths = np.array([len(r) for r in raw])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        step = 2 * (np.abs(sums).max() + 1)
        level = np.repeat(np.arange(len(texts)), lengths) * step
        low = np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]) - level)
        return np.maximum.reduceat(sums - level - low, starts)


def train(sample: list[tuple[str, str]]) -> Model:
    """``sample``: (language, content).  At most LANGUAGE_CHARS characters of clean lines a language are used."""
    lines: dict[str, list[str]] = {}
    used: dict[str, int] = {}
    for lang, content in sample:
        for line in content.split("\n"):
            if used.get(lang, 0) < LANGUAGE_CHARS and is_clean(line, lang):
                lines.setdefault(lang, []).append(line)
                used[lang] = used.get(lang, 0) + len(line)
    count = lambda texts: np.bincount(telling_bigrams("\n".join(texts)), minlength=BUCKETS).astype(np.float64)
    classes: list[tuple[str, str, int] | None] = []
    counts: list[np.ndarray] = []
    clean, garbled = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for lang, own in lines.items():
        c = count([*own, *(x.upper() for x in own[: len(own) // 8]), *(x[: len(x) * 2 // 3] + "…" for x in own[: len(own) // 8])])
        clean = np.maximum(clean, c / max(c.sum(), 1))
        classes.append(None)
        counts.append(c)
        few, size = [], 0
        for line in own:
            if size >= GARBLED_CHARS:
                break
            few.append(line)
            size += len(line)
        for chain in CHAINS:
            pairs = [(x, g) for x in few if (g := garble(x, chain)) is not None and g != x]
            if len(pairs) < 3:
                continue
            whole = count([g for _, g in pairs])
            new = np.maximum(whole - count([x for x, _ in pairs]), 0)  # what the chain brought in
            garbled += new / max(new.sum(), 1)
            classes.append(chain)
            counts.append(whole)
    if not counts:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros((1, BUCKETS), np.float32), [None], np.zeros((1, BUCKETS), np.float32))
    weights = np.array([np.log((c + 0.02) / (c.sum() + 0.02 * BUCKETS)) for c in counts], np.float32)
    n = sum(c is not None for c in classes)
    odds = np.log(garbled / max(n, 1) + 4e-6) - np.log(clean + 4e-6)
    return Model(odds.astype(np.float32), weights, classes, weights[[k for k, c in enumerate(classes) if c is None]])


#: A small letter before a capital within a Cyrillic word: one code page for Cyrillic read as another.
SWAPPED = re.compile("[а-яё][А-ЯЁ]{2}")
#: Characters that only a failed decoding leaves: the replacement character and private-use ones.
LOST = re.compile("[�\ue000-\uf8ff]")
NON_ASCII = re.compile(r"[^\x00-\x7f]+(?: [^\x00-\x7f]+)*")


@functools.cache
def repertoire(wrong: str) -> frozenset[str] | None:
    """Characters outside ASCII that have bytes in an encoding; None: all have."""
    if wrong in ("utf-8", "gb18030"):
        return None
    if wrong in BACK:
        return frozenset(chr(c) for c in BACK[wrong] if c > 127)
    every = [chr(k) for k in (*range(128, 0xD800), *range(0xE000, 0x10000))]
    coded = "\n".join(every).encode(wrong, "ignore").split(b"\n")
    return frozenset(c for c, b in zip(every, coded, strict=True) if b)


def invertible(line: str) -> dict[str, bool]:
    """Wrong encodings that have all characters of at least one passage outside ASCII, and whether they have those of all
    passages: no other can be inverted there."""
    runs = [frozenset(r) for r in re.findall(r"[^\x00-\x7f]+", line)]
    fits = {w: [known is None or r <= known for r in runs] for w in WRONG for known in [repertoire(w)]}
    return {w: all(f) for w, f in fits.items() if any(f)}


def restore_line(line: str, model: Model) -> tuple[str, tuple[str, str, int] | None, float]:
    """The restored line, the chain that was inverted (None: nothing was), and the log odds of garbled against clean.

    Every chain that can be inverted is; the one whose text is the likeliest counts.
    """
    part, excess = model.passage(line)
    if not model.garbled.any():
        return line, None, 0.0
    scores = model.line_scores(part)
    margin = float(scores[model.garbled].max() - scores[~model.garbled].max()) if (~model.garbled).any() else 0.0
    if margin <= 0 and not SWAPPED.search(line):
        return line, None, margin
    margin = min(margin, excess)
    before, strange = model.clean_score(line)
    seen = {line, None}
    can = invertible(line)
    best, fixed = (0.0, line, None), False
    likely = sorted(((float(scores[of].max()), chain) for chain, of in zip(model.chains, model.of_chain, strict=True) if chain[1] in can), reverse=True)
    for _, chain in likely:
        options = [invert(line, chain) if can[chain[1]] else None]
        if options[0] is None or options[0] == line:
            options = [NON_ASCII.sub(lambda m, chain=chain: invert(m[0], chain) or m[0], line)]
            if chain[0] == "utf-8":
                options.append(re.sub(r"[^\x00-\x7f]+", lambda m, chain=chain: invert(m[0], chain) or m[0], line))
        for restored in options:
            if restored in seen or re.search(r"[\x80-\x9f]", restored):
                continue
            seen.add(restored)
            after, still_strange = model.clean_score(restored)
            # the restored text has to be likelier, and made of what clean text shows
            if after - before > 6.0 and still_strange <= strange // 2 and (not fixed or after > best[0]):
                best, fixed = (after, restored, chain), True
    return (best[1], best[2], margin) if fixed else (line, None, margin)


def examine(text: str, model: Model) -> tuple[bool, str]:
    """Is any passage of the text garbled, and the text with what can be restored."""
    out, garbled = [], False
    lines = text.split("\n")
    suspect = model.excess(lines) >= GATE
    for line, look in zip(lines, suspect.tolist(), strict=True):
        if look or LOST.search(line) or SWAPPED.search(line):
            fixed, chain, margin = model.restore(line)
            if chain is not None or LOST.search(line) or margin >= CERTAIN:
                garbled = True
                line = fixed
        out.append(line)
    return garbled, "\n".join(out)


def fit(articles: DataFrame, sites: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on a bounded sample of ``rows`` articles with the language of their site."""
    return train([(lang, content) for lang, _, content in sample_texts(articles, sites, rows)])


def garbled_fields(fields: DataFrame, model: Model) -> DataFrame:
    """The garbled ones of ``fields`` (record_kind, record_id, field, text), with ``restored``.

    One narrow pass, no shuffle.  Null and empty texts are never garbled; a text of any length is
    examined whole; repeated rows give repeated rows; an empty table gives an empty result.
    ``restored`` equals ``text`` where nothing could be restored.
    """
    shared = fields.sparkSession.sparkContext.broadcast(model)  # BUCKETS x classes: its size does not depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for begin, end in chunks(texts, 1_000_000):
                part = [t or "" for t in texts[begin:end]]
                excess = model.excess(part)
                rows, fixed = [], []
                look = [i for i, (t, e) in enumerate(zip(part, excess.tolist(), strict=True)) if e >= GATE or LOST.search(t) or SWAPPED.search(t)]
                for i in look:
                    is_garbled, restored = examine(part[i], model)
                    if is_garbled:
                        rows.append(begin + i)
                        fixed.append(restored)
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(fixed, pa.string())], ["record_kind", "record_id", "field", "text", "restored"])

    return fields.select("record_kind", "record_id", "field", "text").mapInArrow(run, "record_kind string, record_id bigint, field string, text string, restored string")


def text_fields(items: DataFrame | None, articles: DataFrame, columns: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """(record_kind, record_id, field, text) of item titles and article columns that are not empty; each table is read once."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns)))
    out = articles.select(F.lit("article").alias("record_kind"), F.col("article_id").alias("record_id"), pairs.alias("f")).select("record_kind", "record_id", "f.field", "f.text")
    if items is not None:
        out = items.select(F.lit("item").alias("record_kind"), F.col("item_id").alias("record_id"), F.lit("title").alias("field"), F.col("title").alias("text")).unionByName(out)
    return out.filter(F.length("text") > 0)
