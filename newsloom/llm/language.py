"""The language of each article and of each passage, by compression.

Clean lines of a bounded sample of the corpus make one raw-content zstandard dictionary a language.
A passage is compressed with the dictionary of every language of its script; the smallest result
names the language, unless the next one is almost as small.  Garbled text is restored before.
Boilerplate lines do not count: those that the site repeats, that carry its name, or that the page
shows outside its main body (the page is read only where the lines disagree).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import mojibake
from newsloom.llm.mainbody import line_flags, prepared
from newsloom.llm.residue import evidence
from newsloom.llm.sitelines import host_lines, repeated_flags
from newsloom.llm.sites import sample_texts

#: Rows sampled to train on, bytes of a dictionary, and the share of the next best size by which the best must beat it.
SAMPLE_ROWS, DICTIONARY_BYTES, MARGIN = 2500, 60_000, 0.08
LEVEL = 3
#: Characters of a passage that are compressed at a time.
PART = 600

# Frequent short words; they seed a dictionary and check lines to train on.
FUNCTION_WORDS = {
    "en": "the of and to in for a is with by on at from has was that after under before",
    "de": "der die das und den dem ein eine mit auf für von nach im am zum zur bei ist nicht",
    "fr": "le la les des du et une un à pour dans sur avec est de par au aux ce que",
    "es": "el la los las de y en un una por para con del su se al que más tras no ante",
    "pt": "o a os as de e em um uma para com do da no na ao por dos das não",
    "vi": "của và là các những cho trong với một được tại không đã người ở về sau trước",
    "ru": "и в на с по для из не что от до как за при без",
    "hi": "के की में का है और से को ने पर",
    "th": "และ ของ ใน ที่ การ เป็น ให้ ได้",
    "zh": "的 了 在 和 是 并 由 与 对 中",
    "ja": "の は に を が と で も した する",
}
LATIN = ("en", "de", "fr", "es", "pt", "vi")
WORDS = {k: frozenset(FUNCTION_WORDS[k].split()) for k in LATIN}
SCRIPTS = re.compile(r"([A-Za-zÀ-ɏḀ-ỿ]+)|([Ѐ-ӿ]+)|([぀-ヿｦ-ﾟ]+)|([一-鿿㐀-䶿]+)|([฀-๿]+)|([ऀ-ॿ]+)|([가-힣ᄀ-ᇿ]+)|([؀-ۿ]+)|([Ͱ-Ͽ]+)|([֐-׿]+)")
KINDS = range(1, 11)
CANDIDATES = {1: LATIN, 2: ("ru",), 3: ("ja", "zh"), 4: ("zh", "ja"), 5: ("th",), 6: ("hi",)}
#: Scripts that tell a language although no dictionary is trained for it; Arabic script is that of several, so it tells none.
ALONE = {7: "ko", 9: "el", 10: "he"}
#: Words of a passage in Latin script, none of which is a frequent one of the language named, that say that it is in another
#: (Vietnamese has letters of its own).
STRANGE = 20

# ISO 639 codes and names of languages in labels.
LABELS = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano",
    "pt": "por portuguese português portugues", "vi": "vie vietnamese tiếng_việt", "ru": "rus russian русский", "hi": "hin hindi हिन्दी हिंदी", "th": "tha thai ไทย ภาษาไทย",
    "zh": "zho chi cmn chinese mandarin 中文 汉语 简体中文", "ja": "jpn japanese 日本語", "ko": "kor korean 한국어", "it": "ita italian italiano", "nl": "nld dut dutch nederlands",
    "ar": "ara arabic", "pl": "pol polish polski", "tr": "tur turkish", "sv": "swe swedish", "id": "ind indonesian", "uk": "ukr ukrainian", "cs": "ces cze czech", "fa": "fas per persian", "el": "ell gre greek", "he": "heb hebrew", "da": "dan danish", "fi": "fin finnish", "no": "nor norwegian", "hu": "hun hungarian", "ro": "ron rum romanian", "bn": "ben bengali", "ta": "tam tamil", "ms": "msa may malay",
}
NAMED = {n.replace("_", " "): code for code, names in LABELS.items() for n in [code, *names.split()]}
NOTHING = frozenset(["", "-", "--", "?", "und", "unknown", "none", "null", "n/a", "na", "mul", "zxx", "undefined", "auto", "xx", "other"])


def label_code(label: str | None) -> str | None:
    """Two-letter code that a label names, whatever its notation; None if it says nothing."""
    text = (label or "").strip().lower()
    if text in NOTHING:
        return None
    if text in NAMED:
        return NAMED[text]
    head = re.split(r"[-_ .]", text)[0]
    return NAMED.get(head, head if re.fullmatch(r"[a-z]{2,3}", head) and head not in NOTHING else None)


_LETTERS = re.compile(r"[^A-Za-zÀ-ɏḀ-ỿ]+")
_OTHER_SCRIPTS = re.compile(r"[Ѐ-ӿऀ-ॿ฀-๿぀-ヿ㐀-䶿一-鿿ｦ-ﾟ가-힣ᄀ-ᇿ؀-ۿͰ-Ͽ֐-׿]")
#: Addresses and domain names: in Latin script whatever the language around them.
ADDRESS = re.compile(r"(?:https?://\S+|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")


def script_counts(text: str) -> list[int]:
    """Letters of a text by script, at the places of the groups of SCRIPTS."""
    n = [0] * (len(KINDS) + 1)
    if not _OTHER_SCRIPTS.search(text):
        n[1] = len(_LETTERS.sub("", text))
    else:
        for m in SCRIPTS.finditer(text):
            n[m.lastindex] += m.end() - m.start()
    return n


@dataclass
class Model:
    dictionaries: dict[str, bytes]

    def __post_init__(self):
        self._ready: dict[str, zstandard.ZstdCompressor] | None = None
        self._known: dict[str, tuple[str | None, float]] = {}

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "_ready": None, "_known": {}}

    def compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        if self._ready is None:
            self._ready = {}
            for lang, raw in self.dictionaries.items():
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._ready[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return self._ready

    def classify(self, text: str) -> tuple[str | None, float]:
        """(language, confidence) of a passage; None if it has no letters or the margin is narrow."""
        found = self._known.get(text)
        if found is None:
            found = self._classify(text)
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[text] = found
        return found

    def _classify(self, text: str) -> tuple[str | None, float]:
        letters = script_counts(ADDRESS.sub(" ", text) if "." in text and _OTHER_SCRIPTS.search(text) else text)
        # a character of a script without spaces says as much as some letters
        weighed = [n * (3 if k in (3, 4) else 1) for k, n in enumerate(letters)]
        script = max(KINDS, key=weighed.__getitem__)
        if not weighed[script]:
            return None, 0.0
        if script == 4 and letters[3] * 5 >= letters[4]:
            script = 3
        if script in ALONE:
            return ALONE[script], weighed[script] / sum(weighed)
        candidates = [c for c in CANDIDATES.get(script, ()) if c in self.dictionaries]
        share = (weighed[3] + weighed[4] if script in (3, 4) else weighed[script]) / sum(weighed)
        if len(candidates) <= 1:
            return (candidates[0], share) if candidates else (None, 0.0)
        # long passages go in parts, so that what they repeat themselves does not hide what the dictionary knows
        parts = [text] if len(text) <= PART else [text[k : k + PART] for k in range(0, len(text), PART)]
        raws = [p.encode("utf-8", "surrogatepass") for p in parts]
        compressors = self.compressors()
        sizes = sorted((sum(len(compressors[c].compress(r)) for r in raws), c) for c in candidates)
        (best, lang), (second, _) = sizes[0], sizes[1]
        margin = (second - best) / max(second, 1)
        if margin < MARGIN:
            return None, share * (0.5 + margin / MARGIN / 4)
        if script == 1:
            words = text.lower().split() if lang != "vi" else ()
            if len(words) >= STRANGE and WORDS[lang].isdisjoint(words):
                return None, share / 2
        return lang, share * (1 - best / max(second, 1) / 2)


def fit(articles: DataFrame, sites: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Dictionaries from a bounded sample of ``rows`` labelled articles."""
    return train(sample_texts(articles, sites, rows))


def train(sample: list[tuple[str | None, str | None, str]]) -> Model:
    """``sample``: (language of the site, label, content).  A line trains a language that its words speak for and that its site or its label names."""
    parts: dict[str, list[str]] = {k: [] for k in FUNCTION_WORDS}
    used = dict.fromkeys(FUNCTION_WORDS, 0)
    for site_lang, label, content in sample:
        named = {site_lang, label_code(label)}
        for line in content.split("\n"):
            lang = line_language(line)
            if lang and lang in named and used[lang] < DICTIONARY_BYTES and mojibake.is_clean(line, lang):
                parts[lang].append(line)
                used[lang] += len(line.encode())
    return Model({k: (FUNCTION_WORDS[k] + "\n" + "\n".join(v)).encode()[-DICTIONARY_BYTES:] for k, v in parts.items()})


def line_language(line: str) -> str | None:
    """A label for training: script, or a clear majority of function words."""
    letters = script_counts(line)
    if sum(letters) < 15:
        return None
    script = max(KINDS, key=letters.__getitem__)
    if letters[script] < 0.8 * sum(letters) and script not in (3, 4):
        return None
    if script == 1:
        words = line.lower().split()
        hits = sorted(((sum(w in known for w in words), k) for k, known in WORDS.items()), reverse=True)
        return hits[0][1] if hits[0][0] >= 2 and hits[0][0] >= 1.5 * hits[1][0] + 0.5 else None
    return {2: "ru", 3: "ja", 4: "ja" if letters[3] * 8 >= letters[4] else "zh", 5: "th", 6: "hi"}.get(script)


ENDS = re.compile(r"(?:[.!?…]+[\"'”’“»)\]]*(?=\s|$|[A-ZА-ЯÀ-Þ])|[。！？।]+)")
ABBREVIATED = re.compile(r"(?:^|[\s(])(?:[^\W\d_]{1,2}|Dr|Mr|Mrs|No|Nr|St|Sra|art|pág|approx|aprox|env|réf|Corp|Inc|Co|Mio|Mme|руб|ул|Инж|etc|usw)\.$")


def sentence_count(text: str, lang: str | None) -> int:
    """Whole sentences of a passage (about)."""
    if lang == "th":
        return max(sum(len(p) >= 15 for p in text.split()), min(2, len(text) // 120 + 1))
    n = 0
    for m in ENDS.finditer(text):
        if not ABBREVIATED.search(text[max(0, m.start() - 8) : m.start() + 1]):
            n += 1
    return n


_SENTENCES = re.compile(r"(?<=[.!?。！？।])\s*(?=\S)")


def foreign_words(sentences: list[str], lang: str) -> bool:
    """Does a sentence in Latin script hold frequent words of another language, clearly more than of this one?"""
    for sentence in sentences:
        words = sentence.lower().split()
        own = sum(w in WORDS[lang] for w in words)
        if any(k != lang and (n := sum(w in known for w in words)) >= 2 and n >= 2 * own + 1 for k, known in WORDS.items()):
            return True
    return False


def pieces(line: str, model: Model) -> list[tuple[str, str | None, float]]:
    """(passage, language, confidence): the line, or its runs of sentences where it mixes scripts or languages."""
    whole = model.classify(line)
    if _OTHER_SCRIPTS.search(line):
        n = script_counts(line)
        n[3] += n[4]
        n[4] = 0
        mixed = sorted(n)[-2] >= 25
    else:
        mixed = None
    if mixed is False or len(line) < 60:
        return [(line, *whole)]
    cut = [p for p in _SENTENCES.split(line) if p]
    if len(cut) < 2 or mixed is None and whole[0] is not None and not foreign_words(cut, whole[0]):
        return [(line, *whole)]
    out: list[tuple[str, str | None, float]] = []
    for p in cut:
        lang, sure = model.classify(p)
        if out and out[-1][1] == lang:
            text, _, other = out.pop()
            out.append((f"{text} {p}", lang, (sure * len(p) + other * len(text)) / (len(p) + len(text))))
        else:
            out.append((p, lang, sure))
    return out


def segments(lines: list[str], kept: list[bool], model: Model) -> list[tuple[int, str, str | None, float]]:
    """(line number, passage, language, confidence) of the kept lines; a passage that cannot be told, between two in one
    language, takes theirs."""
    out: list[tuple[int, str, str | None, float]] = []
    for k, (line, keep) in enumerate(zip(lines, kept, strict=True), 1):
        if keep and line.strip():
            out.extend((k, *p) for p in pieces(line.strip(), model))
    after, following = None, [None] * len(out)
    for i in range(len(out) - 1, -1, -1):
        following[i] = after
        after = out[i][2] or after
    before = None
    for i, (k, p, lang, sure) in enumerate(out):
        if lang is None and sure and before is not None and before == following[i]:
            out[i] = (k, p, before, sure)
        before = out[i][2] or before
    return out


def passages(found: list[tuple[int, str, str | None, float]]) -> dict[str, tuple[int, int]]:
    """language -> (sentences in all, most in one passage of neighbouring lines)."""
    totals: dict[str, list[int]] = {}
    current, run = None, 0
    for _, text, lang, _ in found:
        n = sentence_count(text, lang)
        if lang is None:
            continue
        run = run + n if lang == current else n
        current = lang
        t = totals.setdefault(lang, [0, 0])
        t[0] += n
        t[1] = max(t[1], run)
    return {k: (a, b) for k, (a, b) in totals.items()}


def article_languages(content: str, html: str | None, repeated: list[bool], source: str | None, site_lang: str | None, model: Model, repair: mojibake.Model | None) -> list[tuple[str, float]]:
    """(language, confidence) of the main body, the main language first; empty if there are no letters to judge."""
    name = source.casefold() if source else ""
    named = bool(name) and name in content.casefold()
    texts = content.split("\n")
    kept = [not r and not (named and len(t) < 200 and name in t.casefold()) and " > " not in t for t, r in zip(texts, repeated, strict=True)]
    lost = False
    if repair is not None and (mojibake.LOST.search(content) or mojibake.SWAPPED.search(content) or repair.excess([content])[0] >= mojibake.GATE):
        fixed = mojibake.examine(content, repair)[1].split("\n")
        # what lost its characters says nothing of its language
        lost = any(mojibake.LOST.search(t) for t in fixed)
        kept = [k and not (len(mojibake.LOST.findall(t)) * 20 > len(t)) for k, t in zip(kept, fixed, strict=True)]
        texts = fixed
    found = segments(texts, kept, model)
    seen = passages(found)
    if len(seen) > 1 and html:
        flags = line_flags(content, html, repeated, source)
        if any(flags):
            inside = segments(texts, [a and b for a, b in zip(kept, flags, strict=True)], model)
            if passages(inside):
                found, seen = inside, passages(inside)
    if not seen:
        return [(site_lang, 0.3)] if lost and site_lang else []
    size: dict[str, int] = {}
    for _, p, lang, _ in found:
        if lang:
            size[lang] = size.get(lang, 0) + len(p) * (3 if lang in ("zh", "ja") else 1)
    main = max(seen, key=lambda x: (seen[x][0], size.get(x, 0)))
    if seen[main][0] == 0:
        main = max(size, key=size.get)
    confidence = {}
    for lang in seen:
        own = [c for _, p, x, c in found if x == lang]
        confidence[lang] = sum(own) / len(own)
    rest = sorted((x for x in seen if x != main and seen[x][1] >= 2), key=lambda x: -seen[x][0])
    return [(x, confidence[x]) for x in (main, *rest)]


def document_languages(articles: DataFrame, sites: DataFrame, model: Model, repair: mojibake.Model | None) -> DataFrame:
    """(article_id, label, lang, confidence, is_main) of every article with content that is no residue.

    Null and empty contents give no row, nor do contents without letters; texts of any length are
    judged whole; repeated rows give repeated rows; labels of any notation are compared by code;
    an empty table gives an empty result.
    """
    kind = articles.schema["article_id"].dataType.simpleString()
    context = articles.sparkSession.sparkContext
    shared = context.broadcast((model, repair))  # dictionaries and weights: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, repair = shared.value
        for batch in batches:
            rows, langs, sure, main = [], [], [], []
            columns = [batch.column("content").to_pylist(), batch.column("raw_html").to_pylist(), host_lines(batch.column("site_key"), batch.column("recurrent")), batch.column("site_source").to_pylist(), batch.column("site_lang").to_pylist()]
            for i, (content, html, recurrent, source, site_lang) in enumerate(zip(*columns, strict=True)):
                repeated = repeated_flags(content.split("\n"), recurrent)
                if evidence("\n".join(t for t, r in zip(content.split("\n"), repeated, strict=True) if not r), "content"):
                    continue
                for k, (lang, confidence) in enumerate(article_languages(content, html, repeated, source, site_lang, model, repair)):
                    rows.append(i)
                    langs.append(lang)
                    sure.append(confidence)
                    main.append(k == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(main, pa.bool_())], ["article_id", "lang", "confidence", "is_main"])

    ready = prepared(articles, sites)
    return ready.mapInArrow(run, f"article_id {kind}, lang string, confidence double, is_main boolean")


def mislabelled(articles: DataFrame, found: DataFrame) -> DataFrame:
    """(article_id, lang) of the articles whose label is missing, says nothing, is wrong, or whose main body holds several languages."""
    kind = "language string, label string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(label_code, batch.column(0).to_pylist()), pa.string())], ["language", "label"])

    labels = articles.select("language").distinct().mapInArrow(run, kind)  # one row a notation
    labelled = articles.select("article_id", "language").join(labels, articles.language.eqNullSafe(labels.language), "left").select("article_id", "label")
    per = found.groupBy("article_id").agg(F.max(F.when(F.col("is_main"), F.col("lang"))).alias("main"), F.collect_set("lang").alias("langs"))
    wrong = per.join(labelled.dropDuplicates(["article_id"]), "article_id").filter(F.col("label").isNull() | (F.col("label") != F.col("main")) | (F.size("langs") > 1))
    return wrong.select("article_id", F.explode("langs").alias("lang"))
