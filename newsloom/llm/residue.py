"""Template residue, filler, stand-in values, error pages and script notices instead of content.

Lines are normalised and counted by host; lines that recur over the host's pages are boilerplate
and are subtracted.  What remains of a record is looked at for evidence: an unfilled placeholder
anywhere (unless its sentence is about placeholders), filler text, or a residual that consists of
stand-in values or of what a site serves instead of content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.notices import SENTENCE, hints, is_notice, notice_characters
from newsloom.llm.sitelines import host_lines, repeated_flags, with_recurrent
from newsloom.llm.sites import url_host

#: Share of a residual that says that it is a page without content; of a page of nothing but recurrent lines.
MOSTLY, WHOLLY = 0.5, 0.95

# Names that templates use for what they fill in.
NAMES = "title|titel|headline|heading|subject|city|name|author|date|body|content|text|summary|teaser|description|caption|image|link|url|category|tag|page|item|article|post|site|user|email|company|year|month|day|price|cause|reason|error|message|msg|status|fehlertext|code|value|label"
NAME = rf"[A-Za-z][\w-]*[._][\w.-]*[A-Za-z]|(?i:{NAMES})"
# Delimiters of template languages, whatever stands between them (up to the next opening one); single brackets,
# percent and number signs and the like only around a name; directives of formatting that stand alone.
PLACEHOLDER = re.compile(
    r"(?=[{$#<&%@_\[])(?:\{\{\{?[^{}\n]*\}\}\}?|\$!?\{[^{}\n]*\}|#\{[^{}\n]*\}|(?:<|&lt;)%(?:(?!<%|&lt;%)[^\n])*?%(?:>|&gt;)|(?:<|&lt;)\?(?:=|php\b)(?:(?!<\?|&lt;\?)[^\n])*?\?(?:>|&gt;)|\{%(?:(?!\{%)[^\n])*?%\}|@@[\w.]+@@|__MSG_[\w.]+?__|<!--#echo\b(?:(?!<!--)[^\n])*?-->|\[\[[\w.]+\]\]"
    r"|(?<![\w$])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)|%\([A-Za-z_]\w*\)[sdr]|(?<![\w{])\{\d\}(?![\w}])|(?<![\w%])%(?:\d\$)?[sd](?![\w%])"
    rf"|\[(?:{NAME})\]|\{{(?:{NAME})\}}|%(?:{NAME})%|(?<![\w#])#(?:{NAME})#(?![\w#])|(?<![\w$])\$(?:{NAME})\$(?![\w$]))"
)
HINT = re.compile(r"[{@\[<$#]|&lt;[%?]|%[(\w]|__[A-Z]")
#: Words of sentences that speak about placeholders instead of holding one by mistake.
MENTION = re.compile(
    r"\b(?:manual|template|placeholder|filled in|syntax|handbuch|platzhalter|ausgefüllt|manuel|plantilla|preenchid\w+|руководств\w+|шаблон\w*|hướng dẫn)\b|手册|模板|占位|说明书|マニュアル|テンプレート|説明書|คู่มือ|แม่แบบ|टेम्पलेट|पुस्तिका",
    re.I,
)
#: Ends of sentences around a placeholder.
STOP = re.compile(r"\n|[.!?] |[。！？।]")
QUOTES = "\"'“”‘’„«»「」`"
# Filler texts, stand-in values, and what sites serve instead of content.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
LOREM_MARKS = ("lorem", "ipsum", "dolor", "aliqua", "mollit", "tempor", "labore", "consectetur")
FILLER = re.compile(r"lorem ipsum|blindtext|\b(?:body )?(?:text|copy|content|headline|title) (?:goes here|to come)|dummy text|placeholder text|aquí va el texto|texto de ejemplo|texte d[’']exemple|hier steht|テキストが入ります|ダミーテキスト|此处填写|在此输入|текст[- ]заполнитель", re.I)
STAND_IN = re.compile(
    r"undefined|null|nan|none|\[object object\]|untitled(?: document| page)?|\(?(?:no|without) title\)?|(?:test[ .,!-]*){2,}|loading ?(?:\.{2,}|…)?|加载中 ?(?:\.{2,}|…)?|読み込み中 ?(?:\.{2,}|…)?|загрузка ?(?:\.{2,}|…)?|(?:标题)+|请输入\w{1,6}|titel hier eingeben|(?:enter|insert|sample|your) (?:\w+ )?(?:headline|title)(?: (?:goes )?here)?|(?:headline|title) (?:goes )?here|escriba el título aquí|título aqui|\?{3,}|x{3,12}",
    re.I,
)
SERVED = re.compile(
    r"(?:(?:error|http|fehler|erreur|ошибка|错误|エラー)[ :]*)?[45]\d\d(?: -?:?(?:not found|forbidden|bad gateway|unauthorized|gateway time-?out|service (?:temporarily )?unavailable|internal server error|too many requests|error|gone))?|error \d+|(?:page )?not found|access denied|forbidden|bad gateway|service unavailable|internal server error|verify you are human|just a moment ?(?:\.{2,}|…)?|page introuvable|seite nicht gefunden|página no(?: fue)? encontrada|página não encontrada|страница не найдена|页面不存在|找不到页面|ページが見つかりません|không tìm thấy trang|ไม่พบหน้า\w*|पृष्ठ नहीं मिला|(?:please )?(?:enable|turn on|activate) javascript",
    re.I,
)
SERVED_SENTENCE = re.compile(
    r"(?:page|seite|página|страниц\w|trang|पृष्ठ|หน้า|页面|ページ|address|document).{0,60}(?:not found|not exist|no longer|is gone|introuvable|nicht gefunden|existiert nicht|no existe|no encontrad|não foi encontrad|не найден|удален|không tồn tại|không tìm thấy|उपलब्ध नहीं|नहीं मिल|不存在|已被删除|見つかりません)|ไม่พบหน้า|moved or removed|introuvable"
    r"|internal server error|bad gateway|service unavailable|gateway time-?out|try again later|系统繁忙|请稍后再试|稍后重试|down for maintenance|do not have permission|permission to (?:view|access)|access denied|session has expired|sign in again"
    r"|java ?script|(?:enable|activate|turn on|need) \w{0,5} ?scripts?\b|启用脚本|开启脚本"
    r"|verify you are human|just a moment|checking your browser|unusual traffic|complete the check|captcha|are you a robot",
    re.I,
)
MARKUP = re.compile(r"<!doctype|<html|<head\b|<body\b|<title>", re.I)


def has_placeholder(text: str) -> bool:
    if not HINT.search(text):
        return False
    begin = end = 0
    spoken = None
    for m in PLACEHOLDER.finditer(text):
        # the sentence around it; placeholders of one sentence have it in common
        if not begin <= m.start() < end:
            begin = last = 0
            for stop in STOP.finditer(text, end if m.start() >= end else 0):
                if stop.end() > m.start():
                    break
                last = stop.end()
            begin = last or end
            stop = STOP.search(text, m.end())
            end = stop.start() if stop else len(text)
            spoken = MENTION.search(PLACEHOLDER.sub(" ", text[begin:end]))
        if text[m.start() - 1 : m.start()] in QUOTES and text[m.end() : m.end() + 1] in QUOTES and m.start() > 0 and m.end() < len(text):
            continue
        if not spoken:
            return True
    return False


def is_filler(text: str) -> bool:
    words = re.findall(r"[a-z]+", text.lower())
    return len(words) >= 4 and sum(w in LOREM for w in words) >= 0.8 * len(words) and sum(len(w) > 2 and w in LOREM for w in words) >= 3


def evidence(text: str | None, field: str, share: float = MOSTLY) -> str | None:
    """What kind of residue a residual shows: placeholder, filler, stand-in or served; None: none of them."""
    if not text or not text.strip():
        return None
    if has_placeholder(text):
        return "placeholder"
    units = [u for u in (x.strip(" \t\r 　-–|·") for x in text.split("\n")) if u]
    total = sum(map(len, units)) or 1
    low = text.lower()
    latin = any(w in low for w in LOREM_MARKS)
    # a filler paragraph is residue wherever it stands; words that announce a text, only where they are most of it
    if latin and any(map(is_filler, units)):
        return "filler"
    announced = 0
    if field != "content":
        announced = sum(map(announced_characters, units))
    if announced:
        return "filler"
    if field == "error":
        if MARKUP.search(text) or SERVED_SENTENCE.search(text) and not re.match(r"(?:http|timeout|connection|tls|dns)\b", text.strip(), re.I):
            return "served"
        return "stand-in" if STAND_IN.fullmatch(text.strip()) else None
    if field == "title":
        # numbering and marks around a title do not count
        bare = re.sub(r"^(?:[\W\d_]*[.)\]】、:]\s*|[\s*•·-]+)(?=\D)", "", text.strip()).strip() if not STAND_IN.fullmatch(text.strip()) else text.strip()
        for t in (text.strip(), bare):
            t = t.strip(" \t　 ")
            if STAND_IN.fullmatch(t):
                return "stand-in"
            if SERVED.fullmatch(t.rstrip(".!。 ")) or is_notice(t):
                return "served"
        return None
    served, left = 0, total
    for u in units:
        left -= len(u)
        found, kinds = hints(u)
        if kinds & 8:
            announced += announced_characters(u)
        if SERVED.fullmatch(u.rstrip(".!。 ")) or STAND_IN.fullmatch(u) or "<" in u and MARKUP.search(u):
            served += len(u)
        elif kinds & 4 or kinds & 3 == 3:
            served += max(notice_characters(u, found), spoken_characters(u) if kinds & 4 else 0)
        if max(served, announced) + left < min(share, MOSTLY) * total:
            return None
    return "filler" if announced >= MOSTLY * total else "served" if served >= share * total else None


def announced_characters(unit: str) -> int:
    """Characters of a line if it is mostly words that announce a text which never came."""
    return len(unit) if FILLER.search(unit) and len(FILLER.sub("", unit)) <= max(12, len(unit) // 2) else 0


def spoken_characters(unit: str) -> int:
    """Characters of the sentences of a line in which a site speaks for itself."""
    if not SERVED_SENTENCE.search(unit):
        return 0
    return sum(len(m[0]) for m in SENTENCE.finditer(unit) if SERVED_SENTENCE.search(m[0])) or len(unit)


def residual(text: str, recurrent: frozenset[int]) -> tuple[str, bool]:
    """A text without its host's recurrent lines; or as it stands, and True, if nothing would be left: a site can serve one
    error page for many URLs."""
    lines = text.split("\n")
    rest = "\n".join(line for line, r in zip(lines, repeated_flags(lines, recurrent), strict=True) if not r)
    return (rest, False) if rest.strip() else (text, True)


def residue(items: DataFrame, articles: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(record_kind, record_id, field, kind) of item titles, article contents and article errors that are residue.

    Null, empty and blank fields are no cases; texts of any length are examined whole; repeated
    rows give repeated rows; a null URL has no host and nothing is subtracted from its content;
    an empty table gives an empty result.  ``sites`` is not read: lines are counted for every host.
    """
    key = F.lit(None).cast("string").alias("site_key")
    content = articles.select(F.lit("article").alias("record_kind"), F.col("article_id").alias("record_id"), F.lit("content").alias("field"), F.col("content").alias("text"), url_host(F.col("url")).alias("site_key"))
    errors = articles.select(F.lit("article").alias("record_kind"), F.col("article_id").alias("record_id"), F.lit("error").alias("field"), F.col("error").alias("text"), key)
    titles = items.select(F.lit("item").alias("record_kind"), F.col("item_id").alias("record_id"), F.lit("title").alias("field"), F.col("title").alias("text"), key)
    filled = F.length("text") > 0
    none = F.lit(None).cast("array<bigint>").alias("recurrent")
    # what has no host's lines to lose is not joined
    fields = titles.unionByName(errors).filter(filled).select("*", none).unionByName(with_recurrent(content.filter(filled), articles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for field, text, recurrent in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), host_lines(batch.column(4), batch.column(5)), strict=True):
                text, whole = residual(text, recurrent) if recurrent else (text, False)
                found.append(evidence(text, field, WHOLLY if whole else MOSTLY))
            rows = [i for i, f in enumerate(found) if f]
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:3], pa.array([found[i] for i in rows], pa.string())], ["record_kind", "record_id", "field", "kind"])

    fields = fields.select("record_kind", "record_id", "field", "text", "site_key", "recurrent")
    return fields.mapInArrow(run, "record_kind string, record_id bigint, field string, kind string")


def without_residue(articles: DataFrame, found: DataFrame) -> DataFrame:
    """Articles whose content is no residue."""
    bad = found.filter((F.col("record_kind") == "article") & (F.col("field") == "content")).select(F.col("record_id").alias("article_id")).distinct()
    return articles.join(bad, "article_id", "left_anti")
