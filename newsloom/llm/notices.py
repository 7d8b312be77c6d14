"""Notices that a site serves instead of content, told by a small grammar instead of by whole phrases.

A notice says of something that the web is made of (a page, a server, a connection, a script) that it
is missing, refused, broken or has to be switched on.  The words for either are listed by language;
a sentence with one of each, that is no longer than notices are, reads like a notice.  Any single
sentence of real text may do so, too, so the caller asks what share of a text does.
"""

from __future__ import annotations

import functools
import re

import ahocorasick

# What notices speak of, and what they say of it; beginnings of words in scripts with spaces.
SUBJECTS = """
page|web page|website|site|link|url|address|document|article|content|file|resource|server|service|gateway|upstream|connection|request|session|access|permission|browser|java script|javascript|scripts|cookies|captcha|ray id|cloudflare|ip address|traffic|robot|human|something|our end|server's end|here|you have been
seite|inhalt|dokument|adresse|verbindung|anfrage|sitzung|zugriff|dienst|ihr browser|da ist etwas
contenu|lien|adresse|serveur|connexion|requête|accès|session|navigateur
página|enlace|contenido|servidor|servicio|conexión|solicitud|sesión|acceso|navegador|dirección
ligação|conteúdo|serviço|conexão|sessão|endereço
pagina|collegamento|contenuto|connessione|accesso|sessione
strona|strony|stronę|łącze|serwer|połączenie|dostęp|sesja|przeglądark
verbinding|toegang|sessie
страниц|ссылк|сервер|соединени|доступ|сесси|браузер|запрос|документ
trang|liên kết|máy chủ|kết nối|truy cập|trình duyệt
पृष्ठ|पेज|सर्वर|कनेक्शन|ब्राउज़र|लिंक
หน้า|เซิร์ฟเวอร์|เบราว์เซอร์|ลิงก์|การเชื่อมต่อ
页面|网页|链接|服务器|浏览器|访问|系统|连接|脚本|地址
ページ|リンク|サーバ|ブラウザ|接続|アクセス|スクリプト|コンテンツ
페이지|링크|서버|브라우저|연결|접속
sayfa|bağlantı|sunucu
"""
PREDICATES = """
not found|not be found|cannot find|can't find|couldn't find|could not find|does not exist|doesn't exist|no longer|is gone|expired|moved|removed|deleted|unavailable|not available|went wrong|error|failed|denied|forbidden|blocked|restricted|not allowed|not authorized|unauthorized|not permitted|do not have permission|don't have permission|without permission|timed out|did not respond|no answer|no response|refused|reset|dropped|interrupted|try again|temporarily|overloaded|maintenance|verify|checking|look at your|complete the|enable|turn on|activate|required|disabled|need to|unusual|cloudflare ray id|nothing lives|nothing is|nothing to see|nothing here|sign in again|log in again
nicht gefunden|existiert nicht|nicht verfügbar|nicht mehr|abgelaufen|verschoben|entfernt|gelöscht|verweigert|gesperrt|fehlgeschlagen|schiefgelaufen|schief gelaufen|versuchen sie|aktivieren
introuvable|n'existe|n’existe|plus disponible|indisponible|expiré|déplacé|supprimé|refusé|bloqué|échoué|réessayer|activer|activez
no encontrad|no fue encontrad|no existe|no disponible|no está disponible|caducad|expirad|movid|eliminad|denegad|bloquead|falló|inténtelo|active|habilit
não encontrad|não foi encontrad|não existe|indisponível|não está disponível|expirou|removid|negad|tente novamente|ative
non trovat|non è stata trovat|non è stato trovat|non esiste|non disponibile|scadut|rimoss|negat|bloccat|riprova|attiva
nie znalezion|nie została znalezion|nie istnieje|niedostępn|wygas|usunięt|odmow|zablokowan|spróbuj|włącz
niet gevonden|bestaat niet|niet beschikbaar|verlopen|verwijderd|geweigerd
не найден|не существует|недоступ|истек|удален|удалён|перемещен|запрещен|заблокирован|повторите|попробуйте|включите
không tìm thấy|không tồn tại|không khả dụng|hết hạn|bị xóa|bị từ chối|bị chặn|thử lại|hãy bật
नहीं मिल|उपलब्ध नहीं|मौजूद नहीं|हटा दिया|समाप्त|अस्वीकृत|पुनः प्रयास|सक्षम
ไม่พบ|ไม่มีอยู่|หมดอายุ|ถูกลบ|ถูกปฏิเสธ|ลองใหม่|เปิดใช้
不存在|找不到|未找到|已被删除|已删除|已过期|失效|无法访问|禁止|拒绝|繁忙|稍后|重试|启用|开启|验证
見つかりません|存在しません|削除され|期限切れ|利用できません|拒否|もう一度|有効に|確認して
찾을 수 없|존재하지 않|삭제되|만료|사용할 수 없|거부|차단|다시 시도|활성화
bulunamadı|mevcut değil|süresi dol|engellen
"""
# What one of has to be in a sentence in which a site speaks for itself, and in words that announce a text.
SPOKEN = """
not found|not exist|no longer|is gone|introuvable|nicht gefunden|existiert nicht|no existe|no encontrad|não foi encontrad|не найден|удален|không tồn tại|không tìm thấy|उपलब्ध नहीं|नहीं मिल|不存在|已被删除|見つかりません|ไม่พบหน้า|moved or removed|internal server error|bad gateway|service unavailable|gateway time|try again later|系统繁忙|请稍后再试|稍后重试|down for maintenance|do not have permission|permission to|access denied|session has expired|sign in again|script|启用脚本|开启脚本|verify you are human|just a moment|checking your browser|unusual traffic|complete the check|captcha|are you a robot
"""
ANNOUNCED = """
lorem ipsum|blindtext|goes here|go here|to come|dummy text|placeholder text|aquí va el texto|texto de ejemplo|texte d|hier steht|テキストが入ります|ダミーテキスト|此处填写|在此输入|текст
"""
#: Words that may stand beside them in a title that is a notice and nothing else.
BESIDE = frozenset("a an the this that these it you we i your our us my me is are was were be been being has have had do does did can cannot could to of for on in at by with from and or but not no please sorry oops whoops hmm uh oh ooops error errors looking requested trying reach view load loading found again later here there end problem occurred http code status".split())
#: Words (characters in scripts without spaces) up to which a sentence can be a notice.
WORDS, SIGNS = 24, 60
SENTENCE = re.compile(r"[^.!?…。！？।\n]+[.!?…。！？।]*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@functools.cache
def _finder() -> ahocorasick.Automaton:
    known: dict[str, int] = {}
    for kind, listed in ((1, SUBJECTS), (2, PREDICATES), (4, SPOKEN), (8, ANNOUNCED)):
        for phrase in listed.strip().replace("\n", "|").split("|"):
            known[phrase] = known.get(phrase, 0) | kind
    finder = ahocorasick.Automaton()
    for phrase, kind in known.items():
        finder.add_word(phrase, (len(phrase), kind))
    finder.make_automaton()
    return finder


def marks(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, kinds: 1 subject, 2 predicate, 4 spoken, 8 announced) of the listed words in a lower-cased text; subjects
    and predicates from word beginnings."""
    out = []
    for last, (n, kind) in _finder().iter(text):
        begin = last - n + 1
        # a word of an alphabet begins at a word's beginning; scripts without spaces have none
        if begin and text[begin] < "\u0e00" and text[begin - 1].isalpha():
            kind &= 12
        if kind:
            out.append((begin, last + 1, kind))
    return out


def hints(text: str) -> tuple[list[tuple[int, int, int]], int]:
    """``marks`` of a text and all their kinds; every kind if lower-casing moves its characters."""
    low = text.lower()
    found = marks(low)
    kinds = 0
    for m in found:
        kinds |= m[2]
    return (found, kinds) if len(low) == len(text) else ([], 12)


def notice_characters(text: str, found: list[tuple[int, int, int]]) -> int:
    """Characters of the sentences of a text that read like notices; ``found``: its marks."""
    total = at = 0
    for m in SENTENCE.finditer(text):
        begin, end = m.span()
        while at < len(found) and found[at][1] <= begin:
            at += 1
        kinds, k = 0, at
        while k < len(found) and found[k][0] < end:
            kinds |= found[k][2]
            k += 1
        if kinds & 3 == 3:
            sentence = m[0].strip()
            if len(sentence.split()) <= WORDS and (len(sentence) <= SIGNS or " " in sentence):
                total += end - begin
    return total


def is_notice(title: str) -> bool:
    """Is a title a notice and nothing else: a predicate, with nothing beside it but subjects and small words?"""
    low = title.lower()
    found = marks(low)
    if not any(k & 2 for _, _, k in found) or not any(k & 1 for _, _, k in found):
        return False
    rest = list(low)
    for begin, end, _ in found:
        if low[begin] < "฀":  # the word that begins so goes to its end
            while end < len(low) and low[end].isalpha():
                end += 1
        rest[begin:end] = " " * (end - begin)
    left = _WORD.findall("".join(rest))
    return all(w in BESIDE or (w >= "฀" and len(w) <= 3) for w in left)
