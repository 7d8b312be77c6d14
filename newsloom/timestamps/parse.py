"""Reading one written time: which wall time or instant does a string state?

``read`` gives every interpretation that is a valid parse.  Only all-numeric dates that do not
begin with a four-digit year have more than one; which of those a source writes is decided in
``newsloom.timestamps.mixture``.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

#: Orders of an all-numeric date that does not begin with a four-digit year.
ORDERS = ("dmy", "mdy", "ymd")

# Month names by language.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "hi": "जनवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्टूबर नवंबर दिसंबर",
    "th": "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม",
}
MORE_MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "jän": 1, "jänner": 1, "mär": 3, "okt": 10, "dez": 12, "janv": 1, "févr": 2, "avr": 4, "juil": 7, "déc": 12, "fev": 2, "abr": 4, "ago": 8, "set": 9, "out": 10, "ene": 1, "dic": 12,
    "январь": 1, "февраль": 2, "март": 3, "апрель": 4, "май": 5, "июнь": 6, "июль": 7, "август": 8, "сентябрь": 9, "октябрь": 10, "ноябрь": 11, "декабрь": 12,
    "янв": 1, "фев": 2, "мар": 3, "апр": 4, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "сент": 9, "окт": 10, "ноя": 11, "нояб": 11, "дек": 12,
    "ม.ค": 1, "ก.พ": 2, "มี.ค": 3, "เม.ย": 4, "พ.ค": 5, "มิ.ย": 6, "ก.ค": 7, "ส.ค": 8, "ก.ย": 9, "ต.ค": 10, "พ.ย": 11, "ธ.ค": 12,
    "फ़रवरी": 2, "सितम्बर": 9, "अक्तूबर": 10, "नवम्बर": 11, "दिसम्बर": 12,
}
# Words for units of time, in seconds, and words that count back from the crawl.
UNIT_WORDS = {
    1: "s sec secs second seconds sekunde sekunden seconde secondes segundo segundos сек секунд секунду секунды giây วินาที सेकंड सेकेंड 秒 秒钟 秒鐘",
    60: "m min mins minute minutes minuten minuto minutos мин минут минуту минуты phút นาที मिनट 分 分钟 分鐘 分間",
    3600: "h hr hrs hour hours std stunde stunden heure heures hora horas ч час часа часов giờ ชั่วโมง घंटे घंटा घण्टे 小时 小時 時間 时",
    86400: "d day days tag tage tagen jour jours día días dia dias дн день дня дней ngày วัน दिन 天 日",
    604800: "week weeks woche wochen semaine semaines semana semanas нед неделю недели недель tuần สัปดาห์ सप्ताह हफ्ते 周 週 週間",
}
BACK_WORDS = ("ago", "vor", "il y a", "hace", "há", "atrás", "назад", "trước", "ที่แล้ว", "ก่อน", "पहले", "前")
NOW_WORDS = ("just now", "gerade eben", "たった今", "à l’instant", "à l'instant", "अभी-अभी", "अभी अभी", "刚刚", "剛剛", "только что", "vừa xong", "เมื่อสักครู่", "ahora mismo", "agora mesmo", "agora há pouco")
DAY_WORDS = {
    0: ("today", "heute", "aujourd’hui", "aujourd'hui", "hoy", "hoje", "сегодня", "hôm nay", "วันนี้", "आज", "今天", "今日"),
    2: ("day before yesterday", "vorgestern", "avant-hier", "anteayer", "anteontem", "позавчера", "hôm kia", "เมื่อวานซืน", "前天", "一昨日"),
    1: ("yesterday", "gestern", "hier", "ayer", "ontem", "вчера", "hôm qua", "เมื่อวาน", "昨天", "昨日"),
}
# Hours added for words of the half day; None needs the hour below 12 as it is.
HALF_DAYS = {"am": 0, "pm": 12, "上午": 0, "凌晨": 0, "早上": 0, "午前": 0, "下午": 12, "晚上": 12, "午後": 12, "पूर्वाह्न": 0, "अपराह्न": 12}
# Minutes east of Greenwich of abbreviations that a site's own zone does not use.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "мск": 180,
    "ist": 330, "ict": 420, "wib": 420, "hkt": 480, "sgt": 480, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "acst": 570, "awst": 480, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "brt": -180, "art": -180,
}
# First year of Japanese eras minus one, and the lead of the Thai calendar.
ERAS = {"令和": 2018, "平成": 1988}
BUDDHIST = 543

MONTHS = {name: i + 1 for names in MONTH_NAMES.values() for i, name in enumerate(unicodedata.normalize("NFKC", names).split())} | {
    unicodedata.normalize("NFKC", k): v for k, v in MORE_MONTHS.items()
}
UNITS = {unicodedata.normalize("NFKC", w): s for s, words in UNIT_WORDS.items() for w in words.split()}
NOW = tuple(unicodedata.normalize("NFKC", w) for w in NOW_WORDS)
BACK = re.compile("|".join(rf"\b{w}\b" if w[0] < "\u0250" else unicodedata.normalize("NFKC", w) for w in BACK_WORDS))
DAYS = {k: tuple(unicodedata.normalize("NFKC", w) for w in v) for k, v in DAY_WORDS.items()}
HALVES = {unicodedata.normalize("NFKC", k): v for k, v in HALF_DAYS.items()}
ALL_DAY_WORDS = tuple(w for words in DAYS.values() for w in words)

_names = "|".join(sorted(map(re.escape, MONTHS), key=len, reverse=True))
YEAR_FIRST = re.compile(r"(?<!\d)(\d{4})\s?[-/.年]\s?(\d{1,2})\s?[-/.月]\s?(\d{1,2})(?!\d)\s?[日号號]?")
ERA_DATE = re.compile(r"(令和|平成)\s?(\d{1,2}|元)\s?年\s?(\d{1,2})\s?月\s?(\d{1,2})\s?日")
TWO_PARTS_CJK = re.compile(r"(?<!\d)(\d{1,2})\s?月\s?(\d{1,2})\s?[日号號]")
COMPACT = re.compile(r"(?<!\d)(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)?)?(?=z|[+-]\d{2}:?\d{2}|\s|$)")
THREE_PARTS = re.compile(r"(?<!\d)(\d{1,2})([-/.])\s?(\d{1,2})\2\s?(\d{4}|\d{2})(?![\d:])")
TWO_PARTS = re.compile(r"(?<![\d:])(\d{1,2})([-/.])(\d{1,2})(?![\d:])\.?")
DAY_MONTH = re.compile(r"(?<!\d)(\d{1,2})(?:\.|er|º|ª|st|nd|rd|th)?\s?(?:de\s|of\s)?(" + _names + r")\.?,?\s?(?:de\s|del\s)?(\d{4}|(?<=\s)\d{2}(?![\d:h]))?(?!\d)")
MONTH_DAY = re.compile(r"(?<![a-zà-öø-ÿа-яё])(" + _names + r")\.?\s?(\d{1,2})(?:st|nd|rd|th)?(?![\d:])(?:,?\s?(\d{4}))?(?!\d)")
THANG = re.compile(r"(?<!\d)(\d{1,2})\s?tháng\s?(\d{1,2})(?:\s?(?:,|năm|/)?\s?(\d{4}))?(?!\d)")
LABEL = re.compile(r"^[^\d:]{1,40}:\s*(?=\S)")
CLOCK = re.compile(r"(?<!\d)(\d{1,2})\s?(?::|h|時|时|点|點)\s?(?:(\d{2}|(?<=[時时点點])\d)(?!\d))?(?:\s?[:分]\s?(\d{2})(?!\d))?(?:[.,]\d+)?\s?[分秒]?")
HALF = re.compile(r"\s*([ap])\.?\s?m\.?(?![a-z])")  # right after the clock
HALF_WORD = re.compile("|".join(w for w in HALVES if w not in ("am", "pm")))
OFFSET = re.compile(r"\(?\s?(?:(utc|gmt)\s?([+-])\s?(\d{1,2})(?::?(\d{2}))?|([+-])(\d{2}):?(\d{2}))\s?\)?")
WORD = re.compile(r"[^\W\d_]{2,5}")
RELATIVE = re.compile(r"(\d+)\s?([^\W\d_]+[̀-ͯऀ-ॿ฀-๿]*)")
EPOCH_RANGE = (int(datetime(2015, 1, 1, tzinfo=UTC).timestamp()), int(datetime(2031, 1, 1, tzinfo=UTC).timestamp()))


def epoch_seconds(value: int | None) -> int | None:
    """Whole seconds of a count of seconds or of a decimal fraction of seconds, if within 2015-2030."""
    while value is not None and value >= EPOCH_RANGE[0]:
        if value < EPOCH_RANGE[1]:
            return value
        value //= 10
    return None


@functools.cache
def zone(name: str) -> ZoneInfo:
    return ZoneInfo(name)


@functools.cache
def own_abbreviations(name: str) -> dict[str, int]:
    """Abbreviations that the zone itself uses, with minutes east of Greenwich."""
    out = {}
    for year in (2020, 2023):
        for month in range(1, 13):
            t = datetime(year, month, 15, tzinfo=zone(name))
            label = t.tzname().lower()
            if label.isalpha():
                out[label] = int(t.utcoffset().total_seconds()) // 60
    return out


def at_zone(wall: datetime, tz: str) -> int:
    """UTC second of a wall time: the earlier one of two, moved forward by the span if skipped."""
    return int(wall.replace(tzinfo=zone(tz)).timestamp())


def _year(y: int, lang: str | None, crawl_year: int) -> int:
    if y < 100:
        y += 2000
        return y if y <= crawl_year + 1 or lang != "th" else y + 500 - BUDDHIST
    return y - BUDDHIST if y > 2400 else y


def _day(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def read(text: str | None, tz: str, lang: str | None, crawl: int) -> dict[str, int] | None:
    """UTC seconds by order of the date (the key is "" where the order does not matter).

    None: the text states no existing date or time.  ``crawl``: UTC second that relative times
    count from and that missing years and days are not after.
    """
    if not text:
        return None
    s = unicodedata.normalize("NFKC", text).lower().strip()
    if not s:
        return None
    if s.isdigit():
        if len(s) in (10, 13, 16, 19):
            found = epoch_seconds(int(s))
            return None if found is None else {"": found}
        if len(s) not in (8, 12, 14):
            return None
    elif not any(c.isdigit() for c in s):
        if any(w in s for w in NOW):
            return {"": crawl}
        for back, words in DAYS.items():
            if any(w in s for w in words):
                local = datetime.fromtimestamp(crawl, zone(tz)).date() - timedelta(days=back)
                return {"": at_zone(datetime(local.year, local.month, local.day), tz)}
        return None
    s = LABEL.sub("", s)
    if BACK.search(s):
        if m := RELATIVE.search(s):
            word = m[2]
            unit = UNITS.get(word)
            if unit is None:
                unit = next((UNITS[word[:n]] for n in range(len(word), 0, -1) if word[:n] in UNITS), None)
            if unit is not None:
                return {"": crawl - int(m[1]) * unit}
    local = datetime.fromtimestamp(crawl, zone(tz))
    dates: dict[str, tuple[int | None, int, int]] = {}  # order -> year, month, day
    rest, day, clock = s, None, None
    if m := YEAR_FIRST.search(s):
        dates[""] = int(m[1]), int(m[2]), int(m[3])
    elif m := COMPACT.search(s):
        dates[""] = int(m[1]), int(m[2]), int(m[3])
        if m[4]:
            clock = int(m[4]), int(m[5]), int(m[6] or 0)
    elif m := ERA_DATE.search(s):
        dates[""] = ERAS[m[1]] + (1 if m[2] == "元" else int(m[2])), int(m[3]), int(m[4])
    elif m := THANG.search(s):
        dates[""] = int(m[3]) if m[3] else None, int(m[2]), int(m[1])
    elif m := DAY_MONTH.search(s):
        dates[""] = int(m[3]) if m[3] else None, MONTHS[m[2]], int(m[1])
    elif m := MONTH_DAY.search(s):
        dates[""] = int(m[3]) if m[3] else None, MONTHS[m[1]], int(m[2])
    elif m := TWO_PARTS_CJK.search(s):
        dates[""] = None, int(m[1]), int(m[2])
    elif m := THREE_PARTS.search(s):
        a, b, c = int(m[1]), int(m[3]), int(m[4])
        dates = {"dmy": (c, b, a), "mdy": (c, a, b)}
        if len(m[4]) == 2:
            dates["ymd"] = a, b, c
    elif m := TWO_PARTS.search(s):
        a, b = int(m[1]), int(m[3])
        dates = {"dmy": (None, b, a), "mdy": (None, a, b), "ymd": (None, a, b)}
    else:
        back = next((k for k, words in DAYS.items() if any(w in s for w in words)), None)
        if back is not None:
            day = local.date() - timedelta(days=back)
    if m and dates:
        rest = s[: m.start()] + " " + s[m.end() :]
    offset = None
    if clock is None:
        if m := CLOCK.search(rest):
            clock = int(m[1]), int(m[2] or 0), int(m[3] or 0)
            tail = rest[m.end() :]
            if half := HALF.match(tail) or HALF_WORD.search(rest):
                if not 1 <= clock[0] <= 12:
                    if clock[0] > 23:
                        return None
                else:
                    add = (0 if half[1] == "a" else 12) if half.re is HALF else HALVES[half[0]]
                    clock = clock[0] % 12 + add, clock[1], clock[2]
                tail = HALF.sub(" ", tail, count=1)
        else:
            tail = rest if dates else ""
            if not dates and day is None:
                return None
            if re.search(r"\d", OFFSET.sub(" ", tail)) and dates:
                return None  # a part that is no date and no time
    else:
        tail = s[m.end() :]
    if clock is not None and not (clock[0] <= 23 and clock[1] <= 59 and clock[2] <= 59):
        return None
    if m := OFFSET.search(tail):
        sign, hours, minutes = (m[2], m[3], m[4]) if m[1] else (m[5], m[6], m[7])
        offset = (int(hours) * 60 + int(minutes or 0)) * (-1 if sign == "-" else 1)
    elif tail.strip().startswith("z"):
        offset = 0
    elif clock is not None:
        own = own_abbreviations(tz)
        for word in WORD.findall(tail):
            offset = own.get(word, ABBREVIATIONS.get(word))
            if offset is not None:
                break
    h, mi, sec = clock or (0, 0, 0)

    def instant(d: date) -> int:
        wall = datetime(d.year, d.month, d.day, h, mi, sec)
        return int(wall.replace(tzinfo=UTC).timestamp()) - offset * 60 if offset is not None else at_zone(wall, tz)

    if not dates:
        if day is not None:
            return {"": instant(day)}
        found = instant(local.date() + timedelta(days=1))  # a time alone: the latest not after the crawl
        for back in range(3):
            if found <= crawl:
                break
            found = instant(local.date() - timedelta(days=back))
        return {"": found}
    out: dict[str, int] = {}
    for order, (y, mo, d) in dates.items():
        if y is not None:
            if exact := _day(_year(y, lang, local.year), mo, d):
                out[order] = instant(exact)
            continue
        for year in range(local.year + 1, local.year - 9, -1):
            if (exact := _day(year, mo, d)) and (found := instant(exact)) <= crawl:
                out[order] = found
                break
    return out or None
