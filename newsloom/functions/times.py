"""Times in running text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of times, in the order in which they are tried (the blank within one of the words is on purpose).
FORMS = (
    r"([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}(?:\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?)",
    r"([0-9]{1,2}[-/][0-9]{1,2})(?![0-9])",
    r"([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)",
    r"([0-9]{1,2}月[0-9]{1,2}日)",
    r"([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)",
    r"([0-9]+\s*(?:分钟|分鐘|小时|小時|天|周|週|秒)\s*前)(?=\s|$|[，,。.!！?？\])）])",
    r"(?i)([0-9]+\s*(?:seconds?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?)\s*ago)\b",
    r"(?i)(刚刚|剛 剛|今天|昨天|前天|just now|today|yesterday)",
)
PREFIXES = r"(?i)^(?:发布于|发表于|更新于|time:|date:|Updated:|Posted:)\s*"
#: Zone in which times without a zone are read.
ZONE = "Asia/Shanghai"


def find_time(text: Column) -> Column:
    """The first form that occurs anywhere in the text; null if none does."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, form, 1)), F.lit("")) for form in FORMS))


def short_time_text(text: Column) -> Column:
    """Could a short text be a time at all?"""
    n = F.length(F.trim(text))
    return F.coalesce((n > 5) & (n < 25) & text.rlike("[0-9]") & text.rlike("[-/:年月日]"), F.lit(False))


def to_epoch(text: Column, reference_ts: Column | None = None) -> Column:
    """UTC second of an absolute time, or against ``reference_ts`` (a UTC second) of a relative one, of a day of its year
    without a year, and of a time of its day without a date."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), PREFIXES, ""), PREFIXES, "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "小時", "小时"), "分鐘", "分钟"), "週", "周")
    plain = F.regexp_replace(F.regexp_replace(t, r"^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", "$1-$2-$3"), "/", "-")
    form = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    wall = F.coalesce(
        *(
            F.when(plain.rlike(form + shape), F.try_to_timestamp(plain, F.lit(pattern)))
            for shape, pattern in ((r" [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "yyyy-M-d H:m:s"), (r" [0-9]{1,2}:[0-9]{1,2}$", "yyyy-M-d H:m"), (r"$", "yyyy-M-d"))
        )
    )
    # read as UTC wall time by its fields, then shifted from the zone
    absolute = F.unix_timestamp(F.to_utc_timestamp(wall, ZONE))
    if reference_ts is None:
        return absolute
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    amount = F.nullif(F.regexp_extract(t, r"^([0-9]+)", 1), F.lit("")).cast("bigint")
    unit = (
        F.when(t.rlike(r"(?i)^[0-9]+\s*(?:秒|seconds?)"), 1)
        .when(t.rlike(r"(?i)^[0-9]+\s*(?:分钟|minutes?|mins?)"), 60)
        .when(t.rlike(r"(?i)^[0-9]+\s*(?:小时|hours?|hrs?)"), 3600)
        .when(t.rlike(r"(?i)^[0-9]+\s*(?:天|days?)"), 86400)
        .when(t.rlike(r"(?i)^[0-9]+\s*(?:周|weeks?)"), 604800)
    )
    # wall clock of the zone at the reference, in the fields of a timestamp
    clock = F.from_utc_timestamp(F.timestamp_seconds(reference_ts), ZONE)
    back = lambda wall: F.unix_timestamp(F.to_utc_timestamp(wall, ZONE))
    months = F.make_interval(months=-amount.cast("int"))
    relative = (
        F.when(t.rlike(r"(?i)^[0-9]+\s*months?\s*ago$"), back(clock + months))
        .when(t.rlike(r"(?i)前$|ago$"), reference_ts - amount * unit)
        .when(t.rlike(r"(?i)^(?:刚刚|剛 剛|今天|just now|today)$"), reference_ts)
        .when(t.rlike(r"(?i)^(?:昨天|yesterday)$"), reference_ts - 86400)
        .when(t.rlike(r"^前天$"), reference_ts - 2 * 86400)
    )
    year, day = F.date_format(clock, "yyyy"), F.date_format(clock, "yyyy-MM-dd")
    of_year = F.when(t.rlike(r"^[0-9]{1,2}(?:[-/][0-9]{1,2}|月[0-9]{1,2}日)$"), F.try_to_timestamp(F.concat(year, F.lit("-"), F.regexp_extract(t, r"^([0-9]+)", 1), F.lit("-"), F.regexp_extract(t, r"([0-9]+)日?$", 1)), F.lit("yyyy-M-d")))
    of_day = F.coalesce(*(F.when(t.rlike(shape), F.try_to_timestamp(F.concat(day, F.lit(" "), t), F.lit(f"yyyy-MM-dd {pattern}"))) for shape, pattern in ((r"^[0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "H:m:s"), (r"^[0-9]{1,2}:[0-9]{2}$", "H:m"))))
    return F.coalesce(absolute, relative, back(of_year), back(of_day))
