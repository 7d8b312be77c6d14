"""Title and link-text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Unicode, collapsed and trimmed.
_SPACE = r"(?U)\s+"
BULLETS = r"^[·•\-*》►▶→]+(?U:\s*)"
NUMBERING = r"^[(\[【]?[0-9]{1,3}[)\]】]?[.、)）]?(?U:\s*)"
TRAILING_DATE = r"(?U:\s+)[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}((?U:\s+)[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
AGE = r"(?i)^[0-9]+(?U:\s+)(?:hrs?|hours?|mins?|minutes?|days?)(?U:\s+)(?:ago(?U:\s+))?(?=[A-Z])"
OPENING_MARKS = r"^[\[\]【】()（）·•\-]+(?U:\s*)"
#: Template syntax and stand-ins that are no titles.
NOT_TITLES = r"\{\{.*\}\}|\$\{.*\}|<%.*%>|\{%.*%\}|^(?i:null|undefined|N/A|loading\.{0,3})$"


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _SPACE, " "), "^ | $", "")


def clean_title(text: Column) -> Column:
    return collapsed(F.regexp_replace(collapsed(F.coalesce(text, F.lit(""))), OPENING_MARKS, ""))


def clean_link_text(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(collapsed(F.coalesce(text, F.lit(""))), BULLETS, ""), NUMBERING, "")
    return collapsed(F.regexp_replace(t, TRAILING_DATE, ""))


def clean_text(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(collapsed(text), BULLETS, ""), NUMBERING, "")
    t = F.regexp_replace(F.regexp_replace(t, AGE, ""), TRAILING_DATE, "")
    return F.nullif(collapsed(t), F.lit(""))


def valid_title(title: Column, least: int = 5) -> Column:
    t = F.regexp_replace(title, r"(?U)^\s+|\s+$", "")
    return F.coalesce((F.length(t) >= least) & ~t.rlike(NOT_TITLES), F.lit(False))
