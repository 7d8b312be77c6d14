"""Charset detection as column expressions, and decoding in Arrow batches where strict decoding is needed."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import charset_normalizer
except ImportError:  # detection by statistics is then skipped
    charset_normalizer = None

# Names of encodings that are read as another.
ALIASES = {
    "gb2312": "gbk", "gb_2312": "gbk", "gb-2312": "gbk", "chinese": "gbk", "csiso58gb231280": "gbk", "euc-cn": "gbk", "euc_cn": "gbk", "x-euc-cn": "gbk",
    "iso-8859-1": "latin-1", "latin1": "latin-1", "ascii": "utf-8",
}
FALLBACKS = ("utf-8", "gbk", "gb18030", "latin-1", "cp1252")
#: Bytes that are searched for a declaration, and for statistics.
HEAD_BYTES, SAMPLE_BYTES = 2048, 10240
_MOJIBAKE = "[À-ß][\x80-¿]|[à-ï][\x80-¿]{2}"
# Where a page declares its charset, in the order of precedence.
DECLARATIONS = (
    r"""(?is)<meta[^>]+charset\s*=\s*["']?([^"'\s>]+)""",
    r"""(?is)<meta[^>]+http-equiv\s*=\s*["']?Content-Type["']?[^>]+content\s*=\s*["']?[^"']*charset=([^"'\s;>]+)""",
    r"""(?is)<meta[^>]+content\s*=\s*["']?[^"']*charset=([^"'\s;>]+)[^>]+http-equiv\s*=\s*["']?Content-Type""",
    r"""(?is)<\?xml[^>]+encoding\s*=\s*["']([^"']+)["']""",
)


def normalize_encoding(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(name)), r"""^["']+|["']+$""", "")
    aliased = bare
    for alias, target in ALIASES.items():
        aliased = F.when(bare == alias, target).otherwise(aliased)
    return F.when(F.coalesce(name, F.lit("")) == "", "utf-8").otherwise(aliased)


def charset_of_content_type(content_type: Column) -> Column:
    found = F.nullif(F.regexp_extract(content_type, r"(?i)charset\s*=\s*([^\s;,]+)", 1), F.lit(""))
    return F.when(found.isNotNull(), normalize_encoding(found))


def charset_of_html(body: Column) -> Column:
    """Byte-order mark, else the first declaration in the head of the page."""
    start = F.hex(F.substring(body, 1, 4))
    head = F.regexp_replace(F.decode(F.substring(body, 1, HEAD_BYTES), "ISO-8859-1"), "[^\\x00-\\x7f]", "")
    declared = F.coalesce(*(F.nullif(F.regexp_extract(head, d, 1), F.lit("")) for d in DECLARATIONS))
    return (
        F.when(start.startswith("EFBBBF"), "utf-8")
        .when(start.startswith("FFFE"), "utf-16-le")
        .when(start.startswith("FEFF"), "utf-16-be")
        .when(start == "0000FEFF", "utf-32-be")
        .when(declared.isNotNull(), normalize_encoding(declared))
    )


def looks_misread(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, or lost characters."""
    return F.coalesce(text.rlike(_MOJIBAKE) | text.contains("�"), F.lit(False))


def _statistics(raw: bytes) -> str | None:
    if charset_normalizer is None:
        return None
    name = (charset_normalizer.detect(raw[:SAMPLE_BYTES]) or {}).get("encoding")
    return ALIASES.get(name.lower(), name.lower()) if name else None


def decode_bytes(raw: bytes | None, declared: str | None) -> tuple[str | None, str | None]:
    """(text, encoding): strictly by what is declared or guessed, else by the first fallback that decodes."""
    if raw is None:
        return None, None
    first = declared or _statistics(raw) or "utf-8"
    for name in (first, *(f for f in FALLBACKS if f != first)):
        try:
            codecs.lookup(name)
            return raw.decode(name), name
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace"), "utf-8"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decode_udf(body: pd.Series, declared: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(b, d) for b, d in zip(body, declared, strict=True)], columns=["text", "encoding"])


@F.pandas_udf(T.StringType())
def reread_udf(text: pd.Series, content_type: pd.Series) -> pd.Series:
    """Text that looks misread, decoded again from its Latin-1 bytes; unchanged if it has none."""

    def again(t: str | None, c: str | None) -> str | None:
        try:
            raw = t.encode("latin-1") if t else None
        except UnicodeEncodeError:
            return t
        if raw is None:
            return t
        found = re.search(r"charset\s*=\s*([^\s;,]+)", c or "", re.I)
        name = found[1].lower().strip("\"'") if found else None
        return decode_bytes(raw, ALIASES.get(name, name) or "utf-8")[0]

    return pd.Series([again(t, c) for t, c in zip(text, content_type, strict=True)])


def decoded_page(html: Column, body: Column, content_type: Column) -> Column:
    """struct(text, encoding) of a page: its text if there is one (read again if it looks misread), else its bytes decoded."""
    declared = F.coalesce(charset_of_content_type(content_type), charset_of_html(body))
    return F.when(html.isNotNull(), F.struct(F.when(looks_misread(html), reread_udf(html, content_type)).otherwise(html).alias("text"), F.lit(None).cast("string").alias("encoding"))).otherwise(
        decode_udf(body, declared)
    )
