"""Text helpers as columns: lines, tokens, folding, counting, deadlines."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.keys import UNICODE_SPACE, strip

#: Line separators of Python's splitlines().
LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
ISO_DATE = r"^\d{4}-\d\d-\d\d$"
ISO_TIME = r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d)(:\d\d(?:[.]\d{1,6})?)?(Z|[+-]\d\d:?\d\d)?$"


_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def universal_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def one_line_break(c: Column) -> Column:
    """A text with the line feed as its only line separator."""
    return F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), _BREAKS, "\n" * len(_BREAKS))


def split_lines(c: Column) -> Column:
    """Lines of a text without a last empty one, as splitlines() gives them."""
    parts = F.split(c, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def none_if_blank(c: Column | str) -> Column:
    s = strip(c)
    return F.when(s != "", s)


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Letters with marks and the same letters without, by decomposition."""
    seen, plain = [], []
    for code in range(0xC0, 0xFFFF):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            seen.append(c)
            plain.append(base)
    return "".join(seen), "".join(plain)


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), *_folding())


def index_tokens(c: Column) -> Column:
    """Tokens of an indexed field: runs of letters and digits, folded."""
    return F.filter(F.split(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def count_of(text: Column, part: Column | str) -> Column:
    """Non-overlapping occurrences of a substring."""
    part = F.lit(part) if isinstance(part, str) else part
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def tidy_tags(c: Column) -> Column:
    """Tags trimmed, without blanks and repeats, in order; null is no tags."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda t: t != "")))


def short_id(prefix: str, *parts: Column, size: int = 24) -> Column:
    """A prefix and the first hex digits of the SHA-256 of parts joined by bars."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(size)))


def deadline_us(c: Column) -> Column:
    """Microseconds of a strict ISO date or time (no zone: UTC); null if it is none."""
    s = strip(c)
    day, clock = F.regexp_extract(s, ISO_TIME, 1), F.regexp_extract(s, ISO_TIME, 2)
    sec, zone = F.regexp_extract(s, ISO_TIME, 3), F.regexp_extract(s, ISO_TIME, 4)
    local = F.unix_micros(F.try_to_timestamp(F.concat(day, F.lit(" "), clock, F.when(sec == "", ":00").otherwise(sec))))
    digits = F.replace(zone, F.lit(":"), F.lit(""))
    minutes = F.when((zone == "") | (zone == "Z"), F.lit(0).cast("long")).otherwise(
        F.when(F.left(zone, F.lit(1)) == "-", -1).otherwise(1)
        * (F.substring(digits, 2, 2).try_cast("long") * 60 + F.substring(digits, 4, 2).try_cast("long"))
    )
    return F.when(s.rlike(ISO_DATE), F.unix_micros(F.try_to_timestamp(F.concat(s, F.lit(" 00:00:00"))))).when(
        s.rlike(ISO_TIME), local - minutes * F.lit(60_000_000)
    )


#: Letters a page of text has at least, and a document; fewer make it sparse.
PAGE_LETTERS, TEXT_LETTERS = 24, 80


def page_letters(text: Column) -> Column:
    """Of each page between form feeds, how many characters are no white space."""
    return F.transform(F.split(text, "\f"), lambda p: F.length(F.regexp_replace(p, UNICODE_SPACE, "")))


def sparse_pages(letters: Column) -> Column:
    """Whether pages (by their letters) hold too little text to be read as it is."""
    full = F.size(F.filter(letters, lambda n: n >= PAGE_LETTERS))
    total = F.aggregate(letters, F.lit(0), lambda a, n: a + n)
    return (F.size(letters) == 0) | (total < TEXT_LETTERS) | (full < F.greatest(F.lit(1), F.floor(F.size(letters) / 4).cast("int")))
