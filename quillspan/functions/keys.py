"""Normal forms of record keys, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() sees it; Spark's trim() drops only U+0020.
UNICODE_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


_SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space of any kind, looking at the ends alone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c, F.lit(_SPACES))


def not_blank(c: Column | str) -> Column:
    """Whether there is anything but white space, stopping at the first of it."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(f"[^{UNICODE_SPACE[1:-1]}]")


def norm_key(c: Column | str) -> Column:
    """A key without surrounding white space and case; null where nothing is left."""
    k = F.lower(strip(c))
    return F.when(k != "", k)
