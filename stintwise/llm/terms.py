"""Terms of a text: maximal runs of ASCII letters, digits and all characters
beyond ASCII, with only A-Z lower-cased."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ascii_lower

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FIND = re.compile(PATTERN)
#: Byte table: A-Z lower-cased, every other ASCII byte outside the class a space.
#: Bytes of characters beyond ASCII are all above 0x7F and stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
               for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def term_spans(text: str) -> list[tuple[int, int]]:
    """Start and end (code points) of every term in the text as it was given;
    lower-casing A-Z changes no length, so the n-th span is the n-th term's."""
    return [m.span() for m in _FIND.finditer(text)]


def terms_column(text: Column) -> Column:
    """The terms as an array of strings (null text: empty), by Spark alone."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PATTERN), 0)
