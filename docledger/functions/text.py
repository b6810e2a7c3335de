"""Text helpers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and line ends.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def filled(value: Column) -> Column:
    """The value, or null when it is the empty text."""
    return F.when(value != "", value)


def split_lines(value: Column) -> Column:
    return F.split(value, LINE_END)


def has_any(value: Column, words: list[str], blank: bool = False) -> Column:
    """True when any word occurs in the value as a substring, or, with ``blank``, when it is the empty text.

    A word that holds another of the words adds nothing and is left out. The one-element list makes
    the value be computed once, whatever expression it is.
    """
    needed = [word for word in words if not any(other != word and other in word for other in words)]
    if not needed and not blank:
        return F.lit(False)

    def found(text: Column) -> Column:
        return reduce(or_, [text == ""] * blank + [text.contains(word) for word in needed])

    return F.exists(F.array(value), found)


def plain_text(value: Column) -> Column:
    """Lower case with single blanks, for comparing texts."""
    return F.regexp_replace(F.lower(strip(F.coalesce(value, F.lit("")))), r"(?U)\s+", " ")


def packed(text: Column) -> Column:
    """A digest in lower-case hexadecimal as its bytes, any other text as it is; the first byte tells which. For keys that are moved
    and compared: half as long, and equal where the texts are."""
    digest = F.lower(F.hex(F.unhex(text))) == text
    return F.when(digest, F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def unpacked(value: Column) -> Column:
    """The text that `packed` was given."""
    rest = F.substring(value, 2, 2**31 - 1)
    return F.when(F.substring(value, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
