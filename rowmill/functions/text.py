"""Character functions as Columns; null in, null out unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def length(s) -> Column:
    """Without trailing blanks."""
    return F.length(F.rtrim(_c(s)))


def compress(s, chars: str = " ", modifiers: str = "") -> Column:
    """Remove (with modifier k: keep only) the characters, and the classes of the modifiers a, d and p."""
    cls = re.sub(r"([\]\[\\^-])", r"\\\1", chars) + "".join({"a": "A-Za-z", "d": "0-9", "p": r"\p{Punct}"}[m] for m in modifiers.lower() if m in "adp")
    return F.regexp_replace(_c(s), f"[{'^' if 'k' in modifiers.lower() else ''}{cls}]", "")


def compbl(s) -> Column:
    return F.trim(F.regexp_replace(_c(s), r"\s+", " "))


def cats(*parts) -> Column:
    return F.concat_ws("", *(F.trim(_c(p).cast("string")) for p in parts))


def catx(sep: str, *parts) -> Column:
    return F.concat_ws(sep, *(F.nullif(F.trim(_c(p).cast("string")), F.lit("")) for p in parts))


def cat(*parts) -> Column:
    return F.concat(*(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts))


def catt(*parts) -> Column:
    return F.concat(*(F.rtrim(F.coalesce(_c(p).cast("string"), F.lit(""))) for p in parts))


def scan(s, n: int, delims: str = " ") -> Column:
    """The n-th word, from the end if n is negative; null if there is none."""
    cls = re.sub(r"([\]\[\\^-])", r"\\\1", delims)
    return F.try_element_at(F.filter(F.split(_c(s), f"[{cls}]"), lambda x: x != ""), F.lit(n))


def index(s, sub: str) -> Column:
    return F.instr(_c(s), sub)


def find(s, sub: str, start: int = 1, ignore_case: bool = False) -> Column:
    return F.locate(sub.lower(), F.lower(_c(s)), start) if ignore_case else F.locate(sub, _c(s), start)


def tranwrd(s, old: str, new: str) -> Column:
    return F.replace(_c(s), F.lit(old), F.lit(new))


def translate(s, to: str, frm: str) -> Column:
    """The new characters come first."""
    return F.translate(_c(s), frm, to)


def verify(s, chars: str) -> Column:
    """Position of the first character that is not listed, else 0."""
    cls = re.sub(r"([\]\[\\^-])", r"\\\1", chars)
    return F.regexp_instr(_c(s), F.lit(f"[^{cls}]"))


def countw(s, delims: str = " ") -> Column:
    cls = re.sub(r"([\]\[\\^-])", r"\\\1", delims)
    return F.size(F.filter(F.split(_c(s), f"[{cls}]"), lambda x: x != ""))


def currency(s) -> Column:
    """Number in a text such as $1,234.56; (x) is negative; null if it is none."""
    t = F.regexp_replace(F.trim(_c(s)), r"[$,\s]", "")
    return F.regexp_replace(t, r"^\((.*)\)$", "-$1").try_cast("double")


def substr(s, start: int, n: int | None = None) -> Column:
    """From the 1-based position; to the end without a length."""
    return F.substr(_c(s), F.lit(start)) if n is None else F.substring(_c(s), start, n)


def trim(s) -> Column:
    """Without trailing blanks."""
    return F.rtrim(_c(s))


def strip(s) -> Column:
    return F.trim(_c(s))


def left(s) -> Column:
    """Without leading blanks."""
    return F.ltrim(_c(s))


def upcase(s) -> Column:
    return F.upper(_c(s))


def lowcase(s) -> Column:
    return F.lower(_c(s))


def propcase(s) -> Column:
    return F.initcap(_c(s))


def reverse(s) -> Column:
    return F.reverse(_c(s))


def repeat(s, n: int) -> Column:
    """n copies."""
    return F.repeat(_c(s), n)


def char(code) -> Column:
    return F.char(_c(code))


def rank(s) -> Column:
    """Code of the first character."""
    return F.ascii(_c(s))


def missing(x, text: bool = False) -> Column:
    """Null, or for text blank."""
    return _c(x).isNull() | (F.trim(_c(x)) == "") if text else _c(x).isNull()


def coalesce(*xs) -> Column:
    return F.coalesce(*map(_c, xs))
