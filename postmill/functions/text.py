"""Text expressions: Python-compatible whitespace, word counts, charset checks.

Python's ``str.strip()``/``\\s`` use Unicode whitespace while Java's ``\\s`` is
ASCII only, so the class is spelled out (same class in the DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: the code points Python treats as whitespace.
PY_WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The same code points as characters, for trims.
PY_WS_CHARS = "".join(chr(c) for c in (*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                                       0x2028, 0x2029, 0x202f, 0x205f, 0x3000))
# FIXED VALUES: preference-corpus character whitelist, letters/digits/whitespace plus .,!?;:'"()-
CHARSET_CLASS = "A-Za-z0-9" + PY_WS + r""".,!?;:'"()\-"""


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """``str.strip()`` with no argument, in time linear in the text."""
    return F.btrim(_c(x), F.lit(PY_WS_CHARS))


def is_blank(x) -> Column:
    """True when ``not s.strip()``."""
    return _c(x).rlike(rf"\A[{PY_WS}]*\z")


def word_count(x) -> Column:
    """``len(s.split(" "))``: single-space split, empty string counts as 1."""
    return F.size(F.split(_c(x), " ", -1))


def charset_ok(x) -> Column:
    """Full match of the whitelist; the empty string passes."""
    return _c(x).rlike(rf"\A[{CHARSET_CLASS}]*\z")


def py_list_text(arr) -> Column:
    """Render an int array the way Python prints a list: ``[1, 2, 3]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(arr), lambda v: v.cast("string")), ", "), F.lit("]"))


def after_first(x, sep: str) -> Column:
    """``s.split(sep, 1)[1]``; NULL when ``sep`` is absent."""
    c = _c(x)
    pos = F.instr(c, sep)
    return F.when(pos > 0, F.substring(c, pos + F.lit(len(sep)), F.lit(2 ** 31 - 1)))


def last_line(x) -> Column:
    """``s.split('\\n')[-1]``."""
    return F.substring_index(_c(x), "\n", -1)
