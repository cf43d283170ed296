"""Join-key normalisation (lower-case, strip surrounding whitespace).

``trim`` only strips ASCII spaces; the ``(?U)`` flag makes ``\\s`` match every
Unicode space (tab, no-break space, ideographic space).  Python's
``str.strip`` also removes the four information separators U+001C-U+001F,
so the class adds them: the result equals ``lower().strip()`` for every
code point Python treats as whitespace (checked exhaustively in tests).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_EDGE_SPACE = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(c) -> Column:
    """lower(strip(c)); null stays null."""
    return F.lower(F.regexp_replace(_col(c), _EDGE_SPACE, ""))


def key_equals(c, value: str) -> Column:
    """Case- and space-insensitive equality with a bound parameter (never
    string-interpolated into SQL)."""
    return norm(c) == norm(F.lit(value))
