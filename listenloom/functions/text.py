"""Small text predicates shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it, for Java's regular expressions.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0085\u001c-\u001f]"


def is_blank(c: Column) -> Column:
    """True where ``c`` holds nothing but white space (false for null)."""
    return F.coalesce(c.rlike(f"^{SPACE}*$"), F.lit(False))


def has_text(c: Column) -> Column:
    """True where ``c`` is neither null nor blank."""
    return c.isNotNull() & ~is_blank(c)


def strip(c: Column) -> Column:
    """``c`` without white space at either end, no-break spaces included."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")
