"""Folding and cutting of text as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with marks and the letters below them, from the Unicode decompositions."""
    a, b = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii() and c == c.lower():
            a.append(c)
            b.append(base)
    # fixed values: letters with strokes do not decompose
    a += ["ø", "ł", "đ", "ı", "ħ"]
    b += ["o", "l", "d", "i", "h"]
    return "".join(a), "".join(b)


_FROM, _TO = _folds()


def fold(c: Column) -> Column:
    """Lower case without marks on Latin letters, combining marks dropped; text of ASCII letters alone, as long as its bytes, takes the short way."""
    x = F.translate(F.lower(c), _FROM, _TO)
    x = F.replace(F.replace(x, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))
    x = F.regexp_replace(x, r"\p{Mn}+", "")
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(x)


def tokens(c: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.filter(F.split(c, r"(?U)[^\p{L}\p{N}]+"), lambda t: t != "")


def near(t: Column, u: Column) -> Column:
    """Equal, or as alike as a slip or two of the keyboard leave a longer word."""
    allowed = F.when(F.least(F.length(t), F.length(u)) >= 9, 2).when(F.least(F.length(t), F.length(u)) >= 5, 1).otherwise(0)
    swap = (F.length(t) == F.length(u)) & (F.length(t) >= 4) & (F.levenshtein(t, u) == 2) & (F.array_sort(F.split(t, "")) == F.array_sort(F.split(u, "")))
    return (t == u) | ((F.abs(F.length(t) - F.length(u)) <= 2) & ((F.levenshtein(t, u) <= allowed) | swap))
