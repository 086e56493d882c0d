"""Unicode folding as JVM-side column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def accent_table() -> tuple[str, str]:
    """Lower-case letters of the basic plane that decompose to one letter and marks, and that letter."""
    source, target = [], []
    for code in range(0xC0, 0x10000):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or char != char.lower():
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char and base.isalpha():
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def fold_accents(text: Column) -> Column:
    """Lower-case ``text`` and drop accents, composed or not; null stays null."""
    low = F.lower(text)
    source, target = accent_table()
    plain = F.regexp_replace(F.translate(low, source, target), r"\p{M}+", "")
    return F.when(low.rlike(r"[^\x00-\x7F]"), plain).otherwise(low)


def clean_tag(tag: Column) -> Column:
    """Clean form of a dirty tag: without blanks of any kind around it and leading ``/tag/`` or ``#``, in upper case; blank gives null."""
    bare = F.upper(F.regexp_replace(tag, r"(?i)^(?:[\s\p{Z}\p{C}]+|/tag/|#)+|[\s\p{Z}\p{C}]+$", ""))
    return F.when(bare != "", bare)
