"""Text column expressions: whitespace, accents, slugs, word counts, theme words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms, used to fold accents
# in column *values* (the driver-side name key uses unicodedata instead).
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"


#: What lies between the words of a lower-cased text; theme terms are looked for between such places.
WORD_BREAK = "[^a-z0-9" + "".join(a for a in ACCENTED if a.islower()) + "]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim any Unicode whitespace at both ends (Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def fold_accents(c) -> Column:
    return F.translate(_c(c), ACCENTED, PLAIN)


def slug(c) -> Column:
    """Value key: lower-case, accents folded, non-word runs -> '_', trimmed of '_'."""
    t = F.regexp_replace(fold_accents(F.lower(_c(c))), r"(?U)\W+", "_")
    t = F.regexp_replace(t, "_+", "_")
    return F.regexp_replace(t, "^_+|_+$", "")


def word_count(c) -> Column:
    """Number of whitespace-separated words; null counts as 0 words."""
    return F.regexp_count(F.coalesce(_c(c), F.lit("")), F.lit(r"(?U)\S+"))


def has_more_words(c, n: int) -> Column:
    """More than ``n`` whitespace-separated words (null -> False).

    Anchored, possessive pattern: it stops after the first ``n + 1`` words
    instead of splitting the whole comment.
    """
    return F.coalesce(_c(c).rlike(r"(?U)^\s*+(?:\S++\s++){%d}\S" % n), F.lit(False))


def _accent_class(ch: str) -> str:
    """Regex for one plain letter that also matches its accented lower-case forms."""
    import re

    variants = [a for a, p in zip(ACCENTED, PLAIN) if p == ch and a.islower()]
    return f"[{ch}{''.join(variants)}]" if variants else re.escape(ch)


def term_pattern_lower(terms: list[str]) -> str:
    """Regex matching any of ``terms``, or its plural in -s or -es, as a whole word of
    lower-cased text that still carries accents.

    Accents are classes in the pattern, which spares a per-character ``translate`` of
    every comment.
    """
    word = "a-z0-9" + "".join(a for a in ACCENTED if a.islower())
    alts = "|".join("".join(_accent_class(ch) for ch in fold_plain(t.lower())) for t in terms)
    # look-around boundaries: same matches as a consumed boundary group, but
    # the regex engine scans for the alternatives directly (about 2x faster)
    return f"(?<![{word}])(?:{alts})(?:e?s)?(?![{word}])"


def fold_plain(s: str) -> str:
    """Accent-fold a Python string with the same fixed letter table as ``fold_accents``."""
    return s.translate(str.maketrans(ACCENTED, PLAIN))


def mentions(c, terms: list[str], lowered: bool = False) -> Column:
    """True when the text mentions any of ``terms`` as a whole word (case and accents
    ignored); null text -> False.  Pass ``lowered=True`` when ``c`` is already
    lower-cased (lower once when testing several themes)."""
    text = _c(c) if lowered else F.lower(_c(c))
    return F.coalesce(text.rlike(term_pattern_lower(terms)), F.lit(False))
