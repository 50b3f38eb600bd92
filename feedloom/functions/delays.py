"""Delays named in a text, read by one pass of a small state machine over its words.

The machine is a table: a state and the class of the next word give the next state and an
action on a few numbers.  It runs as an ``aggregate`` in the JVM, over the words around the
units of time that a text names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import fold_accents

# Delay units and their length in days.
DELAY_UNIT_DAYS = {
    "h": 1.0 / 24.0,
    "hora": 1.0 / 24.0,
    "horas": 1.0 / 24.0,
    "dia": 1.0,
    "dias": 1.0,
    "semana": 7.0,
    "semanas": 7.0,
    "mes": 30.0,
    "meses": 30.0,
    "ano": 365.0,
    "anos": 365.0,
}
# Numbers that are written as words, accents folded.
_ONES = {"un": 1, "una": 1, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9}
_TEENS = {"cero": 0, "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "veinte": 20}
_TEENS |= {"dieci" + w: 10 + n for w, n in _ONES.items() if n > 5} | {"veinti" + w: 20 + n for w, n in _ONES.items()}
_TENS = {"treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90}
_HUNDREDS = {"ciento": 100} | {
    stem + end: n
    for stem, n in {"doscient": 200, "trescient": 300, "cuatrocient": 400, "quinient": 500, "seiscient": 600, "setecient": 700, "ochocient": 800, "novecient": 900}.items()
    for end in ("os", "as")
}

# Classes of words.
_OTHER, _ONE, _TEEN, _TEN, _HUNDRED, _CIEN, _MIL, _HALF, _AND, _UNIT, _DIGITS = range(11)
_CLASSES = {_ONE: _ONES, _TEEN: _TEENS, _TEN: _TENS, _HUNDRED: _HUNDREDS, _CIEN: {"cien": 100}, _MIL: {"mil": 1000}, _HALF: {"medio": 0.5, "media": 0.5}, _AND: {"y": 0}, _UNIT: DELAY_UNIT_DAYS}

# States: what the words so far are the beginning of.
(_NOTHING, _NUMBER, _AFTER_TEN, _AFTER_HUNDRED, _AFTER_MIL, _TEN_AND, _NUMBER_AND, _HALVED, _AFTER_DIGITS, _DELAY, _DELAY_AND, _DELAY_AND_HALF) = range(12)

# Actions on the number read so far: thousands ``hi`` and what follows them, ``lo``.
_KEEP, _START, _ADD, _SET, _TIMES, _THOUSAND, _EMIT = range(7)


def _table() -> dict[tuple[int, int], tuple[int, int]]:
    """(state, class) -> (next state, action)."""
    begins = {_OTHER: (_NOTHING, _KEEP), _AND: (_NOTHING, _KEEP), _UNIT: (_NOTHING, _KEEP), _ONE: (_NUMBER, _START), _TEEN: (_NUMBER, _START), _CIEN: (_NUMBER, _START),
              _TEN: (_AFTER_TEN, _START), _HUNDRED: (_AFTER_HUNDRED, _START), _DIGITS: (_AFTER_DIGITS, _START), _HALF: (_HALVED, _START), _MIL: (_AFTER_MIL, _THOUSAND)}
    t = {(state, word): go for state in range(12) for word, go in begins.items()}  # by default a word begins anew
    for state in (_NUMBER, _AFTER_TEN, _AFTER_HUNDRED, _AFTER_DIGITS):
        t[state, _MIL] = (_AFTER_MIL, _TIMES)
    for state in (_NUMBER, _AFTER_HUNDRED, _AFTER_MIL, _AFTER_DIGITS):
        t[state, _AND] = (_NUMBER_AND, _KEEP)
    for state in (_NUMBER, _AFTER_TEN, _AFTER_HUNDRED, _AFTER_MIL, _HALVED, _AFTER_DIGITS, _DELAY_AND_HALF):
        t[state, _UNIT] = (_DELAY, _EMIT)
    for word, state in ((_ONE, _NUMBER), (_TEEN, _NUMBER), (_TEN, _AFTER_TEN)):
        t[_AFTER_HUNDRED, word] = (state, _ADD)
        t[_AFTER_MIL, word] = (state, _SET)
    t[_AFTER_MIL, _HUNDRED], t[_AFTER_MIL, _CIEN] = (_AFTER_HUNDRED, _SET), (_NUMBER, _SET)
    t[_AFTER_TEN, _AND], t[_TEN_AND, _ONE] = (_TEN_AND, _KEEP), (_NUMBER, _ADD)
    t[_TEN_AND, _HALF] = t[_NUMBER_AND, _HALF] = (_HALVED, _ADD)
    t[_DELAY, _AND], t[_DELAY_AND, _HALF] = (_DELAY_AND, _KEEP), (_DELAY_AND_HALF, _START)
    return t


#: A unit of time in a text as it is: whole, or behind a numeral (``24h``).
#: The look-ahead for a first letter lets most places fail at once.
_UNIT_WORD = r"(?=[hdsmaHDSMA])(?<![a-zA-ZáéíóúñÁÉÍÓÚÑ_])(?i:h(?:oras?)?|d[ií\u00cd]as?|semanas?|mes(?:es)?|a[nñ\u00d1]os?)(?![a-zA-Z0-9áéíóúñÁÉÍÓÚÑ_])"
_NUMERAL = "[0-9]+(?:[.,][0-9]+)*"
#: Characters before a unit that can hold its number (the longest below a million takes 70), and from a unit on ("meses y medio").
_BEFORE, _AFTER = 120, 32


def _tokens(text: Column) -> Column:
    """Words, numerals and single marks of a folded text; ``24h`` is two words."""
    apart = F.regexp_replace(text, rf"(?<![a-z0-9.,])({_NUMERAL})(?=h(?:oras?)?(?![a-z0-9])|dias?(?![a-z0-9])|semanas?(?![a-z0-9])|mes(?:es)?(?![a-z0-9])|anos?(?![a-z0-9]))", "$1 ")
    return F.regexp_extract_all(apart, F.lit(rf"{_NUMERAL}(?![a-z0-9])|[a-z0-9]+|[^\sa-z0-9]"), F.lit(0))


def _around_units(raw: Column) -> Column:
    """A text without what is far from any unit of time: a mark stands where something was left out.

    One pass cuts the text in front of every unit; of each piece the two ends stay.
    """

    def near(part: Column) -> Column:
        ends = F.concat(F.substring(part, 1, _AFTER), F.lit(" # "), F.substring(part, -_BEFORE, _BEFORE))
        return F.when(F.length(part) > _BEFORE + _AFTER, ends).otherwise(part)

    return F.array_join(F.transform(F.split(raw, rf"(?={_UNIT_WORD})"), near), "")


def delay_days(c) -> Column:
    """Longest delay mentioned in a text, in days (``48 horas`` -> 2.0); null if none.

    Numbers may be numerals (``1,5 horas``; of several marks the last is the decimal one),
    attached (``24h``) or Spanish words below a million (``cuarenta y ocho horas``, ``media
    hora``, ``dos y medio``, ``dos dias y medio``).  Marks end a number.  Case and accents
    are ignored: ``días`` and ``dias``, ``años`` and ``anos``.
    """
    raw = F.col(c) if isinstance(c, str) else c
    table = _table()
    width = len(_CLASSES) + 2
    go, act = (F.array(*[F.lit(table[s, w][i]) for s in range(12) for w in range(width)]) for i in (0, 1))
    known = F.create_map(*[x for number, words in _CLASSES.items() for w, v in words.items() for x in (F.lit(w), F.struct(F.lit(number).alias("c"), F.lit(float(v)).alias("v")))])

    def classed(w: Column) -> Column:
        value = F.replace(F.regexp_replace(w, "[.,](?=.*[.,])", ""), F.lit(","), F.lit(".")).try_cast("double")
        plain = F.struct(F.when(value.isNull(), _OTHER).otherwise(_DIGITS).alias("c"), F.coalesce(value, F.lit(0.0)).alias("v"))
        return F.coalesce(F.try_element_at(known, w), F.when(w.rlike("^[0-9]"), plain), F.struct(F.lit(_OTHER).alias("c"), F.lit(0.0).alias("v")))

    def step(s: Column, w: Column) -> Column:
        at = s["state"] * width + w["c"] + 1
        a = F.element_at(act, at)
        more_half = F.when((s["state"] == _DELAY_AND_HALF) & (w["c"] != _UNIT), (s["n"] + 0.5) * s["unit"])
        emitted = a == _EMIT
        return F.struct(
            F.element_at(go, at).alias("state"),
            F.when(a == _START, 0.0).when(a == _TIMES, s["lo"] * 1000).when(a == _THOUSAND, 1000.0).otherwise(s["hi"]).alias("hi"),
            F.when(a.isin(_START, _SET), w["v"]).when(a == _ADD, s["lo"] + w["v"]).when(a.isin(_TIMES, _THOUSAND), 0.0).otherwise(s["lo"]).alias("lo"),
            F.when(emitted, s["hi"] + s["lo"]).otherwise(s["n"]).alias("n"),
            F.when(emitted, w["v"]).otherwise(s["unit"]).alias("unit"),
            F.greatest(s["best"], more_half, F.when(emitted, (s["hi"] + s["lo"]) * w["v"])).alias("best"),
        )

    zero = F.lit(0.0)
    start = F.struct(F.lit(_NOTHING).alias("state"), zero.alias("hi"), zero.alias("lo"), zero.alias("n"), zero.alias("unit"), F.lit(None).cast("double").alias("best"))
    last = lambda s: F.greatest(s["best"], F.when(s["state"] == _DELAY_AND_HALF, (s["n"] + 0.5) * s["unit"]))
    return F.aggregate(F.transform(_tokens(fold_accents(F.lower(_around_units(raw)))), classed), start, step, last)


__all__ = ["DELAY_UNIT_DAYS", "delay_days"]
