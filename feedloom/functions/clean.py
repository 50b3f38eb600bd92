"""Scalar cleaning expressions for survey extracts.

Each function returns a Column, so the filters built on them (``operators.cleaning``)
collapse into one predicate in the Catalyst plan and run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import strip_ws


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- e-mail ----
# Fixed values (must equal the original cleaner's lists).
EMAIL_FORMAT = r"(?U)^[\w\.-]+@[\w\.-]+\.\w{2,}$"
EMAIL_BAD_START = r"^(0123|1234|2345|abcd|asdf)|^(qwerty|asdfgh|zxcvb)"
EMAIL_FAKE_SUFFIXES = [
    "@mail.com", "@test.com", "@abc.com", "@qq.com",
    "@correo.com", "@email.com", "@fake.com", "@sinemail.com",
    "@none.com", "@example.com", "@nomail.com", "@noemail.com",
    "@na.com", "@null.com", "@nulo.com", "nocorreo@nocorreo.com",
    "nomail@nomail.com", "noemail@noemail.com", "none@none.com",
    "nocorreo@gmail.com", "nomail@gmail.com", "noemail@gmail.com",
    "none@gmail.com",
]
EMAIL_FAKE_EXACT = [
    "test@test.com", "correo@correo.com", "email@email.com",
    "sin@email.com", "fake@fake.com", "none@none.com",
    "na@na.com",
]


def clean_email_value(c) -> Column:
    """Stripped, lower-cased e-mail text."""
    return F.lower(strip_ws(_c(c).cast("string")))


def email_is_valid(c) -> Column:
    """True when a cleaned e-mail passes every rule; null/empty input is False."""
    e = _c(c)
    no_fake_suffix = ~_any_endswith(e, EMAIL_FAKE_SUFFIXES)
    ok = (
        e.isNotNull()
        & (F.length(e) > 0)
        & e.rlike(EMAIL_FORMAT)
        & ~e.rlike(EMAIL_BAD_START)
        & no_fake_suffix
        & ~e.isin(EMAIL_FAKE_EXACT)
    )
    return F.coalesce(ok, F.lit(False))


def _any_endswith(e: Column, suffixes: list[str]) -> Column:
    out = None
    for s in suffixes:
        t = e.endswith(s)
        out = t if out is None else (out | t)
    return out


# ----------------------------------------------------------------- phone ----
# Fixed values (must equal the original cleaner's lists).
PHONE_FAKE_PREFIX = r"^(12345678|11111111|00000000|98765432|99999999)"
PHONE_PLACEHOLDERS = [
    "000000000", "123456789", "987654321",
    "666666666", "999999999", "111111111",
    "sintelefono", "ninguno", "noaplica", "no_tengo",
]


def phone_digits_es(c) -> Column:
    """Digits only, then one leading ``0034`` (else ``34``) removed."""
    d = F.regexp_replace(_c(c).cast("string"), r"(?U)[^\d]", "")
    return (
        F.when(d.startswith("0034"), F.substring(d, 5, 1 << 30))
        .when(d.startswith("34"), F.substring(d, 3, 1 << 30))
        .otherwise(d)
    )


def phone_is_valid_es(c) -> Column:
    """True for a 9-digit Spanish number that is not a known fake; null is False."""
    p = _c(c)
    ok = (
        (F.length(p) == 9)
        & p.rlike(r"(?U)^\d{9}$")
        & ~p.rlike(PHONE_FAKE_PREFIX)
        & ~p.isin(PHONE_PLACEHOLDERS)
    )
    return F.coalesce(ok, F.lit(False))


# -------------------------------------------------------- generic cells ----
def is_dash(c) -> Column:
    """Cell whose stripped text is exactly ``-``."""
    return F.coalesce(strip_ws(_c(c).cast("string")) == "-", F.lit(False))


# Answers read as yes / no.
YES_VALUES = ["s", "si", "y"]
NO_VALUES = ["n", "none", ""]


def _yes_no_norm(c) -> Column:
    return F.lower(strip_ws(_c(c).cast("string")))


def yes_no_ok(c) -> Column:
    """Null or one of the yes/no spellings (per-row half of the column test)."""
    v = _yes_no_norm(c)
    return F.coalesce(v.isin(YES_VALUES + NO_VALUES), F.lit(True))


def yes_no_bool(c) -> Column:
    v = _yes_no_norm(c)
    return F.when(v.isin(YES_VALUES), F.lit(True)).when(v.isin(NO_VALUES), F.lit(False)).cast("boolean")


# --------------------------------------------------------------- numbers ----
NUMBER_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def to_number(c) -> Column:
    """Lenient numeric coercion: numeric text (surrounding blanks allowed) -> double, else null.

    Guarded by a regex because Spark's cast also accepts ``7d``, ``7f`` and ``NaN``.
    """
    t = strip_ws(_c(c).cast("string"))
    return F.when(t.rlike(NUMBER_TEXT), t.try_cast("double"))


def duration_seconds(c) -> Column:
    """``"Xm Ys"`` -> X*60+Y; each missing part counts 0, null -> 0 (hours ignored)."""
    t = F.coalesce(strip_ws(_c(c).cast("string")), F.lit(""))

    def part(pattern: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).try_cast("bigint"), F.lit(0))

    return (part(r"(\d+)m") * 60 + part(r"(\d+)s")).cast("bigint")


def parse_datetime(c, fmt: str = "d/M/yyyy H:m:s") -> Column:
    """Lenient day-first datetime -> timestamp_ntz; bad input -> null."""
    return F.try_to_timestamp(_c(c).cast("string"), F.lit(fmt)).cast("timestamp_ntz")


def parse_date(c, fmt: str = "d/M/yyyy") -> Column:
    """Lenient day-first date -> date; bad input -> null."""
    return F.try_to_timestamp(_c(c).cast("string"), F.lit(fmt)).cast("date")


def recode(c, mapping: dict) -> Column:
    """Replace values found in ``mapping``; others pass through unchanged."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, _c(c)), _c(c)) if mapping else _c(c)


def zfill5(c) -> Column:
    """Left-pad with zeros to 5 characters; longer values are kept whole."""
    s = _c(c).cast("string")
    return F.when(F.length(s) < 5, F.lpad(s, 5, "0")).otherwise(s)
