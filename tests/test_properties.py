"""Property tests: cleaning rules (C1, C2, C3, C4) against plain-Python models.

The DuckDB oracle runs ASCII fixtures only.  Here hypothesis draws strings with
accented letters, non-ASCII digits and Unicode blanks, and Spark's result must
equal a literal Python reading of each rule: Unicode ``\\w``/``\\d`` classes,
blanks stripped by the Unicode White_Space property.
"""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.functions import clean as CL
from feedloom.operators import cleaning as C

BLANKS = " \t\n  "
WORD = "abcxyzQWEñÑéÉ0123456789٣_"
EMAIL_ALPHABET = WORD + ".-@+" + BLANKS
PHONE_ALPHABET = "0123456789٣+- ()" + " "


def _strip(s: str) -> str:
    return s.strip(BLANKS)


def py_email(v):
    if v is None:
        return None
    e = _strip(v).lower()
    ok = (
        len(e) > 0
        and re.fullmatch(r"[\w\.-]+@[\w\.-]+\.\w{2,}", e) is not None
        and re.match(CL.EMAIL_BAD_START, e) is None
        and not any(e.endswith(s) for s in CL.EMAIL_FAKE_SUFFIXES)
        and e not in CL.EMAIL_FAKE_EXACT
    )
    return e if ok else None


def py_phone(v):
    if v is None:
        return None
    d = re.sub(r"[^\d]", "", v)
    if d.startswith("0034"):
        d = d[4:]
    elif d.startswith("34"):
        d = d[2:]
    ok = (
        len(d) == 9
        and re.fullmatch(r"\d{9}", d) is not None
        and re.match(CL.PHONE_FAKE_PREFIX, d) is None
        and d not in CL.PHONE_PLACEHOLDERS
    )
    return d if ok else None


def _emails():
    local = st.text(EMAIL_ALPHABET, min_size=0, max_size=12)
    built = st.builds(lambda a, b, c, pad: pad + a + "@" + b + c + pad,
                      st.text(WORD + ".-", min_size=1, max_size=8), st.text(WORD + ".-", min_size=1, max_size=6),
                      st.sampled_from([".com", ".es", ".c", "." + "ññ", ".com."] + CL.EMAIL_FAKE_SUFFIXES),
                      st.sampled_from(["", " ", "\t", " "]))
    keyboard = st.builds(lambda p, s: p + s, st.sampled_from(["qwerty", "1234", "ASDF", "zxcvb", "abcd"]),
                         st.sampled_from(["@x.es", "1@gmail.com", ".a@b.org"]))
    return st.one_of(st.none(), local, built, keyboard, st.sampled_from(CL.EMAIL_FAKE_EXACT))


def _phones():
    digits = st.text("0123456789", min_size=8, max_size=13)
    noisy = st.text(PHONE_ALPHABET, min_size=0, max_size=16)
    prefixed = st.builds(lambda p, d: p + d, st.sampled_from(["+34 ", "0034", "34", ""]), digits)
    return st.one_of(st.none(), noisy, prefixed, st.sampled_from(CL.PHONE_PLACEHOLDERS))


@settings(max_examples=6, deadline=None)
@given(st.lists(_emails(), min_size=1, max_size=80))
def test_clean_email_matches_python_model(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id int, email string")
    got = {r.id: r.email for r in C.clean_email(df, "email").collect()}
    exp = {i: py_email(v) for i, v in enumerate(values) if py_email(v) is not None}
    assert got == exp
    # idempotent: a cleaned address passes unchanged
    again = {r.id: r.email for r in C.clean_email(C.clean_email(df, "email"), "email").collect()}
    assert again == exp


@settings(max_examples=6, deadline=None)
@given(st.lists(_phones(), min_size=1, max_size=80))
def test_clean_phone_matches_python_model(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id int, tel string")
    got = {r.id: r.tel for r in C.clean_phone_es(df, "tel").collect()}
    assert got == {i: py_phone(v) for i, v in enumerate(values) if py_phone(v) is not None}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("-x " + BLANKS, max_size=4)), min_size=1, max_size=60),
       st.lists(st.one_of(st.none(), st.sampled_from(["s", "S", " si ", "y", "n", "None", "", " n", "no", "sí"])),
                min_size=1, max_size=30))
def test_dash_and_yes_no_match_python_model(spark, cells, answers):
    df = spark.createDataFrame(list(enumerate(cells)), "id int, c string")
    got = {r.id: r.c for r in C.dash_to_null(df).collect()}
    assert got == {i: (None if v is not None and _strip(v) == "-" else v) for i, v in enumerate(cells)}

    yn = spark.createDataFrame(list(enumerate(answers)), "id int, q string")
    out = C.infer_bool(yn, ["q"])
    norm = [None if v is None else _strip(v).lower() for v in answers]
    if all(v is None or v in CL.YES_VALUES + CL.NO_VALUES for v in norm):
        assert dict(out.dtypes)["q"] == "boolean"
        exp = {i: (None if v is None else v in CL.YES_VALUES) for i, v in enumerate(norm)}
    else:
        assert dict(out.dtypes)["q"] == "string"
        exp = dict(enumerate(answers))
    assert {r.id: r.q for r in out.collect()} == exp
