"""Literal cases for the cleaning operators (FIXTURES.md §4)."""

import datetime as dt

from pyspark.sql import functions as F

from feedloom.functions import delay_days, to_number, word_count, zfill5
from feedloom.functions.clean import EMAIL_FAKE_EXACT, EMAIL_FAKE_SUFFIXES, PHONE_PLACEHOLDERS
from feedloom.operators import cleaning as C
from feedloom.operators import columns as P
from feedloom.operators import filters as FL


def _one_col(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_clean_email(spark):
    keep = [" Ana.P@Hotmail.com ", "x@gmail.com", "ñandu@x.es"]
    drop = [None, "", "a@b", "qwerty1@x.es", "1234a@x.es", "z@mail.com", "xnocorreo@gmail.com", "abcd@x.es"]
    drop += ["user" + s if s.startswith("@") else s for s in EMAIL_FAKE_SUFFIXES] + EMAIL_FAKE_EXACT
    out = C.clean_email(_one_col(spark, keep + drop, "email"), "email").orderBy("i").collect()
    assert [r.email for r in out] == ["ana.p@hotmail.com", "x@gmail.com", "ñandu@x.es"]


def test_clean_phone(spark):
    keep = ["+34 612 345 678", "0034612345678", "34612345678", "612-345-678"]
    drop = ["666666666", "123456780", "111111119", "341234567", "6123456789", None, "", "12345"] + PHONE_PLACEHOLDERS
    out = C.clean_phone_es(_one_col(spark, keep + drop, "tel"), "tel").collect()
    assert sorted(r.tel for r in out) == ["612345678"] * 4


def test_dash_to_null_and_idempotent(spark):
    df = _one_col(spark, [" x-y ", "-", " - ", "\t-", "a", None])
    once = C.dash_to_null(df)
    assert [r.v for r in once.orderBy("i").collect()] == [" x-y ", None, None, None, "a", None]
    assert once.collect() == C.dash_to_null(once).collect()


def test_infer_bool(spark):
    rows = [("S", None, "s", "sí", "s", "Y"), ("n", None, "no", "n", "maybe", " si "), (None, None, "s", "n", "s", "")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    out = C.infer_bool(df)
    types = dict(out.dtypes)
    assert types == {"a": "boolean", "b": "boolean", "c": "string", "d": "string", "e": "string", "f": "boolean"}
    got = out.collect()
    assert [r.a for r in got] == [True, False, None]
    assert [r.f for r in got] == [True, True, False]


def test_duration_seconds(spark):
    df = _one_col(spark, ["2m 15s", "3m", "40s", "1h 2m", None, "x"], "t")
    out = C.duration_to_seconds(df, "t").orderBy("i").collect()
    assert [r.t for r in out] == [135, 180, 40, 120, 0, 0]


def test_parse_dates(spark):
    df = spark.createDataFrame(
        [("05/01/2025 09:03:04", "05/01/2025"), ("5/1/2025 9:03:04", "5/1/2025"),
         ("31/02/2025 10:00:00", "31/02/2025"), ("2025-01-05 10:00:00", "2025-01-05"), ("", "")],
        "respondido string, enviado string")
    out = P.split_datetime(C.parse_dates(df), "respondido").collect()
    want_ts = dt.datetime(2025, 1, 5, 9, 3, 4)
    assert [r.respondido for r in out] == [want_ts, want_ts, None, None, None]
    assert [r.enviado for r in out] == [dt.date(2025, 1, 5)] * 2 + [None] * 3
    assert out[0].respondido_hora == "09:03:04" and out[0].respondido_fecha == dt.date(2025, 1, 5)


def test_to_number(spark):
    df = _one_col(spark, ["7", " 7 ", "7.5", "n/a", "7,5", "7d", "NaN", "1e1", None])
    got = [r.n for r in df.select("i", to_number("v").alias("n")).orderBy("i").collect()]
    assert got == [7.0, 7.0, 7.5, None, None, None, None, 10.0, None]


def test_zfill5_idempotent(spark):
    df = _one_col(spark, ["8001", "123456", None, "28001"])
    once = df.select("i", zfill5("v").alias("v"))
    assert [r.v for r in once.orderBy("i").collect()] == ["08001", "123456", None, "28001"]
    assert once.orderBy("i").collect() == once.select("i", zfill5("v").alias("v")).orderBy("i").collect()


def test_min_words(spark):
    df = _one_col(spark, ["uno dos  tres   cuatro", "uno dos tres", "", None, " a b c d "], "comment")
    assert sorted(r.i for r in FL.min_words(df, "comment").collect()) == [0, 4]
    assert [r.n for r in df.select("i", word_count("comment").alias("n")).orderBy("i").collect()] == [4, 3, 0, 0, 4]


def test_recode(spark):
    df = _one_col(spark, ["Petrol", "Hybrid", "Electric", "Diesel", "LPG", None])
    got = [r.v for r in C.recode_values(df, "v").orderBy("i").collect()]
    assert got == ["Gasolina", "Híbrido", "Eléctrico", "Diésel", "LPG", None]


def test_delay_days(spark):
    df = _one_col(spark, ["más de 3 semanas", "15 días", "48 horas", "5 meses", "sin número", "2 dias y 1 semana"])
    got = [r.d for r in df.select("i", delay_days("v").alias("d")).orderBy("i").collect()]
    assert got == [21.0, 15.0, 2.0, 150.0, None, 7.0]


def test_merge_columns(spark):
    df = spark.createDataFrame([(None, "b", "c", 1), ("a", None, None, 2)],
                               "`Fecha Contacto` string, fecha_contacto string, `Fecha  contacto!` string, x int")
    out = P.merge_columns(df, {"fecha contacto": "fecha_contacto"})
    assert out.columns == ["fecha_contacto", "x"]
    assert [r.fecha_contacto for r in out.collect()] == ["b", "a"]


def test_merge_columns_mixed_types_and_rename(spark):
    df = spark.createDataFrame([(True, "x", 5)], "`Sí Acepta` boolean, si_acepta string, Modelo_Coche int")
    out = P.merge_columns(df, [("si acepta", "acepta"), ("modelo coche", "modelo")])
    assert dict(out.dtypes) == {"acepta": "string", "modelo": "int"}
    assert out.collect()[0].acepta == "true"


def test_normalize_columns_collision(spark):
    import pytest

    df = spark.createDataFrame([(1, 2)], "`A b` int, `a_b` int")
    with pytest.raises(ValueError):
        P.normalize_columns(df)
    assert P.normalize_columns(spark.createDataFrame([(1,)], "` Nombre Cliente ` int")).columns == ["nombre_cliente"]


def test_merge_plan_order_and_taken_names():
    plan = P.merge_plan(["id", "Fecha Alta", "alta", "fecha-alta", "x"], {"fecha alta": "alta"})
    assert plan == [("id", ["id"]), ("alta", ["Fecha Alta", "fecha-alta"]), ("x", ["x"])]
    assert P.merge_plan(["a", "b"], {}) == [("a", ["a"]), ("b", ["b"])]


def test_name_key():
    assert P.name_key("Straße_Ærø  łódź") == "strasse_aero_lodz"
    assert P.name_key("  Fecha de Contacto (día)! ") == "fecha_de_contacto_dia"
    assert P.name_key("Teléfono") == "telefono"


def test_rename_and_drop_ignore_missing(spark):
    df = spark.createDataFrame([(1, 2)], "`Dealer Name` int, VIN int")
    out = P.drop_if_exists(P.rename(df, P.VERBATIM_RENAMES), P.VERBATIM_DROPS)
    assert out.columns == ["Taller"]


def test_polarity_bands(spark):
    df = spark.createDataFrame([(i, None if s is None else float(s), "a b c d e") for i, s in enumerate([1, 5, 6, 7, 8, None])],
                               "id int, score double, comment string")
    read = lambda kind: [r.id for r in FL.ranked(FL.polarity(df, kind), kind).collect()]
    assert read("negative") == [0, 1]
    assert read("positive") == [4]
    assert FL.segment(df, "id", FL.ALL).count() == 6
    assert df.select(F.lit(1)).count() == 6


def test_slug_value_key(spark):
    from feedloom.functions import slug

    df = _one_col(spark, ["Servicio Técnico", "  Ventas!! ", "Ñandú--Motor"])
    got = [r.s for r in df.select("i", slug("v").alias("s")).orderBy("i").collect()]
    assert got == ["servicio_tecnico", "ventas", "nandu_motor"]


def test_delay_days_forms(spark):
    from feedloom.functions import delay_days

    cases = {"esperé 1,5 horas": 1.5 / 24, "tardó 1.5 horas": 1.5 / 24, "una semana": 7, "2 años": 730, "24h sin coche": 1, "dos días y 3 horas": 2,
             "48 HORAS": 2, "unas horas": None, "luna semana": None, "5 mesas": None, "tres meses.": 90, "x5 horas": None, "": None, "un mes": 30, "10 dias,2 semanas": 14}
    df = spark.createDataFrame(list(enumerate(cases)), "id int, c string").select("c", delay_days("c").alias("d"))
    for r in df.collect():
        assert (r.d is None) == (cases[r.c] is None) and (r.d is None or abs(r.d - cases[r.c]) < 1e-9), r


def test_mentions_plurals(spark):
    from feedloom.functions.text import mentions

    cases = {"muchas esperas": True, "Esperás": True, "desespera": False, "atenciones": True, "atención": True, "esperamos": False, "tardanzas!": True, None: False}
    df = spark.createDataFrame(list(enumerate(cases)), "id int, c string").select("c", mentions("c", ["espera", "atencion", "tardanza"]).alias("m"))
    assert {r.c: r.m for r in df.collect()} == cases


def test_delay_days_number_words(spark):
    cases = {
        "doce días": 12, "veinticuatro horas": 1, "cien dias": 100, "cuarenta y ocho horas": 2, "treinta y un días": 31,
        "dieciséis dias": 16, "veintidós días": 22, "noventa y nueve dias": 99, "ciento veinte horas": 5, "doscientas cuarenta horas": 10,
        "mil doscientas horas": 50, "dos mil cuatrocientas horas": 100, "2 mil dias": 2000, "media hora": 1 / 48, "dos dias y medio": 2.5,
        "una semana y media": 10.5, "tres y media horas": 3.5 / 24, "espere dos dias y media hora": 2, "entre dos y tres dias": 3,
    }
    df = spark.createDataFrame([(c, float(w)) for c, w in cases.items()], "c string, want double")
    got = {r.c: (r.d, r.want) for r in df.select("c", "want", delay_days("c").alias("d")).collect()}
    assert {c: g for c, g in got.items() if g[0] is None or abs(g[0] - g[1]) > 1e-9} == {}
