"""Sources and sinks end to end: messy CSV extracts -> preparation -> Parquet -> read back."""

import datetime as dt
import os

import pandas as pd
from pyspark.sql import functions as F

from feedloom.plans import fixtures as X
from feedloom.plans.preparation import prepare_survey, prepare_verbatims
from feedloom.sources import ingest as S
from feedloom.sources import sinks as K
from tests.conftest import SF_SMALL


def _write(path, rows, cols):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pd.DataFrame(rows, columns=cols).to_csv(path, index=False)


def _survey_extracts(root):
    base = ["Apellido Cliente", "Nombre Cliente", "Email", "Teléfono", "Tiempo Empleado", "Q1", "Modelo Coche",
            "Respondido", "IP"]
    rows1 = [
        ["Ruiz", "Ana", " Ana.R@Hotmail.com ", "+34 612 345 678", "2m 15s", "S", "Brand#11", "05/01/2025 09:03:04", "2.1.1.7"],
        ["Ruiz", "Ana", "ana.r@hotmail.com", "612345678", "2m 15s", "S", "Brand#11", "05/01/2025 09:03:04", "2.1.1.7"],
        ["Gil", "Luis", "luis@test.com", "699111222", "1m", "n", "Brand#12", "6/1/2025 10:00:00", "3.1.1.7"],
        ["Sanz", "Eva", "eva@empresa.es", "666666666", "3m", "n", "Brand#13", "7/1/2025 11:00:00", "4.1.1.7"],
        ["Sanz", "Eva", "eva@empresa.es", "699000111", "-", "-", "Brand#13", "bad", "bad"],
    ]
    _write(f"{root}/2025/enero__Ventas.csv", rows1, base)
    _write(f"{root}/2025/enero__Questionnaire.csv", [["Q1", "¿Recomendaría?"]], ["Display ID", "Questionnaire"])
    rows2 = [["Paz", "Leo", "leo@empresa.es", "0034688777666", "40s", "Brand#11", "08/02/2025 08:00:00", "5.1.1.7", "x"]]
    _write(f"{root}/2025/feb/febrero__Ventas.csv", rows2,
           ["Apellido Cliente", "Nombre Cliente", "Email", "Teléfono", "Tiempo Empleado", "Modelo coche",
            "Respondido", "IP", "Extra"])
    _write(f"{root}/2025/feb/febrero__Posventa.csv", [["x"]], ["Otra"])


def test_read_survey_and_prepare(spark, tmpdir_path):
    root = f"{tmpdir_path}/bruto"
    _survey_extracts(root)
    raw = S.read_survey(spark, root, "Ventas")
    assert raw.count() == 6
    assert "¿recomendaría?" in raw.columns and "extra" in raw.columns  # renamed by the questionnaire, unioned by name
    mapping = {"modelo coche": "modelo", "¿recomendaría?": "recomienda"}
    tech = X.technology_dim(spark, SF_SMALL).withColumnRenamed("model", "modelo")
    out = prepare_survey(raw, tech, mapping, X.city_ranges(spark, SF_SMALL), X.asn_ranges(spark, SF_SMALL),
                         X.income_dim(spark, SF_SMALL), threshold=5)
    rows = {r.nombre_cliente: r for r in out.collect()}
    # duplicate Ana removed (>= 5 equal columns), test.com e-mail and 666666666 phone removed
    assert sorted(rows) == ["Ana", "Eva", "Leo"]
    assert rows["Ana"]["email"] == "ana.r@hotmail.com" and rows["Ana"]["teléfono"] == "612345678"
    assert rows["Ana"]["tiempo_empleado"] == 135 and rows["Eva"]["tiempo_empleado"] == 0
    assert rows["Ana"]["respondido"] == dt.datetime(2025, 1, 5, 9, 3, 4) and rows["Eva"]["respondido"] is None
    assert rows["Ana"]["respondido_hora"] == "09:03:04"
    assert dict(out.dtypes)["recomienda"] == "boolean" and rows["Ana"]["recomienda"] is True
    assert rows["Ana"]["tecnologia"] is not None and rows["Ana"]["ip_city"] == "C2"
    assert rows["Eva"]["ip_city"] is None  # malformed IP
    assert rows["Leo"]["ip_city"] is None  # block 5 is odd: missing in the ASN database
    assert rows["Ana"]["renta_media"] is not None  # postal code 00074 joins the padded income dim

    K.write_parquet(out.drop("_row"), f"{tmpdir_path}/procesado/ventas.parquet")
    back = S.read_parquet(spark, f"{tmpdir_path}/procesado/ventas.parquet")
    # Brand#11 appears twice in the technology lookup, so its rows multiply (left-join semantics)
    assert back.count() == out.count() == 5


def test_read_survey_empty_and_parquet(spark, tmpdir_path):
    assert S.read_survey(spark, f"{tmpdir_path}/nothing", "Ventas").count() == 0
    os.makedirs(f"{tmpdir_path}/pq/sub")
    pd.DataFrame({"Nombre Cliente": ["x"], "q": [1]}).to_parquet(f"{tmpdir_path}/pq/a__Ventas.parquet")
    pd.DataFrame({"Nombre Cliente": ["y"], "other": ["z"]}).to_parquet(f"{tmpdir_path}/pq/sub/b__Ventas.parquet")
    df = S.read_survey_parquet(spark, f"{tmpdir_path}/pq", "Ventas")
    assert sorted(df.columns) == sorted(["nombre_cliente", "q", "other", "_file", "_row"])
    assert df.count() == 2 and dict(df.dtypes)["q"] == "string"


def test_read_verbatims_positional(spark, tmpdir_path):
    root = f"{tmpdir_path}/v1"
    cols = ["Dealer Name", "Dealer No.", "Model", "Fuel", "Product Score", "Verbatim", "Date of Response", "VIN"]
    _write(f"{root}/a__sheet0.csv", [["T1", "1", "Ceed", "Petrol", "7", "muy bien todo gracias", "05/01/2025 10:00:00", "V"]], cols)
    _write(f"{root}/a__sheet1.csv", [["T2", "2", "Niro", "Hybrid", "n/a", "mal", "06/01/2025 10:00:00", "V"]], cols)
    sales, service = S.read_verbatims(spark, root)
    s = prepare_verbatims(sales).first()
    assert s["Taller"] == "T1" and s["Tecnología"] == "Gasolina" and s["Fecha"] == dt.date(2025, 1, 5)
    assert s["Puntuación"] == 7.0 and "VIN" not in sales.transform(prepare_verbatims).columns
    assert prepare_verbatims(service).first()["Puntuación"] is None
    empty_s, empty_v = S.read_verbatims(spark, f"{tmpdir_path}/none")
    assert empty_s.count() == 0 and prepare_verbatims(empty_s).count() == 0


def test_read_tagged(spark, tmpdir_path):
    _write(f"{tmpdir_path}/m/enero.csv", [["a"], ["b"]], ["x"])
    _write(f"{tmpdir_path}/m/febrero.csv", [["c"]], ["x"])
    df = S.read_tagged(spark, {f"{tmpdir_path}/m/enero.csv": "Enero", f"{tmpdir_path}/m/febrero.csv": "Febrero",
                               f"{tmpdir_path}/m/marzo.csv": "Marzo"})
    assert sorted((r.x, r.Mes) for r in df.collect()) == [("a", "Enero"), ("b", "Enero"), ("c", "Febrero")]
    assert S.read_tagged(spark, {f"{tmpdir_path}/m/nope.csv": "X"}) is None


def test_sinks(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a,b"), (2, 'q"x')], "id int, c string")
    assert not K.write_table(df.where("id > 5"), f"{tmpdir_path}/empty")
    assert K.write_table(df, f"{tmpdir_path}/full")
    name = K.export_name("Negativos", "Taller Uno")
    assert name == "comentarios_negativos_taller_uno.csv"
    K.export_csv(df, ["c", "id"], f"{tmpdir_path}/{name}")
    back = S.read_dim(spark, f"{tmpdir_path}/{name}", "c string, id int")
    assert sorted(r.c for r in back.collect()) == ["a,b", 'q"x']
    m = K.materialize(df.withColumn("z", F.col("id") * 2))
    assert m.count() == 2
    built = []
    store = K.embeddings_store(spark, tmpdir_path, "Servicio técnico", lambda: built.append(1) or df)
    store2 = K.embeddings_store(spark, tmpdir_path, "Servicio técnico", lambda: built.append(1) or df)
    assert store.count() == store2.count() == 2 and built == [1]


def test_read_report(spark, tmpdir_path):
    with open(f"{tmpdir_path}/informeventas.txt", "wb") as f:
        f.write("## INFORME\nPuntuación media 6,47\n".encode() + b"\xff\n")
    r = S.read_report(spark, tmpdir_path, "Ventas").collect()
    assert len(r) == 1 and r[0].value.startswith("## INFORME") and "�" in r[0].value
    assert S.read_report(spark, tmpdir_path, "Otro").count() == 0


TEXTS = ["hola\nadios", 'di ""x"" y "z"', "a,b;c", "  spaces kept ", "línea\n\notra", "back\\slash \\n", '"', "end\n"]


def test_free_text_survives_csv(spark, tmpdir_path):
    """Line breaks, quotes, commas, blanks and backslashes, through export, S1, S2, S4 and S7."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, c string")
    K.export_csv(df, ["id", "c"], f"{tmpdir_path}/x/one__Ventas.csv")
    K.export_csv(df, ["id", "c"], f"{tmpdir_path}/x/one__sheet0.csv")
    want = sorted((str(k), t) for k, t in enumerate(TEXTS))
    back = S.read_survey(spark, f"{tmpdir_path}/x", "Ventas")
    assert sorted((r.id, r.c) for r in back.collect()) == want
    assert sorted((r.id, r.c) for r in S.read_verbatims(spark, f"{tmpdir_path}/x")[0].collect()) == want
    assert sorted((r.id, r.c) for r in S.read_tagged(spark, {f"{tmpdir_path}/x/one__Ventas.csv": "m"}).collect()) == want
    assert sorted((r.id, r.c) for r in S.read_dim(spark, f"{tmpdir_path}/x/one__Ventas.csv", "id string, c string").collect()) == want


def test_read_tagged_concatenates_by_name(spark, tmpdir_path):
    _write(f"{tmpdir_path}/a/julio ñ.csv", [["T1", 7]], ["taller", "score"])
    _write(f"{tmpdir_path}/b/julio ñ.csv", [[3, "T2", "more"]], ["score", "taller", "extra"])
    df = S.read_tagged(spark, {f"{tmpdir_path}/a/julio ñ.csv": "uno", f"{tmpdir_path}/b/julio ñ.csv": "dos"}, tag="mes")
    assert {(r.taller, r.score, r.extra, r.mes) for r in df.collect()} == {("T1", "7", None, "uno"), ("T2", "3", "more", "dos")}
    for k, cols in enumerate(("x", "x, y")):
        spark.createDataFrame([(k, k)], "x int, y int").selectExpr(*cols.split(", ")).write.parquet(f"{tmpdir_path}/p{k}")
    both = S.read_tagged(spark, {f"{tmpdir_path}/p0": "p0", f"{tmpdir_path}/p1": "p1"}, fmt="parquet")
    assert {(r.x, r.y, r.Mes) for r in both.collect()} == {(0, None, "p0"), (1, 1, "p1")}


def test_row_is_input_order_over_uneven_part_files(spark, tmpdir_path):
    """Spark packs the largest part first; ``_row`` follows the files all the same."""
    rows = []
    for k, n in enumerate((2, 57, 5)):
        _write(f"{tmpdir_path}/u/book__Ventas.csv/part-{k:05d}.csv", [[f"{k}-{i:03d}"] for i in range(n)], ["v"])
        rows += [f"{k}-{i:03d}" for i in range(n)]
    _write(f"{tmpdir_path}/u/zlast__Ventas.csv", [["z"]], ["v"])
    df = S.read_survey(spark, f"{tmpdir_path}/u", "Ventas")
    assert [r.v for r in df.orderBy("_row").collect()] == [*rows, "z"]


def test_only_corrupt_extracts_are_skipped(spark, tmpdir_path, monkeypatch):
    import pytest

    spark.range(3).write.parquet(f"{tmpdir_path}/c/good__Ventas.parquet")
    with open(f"{tmpdir_path}/c/bad__Ventas.parquet", "wb") as f:
        f.write(b"not parquet at all")
    skipped = []
    assert S.read_survey(spark, f"{tmpdir_path}/c", "Ventas", fmt="parquet", skipped=skipped).count() == 3
    assert len(skipped) == 1 and "bad__Ventas" in skipped[0][0]

    def broken(*args):
        raise OSError("storage is away")

    monkeypatch.setattr(S, "_read_one", broken)
    with pytest.raises(OSError):
        S.read_survey(spark, f"{tmpdir_path}/c", "Ventas", fmt="parquet")


def test_processed_facts_and_streamed_weeks(spark, tmpdir_path):
    K.export_csv(spark.createDataFrame([(1, "x")], "id int, c string"), ["id", "c"], f"{tmpdir_path}/f")
    assert [(r.id, r.c) for r in S.read_processed(spark, f"{tmpdir_path}/f", "csv").collect()] == [("1", "x")]
