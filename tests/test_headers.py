"""Ingest by header catalogue: what it reads, and that jobs and scans do not follow the number of files."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from feedloom.sources import headers as H
from feedloom.sources import ingest as S


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def jobs_of(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def scans_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def many_books(root, n, shapes):
    for i in range(n):
        columns = [f"Col {j}" for j in range(i % shapes + 1)]
        write(f"{root}/d{i % 3}/book{i:04d}__Ventas.csv", ",".join(columns) + "\n" + ",".join(f"{i}-{j}" for j in range(len(columns))) + "\n")


def test_scans_follow_headers_and_jobs_are_fixed(spark, tmp_path):
    seen = []
    for n in (24, 300):
        many_books(f"{tmp_path}/{n}", n, 12)
        df, jobs = jobs_of(spark, lambda n=n: S.read_survey(spark, f"{tmp_path}/{n}", "Ventas"))
        assert scans_of(df) == 12
        rows = df.collect()
        assert len(rows) == n and len({r._file for r in rows}) == n
        assert all(r.col_0 == f"{int(r._file[4:8])}-0" for r in rows)
        assert sum(r.col_11 is not None for r in rows) == n // 12
        seen.append(jobs)
    # above 32 paths Spark lists files in a job of its own, one per load
    assert seen[1] <= seen[0] + 2 * (12 + 2), seen


def test_colliding_names_are_numbered_and_no_extract_is_lost(spark, tmp_path):
    write(f"{tmp_path}/a__Ventas.csv", "Email,Email ,email_2,E-mail\n1,2,3,4\n")
    write(f"{tmp_path}/b__Ventas.csv", "email\n5\n")
    skipped = []
    rows = {r._file: r for r in S.read_survey(spark, str(tmp_path), "Ventas", skipped=skipped).collect()}
    assert (rows["a__Ventas.csv"].email, rows["a__Ventas.csv"].email_3, rows["a__Ventas.csv"].email_2, rows["b__Ventas.csv"].email) == ("1", "2", "3", "5")
    assert skipped == []
    spark.createDataFrame([(1, 2)], "Email int, `Email ` int").write.parquet(f"{tmp_path}/c__Posventa.parquet")
    row = S.read_survey(spark, str(tmp_path), "Posventa", fmt="parquet", skipped=skipped).first()
    assert (row.email, row.email_2) == ("1", "2") and skipped == []


def test_limits_of_operators_are_raised(spark, tmp_path, monkeypatch):
    """An extract is skipped for being corrupt, not because a limit of the library says no."""
    spark.createDataFrame([(1,)], "Q1 int").write.parquet(f"{tmp_path}/c__Ventas.parquet")
    spark.createDataFrame([("Q1", "Nota"), ("Q2", "Otra")], "`Display ID` string, Questionnaire string").write.parquet(f"{tmp_path}/c__Questionnaire.parquet")
    from feedloom.operators import columns

    monkeypatch.setattr(columns, "MAX_NAME_ROWS", 1)
    with pytest.raises(ValueError):
        S.read_survey(spark, str(tmp_path), "Ventas", fmt="parquet")
    many_books(f"{tmp_path}/many", 3, 3)
    monkeypatch.setattr(H, "MAX_HEADERS", 2)
    with pytest.raises(ValueError):
        S.read_survey(spark, f"{tmp_path}/many", "Ventas")


def test_headers_as_written(spark, tmp_path):
    """Line breaks and quotes in names, a byte order mark, blank lines first, unnamed and repeated columns, empty files."""
    write(f"{tmp_path}/a__sheet0.csv", '﻿"uno","dos\nlíneas","tres ""3"""\n1,"2\n2",3\n')
    write(f"{tmp_path}/b__sheet0.csv", "\n\ndos,,dos\n4,5,6\n7\n")
    write(f"{tmp_path}/c__sheet0.csv", "")
    write(f"{tmp_path}/d__sheet0.csv", "uno\n")
    write(f"{tmp_path}/año+1%20__sheet0.csv", "uno\n8\n")
    df, empty = S.read_verbatims(spark, str(tmp_path))
    assert empty.columns == []
    rows = sorted(({k: v for k, v in r.asDict().items() if v is not None} for r in df.collect()), key=repr)
    assert rows == sorted([{"uno": "1", "dos\nlíneas": "2\n2", 'tres "3"': "3"}, {"dos": "4", "_c1": "5", "dos_2": "6"}, {"dos": "7"}, {"uno": "8"}], key=repr)


def test_question_sheets_that_differ_share_one_scan(spark, tmp_path):
    for i in range(6):
        write(f"{tmp_path}/b{i}__Ventas.csv", f"Q1,Q2,Nota\n{i},x,y\n")
        if i % 3:
            write(f"{tmp_path}/b{i}__Questionnaire.csv", 'Questionnaire,Display ID\nviejo,Q1\n{},Q1\n,Q2\n'.format("Nota" if i % 3 == 1 else '"¿Volvería,\n""seguro""?"'))
    df = S.read_survey(spark, str(tmp_path), "Ventas")
    rows = {r._file: r.asDict() for r in df.collect()}
    assert scans_of(df) == 1
    assert rows["b0__Ventas.csv"]["q1"] == "0" and rows["b0__Ventas.csv"]["nota"] == "y"
    assert rows["b1__Ventas.csv"]["nota"] == "1" and rows["b1__Ventas.csv"]["nota_2"] == "y" and rows["b1__Ventas.csv"]["q1"] is None
    assert rows["b5__Ventas.csv"]['¿volvería,\n"seguro"?'] == "5" and rows["b5__Ventas.csv"]["q2"] == "x"


def test_tag_reaches_its_own_extract_and_replaces_a_column(spark, tmp_path):
    for i in range(40):
        write(f"{tmp_path}/m{i}/datos.csv", "x,Mes\n{},viejo\n".format(i) if i % 2 else "Mes,x\nviejo,{}\n".format(i))
    files = {f"{tmp_path}/m{i}/datos.csv": f"mes {i}" for i in range(40)} | {f"{tmp_path}/falta.csv": "nunca"}
    df = S.read_tagged(spark, files)
    assert sorted(df.columns) == ["Mes", "x"] and scans_of(df) == 2
    assert {(r.x, r.Mes) for r in df.collect()} == {(str(i), f"mes {i}") for i in range(40)}


def test_row_order_across_files(spark, tmp_path):
    for i in range(30):
        write(f"{tmp_path}/b{i:02d}__Ventas.csv", ("v,w\n" if i % 2 else "w,v\n") + "".join(f"{i:02d}-{j},{i:02d}-{j}\n" for j in range(3)))
    df = S.read_survey(spark, str(tmp_path), "Ventas")
    assert [r.v for r in df.orderBy("_row").collect()] == [f"{i:02d}-{j}" for i in range(30) for j in range(3)]
    assert df.select(F.count_distinct("_row")).first()[0] == 90
