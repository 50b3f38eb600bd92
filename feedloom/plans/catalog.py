"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus DuckDB oracle SQL.

Every query reads whole driver tables through the fixture views in
``plans.fixtures``; output columns are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import clean as CL
from feedloom.functions import text as TX
from feedloom.operators import cleaning as C
from feedloom.operators import columns as P
from feedloom.operators import dedup as D
from feedloom.operators import enrich as J
from feedloom.operators import findings as FD
from feedloom.operators import filters as FL
from feedloom.operators import metrics as M
from feedloom.operators import report as R
from feedloom.operators import retrieval as RT
from feedloom.plans import fixtures as X
from feedloom.plans.preparation import prepare_verbatims

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


VT, VF = X.VT_SQL, X.VF_SQL
RND = "round_even({x}, 2)"


def r2(x: str) -> str:
    return RND.format(x=x)


# ======================================================= dashboard (A*) ====
@register("matrix_dealer", X.with_views(f"""
SELECT dealer, count(comment) AS n_comments, {r2('avg(score)')} AS mean_score
FROM vf WHERE dealer IS NOT NULL GROUP BY dealer HAVING avg(score) IS NOT NULL""", VF))
def q_matrix_dealer(spark, sf):
    return M.group_matrix(X.facts(spark, sf), "dealer", rounded=True)


@register("matrix_model", X.with_views(f"""
SELECT model, count(comment) AS n_comments, avg(score) AS mean_score
FROM vts WHERE model IS NOT NULL GROUP BY model HAVING avg(score) IS NOT NULL""", VT))
def q_matrix_model(spark, sf):
    return M.group_matrix(X.verbatims(spark, sf), "model")


@register("matrix_model_rounded", X.with_views(f"""
SELECT model, count(comment) AS n_comments, {r2('avg(score)')} AS mean_score
FROM vf WHERE model IS NOT NULL GROUP BY model HAVING avg(score) IS NOT NULL""", VF))
def q_matrix_model_rounded(spark, sf):
    return M.group_matrix(X.facts(spark, sf), "model", rounded=True)


@register("weekly_counts", """
SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n_comments
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def q_weekly_counts(spark, sf):
    return M.weekly_counts(X.table(spark, sf, "events"), "ts")


@register("weekly_counts_verbatims", X.with_views("""
SELECT CAST(date_trunc('week', dt) AS DATE) AS week, count(*) AS n_comments
FROM vts WHERE dt IS NOT NULL GROUP BY 1""", VT))
def q_weekly_counts_vt(spark, sf):
    return M.weekly_counts(X.verbatims(spark, sf), "dt")


@register("max_weekly_count", """
SELECT max(n) AS max_n_comments FROM (
  SELECT count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY CAST(date_trunc('week', ts) AS DATE))""")
def q_max_weekly(spark, sf):
    return M.max_count(M.weekly_counts(X.table(spark, sf, "events"), "ts"))


@register("date_range", X.with_views("SELECT min(dt) AS first_date, max(dt) AS last_date FROM vf", VF))
def q_date_range(spark, sf):
    return M.date_range(X.facts(spark, sf), "dt")


@register("weekly_filled", X.with_views("""
, rng AS (SELECT CAST(date_trunc('week', min(dt)) AS DATE) AS lo, CAST(date_trunc('week', max(dt)) AS DATE) AS hi FROM vf),
dealers AS (SELECT DISTINCT dealer FROM vf WHERE dealer IS NOT NULL),
spine AS (SELECT dealer, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week FROM dealers, rng),
cnt AS (SELECT dealer, CAST(date_trunc('week', dt) AS DATE) AS week, count(*) AS n
        FROM vf WHERE dealer IS NOT NULL AND dt IS NOT NULL GROUP BY 1, 2)
SELECT s.dealer, s.week, coalesce(c.n, 0) AS n_comments
FROM spine s LEFT JOIN cnt c ON s.dealer = c.dealer AND s.week = c.week""", VF).replace("\n\n,", "\n,"))
def q_weekly_filled(spark, sf):
    return M.weekly_counts_filled(X.facts(spark, sf), "dealer", "dt")


@register("mean_technology", X.with_views(f"""
SELECT technology, {r2('avg(score)')} AS mean_score FROM vts WHERE technology IS NOT NULL GROUP BY technology""", VT))
def q_mean_technology(spark, sf):
    return M.mean_score(X.verbatims(spark, sf), "technology", rounded=True)


@register("mean_model", X.with_views("""
SELECT model, avg(score) AS mean_score FROM vf WHERE model IS NOT NULL GROUP BY model""", VF))
def q_mean_model(spark, sf):
    return M.mean_score(X.facts(spark, sf), "model")


@register("count_technology", X.with_views("""
SELECT technology, count(*) AS n FROM vts WHERE technology IS NOT NULL GROUP BY technology""", VT))
def q_count_technology(spark, sf):
    return M.count_by(X.verbatims(spark, sf), "technology")


@register("count_model", X.with_views("""
SELECT model, count(*) AS n FROM vf WHERE model IS NOT NULL GROUP BY model""", VF))
def q_count_model(spark, sf):
    return M.count_by(X.facts(spark, sf), "model")


_MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in M.MONTHS_ES) + "]"


@register("count_month", X.with_views(f"""
SELECT list_element({_MONTHS_SQL}, month(dt)) AS mes, count(*) AS n FROM vts WHERE dt IS NOT NULL GROUP BY 1""", VT))
def q_count_month(spark, sf):
    vt = X.verbatims(spark, sf).withColumn("mes", M.month_tag("dt"))
    return M.count_by(vt, "mes", sort="key")


@register("distinct_values", X.with_views("""
SELECT DISTINCT dim, value FROM (
  SELECT 'dealer' AS dim, dealer AS value FROM vts UNION ALL
  SELECT 'model', model FROM vts UNION ALL
  SELECT 'technology', technology FROM vts) WHERE value IS NOT NULL""", VT))
def q_distinct_values(spark, sf):
    return M.distinct_values(X.verbatims(spark, sf), ["dealer", "model", "technology"])


_TECH_SQL = "[" + ", ".join(f"'{t}'" for t in M.TECHNOLOGIES) + "]"


@register("dealer_vs_all_technology", X.with_views(f"""
, dealers AS (SELECT DISTINCT dealer FROM vts WHERE dealer IS NOT NULL),
grid AS (SELECT dealer, unnest({_TECH_SQL}) AS technology FROM dealers),
own AS (SELECT dealer, technology, avg(score) AS m, count(score) AS n FROM vts WHERE dealer IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT technology, avg(score) AS m, count(score) AS n FROM vts GROUP BY 1)
SELECT g.dealer, g.technology, coalesce({r2('o.m')}, 0.0) AS dealer_mean, coalesce(o.n, 0) AS dealer_n,
       coalesce({r2('t.m')}, 0.0) AS overall_mean, coalesce(t.n, 0) AS overall_n
FROM grid g LEFT JOIN own o ON g.dealer = o.dealer AND g.technology = o.technology
LEFT JOIN tot t ON g.technology = t.technology""", VT))
def q_dealer_vs_all_technology(spark, sf):
    return M.compare_technology(X.verbatims(spark, sf))


@register("dealer_vs_rest_model", X.with_views(f"""
, pairs AS (SELECT DISTINCT dealer, model FROM vf WHERE dealer IS NOT NULL AND model IS NOT NULL)
SELECT p.dealer, p.model,
  coalesce({r2('(SELECT avg(score) FROM vf f WHERE f.model = p.model AND f.dealer = p.dealer)')}, 0.0) AS dealer_mean,
  (SELECT count(score) FROM vf f WHERE f.model = p.model AND f.dealer = p.dealer) AS dealer_n,
  (SELECT count(score) FROM vf f WHERE f.model = p.model AND (f.dealer IS NULL OR f.dealer <> p.dealer)) AS rest_n,
  coalesce({r2('(SELECT avg(score) FROM vf f WHERE f.model = p.model AND (f.dealer IS NULL OR f.dealer <> p.dealer))')}, 0.0) AS rest_mean
FROM pairs p""", VF))
def q_dealer_vs_rest_model(spark, sf):
    return M.compare_model(X.facts(spark, sf))


@register("individual_matrix", X.with_views("""
SELECT id, score, model, comment FROM vts
WHERE len(list_filter(regexp_split_to_array(coalesce(comment, ''), '\\s+'), lambda x: x <> '')) > 3""", VT))
def q_individual_matrix(spark, sf):
    return M.individual_matrix(X.verbatims(spark, sf))


# ===================================================== cleaning (C*, P*) ====

CT = X.CONTACTS_SQL


def _sql_list(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


_WS = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_SUFFIX_SQL = " OR ".join(f"suffix(email, '{s}')" for s in CL.EMAIL_FAKE_SUFFIXES)


@register("clean_email", X.with_views(f"""
, e AS (SELECT id, lower({_WS.format(x='email')}) AS email FROM contacts)
SELECT id, email FROM e
WHERE email IS NOT NULL AND length(email) > 0
  AND regexp_matches(email, '^[\\w\\.-]+@[\\w\\.-]+\\.\\w{{2,}}$')
  AND NOT regexp_matches(email, '{CL.EMAIL_BAD_START}')
  AND NOT ({_SUFFIX_SQL})
  AND email NOT IN {_sql_list(CL.EMAIL_FAKE_EXACT)}""", CT))
def q_clean_email(spark, sf):
    return C.clean_email(X.contacts(spark, sf), "email").select("id", "email")


@register("clean_phone", X.with_views(f"""
, d AS (SELECT id, regexp_replace(telefono, '[^0-9]', '', 'g') AS t FROM contacts),
p AS (SELECT id, CASE WHEN starts_with(t, '0034') THEN substr(t, 5) WHEN starts_with(t, '34') THEN substr(t, 3) ELSE t END AS telefono FROM d)
SELECT id, telefono FROM p
WHERE length(telefono) = 9 AND regexp_matches(telefono, '^[0-9]{{9}}$')
  AND NOT regexp_matches(telefono, '{CL.PHONE_FAKE_PREFIX}')
  AND telefono NOT IN {_sql_list(CL.PHONE_PLACEHOLDERS)}""", CT))
def q_clean_phone(spark, sf):
    return C.clean_phone_es(X.contacts(spark, sf), "telefono").select("id", "telefono")


@register("dash_to_null", X.with_views(f"""
SELECT id, CASE WHEN {_WS.format(x='marca')} = '-' THEN NULL ELSE marca END AS marca FROM contacts""", CT))
def q_dash_to_null(spark, sf):
    return C.dash_to_null(X.contacts(spark, sf).select("id", "marca"))


def _yes_no_sql(c: str) -> str:
    v = f"lower({_WS.format(x=c)})"
    return (f"CASE WHEN {v} IN {_sql_list(CL.YES_VALUES)} THEN true "
            f"WHEN {v} IN {_sql_list(CL.NO_VALUES)} THEN false END AS {c}")


@register("infer_bool", X.with_views(
    "SELECT id, " + ", ".join(_yes_no_sql(c) if c in X.YESNO_BOOLEAN else c for c in X.YESNO_CASES)
    + " FROM contacts", CT))
def q_infer_bool(spark, sf):
    return C.infer_bool(X.contacts(spark, sf).select("id", *X.YESNO_CASES), list(X.YESNO_CASES))


@register("duration_seconds", X.with_views("""
, t AS (SELECT id, coalesce(trim(tiempo_empleado), '') AS t FROM contacts)
SELECT id, CAST(coalesce(TRY_CAST(nullif(regexp_extract(t, '(\\d+)m', 1), '') AS BIGINT), 0) * 60
              + coalesce(TRY_CAST(nullif(regexp_extract(t, '(\\d+)s', 1), '') AS BIGINT), 0) AS BIGINT) AS tiempo_empleado
FROM t""", CT))
def q_duration_seconds(spark, sf):
    return C.duration_to_seconds(X.contacts(spark, sf).select("id", "tiempo_empleado"))


@register("parse_dates", X.with_views("""
, p AS (SELECT id, try_strptime(respondido, '%d/%m/%Y %H:%M:%S') AS respondido,
               CAST(try_strptime(enviado, '%d/%m/%Y') AS DATE) AS enviado FROM contacts)
SELECT id, respondido, enviado, CAST(respondido AS DATE) AS respondido_fecha,
       strftime(respondido, '%H:%M:%S') AS respondido_hora FROM p""", CT))
def q_parse_dates(spark, sf):
    df = X.contacts(spark, sf).select("id", "respondido", "enviado")
    return P.split_datetime(C.parse_dates(df), "respondido")


@register("to_number", X.with_views("""
SELECT id, CASE WHEN regexp_matches(trim(puntuacion), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$')
                THEN TRY_CAST(trim(puntuacion) AS DOUBLE) END AS puntuacion FROM contacts""", CT))
def q_to_number(spark, sf):
    return C.coerce_number(X.contacts(spark, sf).select("id", "puntuacion"), "puntuacion")


@register("zfill5", X.with_views("""
SELECT id, CASE WHEN length(codigo_postal) < 5 THEN lpad(codigo_postal, 5, '0') ELSE codigo_postal END AS codigo_postal
FROM contacts""", CT))
def q_zfill5(spark, sf):
    return C.pad_postal_code(X.contacts(spark, sf).select("id", "codigo_postal"), "codigo_postal")


_FUEL_RAW_SQL = ("CASE WHEN id % 10 = 0 THEN 'LPG' WHEN lang = 'en' THEN 'Petrol' WHEN lang = 'fr' THEN 'Hybrid' "
                 "WHEN lang = 'de' THEN 'Diesel' ELSE 'Electric' END")


def _fuel_raw():
    return (F.when(F.col("id") % 10 == 0, "LPG").when(F.col("lang") == "en", "Petrol")
            .when(F.col("lang") == "fr", "Hybrid").when(F.col("lang") == "de", "Diesel").otherwise("Electric"))


_FUEL_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.FUEL_NAMES.items())


@register("recode", X.with_views(f"""
, r AS (SELECT id, {_FUEL_RAW_SQL} AS fuel FROM vt)
SELECT id, CASE fuel {_FUEL_CASE} ELSE fuel END AS technology FROM r""", VT))
def q_recode(spark, sf):
    df = X.verbatims(spark, sf).select("id", _fuel_raw().alias("fuel"))
    return C.recode_values(df, "fuel", out="technology").select("id", "technology")


@register("to_datetime", X.with_views("""
SELECT id, CAST(dt AS TIMESTAMP) AS ts FROM vt""", VT))
def q_to_datetime(spark, sf):
    return C.to_datetime(X.verbatims(spark, sf).select("id", F.col("dt").alias("ts")), "ts")


# ========================================================= filters (C1x) ====
_WORDS = "len(list_filter(regexp_split_to_array(coalesce(comment, ''), '\\s+'), lambda x: x <> ''))"


@register("min_words", X.with_views(f"SELECT id, dealer FROM vts WHERE {_WORDS} > 3", VT))
def q_min_words(spark, sf):
    return FL.min_words(X.verbatims(spark, sf), "comment", 3).select("id", "dealer")


@register("negative_verbatims", X.with_views(f"""
SELECT id, dt, model, dealer, score, comment FROM vts WHERE score <= 5 AND {_WORDS} > 3""", VT))
def q_negative(spark, sf):
    return FL.polarity(X.verbatims(spark, sf), "negative").select("id", "dt", "model", "dealer", "score", "comment")


@register("positive_verbatims", X.with_views(f"""
SELECT id, dt, model, dealer, score, comment FROM vts WHERE score >= 8 AND {_WORDS} > 3""", VT))
def q_positive(spark, sf):
    return FL.polarity(X.verbatims(spark, sf), "positive").select("id", "dt", "model", "dealer", "score", "comment")


@register("segment_filter", X.with_views("""
SELECT id, dealer, model, technology, score FROM vts WHERE technology = 'Eléctrico'""", VT))
def q_segment(spark, sf):
    df = FL.segment(X.verbatims(spark, sf), "dealer", FL.ALL)
    return FL.segment(df, "technology", "Eléctrico").select("id", "dealer", "model", "technology", "score")


@register("service_facts", X.with_views("""
SELECT id, service, technology FROM vts WHERE service = 'Ventas' AND model IS NOT NULL""", VT))
def q_service(spark, sf):
    df = FL.not_null(FL.service_facts(X.verbatims(spark, sf), "Ventas"), "model")
    return df.select("id", "service", "technology")


# ===================================================== dedup + union ====


@register("distinct_rows", X.with_views("SELECT DISTINCT dt, dealer, score, comment FROM vts", VT))
def q_distinct_rows(spark, sf):
    return D.distinct_rows(X.verbatims(spark, sf), ["dt", "dealer", "score", "comment"])


@register("union_diagonal", X.with_views("""
SELECT id, dealer, score_raw FROM vt WHERE service = 'Ventas'
UNION ALL BY NAME
SELECT id, model, length(comment) AS n_chars FROM vt WHERE service = 'Posventa'""", VT))
def q_union(spark, sf):
    from feedloom.sources.ingest import union_diagonal

    vt = X.verbatims(spark, sf)
    a = vt.where(F.col("service") == "Ventas").select("id", "dealer", "score_raw")
    b = vt.where(F.col("service") == "Posventa").select("id", "model", F.length("comment").alias("n_chars"))
    return union_diagonal([a, b])


_SIM_SQL = " + ".join(f"coalesce(CAST(y.a{i} = x[1].a{i} AS INTEGER), 0)" for i in range(1, 6))


@register("near_duplicates", X.with_views(f"""
, g AS (SELECT k1, k2, list(struct_pack(id := id, a1 := a1, a2 := a2, a3 := a3, a4 := a4, a5 := a5) ORDER BY id) AS l
        FROM survey GROUP BY k1, k2),
k AS (SELECT k1, k2, unnest(list_reduce(list_transform(l, lambda x: [x]),
        lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: ({_SIM_SQL}) >= 4)) > 0 THEN acc
                            ELSE list_concat(acc, x) END)) AS r FROM g)
SELECT r.id AS id, k1, k2, r.a1 AS a1, r.a2 AS a2, r.a3 AS a3, r.a4 AS a4, r.a5 AS a5 FROM k""", X.SURVEY_SQL))
def q_near_duplicates(spark, sf):
    return D.drop_near_duplicates(X.survey(spark, sf), keys=("k1", "k2"), order="id", threshold=4)


@register("near_duplicates_blocked", ORACLE["near_duplicates"])
def q_near_duplicates_blocked(spark, sf):
    """The same with windows of a few rows, so that it takes several rounds."""
    return D.drop_near_duplicates(X.survey(spark, sf), keys=("k1", "k2"), order="id", threshold=4, bucket_window=32)


# Forty comparable columns over the customers: few-valued answers and some varied ones.
_WIDE = {f"w{i}": (2 + i % 3 if i < 30 else 40 + i) for i in range(40)}
_WIDE_SIM = " + ".join(f"coalesce(CAST(x[1].{c} = y.{c} AS INTEGER), 0)" for c in _WIDE)


def _wide(spark, sf):
    k = F.col("c_custkey")
    base = F.floor(k / 3)  # neighbours share most answers
    cells = [F.when((k + i) % 17 != 0, F.when((k * (i + 1)) % 11 == 0, k % m).otherwise(base % m)).alias(c) for i, (c, m) in enumerate(_WIDE.items())]
    names = [F.when(k % 3 == 0, F.col("c_mktsegment")).alias("k1"), (F.col("c_nationkey") % 2).cast("string").alias("k2")]
    return X.table(spark, sf, "customer").select(k.alias("id"), *names, *cells)


_WIDE_CELLS = ", ".join(
    f"CASE WHEN (k + {i}) % 17 <> 0 THEN CASE WHEN (k * {i + 1}) % 11 = 0 THEN k % {m} ELSE (k // 3) % {m} END END AS {c}" for i, (c, m) in enumerate(_WIDE.items()))


@register("near_duplicates_wide", f"""
WITH wide AS (SELECT k AS id, CASE WHEN k % 3 = 0 THEN c_mktsegment END AS k1, CAST(c_nationkey % 2 AS VARCHAR) AS k2, {_WIDE_CELLS}
              FROM (SELECT c_custkey AS k, * FROM customer)),
g AS (SELECT k1, k2, list(struct_pack(id := id, k1 := k1, k2 := k2, {', '.join(f'{c} := {c}' for c in _WIDE)}) ORDER BY id) AS l FROM wide GROUP BY k1, k2),
k AS (SELECT unnest(list_reduce(list_transform(l, lambda x: [x]),
        lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: ({_WIDE_SIM}) >= 30)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS r FROM g)
SELECT r.id AS id, r.k1 AS k1, r.k2 AS k2, r.w0 AS w0, r.w39 AS w39 FROM k""")
def q_near_duplicates_wide(spark, sf):
    """D1 at its default threshold over forty columns, with a group of two thirds of the rows."""
    return D.drop_near_duplicates(_wide(spark, sf), keys=("k1", "k2"), order="id").select("id", "k1", "k2", "w0", "w39")


# ================================================================ joins ====


@register("enrich_technology", X.with_views("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, vf.model AS modelo, t.tecnologia
FROM vf LEFT JOIN tech_dim t ON vf.model = t.model""", VF, X.TECH_SQL))
def q_enrich_technology(spark, sf):
    f = X.facts(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("model").alias("modelo"))
    dim = X.technology_dim(spark, sf).withColumnRenamed("model", "modelo")
    return J.enrich_technology(f, dim, "modelo")


_IP_PARSE_SQL = """CASE WHEN regexp_matches(trim(ip), '^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$')
   AND CAST(split_part(trim(ip), '.', 1) AS BIGINT) <= 255 AND CAST(split_part(trim(ip), '.', 2) AS BIGINT) <= 255
   AND CAST(split_part(trim(ip), '.', 3) AS BIGINT) <= 255 AND CAST(split_part(trim(ip), '.', 4) AS BIGINT) <= 255
  THEN CAST(split_part(trim(ip), '.', 1) AS BIGINT) * 16777216 + CAST(split_part(trim(ip), '.', 2) AS BIGINT) * 65536
     + CAST(split_part(trim(ip), '.', 3) AS BIGINT) * 256 + CAST(split_part(trim(ip), '.', 4) AS BIGINT) END"""

_GEO_SQL = f"""
, ipn AS (SELECT ip, n FROM (SELECT DISTINCT ip, {_IP_PARSE_SQL} AS n FROM event_ips WHERE ip IS NOT NULL) WHERE n IS NOT NULL),
geo AS (SELECT i.ip, c.country_name AS ip_country_name, c.region AS ip_region, c.city AS ip_city,
               c.postal_code AS ip_postal_code, c.latitude AS ip_latitude, c.longitude AS ip_longitude
        FROM ipn i JOIN city_ranges c ON i.n BETWEEN c.ip_lo AND c.ip_hi
        WHERE EXISTS (SELECT 1 FROM asn_ranges a WHERE i.n BETWEEN a.ip_lo AND a.ip_hi)),
enriched AS (SELECT e.event_id, e.ip, g.ip_country_name, g.ip_region, g.ip_city, g.ip_postal_code,
                    g.ip_latitude, g.ip_longitude FROM event_ips e LEFT JOIN geo g ON e.ip = g.ip)"""


@register("enrich_ip", X.with_views(_GEO_SQL + "\nSELECT * FROM enriched", X.IP_SQL))
def q_enrich_ip(spark, sf):
    return J.enrich_ip(X.event_ips(spark, sf), X.city_ranges(spark, sf), X.asn_ranges(spark, sf))


@register("enrich_ip_dense", """
WITH e AS (SELECT event_id, user_id % 256 AS u, event_id % 200 AS b FROM events),
i AS (SELECT event_id, u, b, event_id % 9 AS kind FROM e)
SELECT event_id,
  CASE kind WHEN 0 THEN NULL WHEN 1 THEN '010.1.' || b || '.' || u WHEN 2 THEN ' 10.1.' || b || '.' || u WHEN 3 THEN '2001:db8::' || lower(to_hex(b * 256 + u))
            WHEN 4 THEN '2001:0DB8:0:0::' || upper(to_hex(b * 256 + u)) ELSE '10.1.' || b || '.' || u END AS ip,
  CASE WHEN kind IN (3, 4) AND u < 128 THEN 'v6-' || b WHEN kind > 4 AND b < 150 AND u % 8 < 6 THEN 'v4-' || b || '-' || (u // 8) WHEN kind > 4 AND b BETWEEN 140 AND 180 THEN 'wide' END AS ip_city
FROM i""")
def q_enrich_ip_dense(spark, sf):
    """J2 with thousands of ranges inside one /16 under a wide one, IPv6 ranges, and texts that are no address."""
    k, n = F.col("id"), lambda c: c.cast("string")
    four = spark.range(150 * 32).select(
        F.concat(F.lit("10.1."), n(F.floor(k / 32)), F.lit("."), n(k % 32 * 8)).alias("ip_lo"),
        F.concat(F.lit("10.1."), n(F.floor(k / 32)), F.lit("."), n(k % 32 * 8 + 5)).alias("ip_hi"), F.concat(F.lit("v4-"), n(F.floor(k / 32)), F.lit("-"), n(k % 32)).alias("city"))
    six = spark.range(200).select(
        F.concat(F.lit("2001:db8::"), F.hex(k * 256)).alias("ip_lo"), F.concat(F.lit("2001:db8::"), F.hex(k * 256 + 127)).alias("ip_hi"), F.concat(F.lit("v6-"), n(k)).alias("city"))
    wide = spark.range(1).select(F.lit("10.1.140.0").alias("ip_lo"), F.lit("10.1.180.255").alias("ip_hi"), F.lit("wide").alias("city"))
    asn = spark.createDataFrame([("10.0.0.0", "10.255.255.255"), ("2001:db8::", "2001:db8::ffff:ffff")], "ip_lo string, ip_hi string")
    b, u, kind = F.col("event_id") % 200, F.col("user_id") % 256, F.col("event_id") % 9
    text = F.concat(F.lit("10.1."), n(b), F.lit("."), n(u))
    ip = (F.when(kind == 0, None).when(kind == 1, F.concat(F.lit("0"), text)).when(kind == 2, F.concat(F.lit(" "), text))
          .when(kind == 3, F.concat(F.lit("2001:db8::"), F.lower(F.hex(b * 256 + u)))).when(kind == 4, F.concat(F.lit("2001:0DB8:0:0::"), F.hex(b * 256 + u))).otherwise(text))
    events = X.table(spark, sf, "events").select("event_id", ip.alias("ip"))
    return J.enrich_ip(events, four.unionByName(six).unionByName(wide), asn).select("event_id", "ip", "ip_city")


@register("enrich_income", X.with_views(_GEO_SQL + """
SELECT e.event_id, e.ip, e.ip_postal_code, d.renta_media FROM enriched e
LEFT JOIN (SELECT CASE WHEN length(codigo_postal) < 5 THEN lpad(codigo_postal, 5, '0') ELSE codigo_postal END AS pc,
                  renta_media FROM income_dim) d ON e.ip_postal_code = d.pc""", X.IP_SQL, X.INCOME_SQL))
def q_enrich_income(spark, sf):
    geo = J.enrich_ip(X.event_ips(spark, sf), X.city_ranges(spark, sf), X.asn_ranges(spark, sf))
    out = J.enrich_income(geo, X.income_dim(spark, sf))
    return out.select("event_id", "ip", "ip_postal_code", "renta_media")


# ============================================================== report ====

# Fixture themes: the waiting/staff themes of the feedback reports, plus two
# word lists that occur in the synthetic prose so the counts are not all zero.
THEMES = {
    "espera": ["espera", "demora", "tardanza", "retraso"],
    "trato": ["trato", "amable", "atencion"],
    "articles_en": ["the", "a", "an"],
    "articles_romance": ["la", "le", "les", "el"],
}

_FOLD = f"translate(lower({{x}}), '{TX.ACCENTED}', '{TX.PLAIN}')"


def _mention_sql(terms) -> str:
    forms = ", ".join(f"'{t}{end}'" for t in terms for end in ("", "s", "es"))
    return f"coalesce(list_has_any(regexp_split_to_array({_FOLD.format(x='comment')}, '[^a-z0-9]+'), [{forms}]), false)"


def _pct(num: str, den: str) -> str:
    return f"{r2(f'CAST({num} AS DOUBLE) * CAST(100 AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0)')}"


@register("report_header", X.with_views("""
SELECT count(*) AS n, min(dt) AS first_date, max(dt) AS last_date,
       count(DISTINCT strftime(dt, '%Y-%m')) AS n_months,
       array_to_string(list_sort(list_distinct(list(strftime(dt, '%Y-%m')))), ', ') AS months
FROM vts""", VT))
def q_report_header(spark, sf):
    return R.report_header(X.verbatims(spark, sf))


_BREAKDOWN_SQL = f"""
, pairs AS (
  SELECT 'technology' AS dim, technology AS value, score FROM vts UNION ALL
  SELECT 'model', model, score FROM vts UNION ALL
  SELECT 'dealer', dealer, score FROM vts UNION ALL
  SELECT 'ALL', 'ALL', score FROM vts),
b AS (SELECT dim, value, count(*) AS n, {_pct('count(*)', '(SELECT count(*) FROM vts)')} AS share_pct,
             {r2('avg(score)')} AS mean_score, avg(score) AS m FROM pairs GROUP BY dim, value)"""


@register("report_breakdown", X.with_views(_BREAKDOWN_SQL + "\nSELECT dim, value, n, share_pct, mean_score FROM b", VT))
def q_report_breakdown(spark, sf):
    return R.breakdown(X.verbatims(spark, sf)).drop("_mean")


@register("report_critical", X.with_views(_BREAKDOWN_SQL + """
SELECT dim, value, n, share_pct, mean_score FROM b WHERE dim <> 'ALL' AND value IS NOT NULL AND m < 5""", VT))
def q_report_critical(spark, sf):
    return R.critical(X.verbatims(spark, sf))


@register("report_best", X.with_views(_BREAKDOWN_SQL + """
SELECT dim, value, n, share_pct, mean_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dim ORDER BY m DESC, n DESC, value) AS rank
  FROM b WHERE dim <> 'ALL' AND value IS NOT NULL AND m IS NOT NULL AND n >= 1) WHERE rank <= 3""", VT))
def q_report_best(spark, sf):
    return R.best(X.verbatims(spark, sf))


@register("report_monthly", X.with_views(f"""
SELECT CAST(date_trunc('month', dt) AS DATE) AS month, count(*) AS n, {r2('avg(score)')} AS mean_score
FROM vts WHERE dt IS NOT NULL GROUP BY 1""", VT))
def q_report_monthly(spark, sf):
    return R.monthly(X.verbatims(spark, sf))


@register("report_gaps", X.with_views("""
, rng AS (SELECT CAST(date_trunc('month', min(dt)) AS DATE) AS lo, CAST(date_trunc('month', max(dt)) AS DATE) AS hi FROM vf),
ents AS (SELECT DISTINCT dealer FROM vf WHERE dealer IS NOT NULL),
spine AS (SELECT dealer, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM ents, rng),
seen AS (SELECT DISTINCT dealer, CAST(date_trunc('month', dt) AS DATE) AS month FROM vf WHERE dealer IS NOT NULL AND dt IS NOT NULL)
SELECT s.dealer, s.month FROM spine s ANTI JOIN seen USING (dealer, month)""", VF))
def q_report_gaps(spark, sf):
    return R.coverage_gaps(X.facts(spark, sf), "dealer", "dt")


def _theme_sql() -> str:
    parts = []
    for name, terms in THEMES.items():
        hit = _mention_sql(terms)
        parts.append(f"""SELECT '{name}' AS theme, CAST(coalesce(sum(CAST({hit} AS INTEGER)), 0) AS BIGINT) AS n_mentions,
  {_pct(f'sum(CAST({hit} AS INTEGER))', 'count(*)')} AS share_pct,
  {r2(f'avg(CASE WHEN {hit} THEN score END)')} AS mean_score FROM vts""")
    return "\nUNION ALL\n".join(parts)


@register("report_theme", X.with_views(_theme_sql(), VT))
def q_report_theme(spark, sf):
    return R.theme(X.verbatims(spark, sf), THEMES)


def _contrast_sql() -> str:
    parts = []
    for name, terms in THEMES.items():
        hit = _mention_sql(terms)
        lo, hi = "score <= 4", "score >= 7"
        nl, nh = f"sum(CAST({lo} AS INTEGER))", f"sum(CAST({hi} AS INTEGER))"
        ml, mh = f"sum(CAST({hit} AND {lo} AS INTEGER))", f"sum(CAST({hit} AND {hi} AS INTEGER))"
        parts.append(f"""SELECT '{name}' AS theme, CAST(coalesce({nl}, 0) AS BIGINT) AS n_low,
  CAST(coalesce({ml}, 0) AS BIGINT) AS mentions_low, {_pct(ml, nl)} AS share_low_pct,
  CAST(coalesce({nh}, 0) AS BIGINT) AS n_high, CAST(coalesce({mh}, 0) AS BIGINT) AS mentions_high,
  {_pct(mh, nh)} AS share_high_pct FROM vts""")
    return "\nUNION ALL\n".join(parts)


@register("report_theme_contrast", X.with_views(_contrast_sql(), VT))
def q_report_theme_contrast(spark, sf):
    return R.theme_contrast(X.verbatims(spark, sf), THEMES)


def _dealer_theme_sql() -> str:
    parts = []
    for name, terms in THEMES.items():
        hit = _mention_sql(terms)
        low, top = "dealer IN (SELECT dealer FROM low)", "dealer IN (SELECT dealer FROM top)"
        counts = {g: (f"count(*) FILTER ({of})", f"count(*) FILTER ({of} AND {hit})") for g, of in (("low", low), ("best", top))}
        cols = ", ".join(f"{n} AS n_{g}, {m} AS mentions_{g}, {_pct(m, n)} AS share_{g}_pct" for g, (n, m) in counts.items())
        parts.append(f"SELECT '{name}' AS theme, {cols} FROM vts")
    return "\nUNION ALL\n".join(parts)


@register("report_theme_dealers", X.with_views(f"""
, d AS (SELECT dealer, avg(score) AS m, count(*) AS n FROM vts WHERE dealer IS NOT NULL GROUP BY dealer HAVING avg(score) IS NOT NULL),
low AS (SELECT dealer FROM d WHERE m < 5), top AS (SELECT dealer FROM d ORDER BY m DESC, n DESC, dealer LIMIT 3)
{_dealer_theme_sql()}""", VT))
def q_report_theme_dealers(spark, sf):
    return R.theme_dealers(X.verbatims(spark, sf), THEMES)


@register("report_cross", X.with_views(f"""
SELECT model, dealer, count(*) AS n, {r2('avg(score)')} AS mean_score
FROM vts WHERE model IS NOT NULL AND dealer IS NOT NULL GROUP BY model, dealer""", VT))
def q_report_cross(spark, sf):
    return R.cross(X.verbatims(spark, sf))


@register("report_delay_bands", X.with_views(f"""
SELECT CASE WHEN days IS NULL THEN 'none' WHEN days < 1 THEN '<1d' WHEN days < 7 THEN '1-7d'
            WHEN days < 30 THEN '7-30d' ELSE '>=30d' END AS band,
       count(*) AS n, {r2('avg(score)')} AS mean_score, {r2('avg(days)')} AS mean_days
FROM delayed GROUP BY 1""", VT, X.DELAYED_SQL))
def q_report_delay_bands(spark, sf):
    """Delays are planted in the comments as numerals and number words; the oracle knows them without reading."""
    return R.delay_bands(X.delayed(spark, sf))


@register("report_delay_verdicts", X.with_views(f"""
, t AS (SELECT service, days, count(*) AS n, sum(score) AS s, sum(score * score) AS ss FROM delayed
        WHERE days IS NOT NULL AND score IS NOT NULL GROUP BY service, days),
p AS (SELECT service, days, row_number() OVER w AS i, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(ss) OVER w AS ss,
             sum(n) OVER (PARTITION BY service) AS an, sum(s) OVER (PARTITION BY service) AS a_s
      FROM t WINDOW w AS (PARTITION BY service ORDER BY days)),
c AS (SELECT a.service, a.i AS i, b.i AS j,
             - a.s * a.s / a.n - (b.s - a.s) * (b.s - a.s) / (b.n - a.n) - (b.a_s - b.s) * (b.a_s - b.s) / (b.an - b.n) AS cost
      FROM p a JOIN p b ON a.service = b.service AND a.i < b.i AND b.n < b.an),
best AS (SELECT service, i, j FROM (
  SELECT *, row_number() OVER (PARTITION BY service ORDER BY round(cost, 6), i, j) AS place FROM c) WHERE place = 1),
bands AS (
  SELECT t.service, CASE WHEN p.i <= best.i THEN 1 WHEN p.i <= best.j THEN 2 ELSE 3 END AS band, min(t.days) AS lo, max(t.days) AS hi,
         CAST(sum(t.n) AS BIGINT) AS n, sum(t.s) / sum(t.n) AS m
  FROM t JOIN p ON t.service = p.service AND t.days = p.days JOIN best ON best.service = t.service GROUP BY ALL)
SELECT service, band, round(lo, 6) AS from_days, round(hi, 6) AS to_days, n, {r2('m')} AS mean_score,
       CASE row_number() OVER (PARTITION BY service ORDER BY m DESC, band) WHEN 1 THEN 'genial' WHEN 2 THEN 'bien' ELSE 'mal' END AS verdict
FROM bands""", VT, X.DELAYED_SQL))
def q_report_delay_verdicts(spark, sf):
    """Which delays the customers of sales and of service call great, fair or bad."""
    return R.delay_verdicts(X.delayed(spark, sf), ["service"])


@register("report_gap", X.with_views(f"""
, o AS (SELECT avg(score) AS ov FROM vts),
a AS (SELECT dealer, avg(score) AS m FROM vts WHERE dealer IS NOT NULL GROUP BY dealer)
SELECT dealer, {r2('m')} AS mean_score, {r2('ov')} AS overall_mean, {r2('m - ov')} AS gap_points,
       {r2('(m - ov) * CAST(100 AS DOUBLE) / ov')} AS gap_pct FROM a, o""", VT))
def q_report_gap(spark, sf):
    return R.gap_to(X.verbatims(spark, sf))


@register("report_gap_ref", X.with_views(f"""
, a AS (SELECT technology, avg(score) AS m FROM vts WHERE technology IS NOT NULL GROUP BY technology),
o AS (SELECT m AS ov FROM a WHERE technology = 'Gasolina')
SELECT technology, {r2('m')} AS mean_score, {r2('ov')} AS ref_mean, {r2('m - ov')} AS gap_points,
       {r2('(m - ov) * CAST(100 AS DOUBLE) / ov')} AS gap_pct FROM a, o""", VT))
def q_report_gap_ref(spark, sf):
    """Each technology against petrol."""
    return R.gap_to(X.verbatims(spark, sf), "technology", ref="Gasolina")


# ------------------------------------------------------------ findings ----
@register("report_distinctive_terms", X.with_views("""
, d AS (SELECT dealer, count(*) AS n, avg(score) AS m FROM vts WHERE dealer IS NOT NULL GROUP BY dealer HAVING avg(score) IS NOT NULL),
top AS (SELECT dealer FROM d ORDER BY m DESC, n DESC, dealer LIMIT 3),
sides AS (SELECT dealer, 'best' AS side FROM top UNION ALL SELECT dealer, 'low' FROM d WHERE m < 5 AND dealer NOT IN (SELECT dealer FROM top)),
w AS (SELECT side, list_filter(regexp_split_to_array(lower(coalesce(comment, '')), '[^\\p{L}\\p{N}_]+'), lambda t: t <> '') AS ws FROM vts JOIN sides USING (dealer)),
g AS (SELECT side, 1 AS n, unnest(ws) AS term FROM w
      UNION ALL SELECT side, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
c AS (SELECT n, term, count(*) FILTER (side = 'low') AS yl, count(*) FILTER (side = 'best') AS yb FROM g GROUP BY n, term),
t AS (SELECT *, sum(yl) OVER (PARTITION BY n) AS nl, sum(yb) OVER (PARTITION BY n) AS nb FROM c),
e AS (SELECT *, (yl + yb) * CAST(500 AS DOUBLE) / (nl + nb) AS a FROM t WHERE yl + yb >= 5),
z AS (SELECT term, yl, yb, round((ln((yl + a) / (nl + 500 - yl - a)) - ln((yb + a) / (nb + 500 - yb - a))) / sqrt(1 / (yl + a) + 1 / (yb + a)), 9) AS z FROM e),
r AS (SELECT CASE WHEN z > 0 THEN 'low' ELSE 'best' END AS side, term, yl, yb, z,
             row_number() OVER (PARTITION BY z > 0 ORDER BY abs(z) DESC, term) AS rank FROM z WHERE z <> 0)
SELECT side, CAST(rank AS INTEGER) AS rank, term, yl AS n_low, yb AS n_best, round(z, 6) AS z FROM r WHERE rank <= 20""", VT))
def q_report_distinctive_terms(spark, sf):
    """Words and pairs of words that set badly rated dealers apart from the best three."""
    return FD.distinctive_terms(X.verbatims(spark, sf))


@register("report_silences", """
WITH o AS (SELECT o_custkey AS dealer, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS m FROM orders),
lim AS (SELECT min(m) AS lo, max(m) AS hi FROM o),
spine AS (SELECT dealer, unnest(range(lo, hi + 1)) AS m FROM (SELECT DISTINCT dealer FROM o), lim),
f AS (SELECT s.dealer, s.m, count(o.m) AS n FROM spine s LEFT JOIN o ON o.dealer = s.dealer AND o.m = s.m GROUP BY ALL),
g AS (SELECT *, m - row_number() OVER (PARTITION BY dealer, n = 0 ORDER BY m) AS run FROM f),
runs AS (SELECT dealer, n = 0 AS quiet, min(m) AS first, max(m) AS last, sum(n) AS n FROM g GROUP BY dealer, n = 0, run),
w AS (SELECT *, lag(n) OVER p AS nb, lag(last - first + 1) OVER p AS ab, lead(n) OVER p AS na FROM runs WINDOW p AS (PARTITION BY dealer ORDER BY first))
SELECT dealer, make_date(first // 12, first % 12 + 1, 1) AS from_month, CAST(last - first + 1 AS INTEGER) AS n_months,
       CASE WHEN nb IS NULL THEN 'late' WHEN last - first + 1 < 2 THEN 'gap' WHEN na IS NULL THEN 'stopped' ELSE 'pause' END AS kind,
       CAST(ab AS BIGINT) AS active_months, CAST(nb AS BIGINT) AS n_before, CAST(na AS BIGINT) AS n_after
FROM w WHERE quiet""")
def q_report_silences(spark, sf):
    """Runs of months without an order, per customer, over the months that the table covers."""
    orders = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("dealer"), F.col("o_orderdate").alias("dt"))
    return FD.silences(orders)


@register("report_mean_drivers", X.with_views("""
, b AS (SELECT model, dealer, score FROM vts WHERE model IS NOT NULL AND dealer IS NOT NULL AND score IS NOT NULL),
g AS (SELECT avg(score) AS g, count(*) AS n FROM b),
m AS (SELECT model, avg(score) AS mm, count(*) AS nm, sum(score) AS sm FROM b GROUP BY model),
d AS (SELECT dealer, avg(score) AS md, count(*) AS nd FROM b GROUP BY dealer),
x AS (SELECT m.model, d.dealer, mm, nm, sm, md, nd, count(b.score) AS n, coalesce(sum(b.score), 0) AS s
      FROM m CROSS JOIN d LEFT JOIN b ON b.model = m.model AND b.dealer = d.dealer GROUP BY ALL),
y AS (SELECT x.*, CAST(x.n AS DOUBLE) / nm AS share, (CAST(x.n AS DOUBLE) / nm - CAST(nd AS DOUBLE) / g.n) * (md - g) AS mix, mm - g AS gap FROM x, g),
o AS (SELECT model, dealer, n, s / n AS mean_score, share, share * (s / n - md) AS level, mix,
             CASE WHEN nm > n THEN mm - (sm - s) / (nm - n) END AS influence, gap FROM y WHERE n > 0
      UNION ALL SELECT model, '(otros)', 0, NULL, 0, 0, coalesce(sum(mix) FILTER (n = 0), 0), NULL, any_value(gap) FROM y GROUP BY model)
SELECT model, dealer, n, round(mean_score, 6) AS mean_score, round(share, 6) AS share, round(level, 6) AS level, round(mix, 6) + 0 AS mix,
       round(influence, 6) AS influence, round(gap, 6) AS gap FROM o""", VT))
def q_report_mean_drivers(spark, sf):
    """Which dealers move a model's mean away from the overall mean, by level and by mix."""
    return FD.mean_drivers(X.verbatims(spark, sf))


# A name of each customer's workshop, spelled in six ways: as registered, in capitals, with other
# marks, with a letter missing, with a letter doubled, and with the company form written together.
_SPELLED_SQL = """spelled AS (
  SELECT n_nationkey AS truth, CASE c_custkey % 11 WHEN 0 THEN upper(base) || ' S.A.' WHEN 1 THEN replace(base, ' ', '  - ') || ', S.A'
    WHEN 2 THEN left(base, 8) || substr(base, 10) || ' S.A.' WHEN 3 THEN left(base, 9) || substr(base, 9) || ' S.A.' WHEN 4 THEN base || ' SA'
    WHEN 5 THEN replace(base, 'o', 'ó') || ' S.A.' ELSE base || ' S.A.' END AS dealer
  FROM (SELECT c_custkey, n_nationkey, 'Motores ' || n_name || ' ' || CAST(n_nationkey + 100 AS VARCHAR) AS base FROM customer JOIN nation ON n_nationkey = c_nationkey))"""


def _spelled(spark, sf):
    c = X.table(spark, sf, "customer").join(X.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    base, k = F.concat(F.lit("Motores "), "n_name", F.lit(" "), (F.col("n_nationkey") + 100).cast("string")), F.col("c_custkey") % 11
    sa = F.lit(" S.A.")
    name = (
        F.when(k == 0, F.concat(F.upper(base), sa)).when(k == 1, F.concat(F.replace(base, F.lit(" "), F.lit("  - ")), F.lit(", S.A")))
        .when(k == 2, F.concat(F.left(base, F.lit(8)), F.substr(base, F.lit(10)), sa)).when(k == 3, F.concat(F.left(base, F.lit(9)), F.substr(base, F.lit(9)), sa))
        .when(k == 4, F.concat(base, F.lit(" SA"))).when(k == 5, F.concat(F.replace(base, F.lit("o"), F.lit("ó")), sa)).otherwise(F.concat(base, sa))
    )
    return c.select(name.alias("dealer"), F.col("c_custkey"))


@register("dealer_names", "WITH " + _SPELLED_SQL + """,
c AS (SELECT truth, dealer AS name, count(*) AS n FROM spelled GROUP BY ALL)
SELECT name, first_value(name) OVER (PARTITION BY truth ORDER BY n DESC, name) AS canonical, n, count(*) OVER (PARTITION BY truth) AS n_variants FROM c""")
def q_dealer_names(spark, sf):
    """R6 + P6: spelling variants of workshop names, brought together by slug, q-grams and edit distance; the oracle knows who is who."""
    from feedloom.operators import names as N

    return N.resolve_names(_spelled(spark, sf))


@register("name_slugs", "WITH " + _SPELLED_SQL + """
SELECT slug, count(DISTINCT dealer) AS n_names, count(*) AS n
FROM (SELECT dealer, trim(regexp_replace(translate(lower(dealer), 'ó', 'o'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM spelled) GROUP BY slug""")
def q_name_slugs(spark, sf):
    """P6 over values: names with one slug."""
    return _spelled(spark, sf).groupBy(TX.slug("dealer").alias("slug")).agg(F.count_distinct("dealer").alias("n_names"), F.count(F.lit(1)).alias("n"))


# Scores with planted turns: a third of the dealers fall in June 1995, a third have half a good year in 1996.
_TURNS_SQL = """turns AS (
  SELECT dealer, date_trunc('month', dt) AS month,
    score - CASE WHEN l_suppkey % 3 = 0 AND dt >= DATE '1995-06-01' THEN 4 ELSE 0 END
          + CASE WHEN l_suppkey % 3 = 1 AND dt >= DATE '1996-03-01' AND dt < DATE '1996-09-01' THEN 8 ELSE 0 END AS score
  FROM vf)"""


@register("report_trend_breaks", "WITH RECURSIVE " + VF + ", " + _TURNS_SQL + """,
m AS (SELECT dealer, month, count(*) AS n, CAST(sum(score) AS DOUBLE) AS s, CAST(sum(score * score) AS DOUBLE) AS ss FROM turns GROUP BY ALL),
c AS (SELECT dealer, list(month ORDER BY month) AS months, list_prepend(CAST(0 AS DOUBLE), list(an ORDER BY month)) AS n, list_prepend(CAST(0 AS DOUBLE), list(a_s ORDER BY month)) AS s,
             list_prepend(CAST(0 AS DOUBLE), list(ass ORDER BY month)) AS ss, 12 * greatest(sum(own), 0) / greatest(sum(cnt) - count(*), 1) AS pen
      FROM (SELECT dealer, month, n AS cnt, ss - s * s / n AS own, CAST(sum(n) OVER w AS DOUBLE) AS an, sum(s) OVER w AS a_s, sum(ss) OVER w AS ass
            FROM m WINDOW w AS (PARTITION BY dealer ORDER BY month)) GROUP BY dealer),
dp AS (
  SELECT dealer, 0 AS j, [CAST(0 AS DOUBLE)] AS f, CAST([] AS INTEGER[]) AS begins FROM c
  UNION ALL
  SELECT dealer, j + 1, list_append(f, list_min(costs)), list_append(begins, CAST(list_position(list_transform(costs, lambda x: x <= list_min(costs) + 1e-9), true) - 1 AS INTEGER))
  FROM (SELECT d.dealer, j, f, begins, list_transform(range(1, j + 2), lambda i: f[i] + CASE WHEN i > 1 THEN pen ELSE 0 END + (ss[j + 2] - ss[i])
               - (s[j + 2] - s[i]) * (s[j + 2] - s[i]) / (n[j + 2] - n[i])) AS costs
        FROM dp d JOIN c ON c.dealer = d.dealer WHERE j < len(months))),
done AS (SELECT dp.dealer, begins, len(months) AS size FROM dp JOIN c ON c.dealer = dp.dealer WHERE j = len(months)),
cuts AS (
  SELECT dealer, begins, begins[size] AS lo, size AS hi FROM done
  UNION ALL SELECT dealer, begins, begins[lo], lo FROM cuts WHERE lo > 0),
seg AS (SELECT u.dealer, row_number() OVER w AS segment, lo, hi, (s[hi + 1] - s[lo + 1]) / (n[hi + 1] - n[lo + 1]) AS mean, n[hi + 1] - n[lo + 1] AS cnt, months[lo + 1] AS a, months[hi] AS b
        FROM cuts u JOIN c ON c.dealer = u.dealer WINDOW w AS (PARTITION BY u.dealer ORDER BY lo))
SELECT dealer, CAST(segment AS INTEGER) AS segment, CAST(a AS DATE) AS from_month, CAST(b AS DATE) AS to_month, CAST(cnt AS BIGINT) AS n, round(mean, 6) AS mean_score,
       round(mean - lag(mean) OVER (PARTITION BY dealer ORDER BY segment), 6) AS change FROM seg""")
def q_report_trend_breaks(spark, sf):
    """Stretches of months over which a dealer's mean holds still, with planted turns."""
    key, dt = F.col("l_suppkey"), F.col("dt")
    day = lambda d: F.lit(d).cast("date")
    fall = F.when((key % 3 == 0) & (dt >= day("1995-06-01")), 4).otherwise(0)
    rise = F.when((key % 3 == 1) & (dt >= day("1996-03-01")) & (dt < day("1996-09-01")), 8).otherwise(0)
    return FD.trend_breaks(X.facts(spark, sf).withColumn("score", F.col("score") - fall + rise))


# =========================================================== retrieval ====


@register("enriched_text", X.with_views("""
SELECT id, concat_ws(' | ',
  'Taller: ' || coalesce(dealer, 'nan'), 'Modelo: ' || coalesce(model, 'nan'),
  'Tecnología: ' || coalesce(technology, 'nan'), 'Puntuación: ' || coalesce(score_raw, 'nan'),
  'Comentario: ' || coalesce(comment, 'nan'),
  'Fecha: ' || coalesce(strftime(CAST(dt AS TIMESTAMP), '%Y-%m-%d %H:%M:%S'), 'nan')) AS texto_enriquecido
FROM vt""", VT))
def q_enriched_text(spark, sf):
    return RT.enriched_text(X.verbatims(spark, sf)).select("id", "texto_enriquecido")


_CENTROID_SQL = """centroids AS (
  SELECT label AS query_id, list(m ORDER BY pos) AS qv FROM (
    SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS m FROM (
      SELECT label, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label),
hits AS (
  SELECT query_id, rank, vec_id, label, round(d, 6) AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rank FROM (
      SELECT c.query_id, e.vec_id, e.label,
             list_sum(list_transform(range(1, len(e.embedding) + 1),
                                     lambda i: (CAST(e.embedding[i] AS DOUBLE) - c.qv[i]) ** 2)) AS d
      FROM centroids c, embeddings e WHERE len(e.embedding) = len(c.qv)))
  WHERE rank <= 5)"""


def _label_knn(spark, sf):
    emb = X.table(spark, sf, "embeddings")
    q = RT.centroids(emb, "label").withColumnRenamed("label", "query_id")
    return RT.knn(q, emb, k=5, qid="query_id", qvec="query_vec", vid="vec_id", vec="embedding", payload=["label"])


@register("knn_l2", X.with_views("SELECT * FROM hits", _CENTROID_SQL))
def q_knn_l2(spark, sf):
    return _label_knn(spark, sf)


@register("rag_context", X.with_views("""
SELECT h.query_id, string_agg('- (' || concat_ws(', ', coalesce(v.dealer, 'nan'), coalesce(v.model, 'nan'),
         coalesce(v.technology, 'nan'), coalesce(v.score_raw, 'nan')) || ') ' || coalesce(v.comment, 'nan'), chr(10)
         ORDER BY h.rank) AS context, count(*) AS n_hits
FROM hits h LEFT JOIN vt v ON v.id = h.vec_id GROUP BY h.query_id""", VT, _CENTROID_SQL))
def q_rag_context(spark, sf):
    return RT.build_context(_label_knn(spark, sf), X.verbatims(spark, sf))


@register("chat_history", """
SELECT conv_id, turn, CASE WHEN rn >= 4 THEN 4 ELSE 0 END AS n_history,
       CASE WHEN rn >= 4 THEN array_to_string(h, chr(10)) ELSE '' END AS history
FROM (SELECT conv_id, turn, role,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
             list(role || ': ' || coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn
                  ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h
      FROM conversations) WHERE role = 'user'""")
def q_chat_history(spark, sf):
    return RT.history_window(X.table(spark, sf, "conversations"), 4)


@register("chat_history_gaps", """
WITH c AS (SELECT conv_id, turn * 3 + 7 + (turn % 2) AS turn, role, text FROM conversations WHERE turn % 5 <> 3)
SELECT conv_id, turn, CASE WHEN rn >= 4 THEN 4 ELSE 0 END AS n_history,
       CASE WHEN rn >= 4 THEN array_to_string(h, chr(10)) ELSE '' END AS history
FROM (SELECT conv_id, turn, role, row_number() OVER w AS rn,
             list(role || ': ' || coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""")
def q_chat_history_gaps(spark, sf):
    """T4 on conversations whose turn numbers start late and have gaps."""
    c = X.table(spark, sf, "conversations").where(F.col("turn") % 5 != 3)
    return RT.history_window(c.withColumn("turn", F.col("turn") * 3 + 7 + F.col("turn") % 2), 4)


def _buckets_sql(text: str, n: int) -> str:
    """Word buckets of a text in DuckDB."""
    return (f"list_transform(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> ''), "
            f"lambda t: CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {n})")


def _embedding_sql(view: str, source: str, text: str, key: str, dim: int = 64) -> str:
    """Views ``<view>``: (key, e) with the normalised bucket counts as FLOAT[]."""
    return f"""{view}_b AS (SELECT {key}, {_buckets_sql(text, dim)} AS b FROM {source}),
{view}_c AS (SELECT {key}, list_transform(range({dim}), lambda i: CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE)) AS c FROM {view}_b),
{view} AS (SELECT {key}, list_transform(c, lambda x: CAST(CASE WHEN list_sum(c) = 0 THEN 0 ELSE x / sqrt(list_sum(list_transform(c, lambda y: y * y))) END AS FLOAT)) AS e FROM {view}_c)"""


@register("text_vectors", X.with_views(f"""
, w AS (SELECT id, unnest({_buckets_sql('comment', 1 << 18)}) AS index FROM vt),
tf AS (SELECT id, index, count(*) AS n FROM w GROUP BY ALL),
df AS (SELECT index, ln(((SELECT count(*) FROM vt) + 1) / CAST(count(*) + 1 AS DOUBLE)) AS idf FROM tf GROUP BY index)
SELECT id, CAST(index AS INTEGER) AS index, round(n * idf, 6) AS value FROM tf JOIN df USING (index)""", VT))
def q_text_vectors(spark, sf):
    vectors = RT.tfidf_vectors(X.verbatims(spark, sf), "comment", "id")
    entries = vectors.select("id", F.explode("features").alias("f"))
    return entries.select("id", F.col("f.index").alias("index"), F.round("f.value", 6).alias("value"))


@register("text_embeddings", X.with_views(", " + _embedding_sql("emb", "vt", "comment", "id") + "\nSELECT id, e AS embedding FROM emb", VT))
def q_text_embeddings(spark, sf):
    return RT.hashed_embeddings(X.verbatims(spark, sf), "comment", "id", dim=64)


def _length_model(texts: list[str]):
    """A deterministic embedding function for the hook: length, spaces and vowels of each text."""
    import numpy as np

    return np.array([[len(t or ""), (t or "").count(" "), sum((t or "").count(v) for v in "aeiou")] for t in texts], dtype=np.float32)


@register("embedded_by_function", X.with_views("""
SELECT id, [CAST(length(comment) AS FLOAT), CAST(length(comment) - length(replace(comment, ' ', '')) AS FLOAT),
            CAST(length(regexp_replace(comment, '[^aeiou]', '', 'g')) AS FLOAT)] AS embedding FROM vt WHERE comment IS NOT NULL""", VT))
def q_embedded_by_function(spark, sf):
    """T5's hook with a caller's function."""
    return RT.embed_texts(X.verbatims(spark, sf).where(F.col("comment").isNotNull()), _length_model, "comment", "id")


# What a retrieved comment shows.
STORE_COLS = ["dt", "dealer", "model", "technology", "score_raw", "comment"]


def _embedded(v):
    """The retrieval table of verbatims: id, the six shown columns, and the vector of the enriched text."""
    e = RT.hashed_embeddings(RT.enriched_text(v), "texto_enriquecido", "id", dim=64)
    return v.select("id", *STORE_COLS).join(e, "id").withColumnRenamed("id", "vec_id")


def _questions(spark, sf):
    q = RT.hashed_embeddings(X.table(spark, sf, "benchmark"), "text", "item_id", dim=64, out="query_vec")
    return q.withColumnRenamed("item_id", "query_id")


_ENRICHED_SQL = """concat_ws(' | ',
  'Taller: ' || coalesce(dealer, 'nan'), 'Modelo: ' || coalesce(model, 'nan'),
  'Tecnología: ' || coalesce(technology, 'nan'), 'Puntuación: ' || coalesce(score_raw, 'nan'),
  'Comentario: ' || coalesce(comment, 'nan'),
  'Fecha: ' || coalesce(strftime(CAST(dt AS TIMESTAMP), '%Y-%m-%d %H:%M:%S'), 'nan'))"""


def _retrieval_sql(by_service: bool) -> str:
    part = "query_id, service" if by_service else "query_id"
    shown = ", ".join(f"v.{c}" for c in STORE_COLS)
    return f""", {_embedding_sql('emb', 'vt', _ENRICHED_SQL, 'id')},
{_embedding_sql('qs', 'benchmark', 'text', 'item_id')},
pairs AS (SELECT q.item_id AS query_id, e.id AS vec_id, v.service,
    list_sum(list_transform(range(1, 65), lambda i: (CAST(e.e[i] AS DOUBLE) - CAST(q.e[i] AS DOUBLE)) ** 2)) AS d
  FROM qs q, emb e JOIN vt v ON v.id = e.id),
best AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY round(d, 9), vec_id) AS rank FROM pairs)
SELECT b.query_id, b.rank, b.vec_id, {shown}, round(b.d, 6) AS distance{', b.service' if by_service else ''}
FROM best b JOIN vt v ON v.id = b.vec_id WHERE b.rank <= 5"""


@register("knn_comments", X.with_views(_retrieval_sql(False), VT))
def q_knn_comments(spark, sf):
    """Benchmark questions against the embedded enriched texts: the retrieval step of the chat."""
    return RT.knn(_questions(spark, sf), _embedded(X.verbatims(spark, sf)), k=5, payload=STORE_COLS)


def _csv_sql(c: str) -> str:
    s = f"coalesce(CAST({c} AS VARCHAR), '')"
    return (f"CASE WHEN regexp_matches({s}, '[,\"\\n\\r]') THEN '\"' || replace({s}, '\"', '\"\"') || '\"' "
            f"ELSE {s} END")


_CORPUS_COLS = ["dt", "dealer", "model", "technology", "score_raw", "comment"]
_LINE_SQL = "concat_ws(',', " + ", ".join(_csv_sql(c) for c in _CORPUS_COLS) + ")"


@register("corpus_size", X.with_views(f"""
, l AS (SELECT service, {_LINE_SQL} AS line FROM vt)
SELECT service, count(*) AS n_rows, sum(length(line) + 1) AS n_chars,
       sum(len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''))) AS n_words
FROM l GROUP BY service""", VT))
def q_corpus_size(spark, sf):
    return RT.corpus_size(X.verbatims(spark, sf), _CORPUS_COLS, "service")


# ============================================================ sources ====


def _scratch(spark, kind: str) -> str:
    """A fresh folder under the session's checkpoint folder (shared storage on a cluster)."""
    import uuid

    from feedloom.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/extracts/{kind}-{uuid.uuid4().hex}"


@register("monthly_extracts", X.with_views(f"""
SELECT list_element({_MONTHS_SQL}, month(dt)) AS mes, count(*) AS n, {r2('avg(score)')} AS mean_score
FROM vts WHERE dt IS NOT NULL GROUP BY 1""", VT))
def q_monthly_extracts(spark, sf):
    """S8 + S4 + A9: write the verbatims as one extract per month, read the fixed
    list of monthly extracts back (missing months skipped), count per month."""
    from feedloom.operators._util import round2
    from feedloom.sources import ingest as S
    from feedloom.sources import sinks as K

    root = _scratch(spark, "monthly")
    vt = X.verbatims(spark, sf).where(F.col("dt").isNotNull())
    K.write_parquet(vt.select("id", "dealer", "score", "dt", M.month_tag("dt").alias("mes")), root, ["mes"])
    back = S.read_tagged(spark, {f"{root}/mes={m}": m for m in M.MONTHS_ES}, tag="mes", fmt="parquet")
    return back.groupBy("mes").agg(F.count(F.lit(1)).alias("n"), round2(F.avg("score")).alias("mean_score"))


# Fixed fixture values: the questionnaire sheet of the survey workbooks
# (Display ID -> question text).
SURVEY_QUESTIONS = [("Q1", "¿Recomendaría el taller?"), ("Q2", "Saldo de la cuenta")]


@register("survey_extracts", """
WITH b AS (SELECT *, c_mktsegment = (SELECT max(c_mktsegment) FROM customer) AS bare,
                  CASE WHEN c_acctbal < 0 THEN 'n' ELSE 'S' END AS a1,
                  CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS a2 FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS nombre_cliente,
       CASE WHEN NOT bare THEN a1 END AS "¿recomendaría_el_taller?",
       CASE WHEN NOT bare THEN a2 END AS saldo_de_la_cuenta,
       CASE WHEN bare THEN a1 END AS q1, CASE WHEN bare THEN a2 END AS q2,
       lower(c_mktsegment) || '__Ventas.csv' AS _file
FROM b""")
def q_survey_extracts(spark, sf):
    """S1 + S3 + P1 + P2 + U1: one CSV workbook per market segment (a ``__Ventas`` sheet
    and its ``__Questionnaire`` sheet; the last book has none), read back with per-book
    renames, normalised names, all-string columns and a union by name."""
    from feedloom.sources import ingest as S
    from feedloom.sources import sinks as K

    root = _scratch(spark, "survey")
    c = X.table(spark, sf, "customer")
    raw = c.select(
        F.col("c_custkey").alias("ID"), F.col("c_name").alias("Nombre Cliente"),
        F.when(F.col("c_acctbal") < 0, "n").otherwise("S").alias("Q1"),
        F.floor("c_acctbal").cast("bigint").alias("Q2"), "c_mktsegment",
    )
    # one scan writes all workbooks; a partition folder becomes its book's sheet by name
    raw.withColumn("book", F.concat(F.lower("c_mktsegment"), F.lit("__Ventas.csv"))).drop("c_mktsegment").write.partitionBy("book").options(**K.CSV_WRITE_OPTIONS).csv(root)
    books = sorted(r[0] for r in c.select("c_mktsegment").distinct().collect())  # a handful of workbooks
    questions = spark.createDataFrame(SURVEY_QUESTIONS, "`Display ID` string, Questionnaire string")
    for book in books[:-1]:
        questions.write.options(**K.CSV_WRITE_OPTIONS).csv(f"{root}/book={book.lower()}__Questionnaire.csv")
    return S.read_survey(spark, root, "Ventas").drop("_row").withColumn("_file", F.regexp_replace("_file", "^book=", ""))


# Fixture of drifting headers: what each shape of workbook calls the question Q1 in its own sheet.
_BOOK_QUESTIONS = {0: "Nota", 1: "Valor"}


@register("survey_headers", """
WITH b AS (SELECT *, c_custkey % 4 AS shape, c_custkey // 4 % 6 AS book FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS id,
       CASE shape WHEN 0 THEN c_name WHEN 3 THEN c_name || chr(10) || '"' || c_mktsegment || '"' END AS nombre_cliente,
       CASE WHEN shape < 2 THEN c_mktsegment END AS email,
       CASE WHEN shape = 0 THEN CAST(c_nationkey AS VARCHAR) END AS email_2,
       CASE WHEN shape = 2 AND book % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS nota,
       CASE WHEN shape = 2 AND book % 3 = 1 THEN CAST(c_nationkey AS VARCHAR) END AS valor,
       CASE WHEN shape = 2 AND book % 3 = 2 THEN CAST(c_nationkey AS VARCHAR) END AS q1,
       'libro' || shape || book || '__Ventas.csv' AS _file
FROM b""")
def q_survey_headers(spark, sf):
    """S1 + S3 + U1 over two dozen workbooks in four header shapes: columns change places, are
    missing, have line breaks and quotes in their names, come to the same name, or are named
    by question sheets that differ from book to book.  One scan per header."""
    from feedloom.sources import ingest as S
    from feedloom.sources import sinks as K

    root = _scratch(spark, "headers")
    k, name = F.col("c_custkey"), F.col("c_name")
    quoted = F.concat(name, F.lit('\n"'), F.col("c_mktsegment"), F.lit('"'))
    nation = F.col("c_nationkey").cast("string")
    shapes = [
        [k.alias("ID"), name.alias("Nombre Cliente"), F.col("c_mktsegment").alias("Email"), nation.alias("EMAIL ")],
        [F.col("c_mktsegment").alias("email"), k.alias("ID")],
        [nation.alias("Q1"), k.alias("ID")],
        [k.alias(" ID"), quoted.alias("Nombre\nCliente")],
    ]
    customers = X.table(spark, sf, "customer")
    for shape, columns in enumerate(shapes):
        book = F.concat(F.lit(f"libro{shape}"), F.floor(k / 4) % 6, F.lit("__Ventas.csv")).alias("book")
        rows = customers.where(k % 4 == shape).select(*columns, book)
        rows.write.partitionBy("book").options(**K.CSV_WRITE_OPTIONS).csv(f"{root}/{shape}")
    for book in range(6):
        if book % 3 in _BOOK_QUESTIONS:
            questions = spark.createDataFrame([("Q1", _BOOK_QUESTIONS[book % 3])], "`Display ID` string, Questionnaire string")
            K.export_csv(questions, questions.columns, f"{root}/2/book=libro2{book}__Questionnaire.csv")
    rows = S.read_survey(spark, root, "Ventas").drop("_row").withColumn("_file", F.regexp_replace("_file", "^book=", ""))
    return rows.withColumnRenamed("nombre\ncliente", "con_salto").withColumn("nombre_cliente", F.coalesce("nombre_cliente", "con_salto")).drop("con_salto")


# Texts with what CSV must protect: line breaks, quotes, separators, blanks at the ends.
_HARD_TEXT_SQL = """CASE doc_id % 4 WHEN 0 THEN '"' || text || '"' WHEN 1 THEN ' ' || text || chr(10) || 'a,"b""c"' WHEN 2 THEN replace(text, ' ', ',"') ELSE text END"""


@register("free_text_csv", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, {_HARD_TEXT_SQL} AS text, via FROM documents, (VALUES ('survey'), ('sheet'), ('tagged')) v(via)
WHERE text IS NOT NULL AND text <> ''""")
def q_free_text_csv(spark, sf):
    """Whole document texts through S10 and back by S1, S2 and S4, character for character."""
    from feedloom.sources import ingest as S
    from feedloom.sources import sinks as K

    root = _scratch(spark, "texts")
    k, t = F.col("doc_id"), F.col("text")
    hard = (F.when(k % 4 == 0, F.concat(F.lit('"'), t, F.lit('"'))).when(k % 4 == 1, F.concat(F.lit(" "), t, F.lit('\na,"b""c"')))
            .when(k % 4 == 2, F.replace(t, F.lit(" "), F.lit(',"'))).otherwise(t))
    d = X.table(spark, sf, "documents").where(t.isNotNull() & (t != "")).select(k.alias("id"), hard.alias("text"))
    for sheet in ("Ventas", "sheet0"):
        K.export_csv(d, ["id", "text"], f"{root}/libro__{sheet}.csv")
    survey = S.read_survey(spark, root, "Ventas").select("id", "text", F.lit("survey").alias("via"))
    sheet = S.read_verbatims(spark, root)[0].withColumn("via", F.lit("sheet"))
    tagged = S.read_tagged(spark, {f"{root}/libro__Ventas.csv": "tagged"}, tag="via")
    return survey.unionByName(sheet).unionByName(tagged)


@register("tagged_drift", """
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 <> 2 THEN c_name END AS nombre,
       CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segmento, CASE c_custkey % 3 WHEN 0 THEN 'Enero' WHEN 1 THEN 'Febrero' ELSE 'Año nuevo' END AS mes
FROM customer""")
def q_tagged_drift(spark, sf):
    """S4 + U2 over monthly files whose columns drift and change places, one with a non-ASCII name."""
    from feedloom.sources import ingest as S
    from feedloom.sources import sinks as K

    root = _scratch(spark, "drift")
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nombre"), F.col("c_mktsegment").alias("segmento"))
    files = {}
    for k, (name, label, cols) in enumerate([("m/enero.csv", "Enero", ["id", "nombre"]), ("n/enero.csv", "Febrero", ["segmento", "nombre", "id"]), ("año 1.csv", "Año nuevo", ["segmento", "id"])]):
        K.export_csv(c.where(F.col("id") % 3 == k), cols, f"{root}/{name}")
        files[f"{root}/{name}"] = label
    return S.read_tagged(spark, files | {f"{root}/falta.csv": "Nunca"}, tag="mes")


# ====================================================== schema (P1-P8) ====

# Column-name dictionary used by the merge query (original spelling -> canonical).
NAME_MAPPING = [
    ("Email", "email"),
    ("Teléfono", "telefono"),
    ("Fecha de contacto", "fecha_contacto_ant"),
    ("Fecha Contacto", "fecha_contacto"),
    ("Código Postal", "codigo_postal"),
]


@register("merge_columns", X.with_views("""
SELECT CAST(id AS VARCHAR) AS id, email, telefono,
       coalesce(CASE WHEN id % 2 = 0 THEN enviado END, CASE WHEN id % 5 = 0 THEN 'x' END,
                CASE WHEN id % 3 = 0 THEN respondido END) AS fecha_contacto,
       codigo_postal
FROM contacts""", CT))
def q_merge_columns(spark, sf):
    c = X.contacts(spark, sf)
    raw = c.select(
        F.col("id").alias("ID"),
        F.col("email").alias(" Email "),
        F.col("telefono").alias("Teléfono"),
        F.when(F.col("id") % 2 == 0, F.col("enviado")).alias("Fecha Contacto"),
        F.when(F.col("id") % 5 == 0, F.lit("x")).alias("Fecha  contacto!"),
        F.when(F.col("id") % 3 == 0, F.col("respondido")).alias("Fecha-Contacto"),
        F.col("codigo_postal").alias("Código Postal"),
    )
    return P.merge_columns(P.stringify(P.normalize_columns(raw)), NAME_MAPPING)


_SURVEY_IP = "concat_ws('.', CAST(id % 223 + 1 AS VARCHAR), CAST(id % 256 AS VARCHAR), CAST(id % 100 AS VARCHAR), '7')"


@register("prepared_survey", X.with_views(f"""
, r AS (SELECT id, lower({_WS.format(x='email')}) AS email, regexp_replace(telefono, '[^0-9]', '', 'g') AS t, coalesce(trim(tiempo_empleado), '') AS te,
               CASE WHEN id % 7 < 3 THEN true WHEN id % 7 < 6 THEN false END AS recomienda,
               'Brand#' || CAST(1 + id % 5 AS VARCHAR) || CAST(1 + id // 5 % 5 AS VARCHAR) AS modelo, {_SURVEY_IP} AS ip, id % 223 + 1 AS block,
               try_strptime(respondido, '%d/%m/%Y %H:%M:%S') AS respondido FROM contacts),
p AS (SELECT *, CASE WHEN starts_with(t, '0034') THEN substr(t, 5) WHEN starts_with(t, '34') THEN substr(t, 3) ELSE t END AS tel FROM r),
kept AS (SELECT * FROM p
  WHERE email IS NOT NULL AND length(email) > 0 AND regexp_matches(email, '^[\\w\\.-]+@[\\w\\.-]+\\.\\w{{2,}}$')
    AND NOT regexp_matches(email, '{CL.EMAIL_BAD_START}') AND NOT ({_SUFFIX_SQL}) AND email NOT IN {_sql_list(CL.EMAIL_FAKE_EXACT)}
    AND length(tel) = 9 AND regexp_matches(tel, '^[0-9]{{9}}$') AND NOT regexp_matches(tel, '{CL.PHONE_FAKE_PREFIX}')
    AND tel NOT IN {_sql_list(CL.PHONE_PLACEHOLDERS)})
SELECT CAST(id AS VARCHAR) AS id, email, tel AS "teléfono",
       CAST(coalesce(TRY_CAST(nullif(regexp_extract(te, '(\\d+)m', 1), '') AS BIGINT), 0) * 60
          + coalesce(TRY_CAST(nullif(regexp_extract(te, '(\\d+)s', 1), '') AS BIGINT), 0) AS BIGINT) AS tiempo_empleado,
       recomienda, modelo, tecnologia, respondido, CAST(respondido AS DATE) AS respondido_fecha, strftime(respondido, '%H:%M:%S') AS respondido_hora, ip,
       CASE WHEN block % 2 = 0 THEN 'C' || CAST(block AS VARCHAR) END AS ip_city, d.renta_media
FROM kept LEFT JOIN tech_dim ON modelo = tech_dim.model
LEFT JOIN (SELECT CASE WHEN length(codigo_postal) < 5 THEN lpad(codigo_postal, 5, '0') ELSE codigo_postal END AS pc, renta_media FROM income_dim) d
  ON block % 2 = 0 AND lpad(CAST(block * 37 AS VARCHAR), 5, '0') = d.pc""", CT, X.TECH_SQL, X.INCOME_SQL))
def q_prepared_survey(spark, sf):
    """The whole preparation: two CSV workbooks with a question sheet, one repeating rows of
    the other (S10, S1, S3), cleaned, deduplicated, typed and enriched, stored and read
    back (S9, S6, S13)."""
    from feedloom.plans.preparation import prepare_survey
    from feedloom.sources import ingest as S
    from feedloom.sources import sinks as K

    root = _scratch(spark, "prepared")
    i = F.col("id")
    text = lambda c: c.cast("string")
    raw = X.contacts(spark, sf).select(
        i.alias("ID"), F.concat(F.lit("Ruiz "), text(i)).alias("Apellido Cliente"), F.concat(F.lit("Ana "), text(i)).alias("Nombre Cliente"),
        F.col("email").alias("Email"), F.col("telefono").alias("Teléfono"), F.col("tiempo_empleado").alias("Tiempo Empleado"),
        F.when(i % 7 < 3, "S").when(i % 7 < 6, "n").otherwise("-").alias("Q1"),
        F.concat(F.lit("Brand#"), text(1 + i % 5), text(1 + F.floor(i / 5) % 5)).alias("Modelo Coche"),
        F.col("respondido").alias("Respondido"), F.concat_ws(".", text(i % 223 + 1), text(i % 256), text(i % 100), F.lit("7")).alias("IP"),
    )
    K.export_csv(raw, raw.columns, f"{root}/raw/a__Ventas.csv")
    K.export_csv(raw.where(i % 3 == 0), raw.columns, f"{root}/raw/b__Ventas.csv")
    questions = spark.createDataFrame([("Q1", "¿Recomendaría?")], "`Display ID` string, Questionnaire string")
    for book in "ab":
        K.export_csv(questions, questions.columns, f"{root}/raw/{book}__Questionnaire.csv")
    facts = prepare_survey(
        S.read_survey(spark, f"{root}/raw", "Ventas"), X.technology_dim(spark, sf).withColumnRenamed("model", "modelo"),
        {"modelo coche": "modelo", "¿recomendaría?": "recomienda"}, X.city_ranges(spark, sf), X.asn_ranges(spark, sf), X.income_dim(spark, sf), threshold=2)
    K.write_table(facts.drop("_row"), f"{root}/facts")
    return S.read_processed(spark, f"{root}/facts").select(
        "id", "email", "teléfono", "tiempo_empleado", "recomienda", "modelo", "tecnologia", "respondido", "respondido_fecha", "respondido_hora", "ip", "ip_city", "renta_media")


def _raw_verbatims(spark, sf, with_service: bool = False):
    v = X.verbatims(spark, sf)
    resp = F.date_format(
        F.to_timestamp(F.concat(F.col("dt").cast("string"), F.lit(" "),
                                F.lpad((F.col("id") % 24).cast("string"), 2, "0"), F.lit(":15:00"))),
        "dd/MM/yyyy HH:mm:ss")
    return v.select(
        F.col("dealer").alias("Dealer Name"),
        F.col("id").cast("string").alias("Dealer No."),
        F.col("model").alias("Model"),
        _fuel_raw().alias("Fuel"),
        F.col("score_raw").alias("Product Score"),
        F.col("comment").alias("Verbatim"),
        F.when(F.col("id") % 41 == 0, F.lit("pendiente")).otherwise(resp).alias("Date of Response"),
        F.concat(F.lit("VIN"), F.col("id").cast("string")).alias("VIN"),
        F.concat(F.lit("Cliente "), F.col("id").cast("string")).alias("Customer Name"),
        *([F.col("service")] if with_service else []),
    )


@register("prepare_verbatims", X.with_views(f"""
, r AS (SELECT *, CASE WHEN id % 41 = 0 THEN NULL ELSE dt END AS fecha, {_FUEL_RAW_SQL} AS fuel FROM vts)
SELECT dealer AS "Taller", model AS "Modelo", CASE fuel {_FUEL_CASE} ELSE fuel END AS "Tecnología",
       score AS "Puntuación", comment AS "Comentarios", fecha AS "Fecha"
FROM r""", VT))
def q_prepare_verbatims(spark, sf):
    return prepare_verbatims(_raw_verbatims(spark, sf))


# Positional sheets of a verbatim workbook: first = sales, second = after-sales.
VERBATIM_SHEETS = [("sheet0", "Ventas"), ("sheet1", "Posventa")]


@register("verbatim_extracts", X.with_views(f"""
, r AS (SELECT *, CASE WHEN id % 41 = 0 THEN NULL ELSE dt END AS fecha, {_FUEL_RAW_SQL} AS fuel FROM vts)
SELECT dealer AS "Taller", model AS "Modelo", CASE fuel {_FUEL_CASE} ELSE fuel END AS "Tecnología",
       score AS "Puntuación", comment AS "Comentarios", fecha AS "Fecha", service AS servicio
FROM r""", VT))
def q_verbatim_extracts(spark, sf):
    """S2 + v1 preparation: one workbook whose positional sheets hold the sales and the
    after-sales verbatims, read back by position and prepared (P3, P4, P8, C6, C8, C9)."""
    from feedloom.sources import ingest as S

    root = _scratch(spark, "verbatims")
    raw = _raw_verbatims(spark, sf, with_service=True)
    for sheet, service in VERBATIM_SHEETS:
        raw.where(F.col("service") == service).drop("service").write.parquet(f"{root}/verbatims__{sheet}.parquet")
    sales, after = S.read_verbatims(spark, root, fmt="parquet")
    return prepare_verbatims(sales).withColumn("servicio", F.lit("Ventas")).unionByName(
        prepare_verbatims(after).withColumn("servicio", F.lit("Posventa")))


@register("income_from_csv", ORACLE["enrich_income"])
def q_income_from_csv(spark, sf):
    """S10 + S7 + J3: the income lookup exported as CSV and read back with an explicit
    schema (postal codes stay unpadded strings), then joined to the IP enrichment."""
    from feedloom.sources import ingest as S
    from feedloom.sources import sinks as K

    path = _scratch(spark, "income") + "/renta.csv"
    K.export_csv(X.income_dim(spark, sf), ["codigo_postal", "renta_media"], path)
    dim = S.read_dim(spark, path, "codigo_postal string, renta_media double")
    geo = J.enrich_ip(X.event_ips(spark, sf), X.city_ranges(spark, sf), X.asn_ranges(spark, sf))
    return J.enrich_income(geo, dim).select("event_id", "ip", "ip_postal_code", "renta_media")


@register("stored_knn", X.with_views(_retrieval_sql(True), VT))
def q_stored_knn(spark, sf):
    """S12 + T5 + T2: per service, the retrieval table (payload and vector) is built once,
    stored and read back; benchmark questions retrieve from each."""
    from feedloom.sources import sinks as K

    root = _scratch(spark, "vectors")
    vt = X.verbatims(spark, sf)
    hits = []
    for service in ("Ventas", "Posventa"):
        store = K.embeddings_store(spark, root, service, lambda s=service: _embedded(vt.where(F.col("service") == s)))
        hits.append(RT.knn(_questions(spark, sf), store, k=5, payload=STORE_COLS).withColumn("service", F.lit(service)))
    return hits[0].unionByName(hits[1])


def _stamped(load: int):
    """An embedder whose vectors tell the load in which a text was embedded."""
    return lambda texts: texts.select("text_key", F.array(F.length("text"), F.lit(load)).cast("array<float>").alias("embedding"))


@register("store_refresh", X.with_views(f"""
, t AS (SELECT id, dealer, dt, {_ENRICHED_SQL} AS old_text FROM vt WHERE service = 'Ventas'),
first_load AS (SELECT * FROM t WHERE dt < DATE '2025-03-01'),
second_load AS (SELECT id, dealer, dt, CASE WHEN id % 7 = 0 THEN old_text || ' (corregido)' ELSE old_text END AS new_text FROM t WHERE dt >= DATE '2025-02-01')
SELECT id, dealer, dt, sha256(new_text) AS text_key,
       [CAST(length(new_text) AS FLOAT), CAST(CASE WHEN new_text IN (SELECT old_text FROM first_load) THEN 1 ELSE 2 END AS FLOAT)] AS embedding
FROM second_load""", VT))
def q_store_refresh(spark, sf):
    """S12 over two loads: comments leave, arrive and are corrected; only unseen texts are embedded again."""
    from feedloom.sources import store as ST

    root = _scratch(spark, "store")
    t = RT.enriched_text(X.verbatims(spark, sf).where(F.col("service") == "Ventas")).select("id", "dealer", "dt", "texto_enriquecido")
    ST.refresh_embeddings(t.where(F.col("dt") < F.lit("2025-03-01").cast("date")), root, "Ventas", _stamped(1))
    text = F.col("texto_enriquecido")
    later = t.where(F.col("dt") >= F.lit("2025-02-01").cast("date")).withColumn("texto_enriquecido", F.when(F.col("id") % 7 == 0, F.concat(text, F.lit(" (corregido)"))).otherwise(text))
    ST.refresh_embeddings(later, root, "Ventas", _stamped(2))
    return ST.read_embeddings(spark, root, "Ventas").drop("texto_enriquecido")


_REPORT_LINE_SQL = "concat_ws(' | ', dim, coalesce(value, 'nan'), CAST(n AS VARCHAR), CAST(share_pct AS VARCHAR), " \
                   "coalesce(CAST(mean_score AS VARCHAR), 'nan'))"


@register("stored_report", X.with_views(_BREAKDOWN_SQL + f"""
SELECT {_REPORT_LINE_SQL} AS line FROM b""", VT))
def q_stored_report(spark, sf):
    """S11 over R2: the breakdown is stored as the service's text report, read back file
    by file, split into lines."""
    from feedloom.sources import ingest as S

    root = _scratch(spark, "reports")
    b = R.breakdown(X.verbatims(spark, sf))
    line = F.concat_ws(" | ", "dim", F.coalesce("value", F.lit("nan")), F.col("n").cast("string"),
                       F.col("share_pct").cast("string"), F.coalesce(F.col("mean_score").cast("string"), F.lit("nan")))
    b.select(line.alias("line")).write.text(f"{root}/informeventas.txt")
    text = S.read_report(spark, root, "Ventas")
    lines = text.select(F.explode(F.split(F.col("value"), "\n")).alias("line"))
    return lines.where(F.col("line") != "")
