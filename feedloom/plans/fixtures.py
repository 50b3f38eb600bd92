"""Fixture views: the driver's tables reshaped into the feedback data model.

Each builder reads whole driver tables and derives the view with Spark, so the
work grows with the scale factor.  ``SQL`` holds the same views in DuckDB
syntax; the oracle queries in ``plans.catalog`` are written on top of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import to_number
from feedloom.sources.ingest import read_parquet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _pick(cases: list, key: Column) -> Column:
    """Literal case number ``key % len(cases)`` (1-based pick, like a lookup table)."""
    arr = F.array(*[F.lit(c).cast("string") for c in cases])
    return F.element_at(arr, (F.pmod(key, F.lit(len(cases))) + 1).cast("int"))


def _sql_pick(cases: list, key: str) -> str:
    items = ", ".join("NULL" if c is None else "'" + c.replace("'", "''") + "'" for c in cases)
    return f"list_element([{items}]::varchar[], cast(({key}) % {len(cases)} + 1 as int))"


# --------------------------------------------------------------------- vt ----
def verbatims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatims with text (documents): one comment per document."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    return d.select(
        doc.alias("id"),
        F.concat(F.lit("T"), F.col("source")).alias("dealer"),
        F.when(doc % 29 != 0, F.concat(F.lit("M"), (doc % 12).cast("string"))).alias("model"),
        F.when(F.col("lang") == "en", "Gasolina")
        .when(F.col("lang") == "fr", "Híbrido")
        .when(F.col("lang") == "de", "Diésel")
        .otherwise("Eléctrico")
        .alias("technology"),
        F.when(doc % 37 == 0, F.lit("n/a")).otherwise((F.col("n_chars") % 8 + 1).cast("string")).alias("score_raw"),
        F.col("text").alias("comment"),
        F.date_add(F.lit("2025-01-01").cast("date"), ((doc * 7) % 120).cast("int")).alias("dt"),
        F.when(doc % 5 < 2, "Ventas").otherwise("Posventa").alias("service"),
        F.col("lang"),
    ).withColumn("score", to_number("score_raw"))


VT_SQL = """vt AS (
  SELECT doc_id AS id, 'T' || source AS dealer,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 'M' || CAST(doc_id % 12 AS VARCHAR) END AS model,
    CASE lang WHEN 'en' THEN 'Gasolina' WHEN 'fr' THEN 'Híbrido' WHEN 'de' THEN 'Diésel' ELSE 'Eléctrico' END AS technology,
    CASE WHEN doc_id % 37 = 0 THEN 'n/a' ELSE CAST(1 + n_chars % 8 AS VARCHAR) END AS score_raw,
    text AS comment,
    CAST(DATE '2025-01-01' + CAST((doc_id * 7) % 120 AS INTEGER) AS DATE) AS dt,
    CASE WHEN doc_id % 5 < 2 THEN 'Ventas' ELSE 'Posventa' END AS service,
    lang
  FROM documents),
vts AS (
  SELECT *, CASE WHEN regexp_matches(trim(score_raw), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$')
                 THEN TRY_CAST(trim(score_raw) AS DOUBLE) END AS score
  FROM vt)"""


# ---------------------------------------------------------------- delays ----
# Spanish number words, from which ``spelled`` makes all numbers below a thousand.
_BELOW_16 = "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince".split()
_TENS_ES = "diez veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
_HUNDREDS_ES = "cien doscientas trescientas cuatrocientas quinientas seiscientas setecientas ochocientas novecientas".split()


def spelled(n: int) -> str:
    """A number from 0 to 999 in Spanish words."""
    if n < 16:
        return _BELOW_16[n]
    if n < 100:
        ten, one = divmod(n, 10)
        if one == 0:
            return _TENS_ES[ten - 1]
        return {1: "dieci", 2: "veinti"}.get(ten, _TENS_ES[ten - 1] + " y ") + _BELOW_16[one]
    hundred, rest = divmod(n, 100)
    if rest == 0:
        return _HUNDREDS_ES[hundred - 1]
    return ("ciento" if hundred == 1 else _HUNDREDS_ES[hundred - 1]) + " " + spelled(rest)


def delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatims with a delay planted in front of most comments, and scores that follow the delay.

    The text is made from a number, so the oracle knows every delay without reading text.
    """
    d = table(spark, sf_dir, "documents")
    kind, i = F.col("doc_id") % 10, F.floor(F.col("doc_id") / 10)
    words = F.array(*[F.lit(spelled(n)) for n in range(1, 252)])
    word = lambda n: F.element_at(words, n.cast("int"))
    num = lambda n: n.cast("string")
    phrase = (
        F.when(kind == 1, F.concat(F.lit("Tardaron "), num(i % 60 + 1), F.lit(" horas. ")))
        .when(kind == 2, F.concat(F.lit("Esperé "), word(i % 45 + 1), F.lit(" DÍAS: ")))
        .when(kind == 3, F.concat(F.lit("Más de "), word(i % 5 + 2), F.lit(" semanas y media, ")))
        .when(kind == 4, F.concat(F.lit("Fueron "), num(i % 6 + 1), F.lit(",5 meses; ")))
        .when(kind == 5, F.concat(F.lit("Listo en "), num(i % 20 + 1), F.lit("h. ")))
        .when(kind == 6, F.when(i % 2 == 0, "Media hora. ").otherwise("medio mes! "))
        .when(kind == 7, F.concat(F.lit("Unas "), word(i % 150 + 101), F.lit(" horas. ")))
        .when(kind == 8, F.concat(F.lit("dos días y "), word(i % 23 + 1), F.lit(" horas... ")))
        .when(kind == 9, F.when(i % 2 == 0, "Un año y medio. ").otherwise("mil doscientos días. "))
        .otherwise("Sin demora. ")
    )
    base = verbatims(spark, sf_dir).select("id", "dealer", "service", "comment", "score")
    marks = d.select(F.col("doc_id").alias("id"), phrase.alias("phrase"), _planted_days(kind, i).alias("_days"))
    j = F.col("id")
    own = (F.when(F.col("_days") < 1, 8 - j % 2).when(F.col("_days") < 7, 5 + j % 2).when(F.col("_days") >= 7, 1 + j % 3)).cast("double")
    return base.join(marks, "id").select("id", "dealer", "service", F.concat("phrase", "comment").alias("comment"), F.coalesce(own, F.col("score")).alias("score"))


def _planted_days(kind: Column, i: Column) -> Column:
    return (
        F.when(kind == 1, (i % 60 + 1) / 24.0).when(kind == 2, (i % 45 + 1).cast("double")).when(kind == 3, (i % 5 + 2.5) * 7).when(kind == 4, (i % 6 + 1.5) * 30)
        .when(kind == 5, (i % 20 + 1) / 24.0).when(kind == 6, F.when(i % 2 == 0, 0.5 / 24).otherwise(15.0)).when(kind == 7, (i % 150 + 101) / 24.0).when(kind == 8, 2.0)
        .when(kind == 9, F.when(i % 2 == 0, 547.5).otherwise(1200.0))
    )


DELAYED_SQL = """planted AS (
  SELECT id, dealer, service, score AS own_score, id // 10 AS i, id % 10 AS kind FROM vts),
delays AS (
  SELECT *, CAST(CASE kind WHEN 1 THEN (i % 60 + 1) / 24.0 WHEN 2 THEN i % 45 + 1 WHEN 3 THEN (i % 5 + 2.5) * 7
    WHEN 4 THEN (i % 6 + 1.5) * 30 WHEN 5 THEN (i % 20 + 1) / 24.0 WHEN 6 THEN CASE WHEN i % 2 = 0 THEN 0.5 / 24 ELSE 15 END
    WHEN 7 THEN (i % 150 + 101) / 24.0 WHEN 8 THEN 2 WHEN 9 THEN CASE WHEN i % 2 = 0 THEN 547.5 ELSE 1200 END END AS DOUBLE) AS days
  FROM planted),
delayed AS (
  SELECT id, dealer, service, days, CASE WHEN days < 1 THEN 8 - id % 2 WHEN days < 7 THEN 5 + id % 2 WHEN days >= 7 THEN 1 + id % 3 ELSE own_score END AS score
  FROM delays)"""


# --------------------------------------------------------------------- vf ----
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large numeric fact: one scored visit per line item.

    Joins are left to the planner: at scale ``part`` is far above any broadcast
    threshold, and AQE turns a join into a broadcast at runtime only when the
    measured side is small.
    """
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(supp, li.l_suppkey == supp.s_suppkey)
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("s_name").alias("dealer"),
            F.col("p_brand").alias("model"),
            F.col("p_type").alias("technology"),
            ((F.col("l_quantity").cast("int") * 7 + F.col("l_linenumber")) % 8 + 1).cast("int").alias("score"),
            F.col("p_name").alias("comment"),
            F.col("l_shipdate").cast("date").alias("dt"),
        )
    )


VF_SQL = """vf AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    s_name AS dealer, p_brand AS model, p_type AS technology,
    CAST(1 + (CAST(l_quantity AS INTEGER) * 7 + l_linenumber) % 8 AS INTEGER) AS score,
    p_name AS comment, CAST(l_shipdate AS DATE) AS dt
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""


# ----------------------------------------------------------------- survey ----
def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate input: name keys (with nulls) and five comparable columns."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.col("c_nationkey").cast("string").alias("k1"),
        F.when(k % 11 != 0, F.col("c_mktsegment")).alias("k2"),
        (k % 2).alias("a1"),
        (k % 3).alias("a2"),
        F.floor(F.col("c_acctbal") / 2000).cast("int").alias("a3"),
        (F.col("c_acctbal") < 0).alias("a4"),
        (k % 5).alias("a5"),
    )


SURVEY_SQL = """survey AS (
  SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS k1,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS k2,
    c_custkey % 2 AS a1, c_custkey % 3 AS a2,
    CAST(floor(c_acctbal / 2000) AS INTEGER) AS a3,
    c_acctbal < 0 AS a4, c_custkey % 5 AS a5
  FROM customer)"""


# --------------------------------------------------------------- contacts ----
# Fixed literal cases (FIXTURES.md §4); each customer picks one per rule.
EMAIL_CASES = [" Ana.P@Hotmail.com ", "x@gmail.com", None, "", "a@b", "qwerty1@x.es", "1234a@x.es",
               "z@mail.com", "xnocorreo@gmail.com", "maria.lopez@empresa.es", "test@test.com"]
PHONE_CASES = ["+34 612 345 678", "0034612345678", "34612345678", "612-345-678", "666666666", "123456780",
               "111111119", "341234567", "6123456789", None, "912 345 678"]
DURATION_CASES = ["2m 15s", "3m", "40s", "1h 2m", None, "x", " 10m 5s "]
DATETIME_CASES = ["05/01/2025 09:03:04", "5/1/2025 9:03:04", "31/02/2025 10:00:00", "2025-01-05 10:00:00",
                  "", None, "28/02/2025 23:59:59"]
DATE_CASES = ["05/01/2025", "5/1/2025", "31/02/2025", "2025-01-05", "", None]
NUMBER_CASES = ["7", " 7 ", "7.5", "n/a", "7,5", "7d", "NaN", "-3", None]
ZIP_CASES = ["8001", "123456", None, "28001", "1"]
DASH_CASES = [" x-y ", "-", " - ", "\t-", "a", None]
YESNO_CASES = {
    "q_a": ["S", "n", None],
    "q_b": [None],
    "q_c": ["s", "no"],
    "q_d": ["sí", "n"],
    "q_e": ["s", "maybe"],
    "q_f": ["Y", " si ", "none", ""],
}
# Which yes/no columns the inference must turn into booleans.
YESNO_BOOLEAN = ["q_a", "q_b", "q_f"]

_CONTACT_COLS = [
    ("email", EMAIL_CASES, "c_custkey"),
    ("telefono", PHONE_CASES, "c_custkey"),
    ("tiempo_empleado", DURATION_CASES, "c_custkey"),
    ("respondido", DATETIME_CASES, "c_custkey"),
    ("enviado", DATE_CASES, "c_custkey"),
    ("puntuacion", NUMBER_CASES, "c_custkey"),
    ("codigo_postal", ZIP_CASES, "c_custkey"),
    ("marca", DASH_CASES, "c_custkey"),
] + [(name, cases, "c_custkey / 7") for name, cases in YESNO_CASES.items()]


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw, all-string contact extract: one literal case per rule and customer."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    cols = [k.alias("id")]
    for name, cases, key in _CONTACT_COLS:
        kk = k if key == "c_custkey" else F.floor(k / 7).cast("bigint")
        cols.append(_pick(cases, kk).alias(name))
    return c.select(*cols)


CONTACTS_SQL = "contacts AS (\n  SELECT c_custkey AS id,\n    " + ",\n    ".join(
    f"{_sql_pick(cases, 'c_custkey' if key == 'c_custkey' else 'CAST(floor(c_custkey / 7) AS BIGINT)')} AS {name}"
    for name, cases, key in _CONTACT_COLS
) + "\n  FROM customer)"


# -------------------------------------------------------------- ip ranges ----
def city_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City-level IP blocks: one /8 per nation-scaled block (256 blocks)."""
    i = F.col("id")
    return spark.range(0, 256).select(
        (i * 16777216).alias("ip_lo"),
        (i * 16777216 + 16777215).alias("ip_hi"),
        F.concat(F.lit("Country"), (i % 7).cast("string")).alias("country_name"),
        F.concat(F.lit("R"), (i % 17).cast("string")).alias("region"),
        F.concat(F.lit("C"), i.cast("string")).alias("city"),
        F.lpad((i * 37).cast("string"), 5, "0").alias("postal_code"),
        (i * 0.5 - 60.0).alias("latitude"),
        (i * 0.25 - 30.0).alias("longitude"),
    )


def asn_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASN blocks: the even /8 blocks only, so odd blocks miss in this database."""
    i = F.col("id")
    return spark.range(0, 256, 2).select(
        (i * 16777216).alias("ip_lo"),
        (i * 16777216 + 16777215).alias("ip_hi"),
        F.concat(F.lit("AS"), i.cast("string")).alias("asn"),
    )


IP_SQL = """city_ranges AS (
  SELECT i * 16777216 AS ip_lo, i * 16777216 + 16777215 AS ip_hi,
    'Country' || CAST(i % 7 AS VARCHAR) AS country_name, 'R' || CAST(i % 17 AS VARCHAR) AS region,
    'C' || CAST(i AS VARCHAR) AS city, lpad(CAST(i * 37 AS VARCHAR), 5, '0') AS postal_code,
    CAST(i * 0.5 - 60.0 AS DOUBLE) AS latitude, CAST(i * 0.25 - 30.0 AS DOUBLE) AS longitude
  FROM range(0, 256) t(i)),
asn_ranges AS (
  SELECT i * 16777216 AS ip_lo, i * 16777216 + 16777215 AS ip_hi, 'AS' || CAST(i AS VARCHAR) AS asn
  FROM range(0, 256, 2) t(i)),
event_ips AS (
  SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'bad'
    ELSE concat_ws('.', user_id % 223 + 1, event_id % 256, event_id % 100, 7) END AS ip
  FROM events)"""


def event_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    ip = F.concat_ws(".", (F.col("user_id") % 223 + 1).cast("string"), (eid % 256).cast("string"),
                     (eid % 100).cast("string"), F.lit("7"))
    return e.select(eid, F.when(eid % 17 == 0, F.lit(None)).when(eid % 13 == 0, F.lit("bad")).otherwise(ip).alias("ip"))


# ---------------------------------------------------------------- lookups ----
def technology_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model -> technology lookup: one row per brand (plus a duplicated brand)."""
    p = table(spark, sf_dir, "part")
    brands = p.select(F.col("p_brand").alias("model")).distinct()
    n = F.substring(F.col("model"), -1, 1).cast("int")
    tech = F.when(n % 4 == 0, "Gasolina").when(n % 4 == 1, "Diésel").when(n % 4 == 2, "Híbrido").otherwise("Eléctrico")
    dim = brands.select("model", tech.alias("tecnologia"))
    # a duplicated key multiplies matching fact rows, as a left join does
    extra = dim.where(F.col("model").endswith("11")).select("model", F.lit("Híbrido").alias("tecnologia"))
    return dim.unionByName(extra)


TECH_SQL = """tech_dim AS (
  SELECT model, CASE CAST(right(model, 1) AS INTEGER) % 4 WHEN 0 THEN 'Gasolina' WHEN 1 THEN 'Diésel'
                     WHEN 2 THEN 'Híbrido' ELSE 'Eléctrico' END AS tecnologia
  FROM (SELECT DISTINCT p_brand AS model FROM part)
  UNION ALL
  SELECT DISTINCT p_brand AS model, 'Híbrido' AS tecnologia FROM part WHERE p_brand LIKE '%11')"""


def income_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal code -> mean income; codes are stored unpadded, as in a spreadsheet."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        (F.col("n_nationkey") * 37).cast("string").alias("codigo_postal"),
        (F.col("n_regionkey") * 1000 + F.col("n_nationkey") * 10 + 20000).cast("double").alias("renta_media"),
    )


INCOME_SQL = """income_dim AS (
  SELECT CAST(n_nationkey * 37 AS VARCHAR) AS codigo_postal,
         CAST(n_regionkey * 1000 + n_nationkey * 10 + 20000 AS DOUBLE) AS renta_media
  FROM nation)"""


def with_views(sql: str, *views: str) -> str:
    """Prefix a query with the named fixture views as CTEs."""
    return "WITH " + ",\n".join(views) + "\n" + sql
