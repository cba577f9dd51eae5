"""Queries: ingest and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import shared_path
from ..operators import ingest as I
from ..sources.tables import SCHEMAS, load_table, save_table, table
from . import settings as S
from . import views as V
from .registry import query
from .sqlviews import sql

SECTORS = ("1-urgent", "2-high", "3-medium", "4-not_specified", "5-low")
GRADES = ("F", "O", "P")


def raw_upload(spark, d):
    """An untidy upload: padded codes, unknown codes, text in number columns, odd column names."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    text = F.col("o_orderpriority")
    return o.select(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("Person ID"),
        F.when(k % 211 == 0, "").otherwise(F.year("o_orderdate").cast("string")).alias("Snapshot Year"),
        F.when(k % 101 == 0, "n/a").when(k % 7 == 0, F.concat((20 + F.col("o_custkey") % 40).cast("string"), F.lit(".5")))
        .otherwise((20 + F.col("o_custkey") % 40).cast("string")).alias(" Age "),
        (k % 30 - 2).cast("string").alias("Service"),
        F.when(k % 97 == 0, F.concat(F.lit("Dept "), (k % 7).cast("string"))).when(k % 2 == 0, F.upper(text))
        .otherwise(F.concat(F.lit(" "), text, F.lit(" "))).alias("Sector"),
        F.when(k % 89 == 0, F.concat(F.lit("x"), (k % 9).cast("string")))
        .otherwise(F.concat(F.lower("o_orderstatus"), F.lit(" "))).alias("Framework"),
        F.when(k % 8 == 0, "Yes").when(k % 8 == 1, " TRUE").when(k % 8 == 2, "1").when(k % 8 == 3, "no")
        .when(k % 8 == 4, F.lit(None)).otherwise("false").alias("Eligible60"),
        F.col("o_totalprice").alias("Basic Salary"))


UPLOAD = """WITH upload AS (
  SELECT ' ' || o_custkey AS person_id,
    CASE WHEN o_orderkey % 211 = 0 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS snapshot_year,
    CASE WHEN o_orderkey % 101 = 0 THEN 'n/a' WHEN o_orderkey % 7 = 0 THEN (20 + o_custkey % 40) || '.5'
      ELSE CAST(20 + o_custkey % 40 AS VARCHAR) END AS age,
    CAST(o_orderkey % 30 - 2 AS VARCHAR) AS service,
    CASE WHEN o_orderkey % 97 = 0 THEN 'Dept ' || (o_orderkey % 7) WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority)
      ELSE ' ' || o_orderpriority || ' ' END AS sector,
    CASE WHEN o_orderkey % 89 = 0 THEN 'x' || (o_orderkey % 9) ELSE lower(o_orderstatus) || ' ' END AS framework,
    CASE o_orderkey % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN ' TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN NULL
      ELSE 'false' END AS eligible60,
    o_totalprice AS basic_salary
  FROM orders),
codes AS (SELECT *, replace(lower(trim(sector)), ' ', '_') AS s, upper(trim(framework)) AS f FROM upload)
"""


@query("a01_load_table", sql("", """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS pay,
  MIN(CAST(l_shipdate AS DATE)) AS first_day FROM lineitem GROUP BY 1, 2"""))
def load(spark, d):
    df = load_table(spark, f"{d}/lineitem.parquet", SCHEMAS["lineitem"])
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("pay"),
        F.min(F.col("l_shipdate").cast("date")).alias("first_day"))


BAD_LINE = "o_orderkey % 50 = 0 OR o_orderkey % 70 = 7"


@query("a01_rejected_rows", sql("", f"""
SELECT source, o_orderstatus, COUNT(*) AS n, COUNT(*) FILTER (WHERE {BAD_LINE}) AS rejected, ROUND(SUM(o_totalprice) FILTER (WHERE NOT ({BAD_LINE})), 2) AS pay,
  SUM(o_custkey) FILTER (WHERE NOT ({BAD_LINE})) AS custkeys
FROM orders CROSS JOIN (VALUES ('csv'), ('csv.gz'), ('partitioned')) AS v(source) GROUP BY 1, 2"""))
def rejected(spark, d):
    """An upload with text in number columns, as CSV, compressed CSV and a folder per status: lines that do not fit the
    schema are kept and counted, the others are read whole."""
    k = F.col("o_orderkey")
    lines = table(spark, d, "orders").select(
        k.cast("string").alias("o_orderkey"), F.when(k % 50 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit("x"))).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(k % 70 == 7, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"), "o_orderstatus")
    base, out = shared_path(spark), None
    for source, how in (("csv", {}), ("csv.gz", {"compression": "gzip"}), ("partitioned", {"partition_by": ["o_orderstatus"]})):
        save_table(lines, f"{base}/{source}", "csv", **how)
        status = "" if "partition_by" in how else ", o_orderstatus string"
        back = load_table(spark, f"{base}/{source}", f"o_orderkey bigint, o_custkey bigint, o_totalprice double{status}", "csv")
        good = F.col("_corrupt_record").isNull()
        n = back.groupBy(F.lit(source).alias("source"), "o_orderstatus").agg(
            F.count("*").alias("n"), F.count_if(~good).alias("rejected"), F.round(F.sum(F.when(good, F.col("o_totalprice"))), 2).alias("pay"),
            F.sum(F.when(good, F.col("o_custkey"))).alias("custkeys"))
        out = n if out is None else out.unionByName(n)
    return out


@query("a02_normalise_columns", sql("", UPLOAD + """
SELECT trim(person_id) AS person_id, COUNT(*) AS n, ROUND(SUM(basic_salary), 2) AS basic_salary FROM upload GROUP BY 1"""))
def normalise(spark, d):
    return (I.normalise_columns(raw_upload(spark, d)).groupBy(F.trim("person_id").alias("person_id"))
            .agg(F.count("*").alias("n"), F.round(F.sum("basic_salary"), 2).alias("basic_salary")))


@query("a03_check_required", sql("", UPLOAD + """
SELECT 'person_id' AS "column", TRUE AS present, COUNT(person_id) AS filled FROM upload
UNION ALL SELECT 'eligible60', TRUE, COUNT(eligible60) FROM upload
UNION ALL SELECT 'basic_salary', TRUE, COUNT(basic_salary) FROM upload
UNION ALL SELECT 'allowance', FALSE, 0"""))
def required(spark, d):
    upload, required = I.normalise_columns(raw_upload(spark, d)), ["person_id", "eligible60", "basic_salary", "allowance"]
    return I.check_required(upload, required).join(F.broadcast(I.filled_counts(upload, required).drop("present")), "column")


@query("a04_canonicalise_codes", sql("", UPLOAD + f""",
bad AS (
  SELECT 'sector' AS "column", s AS code, COUNT(*) AS n FROM codes WHERE s NOT IN {SECTORS} GROUP BY 2
  UNION ALL SELECT 'framework', f, COUNT(*) FROM codes WHERE f NOT IN {GRADES} GROUP BY 2),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY code) AS rn FROM bad)
SELECT "column", CAST(SUM(n) AS BIGINT) AS bad_rows, COUNT(*) AS unknown_codes,
  string_agg(code, ',' ORDER BY code) FILTER (WHERE rn <= 5) AS examples FROM ranked GROUP BY 1"""))
def codes(spark, d):
    df = I.canonicalise_codes(I.normalise_columns(raw_upload(spark, d)), {"sector": False, "framework": True})
    return I.unknown_codes(df, {"sector": SECTORS, "framework": GRADES})


@query("a05_coerce_numeric", sql("", UPLOAD + """
SELECT 'snapshot_year' AS "column", COUNT(*) FILTER (WHERE TRY_CAST(snapshot_year AS DOUBLE) IS NULL) AS failed FROM upload
UNION ALL SELECT 'age', COUNT(*) FILTER (WHERE TRY_CAST(age AS DOUBLE) IS NULL) FROM upload
UNION ALL SELECT 'service', COUNT(*) FILTER (WHERE TRY_CAST(service AS DOUBLE) IS NULL) FROM upload"""))
def numeric(spark, d):
    return I.numeric_failures(I.normalise_columns(raw_upload(spark, d)), ["snapshot_year", "age", "service"])


@query("a06_parse_truthy", sql("", UPLOAD + """
SELECT COALESCE(lower(trim(eligible60)) IN ('true', '1', 'yes', 'y'), FALSE) AS eligible60, COUNT(*) AS n
FROM upload GROUP BY 1"""))
def truthy(spark, d):
    df = I.normalise_columns(raw_upload(spark, d))
    return df.groupBy(I.parse_truthy("eligible60").alias("eligible60")).agg(F.count("*").alias("n"))


@query("a07_fill_optional", sql("", f"""
WITH r AS (
  SELECT c_custkey AS key, r_name AS sector, CAST(20 + c_custkey % 40 AS INT) AS age, c_acctbal AS basic_salary
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT key, sector, age, 'Unknown' AS ministry, 'U' AS sex, 60 AS attendance_days_q,
  ROUND(basic_salary * CASE sector WHEN 'AFRICA' THEN 0.35 WHEN 'AMERICA' THEN 0.40 WHEN 'ASIA' THEN 0.30
    WHEN 'EUROPE' THEN 0.25 ELSE 0.20 END, 4) AS allowance,
  make_date({S.BASE_YEAR} - age, 1, 1) AS birth_date, {S.BASE_YEAR} - age AS birth_year,
  'id-' || key AS national_id, 'row-' || key AS full_name FROM r"""))
def fill(spark, d):
    c = table(spark, d, "customer").join(V._units(spark, d), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("key"), F.col("r_name").alias("sector"), (20 + F.col("c_custkey") % 40).cast("int").alias("age"),
        F.col("c_acctbal").alias("basic_salary"))
    out = I.fill_optional(c, "key", S.BASE_YEAR, S.ALLOWANCE, {"ministry": "Unknown", "sex": "U", "attendance_days_q": 60})
    return out.select("key", "sector", "age", "ministry", "sex", "attendance_days_q",
                      F.round("allowance", 4).alias("allowance"), "birth_date", "birth_year", "national_id", "full_name")


@query("a07_fill_notes", sql("", """
SELECT c AS "column", n AS "rows" FROM (SELECT COUNT(*) AS n FROM customer)
CROSS JOIN (VALUES ('allowance'), ('sex')) AS v(c)"""))
def notes(spark, d):
    return I.fill_notes(table(spark, d, "customer"), ["allowance", "sex", "c_acctbal"])


@query("a08_duplicate_keys", sql("", """
SELECT CAST(SUM(n - 1) AS BIGINT) AS repeated_rows, COUNT(*) AS repeated_keys FROM (
  SELECT o_custkey, year(o_orderdate), COUNT(*) AS n FROM orders GROUP BY 1, 2 HAVING COUNT(*) > 1)"""))
def duplicates(spark, d):
    return I.duplicate_keys(table(spark, d, "orders").withColumn("year", F.year("o_orderdate")), ["o_custkey", "year"])


@query("a09_period_coverage", sql("", """
WITH p AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS p, COUNT(*) AS rows FROM orders GROUP BY 1),
s AS (SELECT *, LEAD(p) OVER (ORDER BY p) - p AS step FROM p)
SELECT COUNT(*) AS periods, MIN(p) AS "first", MAX(p) AS "last", COUNT(*) FILTER (WHERE step <> 1) AS gaps,
  CAST(SUM(rows - 1) AS BIGINT) AS repeated, COUNT(*) < 6 AS too_few FROM s"""))
def coverage(spark, d):
    o = table(spark, d, "orders")
    return I.period_coverage(o.select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("p")), "p", 6)


@query("a10_infer_exits", sql("panel_base", """
WITH e AS (SELECT *, LEAD(year) OVER (PARTITION BY person_id ORDER BY year) AS nx, MAX(year) OVER () AS ly FROM panel_base)
SELECT person_id, year, CASE WHEN nx IS NULL AND year < ly THEN
  CASE WHEN age >= CASE WHEN eligible60 THEN 60 ELSE 55 END THEN 'retirement' ELSE 'separation' END ELSE '' END AS exit_type,
  nx IS NULL AND year < ly AS "exit" FROM e"""))
def exits(spark, d):
    return I.infer_exits(V.panel_base(spark, d)).select("person_id", "year", "exit_type", "exit")


@query("a11_normalise_exit_type", sql("", """
WITH t AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN ' None' WHEN 1 THEN 'stay' WHEN 2 THEN NULL WHEN 3 THEN 'Retirement '
  WHEN 4 THEN 'DEATH' ELSE 'fired' || o_orderstatus END AS e FROM orders),
n AS (SELECT CASE WHEN lower(trim(COALESCE(e, ''))) IN ('none', 'nan', 'stay') THEN '' ELSE lower(trim(COALESCE(e, ''))) END AS exit_type FROM t)
SELECT exit_type, COUNT(*) AS n, exit_type NOT IN ('', 'retirement', 'death', 'separation') AS unknown FROM n GROUP BY 1"""))
def exit_types(spark, d):
    k = F.col("o_orderkey")
    raw = table(spark, d, "orders").select(
        F.when(k % 6 == 0, " None").when(k % 6 == 1, "stay").when(k % 6 == 2, F.lit(None)).when(k % 6 == 3, "Retirement ")
        .when(k % 6 == 4, "DEATH").otherwise(F.concat(F.lit("fired"), "o_orderstatus")).alias("exit_type"))
    return (raw.groupBy(I.normalise_exit_type().alias("exit_type")).agg(F.count("*").alias("n"))
            .withColumn("unknown", ~F.col("exit_type").isin("", "retirement", "death", "separation")))


@query("a12_infer_promotions", sql("panel", """
SELECT framework, year, COUNT(*) FILTER (WHERE promoted) AS promoted, COUNT(*) AS n FROM panel GROUP BY 1, 2"""))
def promotions(spark, d):
    p = I.infer_promotions(V.panel_base(spark, d), S.FRAMEWORKS)
    return p.groupBy("framework", "year").agg(F.count_if("promoted").alias("promoted"), F.count("*").alias("n"))


@query("a13_detect_percent_units", sql("", """
WITH x AS (SELECT l_returnflag, l_discount AS a, l_discount * 100 AS b FROM lineitem),
m AS (SELECT median(abs(a)) > 1 AS pa, median(abs(b)) > 1 AS pb FROM x)
SELECT l_returnflag, ROUND(AVG(CASE WHEN pa THEN a / 100 ELSE a END), 8) AS a,
  ROUND(AVG(CASE WHEN pb THEN b / 100 ELSE b END), 8) AS b FROM x, m GROUP BY 1"""))
def percent(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", F.col("l_discount").alias("a"),
                                           (F.col("l_discount") * 100).alias("b"))
    return (I.detect_percent_units(x, ["a", "b"]).groupBy("l_returnflag")
            .agg(F.round(F.avg("a"), 8).alias("a"), F.round(F.avg("b"), 8).alias("b")))


@query("a14_range_checks", sql("", """
SELECT 'l_discount' AS "column", COUNT(*) FILTER (WHERE NOT l_discount BETWEEN 0.02 AND 0.6) AS outside,
  MIN(l_discount) AS lowest, MAX(l_discount) AS highest FROM lineitem
UNION ALL SELECT 'l_quantity', COUNT(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 40), MIN(l_quantity), MAX(l_quantity)
FROM lineitem"""))
def ranges(spark, d):
    return I.range_checks(table(spark, d, "lineitem"), {"l_discount": (0.02, 0.6), "l_quantity": (1.0, 40.0)})


@query("a14_ends_before", sql("", f"""
SELECT CAST(MAX(year(o_orderdate)) AS INT) AS "last", MAX(year(o_orderdate)) < {S.BASE_YEAR - 1} AS short FROM orders"""))
def short(spark, d):
    return I.ends_before(table(spark, d, "orders").select(F.year("o_orderdate").alias("year")), "year", S.BASE_YEAR)


@query("a15_tables_match", sql("cells", """
WITH b AS (SELECT sector, ministry, province, year, value + CASE WHEN year = 1997 AND province = 'BUILDING' THEN 0.5
    ELSE 1e-9 END AS value FROM cells WHERE NOT (year = 1999 AND sector = 'ASIA')),
j AS (SELECT a.value AS va, b.value AS vb FROM cells a FULL JOIN b USING (sector, ministry, province, year))
SELECT COUNT(*) FILTER (WHERE vb IS NULL) AS only_first, COUNT(*) FILTER (WHERE va IS NULL) AS only_second,
  COUNT(*) FILTER (WHERE abs(va - vb) > 1e-6) AS different,
  COUNT(*) FILTER (WHERE vb IS NULL OR va IS NULL OR abs(va - vb) > 1e-6) = 0 AS "match" FROM j"""))
def match(spark, d):
    a = V.cells(spark, d)
    b = (a.where(~((F.col("year") == 1999) & (F.col("sector") == "ASIA")))
         .withColumn("value", F.col("value") + F.when((F.col("year") == 1997) & (F.col("province") == "BUILDING"), 0.5)
                     .otherwise(1e-9)))
    return I.tables_match(a, b, ["sector", "ministry", "province", "year"], ["value"], 1e-6)


@query("a15_table_fingerprint")
def fingerprint(spark, d):
    return I.table_fingerprint(table(spark, d, "lineitem"))


@query("a16_clean_register", sql("register", """
WITH r AS (SELECT pensioner_id, CASE WHEN pensioner_id % 53 = 0 THEN 'unknown' ELSE (age - 5 + pensioner_id % 3) || '.5' END AS age,
  CASE WHEN pensioner_id % 41 = 0 THEN NULL ELSE CAST(monthly_pension AS VARCHAR) END AS monthly_pension FROM register),
c AS (SELECT pensioner_id, TRY_CAST(age AS DOUBLE) AS age, TRY_CAST(monthly_pension AS DOUBLE) AS monthly_pension FROM r)
SELECT pensioner_id, CAST(LEAST(GREATEST(CASE WHEN age - floor(age) = 0.5 THEN 2 * round(age / 2) ELSE round(age) END, 40), 110) AS INT) AS age,
  monthly_pension FROM c WHERE age IS NOT NULL AND monthly_pension IS NOT NULL"""))
def register(spark, d):
    r = V.register(spark, d)
    k = F.col("pensioner_id")
    raw = r.select("pensioner_id",
                   F.when(k % 53 == 0, "unknown").otherwise(F.concat((F.col("age") - 5 + k % 3).cast("string"), F.lit(".5"))).alias("age"),
                   F.when(k % 41 == 0, F.lit(None)).otherwise(F.col("monthly_pension").cast("string")).alias("monthly_pension"))
    return I.clean_register(raw)


@query("a17_panel_profile", sql("panel", """
SELECT COUNT(*) AS person_years, COUNT(DISTINCT person_id) AS people, MIN(year) AS first_year, MAX(year) AS last_year,
  ROUND(AVG(CASE WHEN exit_type = 'separation' THEN 1.0 ELSE 0.0 END), 8) AS separation_rate FROM panel"""))
def profile(spark, d):
    return I.panel_profile(V.panel(spark, d)).withColumn("separation_rate", F.round("separation_rate", 8))
