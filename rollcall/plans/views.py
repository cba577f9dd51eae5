"""Logical input tables (staff panel, payroll records, paths, ...) derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import inline_table
from ..sources.tables import table
from . import settings as S


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Nation with its region. Both tables have a fixed size (25 and 5 rows), so the hint is safe."""
    nation = table(spark, d, "nation")
    region = table(spark, d, "region")
    return F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
                       .select("n_nationkey", "n_name", "r_name"))


def panel_base(spark: SparkSession, d: str) -> DataFrame:
    """Person-years without exits. Orders are summed to one row per person and year before any join."""
    orders = table(spark, d, "orders")
    years = (orders.groupBy(F.col("o_custkey").alias("person_id"), F.year("o_orderdate").alias("year"))
             .agg(F.sum("o_totalprice").alias("spend")))
    by_person = Window.partitionBy("person_id")  # at most one row per calendar year
    years = years.withColumn("first_year", F.min("year").over(by_person))
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    spend = F.col("spend")
    return (years.join(cust, years.person_id == cust.c_custkey)
            .join(_units(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                "person_id", "year",
                (20 + F.col("person_id") % 40 + F.col("year") - S.PANEL_START).cast("int").alias("age"),
                (F.col("year") - F.col("first_year") + F.when(F.col("person_id") % 4 == 0, 3).otherwise(0))
                .cast("int").alias("service"),
                F.col("r_name").alias("sector"),
                F.when(spend >= 900000, "A").when(spend >= 500000, "B").when(spend >= 200000, "C")
                .otherwise("D").alias("framework"),
                (F.col("person_id") % 8 == 0).alias("eligible60"),
                F.col("n_name").alias("ministry"), F.col("c_mktsegment").alias("province")))


def panel(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ingest import infer_exits, infer_promotions
    p = infer_promotions(infer_exits(panel_base(spark, d)), S.FRAMEWORKS)
    died = (F.col("exit_type") != "") & (F.col("person_id") % 29 == 0)
    return p.withColumn("exit_type", F.when(died, "death").otherwise(F.col("exit_type")))


def records(spark: SparkSession, d: str) -> DataFrame:
    """One payroll record per order line."""
    li = table(spark, d, "lineitem")
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    supp = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .join(supp, li.l_suppkey == supp.s_suppkey)
            .join(_units(spark, d), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                # every column that tells two lines apart: the first four repeat once in the smallest test set
                F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"),
                            F.col("l_shipdate").cast("date")).alias("record_id"),
                (F.col("l_orderkey") * 10000 + F.col("l_partkey") % 50).alias("national_id"),
                (F.col("l_suppkey") * 100000 + F.col("l_orderkey")).alias("bank_account"),
                F.concat_ws("/", "p_name", "l_suppkey").alias("full_name"),
                F.col("l_shipdate").cast("date").alias("birth_date"), F.col("l_linestatus").alias("sex"),
                F.col("l_linestatus").alias("sector"), F.col("l_returnflag").alias("framework"),
                F.col("n_name").alias("ministry"), F.col("r_name").alias("province"),
                F.col("l_linenumber").alias("service"), (20 + F.col("p_size")).alias("age"),
                (F.col("l_suppkey") % 8 == 0).alias("eligible60"),
                F.col("l_extendedprice").alias("basic_salary"),
                (F.col("l_extendedprice") * F.col("l_tax")).alias("allowance"),
                (F.col("l_quantity").cast("int") % 10).alias("attendance_days_q"),
                (F.col("p_retailprice") * F.col("l_quantity")).alias("expected")))


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Run x year rates: a user is a run, a day is a year; days without events count as zero."""
    ev = table(spark, d, "events")
    daily = (ev.groupBy(F.col("user_id").alias("run"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01")).alias("t"))
             .agg(F.avg("value").alias("x")))
    # a longer history than the model's horizon is an error, not a shorter result
    daily = daily.withColumn("t", F.when(F.col("t").between(0, S.PATH_YEARS - 1), F.col("t"))
                             .otherwise(F.raise_error(F.concat(F.lit("event outside the path years: "), F.col("t").cast("string"))).cast("int")))
    # partitioned by run once: paths, flows and ledgers of a run all stay where this puts them
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_run = daily.repartition(parts, "run").groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("t", "x"))).alias("days"))
    x = F.coalesce(F.element_at("days", F.col("t")), F.lit(0.0))
    return (by_run.select("run", "days", F.explode(F.sequence(F.lit(0), F.lit(S.PATH_YEARS - 1))).alias("t"))
            .select("run", "t", (S.BASE_YEAR + F.col("t")).alias("year"), x.alias("x"))
            .select("run", "t", "year", (F.col("x") * 0.0001).alias("real_growth"),
                    (F.col("x") * 0.00005).alias("inflation"), (F.col("x") * 0.00002).alias("real_return"),
                    (0.2 + F.col("x") * 0.00001).alias("revenue_share"),
                    (0.9 + 0.02 * (F.col("run") % 11)).alias("mortality_mult")))


def level_paths(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scenarios import level_index
    return level_index(paths(spark, d))


def scenarios(spark: SparkSession) -> DataFrame:
    return F.broadcast(inline_table(spark, S.SCENARIOS, S.SCENARIO_SCHEMA))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Value per (sector, ministry, province, year), every year of the orders."""
    orders = table(spark, d, "orders")
    per = (orders.groupBy("o_custkey", F.year("o_orderdate").alias("year"))
           .agg(F.sum("o_totalprice").alias("spend")))
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (per.join(cust, per.o_custkey == cust.c_custkey)
            .join(_units(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("r_name").alias("sector"), F.col("n_name").alias("ministry"),
                     F.col("c_mktsegment").alias("province"), "year")
            .agg((F.sum("spend") / 1e6).alias("value")))


def macro(spark: SparkSession, d: str) -> DataFrame:
    """Monthly series in long form (series, t, value): growth, inflation, revenue share."""
    from ..functions.keys import unpivot_structs
    li = table(spark, d, "lineitem")
    month = (li.groupBy((F.year("l_shipdate") * 12 + F.month("l_shipdate") - (S.PANEL_START * 12 + 1)).alias("t"))
             .agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("v"),
                  (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("share")))
    w = Window.orderBy("t")  # one row per calendar month
    prev_q, prev_p = F.lag("q").over(w), F.lag(F.col("v") / F.col("q")).over(w)
    wide = month.select("t", (F.col("q") / prev_q - 1).alias("real_growth"),
                        (F.col("v") / F.col("q") / prev_p - 1).alias("inflation"), "share").where("real_growth is not null")
    return unpivot_structs(wide, ["t"], [
        F.struct(F.lit("real_growth").alias("series"), F.col("real_growth").alias("value")),
        F.struct(F.lit("inflation").alias("series"), F.col("inflation").alias("value")),
        F.struct(F.lit("revenue_share").alias("series"), F.col("share").alias("value"))], ["series", "value"]
    ).select("series", "t", "value")


def retirees(spark: SparkSession, d: str) -> DataFrame:
    """Retirement exits by year index and cohort."""
    return (panel(spark, d).where("exit_type = 'retirement'")
            .groupBy((F.col("year") - S.PANEL_START).alias("t"), "sector", "framework", "age", "service")
            .agg(F.count("*").alias("n")))


def stocks(spark: SparkSession, d: str) -> DataFrame:
    """Staff by year index and cohort."""
    from ..operators.panel import cohort_stock
    p = panel_base(spark, d).withColumn("t", F.col("year") - S.PANEL_START)
    return cohort_stock(p, extra=["t"])


def flagged_docs(spark: SparkSession, d: str) -> DataFrame:
    """All documents with rule, matching and truth columns (null without a label): the detector-scoring input."""
    from ..operators.quality import later_duplicates
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("record_id"), F.sha2("text", 256).alias("text_key"), "lang",
        F.col("n_chars").cast("double").alias("pay"), "source",
        ((F.length("text") < 60) | (F.length("text") > 20000)).alias("length_rule"),
        F.col("text").rlike("[0-9]").alias("digit_rule"))
    docs = later_duplicates(docs, ["text_key", "lang"], "record_id", "copy_flag")
    labels = table(spark, d, "labels")
    truth = labels.select(F.col("doc_id").alias("record_id"),
                          F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality")
                          .otherwise("none").alias("anomaly"))
    return (docs.join(truth, "record_id", "left").withColumns({
        "rule_flag": F.col("length_rule") | F.col("digit_rule"),
        "flag": F.col("length_rule") | F.col("digit_rule") | F.col("copy_flag")}))


def register(spark: SparkSession, d: str) -> DataFrame:
    """Pensioner register from the customer table."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("pensioner_id"), (40 + F.col("c_custkey") % 60).cast("int").alias("age"),
                    F.col("c_acctbal").alias("monthly_pension"))
