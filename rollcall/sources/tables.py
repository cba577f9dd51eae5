"""Reading and writing tables with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Logical tables a user brings (the upload contract).
PANEL_SCHEMA = ("person_id string, year int, age int, service int, sector string, framework string, "
                "eligible60 boolean, exit boolean, exit_type string, promoted boolean, province string, ministry string")
PAYROLL_SCHEMA = ("record_id bigint, person_id bigint, national_id bigint, full_name string, birth_date date, "
                  "age int, sex string, sector string, ministry string, province string, framework string, "
                  "service int, eligible60 boolean, basic_salary double, allowance double, "
                  "attendance_days_q int, bank_account bigint")
PENSIONER_SCHEMA = "pensioner_id bigint, age int, monthly_pension double"
MACRO_SCHEMA = "year int, real_growth double, inflation double, revenue_share_gdp double"
FORECAST_SCHEMA = ("task string, series string, origin int, h int, year int, q10 double, q50 double, q90 double, "
                   "model string")


def load_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str | None = None) -> DataFrame:
    """Read Parquet or CSV (plain or .csv.gz) with a declared schema.

    CSV rows that do not fit the schema are kept, with the raw line in ``_corrupt_record``.
    """
    fmt = fmt or ("csv" if ".csv" in path.lower() else "parquet")
    if fmt == "parquet":
        reader = spark.read
        return (reader.schema(schema) if schema else reader).parquet(path)
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return reader.csv(path)
    return (reader.option("columnNameOfCorruptRecord", "_corrupt_record")
            .schema(f"{schema}, _corrupt_record string").csv(path))


def save_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
               mode: str = "errorifexists", compression: str | None = None) -> None:
    """Write a result table, optionally partitioned and compressed; one directory per table."""
    writer = df.write.mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def spread(df: DataFrame) -> DataFrame:
    """Use every core for heavy per-row work on a table scan with fewer splits than cores.

    Only small inputs are shuffled: a scan that already has a split per core is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
