"""Validation and completion of uploaded tables.

Checks return issue tables; nothing is collected. Staff panels hold one row per person and year, so a
window over one person is bounded by the number of calendar years.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import inline_table, keyed_lookup, unpivot_structs

TRUTHY = ("true", "1", "yes", "y")  # fixed values


def normalise_columns(df: DataFrame) -> DataFrame:
    """Column names trimmed, lower-cased, spaces to underscores."""
    return df.toDF(*[re.sub(" ", "_", c.strip().lower()) for c in df.columns])


def check_required(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per required column: is it there. Reads the schema only, no data."""
    return inline_table(df.sparkSession, [(c, c in df.columns) for c in required], "column string, present boolean")


def filled_counts(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per required column: is it there, and how many rows have it filled (one scan)."""
    wide = df.agg(*[(F.count(c) if c in df.columns else F.lit(0).cast("bigint")).alias(f"n{i}")
                    for i, c in enumerate(required)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), F.col(f"n{i}").alias("filled"))
            for i, c in enumerate(required)]
    return unpivot_structs(wide, [], rows, ["column", "present", "filled"])


def canonical_code(col: str, upper: bool = False) -> Column:
    """Codes with outer blanks and case removed, inner blanks as underscores."""
    text = F.trim(F.col(col).cast("string"))
    return F.upper(text) if upper else F.regexp_replace(F.lower(text), " ", "_")


def canonicalise_codes(df: DataFrame, upper: dict[str, bool]) -> DataFrame:
    return df.withColumns({c: canonical_code(c, up) for c, up in upper.items()})


def unknown_codes(df: DataFrame, domains: dict[str, tuple[str, ...]], show: int = 5) -> DataFrame:
    """Per column: rows with a code outside its domain, distinct unknown codes, and the first few of them."""
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("code"), (~F.col(c).isin(*dom)).alias("bad"))
            for c, dom in domains.items()]
    long = unpivot_structs(df.select(*domains), [], rows, ["column", "code", "bad"])
    codes = long.where("bad").groupBy("column", "code").agg(F.count("*").alias("n"))
    # `show` codes per column survive the ranking; the rest is counted before it
    totals = codes.groupBy("column").agg(F.sum("n").alias("bad_rows"), F.count("*").alias("unknown_codes"))
    first = _smallest(codes, "column", "code", show)
    return totals.join(first, "column")


def _smallest(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k smallest distinct values per group as one string; Spark keeps k per task before the shuffle."""
    top = Window.partitionBy(group).orderBy(value)
    return (df.select(group, value).withColumn("_rn", F.row_number().over(top)).where(F.col("_rn") <= k)
            .groupBy(group).agg(F.concat_ws(",", F.array_sort(F.collect_list(value))).alias("examples")))


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns as double; text that is not a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def numeric_failures(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per column that are missing or not a number."""
    wide = df.agg(*[F.count_if(F.col(c).try_cast("double").isNull()).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("failed")) for c in cols]
    return unpivot_structs(wide, [], rows, ["column", "failed"])


def parse_truthy(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin(*TRUTHY), F.lit(False))


def fill_optional(df: DataFrame, key: str, base_year: int, allowance_rate: dict[str, float],
                  constants: dict[str, object]) -> DataFrame:
    """Add the optional payroll columns that are absent.

    Constants first; then allowance from the sector rate, birth date from the age, and per-row
    placeholders for national id, name and account built from the row key (unique when the key is).
    """
    new: dict[str, Column] = {c: F.lit(v) for c, v in constants.items() if c not in df.columns}
    if "allowance" not in df.columns:
        new["allowance"] = F.col("basic_salary") * keyed_lookup(allowance_rate, "sector")
    if "birth_date" not in df.columns:
        new["birth_date"] = F.make_date(base_year - F.col("age"), F.lit(1), F.lit(1))
    if "birth_year" not in df.columns:
        new["birth_year"] = base_year - F.col("age")
    for c, mark in (("national_id", "id-"), ("full_name", "row-"), ("bank_account", "acct-")):
        if c not in df.columns:
            new[c] = F.concat(F.lit(mark), F.col(key).cast("string"))
    return df.withColumns(new) if new else df


def fill_notes(df: DataFrame, optional: list[str]) -> DataFrame:
    """Which optional columns a table lacks, with the number of rows the default applies to."""
    missing = [c for c in optional if c not in df.columns]
    wide = df.agg(F.count("*").alias("rows"))
    if not missing:
        return wide.select(F.lit("").alias("column"), "rows").where(F.lit(False))
    rows = [F.struct(F.lit(c).alias("column"), F.col("rows")) for c in missing]
    return unpivot_structs(wide, [], rows, ["column", "rows"])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows repeat an earlier row's key, and how many keys are affected."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated_rows"),
                      F.count("*").alias("repeated_keys"))


def period_coverage(df: DataFrame, col: str, min_n: int) -> DataFrame:
    """Distinct periods, first, last, gaps between neighbours, whether there are enough, repeated rows."""
    periods = df.groupBy(F.col(col).alias("p")).agg(F.count("*").alias("rows"))
    w = Window.orderBy("p")  # one row per calendar period
    return (periods.withColumn("step", F.lead("p").over(w) - F.col("p"))
            .agg(F.count("*").alias("periods"), F.min("p").alias("first"), F.max("p").alias("last"),
                 F.count_if(F.col("step") != 1).alias("gaps"),
                 F.sum(F.col("rows") - 1).alias("repeated"),
                 (F.count("*") < min_n).alias("too_few")))


def infer_exits(panel: DataFrame, standard_age: int = 55, extended_age: int = 60) -> DataFrame:
    """A person's last row before the final period is an exit: retirement at retirement age, else separation."""
    w = Window.partitionBy("person_id").orderBy("year")  # one row per year and person
    last_year = panel.agg(F.max("year")).scalar()
    left = F.lead("year").over(w).isNull() & (F.col("year") < last_year)
    limit = F.when(F.col("eligible60"), extended_age).otherwise(standard_age)
    kind = F.when(left, F.when(F.col("age") >= limit, "retirement").otherwise("separation")).otherwise("")
    return panel.withColumn("exit_type", kind).withColumn("exit", F.col("exit_type") != "")


def normalise_exit_type(col: str = "exit_type") -> Column:
    """Blank, none, nan and stay mean no exit."""
    text = F.lower(F.trim(F.coalesce(F.col(col), F.lit(""))))
    return F.when(text.isin("none", "nan", "stay"), "").otherwise(text)


def infer_promotions(panel: DataFrame, seniority: tuple[str, ...]) -> DataFrame:
    """A more senior framework in the very next year counts as a promotion."""
    w = Window.partitionBy("person_id").orderBy("year")
    rank = keyed_lookup({f: i for i, f in enumerate(seniority)}, "framework")
    hit = (F.lead("year").over(w) == F.col("year") + 1) & (F.lead(rank).over(w) < rank)
    return panel.withColumn("promoted", F.coalesce(hit, F.lit(False)))


def percent_units(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: does the median absolute value exceed 1 (percentages rather than shares)?

    The test needs no sort: it follows from the count at or below 1 and the two values next to 1.
    """
    aggs = []
    for c in cols:
        a = F.abs(F.col(c))
        aggs += [F.count(c).alias(f"n_{c}"), F.count_if(a <= 1).alias(f"k_{c}"),
                 F.max(F.when(a <= 1, a)).alias(f"lo_{c}"), F.min(F.when(a > 1, a)).alias(f"hi_{c}")]
    wide = df.agg(*aggs)

    def verdict(c: str) -> Column:
        n, k = F.col(f"n_{c}"), F.col(f"k_{c}")
        return F.coalesce(F.when(2 * k == n, F.col(f"lo_{c}") + F.col(f"hi_{c}") > 2).otherwise(2 * k < n), F.lit(False))

    return wide.select(*[verdict(c).alias(c) for c in cols])


def detect_percent_units(df: DataFrame, cols: list[str]) -> DataFrame:
    """Divide a column by 100 when it holds percentages."""
    flags = percent_units(df, cols)
    return df.withColumns({c: F.when(flags.select(c).scalar(), F.col(c) / 100).otherwise(F.col(c)) for c in cols})


def range_checks(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """Values per column outside their stated bounds, with the extremes found."""
    aggs = []
    for c, (lo, hi) in rules.items():
        aggs += [F.count_if(~F.col(c).between(lo, hi)).alias(f"out_{c}"),
                 F.min(c).cast("double").alias(f"min_{c}"), F.max(c).cast("double").alias(f"max_{c}")]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"out_{c}").alias("outside"), F.col(f"min_{c}").alias("lowest"),
                     F.col(f"max_{c}").alias("highest")) for c in rules]
    return unpivot_structs(df.agg(*aggs), [], rows, ["column", "outside", "lowest", "highest"])


def ends_before(df: DataFrame, col: str, base: int) -> DataFrame:
    """Last period of a series and whether it stops short of the period before ``base``."""
    return df.agg(F.max(col).alias("last"), (F.max(col) < base - 1).alias("short"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Digest of a table's content that ignores row order and partitioning."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    wide = F.sum(h.cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), wide.cast("string").alias("digest"),
                  F.expr("bit_xor(h)").alias("mix") if "h" in df.columns else F.bit_xor(h).alias("mix"))


def tables_match(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tol: float) -> DataFrame:
    """Are two tables equal within a tolerance: rows on one side only, rows that differ, the verdict.

    A null key meets a null key; a null value equals only a null value.
    """
    left = a.select(*[F.col(k).alias(f"_a_key_{k}") for k in keys], *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(True).alias("_in_a"))
    right = b.select(*[F.col(k).alias(f"_b_key_{k}") for k in keys], *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(True).alias("_in_b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_a_key_{k}").eqNullSafe(F.col(f"_b_key_{k}"))
    both = left.join(right, same, "full_outer")
    off = F.lit(False)
    for v in values:
        x, y = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        off = off | F.coalesce(F.abs(x - y) > tol, x.isNull() != y.isNull())
    paired = F.col("_in_a") & F.col("_in_b")
    return both.agg(
        F.count_if(F.col("_in_b").isNull()).alias("only_first"), F.count_if(F.col("_in_a").isNull()).alias("only_second"),
        F.count_if(paired & off).alias("different"),
        (F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull() | F.coalesce(off, F.lit(False))) == 0).alias("match"))


def clean_register(df: DataFrame, age: str = "age", amount: str = "monthly_pension",
                   lowest: int = 40, highest: int = 110) -> DataFrame:
    """Pensioner register: numeric, complete rows, age rounded half to even and kept within bounds."""
    df = coerce_numeric(df, [age, amount]).dropna(subset=[age, amount])
    bounded = F.least(F.greatest(F.bround(age, 0), F.lit(float(lowest))), F.lit(float(highest)))
    return df.withColumn(age, bounded.cast("int"))


def panel_profile(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("person_years"), F.count_distinct("person_id").alias("people"),
                     F.min("year").alias("first_year"), F.max("year").alias("last_year"),
                     F.avg((F.col("exit_type") == "separation").cast("double")).alias("separation_rate"))


def domain_table(spark, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """Allowed codes as a small table."""
    return inline_table(spark, [(c, v) for c, dom in domains.items() for v in dom], "column string, code string")
