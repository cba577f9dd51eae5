"""Expected exits of today's staff, by unit and year, and why units differ."""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import with_small_table

CELL = ("province", "ministry", "sector", "framework", "eligible60", "age", "service")


def unit_cells(records: DataFrame, ages: tuple[int, int] = (18, 65), service_max: int = 47) -> DataFrame:
    """Counts by unit and cohort, without identifiers; missing unit columns become 'Unknown'."""
    for c, default in (("province", "Unknown"), ("ministry", "Unknown"), ("eligible60", False)):
        records = records.withColumn(c, F.coalesce(F.col(c), F.lit(default)) if c in records.columns else F.lit(default))
    inside = F.col("age").between(*ages) & F.col("service").between(0, service_max)
    return records.where(inside).groupBy(*CELL).agg(F.count("*").alias("n"))


def exit_paths(cells: DataFrame, years: int, limit: Callable[[Column], Column], hazard: Callable[[DataFrame], DataFrame],
               life: DataFrame, ages: tuple[int, int] = (18, 65), service_max: int = 47) -> DataFrame:
    """Expected exits of each cell in each of the next ``years`` (nobody is hired into a cell).

    ``limit(t)`` is the retirement age for non-eligible staff; ``hazard`` adds column h using age_t and
    service_t. Everyone leaves at the limit; before it death and separation compete. A cell has one row
    per year ahead, so its survivors are a short window.
    """
    rows = (cells.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(years - 1))))
            .withColumn("_age", F.col("age") + F.col("t"))
            .withColumns({"age_t": F.least(F.greatest(F.col("_age"), F.lit(ages[0])), F.lit(ages[1])).cast("int"),
                          "service_t": F.least(F.col("service") + F.col("t"), F.lit(service_max)).cast("int")}))
    rows = hazard(rows).join(F.broadcast(life.select(F.col("age").alias("age_t"), F.col("qx").alias("_q"))), "age_t")
    stop = F.when(F.col("eligible60"), F.greatest(F.lit(60), limit(F.col("t")))).otherwise(limit(F.col("t")))
    p = F.when(F.col("_age") >= stop, 1.0).otherwise(F.col("_q") + (1 - F.col("_q")) * F.col("h"))
    before = Window.partitionBy(*CELL).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_p", p)
            .withColumn("_alive", F.coalesce(F.product(1 - F.col("_p")).over(before), F.lit(1.0)))
            .select(*CELL, "n", "t", (F.col("n") * F.col("_alive") * F.col("_p")).alias("exits")))


def unit_wave_table(exits: DataFrame, level: list[str], horizon: int, first_year: int, high: float = 1.25,
                    watch: float = 1.1, wave_factor: float = 1.5, min_staff: int = 30) -> DataFrame:
    """One row per unit: staff, age mix, shares leaving, peak and wave years, ratio to national, warning tier."""
    start = F.col("t") == 0
    uy = exits.groupBy(*level, "t").agg(
        F.sum("exits").alias("x"), F.sum(F.when(start, F.col("n"))).alias("n0"),
        F.sum(F.when(start, F.col("n") * F.col("age"))).alias("ax"),
        F.sum(F.when(start & (F.col("age") >= 50), F.col("n")).otherwise(0)).alias("old"))
    inside = F.col("t") < horizon
    # the national figures are one struct
    nat = uy.agg(F.struct(F.sum("n0").alias("staff"), F.sum(F.when(inside, F.col("x"))).alias("x")).alias("s")).scalar()
    units = uy.groupBy(*level).agg(F.sum("n0").alias("staff"), F.sum("ax").alias("_ax"), F.sum("old").alias("_old"),
                                   F.array_sort(F.collect_list(F.struct("t", "x"))).alias("_x")).withColumn("_nat", nat)
    share = F.col("_nat")["x"] / F.col("_nat")["staff"]
    rate = F.transform(F.filter("_x", lambda e: e["t"] < horizon), lambda e: F.struct(
        (e["x"] / F.col("staff")).alias("rate"), (-e["t"]).alias("neg"), (first_year + e["t"]).alias("year")))
    units = units.withColumn("_r", rate)

    def total(k: int) -> Column:
        return F.aggregate(F.filter("_r", lambda e: -e["neg"] < k), F.lit(0.0), lambda a, e: a + e["rate"])

    peak = F.array_max("_r")
    wave = F.filter("_r", lambda e: e["rate"] >= wave_factor * share / horizon)
    out = units.select(
        *level, "staff", (F.col("_ax") / F.col("staff")).alias("mean_age"), (F.col("_old") / F.col("staff")).alias("aged_50_plus"),
        total(5).alias("leave_5y"), total(horizon).alias("leave_h"), peak["year"].alias("peak_year"), peak["rate"].alias("peak_rate"),
        F.array_min(F.transform(wave, lambda e: e["year"])).alias("wave_start"), F.size(wave).alias("wave_years"),
        (total(horizon) / share).alias("vs_national"))
    return out.withColumn("tier", F.when(F.col("staff") < min_staff, "few_staff").when(F.col("vs_national") >= high, "high")
                          .when(F.col("vs_national") >= watch, "watch").otherwise("normal"))


def wave_heat(exits: DataFrame, units: DataFrame, unit: str, years: int, top: int) -> DataFrame:
    """Exit rate by unit (rows) and year ahead (columns) for the units with the highest ratio to national."""
    first = units.orderBy(F.col("vs_national").desc(), unit).limit(top).select(unit)
    rates = exits.join(first, unit, "left_semi").groupBy(unit, "t").agg((F.sum("exits") / F.sum("n")).alias("rate"))
    return rates.groupBy(unit).pivot("t", list(range(years))).agg(F.first("rate")).toDF(unit, *[f"y{i}" for i in range(years)])


def subset_weight(mask: str, i: int, k: int) -> Column:
    """What the worth of the set ``mask`` (bits of k features) counts for in the Shapley value of feature i."""
    size = F.bit_count(mask)
    plus = [factorial(s - 1) * factorial(k - s) / factorial(k) if s else 0.0 for s in range(k + 1)]
    minus = [-factorial(s) * factorial(k - s - 1) / factorial(k) if s < k else 0.0 for s in range(k + 1)]
    pick = lambda table: F.element_at(F.array(*[F.lit(v) for v in table]), size + 1)
    return F.when(F.col(mask).bitwiseAND(1 << i) != 0, pick(plus)).otherwise(pick(minus))


def shapley(df: DataFrame, features: list[str], value: str, weight: str) -> DataFrame:
    """Exact Shapley split of ``value`` over feature groups: one row per feature combination.

    The worth of a feature set is the weighted mean of the value among combinations that agree on it.
    Rows are reduced to distinct combinations first; every combination then meets its 2^k sets
    (k at most 6). Contributions of a combination add up to its value minus the overall mean.
    """
    k = len(features)
    if k > 6:
        raise ValueError("at most six feature groups")
    combos = df.groupBy(*features).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("_y"), F.sum(weight).alias("_w"))
    keys = [f"_k{i}" for i in range(k)]
    masks = combos.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(2 ** k - 1))))
    masks = masks.withColumns({keys[i]: F.when(F.col("_m").bitwiseAND(1 << i) != 0, F.col(f).cast("string")).otherwise("")
                               for i, f in enumerate(features)})
    worth = masks.groupBy("_m", *keys).agg((F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")).alias("_v"))
    return (masks.join(worth, ["_m", *keys]).groupBy(*features)
            .agg(F.max("_y").alias("value"), F.max("_w").alias("weight"),
                 *[F.sum(subset_weight("_m", i, k) * F.col("_v")).alias(f"phi_{f}") for i, f in enumerate(features)]))


def explain_gap(cells: DataFrame, exits: DataFrame, level: list[str], horizon: int) -> DataFrame:
    """Split each unit's gap to the national exit share (in points) over five feature groups."""
    feats = ["sector", "framework", "eligible60", "age", "service"]
    gone = exits.where(F.col("t") < horizon).groupBy(*CELL).agg((F.sum("exits") / F.max("n")).alias("y"), F.max("n").alias("n"))
    phi = shapley(gone, feats, "y", "n").drop("value", "weight")
    per = cells.select(*dict.fromkeys([*level, *feats]), "n").join(phi, feats)
    return per.groupBy(*level).agg(*[
        (F.sum(F.col(f"phi_{f}") * F.col("n")) / F.sum("n") * 100).alias(f) for f in feats])


def importance(df: DataFrame, features: list[str], value: str, weight: str) -> DataFrame:
    """Mean absolute contribution of each (binned) driver."""
    s = shapley(df, features, value, weight)
    wide = s.agg(*[(F.sum(F.abs(f"phi_{f}") * F.col("weight")) / F.sum("weight")).alias(f) for f in features])
    rows = [F.struct(F.lit(f).alias("driver"), F.col(f).alias("importance")) for f in features]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.driver", "r.importance")


def rate_backtest(panel: DataFrame, origin: Column, level: list[str], span: int = 5) -> DataFrame:
    """Per unit over the years up to the origin: exit rate, and separation rate among those at risk."""
    window = panel.where((F.col("year") <= origin) & (F.col("year") > origin - span))
    risk = ~F.col("exit_type").isin("retirement", "death")
    return window.groupBy(*level).agg(
        F.avg(F.col("exit").cast("double")).alias("exit_rate"),
        F.avg(F.when(risk, (F.col("exit_type") == "separation").cast("double"))).alias("separation_rate"))


def carried_forward(cells: DataFrame, rates: DataFrame, level: list[str], years: int) -> DataFrame:
    """Exits when each unit's past exit rate simply continues."""
    units = cells.groupBy(*level).agg(F.sum("n").alias("_n")).join(rates, level)
    return (units.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(years - 1))))
            .select(*level, "t", (F.col("_n") * F.col("exit_rate") * F.pow(1 - F.col("exit_rate"), F.col("t"))).alias("past_rate")))


def actual_exits(panel: DataFrame, staff: DataFrame, origin: Column, level: list[str]) -> DataFrame:
    """Exits after the origin of people who were on the staff at the origin."""
    later = panel.where((F.col("year") > origin) & F.col("exit")).join(staff.select("person_id"), "person_id", "left_semi")
    return later.groupBy(*level, (F.col("year") - origin - 1).alias("t")).agg(F.count("*").alias("actual"))


def _substrings(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, gram): every distinct run of ``size`` characters, and every shorter one."""
    n = F.length(key)

    def runs(k: int):
        every = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(F.col(key), i, F.lit(k)))
        return F.when(n >= k, every).otherwise(F.array().cast("array<string>"))
    held = F.array_distinct(F.flatten(F.array(*[runs(k) for k in range(1, size + 1)])))
    return df.select(key, F.explode(held).alias("gram"))


def containing(inner: DataFrame, outer: DataFrame, a: str, b: str, size: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct texts where b contains a: joined on one run of characters of a, its rarest among b."""
    held = _substrings(outer, b, size)
    seen = held.groupBy("gram").agg(F.count("*").alias("_uses"))
    n = F.length(a)
    own = inner.where(n > 0).select(a, F.explode(F.when(n <= size, F.array(F.col(a))).otherwise(
        F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(F.col(a), i, F.lit(size))))).alias("gram"))
    # a run that no b has rules its text out, so it counts as the rarest
    anchor = own.join(seen, "gram", "left").groupBy(a).agg(F.min_by("gram", F.struct(F.coalesce("_uses", F.lit(0)), "gram")).alias("gram"))
    return anchor.join(held, "gram").where(F.contains(F.col(b), F.col(a))).select(a, b)


def similar_spellings(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float) -> DataFrame:
    """Pairs (a, b) of distinct texts with 1 - distance / longer length of at least ``cutoff``, and that figure.

    Texts within d edits share at least L - q + 1 - q d of their runs of q characters, counted with repeats (L: the
    longer length). So both must have a common run among the first few of each in one order of all runs, rarest first;
    only such pairs are compared. With q = 1 the bound holds for every cutoff above 0; from 0.7 on q = 2 is sharper.
    """
    q = 2 if cutoff >= 0.7 else 1

    def grams(df: DataFrame, key: str) -> DataFrame:
        n = F.length(key)
        runs = df.where(n >= q).select(key, F.posexplode(F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substring(F.col(key), i, F.lit(q)))).alias("pos", "g"))
        nth = F.row_number().over(Window.partitionBy(key, "g").orderBy("pos"))          # repeats within one text
        return runs.select(key, F.concat("g", F.lit("#"), nth.cast("string")).alias("gram"))

    def first_runs(df: DataFrame, key: str, order: DataFrame) -> DataFrame:
        n = F.length(key)
        most = F.floor(n / F.lit(cutoff) + 1e-9)
        shared = F.array_min(F.transform(F.sequence(n.cast("bigint"), most), lambda m: m - (q - 1) - q * F.floor((1 - cutoff) * m + 1e-9)))
        place = F.row_number().over(Window.partitionBy(key).orderBy("_df", "gram"))       # one text's runs
        return (df.join(order, "gram").withColumn("_at", place)
                .where(F.col("_at") <= n - (q - 1) - F.greatest(shared, F.lit(1)) + 1).select(key, "gram"))
    ga, gb = grams(left, a), grams(right, b)
    order = ga.select("gram").unionAll(gb.select("gram")).groupBy("gram").agg(F.count("*").alias("_df"))
    longer = F.greatest(F.length(a), F.length(b))
    fits = F.abs(F.length(a) - F.length(b)) <= (1 - cutoff) * longer + 1e-9
    near = 1 - F.levenshtein(a, b) / longer
    return (first_runs(ga, a, order).join(first_runs(gb, b, order), "gram").where(fits).select(a, b).distinct()
            .withColumn("near", near).where(F.col("near") >= cutoff))


def match_unit(names: DataFrame, units: DataFrame, name: str, unit: str, cutoff: float = 0.7) -> DataFrame:
    """Unit each written name means: exact, then containing or contained, then the closest spelling.

    Distinct names are matched once, by joins on equal names, on a rare run of characters, and on rare first runs;
    names and units are never paired as such. An empty unit matches nothing but an empty name.
    """
    clean = F.trim(F.regexp_replace(F.lower(name), "province|ministry of", ""))
    distinct = names.select(name).distinct().withColumn("_n", clean)
    listed = units.select(unit, F.lower(unit).alias("_u"))
    n, u = distinct.select("_n").distinct(), listed.select("_u").distinct()
    pairs = (n.join(u, F.col("_n") == F.col("_u")).select("_n", "_u", F.lit(3.0).alias("_rank"))
             .unionAll(containing(n, u, "_n", "_u").withColumn("_rank", F.lit(2.0)))
             .unionAll(containing(u, n, "_u", "_n").select("_n", "_u", F.lit(2.0)))
             .unionAll(similar_spellings(n, u, "_n", "_u", cutoff).select("_n", "_u", F.col("near"))))
    best = pairs.groupBy("_n", "_u").agg(F.max("_rank").alias("_rank")).join(listed, "_u")
    # among equals the first unit in code order wins
    best = best.groupBy("_n").agg(F.min_by(F.col(unit), F.struct(-F.col("_rank"), F.col(unit))).alias("unit"))
    return distinct.join(best, "_n", "left").select(name, "unit")
