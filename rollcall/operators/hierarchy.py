"""Hierarchical series: totals, smoothing forecasts, reconciliation and its scoring.

Tables are long: cells carry sector, ministry and province; every total is a series id. A cell belongs to
one national, one sector, one ministry and one province total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import inline_table, with_small_table, written

CELL = ("sector", "ministry", "province")
LEVELS = ("national", "sector", "ministry", "province", "cell")


def cell_series(cells: DataFrame) -> DataFrame:
    """One value per cell and year of the data, 0 where nothing was recorded. One shuffle on the cell."""
    years = cells.agg(F.array_sort(F.collect_set("year"))).scalar()  # one entry per calendar year
    packed = (cells.groupBy(*CELL, "year").agg(F.sum("value").alias("value"))
              .groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct("year", "value"))).alias("_v"))
              .withColumn("_years", years))
    return (packed.select(*CELL, "_v", F.explode("_years").alias("year"))
            .select(*CELL, "year", F.coalesce(F.element_at("_v", F.col("year")), F.lit(0.0)).alias("value")))


def cell_id() -> Column:
    return F.concat(F.lit("cell:"), F.concat_ws("|", *CELL))


def membership(totals_only: bool = False) -> Column:
    """The series a cell row belongs to, as an array to explode."""
    rows = [F.struct(F.lit("national").alias("series"), F.lit("national").alias("level"), F.lit("national").alias("label"))]
    rows += [F.struct(F.concat(F.lit(f"{lv}:"), F.col(lv)).alias("series"), F.lit(lv).alias("level"), F.col(lv).alias("label"))
             for lv in CELL]
    if not totals_only:
        rows.append(F.struct(cell_id().alias("series"), F.lit("cell").alias("level"), F.concat_ws(" - ", "province", "ministry").alias("label")))
    return F.array(*rows)


def all_series(cells: DataFrame, keys: tuple[str, ...] = ("year",), value: str = "value") -> DataFrame:
    """Every series of the hierarchy. The national total is summed inside tasks before the shuffle."""
    rows = cells.select(*keys, value, F.explode(membership()).alias("_s"))
    return rows.groupBy("_s.series", "_s.level", "_s.label", *keys).agg(F.sum(value).alias(value))


def damped_trend(series: DataFrame, by: list[str], h: int, alphas: list[float], betas: list[float], phis: list[float]) -> DataFrame:
    """Damped-trend smoothing with the parameters of lowest in-sample squared error, per series.

    The grid is folded inside the row of a series, so neither the grid nor the series is shuffled again.
    Returns arrays ``forecast`` (h values, floored at 0) and ``residual``. Near-equal errors resolve to the
    first grid point.
    """
    p = (series.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("year", "value"))).alias("_p"))
         .withColumn("y", F.transform("_p", lambda e: e["value"])))
    y0 = F.element_at("y", 1)
    b0 = F.when(F.size("y") > 1, F.element_at("y", 2) - y0).otherwise(F.lit(0.0))
    rest = F.slice("y", F.lit(2), F.greatest(F.size("y") - 1, F.lit(0)))
    start = F.struct(y0.alias("level"), b0.alias("trend"), F.lit(0.0).alias("sse"))

    def smooth(a: Column, b: Column, phi: Column) -> Column:
        def one(s: Column, v: Column) -> Column:
            fit = s["level"] + phi * s["trend"]
            new = a * v + (1 - a) * fit
            return F.struct(new.alias("level"), (b * (new - s["level"]) + (1 - b) * phi * s["trend"]).alias("trend"),
                            (s["sse"] + (v - fit) * (v - fit)).alias("sse"))
        return F.aggregate(rest, start, one)

    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    nb, nf = len(betas), len(phis)

    def entry(a, i, b, j, f, m):
        s = smooth(a, b, f)
        return F.struct(F.round(s["sse"], 8).alias("sse"), (i * (nb * nf) + j * nf + m).alias("pos"), a.alias("a"), b.alias("b"),
                        f.alias("phi"), s["level"].alias("level"), s["trend"].alias("trend"))

    grid = F.flatten(F.flatten(F.transform(lit(alphas), lambda a, i: F.transform(
        lit(betas), lambda b, j: F.transform(lit(phis), lambda f, m: entry(a, i, b, j, f, m))))))
    # the generator keeps the optimizer from inlining the grid search into each use of its result
    p = p.select("*", F.explode(F.array(F.array_min(grid))).alias("_b"))
    best = F.col("_b")
    damp = lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda s, j: s + F.pow(best["phi"], j))
    forecast = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: F.greatest(best["level"] + damp(k) * best["trend"], F.lit(0.0)))
    # second pass with the chosen parameters, keeping the one-step errors
    init = F.struct(y0.alias("level"), b0.alias("trend"), F.array(F.lit(0.0)).alias("res"))

    def keep(s: Column, v: Column) -> Column:
        fit = s["level"] + best["phi"] * s["trend"]
        new = best["a"] * v + (1 - best["a"]) * fit
        return F.struct(new.alias("level"), (best["b"] * (new - s["level"]) + (1 - best["b"]) * best["phi"] * s["trend"]).alias("trend"),
                        F.concat(s["res"], F.array(v - fit)).alias("res"))

    return p.select(*by, F.array_max(F.transform("_p", lambda e: e["year"])).alias("last_year"), forecast.alias("forecast"),
                    F.aggregate(rest, init, keep, lambda s: s["res"]).alias("residual"))


def rolling_origins(series: DataFrame, max_h: int) -> DataFrame:
    """Copies of each series cut at every rolling origin (the last years, each with five training years)."""
    ends = series.agg(F.struct(F.greatest(F.min("year") + 4, F.max("year") - 7).alias("a"), (F.max("year") - 1).alias("b"))).scalar()
    rows = series.withColumn("_e", ends).withColumn("origin", F.explode(F.sequence(F.col("_e")["a"], F.col("_e")["b"])))
    return rows.where(F.col("year") <= F.col("origin")).drop("_e")


def long_forecast(base: DataFrame, by: list[str]) -> DataFrame:
    """Base forecasts in long form with horizon and year."""
    return base.select(*by, "last_year", F.posexplode("forecast").alias("_i", "value")).select(
        *by, (F.col("_i") + 1).alias("h"), (F.col("last_year") + F.col("_i") + 1).alias("year"), "value")


def split_cells(series: DataFrame) -> DataFrame:
    """Cell rows of a series table with sector, ministry and province back as columns."""
    parts = F.split(F.substring("series", 6, 100000), r"\|")
    return series.where(F.col("level") == "cell").withColumns({c: parts[i] for i, c in enumerate(CELL)})


def bottom_up(base: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Totals as sums of the cells' own forecasts."""
    return all_series(split_cells(base), keys)


def top_down(base: DataFrame, history: DataFrame, keys: tuple[str, ...], origin: list[str] = ()) -> DataFrame:
    """The national forecast split by each cell's average historical share.

    ``history`` holds cell values up to the origin; each (origin, year) total is one small row joined back.
    """
    origin = list(origin)
    total = history.groupBy(*origin, "year").agg(F.sum("value").alias("_all"))
    share = (history.join(total, [*origin, "year"]).groupBy(*origin, *CELL)
             .agg(F.avg(F.try_divide(F.col("value"), F.col("_all"))).alias("_share")))
    nat = base.where(F.col("level") == "national").select(*keys, "value")
    cells = (share.join(nat, origin) if origin else with_small_table(share, nat)).withColumn("value", F.col("_share") * F.col("value"))
    return all_series(cells, keys)


TOLERANCE = 1e-10


def solve_totals(matrix: DataFrame, low: DataFrame | None, gap: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """x of (K + Z Z') x = g for every (method, origin, h), by conjugate gradients on tables of any size.

    ``matrix`` has the non-zero entries (method, origin, a, b, v) of K, ``low`` (method, origin, a, i, v) those of Z, one
    column i a year, ``gap`` (method, origin, a, h, v) the right-hand sides. A product is a join of the entries with
    the vector and a sum by row. The form of the iteration with one reduction a step is used, scaled by the diagonal:
    a step sums the written state to a row of scalars for each system (methods x origins x horizons, which the driver
    reads to see what has converged), moves the vectors and multiplies once; it is written, which ends its lineage. Systems that have converged stand still. When all have, residuals are
    computed anew from x: a system whose true residual is above ``tolerance`` times the right-hand side goes on from
    there, and one that is not solved within the allowed steps is an error. Returns (method, origin, series, h, mult).
    """
    key, row = ["method", "origin"], ["method", "origin", "h", "a"]
    squares = matrix.where("a = b").select(*key, "a", "v")
    if low is not None:
        squares = squares.unionByName(low.select(*key, "a", (F.col("v") * F.col("v")).alias("v")))
    diagonal = written(squares.groupBy(*key, "a").agg(F.sum("v").alias("d")))

    def product(vector: DataFrame) -> DataFrame:
        """(K + Z Z') times a vector (method, origin, h, a, u)."""
        out = matrix.join(vector.withColumnRenamed("a", "b"), [*key, "b"]).select(*row, (F.col("v") * F.col("u")).alias("w"))
        if low is not None:
            years = low.join(vector, [*key, "a"]).groupBy(*key, "h", "i").agg(F.sum(F.col("v") * F.col("u")).alias("t"))
            out = out.unionByName(low.join(years, [*key, "i"]).select(*row, (F.col("v") * F.col("t")).alias("w")))
        return out.groupBy(*row).agg(F.sum("w").alias("w"))

    def with_product(state: DataFrame) -> DataFrame:
        return written(state.join(product(state.select(*row, (F.col("r") / F.col("d")).alias("u"))), row))

    zero, none = F.lit(0.0), F.lit(None).cast("double")
    size = gap.groupBy(*key, "h").agg(F.sum(F.col("v") * F.col("v")).alias("g2"))
    state = with_product(gap.join(diagonal, [*key, "a"]).join(size, [*key, "h"]).select(
        *row, "d", F.col("v").alias("g"), "g2", zero.alias("x"), F.col("v").alias("r"), zero.alias("p"), zero.alias("s"), none.alias("gamma"), none.alias("alpha")))

    def scalars(state: DataFrame) -> list[tuple]:
        """(method, origin, h, gamma, beta, alpha) of each system, without alpha once it has converged."""
        u, out = F.col("r") / F.col("d"), []
        for r in state.groupBy(*key, "h").agg(F.sum(F.col("r") * u).alias("new"), F.sum(F.col("w") * u).alias("delta"), F.sum(F.col("r") * F.col("r")).alias("rr"),
                                              F.first("g2").alias("g2"), F.first("gamma").alias("old"), F.first("alpha").alias("last")).collect():
            beta = r.new / r.old if r.old else 0.0
            below = r.delta - (beta * r.new / r.last if r.last else 0.0)
            live = not r.rr <= r.g2 * tolerance * tolerance
            out.append((r.method, r.origin, r.h, r.new, beta, r.new / below if live and below else None))
        return out

    def step(state: DataFrame, systems: list[tuple]) -> DataFrame:
        table = F.broadcast(inline_table(state.sparkSession, systems, "method string, origin int, h int, new double, beta double, go double"))
        p, s = F.col("r") / F.col("d") + F.col("beta") * F.col("p"), F.col("w") + F.col("beta") * F.col("s")
        moved = lambda new, old: F.when(F.col("go").isNotNull(), new).otherwise(F.col(old)).alias(old)
        return with_product(state.join(table, [*key, "h"]).select(
            *row, "d", "g", "g2", moved(F.col("x") + F.col("go") * p, "x"), moved(F.col("r") - F.col("go") * s, "r"), moved(p, "p"), moved(s, "s"),
            moved(F.col("new"), "gamma"), moved(F.col("go"), "alpha")))

    def open_(systems: list[tuple]) -> bool:
        return any(go is not None for *_, go in systems)

    # as many steps as unknowns are enough but for rounding
    most = 10 * (diagonal.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) + 10
    steps, systems = 0, scalars(state)
    while open_(systems):
        while open_(systems):
            if steps >= most:
                raise ValueError(f"reconciliation did not converge to {tolerance} in {most} steps")
            state, steps = step(state, systems), steps + 1
            systems = scalars(state)
        true = product(state.select(*row, F.col("x").alias("u")))
        state = with_product(state.drop("w").join(true, row, "left").select(
            *row, "d", "g", "g2", "x", (F.col("g") - F.coalesce("w", zero)).alias("r"), zero.alias("p"), zero.alias("s"), none.alias("gamma"), none.alias("alpha")))
        systems = scalars(state)
    return state.select(*key, F.col("a").alias("series"), "h", F.col("x").alias("mult"))


def shrinkage(base: DataFrame) -> DataFrame:
    """Shrinkage intensity of the residual correlation per origin, from sums over series only.

    ``base`` has one row per (origin, series) with its residual array. The n x n correlation is never
    formed: its squared sum equals that of the T x T products over years.
    """
    t = F.size("residual").cast("double")
    sd = F.sqrt(F.greatest(F.aggregate("residual", F.lit(0.0), lambda s, x: s + x * x) / t, F.lit(1e-12)))
    x = base.select("origin", t.alias("_t"), F.transform("residual", lambda v: v / sd).alias("_x"))
    x = x.withColumn("_q", F.transform("_x", lambda v: v * v))
    sq = F.aggregate("_q", F.lit(0.0), lambda s, v: s + v)
    own = x.groupBy("origin").agg(F.sum(sq * sq).alias("diag2"), F.max("_t").alias("t"),
                                  F.sum(F.aggregate("_q", F.lit(0.0), lambda s, v: s + v * v)).alias("diag4"))
    pairs = (x.select("origin", "_x", "_q", F.posexplode("_x").alias("i", "xi")).select("origin", "_q", "i", "xi", F.posexplode("_x").alias("j", "xj"))
             .groupBy("origin", "i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("g"),
                                              F.sum(F.when(F.col("i") == F.col("j"), F.col("xi") * F.col("xi"))).alias("q")))
    whole = pairs.groupBy("origin").agg(F.sum(F.col("g") * F.col("g")).alias("gg"), F.sum(F.col("q") * F.col("q")).alias("qq"))
    n = F.col("t")
    off = F.col("gg") - F.col("diag2")
    v = (F.col("qq") - F.col("diag4")) / (n * (n - 1)) - off / (n * n * (n - 1))
    d = off / (n * n)
    lam = F.when(d > 0, F.least(F.greatest(v / d, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    return whole.join(own, "origin").select("origin", lam.alias("lam"))


def reconcile(base: DataFrame, methods: tuple[str, ...] = ("ols", "wls_struct", "wls_var", "mint_shrink")) -> DataFrame:
    """Least-squares coherent forecasts: ols, structural, variance and shrunken-covariance weights.

    ``base`` has one row per (origin, series): level, forecast array, residual array. Each total must equal
    the sum of its cells, so forecasts move by W C' x with (C W C') x = the gaps. The system has one row per
    total; every sum over cells is a distributed aggregation, and W is never formed. With shrinkage W is the
    diagonal plus a product of residuals over years, so C W C' gains one rank per year.
    """
    by = ["origin", "series"]
    members = base.where(F.col("level") == "cell").transform(split_cells)
    size = members.select("origin", "series", F.explode(membership(True)).alias("_s")).groupBy(
        "origin", F.col("_s.series").alias("series")).agg(F.count("*").cast("double").alias("_size"))
    t = F.size("residual").cast("double")
    ms = F.aggregate("residual", F.lit(0.0), lambda s, x: s + x * x) / t
    full = base.join(size, by, "left").withColumns({"_size": F.coalesce("_size", F.lit(1.0)), "_var": ms})
    full = full.join(shrinkage(base), "origin").join(base.groupBy("origin").agg(F.avg(ms).alias("_mean_var")), "origin")
    var = F.greatest("_var", F.lit(1e-9))
    # per method: diagonal of W, and the weight of the residual products
    spec = {"ols": (F.lit(1.0), F.lit(0.0)), "wls_struct": (F.col("_size"), F.lit(0.0)), "wls_var": (var, F.lit(0.0)),
            "mint_shrink": (F.col("lam") * F.col("_var") + 1e-9 * F.greatest(F.col("_mean_var"), F.lit(1e-9)), (1 - F.col("lam")) / t)}
    rows = [F.struct(F.lit(m).alias("method"), spec[m][0].alias("w"), spec[m][1].alias("c")) for m in methods]
    full = full.select("origin", "series", "level", "label", "last_year", "forecast", "residual", F.explode(F.array(*rows)).alias("_m")).select(
        "origin", "series", "level", "label", "last_year", "forecast", "residual", "_m.*")
    cell = split_cells(full).withColumn("_tot", F.transform(membership(True), lambda s: s["series"]))
    total = full.where(F.col("level") != "cell")

    # gaps: total minus the sum of its cells, for forecasts (per h) and residuals (per year)
    def spread(df: DataFrame, col: str, sign: int, key: Column) -> DataFrame:
        return (df.select("method", "origin", "c", key.alias("a"), F.posexplode(col).alias("i", "x"))
                .select("method", "origin", "c", "a", "i", (F.lit(sign) * F.col("x")).alias("x")))
    one = cell.withColumn("a", F.explode("_tot"))

    def gaps(col: str) -> DataFrame:
        both = spread(total, col, 1, F.col("series")).unionByName(spread(one, col, -1, F.col("a")))
        return both.groupBy("method", "origin", "a", "i").agg(F.sum("x").alias("x"), F.max("c").alias("c"))

    g = written(gaps("forecast").select("method", "origin", "a", (F.col("i") + 1).alias("h"), F.col("x").alias("v")))
    # a cell has four totals, so sixteen pairs whatever the size of a total
    pairs = one.select("method", "origin", "a", F.explode("_tot").alias("b"), "w")
    own = total.select("method", "origin", F.col("series").alias("a"), F.col("series").alias("b"), "w")
    matrix = written(pairs.unionByName(own).groupBy("method", "origin", "a", "b").agg(F.sum("w").alias("v")))
    low = None
    if "mint_shrink" in methods:
        z = written(gaps("residual").where("c > 0"))
        low = z.select("method", "origin", "a", "i", (F.sqrt("c") * F.col("x")).alias("v"))
    mult = solve_totals(matrix, low, g)
    moved = (cell.select("method", "origin", F.col("series").alias("cell"), F.explode("_tot").alias("series"), "w")
             .join(mult, ["method", "origin", "series"]).groupBy("method", "origin", "cell", "h")
             .agg(F.sum(F.col("w") * F.col("mult")).alias("_d")))
    start = cell.select("method", "origin", F.col("series").alias("cell"), *CELL, "last_year", F.posexplode("forecast").alias("_i", "value")
                        ).withColumn("h", F.col("_i") + 1)
    done = start.join(moved, ["method", "origin", "cell", "h"], "left").withColumn("value", F.col("value") + F.coalesce("_d", F.lit(0.0)))
    if low is not None:
        u = (z.select("method", "origin", F.col("a").alias("series"), "i", "x").join(mult, ["method", "origin", "series"])
             .groupBy("method", "origin", "h", "i").agg(F.sum(F.col("x") * F.col("mult")).alias("u")))
        pull = (cell.where("c > 0").select("method", "origin", F.col("series").alias("cell"), "c", F.posexplode("residual").alias("i", "x"))
                .join(u, ["method", "origin", "i"]).groupBy("method", "origin", "cell", "h")
                .agg(F.sum(F.col("c") * F.col("x") * F.col("u")).alias("_p")))
        done = done.join(pull, ["method", "origin", "cell", "h"], "left").withColumn("value", F.col("value") - F.coalesce("_p", F.lit(0.0)))
    return all_series(done.withColumn("year", F.col("last_year") + F.col("h")), ("method", "origin", "h", "year"))


def reconciliation_check(base: DataFrame, coherent: DataFrame, weights: str) -> DataFrame:
    """How far reconciled forecasts are from the least-squares answer, per (origin, h): both figures are zero for it alone.

    ``gap`` is the largest difference of a total and the sum of its cells; ``residual`` the largest entry of
    S' W^-1 (base - coherent) over cells, relative to the largest forecast. ``weights`` is ols, wls_struct or wls_var.
    """
    by = ["origin", "series"]
    members = split_cells(base).select("origin", "series", F.explode(membership(True)).alias("_s"))
    size = members.groupBy("origin", F.col("_s.series").alias("series")).agg(F.count("*").cast("double").alias("_size"))
    var = F.aggregate("residual", F.lit(0.0), lambda s, x: s + x * x) / F.size("residual")
    w = {"ols": F.lit(1.0), "wls_struct": F.coalesce("_size", F.lit(1.0)), "wls_var": F.greatest(var, F.lit(1e-9))}[weights]
    long = base.join(size, by, "left").select("origin", "series", "level", w.alias("w"), F.posexplode("forecast").alias("_i", "was")).select(
        "origin", "series", "level", "w", (F.col("_i") + 1).alias("h"), "was")
    both = long.join(coherent.select("origin", "series", "h", F.col("value").alias("now")), [*by, "h"])
    cells = split_cells(both).withColumn("_tot", F.transform(membership(True), lambda s: s["series"]))
    parts = cells.select("origin", "h", F.explode("_tot").alias("series"), "now").groupBy("origin", "h", "series").agg(F.sum("now").alias("parts"))
    gap = (both.where("level <> 'cell'").join(parts, ["origin", "h", "series"]).groupBy("origin", "h")
           .agg(F.max(F.abs(F.col("now") - F.col("parts"))).alias("gap"), F.max(F.abs("was")).alias("scale"), F.count("*").alias("totals")))
    pull = both.select("origin", "h", "series", ((F.col("was") - F.col("now")) / F.col("w")).alias("pull"))
    up = cells.select("origin", "h", F.col("series").alias("cell"), "w", F.explode(F.concat("_tot", F.array("series"))).alias("series"))
    sums = up.join(pull, ["origin", "h", "series"]).groupBy("origin", "h", "cell").agg(F.sum("pull").alias("sum"), F.max("w").alias("w"))
    worst = sums.groupBy("origin", "h").agg(F.max(F.abs(F.col("sum")) * F.least("w", F.lit(1.0))).alias("residual"), F.count("*").alias("cells"))
    return gap.join(worst, ["origin", "h"]).select("origin", "h", "totals", "cells", (F.col("gap") / F.greatest("scale", F.lit(1e-9))).alias("gap"),
                                                   (F.col("residual") / F.greatest("scale", F.lit(1e-9))).alias("residual"))


def wape_by(errors: DataFrame, by: list[str]) -> DataFrame:
    e = F.abs(F.col("forecast") - F.col("actual"))
    return errors.groupBy(*by).agg((F.try_divide(F.sum(e), F.sum("actual")) * 100).alias("wape"))


def wape_summary(errors: DataFrame, extra: list[str] = ()) -> DataFrame:
    """WAPE by method (rows) and level (columns), and the average over levels."""
    by = wape_by(errors, [*extra, "method", "level"])
    wide = by.groupBy(*extra, "method").pivot("level", list(LEVELS)).agg(F.first("wape"))
    total = sum((F.col(lv) for lv in LEVELS), F.lit(0.0)) / len(LEVELS)
    return wide.withColumn("average", total)


def coherence_gap(errors: DataFrame) -> DataFrame:
    """How far separate (base) forecasts miss adding up, in percent of the national forecast."""
    base = errors.where("method = 'base'")
    parts = base.where("level <> 'national'").groupBy("level", "origin", "h").agg(F.sum("forecast").alias("_p"))
    nat = base.where("level = 'national'").select("origin", "h", F.col("forecast").alias("_n"))
    return parts.join(nat, ["origin", "h"]).groupBy("level").agg(F.avg(F.abs(F.col("_p") - F.col("_n")) / F.col("_n") * 100).alias("gap"))


def pick_method(summary: DataFrame, base_key: str = "base_model") -> DataFrame:
    """The coherent method (and base forecaster) with the lowest average WAPE."""
    row = F.struct(base_key, "method")
    best = summary.where("method <> 'base'").agg(F.min_by(row, F.struct("average", base_key, "method")).alias("b"))
    return best.select(f"b.{base_key}", "b.method")


def win_rates(errors: DataFrame, method: str, against: tuple[str, ...] = ("base", "bottom_up", "top_down")) -> DataFrame:
    """Share of forecasts where the method is closer to the actual than each alternative."""
    e = F.abs(F.col("forecast") - F.col("actual"))
    wide = errors.groupBy("origin", "h", "series").agg(*[F.max(F.when(F.col("method") == m, e)).alias(f"e_{m}") for m in (method, *against)])
    one = wide.agg(*[F.avg((F.col(f"e_{method}") < F.col(f"e_{m}")).cast("double")).alias(m) for m in against])
    rows = [F.struct(F.lit(m).alias("against"), F.col(m).alias("win_rate")) for m in against]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.against", "r.win_rate")


def saved_base(saved: DataFrame, series: DataFrame) -> DataFrame:
    """Outside forecasts as base input: per (model, series, origin) the forecast array and one-step residuals.

    The residual for a year is its value minus the forecast made the year before.
    """
    f = saved.groupBy("model", "series", "origin").agg(F.array_sort(F.collect_list(F.struct("h", "value"))).alias("_f"))
    f = f.withColumn("forecast", F.transform("_f", lambda e: e["value"]))
    one = saved.where("h = 1").select("model", "series", (F.col("origin") + 1).alias("year"), F.col("value").alias("_one"))
    res = (one.join(series.select("series", "year", F.col("value").alias("_y")), ["series", "year"]).groupBy("model", "series")
           .agg(F.array_sort(F.collect_list(F.struct("year", (F.col("_y") - F.col("_one")).alias("r")))).alias("_r")))
    out = f.join(res, ["model", "series"], "left")
    kept = F.filter("_r", lambda e: e["year"] <= F.col("origin"))
    return out.select("model", "series", "origin", "forecast", F.transform(kept, lambda e: e["r"]).alias("residual"))


def unit_forecast_table(forecast: DataFrame, level: str, years: list[int]) -> DataFrame:
    """Units by year, with a row for their sum and one for the national series, and growth over the span."""
    units = forecast.where(F.col("level") == level).select("label", "year", "value")
    total = units.groupBy("year").agg(F.sum("value").alias("value")).select(F.lit("all units").alias("label"), "year", "value")
    nat = forecast.where("level = 'national'").select(F.lit("national").alias("label"), "year", "value")
    rows = units.unionByName(total).unionByName(nat)
    wide = rows.groupBy("label").agg(*[F.max(F.when(F.col("year") == y, F.col("value"))).alias(f"y{y}") for y in years])
    ratio = F.try_divide(F.col(f"y{years[-1]}"), F.col(f"y{years[0]}"))
    return wide.withColumns({"growth": ratio - 1, "yearly_growth": F.pow(ratio, F.lit(1 / (len(years) - 1))) - 1})
