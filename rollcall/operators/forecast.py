"""Series forecasting and forecast scoring.

A series is packed once into an array ordered by period (its length is the number of periods), and every
model is an expression over that array. Forecasting any number of series, origins and models is then one
shuffle followed by projections.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import diebold_mariano, dm_hln, pinball

ROLL_H, TEST_H, FUTURE_H = 5, 8, 10
Z80 = 1.2815515655446004  # fixed value: normal quantile of 0.9


def pack_series(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per series: ``y`` sorted by t, with the first and last period."""
    pairs = F.array_sort(F.collect_list(F.struct("t", "value")))
    return df.groupBy(*by).agg(pairs.alias("_p"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).withColumn(
        "y", F.transform("_p", lambda e: e["value"]))


def rolling_tasks(df: DataFrame, by: list[str], roll_h: int = ROLL_H, test_h: int = TEST_H, future_h: int = FUTURE_H) -> DataFrame:
    """Every (series, origin) to forecast, its horizon and the history up to the origin.

    Up to 13 rolling origins with enough history, the single test origin, and the end of the data; an
    origin that serves two purposes gets the longer horizon.
    """
    p = pack_series(df, by)
    first, last = F.col("first_t"), F.col("last_t")
    start = F.greatest(first + 7, last - 17)
    roll = F.when(start <= last - roll_h, F.sequence(start, last - roll_h)).otherwise(F.array().cast("array<int>"))
    origins = F.array_distinct(F.concat(roll, F.array(last - test_h, last)))
    rows = p.withColumn("_roll", roll).select(*by, "_p", "_roll", "last_t", F.explode(origins).alias("origin"))
    h = F.greatest(F.when(F.array_contains("_roll", F.col("origin")), roll_h).otherwise(0),
                   F.when(F.col("origin") == last - test_h, test_h).otherwise(0),
                   F.when(F.col("origin") == last, future_h).otherwise(0))
    context = F.transform(F.filter("_p", lambda e: e["t"] <= F.col("origin")), lambda e: e["value"])
    return rows.select(*by, "origin", h.alias("h"), context.alias("y")).where(F.size("y") > 0)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def _steps(h: Column) -> Column:
    return F.sequence(F.lit(1), h)


def naive(y: Column, h: Column) -> Column:
    return F.transform(_steps(h), lambda k: F.element_at(y, -1))


def recent_mean(y: Column, h: Column, k: int = 8) -> Column:
    tail = F.slice(y, -F.least(F.size(y), F.lit(k)), F.least(F.size(y), F.lit(k)))
    return F.transform(_steps(h), lambda _: _sum(tail) / F.size(tail))


def linear_trend(y: Column, h: Column) -> Column:
    """Least-squares line over positions 0..n-1, extended."""
    n = F.size(y).cast("double")
    x = F.transform(F.sequence(F.lit(0), F.size(y) - 1), lambda i: i.cast("double"))
    mx, my = (n - 1) / 2, _sum(y) / n
    slope = F.try_divide(_dot(x, y) - n * mx * my, n * (n * n - 1) / 12)
    slope = F.coalesce(slope, F.lit(0.0))
    return F.transform(_steps(h), lambda k: my + slope * (n - 1 + k - mx))


BASELINES = {"naive": naive, "mean_8": recent_mean, "linear_trend": linear_trend}


def _centre(a: Column) -> Column:
    m = _sum(a) / F.size(a)
    return F.transform(a, lambda x: x - m)


def ar_candidates(df: DataFrame) -> DataFrame:
    """Least-squares AR(1), AR(2) with constant and ARI(1,1) without, on the same rows, each with its AIC.

    Adds ``fits``: array of struct(aic, order, c, a1, a2, d, sigma2, theta, e); a forecast of order d = 1 works on
    differences; theta weighs the last shock e, both 0 here. Series need at least six periods.
    """
    y, n = F.col("y"), F.size("y")
    df = df.withColumns({"_y0": F.slice(y, F.lit(3), n - 2), "_y1": F.slice(y, F.lit(2), n - 2), "_y2": F.slice(y, F.lit(1), n - 2)})
    df = df.withColumns({f"_c{i}": _centre(F.col(f"_y{i}")) for i in range(3)} | {f"_m{i}": _sum(F.col(f"_y{i}")) / (n - 2) for i in range(3)}
                        | {"_d0": F.zip_with("_y0", "_y1", lambda a, b: a - b), "_d1": F.zip_with("_y1", "_y2", lambda a, b: a - b)})
    df = df.withColumns({f"_s{i}{j}": _dot(F.col(f"_c{i}"), F.col(f"_c{j}")) for i in range(3) for j in range(i, 3)}
                        | {"_dd": _dot(F.col("_d0"), F.col("_d1")), "_d11": _dot(F.col("_d1"), F.col("_d1")), "_d00": _dot(F.col("_d0"), F.col("_d0"))})
    s = {k: F.col(f"_s{k}") for k in ("00", "01", "02", "11", "12", "22")}
    m = (n - 2).cast("double")
    a1 = F.coalesce(F.try_divide(s["01"], s["11"]), F.lit(0.0))
    det = s["11"] * s["22"] - s["12"] * s["12"]
    b1 = F.try_divide(s["01"] * s["22"] - s["02"] * s["12"], det)
    b2 = F.try_divide(s["02"] * s["11"] - s["01"] * s["12"], det)
    g = F.coalesce(F.try_divide(F.col("_dd"), F.col("_d11")), F.lit(0.0))

    def fit(order: int, params: int, c: Column, p1: Column, p2: Column, d: int, sse: Column) -> Column:
        s2 = F.greatest(sse / m, F.lit(1e-12))
        return F.struct((m * F.log(s2) + 2 * params).alias("aic"), F.lit(order).alias("order"), c.alias("c"), p1.alias("a1"),
                        p2.alias("a2"), F.lit(d).alias("d"), s2.alias("sigma2"), F.lit(0.0).alias("theta"), F.lit(0.0).alias("e"))

    ar2 = F.when(F.abs(det) > 1e-12, fit(2, 4, F.col("_m0") - b1 * F.col("_m1") - b2 * F.col("_m2"), b1, b2, 0,
                                         s["00"] - b1 * s["01"] - b2 * s["02"]))
    fits = F.array_compact(F.array(
        fit(1, 3, F.col("_m0") - a1 * F.col("_m1"), a1, F.lit(0.0), 0, s["00"] - a1 * s["01"]), ar2,
        fit(3, 2, F.lit(0.0), g, F.lit(0.0), 1, F.col("_d00") - g * F.col("_dd"))))
    return df.withColumn("fits", fits).drop(*[c for c in df.columns if c.startswith("_")])


ORDERS = {1: "ar1", 2: "ar2", 3: "ari11", 4: "arma11", 5: "ima011"}
MA_GRID = [round(-0.9 + 0.1 * i, 1) for i in range(19)]


def model_candidates(df: DataFrame, grid: list[float] = MA_GRID) -> DataFrame:
    """AR(1), AR(2), ARI(1,1), ARMA(1,1) and IMA(0,1,1) in one table of fits, all on the periods from the third on.

    The autoregressions are those of ``ar_candidates``. The other two are the best of a parameter grid by conditional
    least squares (shocks before the second period are 0), folded inside the row; ARMA works around the series' mean.
    Every sum of squares has the same n - 2 terms, so the five criteria compare.
    """
    y, n = F.col("y"), F.size("y")
    df = ar_candidates(df).withColumn("_mean", _sum(y) / n).withColumns({
        "_x": F.transform(y, lambda v: v - F.col("_mean")),
        "_d": F.zip_with(F.slice(y, F.lit(2), n - 1), F.slice(y, F.lit(1), n - 1), lambda a, b: a - b)})
    m = (n - 2).cast("double")

    def fold(values: Column, phi: Column, theta: Column, first: Column, shock: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sse"), shock.alias("e"), first.alias("prev"))

        def one(a: Column, v: Column) -> Column:
            u = v - phi * a["prev"] - theta * a["e"]
            return F.struct((a["sse"] + u * u).alias("sse"), u.alias("e"), v.alias("prev"))
        return F.aggregate(values, start, one)

    def fit(order: int, params: int, a: Column, phi: Column, theta: Column, d: int) -> Column:
        s2 = F.greatest(a["sse"] / m, F.lit(1e-12))
        return F.struct((m * F.log(s2) + 2 * params).alias("aic"), F.lit(order).alias("order"),
                        (F.lit(0.0) if d else F.col("_mean") * (1 - phi)).alias("c"), phi.alias("a1"), F.lit(0.0).alias("a2"), F.lit(d).alias("d"),
                        s2.alias("sigma2"), theta.alias("theta"), a["e"].alias("e"))
    g = F.array(*[F.lit(float(v)) for v in grid])
    x1, x2 = F.element_at("_x", 1), F.element_at("_x", 2)
    later = F.slice("_x", F.lit(3), n - 2)
    arma = F.array_min(F.flatten(F.transform(g, lambda p: F.transform(g, lambda t: fit(4, 4, fold(later, p, t, x2, x2 - p * x1), p, t, 0)))))
    steps = F.slice("_d", F.lit(2), n - 2)
    ima = F.array_min(F.transform(g, lambda t: fit(5, 2, fold(steps, F.lit(0.0), t, F.lit(0.0), F.element_at("_d", 1)), F.lit(0.0), t, 1)))
    # the generator keeps the optimizer from repeating the grid for each use of its result
    df = df.select("*", F.explode(F.array(F.concat("fits", F.array(arma, ima)))).alias("_all"))
    return df.withColumn("fits", F.col("_all")).drop("_all", "_mean", "_x", "_d")


def best_fit() -> Column:
    """The fit of lowest AIC; criteria equal to eight decimals go to the smaller order."""
    keyed = F.transform("fits", lambda f: F.struct(F.round(f["aic"], 8).alias("k"), f["order"].alias("o"), f.alias("f")))
    return F.array_min(keyed)["f"]


def model_table(tasks: DataFrame, by: list[str]) -> DataFrame:
    """One row per task and model: its AIC and parameters, and whether it is the one chosen."""
    df = model_candidates(tasks.where(F.size("y") >= 6)).withColumn("_f", best_fit())
    names = F.create_map(*[F.lit(v) for kv in ORDERS.items() for v in kv])
    return df.select(*by, "origin", F.col("_f.order").alias("_o"), F.explode("fits").alias("f")).select(
        *by, "origin", names[F.col("f.order")].alias("model"), "f.aic", "f.c", "f.a1", "f.a2", "f.theta", "f.sigma2", (F.col("f.order") == F.col("_o")).alias("chosen"))


def _last_value(tasks: DataFrame) -> DataFrame:
    """Tasks of one to five periods with ``_last`` and ``_s2``, the mean squared step of a random walk (null with one)."""
    y, n = F.col("y"), F.size("y")
    steps = F.zip_with(F.slice(y, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(y, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)
    return tasks.where(n < 6).withColumns({"_last": F.try_element_at(y, F.lit(-1)), "_s2": F.try_divide(_dot(steps, steps), n - 1)})


def ar_select(tasks: DataFrame) -> DataFrame:
    """Forecast with the lowest-AIC model of ``model_candidates`` and its 80% interval (columns q10, q50, q90 as arrays).

    Series under six periods get a random walk, the order that their length allows; one value alone has no interval.
    """
    # the generator keeps the optimizer from repeating the fits for each use of the best one
    df = model_candidates(tasks.where(F.size("y") >= 6)).select("*", F.explode(F.array(best_fit())).alias("_f"))
    f, y = F.col("_f"), F.col("y")
    last, prev = F.element_at(y, -1), F.element_at(y, -2)
    level = f["d"] == 1
    x1, x2 = F.when(level, last - prev).otherwise(last), F.when(level, F.lit(0.0)).otherwise(prev)
    # psi weights follow the same recursion with a unit shock; the last shock reaches one step
    zero = F.struct(F.lit(1.0).alias("live"), x1.alias("x1"), x2.alias("x2"), last.alias("lvl"), F.lit(1.0).alias("p1"), F.lit(0.0).alias("p2"),
                    F.lit(1.0).alias("cum"), F.lit(0.0).alias("var"),
                    F.expr("cast(array() as array<struct<mid:double,sd:double>>)").alias("out"))

    def step(a: Column, k: Column) -> Column:
        x = f["c"] + f["a1"] * a["x1"] + f["a2"] * a["x2"] + a["live"] * f["theta"] * f["e"]
        lvl = F.when(level, a["lvl"] + x).otherwise(x)
        w = F.when(level, a["cum"]).otherwise(a["p1"])
        var = a["var"] + w * w
        p = f["a1"] * a["p1"] + f["a2"] * a["p2"] + a["live"] * f["theta"]
        return F.struct(F.lit(0.0).alias("live"), x.alias("x1"), a["x1"].alias("x2"), lvl.alias("lvl"), p.alias("p1"), a["p1"].alias("p2"),
                        (a["cum"] + p).alias("cum"), var.alias("var"),
                        F.concat(a["out"], F.array(F.struct(lvl.alias("mid"), F.sqrt(var * f["sigma2"]).alias("sd")))).alias("out"))

    df = df.withColumn("_o", F.aggregate(_steps(F.col("h")), zero, step, lambda a: a["out"]))
    df = df.withColumns({"q10": F.transform("_o", lambda e: e["mid"] - Z80 * e["sd"]), "q50": F.transform("_o", lambda e: e["mid"]),
                         "q90": F.transform("_o", lambda e: e["mid"] + Z80 * e["sd"])}).drop("_f", "_o", "fits")
    walk = lambda z: F.transform(_steps(F.col("h")), lambda k: F.col("_last") + z * F.sqrt(k * F.col("_s2")))
    mid = F.transform(_steps(F.col("h")), lambda _: F.col("_last"))
    return df.unionByName(_last_value(tasks).withColumns({"q10": walk(-Z80), "q50": mid, "q90": walk(Z80)}).select(*df.columns))


def ma_grid(tasks: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """ARMA(1,1) on the centred series and IMA(0,1,1) by conditional least squares over a parameter grid.

    Adds the best ``model``, ``phi``, ``theta``, ``aic`` and the forecast array ``q50``. Series under six periods get
    the model "naive", their last value, without parameters.
    """
    grid = grid or [round(-0.9 + 0.1 * i, 1) for i in range(19)]
    y, n = F.col("y"), F.size("y")
    df = tasks.where(n >= 6).withColumns({"_m": _sum(y) / n}).withColumns({
        "_x": F.transform(y, lambda v: v - F.col("_m")),
        "_d": F.zip_with(F.slice(y, F.lit(2), n - 1), F.slice(y, F.lit(1), n - 1), lambda a, b: a - b)})

    def fold(x: Column, phi: Column | float, theta: Column, start: Column) -> Column:
        init = F.struct(F.lit(0.0).alias("sse"), F.lit(0.0).alias("e"), start.alias("prev"))
        return F.aggregate(x, init, lambda a, v: F.struct(
            (a["sse"] + F.pow(v - phi * a["prev"] - theta * a["e"], F.lit(2))).alias("sse"),
            (v - phi * a["prev"] - theta * a["e"]).alias("e"), v.alias("prev")))

    g = F.array(*[F.lit(v) for v in grid])
    rest = F.slice("_x", F.lit(2), n - 1)
    m = (n - 1).cast("double")

    def cand(name: str, params: int, a: Column, phi: Column, theta: Column) -> Column:
        return F.struct((m * F.log(F.greatest(a["sse"] / m, F.lit(1e-12))) + 2 * params).alias("aic"), F.lit(name).alias("model"),
                        phi.alias("phi"), theta.alias("theta"), a["e"].alias("e"))

    arma = F.flatten(F.transform(g, lambda p: F.transform(g, lambda t: cand(
        "arma11", 4, fold(rest, p, t, F.element_at("_x", 1)), p, t))))
    ima = F.transform(g, lambda t: cand("ima011", 2, fold(F.col("_d"), F.lit(0.0), t, F.lit(0.0)), F.lit(0.0), t))
    df = df.select("*", F.explode(F.array(F.array_min(F.concat(arma, ima)))).alias("_b"))
    b = F.col("_b")
    one = F.when(b["model"] == "arma11", b["phi"] * F.element_at("_x", -1) + b["theta"] * b["e"])
    path = F.transform(_steps(F.col("h")), lambda k: F.when(
        b["model"] == "arma11", F.col("_m") + one * F.pow(b["phi"], k - 1)).otherwise(F.element_at("y", -1) + b["theta"] * b["e"]))
    none = F.lit(None).cast("double")
    short = _last_value(tasks).select(*tasks.columns, F.lit("naive").alias("model"), none.alias("phi"), none.alias("theta"), none.alias("aic"),
                                      F.transform(_steps(F.col("h")), lambda _: F.col("_last")).alias("q50"))
    return df.select(*tasks.columns, "_b.model", "_b.phi", "_b.theta", "_b.aic", path.alias("q50")).unionByName(short)


def run_forecasters(tasks: DataFrame, by: list[str], models: dict = BASELINES, with_ar: bool = False) -> DataFrame:
    """All models on all tasks, long: (series keys, origin, h, t, q10, q50, q90, model)."""
    rows = [F.struct(F.lit(name).alias("model"), fn(F.col("y"), F.col("h")).alias("f")) for name, fn in models.items()]
    each = tasks.select(*by, "origin", F.explode(F.array(*rows)).alias("_m")).select(
        *by, "origin", "_m.model", F.posexplode("_m.f").alias("_i", "q50"))
    none = F.lit(None).cast("double")
    out = each.select(*by, "origin", (F.col("_i") + 1).alias("h"), (F.col("origin") + F.col("_i") + 1).alias("t"),
                      none.alias("q10"), "q50", none.alias("q90"), "model")
    if with_ar:
        ar = ar_select(tasks).select(*by, "origin", F.posexplode(F.arrays_zip("q10", "q50", "q90")).alias("_i", "_q")).select(
            *by, "origin", (F.col("_i") + 1).alias("h"), (F.col("origin") + F.col("_i") + 1).alias("t"), "_q.q10", "_q.q50", "_q.q90",
            F.lit("ar").alias("model"))
        out = out.unionByName(ar)
    return out


def _test_rows(forecasts: DataFrame, actuals: DataFrame, test_h: int) -> DataFrame:
    last = actuals.groupBy("series").agg((F.max("t") - test_h).alias("_test"))
    return (forecasts.join(last, "series").where((F.col("origin") == F.col("_test")) & (F.col("h") <= test_h))
            .join(actuals.withColumnRenamed("value", "actual"), ["series", "t"]).drop("_test"))


def score_same_origin(forecasts: DataFrame, actuals: DataFrame, rates: list[str], test_h: int = TEST_H) -> DataFrame:
    """One long run from the test origin: MAPE, RMSE and DM against naive, on the implied level for rates."""
    rows = _test_rows(forecasts, actuals, test_h)
    # one row per step of the test horizon
    w = Window.partitionBy("series", "model").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    rate = F.col("series").isin(*rates)
    level = lambda c: F.when(rate, F.product(1 + F.col(c)).over(w)).otherwise(F.col(c))
    rows = rows.select("series", "model", "h", level("q50").alias("pred"), level("actual").alias("actual"))
    ref = rows.where("model = 'naive'").select("series", "h", F.col("pred").alias("naive"))
    e, e0 = F.col("pred") - F.col("actual"), F.col("naive") - F.col("actual")
    return rows.join(ref, ["series", "h"]).groupBy("series", "model").agg(
        (F.avg(F.abs(e / F.col("actual"))) * 100).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(F.first("model") != "naive", diebold_mariano(e0, e)).alias("dm_vs_naive"))


def best_model(scores: DataFrame, by: str = "series", score: str = "mape") -> DataFrame:
    return scores.groupBy(by).agg(F.min_by("model", F.struct(score, "model")).alias("model"))


def rolling_rows(forecasts: DataFrame, actuals: DataFrame, roll_h: int = ROLL_H) -> DataFrame:
    """Forecasts from rolling origins with their actual, error, coverage and quantile loss (in points)."""
    span = actuals.groupBy("series").agg(F.greatest(F.min("t") + 7, F.max("t") - 17).alias("_a"), (F.max("t") - roll_h).alias("_b"))
    rows = (forecasts.join(span, "series").where(F.col("origin").between(F.col("_a"), F.col("_b")) & (F.col("h") <= roll_h))
            .join(actuals.withColumnRenamed("value", "actual"), ["series", "t"]).drop("_a", "_b"))
    has = F.col("q10").isNotNull()
    loss = sum((pinball("actual", f"q{int(q * 100)}", q) for q in (0.1, 0.5, 0.9)), F.lit(0.0)) * 2 / 3 * 100
    return rows.withColumns({
        "abs_err": F.abs(F.col("q50") - F.col("actual")) * 100,
        "covered": F.when(has, ((F.col("actual") >= F.col("q10")) & (F.col("actual") <= F.col("q90"))).cast("double")),
        "qloss": F.when(has, loss)})


def score_rolling(rows: DataFrame, roll_h: int = ROLL_H) -> DataFrame:
    """MAE, MAE relative to naive, MAE per horizon, coverage and quantile loss per series and model."""
    s = rows.groupBy("series", "model").agg(
        F.avg("abs_err").alias("mae"), *[F.avg(F.when(F.col("h") == k, F.col("abs_err"))).alias(f"mae_h{k}") for k in range(1, roll_h + 1)],
        (F.avg("covered") * 100).alias("coverage_80"), F.avg("qloss").alias("quantile_loss"))
    ref = s.where("model = 'naive'").select("series", F.col("mae").alias("_naive"))
    return s.join(ref, "series").withColumn("rel_mae", F.try_divide(F.col("mae"), F.col("_naive"))).drop("_naive")


def rolling_dm(rows: DataFrame, model: str, reference: str, h: int = ROLL_H) -> DataFrame:
    """Small-sample Diebold-Mariano of two models on mean errors per origin."""
    per = rows.where(F.col("model").isin(model, reference)).groupBy("series", "origin").agg(
        F.avg(F.when(F.col("model") == model, F.col("abs_err"))).alias("a"),
        F.avg(F.when(F.col("model") == reference, F.col("abs_err"))).alias("b"))
    return dm_hln(per, ["series"], "origin", "a", "b", h)


def overall_scores(rolling: DataFrame) -> DataFrame:
    """Per model: geometric mean of relative MAE, mean coverage and loss, mean rank among models."""
    w = Window.partitionBy("series")  # one row per model
    rank = F.rank().over(w.orderBy("mae")) + (F.count("*").over(Window.partitionBy("series", "mae")) - 1) / 2
    return rolling.withColumn("_rank", rank).groupBy("model").agg(
        F.exp(F.avg(F.log("rel_mae"))).alias("rel_mae"), F.avg("coverage_80").alias("coverage_80"),
        F.avg("quantile_loss").alias("quantile_loss"), F.avg("_rank").alias("mean_rank"))


def future_forecasts(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    last = actuals.groupBy("series").agg(F.max("t").alias("_last"))
    return forecasts.join(last, "series").where(F.col("origin") == F.col("_last")).drop("_last", "origin")


def forecast_coverage(forecasts: DataFrame, tasks: DataFrame, by: list[str]) -> DataFrame:
    """Per model: tasks covered, forecast rows against rows expected, rows whose quantiles are out of order."""
    need = tasks.agg(F.count("*").alias("n"), F.sum("h").alias("r"))
    wrong = (F.col("q10") > F.col("q50")) | (F.col("q50") > F.col("q90"))
    return forecasts.groupBy("model").agg(
        F.count_if(F.col("h") == 1).alias("tasks_covered"), F.count("*").alias("rows"), F.count_if(wrong).alias("disordered")
    ).withColumns({"tasks": need.select("n").scalar(), "rows_expected": need.select("r").scalar()})


def growth_rate(first: Column, last: Column, years: int) -> Column:
    return F.pow(F.try_divide(last, first), F.lit(1 / years)) - 1 if years else F.lit(math.nan)
