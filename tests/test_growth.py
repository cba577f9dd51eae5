"""Figures that must not grow with the rows: what meets the driver, and what models are trained on."""

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from rollcall.functions.keys import exact_sum
from rollcall.operators import answers as A
from rollcall.operators import explain as X
from rollcall.operators import panel as P
from rollcall.operators import pay as E
from rollcall.operators import quality as Q
from rollcall.operators import risk as K
from rollcall.plans import record_checks, texts


def test_run_off_does_not_broadcast_the_index(spark):
    benefits = spark.createDataFrame([("S", r, "ASIA", 60, 1, 1.0, 10.0, 2, 1.0) for r in range(3)],
                                     "scenario string, run long, sector string, age int, t int, mortality_mult double, benefit double, n long, pidx double")
    index = spark.range(3).select(F.lit("S").alias("scenario"), F.col("id").alias("run"), F.lit("ASIA").alias("sector"),
                                  F.explode(F.sequence(F.lit(0), F.lit(3))).alias("t")).withColumn("pidx", F.lit(1.0))
    out = E.benefit_run_off(benefits, index, P.life_table(spark, 0.0006, 0.00004, 0.092), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 2      # only the life table, twice
    got = {(r.run, r.t): r.payments for r in out.collect()}
    assert set(got) == {(r, t) for r in range(3) for t in (2, 3)}
    assert all(got[r, 2] == pytest.approx(20.0) and got[r, 3] < 20.0 for r in range(3))


def test_exact_sums_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(1e18,), (0.25,), (-1e18,)], "v double").coalesce(1)
    assert df.agg(F.sum("v")).first()[0] == 0.0         # what doubles lose
    assert df.agg(exact_sum(F.col("v"))).first()[0] == 0.25


def test_boosted_trees_train_on_counted_steps(spark, monkeypatch):
    seen = []

    class Trees(GBTClassifier):
        def _fit(self, data):
            seen.append((data.count(), data.agg(F.sum("_weight")).first()[0] if "_weight" in data.columns else None))
            return super()._fit(data)

    monkeypatch.setattr(K, "GBTClassifier", Trees)
    monkeypatch.setattr("rollcall.operators.boosting.DRAWS", 1000, raising=False)
    for n in (2000, 8000):
        x = F.pmod(F.xxhash64("id"), F.lit(1000003)) / 1000003
        rows = spark.range(n).withColumns({f: F.lit(0.0) for f in K.FEATURES}).withColumns({"avg_return": x, "year": F.lit(2030)})
        rows = rows.withColumn("label", (F.col("avg_return") > 0.5).cast("int"))
        out = K.risk_classifier(rows, rounds=3)(rows)
        assert out.columns == [*rows.columns, "prob"]
        assert out.where((F.col("prob") > 0.5) != (F.col("label") == 1)).count() <= 0.05 * n
        assert seen[-1][0] <= 1000 + 2 * 32 and seen[-1][1] == pytest.approx(n)


def test_contributions_of_trees_are_counted_on_steps(spark):
    x = F.pmod(F.xxhash64("id"), F.lit(1000003)) / 1000003
    rows = spark.range(3000).select(x.alias("a"), (F.col("id") % 3).cast("double").alias("b")).withColumn("y", F.col("a") * 2 + F.col("b"))
    groups = {"a": ["a"], "b": ["b"]}
    got = X.contributions(rows, groups, X.boosted(rows, ["a", "b"], "y", rounds=5)).collect()
    assert len(got) <= 32 * 3 and sum(r.weight for r in got) == 3000
    assert all(r.predicted - r.base == pytest.approx(r.phi_a + r.phi_b) for r in got)


def test_isotonic_fit_on_counted_chances_is_the_same(spark):
    cal = spark.createDataFrame([(i % 7 / 10, int(i * i % 11 < i % 7)) for i in range(200)], "prob double, label int")
    plain = IsotonicRegression(featuresCol="prob", labelCol="label", predictionCol="calibrated").fit(cal).transform(cal)
    want, got = ({r.prob: r.calibrated for r in t.collect()} for t in (plain, K.isotonic_calibration(cal)(cal)))
    assert got == pytest.approx(want)
    with pytest.raises(Exception):
        K.isotonic_calibration(cal.unionAll(spark.createDataFrame([(0.5, None)], cal.schema)))


@pytest.fixture
def no_small_tables(spark):
    """Spark's own broadcasts off: what is broadcast then was counted."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_questions_asked_often_are_routed_once(spark, monkeypatch):
    seen, route = [], A.route_questions
    monkeypatch.setattr(A, "route_questions", lambda df, *a: seen.append(df.count()) or route(df, *a))
    asked = ["What if the retirement age rises to 60?", "What is the rate of red widget?", None]
    monkeypatch.setattr(texts, "both_languages", lambda spark, d: spark.createDataFrame([(i, asked[i % 3]) for i in range(30)], "id long, q string"))
    monkeypatch.setattr(texts, "units", lambda spark, d: ("Kampot",))
    monkeypatch.setattr(texts, "topics", lambda spark, d: spark.createDataFrame([("red widget", "red widget"), ("inflation", "inflation")], "entry string, text string"))
    got = {r.id: r for r in texts.clean_both(spark, "").collect()}
    assert seen == [3] and len(got) == 30
    for i, r in got.items():
        assert (r.tool, r.retirement_age) == (("run_reform", 60), ("explain_assumption", None), ("none", None))[i % 3]


def test_values_worked_on_once_reach_all_rows(spark):
    from rollcall.functions.keys import per_distinct
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else i % 4, [i % 2]) for i in range(40)], "id int, k int, l array<int>")
    for most in (100, 0):       # broadcast, and joined by key
        out = per_distinct(rows, ["k", "l"], lambda t: t.withColumn("twice", F.col("k") * 2), most)
        assert sorted((r.id, r.twice) for r in out.collect()) == [(i, None if i % 4 == 0 else i % 4 * 2) for i in range(40)]


def test_few_lists_of_sources_go_to_the_rows(spark, no_small_tables):
    stated = A.source_numbers(spark.createDataFrame([("A1", "in 1,250 cases"), ("A2", "7.50")], "s string, t string"), "s", "t")
    rows = spark.createDataFrame([(1, ["A1"]), (2, ["A1", "A2"]), (3, ["A9"]), (4, None)], "id int, sources array<string>")
    out = A.numbers_of_sources(rows, "sources", stated)
    assert "SortMergeJoin" not in executed(out)
    assert {r.id: sorted(r._from_sources) for r in out.collect()} == {1: ["1250"], 2: ["1250", "7.5"], 3: [], 4: []}


def test_shared_keys_are_summed_from_the_keys(spark, no_small_tables):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    out = Q.shared_key_summary(df, "k")
    assert "Join" not in executed(out)
    flagged = Q.shared_key_flag(df, "k").groupBy("shared_account").agg(F.count("*").alias("n"), F.count_distinct("k").alias("accounts"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, flagged.collect())) == [(False, 3, 1), (True, 2, 1)]


def test_persons_are_counted_without_the_join_for_ids(spark, monkeypatch, no_small_tables):
    names = ["record_id", "national_id", "full_name", "birth_date", "sex", "age", "eligible60", "attendance_days_q", "basic_salary", "expected", "allowance"]
    rows = [("a", 1, "x", 5, "F", 30, True, 1, 1.0, 1.0, 0.0), ("b", 1, "y", 5, "F", 30, True, 1, 1.0, 1.0, 0.0), ("c", 2, "x", 5, "F", 30, True, 1, 1.0, 1.0, 0.0),
            ("d", 3, "z", None, "F", 70, True, 0, 99.0, 1.0, 0.0)]
    monkeypatch.setattr(record_checks.V, "records", lambda spark, d: spark.createDataFrame(rows, names))
    out = record_checks.flagged(spark, "")
    assert executed(out).count("SortMergeJoin") == 2
    assert {r.record_id: (r.dup_national_id, r.matched, r.flag) for r in out.collect()} == {
        "a": (False, False, False), "b": (True, True, True), "c": (False, True, True), "d": (False, False, True)}


def test_parts_of_scores_are_added_up_where_they_arise(spark):
    c = spark.createDataFrame([(1, "red ring"), (2, "blue ring"), (3, "red bolt")], "e int, text string")
    q = spark.createDataFrame([(7, "a red ring"), (8, "blue")], "q int, text string")
    out = A.tfidf_search(c, q, "e", "q", "text", k=1)
    assert "hashpartitioning(q#" in executed(out) and not any("hashpartitioning(q#" in x and ", e#" in x for x in executed(out).splitlines())
    assert {r.q: r.e for r in out.collect()} == {7: 1, 8: 2}


def test_values_are_rounded_only_for_numbers_left(spark):
    facts = [("share", 0.1234, "pct", "12.3%")]
    rows = spark.createDataFrame([(1, "It is 12.3%.", facts), (2, "It is 12.34%.", facts), (3, "It is 12.35%.", facts)],
                                 "id int, text string, shown array<struct<key:string,value:double,kind:string,shown:string>>")
    out = A.grounding_check(rows.withColumns({"q": F.lit("?"), "sources": F.array().cast("array<string>")}), "text", "q", "shown", "sources")
    assert "CASE WHEN (size(_left" in executed(out)
    assert {r.id: r.grounded for r in out.collect()} == {1: True, 2: True, 3: False}


def test_run_out_years_are_worked_out_once_for_equal_pay_and_rates(spark, monkeypatch):
    from rollcall.plans import funds, risks
    from rollcall.plans import settings as S
    x = [(r, t, ((r * 37 + t * 11) % 23) * (20.0 + 30 * r)) for r in range(6) for t in range(S.PATH_YEARS)]
    paths = spark.createDataFrame(x, "run long, t int, x double").selectExpr(
        "run", "t", f"{S.BASE_YEAR} + t AS year", "x", "x * 0.0001 AS real_growth", "x * 0.00005 AS inflation", "x * 0.00002 AS real_return",
        "0.2 + x * 0.00001 AS revenue_share", "0.9 + 0.02 * (run % 11) AS mortality_mult")
    units = spark.createDataFrame([("ASIA", 0.7, 0.8), ("AFRICA", 0.3, 0.4)], "sector string, basic_units double, total_units double")
    monkeypatch.setattr(funds.V, "paths", lambda spark, d: paths)
    monkeypatch.setattr(funds, "start_units", lambda spark, d: F.broadcast(units))
    want = E.depletion_year(funds.ledger(spark, "", risks.SETTINGS)[1], S.BASE_YEAR)
    want = {(r.scenario, r.run): r.depletion_year for r in want.collect()}
    assert len(want) == 49 * 6 and 0 in want.values() and len(set(want.values())) > 5
    seen, index = [], E.salary_index
    monkeypatch.setattr(E, "salary_index", lambda paths, *rest: seen.append(paths.count()) or index(paths, *rest))
    monkeypatch.setattr(funds, "flow_table", lambda *given: pytest.fail("a row per setting, run and year is written"))
    rows = risks.training(spark, "", risks.SETTINGS).collect()
    assert {(r.scenario, r.run): r.run_out for r in rows} == {k: v or risks.NEVER for k, v in want.items()}
    assert len(rows) == len(want) and seen == [3 * 6 * S.PATH_YEARS]            # three rules of pay, not 49 settings


def test_logistic_risk_scales_without_a_pass_of_its_own(spark, monkeypatch):
    import pyspark.ml.feature
    rows = [tuple(float((i * (j + 3)) % (5 + j)) for j in range(len(K.FEATURES) + 1)) + (int(i % 7 < 3),) for i in range(200)]
    train = spark.createDataFrame(rows, [*K.FEATURES, "year", "label"])

    def mean():
        return K.logistic_risk(train)(train).agg(F.avg("prob"), F.avg((F.col("prob") - F.col("label")) ** 2)).first()
    one = mean()
    assert one[0] == pytest.approx(87 / 200, abs=0.005) and one[1] < 0.25
    monkeypatch.setattr(pyspark.ml.feature.StandardScaler, "fit", lambda *given: pytest.fail("another pass over the rows"))
    assert mean() == one


def test_few_groups_are_split_without_moving_their_rows(spark):
    rows = spark.range(2000).select((F.col("id") % 7).cast("string").alias("g"), "id").checkpoint()
    out = K.group_split(rows, "g", {"train": 0.7, "cal": 0.85, "test": 1.01})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "hashpartitioning" not in plan
    parts = {(r.g, r.part) for r in out.select("g", "part").distinct().collect()}
    assert out.count() == 2000 and len(parts) == 7 and {p for _, p in parts} == {"train", "cal", "test"}


def test_first_benefits_are_worked_out_once_for_equal_pay(spark, monkeypatch):
    from rollcall.plans import catalog, funds
    retired = [(t, s, "AB"[a % 2], a, 2 + a % 3, 1 + a % 4) for t in (2, 3) for s in ("ASIA", "AFRICA") for a in range(50, 62)] + [(2, "ASIA", "A", None, None, 5)]
    paths = spark.range(9).select(F.col("id").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("t")).selectExpr(
        "run", "t", "0.9D AS mortality_mult", "CASE WHEN run < 8 THEN pow(1.0 + 0.01 * (run % 3), t) END AS cpi")
    monkeypatch.setattr(funds.V, "retirees", lambda spark, d: spark.createDataFrame(retired, "t int, sector string, framework string, age int, service int, n long"))
    monkeypatch.setattr(funds.V, "level_paths", lambda spark, d: paths)
    n = F.col("n")
    want = funds.benefits(spark, "").groupBy("scenario", "t", "sector").agg(
        F.round(exact_sum(n * F.col("benefit")) / 1e9, 6).alias("benefit"), F.round(exact_sum(n * F.col("final")) / 1e9, 6).alias("final"),
        F.sum(F.when(F.col("formula") <= F.col("floor"), n).otherwise(0)).alias("on_floor"))
    want = {(r.scenario, r.t, r.sector): r for r in want.collect()}
    seen, benefit = [], E.initial_benefit
    monkeypatch.setattr(E, "initial_benefit", lambda people, index, *rest: seen.append((people, index)) or benefit(people, index, *rest))
    got = catalog.QUERIES["e07_initial_benefit"](spark, "").collect()
    assert len(got) == len(want) == 7 * 2 * 2 and all(r == want[r.scenario, r.t, r.sector] for r in got)
    people, index = seen[0]
    assert people.count() == 25 and people.agg(F.sum("n")).first()[0] == sum(r[-1] for r in retired)
    assert index.where("t NOT IN (2, 3)").count() == 0 and index.agg(F.sum("runs")).first()[0] == 9 * 7 * 2 * 5
    assert index.count() == (5 * 1 + 2 * 4) * 2 * 5         # pay of five presets is the same in all runs, two follow prices


def test_rows_that_share_a_key_are_told_apart_without_moving_the_rows(spark):
    rows = [(i, f"n{i}", i % 500 if i < 505 else 1000 + i, None if i in (700, 701) else i) for i in range(800)] + [(900, None, 5000, 900)]
    df = spark.createDataFrame(rows, "id long, name string, a long, b long").repartition(3).checkpoint()
    alone, others = Q.repeated_apart(df, [["id"], ["name", "b"], ["a"], ["b"]])
    assert "Exchange" not in executed(alone) and "Exchange" not in executed(others)
    got = {r.id for r in others.collect()}
    assert {r.id for r in alone.collect()} == {r[0] for r in rows} - got
    shared = {i for i in range(5)} | {i for i in range(500, 505)} | {700, 701}
    assert shared <= got and len(got) < 30


def test_a_quantile_is_looked_for_in_its_step_only(spark, monkeypatch):
    from rollcall.functions import ordered as O
    df = spark.range(2000).select((F.pmod(F.xxhash64("id"), F.lit(997)) / 997).alias("v")).unionAll(spark.sql("SELECT CAST(NULL AS DOUBLE)"))
    seen, placed = [], O.placed
    for p in (0.0, 0.5, 0.98, 0.9803, 1.0):
        want = O.exact_quantiles(df, [], "v", {"q": p}).first()[0]
        with monkeypatch.context() as m:
            m.setattr(O, "placed", lambda rows, *rest: seen.append(rows.count()) or placed(rows, *rest))
            assert O.narrow_quantile(df, "v", p) == pytest.approx(want, abs=1e-12)
    assert max(seen) < 20
    assert O.narrow_quantile(spark.sql("SELECT 0.25D AS v"), "v", 0.98) == 0.25


def test_flags_meet_scores_without_a_join_of_the_records(spark, monkeypatch, no_small_tables):
    rows = [(f"r{i}", i if i > 3 else 1, i, f"x{i % 57}", i % 60, "FM"[i % 2], "s", "ANR"[i % 3], "m", "p", i % 9, 30 + i % 40, i % 2 == 0,
             100.0 + i, 3.0, i % 7, 20.0) for i in range(60)]
    rows += [(*rows[7][:11], 70, *rows[7][12:15], 0, 20.0), ("r90", None, None, None, 1, "F", "s", "A", "m", "p", 1, 30, True, 5.0, None, None, 20.0)]
    rows.append((None, *rows[8][1:]))
    schema = ("record_id string, national_id long, bank_account long, full_name string, birth_date int, sex string, sector string, framework string, ministry string, "
              "province string, service int, age int, eligible60 boolean, basic_salary double, allowance double, attendance_days_q int, expected double")
    monkeypatch.setattr(record_checks.V, "records", lambda spark, d: spark.createDataFrame(rows, schema))
    f = record_checks.flagged(spark, "").join(record_checks.forest(spark, ""), "record_id")
    f = Q.flag_and_split(f, list(Q.RULES), ["past_retirement", "no_attendance", "off_scale_salary"], ["matched", "iforest_flag"])
    want = {(r.flag, r.iforest_flag): (r.n, r.pay) for r in f.groupBy("flag", "iforest_flag").agg(F.count("*").alias("n"), F.sum(record_checks.PAY()).alias("pay")).collect()}
    joined, join = [], type(f).join

    def counted(self, other, *rest):
        joined.append(max(self.count(), other.count()))
        return join(self, other, *rest)

    monkeypatch.setattr(type(f), "join", counted)
    got = {(r.flag, r.iforest_flag): (r.n, r.pay) for r in record_checks.flag_with_forest(spark, "").collect()}
    assert sum(n for n, _ in got.values()) == sum(n for n, _ in want.values()) == 60 - 1 + 4 + 1 and set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert joined and max(joined) < 20


def test_other_models_are_fitted_while_trees_train(spark, monkeypatch):
    from threading import Event

    from rollcall.plans import risks
    few = spark.createDataFrame([(1, "a", 2030)], "run long, scenario string, run_out int")
    begun = {"logit": Event(), "line": Event()}

    def other(name):
        return lambda *given: begun[name].set() or name

    def trees(train, *rest):
        assert all(e.wait(20) for e in begun.values())       # they begin while trees are still training
        return lambda df: df.withColumn("prob", F.lit(0.5))

    monkeypatch.setattr(risks, "parts", lambda spark, d: [few] * 3)
    monkeypatch.setattr(K, "risk_classifier", trees)
    monkeypatch.setattr(K, "logistic_risk", other("logit"))
    monkeypatch.setattr(K, "linear_conformal", other("line"))
    monkeypatch.setattr(K, "isotonic_calibration", lambda cal: cal.columns)
    score, fix, logit, rates, line, _ = risks.fitted(spark, "")
    assert (logit, line) == ("logit", "line") and "prob" in fix and rates.count() > 0
    from rollcall.functions.keys import side_by_side
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, lambda: 1, lambda: 1 / 0)
