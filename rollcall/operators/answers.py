"""Questions, answers and documents as tables: routing, cleaning, grounding, scoring, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import BROADCAST_ROWS, DISTINCT_ROWS, bounded, written
from ..functions.ordered import numbered

# ---- fixed values: routing patterns, setting ranges, label years ----
STOP_WORDS = ("a", "about", "an", "and", "are", "as", "at", "be", "by", "for", "from", "had", "has", "have", "how", "in",
              "is", "it", "its", "of", "on", "or", "that", "the", "their", "they", "this", "to", "was", "were", "what",
              "when", "which", "will", "with")
CHEAPEST = "cheapest|lowest cost|least cost|ថោកបំផុត"
GENEROUS = "most generous|highest (pension|replacement)|best pension"
UNIT_WORDS = "province|ministr|ខេត្ត|ក្រសួង"
MINISTRY_WORDS = "ministr|ក្រសួង"
EXIT_WORDS = "leave|leaving|lose|exits|retirement wave|shortage|ចាកចេញ|បាត់បង់|រលក"
YEARS_AHEAD = r"(\d+)\s*(?:years?|ឆ្នាំ)"
RETIRE_AGE = r"(?:retire\w*|retirement age|អាយុចូលនិវត្តន៍|ចូលនិវត្តន៍)\D{0,25}?(\d{2})\b"
ACCRUAL = "accrual|per year of service|តាមឆ្នាំសេវា|ប្រមូលផ្តុំ"
RISE = r"(?:contribution\w*|ភាគទាន)\D{0,40}?(\d(?:\.\d+)?)\s*(?:points?|pp|percentage|%|ពិន្ទុ)"
INFLATION = "inflation|អតិផរណា"
PAY_WORDS = "pay|salar|wage|raise|index|បៀវត្ស"
PAY_LEVERS = "pay|បៀវត្ស"
TARGETED = "targeted|teachers and health|education and health|អប់រំ និងសុខាភិបាល"
RESTRAIN = "only replace|replace only|restrain|hiring freeze|freeze hiring|ទប់"
COMPARE = r"compare|which\b.*\bscenarios?|ប្រៀបធៀប|សេណារីយ៉ូណា"
FUND = "fund.*(run out|deplet|risk)|status quo|មូលនិធិ.*អស់"
EXPLAIN = r"\b(what|how|where|which|define|explain)\b|assum|formula|rate|source|រូបមន្ត|សន្មត|អត្រា|ប្រភព"
LATIN = "[A-Za-z]{3}"
SCENARIO_WORDS = (("status quo", "S0"), ("inflation-indexed pay", "S1"), ("targeted pay", "S2"), ("combined reform", "S5"),
                  ("workforce restraint", "S6"), ("ស្ថានភាពបច្ចុប្បន្ន", "S0"), ("កំណែទម្រង់រួម", "S5"))
TOPICS = (("រូបមន្តសោធន", "current pension formula"), ("ភាគទាន", "contribution rates"), ("អប្បបរមា", "minimum pension"), ("ចំនួនមន្ត្រី", "headcount"),
          ("ថ្លៃដើមសរុប", "total cost definition"), ("អតិផរណា", "inflation"), ("អាយុចូលនិវត្តន៍", "retirement age"), ("មូលនិធិ", "fund reserve"), ("GDP", "GDP"))
CODES = ("S0", "S1", "S2", "S3", "S4", "S5", "S6")
PAY_RULES = ("recent_average", "inflation", "targeted")
GOALS = ("cheapest_for_replacement", "most_adequate_within_cost")
LABEL_YEARS = ("2026", "2027", "2036", "2046", "2047", "2076")
# ---- end of fixed values ----

SLOTS = ("goal", "target", "include_pay_levers", "level", "years_ahead", "retirement_age", "pension_formula",
         "accrual_rate_percent", "contribution_rise_points", "pay_rule", "restrain_hiring", "base_scenario", "codes")


def _found(text: Column, pattern: str) -> Column:
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", hit)


# the first rule whose condition holds names the tool; conditions are the columns of `_conditions`
RULES = (("find_best_reform", "cheapest"), ("find_best_reform", "generous"), ("staff_exits", "exits"), ("run_reform", "reform"),
         ("compare_scenarios", "compare"), ("run_reform", "fund"), ("explain_assumption", "explain"))


def _stated(q: Column, ql: Column, units: tuple[str, ...]) -> dict[str, Column]:
    """What a question states, whatever tool it is for; null where it does not."""
    coded = F.transform(F.regexp_extract_all(ql, F.lit(r"\bs([0-6])\b"), 1), lambda x: F.concat(F.lit("S"), x))
    named = F.array_compact(F.array(*[F.when(F.contains(ql, F.lit(w)), c) for w, c in SCENARIO_WORDS]))
    age, rise = _found(ql, RETIRE_AGE).cast("int"), _found(ql, RISE).cast("double")
    accrual, pays = ql.rlike(ACCRUAL), ql.rlike(PAY_WORDS)
    rate = _found(F.regexp_replace(ql, "^.*?accrual", ""), r"(\d(?:\.\d+)?)\s*%").cast("double")
    listed = F.filter(F.array(*[F.lit(u) for u in units]).cast("array<string>"), lambda u: F.contains(ql, F.lower(u)))
    topic = F.array_join(F.array_compact(F.array(*[F.when(F.contains(q, F.lit(w)), t) for w, t in TOPICS])), " ")
    return {
        "pct": _found(q, r"(\d+(?:\.\d+)?)\s*%").cast("double"), "codes": F.array_distinct(F.concat(coded, named)),
        "retirement_age": F.when(age.between(50, 70), age), "pension_formula": F.when(accrual, "accrual"),
        "accrual_rate_percent": F.when(accrual & rate.between(0.5, 4), rate), "contribution_rise_points": rise,
        "pay_rule": F.when(ql.rlike(INFLATION) & pays, "inflation").when(ql.rlike(TARGETED) & pays, "targeted"),
        "restrain_hiring": F.when(ql.rlike(RESTRAIN), True), "unit": F.try_element_at(listed, F.lit(1)),
        "topic": F.when(q.rlike(LATIN), q).when(topic != "", topic)}


def _conditions(ql: Column, s: dict[str, Column]) -> dict[str, Column]:
    settings = ("retirement_age", "pension_formula", "contribution_rise_points", "pay_rule", "restrain_hiring")
    reform = F.lit(False)
    for name in settings:
        reform = reform | s[name].isNotNull()
    return {"cheapest": ql.rlike(CHEAPEST), "generous": ql.rlike(GENEROUS) & F.contains(ql, F.lit("gdp")),
            "exits": (ql.rlike(UNIT_WORDS) | s["unit"].isNotNull()) & ql.rlike(EXIT_WORDS), "reform": reform,
            "compare": (F.size(s["codes"]) > 0) | ql.rlike(COMPARE), "fund": ql.rlike(FUND), "explain": ql.rlike(EXPLAIN) & s["topic"].isNotNull()}


def route_questions(df: DataFrame, question: str, units: tuple[str, ...] = ()) -> DataFrame:
    """The tool a question calls for and the settings it states: ordered rules in both languages, first match wins.

    ``units`` is the caller's list of unit names; the first one that a question names is its ``unit``.
    """
    q = T.plain_digits(F.col(question))
    ql = F.lower(q)
    stated = _stated(q, ql, units)
    holds = _conditions(ql, stated)
    tool = F.coalesce(*[F.when(holds[c], F.lit(t)) for t, c in RULES], F.lit("none"))
    df = df.withColumns({"tool": tool, "_cheap": holds["cheapest"], "_reform": holds["reform"]})
    best, staff, run = F.col("tool") == "find_best_reform", F.col("tool") == "staff_exits", (F.col("tool") == "run_reform") & F.col("_reform")
    years = F.coalesce(_found(ql, YEARS_AHEAD).cast("int"), F.lit(10))
    out = {
        "goal": F.when(best, F.when(F.col("_cheap"), GOALS[0]).otherwise(GOALS[1])),
        "target": F.when(best, F.coalesce(stated["pct"], F.when(F.col("_cheap"), 60.0).otherwise(3.5))),
        "include_pay_levers": F.when(best, F.col("_cheap") & ql.rlike(PAY_LEVERS)),
        "level": F.when(staff, F.when(ql.rlike(MINISTRY_WORDS), "ministry").otherwise("province")), "years_ahead": F.when(staff, years),
        **{c: F.when(run, stated[c]) for c in ("retirement_age", "pension_formula", "accrual_rate_percent", "contribution_rise_points", "pay_rule", "restrain_hiring")},
        "base_scenario": F.when(run & (F.size(stated["codes"]) == 1), stated["codes"][0]),
        "codes": F.when(F.col("tool") == "compare_scenarios", F.concat_ws(",", stated["codes"])),
        "unit": F.when(staff, stated["unit"]), "topic": F.when(F.col("tool") == "explain_assumption", stated["topic"])}
    return df.withColumns(out).drop("_cheap", "_reform")


def confirm_topics(routed: DataFrame, corpus: DataFrame, corpus_key: str, text: str) -> DataFrame:
    """Questions for an explanation that the corpus knows nothing about go to no tool; each distinct topic is searched once."""
    topics = routed.where("topic IS NOT NULL").select("topic").distinct().withColumn(text, F.col("topic"))
    known = tfidf_search(corpus, topics, corpus_key, "topic", text, k=1).select("topic", F.lit(True).alias("_known"))
    out = routed.join(known, "topic", "left")
    lost = (F.col("tool") == "explain_assumption") & F.col("_known").isNull()
    return out.withColumns({"tool": F.when(lost, "none").otherwise(F.col("tool")), "topic": F.when(~lost, F.col("topic"))}).drop("_known")


def stated_args(routed: DataFrame) -> DataFrame:
    """The settings of routed questions as the argument map that ``clean_settings`` takes."""
    items = [v for c in (*SLOTS, "unit", "topic") for v in (F.lit(c), F.col(c).cast("string"))]
    return routed.select(*[c for c in routed.columns if c not in (*SLOTS, "unit", "topic")], F.map_filter(F.create_map(*items), lambda _, v: v.isNotNull()).alias("args"))


def parse_tool_calls(df: DataFrame, col: str) -> DataFrame:
    """A call written as JSON text inside an answer: tool name and arguments as text."""
    body = F.regexp_extract(col, r"(?s)(\{.*\})", 1)
    call = F.from_json(body, "name string, tool string, args map<string,string>, arguments map<string,string>, parameters map<string,string>")
    df = df.withColumn("_c", call)
    return df.withColumns({"tool": F.coalesce("_c.name", "_c.tool", F.lit("none")),
                           "args": F.coalesce("_c.args", "_c.arguments", "_c.parameters", F.create_map().cast("map<string,string>"))}).drop("_c")


def clean_settings(df: DataFrame, args: str = "args") -> DataFrame:
    """Known settings of each tool, coerced and clamped to the ranges the model supports."""
    tool = F.col("tool")

    def raw(name: str) -> Column:
        return F.try_element_at(F.col(args), F.lit(name))

    def num(name: str) -> Column:
        return T.number_of(raw(name))

    def clamp(x: Column, lo: float, hi: float) -> Column:
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))

    run, cmp, best, staff = (tool == t for t in ("run_reform", "compare_scenarios", "find_best_reform", "staff_exits"))
    rate = num("accrual_rate_percent")
    rate = F.when(rate > 0, F.round(clamp(F.when(rate < 0.1, rate * 100).otherwise(rate), 1.0, 3.0), 2))
    rise = num("contribution_rise_points")
    rise = F.round(clamp(F.when((rise > 0) & (rise < 0.1), rise * 100).otherwise(rise), 0.0, 4.0), 1)
    goal = F.when(raw("goal").isin(*GOALS), raw("goal")).otherwise(GOALS[0])
    target = num("target")
    target = F.when(goal == GOALS[0], F.when(target.isNull(), 60.0).when(target <= 1, target * 100).otherwise(target)).otherwise(
        F.coalesce(target, F.lit(3.5)))
    # a JSON list arrives as its text
    asked = F.split(F.regexp_replace(F.upper(F.coalesce(raw("codes"), F.lit(""))), r'[\[\]" ]', ""), ",")
    known = F.filter(F.array(*[F.lit(c) for c in CODES]), lambda c: F.array_contains(asked, c))
    every = F.array(*[F.lit(c) for c in CODES])
    years = num("years_ahead")
    return df.withColumns({
        "base_scenario": F.when(run & F.upper(raw("base_scenario")).isin(*CODES), F.upper(raw("base_scenario"))),
        "retirement_age": F.when(run, clamp(F.bround(num("retirement_age"), 0), 55.0, 65.0).cast("int")),
        "accrual_rate_percent": F.when(run, rate),
        "pension_formula": F.when(run, F.when(rate.isNotNull(), "accrual").when(raw("pension_formula").isin("current", "accrual"), raw("pension_formula"))),
        "contribution_rise_points": F.when(run, rise),
        "pay_rule": F.when(run & raw("pay_rule").isin(*PAY_RULES), raw("pay_rule")),
        "restrain_hiring": F.when(run & raw("restrain_hiring").isin("true", "false"), raw("restrain_hiring") == "true"),
        "codes": F.when(cmp, F.concat_ws(",", F.when(F.size(known) > 0, known).otherwise(every))),
        "goal": F.when(best, goal), "target": F.when(best, F.round(target, 2)),
        "include_pay_levers": F.when(best, F.coalesce(raw("include_pay_levers") == "true", F.lit(False))),
        "level": F.when(staff, F.when(raw("level").isin("province", "ministry"), raw("level")).otherwise("province")),
        "years_ahead": F.when(staff, F.coalesce(clamp(F.bround(years, 0), 5.0, 15.0).cast("int"), F.lit(10))),
        "unit": F.when(staff, F.nullif(F.trim(raw("unit")), F.lit(""))),
        "topic": F.when(tool == "explain_assumption", F.trim(F.coalesce(raw("topic"), F.lit(""))))})


SIGNATURE = ("tool", "base_scenario", "retirement_age", "pension_formula", "accrual_rate_percent", "contribution_rise_points",
             "pay_rule", "restrain_hiring", "codes", "goal", "target", "include_pay_levers", "level", "years_ahead", "unit")


def settings_signature(df: DataFrame, out: str = "signature") -> DataFrame:
    """One canonical key per set of cleaned settings; the accrual rate counts only with the accrual formula, a reform
    without a base starts from S0, and units are compared in lower case. Topics are judged by citations, not here."""
    cols = []
    for c in SIGNATURE:
        v = F.col(c)
        if c == "accrual_rate_percent":
            v = F.when(F.col("pension_formula") == "accrual", v)
        if c in ("accrual_rate_percent", "contribution_rise_points", "target"):
            v = F.bround(v * 100, 0).cast("bigint")
        if c == "base_scenario":
            v = F.when(F.col("tool") == "run_reform", F.coalesce(v, F.lit(CODES[0])))
        if c == "unit":
            v = F.lower(v)
        cols.append(F.coalesce(v.cast("string"), F.lit("-")))
    return df.withColumn(out, F.sha2(F.concat_ws("|", *cols), 256))


def format_facts(facts: Column) -> Column:
    """Facts (array of key, value, kind, text) with their display text."""
    return F.transform(facts, lambda f: F.struct(
        f["key"].alias("key"), f["value"].alias("value"), f["kind"].alias("kind"),
        T.format_fact(f["value"], f["kind"], f["text"]).alias("shown")))


def fill_placeholders(df: DataFrame, template: str, shown: str, out: str = "text") -> DataFrame:
    """Replace {keys} by the facts' display text; ``unknown`` lists keys without a fact.

    The template is cut at the braces and put together again inside the row.
    """
    facts = F.map_from_entries(F.transform(F.col(shown), lambda f: F.struct(f["key"], f["shown"])))
    marked = F.regexp_replace(template, T.PLACEHOLDER, "\u0001{$1}\u0001")
    pieces = F.split(marked, "\u0001")
    df = df.withColumns({"_f": facts, "_p": pieces})

    def key(p: Column) -> Column:
        return F.regexp_extract(p, r"^\{([a-zA-Z0-9_]+)\}$", 1)

    filled = F.transform("_p", lambda p: F.when(key(p) != "", F.coalesce(F.try_element_at("_f", key(p)), p)).otherwise(p))
    unknown = F.transform(F.filter("_p", lambda p: (key(p) != "") & F.try_element_at("_f", key(p)).isNull()), key)
    return df.withColumns({out: F.array_join(filled, ""), "unknown": unknown}).drop("_f", "_p")


def source_numbers(library: DataFrame, key: str, text: str) -> DataFrame:
    """The set of numbers that each source's text states."""
    return library.select(F.col(key).alias("_source"), F.array_distinct(T.extract_numbers(F.col(text))).alias("_stated"))


def numbers_of_sources(df: DataFrame, sources: str, stated: DataFrame) -> DataFrame:
    """Add ``_from_sources``, the numbers of all sources of a row; each distinct list of sources is looked up once.

    The lists are counted, so that the rows stay where they are if the lists are few.
    """
    lists = df.select(F.col(sources).alias("_list")).where("_list IS NOT NULL").distinct()
    sets = (lists.select("_list", F.explode("_list").alias("_source")).join(stated, "_source").groupBy("_list")
            .agg(F.array_distinct(F.flatten(F.collect_list("_stated"))).alias("_from_sources")))
    out = df.join(bounded(sets, DISTINCT_ROWS), F.col(sources) == F.col("_list"), "left").drop("_list")
    return out.withColumn("_from_sources", F.coalesce("_from_sources", F.array().cast("array<string>")))


def stated_numbers(question: Column, shown: Column) -> Column:
    """Numbers an answer may repeat: label years, counting words, the question's, and those of each fact's display text."""
    fixed = F.array(*[F.lit(v) for v in (*LABEL_YEARS, *T.SMALL_NUMBERS)])
    # all display texts are read in one go, with a sign between them that no number or citation spans
    texts = F.transform(shown, lambda f: f["shown"])
    written = F.when(~F.exists(texts, lambda x: x.isNull()), T.extract_numbers(F.array_join(texts, "\u0001")))
    return F.concat(fixed, T.extract_numbers(question), written)


def rounded_values(shown: Column) -> Column:
    """Each fact's value at 0 to 2 decimals."""
    def rounded(f: Column) -> Column:
        v = F.abs(f["value"]) * F.when(f["kind"] == "pct", 100).otherwise(1)
        return F.transform(F.array(*[F.format_string(f"%.{k}f", v) for k in (0, 1, 2)]), T.trim_number)

    return F.flatten(F.transform(F.filter(shown, lambda f: f["value"].isNotNull()), rounded))


def allowed_numbers(question: Column, shown: Column) -> Column:
    """Numbers an answer may use: label years, counting words, the question's, and each fact's at 0 to 2 decimals."""
    return F.array_distinct(F.concat(stated_numbers(question, shown), rounded_values(shown)))


def grounding_check(df: DataFrame, text: str, question: str, shown: str, sources: str, stated: DataFrame | None = None) -> DataFrame:
    """Is every number a model value and every citation a source? Adds ``grounded`` and the first reason against.

    With ``stated``, the table of ``source_numbers``, numbers of the row's sources are allowed too.
    """
    t = F.col(text)
    # only what is left after the numbers as they are shown is looked for among the many of the sources and the rounded ones
    left = F.array_except(T.extract_numbers(t), stated_numbers(F.col(question), F.col(shown)))
    if stated is not None:
        df = numbers_of_sources(df, sources, stated)
        left = F.filter(left, lambda n: ~F.array_contains("_from_sources", n))
    df = df.withColumn("_left", left)
    df = df.withColumns({
        "_bad": F.when(F.size("_left") > 0, F.array_except("_left", rounded_values(F.col(shown)))).otherwise(F.col("_left")),
        "_cited": T.extract_citations(t)}).withColumn("_wrong", F.array_except("_cited", sources))
    reason = (F.when(t.rlike("[{}]"), "unfilled placeholder")
              .when(F.size("_bad") > 0, F.concat(F.lit("numbers not from the model: "), F.array_join(F.slice("_bad", 1, 5), ", ")))
              .when(F.size("_wrong") > 0, F.concat(F.lit("citations not among the sources: "), F.array_join("_wrong", ", ")))
              .when((F.size(sources) > 0) & (F.size("_cited") == 0), "no citations").otherwise(""))
    return df.withColumn("reason", reason).withColumn("grounded", F.col("reason") == "").drop("_left", "_bad", "_cited", "_wrong", "_from_sources")


METRICS = ("right_tool", "right_settings", "cites_correctly", "model_numbers")


def routing_scores(answers: DataFrame) -> DataFrame:
    """Per answer: right tool, right settings, right citations, only model numbers.

    ``answers`` has tool, signature, cited, sources, grounded and ``alternatives``: array of (tool,
    signature, sources), any of which is right. Citations are judged by the alternative that matches best.
    With a column ``codes`` and a field of that name, comparing more scenarios than the one asked for is right too.
    """
    alts, tool = F.col("alternatives"), F.col("tool")
    fields = answers.schema["alternatives"].dataType.elementType.names

    def settings(a: Column) -> Column:
        same = a["signature"] == F.col("signature")
        if "codes" in fields:
            one = ~F.contains(a["codes"], F.lit(",")) & (a["codes"] != "")
            same = same | F.coalesce(one & F.array_contains(F.split("codes", ","), a["codes"]), F.lit(False))
        return same
    same_tool = F.filter(alts, lambda a: a["tool"] == tool)
    full = F.filter(alts, lambda a: (a["tool"] == tool) & settings(a))
    df = answers.withColumns({"_n": F.size(same_tool), "_m": F.size(full)}).withColumn(
        "_want", F.when(F.col("_m") > 0, F.try_element_at(full, F.lit(1))["sources"])
        .when(F.col("_n") > 0, F.try_element_at(same_tool, F.lit(1))["sources"]).otherwise(F.try_element_at(alts, F.lit(1))["sources"]))
    valid = F.size(F.array_except("cited", "sources")) == 0
    return df.withColumns({
        "right_tool": F.col("_n") > 0, "right_settings": F.col("_m") > 0,
        "cites_correctly": (F.col("_n") > 0) & (F.size(F.array_except("_want", "cited")) == 0) & valid,
        "model_numbers": F.col("grounded") | (tool == "none")}).drop("_n", "_m", "_want")


def score_summary(scored: DataFrame) -> DataFrame:
    """Means by question set and language, with a row for all languages."""
    rows = scored.withColumn("lang", F.explode(F.array(F.col("language"), F.lit("all"))))
    return rows.groupBy("question_set", "lang").agg(
        *[F.avg(F.col(m).cast("double")).alias(m) for m in METRICS], F.count("*").alias("questions"))


def text_terms(df: DataFrame, key: str, text: str, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Terms of whole texts: words of two or more characters and their pairs, stop words removed first."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    kept = F.filter(words, lambda w: ~w.isin(*stop_words))
    # the generator keeps the optimizer from repeating the tokenising for each use of the words
    df = df.select(key, F.explode(F.array(kept)).alias("_w"))
    n = F.size("_w")
    pairs = F.when(n > 1, F.zip_with(F.slice("_w", F.lit(1), n - 1), F.slice("_w", F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return df.select(key, F.explode(F.concat("_w", F.coalesce(pairs, F.array().cast("array<string>")))).alias("term"))


BLOCK = 128


def impact_index(corpus: DataFrame, key: str, text: str, stop_words: tuple[str, ...] = STOP_WORDS) -> tuple[DataFrame, DataFrame]:
    """An inverted index: postings (term, block, key, w) and blocks (term, block, idf, top).

    Weights are sublinear tf-idf of the entry's text over its norm. The postings of a term are numbered by falling
    weight through a range partitioning, so no term meets in one task, and cut into blocks of ``BLOCK``; ``top`` is
    the largest weight of a block.
    """
    c = text_terms(corpus, key, text, stop_words).groupBy(key, "term").agg(F.count("*").alias("n"))
    size = corpus.agg(F.count("*")).scalar()
    df = c.groupBy("term").agg(F.count("*").alias("_df")).withColumn("idf", F.log((1 + size) / (1 + F.col("_df"))) + 1).drop("_df")
    cw = c.join(df, "term").withColumn("w", (1 + F.log("n")) * F.col("idf"))
    norm = cw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    weighed = cw.join(norm, key).select("term", "idf", key, (F.col("w") / F.col("_norm")).alias("w"), (-F.col("w") / F.col("_norm")).alias("_falling"))
    postings = written(numbered(weighed, ["term"], ["_falling", key], "_rank").select(
        "term", "idf", key, "w", F.floor(F.col("_rank") / BLOCK).cast("int").alias("block")))
    return postings.drop("idf"), postings.groupBy("term", "block").agg(F.max("w").alias("top"), F.first("idf").alias("idf"))


def tfidf_search(corpus: DataFrame, queries: DataFrame, corpus_key: str, query_key: str, text: str, k: int = 3,
                 min_score: float = 0.05, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The k entries of a knowledge corpus most similar to each query text (cosine of sublinear tf-idf).

    The first blocks of all terms of a query give each entry a part of its score, and their k-th best part is a bound
    that the k-th best score cannot fall below. A later block is read only if its largest weight, with the largest
    weight of every other term, could reach that bound (and ``min_score``): an entry found in skipped blocks only, or
    short of a part from one, is below the bound with its whole score, so the answer is that of the full join.
    Terms the corpus does not know are dropped before anything is counted or shuffled. If the postings are few, as
    counted, they go to the queries' terms, dealt by query: parts of scores are then added up where they arise.
    """
    postings, blocks = impact_index(corpus, corpus_key, text, stop_words)
    blocks = written(blocks)
    first = blocks.where("block = 0").select("term", "idf", F.col("top").alias("most"))
    asked = (text_terms(queries, query_key, text, stop_words).join(first.select("term"), "term", "left_semi")
             .groupBy(query_key, "term").agg(F.count("*").alias("n")).join(first, "term")
             .withColumn("_q", (1 + F.log("n")) * F.col("idf")))
    asked = written(asked.select(query_key, "term", "_q", "most"))
    sums = asked.groupBy(query_key).agg(F.sqrt(F.sum(F.col("_q") * F.col("_q"))).alias("_qn"), F.sum(F.col("_q") * F.col("most")).alias("_all"))

    few = postings.count() <= BROADCAST_ROWS

    def parts(pairs: DataFrame) -> DataFrame:
        pairs = pairs.repartition(query_key) if few else pairs
        return (pairs.join(F.broadcast(postings) if few else postings, ["term", "block"]).groupBy(query_key, corpus_key)
                .agg(F.sum(F.col("_q") * F.col("w")).alias("_dot")))
    dots = parts(asked.select(query_key, "term", "_q", F.lit(0).alias("block")))
    later = blocks.where("block > 0").select("term", "block", "top")
    if not later.isEmpty():
        dots = written(dots)
        kth = (dots.withColumn("_at", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("_dot")))).where(F.col("_at") == k)
               .select(query_key, F.col("_dot").alias("_kth")))
        reach = sums.join(kth, query_key, "left").select(query_key, "_all", F.greatest(F.coalesce("_kth", F.lit(0.0)), min_score * F.col("_qn")).alias("_bound"), "_qn")
        open_ = (asked.join(reach, query_key).join(later, "term")
                 # scores are compared to nine decimals
                 .where(F.col("_all") - F.col("_q") * (F.col("most") - F.col("top")) >= F.col("_bound") - 1e-8 * F.col("_qn")))
        dots = dots.unionAll(parts(open_.select(query_key, "term", "_q", "block"))).groupBy(query_key, corpus_key).agg(F.sum("_dot").alias("_dot"))
    scored = dots.join(sums, query_key).select(query_key, corpus_key, F.round(F.col("_dot") / F.col("_qn"), 9).alias("score"))
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), corpus_key)
    return scored.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
