"""Queries: questions, answers and retrieval over texts derived from orders, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import per_distinct
from ..operators import answers as A
from ..sources.tables import spread, table
from .registry import query
from .sqlviews import sql

# question templates; {a}.. are numbers from the order's keys
QUESTIONS = [
    "What is the cheapest reform that keeps replacement at {a}%?",
    "Which is the most generous pension within {b}.5% of GDP?",
    "How many staff of the ministry will leave in {c} years?",
    "What if the retirement age rises to {d}?",
    "Use an accrual rate of {b}.5% per year of service and raise contributions by {b} points",
    "Index pay to inflation starting from S{e}",
    "Compare S{e} and combined reform",
    "Will the fund run out early?",
    "How is the minimum pension defined?",
    "Restrain hiring, and retire at {d}",
    "Hello number {a}",
]
NUMBERS = {"a": "(40 + o_custkey % 40)", "b": "(1 + o_custkey % 3)", "c": "(5 + o_custkey % 12)", "d": "(48 + o_custkey % 25)",
           "e": "(o_custkey % 8)"}


def _concat(template: str) -> str:
    """A template as SQL concatenation, the same text for both engines."""
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [f"'{head}'", f"CAST({NUMBERS[name]} AS STRING)"]
    return "concat(" + ", ".join([*parts, f"'{rest}'"]) + ")"


QUESTION = f"CASE o_orderkey % {len(QUESTIONS)} " + " ".join(f"WHEN {i} THEN {_concat(t)}" for i, t in enumerate(QUESTIONS)) + " END"
Q_SQL = f"qs AS (SELECT o_orderkey AS id, {QUESTION} AS q FROM orders)"


def questions(spark, d):
    return spread(table(spark, d, "orders")).select(F.col("o_orderkey").alias("id"), F.expr(QUESTION).alias("q"))


# the same kinds of questions in both languages, with units by name and topics that the corpus may know
NUMBERS |= {"k": "translate(CAST((5 + o_custkey % 12) AS STRING), '0123456789', '០១២៣៤៥៦៧៨៩')",
            "u": "CASE o_custkey % 4 WHEN 0 THEN 'NATION_3' WHEN 1 THEN 'nation_1' WHEN 2 THEN 'Nation_17' ELSE 'elsewhere' END",
            "t": "CASE o_custkey % 4 WHEN 0 THEN 'small ring' WHEN 1 THEN 'red widget' WHEN 2 THEN 'blue bolts' ELSE 'gadfly' END"}
BOTH = [
    *QUESTIONS,
    "កំណែទម្រង់ណាថោកបំផុតដែលរក្សាអត្រាជំនួស {a}% និងបៀវត្ស?",
    "តើក្រសួងណានឹងមានមន្ត្រីចាកចេញក្នុង {k} ឆ្នាំ?",
    "តើខេត្តណានឹងបាត់បង់មន្ត្រីច្រើន?",
    "បើអាយុចូលនិវត្តន៍ {d} ឆ្នាំ?",
    "ដំឡើងភាគទាន {b} ពិន្ទុ ហើយទប់ការជ្រើសរើស",
    "ប្រៀបធៀប S{e} និងកំណែទម្រង់រួម",
    "តើមូលនិធិនឹងអស់នៅពេលណា?",
    "តើរូបមន្តសោធន និងអតិផរណាជាអ្វី?",
    "តើប្រភពជាអ្វី?",
    "Who will leave {u} within {c} years?",
    "What is the rate of {t}?",
]
BOTH_QUESTION = f"CASE o_orderkey % {len(BOTH)} " + " ".join(f"WHEN {i} THEN {_concat(t)}" for i, t in enumerate(BOTH)) + " END"


def both_languages(spark, d):
    return spread(table(spark, d, "orders")).select(F.col("o_orderkey").alias("id"), F.expr(BOTH_QUESTION).alias("q"))


def units(spark, d) -> tuple[str, ...]:
    """The code table of unit names, 25 rows."""
    return tuple(sorted(r.n_name for r in table(spark, d, "nation").select("n_name").collect()))


def topics(spark, d):
    """What explanations are about: part names, and the topics of the other language."""
    named = table(spark, d, "part").select(F.col("p_name").alias("entry")).distinct()
    fixed = spark.createDataFrame([(t,) for _, t in A.TOPICS], "entry string")
    return named.unionAll(fixed).distinct().withColumn("text", F.col("entry"))


def rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def grab(text: str, pattern: str, kind: str) -> str:
    return f"CAST(NULLIF(regexp_extract({text}, '{pattern}', 1), '') AS {kind})"


ROUTE = f"""{Q_SQL},
r0 AS (SELECT id, q, lower(q) AS ql, {grab('q', r'(\d+(?:\.\d+)?)\s*%', 'DOUBLE')} AS pct,
  list_distinct(list_concat(list_transform(regexp_extract_all(lower(q), '\\bs([0-6])\\b', 1), lambda x: 'S' || x),
    list_filter([{', '.join(f"CASE WHEN contains(lower(q), '{w}') THEN '{c}' END" for w, c in A.SCENARIO_WORDS)}], lambda x: x IS NOT NULL))) AS codes FROM qs),
r1 AS (SELECT *, {grab('ql', A.RETIRE_AGE, 'INT')} AS age0, {rx('ql', A.ACCRUAL)} AS acc, {grab('ql', A.RISE, 'DOUBLE')} AS rise,
  {grab("regexp_replace(ql, '^.*?accrual', '')", r'(\d(?:\.\d+)?)\s*%', 'DOUBLE')} AS rate0,
  {rx('ql', A.PAY_WORDS)} AS pays, {rx('ql', A.CHEAPEST)} AS cheap, {rx('ql', A.GENEROUS)} AND contains(ql, 'gdp') AS gen,
  {rx('ql', A.UNIT_WORDS)} AND {rx('ql', A.EXIT_WORDS)} AS ex, CASE WHEN {rx('ql', A.RESTRAIN)} THEN TRUE END AS restr FROM r0),
r2 AS (SELECT *, CASE WHEN age0 BETWEEN 50 AND 70 THEN age0 END AS age, CASE WHEN acc AND rate0 BETWEEN 0.5 AND 4 THEN rate0 END AS rate,
  CASE WHEN contains(ql, 'inflation') AND pays THEN 'inflation' WHEN {rx('ql', A.TARGETED)} AND pays THEN 'targeted' END AS rule FROM r1),
r3 AS (SELECT *, age IS NOT NULL OR acc OR rise IS NOT NULL OR rule IS NOT NULL OR restr IS NOT NULL AS ref FROM r2),
r4 AS (SELECT *, CASE WHEN cheap OR gen THEN 'find_best_reform' WHEN ex THEN 'staff_exits' WHEN ref THEN 'run_reform'
  WHEN len(codes) > 0 OR {rx('ql', A.COMPARE)} THEN 'compare_scenarios' WHEN {rx('ql', A.FUND)} THEN 'run_reform'
  WHEN {rx('ql', A.EXPLAIN)} THEN 'explain_assumption' ELSE 'none' END AS tool FROM r3)
"""


ROUTE_BOTH = f"""qs AS (SELECT o_orderkey AS id, translate({BOTH_QUESTION}, '{T.DIGITS[0]}', '{T.DIGITS[1]}') AS q FROM orders),
{ROUTE.split(Q_SQL + ",", 1)[1]}"""
ROUTE_UNITS = f"""{ROUTE_BOTH.replace(f"{rx('ql', A.UNIT_WORDS)} AND {rx('ql', A.EXIT_WORDS)} AS ex", f"({rx('ql', A.UNIT_WORDS)} OR unit IS NOT NULL) AND {rx('ql', A.EXIT_WORDS)} AS ex")
  .replace("contains(ql, 'inflation') AND pays", f"{rx('ql', A.INFLATION)} AND pays").replace("FROM r0)", "FROM r0 LEFT JOIN un USING (id))")},
r5 AS (SELECT *, CASE WHEN tool <> 'explain_assumption' THEN NULL WHEN {rx('q', A.LATIN)} THEN q
  ELSE NULLIF(array_to_string(list_filter([{', '.join(f"CASE WHEN contains(q, '{w}') THEN '{t}' END" for w, t in A.TOPICS)}], lambda x: x IS NOT NULL), ' '), '') END AS topic FROM r4),
ce AS (SELECT DISTINCT p_name AS entry FROM part UNION {' UNION '.join(f"SELECT '{t}'" for _, t in A.TOPICS)}), cx AS (SELECT entry, entry AS text FROM ce),
tx AS (SELECT DISTINCT topic, topic AS text FROM r5 WHERE topic IS NOT NULL),
"""
UNIT_SQL = """un AS (SELECT o_orderkey AS id, MIN(n_name) AS unit FROM (SELECT o_orderkey, lower(""" + BOTH_QUESTION + """) AS ql FROM orders) JOIN nation ON contains(ql, lower(n_name)) GROUP BY 1),
"""


def known_sql() -> str:
    """Topics with an entry of cosine 0.05 or more."""
    return f"""{terms_sql('cx', 'entry', 'ct')}, {terms_sql('tx', 'topic', 'qt')},
idf AS (SELECT term, ln((1 + (SELECT COUNT(*) FROM ce)) / (1 + COUNT(*))) + 1 AS idf FROM ct GROUP BY 1),
cw AS (SELECT entry, term, (1 + ln(n)) * idf AS w FROM ct JOIN idf USING (term)), cn AS (SELECT entry, sqrt(SUM(w * w)) AS nrm FROM cw GROUP BY 1),
qw AS (SELECT topic, term, (1 + ln(n)) * idf AS w FROM qt JOIN idf USING (term)), qn AS (SELECT topic, sqrt(SUM(w * w)) AS nrm FROM qw GROUP BY 1),
kn AS (SELECT DISTINCT topic AS known FROM (SELECT topic, entry, SUM(qw.w * cw.w / cn.nrm) / MAX(qn.nrm) AS score FROM qw JOIN cw USING (term) JOIN cn USING (entry) JOIN qn USING (topic) GROUP BY 1, 2)
  WHERE ROUND(score, 9) >= 0.05),
r6 AS (SELECT * EXCLUDE (tool), CASE WHEN tool = 'explain_assumption' AND known IS NULL THEN 'none' ELSE tool END AS tool FROM r5 LEFT JOIN kn ON topic = known)
"""


@query("l02_route_questions", sql("", f"""WITH {ROUTE}
SELECT id, tool, CASE WHEN tool = 'find_best_reform' THEN CASE WHEN cheap THEN 'cheapest_for_replacement' ELSE 'most_adequate_within_cost' END END AS goal,
  CASE WHEN tool = 'find_best_reform' THEN COALESCE(pct, CASE WHEN cheap THEN 60.0 ELSE 3.5 END) END AS target,
  CASE WHEN tool = 'find_best_reform' THEN cheap AND contains(ql, 'pay') END AS include_pay_levers,
  CASE WHEN tool = 'staff_exits' THEN CASE WHEN contains(ql, 'ministr') THEN 'ministry' ELSE 'province' END END AS level,
  CASE WHEN tool = 'staff_exits' THEN COALESCE({grab('ql', r'(\d+)\s*years?', 'INT')}, 10) END AS years_ahead,
  CASE WHEN tool = 'run_reform' AND ref THEN age END AS retirement_age, CASE WHEN tool = 'run_reform' AND acc THEN 'accrual' END AS pension_formula,
  CASE WHEN tool = 'run_reform' AND ref THEN rate END AS accrual_rate_percent, CASE WHEN tool = 'run_reform' AND ref THEN rise END AS contribution_rise_points,
  CASE WHEN tool = 'run_reform' AND ref THEN rule END AS pay_rule, CASE WHEN tool = 'run_reform' AND ref THEN restr END AS restrain_hiring,
  CASE WHEN tool = 'run_reform' AND ref AND len(codes) = 1 THEN codes[1] END AS base_scenario FROM r4"""))
def route(spark, d):
    r = per_distinct(questions(spark, d), ["q"], lambda t: A.route_questions(t, "q"))
    return r.select("id", "tool", *[c for c in A.SLOTS if c != "codes"])


CALL = """concat('Sure: {"name": "', CASE o_orderkey % 4 WHEN 0 THEN 'run_reform' WHEN 1 THEN 'find_best_reform' WHEN 2 THEN 'staff_exits' ELSE 'compare_scenarios' END,
  '", "args": {"retirement_age": "', CAST(45 + o_custkey % 30 AS STRING), '.2", "accrual_rate_percent": "', CASE WHEN o_custkey % 3 = 0 THEN '0.025' WHEN o_custkey % 3 = 1 THEN '2.2%' ELSE 'high' END,
  '", "contribution_rise_points": "', CAST(o_custkey % 7 AS STRING), '", "pay_rule": "', CASE WHEN o_custkey % 2 = 0 THEN 'inflation' ELSE 'double' END,
  '", "restrain_hiring": "', CASE WHEN o_custkey % 5 = 0 THEN 'true' ELSE 'maybe' END, '", "goal": "', CASE WHEN o_custkey % 2 = 0 THEN 'most_adequate_within_cost' ELSE 'x' END,
  '", "target": "', CAST(o_custkey % 9 AS STRING), '", "years_ahead": "', CAST(o_custkey % 20 AS STRING), '", "codes": "s', CAST(o_custkey % 9 AS STRING), ',S6"}} ok')"""
CLEAN = f"""cl0 AS (SELECT o_orderkey AS id, regexp_extract({CALL}, '(\\{{.*\\}})', 1) AS j FROM orders),
cl1 AS (SELECT id, j ->> '$.name' AS tool, TRY_CAST(trim(replace(j ->> '$.args.retirement_age', '%', '')) AS DOUBLE) AS ra,
  TRY_CAST(trim(replace(j ->> '$.args.accrual_rate_percent', '%', '')) AS DOUBLE) AS ar, TRY_CAST(j ->> '$.args.contribution_rise_points' AS DOUBLE) AS cr,
  j ->> '$.args.pay_rule' AS pr, j ->> '$.args.restrain_hiring' AS rh, j ->> '$.args.goal' AS g, TRY_CAST(j ->> '$.args.target' AS DOUBLE) AS ta,
  TRY_CAST(j ->> '$.args.years_ahead' AS DOUBLE) AS ya, string_split(upper(j ->> '$.args.codes'), ',') AS cd FROM cl0),
cl AS (SELECT id, tool, CASE WHEN tool = 'run_reform' THEN CAST(LEAST(GREATEST(round(ra), 55), 65) AS INT) END AS retirement_age,
  CASE WHEN tool = 'run_reform' AND ar > 0 THEN ROUND(LEAST(GREATEST(CASE WHEN ar < 0.1 THEN ar * 100 ELSE ar END, 1), 3), 2) END AS accrual_rate_percent,
  CASE WHEN tool = 'run_reform' AND ar > 0 THEN 'accrual' END AS pension_formula,
  CASE WHEN tool = 'run_reform' THEN ROUND(LEAST(GREATEST(cr, 0), 4), 1) END AS contribution_rise_points,
  CASE WHEN tool = 'run_reform' AND pr IN ('recent_average', 'inflation', 'targeted') THEN pr END AS pay_rule,
  CASE WHEN tool = 'run_reform' AND rh IN ('true', 'false') THEN rh = 'true' END AS restrain_hiring,
  CASE WHEN tool = 'find_best_reform' THEN CASE WHEN g = 'most_adequate_within_cost' THEN g ELSE 'cheapest_for_replacement' END END AS goal,
  CASE WHEN tool = 'find_best_reform' THEN CASE WHEN g = 'most_adequate_within_cost' THEN ta WHEN ta <= 1 THEN ta * 100 ELSE ta END END AS target,
  CASE WHEN tool = 'staff_exits' THEN CAST(LEAST(GREATEST(ya, 5), 15) AS INT) END AS years_ahead,
  CASE WHEN tool = 'compare_scenarios' THEN array_to_string(list_filter(['S0', 'S1', 'S2', 'S3', 'S4', 'S5', 'S6'], lambda x: list_contains(cd, x)), ',') END AS codes FROM cl1)
"""
CLEANED = ("tool", "retirement_age", "accrual_rate_percent", "pension_formula", "contribution_rise_points", "pay_rule",
           "restrain_hiring", "goal", "target", "years_ahead", "codes")


def calls(spark, d):
    o = spread(table(spark, d, "orders")).select(F.col("o_orderkey").alias("id"), F.expr(CALL).alias("answer"))
    return per_distinct(o, ["answer"], lambda t: A.clean_settings(A.parse_tool_calls(t, "answer")))


@query("l03_clean_settings", sql("", f"WITH {CLEAN} SELECT id, {', '.join(CLEANED)} FROM cl"))
def clean(spark, d):
    return calls(spark, d).select("id", *CLEANED)


@query("l09_settings_signature", sql("", f"""WITH {CLEAN} SELECT COUNT(DISTINCT concat_ws('|', tool, {', '.join(
    f"COALESCE(CAST({c} AS VARCHAR), '-')" for c in CLEANED if c != 'tool')})) AS signatures, COUNT(*) AS answers FROM cl"""))
def signature(spark, d):
    s = A.settings_signature(calls(spark, d)).groupBy("signature").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("signatures"), F.sum("n").alias("answers"))


# facts and answers of an order: cost (never a rounding tie), year, count and share
CENTS = "CAST(ROUND(o_totalprice * 100) AS BIGINT) % 1000"
FACTS = {"cost": (f"(({CENTS}) * 10 + 3) / 10000.0E0", "pct_gdp"), "change": (f"(({CENTS}) * 10 - 4997) / 10000.0E0", "pp"),
         "year": ("CAST(2030 + o_custkey % 40 AS DOUBLE)", "year"), "staff": ("CAST(1000 + o_custkey * 7 AS DOUBLE)", "count"),
         "share": (f"(({CENTS}) * 10 + 3) / 100000.0E0", "pct")}
TEMPLATE = """CASE o_orderkey % 5 WHEN 0 THEN 'The cost is {cost} of GDP by {year} [A6, P10].' WHEN 1 THEN 'Cost changes by { change } for {staff} staff [A6; S0].'
  WHEN 2 THEN 'About {share} of staff, {missing} at most [A9].' WHEN 3 THEN concat('It is ', CAST(o_orderkey % 1000 AS STRING), ' points, or 12,345.50 in S3 [A6].')
  ELSE 'The share is {share}.' END"""


def facts(spark, d):
    items = [F.struct(F.lit(k).alias("key"), F.expr(v).cast("double").alias("value"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("text"))
             for k, (v, kind) in FACTS.items()]
    return spread(table(spark, d, "orders")).select(
        F.col("o_orderkey").alias("id"), F.expr(QUESTION).alias("q"), F.expr(TEMPLATE).alias("template"), F.array(*items).alias("facts"),
        F.array(F.lit("A6"), F.lit("P10"), F.lit("S0")).alias("sources")).withColumn("shown", A.format_facts(F.col("facts")))


SHOWN = f"""fa AS (SELECT o_orderkey AS id, {QUESTION} AS q, {TEMPLATE} AS template, """ + ", ".join(
    f"{v} AS v_{k}" for k, (v, _) in FACTS.items()) + """ FROM orders),
sh AS (SELECT *, printf('%.2f%%', v_cost) AS cost, printf('%+.2f', v_change) AS change, CAST(CAST(v_year AS BIGINT) AS VARCHAR) AS year,
  format('{:,}', CAST(v_staff AS BIGINT)) AS staff, regexp_replace(printf('%.1f%%', v_share * 100), '\\.0%$', '%') AS share FROM fa),
fi AS (SELECT *, replace(replace(replace(replace(replace(template, '{cost}', cost), '{ change }', change), '{year}', year), '{staff}', staff), '{share}', share) AS text FROM sh)
"""


def number_list(text: str) -> str:
    """Numbers in a text, in DuckDB: citations and codes out, separators out (four groups at most here), zeros trimmed."""
    cite = r"\[\s*([A-Z]\d{1,2}(?:\s*[,;]\s*[A-Z]\d{1,2})*)\s*\]"
    t = f"regexp_replace(regexp_replace({text}, '{cite}', ' ', 'g'), '\\bS[0-6]\\b', ' ', 'g')"
    for _ in range(3):
        t = f"regexp_replace({t}, '(\\d),(\\d{{3}})\\b', '\\1\\2', 'g')"
    trim = r"CASE WHEN contains(n, '.') THEN regexp_replace(n, '\.?0+$', '') ELSE n END"
    return f"list_transform(regexp_extract_all({t}, '\\d+(?:\\.\\d+)?'), lambda n: {trim})"


CITES = r"""list_distinct(flatten(list_transform(regexp_extract_all(text, '\[\s*([A-Z]\d{1,2}(?:\s*[,;]\s*[A-Z]\d{1,2})*)\s*\]', 1), lambda g: list_transform(regexp_split_to_array(g, '[,;]'), lambda x: trim(x)))))"""


@query("l04_extract_numbers", sql("", f"WITH {SHOWN} SELECT id, array_to_string({number_list('text')}, ' ') AS numbers FROM fi"))
def numbers(spark, d):
    f = A.fill_placeholders(facts(spark, d), "template", "shown")
    return f.select("id", F.array_join(T.extract_numbers(F.col("text")), " ").alias("numbers"))


def trimmed(expr: str) -> str:
    return f"list_transform([printf('%.0f', {expr}), printf('%.1f', {expr}), printf('%.2f', {expr})], lambda n: CASE WHEN contains(n, '.') THEN regexp_replace(n, '\\.?0+$', '') ELSE n END)"


FIXED = "[" + ", ".join(f"'{v}'" for v in (*A.LABEL_YEARS, *T.SMALL_NUMBERS)) + "]"
CHECK = f"""{SHOWN},
al AS (SELECT id, text, {number_list('text')} AS nums, {CITES} AS cited,
  flatten([{FIXED}, {number_list('q')}, {number_list('cost')}, {number_list('change')}, {number_list('year')}, {number_list('staff')}, {number_list('share')},
    {trimmed('abs(v_cost)')}, {trimmed('abs(v_change)')}, {trimmed('abs(v_year)')}, {trimmed('abs(v_staff)')}, {trimmed('abs(v_share) * 100')}]) AS ok FROM fi),
ck AS (SELECT id, text, cited, list_filter(nums, lambda n: NOT list_contains(ok, n)) AS bad, list_filter(cited, lambda c: c NOT IN ('A6', 'P10', 'S0')) AS wrong FROM al),
gr AS (SELECT id, cited, CASE WHEN contains(text, '{{') OR contains(text, '}}') THEN 'unfilled placeholder' WHEN len(bad) > 0 THEN 'numbers not from the model'
  WHEN len(wrong) > 0 THEN 'citations not among the sources' WHEN len(cited) = 0 THEN 'no citations' ELSE '' END AS reason FROM ck)
"""


def checked(spark, d):
    f = A.fill_placeholders(facts(spark, d), "template", "shown")
    return A.grounding_check(f, "text", "q", "shown", "sources")


@query("l05_grounding_check", sql("", f"WITH {CHECK} SELECT id, reason = '' AS grounded, reason FROM gr"))
def grounding(spark, d):
    return checked(spark, d).select("id", "grounded", F.regexp_replace("reason", ":.*", "").alias("reason"))


@query("l05_grounding_sources", sql("", f"""WITH {CHECK},
lib AS (SELECT item_id, 'A' || CAST(item_id % 12 AS VARCHAR) AS source, concat(text, ' The reserve is ', CAST(item_id % 900 AS VARCHAR), ' points [P', CAST(item_id % 10 AS VARCHAR), '].') AS text FROM benchmark),
st AS (SELECT source, flatten(list({number_list('text')})) AS stated FROM lib GROUP BY 1),
own AS (SELECT id, ['A' || CAST(id % 12 AS VARCHAR), 'A6'] AS sources, concat(text, ' The reserve is ', CAST(id % 900 AS VARCHAR), ' [A', CAST(id % 12 AS VARCHAR), '].') AS text, ok FROM al),
al2 AS (SELECT o.id, o.sources, {number_list('o.text')} AS nums, {CITES.replace('text', 'o.text', 1)} AS cited, o.text,
  list_concat(o.ok, COALESCE(s1.stated, []), COALESCE(s2.stated, [])) AS ok FROM own o LEFT JOIN st s1 ON s1.source = o.sources[1] LEFT JOIN st s2 ON s2.source = o.sources[2]),
ck2 AS (SELECT id, text, cited, list_filter(nums, lambda n: NOT list_contains(ok, n)) AS bad, list_filter(cited, lambda c: NOT list_contains(sources, c)) AS wrong FROM al2)
SELECT id, CASE WHEN contains(text, '{{') OR contains(text, '}}') THEN 'unfilled placeholder' WHEN len(bad) > 0 THEN 'numbers not from the model'
  WHEN len(wrong) > 0 THEN 'citations not among the sources' WHEN len(cited) = 0 THEN 'no citations' ELSE '' END AS reason FROM ck2"""))
def grounding_sources(spark, d):
    """Answers that repeat a number of a cited source, checked against the numbers that source states."""
    item = lambda n: (F.col("item_id") % n).cast("string")
    library = table(spark, d, "benchmark").select(F.concat(F.lit("A"), item(12)).alias("source"), F.concat(
        "text", F.lit(" The reserve is "), item(900), F.lit(" points [P"), item(10), F.lit("].")).alias("text"))
    f = A.fill_placeholders(facts(spark, d), "template", "shown")
    own = F.concat(F.lit("A"), (F.col("id") % 12).cast("string"))
    f = f.withColumns({"sources": F.array(own, F.lit("A6")), "text": F.concat("text", F.lit(" The reserve is "), (F.col("id") % 900).cast("string"), F.lit(" ["), own, F.lit("]."))})
    g = A.grounding_check(f, "text", "q", "shown", "sources", A.source_numbers(library, "source", "text"))
    return g.select("id", F.regexp_replace("reason", ":.*", "").alias("reason"))


@query("l06_fill_placeholders", sql("", f"WITH {SHOWN} SELECT id, text, CASE WHEN contains(template, 'missing') THEN 'missing' ELSE '' END AS unknown FROM fi"))
def fill(spark, d):
    f = A.fill_placeholders(facts(spark, d), "template", "shown")
    return f.select("id", "text", F.array_join("unknown", ",").alias("unknown"))


@query("l07_extract_citations", sql("", f"WITH {SHOWN}, c AS (SELECT {CITES} AS l FROM fi), x AS (SELECT unnest(l) AS cited FROM c) SELECT cited, COUNT(*) AS n FROM x GROUP BY 1"))
def citations(spark, d):
    f = facts(spark, d).select(F.explode(T.extract_citations(F.col("template"))).alias("cited"))
    return f.groupBy("cited").agg(F.count("*").alias("n"))


@query("l08_detect_script", sql("", """
SELECT doc_id, CASE WHEN regexp_matches(CASE WHEN doc_id % 7 = 0 THEN concat(text, ' ខេត្ត') ELSE text END, '[ក-៿]') THEN 'km' ELSE 'en' END AS script FROM documents"""))
def script(spark, d):
    t = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" ខេត្ត"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.detect_script(t).alias("script"))


GOLD = ("CASE id % 3 WHEN 0 THEN 'run_reform' WHEN 1 THEN 'explain_assumption' ELSE 'compare_scenarios' END")


@query("l10_routing_scores", sql("", f"""WITH {ROUTE}, {CHECK.replace('WITH ', '')},
an AS (SELECT r4.id, tool, reason = '' AS grounded, cited, {GOLD.replace('id %', 'r4.id %')} AS t1, CASE WHEN age IS NULL THEN 'no' ELSE 'age' END AS sig FROM r4 JOIN gr ON gr.id = r4.id),
sc AS (SELECT CASE WHEN id % 2 = 0 THEN 'development' ELSE 'blind' END AS question_set, CASE WHEN id % 5 = 0 THEN 'km' ELSE 'en' END AS language,
  tool = t1 OR tool = 'staff_exits' AS rt, (tool = t1 AND sig = 'age') OR (tool = 'staff_exits' AND sig = 'no') AS rs,
  CASE WHEN tool = t1 THEN list_contains(cited, 'A6') WHEN tool = 'staff_exits' THEN list_contains(cited, 'P10') ELSE FALSE END
    AND len(list_filter(cited, lambda c: c NOT IN ('A6', 'P10', 'S0'))) = 0 AS cc, grounded OR tool = 'none' AS mn FROM an),
x AS (SELECT *, language AS lang FROM sc UNION ALL SELECT *, 'all' FROM sc)
SELECT question_set, lang, ROUND(AVG(CASE WHEN rt THEN 1.0 ELSE 0.0 END), 8) AS right_tool, ROUND(AVG(CASE WHEN rs THEN 1.0 ELSE 0.0 END), 8) AS right_settings,
  ROUND(AVG(CASE WHEN cc THEN 1.0 ELSE 0.0 END), 8) AS cites_correctly, ROUND(AVG(CASE WHEN mn THEN 1.0 ELSE 0.0 END), 8) AS model_numbers, COUNT(*) AS questions
FROM x GROUP BY 1, 2"""))
def routing(spark, d):
    # the answers of the same order: routed tool, cited ids and the grounding result; a question asked often is routed once
    a = per_distinct(facts(spark, d), ["q"], lambda t: A.route_questions(t, "q").withColumn("age_missing", _age_missing()))
    a = A.grounding_check(A.fill_placeholders(a, "template", "shown"), "text", "q", "shown", "sources")
    alt = lambda t, s, c: F.struct(t.alias("tool"), F.lit(s).alias("signature"), F.array(F.lit(c)).alias("sources"))
    a = a.withColumns({
        "signature": F.when(F.col("retirement_age").isNull() & F.col("age_missing"), "no").otherwise("age"),
        "cited": T.extract_citations(F.col("text")), "alternatives": F.array(alt(F.expr(GOLD), "age", "A6"), alt(F.lit("staff_exits"), "no", "P10")),
        "question_set": F.when(F.col("id") % 2 == 0, "development").otherwise("blind"), "language": F.when(F.col("id") % 5 == 0, "km").otherwise("en")})
    s = A.score_summary(A.routing_scores(a))
    return s.withColumns({m: F.round(m, 8) for m in A.METRICS})


def _age_missing():
    """No retirement age between 50 and 70 in the question, whatever tool it went to."""
    hit = F.regexp_extract(F.lower("q"), A.RETIRE_AGE, 1)
    return (hit == "") | ~F.coalesce(F.when(hit != "", hit).cast("int").between(50, 70), F.lit(False))


@query("l11_format_facts", sql("", f"WITH {SHOWN} SELECT id, cost, change, year, staff, share FROM sh"))
def formats(spark, d):
    s = facts(spark, d).withColumn("m", F.map_from_entries(F.transform("shown", lambda f: F.struct(f["key"], f["shown"]))))
    return s.select("id", *[F.element_at("m", k).alias(k) for k in FACTS])


def terms_sql(src: str, key: str, out: str) -> str:
    stop = ", ".join(f"'{w}'" for w in A.STOP_WORDS)
    return f"""{out}_w AS (SELECT {key}, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({stop})) AS w FROM {src}),
{out} AS (SELECT {key}, term, COUNT(*) AS n FROM (SELECT {key}, unnest(w) AS term FROM {out}_w
  UNION ALL SELECT {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {out}_w) GROUP BY 1, 2)"""


@query("l01_tfidf_search", sql("", f"""
WITH {terms_sql('benchmark', 'item_id', 'ct')}, {terms_sql('documents', 'doc_id', 'qt')},
idf AS (SELECT term, ln((1 + (SELECT COUNT(*) FROM benchmark)) / (1 + COUNT(*))) + 1 AS idf FROM ct GROUP BY 1),
cw AS (SELECT item_id, term, (1 + ln(n)) * idf AS w FROM ct JOIN idf USING (term)), cn AS (SELECT item_id, sqrt(SUM(w * w)) AS nrm FROM cw GROUP BY 1),
qw AS (SELECT doc_id, term, (1 + ln(n)) * idf AS w FROM qt JOIN idf USING (term)), qn AS (SELECT doc_id, sqrt(SUM(w * w)) AS nrm FROM qw GROUP BY 1),
sc AS (SELECT doc_id, item_id, ROUND(SUM(qw.w * cw.w / cn.nrm) / MAX(qn.nrm), 9) AS score FROM qw JOIN cw USING (term) JOIN cn USING (item_id) JOIN qn USING (doc_id) GROUP BY 1, 2),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM sc WHERE score >= 0.05)
SELECT doc_id, item_id, ROUND(score, 6) AS score, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 3"""))
def search(spark, d):
    corpus = table(spark, d, "benchmark")
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return A.tfidf_search(corpus, docs, "item_id", "doc_id", "text").withColumn("score", F.round("score", 6))


STATED = """SELECT id, tool, CASE WHEN tool = 'find_best_reform' THEN CASE WHEN cheap THEN 'cheapest_for_replacement' ELSE 'most_adequate_within_cost' END END AS goal,
  CASE WHEN tool = 'find_best_reform' THEN COALESCE(pct, CASE WHEN cheap THEN 60.0 ELSE 3.5 END) END AS target,
  CASE WHEN tool = 'find_best_reform' THEN cheap AND """ + rx("ql", A.PAY_LEVERS) + """ END AS include_pay_levers,
  CASE WHEN tool = 'staff_exits' THEN CASE WHEN """ + rx("ql", A.MINISTRY_WORDS) + """ THEN 'ministry' ELSE 'province' END END AS level,
  CASE WHEN tool = 'staff_exits' THEN COALESCE(""" + grab("ql", A.YEARS_AHEAD, "INT") + """, 10) END AS years_ahead,
  CASE WHEN tool = 'run_reform' AND ref THEN age END AS retirement_age, CASE WHEN tool = 'run_reform' AND acc THEN 'accrual' END AS pension_formula,
  CASE WHEN tool = 'run_reform' AND ref THEN rate END AS accrual_rate_percent, CASE WHEN tool = 'run_reform' AND ref THEN rise END AS contribution_rise_points,
  CASE WHEN tool = 'run_reform' AND ref THEN rule END AS pay_rule, CASE WHEN tool = 'run_reform' AND ref THEN restr END AS restrain_hiring,
  CASE WHEN tool = 'run_reform' AND ref AND len(codes) = 1 THEN codes[1] END AS base_scenario,
  CASE WHEN tool = 'compare_scenarios' THEN array_to_string(list_sort(codes), ',') END AS codes,
  CASE WHEN tool = 'staff_exits' THEN unit END AS unit, CASE WHEN tool = 'explain_assumption' THEN topic END AS topic FROM r6"""


def routed_both(spark, d, then=lambda routed: routed):
    """Every question with its route, and what ``then`` makes of that; a question asked often is routed once."""
    names, known = units(spark, d), topics(spark, d)
    return per_distinct(both_languages(spark, d), ["q"], lambda t: then(A.confirm_topics(A.route_questions(t, "q", names), known, "entry", "text")))


@query("l02_route_both_languages", sql("", f"WITH {UNIT_SQL} {ROUTE_UNITS} {known_sql()} {STATED}"))
def route_both(spark, d):
    # codes are kept in the order of the question; DuckDB's list_distinct has no order, so both sort them
    r = routed_both(spark, d).withColumn("codes", F.concat_ws(",", F.array_sort(F.split("codes", ","))))
    return r.withColumn("codes", F.when(F.col("tool") == "compare_scenarios", F.col("codes"))).select("id", "tool", *A.SLOTS, "unit", "topic")


CLEAN_BOTH = f"""WITH {UNIT_SQL} {ROUTE_UNITS} {known_sql()}, sd AS ({STATED}),
cb AS (SELECT id, tool, CASE WHEN tool = 'run_reform' THEN base_scenario END AS base_scenario, CASE WHEN retirement_age IS NOT NULL THEN CAST(LEAST(GREATEST(retirement_age, 55), 65) AS INT) END AS retirement_age,
  CASE WHEN tool = 'run_reform' AND accrual_rate_percent > 0 THEN ROUND(LEAST(GREATEST(accrual_rate_percent, 1), 3), 2) END AS accrual_rate_percent, pension_formula,
  CASE WHEN contribution_rise_points IS NOT NULL THEN ROUND(LEAST(GREATEST(contribution_rise_points, 0), 4), 1) END AS contribution_rise_points, pay_rule, restrain_hiring, goal,
  CASE WHEN goal = 'cheapest_for_replacement' AND target <= 1 THEN target * 100 ELSE target END AS target, include_pay_levers, level,
  CASE WHEN tool = 'staff_exits' THEN CAST(LEAST(GREATEST(years_ahead, 5), 15) AS INT) END AS years_ahead, unit, CASE WHEN tool = 'explain_assumption' THEN trim(topic) END AS topic,
  CASE WHEN tool = 'compare_scenarios' THEN COALESCE(NULLIF(array_to_string(list_filter(['S0', 'S1', 'S2', 'S3', 'S4', 'S5', 'S6'], lambda x: list_contains(string_split(codes, ','), x)), ','), ''),
    'S0,S1,S2,S3,S4,S5,S6') END AS codes FROM sd)
"""


def cleaned_both(spark, d, then=lambda cleaned: cleaned):
    return routed_both(spark, d, lambda routed: then(A.clean_settings(A.stated_args(routed))))


@query("l03_clean_slots", sql("", CLEAN_BOTH + f"SELECT id, tool, {', '.join(A.SLOTS)}, unit, topic FROM cb"))
def clean_both(spark, d):
    return cleaned_both(spark, d).select("id", "tool", *A.SLOTS, "unit", "topic")


# right answers of a few kinds of questions; others have none and any tool is wrong for them
WANTED = {3: ("run_reform", "'retirement_age', CAST((48 + o_custkey % 25) AS STRING)"), 13: ("staff_exits", "'level', 'province', 'years_ahead', '10'"),
          12: ("staff_exits", "'level', 'ministry', 'years_ahead', CAST((5 + o_custkey % 11) AS STRING)"), 16: ("compare_scenarios", "'codes', 'S5'"),
          20: ("staff_exits", "'unit', 'nation_3', 'years_ahead', CAST((5 + o_custkey % 12) AS STRING)"), 6: ("compare_scenarios", "'codes', concat('s', CAST((o_custkey % 8) AS STRING), ',s5')")}
GOLD_TOOL = f"CASE o_orderkey % {len(BOTH)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in WANTED.items()) + " ELSE 'explain_assumption' END"
GOLD_ARGS = f"CASE o_orderkey % {len(BOTH)} " + " ".join(f"WHEN {i} THEN map({a})" for i, (_, a) in WANTED.items()) + " ELSE map('topic', 'any') END"
SAME_SETTINGS = """CASE r.tool WHEN 'run_reform' THEN r.base_scenario IS NULL AND r.accrual_rate_percent IS NULL AND r.pension_formula IS NULL AND r.contribution_rise_points IS NULL AND r.pay_rule IS NULL
    AND r.restrain_hiring IS NULL AND r.retirement_age IS NOT DISTINCT FROM LEAST(GREATEST(48 + o_custkey % 25, 55), 65)
  WHEN 'staff_exits' THEN r.level = CASE WHEN k = 12 THEN 'ministry' ELSE 'province' END AND lower(COALESCE(r.unit, '')) = CASE WHEN k = 20 THEN 'nation_3' ELSE '' END
    AND r.years_ahead = CASE k WHEN 13 THEN 10 WHEN 12 THEN 5 + o_custkey % 11 ELSE LEAST(5 + o_custkey % 12, 15) END
  WHEN 'compare_scenarios' THEN CASE WHEN k = 16 OR o_custkey % 8 IN (5, 7) THEN list_contains(string_split(r.codes, ','), 'S5')
    ELSE r.codes = array_to_string(list_sort(list_distinct(['S' || CAST(o_custkey % 8 AS VARCHAR), 'S5'])), ',') END
  WHEN 'explain_assumption' THEN TRUE ELSE FALSE END"""


@query("l10_scores_by_signature", sql("", CLEAN_BOTH + f""",
og AS (SELECT o_orderkey AS id, o_custkey, o_orderkey % {len(BOTH)} AS k, {GOLD_TOOL} AS gold FROM orders),
sc AS (SELECT CASE WHEN o.id % 2 = 0 THEN 'development' ELSE 'blind' END AS question_set, CASE WHEN k BETWEEN 11 AND 19 THEN 'km' ELSE 'en' END AS language,
  r.tool = gold AS rt, r.tool = gold AND {SAME_SETTINGS} AS rs FROM cb r JOIN og o ON o.id = r.id),
x AS (SELECT *, language AS lang FROM sc UNION ALL SELECT *, 'all' FROM sc)
SELECT question_set, lang, ROUND(AVG(CASE WHEN rt THEN 1.0 ELSE 0.0 END), 8) AS right_tool, ROUND(AVG(CASE WHEN rs THEN 1.0 ELSE 0.0 END), 8) AS right_settings, COUNT(*) AS questions FROM x GROUP BY 1, 2"""))
def scores_by_signature(spark, d):
    """Routed and wanted settings go through the same cleaning and meet in one canonical key."""
    got = cleaned_both(spark, d, A.settings_signature).select("id", "tool", "signature", "codes")
    # maps are no keys, their entries are
    gold = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(GOLD_TOOL).alias("tool"), F.map_entries(F.expr(GOLD_ARGS)).alias("wanted"))
    gold = per_distinct(gold, ["tool", "wanted"], lambda t: A.settings_signature(A.clean_settings(t.withColumn("args", F.map_from_entries("wanted")))))
    gold = gold.select("id", F.array(F.struct(
        "tool", "signature", F.array().cast("array<string>").alias("sources"), F.coalesce("codes", F.lit("")).alias("codes"))).alias("alternatives"))
    k = F.col("id") % len(BOTH)
    a = got.join(gold, "id").withColumns({
        "cited": F.array().cast("array<string>"), "sources": F.array().cast("array<string>"), "grounded": F.lit(True),
        "question_set": F.when(F.col("id") % 2 == 0, "development").otherwise("blind"), "language": F.when(k.between(11, 19), "km").otherwise("en")})
    s = A.score_summary(A.routing_scores(a))
    return s.select("question_set", "lang", F.round("right_tool", 8).alias("right_tool"), F.round("right_settings", 8).alias("right_settings"), "questions")
