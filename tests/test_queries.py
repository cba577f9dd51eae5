"""Registry rules and a sample of queries against their SQL (all of them: ``python -m tests.compare``)."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["a04_canonicalise_codes", "a13_detect_percent_units", "a17_panel_profile", "c02_unit_rollup", "d03_kaplan_meier", "f13_pareto_front",
          "g03_unit_wave_table", "h10_score_rolling", "k06_auc", "k08_spearman", "l02_route_questions", "l05_grounding_check"]


def test_names_and_sql_belong_together():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 120 and all(re.fullmatch(r"[a-l]\d\d_[a-z0-9_]+|op\d+_[a-z0-9_]+|pipeline", n) for n in q)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None
