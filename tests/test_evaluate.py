from __future__ import annotations

from conftest import TABLES
from docledger.operators import evaluate
from docledger.plans.evaluation_queries import gated_cases


def test_fields_are_compared_once(spark):
    """The comparison stands once in the plan, not again in filters that Spark makes up, and each value's kind is found once."""
    fields = evaluate.field_results(gated_cases(spark, TABLES))
    plan = fields._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("numeric mismatch") == 1
    assert plan.count("^[A-Z]+") == 2
