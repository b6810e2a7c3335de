"""Queries over the golden-set evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.operators import evaluate
from docledger.plans import fixtures as fx
from docledger.plans.registry import query


def gated_cases(spark, folder) -> DataFrame:
    return evaluate.gate_cases(fx.golden(spark, folder), fx.evaluated_documents(spark, folder))


def evaluated(spark, folder) -> DataFrame:
    return evaluate.case_results(gated_cases(spark, folder))


@query("evl_gate", "SELECT id, status, error, used_provider FROM fx_eval", ("fx_eval",))
def evl_gate(spark, folder):
    return gated_cases(spark, folder).select("id", "status", "error", "used_provider")


SCALAR_SQL = """
    SELECT id, 'vendor_name' AS field, true AS matched, NULL AS reason, '  ' || upper(vendor_name) AS expected_value FROM fx_eval
    WHERE status = 'ok' AND NOT odd AND vendor_name IS NOT NULL
    UNION ALL SELECT id, 'invoice_date', true, NULL, strftime(invoice_date, '%Y-%m-%d') FROM fx_eval WHERE status = 'ok' AND NOT odd
    UNION ALL SELECT id, 'currency', k % 7 <> 0, CASE WHEN k % 7 = 0 THEN 'text mismatch' END, CASE WHEN k % 7 = 0 THEN 'ZZZ' ELSE currency END
    FROM fx_eval WHERE status = 'ok' AND NOT odd
    UNION ALL SELECT id, 'total_amount', k % 4 <> 2, CASE WHEN k % 4 = 2 THEN 'numeric mismatch (tol=0.01)' END, NULL
    FROM fx_eval WHERE status = 'ok' AND NOT odd"""


@query("evl_fields", f"""
    SELECT id, field, expected_value FROM ({SCALAR_SQL}) WHERE field <> 'total_amount'""", ("fx_eval",))
def evl_fields(spark, folder):
    fields = evaluate.field_results(gated_cases(spark, folder))
    named = fields.where(~F.col("field").startswith("line_items") & (F.col("field") != "total_amount"))
    return named.select("id", "field", "expected_value")


@query("evl_compare", f"SELECT id, field, matched, reason FROM ({SCALAR_SQL})", ("fx_eval",))
def evl_compare(spark, folder):
    fields = evaluate.field_results(gated_cases(spark, folder))
    return fields.where(~F.col("field").startswith("line_items")).select("id", "field", "matched", "reason")


@query("evl_line_items", """
    SELECT id, 'line_items.count' AS field, k % 6 <> 0 AS matched, CASE WHEN k % 6 = 0 THEN 'count mismatch' END AS reason
    FROM fx_eval WHERE status = 'ok' AND NOT odd AND k % 3 = 0
    UNION ALL SELECT id, 'line_items', false, '''line_items'' must be a list' FROM fx_eval WHERE status = 'ok' AND odd
    UNION ALL SELECT e.id, 'line_items[' || (l.line_no - 1) || '].' || f, true, NULL
    FROM fx_eval e JOIN fx_lines l ON l.k = e.k, (SELECT unnest(['description', 'quantity', 'line_total']) AS f)
    WHERE status = 'ok' AND NOT odd AND e.k % 3 = 0 AND (e.k % 6 <> 0 OR l.line_no < e.n_lines)""", ("fx_eval", "fx_lines"))
def evl_line_items(spark, folder):
    fields = evaluate.field_results(gated_cases(spark, folder))
    return fields.where(F.col("field").startswith("line_items")).select("id", "field", "matched", "reason")


@query("evl_case_scores", """
    SELECT id, status, CASE WHEN status = 'ok' THEN matched END AS matched_fields, CASE WHEN status = 'ok' THEN total END AS total_fields,
           CASE WHEN status = 'ok' THEN round_even(matched / total, 4) END AS score FROM fx_eval""", ("fx_eval",))
def evl_case_scores(spark, folder):
    return evaluated(spark, folder).select("id", "status", "matched_fields", "total_fields", "score")


@query("evl_summary", """
    SELECT count(*) AS cases_total, count(*) FILTER (status = 'ok') AS ok_total, count(*) FILTER (status <> 'ok') AS error_total,
           round_even(cast(sum(cast(CASE WHEN status = 'ok' THEN round_even(matched / total, 4) END AS DECIMAL(10,4))) AS DOUBLE)
             / count(*) FILTER (status = 'ok'), 4) AS avg_score FROM fx_eval""", ("fx_eval",))
def evl_summary(spark, folder):
    return evaluate.summarize(evaluated(spark, folder))


@query("evl_providers", """
    SELECT used_provider, count(*) AS ok_total FROM fx_eval WHERE status = 'ok' GROUP BY used_provider""", ("fx_eval",))
def evl_providers(spark, folder):
    return evaluate.evaluated_providers(evaluated(spark, folder))


@query("evl_gate_result", """
    SELECT round_even(cast(sum(cast(CASE WHEN status = 'ok' THEN round_even(matched / total, 4) END AS DECIMAL(10,4))) AS DOUBLE)
             / count(*) FILTER (status = 'ok'), 4) AS avg_score, avg_score < 0.9 AS failed FROM fx_eval""", ("fx_eval",))
def evl_gate_result(spark, folder):
    summary = evaluate.summarize(evaluated(spark, folder))
    return evaluate.quality_gate(summary, 0.9).select("avg_score", "failed")
