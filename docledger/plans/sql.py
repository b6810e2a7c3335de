"""The domain tables of ``fixtures`` in plain SQL, as named common table expressions."""

from __future__ import annotations

HASH = "sha256(cast({k} - (CASE WHEN {k} % 13 = 0 THEN 1 ELSE 0 END) AS VARCHAR))"


def hash_of(k: str) -> str:
    return HASH.format(k=k)


TABLES: dict[str, tuple[list[str], str]] = {
    "fx_orders": ([], f"""
        SELECT o_orderkey AS k, o_custkey AS custkey, o_orderstatus AS orderstatus,
               o_totalprice AS totalprice, o_orderdate AS ordered_at,
               'doc-' || o_orderkey AS document_id, 'inbox/' || o_orderkey || '.pdf' AS drive_file_id,
               {hash_of('o_orderkey')} AS file_hash
        FROM orders"""),
    "fx_lines": ([], """
        SELECT l_orderkey AS k,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                 l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS line_no,
               p_name AS description, l_quantity AS quantity,
               cast(floor(cast(l_extendedprice * 100 AS BIGINT) / l_quantity) AS BIGINT) / 100.0::DOUBLE AS unit_price,
               cast(l_extendedprice * 100 AS BIGINT) AS cents,
               cast(l_extendedprice * 100 AS BIGINT) / 100.0::DOUBLE AS line_total, p_type AS category
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "fx_truth": (["fx_orders", "fx_lines"], """
        SELECT o.k, document_id, drive_file_id, file_hash, ordered_at, orderstatus,
               CASE WHEN o.k % 5 = 0 THEN 'receipt' ELSE 'invoice' END AS document_type,
               CASE WHEN o.k % 31 <> 0 THEN c_name END AS vendor_name,
               CASE WHEN o.k % 7 = 0 AND o.k % 19 <> 0 THEN 'TIN-' || o.k END AS vendor_tax_id,
               CASE WHEN o.k % 19 <> 0 THEN 'INV-' || o.k END AS invoice_number,
               cast(ordered_at AS DATE) AS invoice_date,
               CASE c_nationkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP'
                 WHEN 3 THEN 'BDT' ELSE 'INR' END AS currency,
               s.cents / 100.0::DOUBLE AS subtotal,
               (s.cents // 10) / 100.0::DOUBLE AS tax_amount,
               (s.cents + s.cents // 10 + CASE WHEN o.k % 17 = 0 THEN 999 ELSE 0 END) / 100.0::DOUBLE AS total_amount,
               CASE o.k % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'cash' WHEN 2 THEN 'bank' ELSE 'unknown' END AS payment_method,
               cast(30 + o.k % 70 AS DOUBLE) / 100 AS model_confidence,
               CASE o.k % 4 WHEN 0 THEN 'mistral' WHEN 2 THEN 'groq' ELSE 'openrouter' END AS provider,
               s.cents AS cents, s.n_lines AS n_lines, s.line_totals AS line_totals, s.line_cents AS line_cents
        FROM fx_orders o
        JOIN (SELECT k, cast(sum(cents) AS BIGINT) AS cents, count(*) AS n_lines,
                     list(line_total ORDER BY line_no) AS line_totals,
                     list(cents ORDER BY line_no) AS line_cents FROM fx_lines GROUP BY k) s ON s.k = o.k
        LEFT JOIN customer ON c_custkey = custkey"""),
    "fx_records": (["fx_truth"], """
        SELECT * REPLACE (
                 coalesce(vendor_name, 'Unknown Vendor') AS vendor_name,
                 CASE WHEN k % 47 = 0 THEN lower(currency) ELSE currency END AS currency,
                 CASE WHEN k % 59 = 0 THEN -1.0 ELSE total_amount END AS total_amount),
               CASE WHEN k % 23 = 0 AND k % 53 <> 0 THEN 0.0 ELSE
                 list_reduce(line_totals, lambda a, b: a + b) END AS item_sum,
               (k % 47 = 0 OR k % 53 = 0 OR k % 59 = 0) AS bad_schema
        FROM fx_truth"""),
    "fx_rules": (["fx_records"], """
        SELECT *,
               abs(round_even(subtotal + tax_amount, 2) - round_even(total_amount, 2)) > 0.01 AS v1,
               (round_even(item_sum, 2) <= 0.01 AND round_even(subtotal, 2) > 0.01) AS v2,
               (NOT (round_even(item_sum, 2) <= 0.01 AND round_even(subtotal, 2) > 0.01)
                 AND abs(round_even(item_sum, 2) - round_even(subtotal, 2)) > 0.01) AS v3,
               (document_type = 'invoice' AND invoice_number IS NULL AND vendor_tax_id IS NULL) AS v4
        FROM fx_records"""),
    "fx_routed": (["fx_rules"], """
        SELECT *, round_even(greatest(1.0::DOUBLE - (v1::INT + v2::INT + v3::INT + v4::INT) / 3.0::DOUBLE, 0.0), 4) AS score,
               NOT (v1 OR v3) AS valid,
               CASE WHEN bad_schema THEN 'schema_validation_failed'
                    ELSE concat_ws(',', CASE WHEN v1 OR v3 THEN 'validation_failed' END,
                                   CASE WHEN model_confidence < 0.5 THEN 'low_confidence' END) END AS reasons,
               CASE WHEN bad_schema OR v1 OR v3 OR model_confidence < 0.5 THEN 'REVIEW_REQUIRED' ELSE 'STORED' END AS route
        FROM fx_rules"""),
    "fx_ledger": (["fx_routed"], """
        SELECT k AS id, ordered_at AS processed_at_utc,
               CASE WHEN orderstatus = 'F' THEN 'ARCHIVED' ELSE 'STORED' END AS row_status,
               drive_file_id, file_hash, document_type, vendor_name, vendor_tax_id, invoice_number,
               cast(invoice_date AS VARCHAR) AS invoice_date, currency, subtotal, tax_amount, total_amount,
               payment_method, model_confidence, score AS validation_score, score < 0.6 AS needs_review,
               document_id, provider AS used_provider, k
        FROM fx_routed WHERE route = 'STORED'"""),
    "fx_resolved": (["fx_ledger"], "SELECT DISTINCT file_hash FROM fx_ledger"),
    "fx_claims": (["fx_orders"], """
        SELECT drive_file_id, file_hash,
               CASE k % 5 WHEN 0 THEN 'STORED' WHEN 1 THEN 'ARCHIVED' WHEN 2 THEN 'FAILED'
                 WHEN 3 THEN 'REVIEW_REQUIRED' ELSE 'CLAIMED' END AS status,
               'worker-' || (k % 3) AS owner_id, k
        FROM fx_orders WHERE k % 10 <> 7"""),
    "fx_attempts": (["fx_orders"], """
        SELECT drive_file_id, file_hash, 'poll-' || ((k + p) % 4) AS owner_id, k * 2 + p AS arrival, k, p
        FROM fx_orders, (SELECT unnest([0, 1]) AS p) WHERE p = 0 OR k % 3 = 0"""),
    "fx_claim_results": (["fx_attempts", "fx_claims"], """
        SELECT a.drive_file_id, a.file_hash, a.arrival,
               CASE WHEN (c.status IS NULL OR c.status IN ('FAILED', 'REVIEW_REQUIRED')) AND a.p = 0 THEN 'claimed'
                    WHEN c.status IN ('STORED', 'ARCHIVED') THEN 'already_processed'
                    ELSE 'already_claimed' END AS claim_status,
               CASE WHEN c.status IS NULL OR c.status IN ('FAILED', 'REVIEW_REQUIRED') THEN 'poll-' || (a.k % 4)
                    ELSE c.owner_id END AS owner_id
        FROM fx_attempts a LEFT JOIN fx_claims c USING (drive_file_id, file_hash)"""),
    "fx_dead": ([], f"""
        SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at_utc,
               CASE WHEN event_id % 40 <> 0 THEN 'doc-' || (event_id % 500) END AS document_id,
               CASE WHEN event_id % 25 <> 0 THEN 'inbox/' || (event_id % 500) || '.pdf' END AS drive_file_id,
               CASE WHEN event_id % 25 <> 0 THEN {hash_of('(event_id % 500)')} END AS file_hash,
               CASE WHEN event_id % 3 = 0 THEN 'REVIEW_REQUIRED' WHEN event_id % 31 = 0 THEN 'QUEUED' ELSE 'FAILED' END AS status,
               CASE WHEN event_id % 4 <> 0 THEN 'invalid_json' END AS error_code,
               CASE WHEN event_id % 5 = 0 THEN 'Model returned invalid JSON' END AS error_message,
               CASE WHEN event_id % 6 <> 0 THEN 'mistral' END AS used_provider,
               event_id AS seq
        FROM events WHERE event_type = 'error'"""),
    "fx_active_dead": (["fx_dead", "fx_resolved"], """
        SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY coalesce(document_id,
                   coalesce(drive_file_id, '') || '|' || coalesce(file_hash, '')) ORDER BY seq DESC) AS rn
          FROM fx_dead
          WHERE status IN ('FAILED', 'REVIEW_REQUIRED')
            AND (file_hash IS NULL OR file_hash NOT IN (SELECT file_hash FROM fx_resolved)))
        WHERE rn = 1"""),
    "fx_replay": (["fx_dead", "fx_claims"], """
        SELECT d.seq, d.document_id, d.drive_file_id, d.file_hash, d.status,
               CASE WHEN d.drive_file_id IS NULL OR d.file_hash IS NULL OR d.document_id IS NULL THEN 'skipped_invalid'
                    WHEN c.status IN ('STORED', 'ARCHIVED') THEN 'skipped_processed'
                    ELSE 'queued_for_replay' END AS outcome, c.status AS held
        FROM fx_dead d LEFT JOIN fx_claims c USING (drive_file_id, file_hash)
        WHERE d.status = 'FAILED'"""),
    "fx_metrics": ([], """
        SELECT CASE WHEN event_id % 101 <> 0 THEN 'documents_' || event_type || '_total' END AS metric,
               CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 1
                    ELSE cast(trunc(value) AS BIGINT) END AS whole,
               event_id % 997 AS latency_ms, event_type
        FROM events"""),
    "fx_counters": (["fx_metrics"], """
        SELECT metric, cast(sum(whole) AS BIGINT) AS value FROM fx_metrics
        WHERE metric IS NOT NULL AND whole IS NOT NULL GROUP BY metric"""),
    "fx_queue": (["fx_orders"], """
        SELECT k, document_id,
               CASE k % 4 WHEN 0 THEN 'REVIEW_REQUIRED' WHEN 1 THEN 'RESOLVED_STORED'
                 WHEN 2 THEN 'RESOLVED_DUPLICATE' ELSE 'REJECTED' END AS status,
               CASE WHEN k % 15 = 0 THEN '' WHEN k % 8 = 0 THEN 'validation_failed'
                 ELSE 'validation_failed,low_confidence' END AS reasons,
               strftime(ordered_at, '%Y-%m-%d %H:%M:%S') AS created_at_utc,
               CASE WHEN k % 4 <> 0 AND k % 7 <> 0 THEN
                 strftime(ordered_at + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END AS resolved_at_utc,
               CASE WHEN k % 36 <> 0 THEN drive_file_id END AS source_file_id,
               CASE WHEN k % 33 = 0 THEN '' ELSE file_hash END AS file_hash,
               CASE WHEN k % 24 <> 0 THEN 'mistral' ELSE 'unknown' END AS used_provider,
               'Vendor ' || custkey AS n_vendor,
               CASE WHEN k % 21 <> 0 THEN 'INV-' || k END AS n_number,
               strftime(ordered_at, '%Y-%m-%d') AS n_date,
               CASE WHEN k % 27 = 0 THEN 'usd' ELSE 'USD' END AS n_currency,
               CASE WHEN k % 12 = 0 THEN totalprice + 5 ELSE totalprice END AS n_total,
               CASE WHEN k % 4 <> 0 AND k % 5 <> 0 THEN 'checked ' || k END AS resolution_note, totalprice
        FROM fx_orders WHERE k % 3 = 0"""),
    "fx_active": (["fx_queue", "fx_resolved"], """
        SELECT * FROM fx_queue WHERE status = 'REVIEW_REQUIRED'
          AND (file_hash = '' OR file_hash NOT IN (SELECT file_hash FROM fx_resolved))"""),
    "fx_history": (["fx_queue"], """
        SELECT document_id, status, created_at_utc, resolved_at_utc, source_file_id, used_provider,
               CASE WHEN k % 4 IN (1, 2) THEN n_vendor ELSE 'Unknown' END AS vendor_name,
               CASE WHEN k % 4 IN (1, 2) THEN coalesce(n_number, '-') ELSE '-' END AS invoice_number,
               CASE WHEN k % 4 IN (1, 2) THEN n_total END AS total_amount,
               CASE WHEN k % 4 IN (1, 2) THEN n_currency ELSE 'NA' END AS currency, resolution_note,
               coalesce(resolved_at_utc, created_at_utc) AS decided_at
        FROM fx_queue WHERE status <> 'REVIEW_REQUIRED'"""),
    "fx_eval": (["fx_truth"], """
        SELECT *, CASE WHEN odd THEN 0 ELSE (vendor_name IS NOT NULL)::BIGINT + 3 + (CASE WHEN k % 3 = 0 THEN 1 + 3 * (n_lines - (k % 6 = 0)::BIGINT) ELSE 0 END)
                    - (k % 7 = 0)::BIGINT - (k % 4 = 2)::BIGINT - (k % 6 = 0)::BIGINT END AS matched_all,
               CASE WHEN error IS NOT NULL THEN NULL WHEN odd THEN 0 ELSE matched_all END AS matched,
               CASE WHEN error IS NOT NULL THEN NULL WHEN odd THEN 1
                    ELSE (vendor_name IS NOT NULL)::BIGINT + 3 + (CASE WHEN k % 3 = 0 THEN 1 + 3 * (n_lines - (k % 6 = 0)::BIGINT) ELSE 0 END) END AS total
        FROM (SELECT * EXCLUDE (provider), 'case-' || k AS id, k % 55 = 0 AS odd,
                     CASE WHEN k % 50 = 0 THEN 'file_not_found' WHEN k % 51 = 0 OR k % 52 = 0 THEN 'invalid_expected_payload'
                          WHEN k % 41 = 0 THEN 'all_providers_failed' END AS error,
                     CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status,
                     CASE WHEN error IS NULL THEN provider END AS used_provider
              FROM fx_truth)"""),
    "fx_decisions": (["fx_orders"], """
        SELECT k, document_id,
               CASE WHEN k % 10 = 8 THEN 'postpone' WHEN (k // 60) % 3 = 0 THEN ' Approve'
                    WHEN (k // 60) % 3 = 1 THEN 'reject' ELSE 'duplicate' END AS action,
               (k % 5 = 0 AND k % 60 <> 0) AS has_override,
               CASE WHEN k % 14 <> 0 THEN 'note ' || k END AS note, totalprice
        FROM fx_orders WHERE k % 2 = 0"""),
    "fx_approved": (["fx_decisions", "fx_queue", "fx_ledger"], """
        SELECT *, CASE WHEN refused IS NOT NULL THEN NULL
                       WHEN EXISTS (SELECT 1 FROM fx_ledger l WHERE l.drive_file_id = source_file_id
                                     AND l.file_hash = a.file_hash) THEN 'RESOLVED_DUPLICATE'
                       ELSE 'RESOLVED_STORED' END AS resolution_status
        FROM (
          SELECT d.document_id, d.note, d.k, q.source_file_id, nullif(q.file_hash, '') AS file_hash,
                 q.used_provider, d.has_override,
                 CASE WHEN q.document_id IS NULL THEN 'not_found'
                      WHEN q.status <> 'REVIEW_REQUIRED' THEN 'not_active'
                      WHEN NOT d.has_override AND q.n_currency = 'usd' THEN 'schema: currency: string_pattern_mismatch'
                      WHEN q.source_file_id IS NULL OR q.file_hash = '' THEN 'missing_key' END AS refused,
                 CASE WHEN d.has_override THEN 1.0
                      ELSE round_even(1.0::DOUBLE - ((abs(round_even(q.totalprice + 0.0, 2) - round_even(q.n_total, 2)) > 0.01)::INT
                           + (q.n_number IS NULL)::INT) / 3.0::DOUBLE, 4) END AS score
          FROM fx_decisions d LEFT JOIN fx_queue q USING (document_id)
          WHERE d.action = ' Approve') a"""),
}


def with_tables(names: list[str], body: str) -> str:
    """A query over the named tables and all they are built from."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in TABLES[name][0]:
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    parts = ", ".join(f"{name} AS ({TABLES[name][1]})" for name in ordered)
    return f"WITH {parts} {body}" if parts else body
