"""The same tables for DuckDB, written on their own as common table expressions."""

from __future__ import annotations

from tallywright.sources.ledger import AS_OF, RULES

_VIEWS = {
    "accounts": """
        SELECT c_custkey AS account_id, c_name AS name,
               CASE c_custkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' ELSE 'BHD' END AS currency,
               CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'business' ELSE 'personal' END AS category,
               c_custkey % 10 <> 0 AS included, 'BANK' || (c_nationkey % 7) AS aspsp, 's' || (c_custkey % 40) AS session_id
        FROM customer""",
    "transactions": """
        SELECT o_orderkey AS row_id, o_custkey AS account_id,
               CASE WHEN o_orderkey % 211 = 0 THEN '2024-2-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS booking_date,
               CASE a.currency WHEN 'JPY' THEN cents // 100 WHEN 'BHD' THEN cents * 10 ELSE cents END AS amount_minor,
               CASE WHEN o_orderkey % 101 = 0 THEN '' WHEN o_orderkey % 103 = 0 THEN NULL ELSE a.currency END AS currency,
               CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderpriority[1] IN ('1', '2') THEN 'CRDT' ELSE 'DBIT' END AS direction,
               CASE o_orderstatus WHEN 'F' THEN 'BOOK' WHEN 'O' THEN 'PDNG' ELSE 'HOLD' END AS status,
               CASE WHEN o_orderkey % 23 <> 0 THEN '  Payee  ' || (o_custkey % 50) || CASE WHEN o_orderkey % 2 = 0 THEN ' GmbH' ELSE ' gmbh ' END END AS counterparty,
               CASE WHEN o_orderkey % 29 <> 0 THEN 'Invoice ' || o_orderpriority || ' ref_' || (o_orderkey % 1000) END AS remittance,
               CASE WHEN o_orderkey % 4 <> 0 THEN 'R' || (o_orderkey % 300) END AS provider_ref,
               CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'transaction_id' ELSE 'entry_reference' END AS provider_ref_kind,
               CASE WHEN o_orderkey % 13 = 0 THEN 'superseded' WHEN o_orderkey % 17 = 0 THEN 'vanished' ELSE 'active' END AS state,
               o_orderkey % 7 = 0 AS needs_review,
               CASE WHEN o_orderkey % 7 = 0 THEN CASE o_orderkey % 35 WHEN 0 THEN 'amount_changed' WHEN 7 THEN 'direction_or_currency_changed'
                    WHEN 14 THEN 'provider_ref_reuse' WHEN 21 THEN 'cluster_oversized' ELSE 'content_present' END END AS review_reason
        FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM orders) o JOIN accounts a ON a.account_id = o.o_custkey""",
    "tags": """
        SELECT o_orderkey AS row_id, tag FROM orders, (VALUES (3, 0, 'groceries'), (5, 0, 'household'), (7, 1, 'travel'), (11, 0, 'awaiting-operator'), (19, 0, 'unclassifiable')) v(n, r, tag)
        WHERE o_orderkey % n = r""",
    "balances": """
        SELECT c_custkey AS account_id, seq, balance_type,
               CASE WHEN c_custkey % 31 <> 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) + more END AS amount_minor,
               CASE WHEN c_custkey % 37 = 0 THEN '' ELSE a.currency END AS currency
        FROM customer JOIN accounts a ON a.account_id = c_custkey, (VALUES (0, 'XPCD', 7), (1, 'CLBD', 0), (2, 'ITAV', 3), (3, 'OTHR', 1)) v(seq, balance_type, more)
        WHERE CASE seq WHEN 0 THEN c_custkey % 4 = 0 WHEN 1 THEN c_custkey % 2 = 0 WHEN 2 THEN c_custkey % 3 <> 0 ELSE c_custkey % 9 = 0 END""",
    "coverage": 'SELECT user_id AS account_id, CAST(ts AS DATE) AS "start", CAST(ts AS DATE) + CAST(event_id % 3 + 1 AS INTEGER) AS "end" FROM events',
    "notes": "SELECT doc_id AS note_id, doc_id * 7 % 997 AS row_id, CASE WHEN doc_id % 3 = 0 THEN 'operator' ELSE 'classifier' END AS author, text AS note FROM documents",
    "sync_state": f"""
        SELECT c_custkey AS account_id,
               CASE WHEN c_custkey % 13 <> 0 THEN strftime(TIMESTAMP '{AS_OF} 00:00:00' - to_minutes(CAST(c_custkey % 2000 AS BIGINT) - 60), '%Y-%m-%dT%H:%M:%S') || CASE WHEN c_custkey % 3 = 0 THEN 'Z' ELSE '' END END AS last_success_at,
               CASE WHEN c_custkey % 5 = 0 THEN 'partial' ELSE 'complete' END AS completeness,
               's' || (CASE WHEN c_custkey % 6 = 0 THEN c_custkey + 1 ELSE c_custkey END % 40) AS last_success_session
        FROM customer""",
    "rules": "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in RULES)
    + ") v(rule_id, counterparty_canon, remittance_token, direction, currency, amount_min_minor, amount_max_minor, dom_min, dom_max, weekdays, tags)",
}
_NEEDS = {"transactions": ["accounts"], "balances": ["accounts"]}


def with_views(sql: str, *names: str) -> str:
    """sql behind the views named; sql may start with WITH and names of its own."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    if not wanted:
        return sql
    head = ", ".join(f"{n} AS ({_VIEWS[n]})" for n in wanted)
    body = sql.strip()
    recursive = body[:14].upper() == "WITH RECURSIVE"
    if recursive:
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body[:4].upper() == "WITH" else f"WITH {head} {body}"
