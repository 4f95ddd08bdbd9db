"""Texts built from columns of the given tables, so that each rule of the text operators meets many
rows: statements and questions from orders, fenced replies from events, Markdown from documents.

Each is one SQL expression that Spark and the checking SQL read alike (quotes and line ends by chr).
"""

from __future__ import annotations


def _by(key: str, cases: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(cases))
    return f"CASE {key} % {len(cases)} {whens} END"


_KEY, _DAY, _CUST = "CAST(o_orderkey AS STRING)", "CAST(CAST(o_orderdate AS DATE) AS STRING)", "CAST(o_custkey AS STRING)"
_Q, _NL = "chr(39)", "chr(10)"

STATEMENT_ID = f"concat('order-', {_KEY})"
STATEMENT = _by("o_orderkey", [
    f"concat('SELECT * FROM orders WHERE order_id = ', {_KEY})",
    f"concat('select order_id from orders where order_date > ', {_Q}, {_DAY}, {_Q}, ' limit 20;')",
    f"concat('WITH big AS (SELECT * FROM orders WHERE order_total > ', {_CUST}, ') SELECT count(*) FROM big JOIN refunds USING (order_id)')",
    f"concat('DELETE FROM orders WHERE order_id = ', {_KEY})",
    f"concat('SELECT 1; DROP TABLE customers_', {_CUST})",
    f"concat('SELECT * FROM customer_', {_CUST}, ' JOIN orders ON true')",
    f"concat('select ', {_Q}, 'update ', o_orderpriority, '; drop', {_Q}, ' as note from payments')",
    f"concat('  ', {_NL}, ' ; ')",
    f"concat('explain select * from orders where customer_id = ', {_CUST})",
    f"concat('with a as (select 1), b as (select * from a) select * from b join c_', {_KEY}, ' on true')",
    f"concat('SELECT channel, sum(order_total)', {_NL}, 'FROM fact_orders_enriched', {_NL}, 'GROUP BY channel LIMIT ', {_KEY})",
    f"concat('insert into orders select * from orders where order_id <> ', {_KEY})",
    f"concat('SELECT * FROM region_performance r JOIN category_performance c ON r.order_date = c.order_date -- ', o_orderpriority)",
])

_KPIS = ["gmv", "order count", "aov", "conversion_rate", "refund rate", "new_customer_ratio", "revenue", "cancellation_rate", "stock"]
QUESTION = _by("o_orderkey", [
    f"concat('Why did {kpi} of order ', {_KEY}, ' move by {dim} since ', {_DAY}, '?')"
    for kpi, dim in zip(_KPIS, ["channel", "region", "category and channel", "customer_type", "payment type", "campaign", "it", "Region", "payment_type"])])

REPLY = _by("event_id", [
    "props",
    f"concat('Here it is:', {_NL}, '```json', {_NL}, props, {_NL}, '```', {_NL}, 'Done.')",
    f"concat('```', {_NL}, props, {_NL}, '```')",
    f"concat('```json', {_NL}, props)",
    "concat('no reply for ', event_type)",
    f"concat('``` ', event_type, ' ``` and ```json ', props, ' ```')",
])

MARKDOWN = _by("doc_id", [
    "text",
    f"concat('# ', source, {_NL}, text, {_NL}, '## Language ', lang, {_NL}, text)",
    f"concat(text, {_NL}, '### ', lang, ' part  ', {_NL}, {_NL}, '#### no heading', {_NL}, '#no heading either')",
    f"concat('## ', source, {_NL}, '# ', lang, {_NL}, {_NL}, text)",
    f"concat('#  ', {_NL}, text, {_NL}, '#', chr(9), 'tabbed ', source, {_NL}, 'end')",
])
