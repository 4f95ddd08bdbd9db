"""Reference SQL (DuckDB dialect) for the correctness gate.

Each function returns plain SQL over the raw driver tables (region nation
customer orders lineitem part documents benchmark ...). The canonical binding
and the incident table are shared CTEs, written out here independently of the
DataFrame code they check.
"""

from __future__ import annotations

from kpiscope.functions import fixed as F_
from kpiscope.functions.fixed import DIMENSIONS, MONTH_FACTORS, WEEKEND_FACTOR
from kpiscope.incidents import DEFAULT_CASES

# KPI choice, written out for SQL: sum column, count column, whether the sum is in cents
_ORDERS, _PAID = ("amt_c", "n_total", True), ("paid_c", "n_paid", True)
_REFUNDS, _CANCELS = ("s_ref", "n_ref", False), ("s_can", "n_can", False)
COLUMNS_OF = {"order_total": _ORDERS, "paid_total": _PAID, "is_refunded": _REFUNDS, "is_cancelled": _CANCELS,
              "customer_type": (None, "n_ct", False), "is_new": ("s_new", "n_new", False)}
_RATES = {"refund_rate": (_REFUNDS, "mean"), "cancellation_rate": (_CANCELS, "mean"), "conversion_rate": (_ORDERS, "count")}
KPI_CHOICE = {
    "raw": {**_RATES, "gmv": (_ORDERS, "sum"), "revenue": (_ORDERS, "sum"), "order_count": (_ORDERS, "count"),
            "aov": (_ORDERS, "mean"), "new_customer_ratio": (COLUMNS_OF["customer_type"], "count")},
    "governed": {**_RATES, "gmv": (_PAID, "sum"), "revenue": (_PAID, "sum"), "order_count": (_PAID, "count"),
                 "aov": (_PAID, "mean"), "new_customer_ratio": (COLUMNS_OF["is_new"], "mean")},
}


def cents(x: str) -> str:
    return f"CAST(round(({x}) * CAST(100.0 AS DOUBLE)) AS BIGINT)"


def round2(x: str) -> str:
    return round_to(x, 2)


def round_to(x: str, d: int) -> str:
    """Scaled rounding; a zero result is +0.0 (Spark never yields -0.0 here)."""
    s = f"CAST({float(10 ** d)} AS DOUBLE)"
    r = f"(round(({x}) * {s}) / {s})"
    return f"(CASE WHEN {r} = 0 THEN CAST(0.0 AS DOUBLE) ELSE {r} END)"


def pct_change(new: str, old: str) -> str:
    return (f"(CASE WHEN ({old}) <> 0 THEN (({new}) - ({old})) / ({old}) * CAST(100.0 AS DOUBLE) "
            f"ELSE CAST(0.0 AS DOUBLE) END)")


def no_neg_zero(x: str) -> str:
    return f"(CASE WHEN ({x}) = 0 THEN CAST(0.0 AS DOUBLE) ELSE ({x}) END)"


def fmt_fixed(x: str, d: int = 1, sign: bool = False) -> str:
    """printf rounds the exact binary value, ties to even (as Python does)."""
    pat = ("%+" if sign else "%") + f".{d}f"
    return f"printf('{pat}', CAST({x} AS DOUBLE))"


def fmt_short(x: str) -> str:
    return f"regexp_replace(printf('%.2f', {no_neg_zero(x)}), '0$', '')"


def campaign_sql(d: str) -> str:
    m, day = f"month({d})", f"day({d})"
    return (f"(CASE WHEN {m} IN (3, 4) THEN 'spring_sale' WHEN {m} IN (6, 7) THEN 'summer_blast' "
            f"WHEN {m} = 8 THEN 'back_to_school' WHEN {m} IN (9, 10) THEN 'fall_promo' "
            f"WHEN {m} = 11 AND {day} >= 20 THEN 'black_friday' WHEN {m} = 12 THEN 'holiday_special' "
            f"ELSE 'none' END)")


def seasonal_sql(d: str) -> str:
    cases = " ".join(f"WHEN {k} THEN CAST({v} AS DOUBLE)" for k, v in MONTH_FACTORS.items())
    mf = f"(CASE month({d}) {cases} END)"
    return f"(CASE WHEN isodow({d}) >= 6 THEN {mf} * CAST({WEEKEND_FACTOR} AS DOUBLE) ELSE {mf} END)"


NET = "l_extendedprice * (CAST(1.0 AS DOUBLE) - l_discount)"
GROSS = f"{NET} * (CAST(1.0 AS DOUBLE) + l_tax)"

LINE_FACTS = f"""li AS (
  SELECT l_orderkey AS order_id, count(*) AS n_lines,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_return,
         max(CAST(l_shipdate AS DATE)) AS last_ship_date,
         sum({cents(NET)}) AS net_c,
         sum({cents(GROSS)}) AS gross_c,
         CASE WHEN max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 1 THEN 'O' ELSE 'F' END AS max_linestatus
  FROM lineitem GROUP BY l_orderkey)"""

CUST = """cust AS (
  SELECT c.c_custkey AS customer_id, g.r_name AS region, c.c_mktsegment AS category, g.n_name AS payment_type
  FROM customer c LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) g
    ON c.c_nationkey = g.n_nationkey)"""

FIRSTS = """firsts AS (
  SELECT o_orderkey AS first_order_id FROM (
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
    FROM orders) WHERE rn = 1)"""

CANON = f"""canon AS (
  SELECT o.o_orderkey AS order_id, CAST(o.o_orderdate AS DATE) AS order_date, o.o_custkey AS customer_id,
         CASE WHEN f.first_order_id IS NOT NULL THEN 'new' ELSE 'returning' END AS customer_type,
         o.o_orderpriority AS channel, c.region, c.category,
         {campaign_sql('CAST(o.o_orderdate AS DATE)')} AS campaign, c.payment_type,
         o.o_totalprice AS order_total,
         CASE WHEN o.o_orderstatus = 'F' THEN 'cancelled' WHEN o.o_orderstatus = 'P' THEN 'pending'
              WHEN coalesce(li.has_return, 0) = 1 THEN 'refunded' ELSE 'completed' END AS order_status,
         o.o_orderstatus = 'F' AS is_cancelled,
         (NOT (o.o_orderstatus = 'F')) AND coalesce(li.has_return, 0) = 1 AS is_refunded,
         o.o_orderstatus = 'P' AS is_pending,
         CAST(coalesce(li.n_lines, 0) AS INTEGER) AS n_items
  FROM orders o
  LEFT JOIN cust c ON o.o_custkey = c.customer_id
  LEFT JOIN li ON o.o_orderkey = li.order_id
  LEFT JOIN firsts f ON o.o_orderkey = f.first_order_id)"""

STAR = f"{LINE_FACTS},\n{CUST},\n{FIRSTS},\n{CANON}"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return f"CAST({v} AS DOUBLE)"
    if hasattr(v, "isoformat"):
        return f"DATE '{v.isoformat()}'"
    return "'" + str(v).replace("'", "''") + "'"


def cases_cte(cases=None) -> str:
    """cases0 (raw incidents) and cases (with V0 baseline and day counts)."""
    rows = []
    day = lambda d: f"DATE '{d}'" if d else "CAST(NULL AS DATE)"
    for c in cases or DEFAULT_CASES:
        tag, (first, last) = c.get("tag") or {}, c.get("baseline") or (None, None)
        vals = [_lit(c["case_id"]), _lit(c["kpi_name"]), day(c["start"]), day(c["end"]), day(first), day(last),
                _lit(c["description"]), _lit(c["cause"]), _lit(bool(c.get("review"))),
                *(f"CAST({_lit(tag.get(k))} AS VARCHAR)" for k in ("type", "channel", "region", "category", "payment_type", "campaign"))]
        rows.append("(" + ", ".join(vals) + ")")
    cols = ("case_id, kpi_name, affected_start_date, affected_end_date, bs, be, description, "
            "expected_primary_cause, should_trigger_human_review, i_type, i_channel, i_region, "
            "i_category, i_payment_type, i_campaign")
    values = ",\n    ".join(rows)
    return f"""cases0 AS (
  SELECT * FROM (VALUES
    {values}) AS t({cols})),
cases AS (
  SELECT *,
    CASE WHEN bs IS NULL OR be IS NULL
         THEN (affected_start_date - 1) - CAST(greatest(affected_end_date - affected_start_date + 1, 14) - 1 AS INTEGER)
         ELSE bs END AS baseline_start,
    CASE WHEN bs IS NULL OR be IS NULL THEN affected_start_date - 1 ELSE be END AS baseline_end
  FROM cases0),
casesd AS (
  SELECT *, CAST(baseline_end - baseline_start + 1 AS INTEGER) AS baseline_days,
         CAST(affected_end_date - affected_start_date + 1 AS INTEGER) AS anomaly_days
  FROM cases)"""


def days(lo: str, hi: str) -> str:
    return f"unnest(generate_series(CAST({lo} AS TIMESTAMP), CAST({hi} AS TIMESTAMP), INTERVAL 1 DAY))"


CALENDAR = f"""cal AS (
  SELECT case_id, kpi_name, baseline_days, anomaly_days, 'baseline' AS win,
         CAST({days('baseline_start', 'baseline_end')} AS DATE) AS order_date FROM casesd
  UNION ALL
  SELECT case_id, kpi_name, baseline_days, anomaly_days, 'anomaly' AS win,
         CAST({days('affected_start_date', 'affected_end_date')} AS DATE) AS order_date FROM casesd)"""

MEASURE_AGGS = f"""count(*) AS n_rows, count(order_total) AS n_total, sum({cents('order_total')}) AS amt_c,
    count(is_refunded) AS n_ref, sum(CAST(is_refunded AS INTEGER)) AS s_ref,
    count(is_cancelled) AS n_can, sum(CAST(is_cancelled AS INTEGER)) AS s_can,
    count(customer_type) AS n_ct,
    count(CASE WHEN NOT is_cancelled AND NOT is_pending THEN order_total END) AS n_paid,
    sum(CASE WHEN NOT is_cancelled AND NOT is_pending THEN {cents('order_total')} END) AS paid_c,
    count(customer_type) AS n_new, sum(CAST(customer_type = 'new' AS INTEGER)) AS s_new"""


def cube_cte(dims=None, bounded: bool = True) -> str:
    dims = dims or DIMENSIONS
    where = ("WHERE order_date BETWEEN (SELECT least(min(baseline_start), min(affected_start_date)) FROM casesd) "
             "AND (SELECT greatest(max(baseline_end), max(affected_end_date)) FROM casesd)") if bounded else ""
    parts = [f"SELECT order_date, '{d}' AS dimension, CAST({d} AS VARCHAR) AS slice, order_total, "
             f"is_refunded, is_cancelled, is_pending, customer_type FROM canon {where}" for d in dims]
    parts.append("SELECT order_date, '__total__' AS dimension, '__total__' AS slice, order_total, "
                 f"is_refunded, is_cancelled, is_pending, customer_type FROM canon {where}")
    union = "\n    UNION ALL ".join(parts)
    return f"""longf AS (
    {union}),
cube AS (
  SELECT order_date, dimension, slice, {MEASURE_AGGS}
  FROM longf GROUP BY order_date, dimension, slice)"""


def _part(columns: tuple, agg: str, what: str) -> str:
    total, count, in_cents = columns
    return {"sum": f"CAST({total or 'NULL'} AS BIGINT)", "cnt": f"CAST({count} AS BIGINT)",
            "scale": f"CAST({100.0 if in_cents else 1.0} AS DOUBLE)", "agg": f"'{agg}'"}[what]


def pick(mode: str | None, what: str, metric: str | None = None, agg: str | None = None) -> str:
    if metric is not None:
        return _part(COLUMNS_OF[metric], agg, what)
    whens = " ".join(f"WHEN kpi_name = '{k}' THEN {_part(*choice, what)}" for k, choice in KPI_CHOICE[mode].items())
    return f"(CASE {whens} ELSE {_part(_ORDERS, 'sum', what)} END)"


def value(agg: str, s: str, n: str, d: str) -> str:
    return (f"(CASE WHEN {agg} = 'sum' THEN {s} / {d} "
            f"WHEN {agg} = 'mean' THEN (CASE WHEN {n} > 0 THEN {s} / {n} ELSE CAST(0.0 AS DOUBLE) END) "
            f"ELSE CAST({n} AS DOUBLE) / {d} END)")


def window_sums_cte(metric=None, agg=None, mode="raw", total: bool = False) -> str:
    dim_filter = "cb.dimension = '__total__'" if total else "cb.dimension <> '__total__' AND cb.slice IS NOT NULL"
    every = "FROM j" if not total else ("FROM (SELECT case_id, kpi_name, baseline_days, anomaly_days, '__total__' AS dimension, "
        f"'__total__' AS slice, {pick(mode, 'scale', metric, agg)} AS scale, {pick(mode, 'agg', metric, agg)} AS agg FROM casesd) c "
        "LEFT JOIN (SELECT case_id AS of_case, win, s, n FROM j) ON of_case = case_id")
    return f"""j AS (
  SELECT c.case_id, c.kpi_name, c.baseline_days, c.anomaly_days, c.win, cb.dimension, cb.slice,
         {pick(mode, 'sum', metric, agg)} AS s, {pick(mode, 'cnt', metric, agg)} AS n,
         {pick(mode, 'scale', metric, agg)} AS scale, {pick(mode, 'agg', metric, agg)} AS agg
  FROM cube cb JOIN cal c ON cb.order_date = c.order_date WHERE {dim_filter}),
ws AS (
  SELECT case_id, kpi_name, agg, scale, baseline_days, anomaly_days, dimension, slice,
         sum(CASE WHEN win = 'baseline' THEN s END) AS bl_s, sum(CASE WHEN win = 'baseline' THEN n END) AS bl_n,
         sum(CASE WHEN win = 'anomaly' THEN s END) AS an_s, sum(CASE WHEN win = 'anomaly' THEN n END) AS an_n
  {every} GROUP BY case_id, kpi_name, agg, scale, baseline_days, anomaly_days, dimension, slice),
vals AS (
  SELECT *,
    {value('agg', 'CAST(coalesce(bl_s, 0) AS DOUBLE) / scale', 'coalesce(bl_n, 0)', 'baseline_days')} AS bl_val,
    {value('agg', 'CAST(coalesce(an_s, 0) AS DOUBLE) / scale', 'coalesce(an_n, 0)', 'anomaly_days')} AS an_val,
    CAST(coalesce(bl_n, 0) AS BIGINT) AS sample_size_baseline,
    CAST(coalesce(an_n, 0) AS BIGINT) AS sample_size_anomaly
  FROM ws)"""


def slices_cte(metric=None, agg=None, mode="raw") -> str:
    chg = "CAST(round((an_val - bl_val) * CAST(100.0 AS DOUBLE)) AS BIGINT)"
    return f"""{window_sums_cte(metric, agg, mode)},
v2 AS (SELECT *, {chg} AS chg_c FROM vals),
v3 AS (SELECT *, sum(chg_c) OVER (PARTITION BY case_id, dimension) AS total_c,
              row_number() OVER (PARTITION BY case_id, dimension ORDER BY abs(chg_c) DESC, slice ASC) AS rk
       FROM v2),
slices AS (
  SELECT case_id, kpi_name, dimension, slice AS dimension_value,
         {round2('bl_val')} AS baseline_daily, {round2('an_val')} AS anomaly_daily,
         CAST(chg_c AS DOUBLE) / CAST(100.0 AS DOUBLE) AS absolute_change,
         {round2(pct_change('an_val', 'bl_val'))} AS percent_change,
         sample_size_baseline, sample_size_anomaly,
         CASE WHEN total_c <> 0 THEN {round2('CAST(chg_c AS DOUBLE) / CAST(total_c AS DOUBLE) * CAST(100.0 AS DOUBLE)')}
              ELSE CAST(0.0 AS DOUBLE) END AS contribution_pct,
         CAST(rk AS BIGINT) AS driver_rank, chg_c
  FROM v3)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def slice_base(metric=None, agg=None, mode="raw") -> str:
    return with_(STAR, cases_cte(), CALENDAR, cube_cte(), slices_cte(metric, agg, mode))


SLICE_COLS = ("case_id, kpi_name, dimension, dimension_value, baseline_daily, anomaly_daily, "
              "absolute_change, percent_change, sample_size_baseline, sample_size_anomaly, "
              "contribution_pct, driver_rank")


PAID_SQL = "(NOT is_cancelled AND NOT is_pending)"
_PAID_C = f"sum(CASE WHEN {PAID_SQL} THEN {cents('order_total')} END)"
_MONEY = "CAST(100.0 AS DOUBLE)"


def money(c: str) -> str:
    return f"(CAST({c} AS DOUBLE) / {_MONEY})"


def rate_sql(flag: str) -> str:
    return f"(CAST(sum(CAST({flag} AS INTEGER)) AS DOUBLE) / CAST(count(*) AS DOUBLE))"


KPI_SQL = {
    "total_orders": "count(*)",
    "paid_orders": f"count_if({PAID_SQL})",
    "gmv": money(_PAID_C),
    "aov": f"(CASE WHEN count_if({PAID_SQL}) <> 0 THEN {money(_PAID_C)} / CAST(count_if({PAID_SQL}) AS DOUBLE) END)",
    "refund_rate": rate_sql("is_refunded"),
    "cancellation_rate": rate_sql("is_cancelled"),
    "new_customer_ratio": rate_sql("customer_type = 'new'"),
    "revenue": money(_PAID_C),
}


def kpi_sql(names) -> str:
    return ", ".join(f"{KPI_SQL[n]} AS {n}" for n in names)


REFUNDS = f"""refunds AS (
  SELECT li.order_id AS refund_id, li.order_id, li.last_ship_date AS refund_date,
         {money('li.net_c')} AS refund_amount, li.max_linestatus AS reason
  FROM li JOIN orders o ON li.order_id = o.o_orderkey
  WHERE li.has_return = 1 AND o.o_orderstatus <> 'F')"""

PAYMENTS = f"""payments AS (
  SELECT li.order_id AS payment_id, li.order_id, c.payment_type, {money('li.gross_c')} AS amount,
         CASE WHEN o.o_orderstatus = 'F' THEN 'failed' WHEN o.o_orderstatus = 'P' THEN 'pending'
              ELSE 'completed' END AS payment_status,
         CAST(o.o_orderdate AS DATE) AS payment_date
  FROM li JOIN orders o ON li.order_id = o.o_orderkey LEFT JOIN cust c ON o.o_custkey = c.customer_id)"""

PRODUCTS = """products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_retailprice AS base_price
  FROM part)"""

ORDER_ITEMS = """order_items AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS item_id, l.l_orderkey AS order_id, l.l_partkey AS product_id,
         CAST(l.l_quantity AS INTEGER) AS quantity, p.base_price AS unit_price, l.l_extendedprice AS line_total
  FROM lineitem l LEFT JOIN products p ON l.l_partkey = p.product_id)"""

FULL_STAR = f"{STAR},\n{REFUNDS},\n{PAYMENTS},\n{PRODUCTS},\n{ORDER_ITEMS}"

ENRICHED = """enriched AS (
  SELECT o.order_id, o.order_date, o.customer_id, o.customer_type, o.channel, o.region, o.category,
         o.campaign, o.payment_type, o.order_total, o.order_status, o.is_cancelled, o.is_refunded,
         o.is_pending, o.n_items, coalesce(r.refund_amount, CAST(0.0 AS DOUBLE)) AS refund_amount,
         r.refund_date, r.reason AS refund_reason, p.amount AS payment_amount, p.payment_status
  FROM canon o LEFT JOIN refunds r ON o.order_id = r.order_id LEFT JOIN payments p ON o.order_id = p.order_id)"""

LINE_LEVEL = f"""refunds AS (
  SELECT l_orderkey AS order_id, CAST(l_shipdate AS DATE) AS refund_date, l_linestatus AS reason,
         {money(cents('l_extendedprice * (CAST(1.0 AS DOUBLE) - l_discount)'))} AS refund_amount
  FROM lineitem WHERE l_returnflag = 'R'),
payments AS (
  SELECT l_orderkey AS order_id, CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'completed' END AS payment_status,
         {money(cents('l_extendedprice * (CAST(1.0 AS DOUBLE) - l_discount) * (CAST(1.0 AS DOUBLE) + l_tax)'))} AS amount
  FROM lineitem)"""

LABEL_CAL = f"""lcal AS (
  SELECT case_id, order_date,
         CASE WHEN order_date BETWEEN affected_start_date AND affected_end_date THEN 'anomaly'
              ELSE 'baseline' END AS time_window
  FROM (SELECT case_id, affected_start_date, affected_end_date,
               CAST({days('baseline_start', 'affected_end_date')} AS DATE) AS order_date FROM casesd))"""

WINDOW_AGGS = f"""CAST(sum(n_rows) AS BIGINT) AS order_count, {money('sum(amt_c)')} AS gmv,
  (CASE WHEN sum(n_total) <> 0 THEN {money('sum(amt_c)')} / CAST(sum(n_total) AS DOUBLE) END) AS aov"""


# ---------------------------------------------------------------- SQL audit
from kpiscope.functions.fixed import ALLOWED_TABLES, FORBIDDEN_KEYWORDS, KPI_SCAN_ORDER, DEFAULT_DIMENSIONS  # noqa: E402

_WS = r"[ \t\n\x0B\f\r]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + _WS + '+|' + _WS + '+$')}, '', 'g')"


def word_runs_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {q(r'[\p{L}\p{N}_]+')})"


def audit_cte(source: str) -> str:
    """source: a CTE body producing (query_id, sql)."""
    allowed_text = "[" + ", ".join(f"'{t}'" for t in sorted(ALLOWED_TABLES)) + "]"
    table_re = "(?i)(?:FROM|JOIN)" + _WS + "+([a-zA-Z_][a-zA-Z0-9_]*)"
    cte_re = r"(?i)([\p{L}\p{N}_]+)" + _WS + "+AS" + _WS + r"*\("
    return f"""aq AS ({source}),
a1 AS (SELECT query_id, {strip_sql(f"regexp_replace({strip_sql('sql')}, ';+$', '')")} AS s FROM aq),
a2 AS (SELECT *, replace(upper(regexp_extract(s, {q('^([^ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'x0B' + chr(92) + 'f' + chr(92) + 'r]+)')}, 1)), 'ẞ', 'SS') AS first_word,
              regexp_replace(s, '''[^'']*''', '''''', 'g') AS masked FROM a1),
a3 AS (SELECT *,
         list_sort(list_distinct(list_filter(list_transform({word_runs_sql('masked')}, lambda x: upper(x)),
                                              lambda x: list_contains({sql_list(FORBIDDEN_KEYWORDS)}, x)))) AS kw,
         CASE WHEN first_word = 'WITH'
              THEN list_transform(regexp_extract_all(masked, {q(cte_re)}, 1), lambda x: lower(x))
              ELSE CAST([] AS VARCHAR[]) END AS cte_names,
         regexp_extract_all(masked, {q(table_re)}, 1) AS table_refs
       FROM a2),
a4 AS (SELECT *,
         CASE WHEN s = '' THEN [{q(F_.MSG_EMPTY_SQL)}] ELSE list_concat(
           list_filter([CASE WHEN instr(s, ';') > 0 THEN {q(F_.MSG_MULTIPLE_STATEMENTS)} END,
                        CASE WHEN first_word NOT IN ('SELECT', 'WITH') THEN printf({q(F_.MSG_ONLY_SELECT)}, first_word) END,
                        CASE WHEN len(kw) > 0 THEN printf({q(F_.MSG_FORBIDDEN_KEYWORDS)}, array_to_string(kw, ', ')) END],
                       lambda e: e IS NOT NULL),
           list_transform(list_filter(table_refs, lambda t: NOT list_contains({sql_list(ALLOWED_TABLES)}, lower(t))
                                                      AND NOT list_contains(cte_names, lower(t))),
                          lambda t: printf({q(F_.MSG_TABLE_NOT_APPROVED)}, t, {q(allowed_text)})))
         END AS errors,
         CASE WHEN s = '' THEN ''
              WHEN list_contains(list_transform({word_runs_sql('s')}, lambda x: upper(x)), 'LIMIT') THEN s
              ELSE s || chr(10) || 'LIMIT 10000' END AS sanitized_sql
       FROM a3)"""


DOC_SQL_SOURCE = "SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS query_id, text AS sql FROM documents"


def request_sql(text: str) -> str:
    low = f"lower({text})"
    kpi = "'gmv'"
    for k in reversed(KPI_SCAN_ORDER):
        kpi = f"CASE WHEN instr({low}, '{k}') > 0 THEN '{k}' ELSE {kpi} END"
    found = ("list_filter([" + ", ".join(f"CASE WHEN instr({low}, '{d}') > 0 THEN '{d}' END" for d in DIMENSIONS)
             + "], lambda x: x IS NOT NULL)")
    dims = f"CASE WHEN len({found}) > 0 THEN {found} ELSE {sql_list(DEFAULT_DIMENSIONS)} END"
    dates = f"regexp_extract_all({text}, '\\d{{4}}-\\d{{2}}-\\d{{2}}', 0)"
    return kpi, dims, dates


# ---------------------------------------------------------------- decision layer
def _analyses_cte() -> str:
    kpi, _, _ = request_sql("concat_ws(' ', kpi_name, description)")
    plans = [("q_aggregate", f"printf({q(F_.TXT_PURPOSE_AGGREGATE)}, kpi_mention)")]
    plans += [(f"q_by_{d}", f"printf({q(F_.TXT_PURPOSE_BREAKDOWN)}, kpi_mention, '{d}')") for d in ("channel", "region")]
    union = " UNION ALL ".join(f"SELECT case_id, {i + 1} AS seq, '{name}' AS query_id, {purpose} AS purpose FROM cm"
                               for i, (name, purpose) in enumerate(plans))
    return f"""cm AS (SELECT *, {kpi} AS kpi_mention FROM casesd),
analyses AS ({union})"""


def decision_ctes() -> str:
    conc1 = f"""conc1 AS (
  SELECT case_id, dimension, sum(CASE WHEN crank <= 1 THEN abs(contribution_pct) END) > 50.0 AS concentrated
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id, dimension
                                     ORDER BY abs(contribution_pct) DESC, dimension_value ASC) AS crank
        FROM slices) GROUP BY case_id, dimension)"""
    stats = f"""stats AS (
  SELECT case_id, dimension, count(*) AS n_slices,
         {round2('max(CASE WHEN driver_rank = 1 THEN abs(contribution_pct) END)')} > 50.0 AS concentrated
  FROM slices GROUP BY case_id, dimension)"""
    wc = f"""wc AS (
  SELECT case_id, {round2('bl_val')} AS baseline_daily, {round2('an_val')} AS anomaly_daily,
         {round2(pct_change('an_val', 'bl_val'))} AS percent_change
  FROM (SELECT case_id, bl_s, an_s, bl_n, an_n,
          (CAST(coalesce(bl_s, 0) AS DOUBLE) / CAST(100.0 AS DOUBLE)) / baseline_days AS bl_val,
          (CAST(coalesce(an_s, 0) AS DOUBLE) / CAST(100.0 AS DOUBLE)) / anomaly_days AS an_val
        FROM (SELECT c.case_id, c.baseline_days, c.anomaly_days,
                     sum(CASE WHEN c.win = 'baseline' THEN cb.amt_c END) AS bl_s,
                     sum(CASE WHEN c.win = 'baseline' THEN cb.n_total END) AS bl_n,
                     sum(CASE WHEN c.win = 'anomaly' THEN cb.amt_c END) AS an_s,
                     sum(CASE WHEN c.win = 'anomaly' THEN cb.n_total END) AS an_n
              FROM cube cb JOIN cal c ON cb.order_date = c.order_date
              WHERE cb.dimension = '__total__' GROUP BY c.case_id, c.baseline_days, c.anomaly_days)))"""
    rows = """qrows AS (
  SELECT l.case_id, 'q_aggregate' AS query_id, count(DISTINCT l.time_window) AS rows
  FROM cube c JOIN lcal l ON c.order_date = l.order_date WHERE c.dimension = '__total__' GROUP BY l.case_id
  UNION ALL
  SELECT case_id, 'q_by_' || dimension AS query_id, count(*) AS rows FROM (
    SELECT DISTINCT l.case_id, c.dimension, c.slice, l.time_window
    FROM cube c JOIN lcal l ON c.order_date = l.order_date WHERE c.dimension IN ('channel', 'region'))
  GROUP BY case_id, dimension)"""
    runlog = """runlog AS (
  SELECT t.*, TRUE AS success, CAST(coalesce(r.rows, 0) AS BIGINT) AS row_count
  FROM analyses t LEFT JOIN qrows r ON r.case_id = t.case_id AND r.query_id = t.query_id)"""
    dims = "[" + ", ".join(f"'{d}'" for d in DIMENSIONS) + "]"
    ev = f"""ev1 AS (
  SELECT case_id, CAST(seq AS BIGINT) AS seq, 'sql_' || query_id AS evidence_id, 'sql_result' AS source_type,
         query_id AS source_ref, printf({q(F_.TXT_SQL_EVIDENCE)}, purpose, row_count) AS description,
         TRUE AS supports_conclusion, 'medium' AS strength FROM runlog WHERE success
  UNION ALL
  SELECT s.case_id, CAST(10 + 2 * list_position({dims}, s.dimension) AS BIGINT), 'analysis_' || s.dimension,
         'analysis', 'contribution_' || s.dimension,
         printf({q(F_.TXT_ANALYSIS_EVIDENCE)},
                s.dimension, s.dimension_value, {fmt_fixed('s.contribution_pct', 1)},
                {fmt_fixed('s.percent_change', 1, True)},
                CASE WHEN k.concentrated THEN 'True' ELSE 'False' END),
         TRUE, CASE WHEN k.concentrated THEN 'high' ELSE 'medium' END
  FROM slices s JOIN conc1 k ON s.case_id = k.case_id AND s.dimension = k.dimension WHERE s.driver_rank = 1
  UNION ALL
  SELECT case_id, CAST(11 + 2 * list_position({dims}, dimension) AS BIGINT),
         'caveat_' || dimension || '_sample_size', 'analysis', 'sample_check_' || dimension,
         printf({q(F_.TXT_SAMPLE_WARNING)}, string_agg(
            printf({q(F_.TXT_SMALL_SAMPLE)}, dimension_value, sample_size_baseline,
                   sample_size_anomaly), '; ' ORDER BY driver_rank)),
         FALSE, 'low'
  FROM slices WHERE sample_size_anomaly < 30 OR sample_size_baseline < 30 GROUP BY case_id, dimension
  UNION ALL
  SELECT c.case_id, CAST(100 AS BIGINT), 'baseline_comparison_order_total', 'analysis', 'baseline_comparison',
         'Aggregate order_total: baseline_daily=' || {fmt_short('coalesce(w.baseline_daily, 0.0)')} ||
         ', anomaly_daily=' || {fmt_short('coalesce(w.anomaly_daily, 0.0)')} ||
         ', change=' || {fmt_fixed('coalesce(w.percent_change, 0.0)', 1, True)} || '%',
         TRUE, 'high'
  FROM casesd c LEFT JOIN wc w ON c.case_id = w.case_id)"""
    counts = """counts0 AS (
  SELECT c.case_id, c.kpi_name,
    coalesce(rl.n_sql, 0) AS n_sql, coalesce(rl.n_sql_ok, 0) AS n_sql_ok,
    coalesce(st.n_analyses, 0) AS n_analyses, coalesce(st.any_conc, 0) = 1 AS any_concentrated,
    coalesce(e.n_support1, 0) AS n_support1, coalesce(e.n_warn1, 0) AS n_warn1,
    CAST(0.0 AS DOUBLE) AS elapsed_seconds
  FROM casesd c
  LEFT JOIN (SELECT case_id, count(*) AS n_sql, count_if(success) AS n_sql_ok FROM runlog GROUP BY case_id) rl
    ON c.case_id = rl.case_id
  LEFT JOIN (SELECT case_id, count(*) AS n_analyses, max(CAST(concentrated AS INTEGER)) AS any_conc
             FROM stats GROUP BY case_id) st ON c.case_id = st.case_id
  LEFT JOIN (SELECT case_id, count_if(supports_conclusion) AS n_support1,
                    count_if(contains(lower(description), 'sample size')) AS n_warn1
             FROM ev1 GROUP BY case_id) e ON c.case_id = e.case_id),
counts AS (
  SELECT *, CAST(CASE
      WHEN n_sql_ok > 0 AND n_analyses > 0 AND any_concentrated AND n_warn1 = 0 AND n_support1 * 1 >= 2 THEN 1
      WHEN n_sql_ok > 0 AND n_analyses > 0 AND any_concentrated AND n_warn1 = 0 AND n_support1 * 2 >= 2 THEN 2
      ELSE 3 END AS BIGINT) AS passes
  FROM counts0)"""
    evidence = """evidence AS (
  SELECT e.*, CAST(p AS BIGINT) AS pass_no
  FROM ev1 e JOIN counts c ON e.case_id = c.case_id, unnest(range(1, c.passes + 1)) AS u(p))"""
    checks = f"""checks AS (
  SELECT case_id, CAST(1 AS BIGINT) AS check_no, 'sql_evidence_exists' AS check_name, n_sql_ok > 0 AS passed,
         printf({q(F_.TXT_CHECK_SQL)}, n_sql_ok, n_sql) AS detail FROM counts
  UNION ALL SELECT case_id, 2, 'analysis_results_exist', n_analyses > 0,
         printf({q(F_.TXT_CHECK_ANALYSES)}, n_analyses) FROM counts
  UNION ALL SELECT case_id, 3, 'supporting_evidence', n_support1 * passes >= 2,
         printf({q(F_.TXT_CHECK_SUPPORT)}, n_support1 * passes) FROM counts
  UNION ALL SELECT case_id, 4, 'concentrated_driver_found', any_concentrated,
         CASE WHEN any_concentrated THEN {q(F_.TXT_CHECK_CONCENTRATED)}
              ELSE {q(F_.TXT_CHECK_DIFFUSE)} END FROM counts
  UNION ALL SELECT case_id, 5, 'sample_size_adequate', n_warn1 * passes = 0,
         CASE WHEN n_warn1 * passes > 0 THEN printf({q(F_.TXT_CHECK_WARNINGS)}, n_warn1 * passes)
              ELSE {q(F_.TXT_CHECK_SAMPLES_OK)} END FROM counts)"""
    verdict = """verdict0 AS (
  SELECT c.*, p.checks_passed, p.checks_total,
    CASE WHEN p.checks_passed >= 4 THEN 'high' WHEN p.checks_passed >= 3 THEN 'medium'
         WHEN p.checks_passed >= 2 THEN 'low' ELSE 'inconclusive' END AS confidence,
    CAST((c.n_sql - c.n_sql_ok) * c.passes AS BIGINT) AS sql_failure_count
  FROM counts c JOIN (SELECT case_id, count_if(passed) AS checks_passed, count(*) AS checks_total
                      FROM checks GROUP BY case_id) p ON c.case_id = p.case_id),
verdict AS (
  SELECT *, checks_passed = checks_total AS overall_supported,
    list_filter([CASE WHEN confidence IN ('low', 'inconclusive') THEN 'low_confidence' END,
                 CASE WHEN sql_failure_count >= 2 THEN 'sql_validation_failure' END,
                 CASE WHEN elapsed_seconds > 120.0 THEN 'cost_exceeded' END,
                 CASE WHEN checks_passed < checks_total THEN 'weak_evidence' END],
                lambda r: r IS NOT NULL) AS review_reasons
  FROM verdict0),
verdict2 AS (
  SELECT *, len(review_reasons) > 0 AS needs_review,
         CASE WHEN len(review_reasons) > 0 THEN 'approved' ELSE 'not_required' END AS review_status
  FROM verdict)"""
    best = f"""best AS (
  SELECT * FROM (
    SELECT case_id, dimension, dimension_value, percent_change, contribution_pct,
           row_number() OVER (PARTITION BY case_id ORDER BY abs(contribution_pct) DESC,
                              list_position({dims}, dimension) ASC) AS r
    FROM slices WHERE driver_rank = 1 AND contribution_pct <> 0) WHERE r = 1)"""
    found = f"""found AS (
  SELECT v.*, b.dimension, b.dimension_value, b.percent_change, b.contribution_pct,
    CASE WHEN b.dimension IS NOT NULL THEN printf(
      {q(F_.TXT_FINDING)},
      v.kpi_name, b.dimension_value, b.dimension, {fmt_fixed('b.percent_change', 1, True)},
      {fmt_fixed('b.contribution_pct', 1)}) END AS primary_finding,
    CASE WHEN b.dimension IS NOT NULL THEN printf(
      {q(F_.TXT_CONCLUSION)},
      v.kpi_name, b.dimension_value, b.dimension, {fmt_fixed('b.contribution_pct', 1)}, v.confidence)
    ELSE printf({q(F_.TXT_CONCLUSION_DIFFUSE)}, v.kpi_name)
    END AS conclusion,
    CASE WHEN b.dimension IS NOT NULL THEN coalesce(e.ids, []) END AS finding_evidence_ids,
    CASE WHEN b.dimension IS NOT NULL THEN
      CASE WHEN v.n_warn1 > 0 THEN [{q(CAVEAT_CORRELATION_)}, {q(CAVEAT_SMALL_SAMPLE_)}]
           ELSE [{q(CAVEAT_CORRELATION_)}] END END AS finding_caveats
  FROM verdict2 v LEFT JOIN best b ON v.case_id = b.case_id
  LEFT JOIN (SELECT case_id, list(evidence_id ORDER BY pass_no, seq)[1:5] AS ids
             FROM evidence WHERE supports_conclusion GROUP BY case_id) e ON v.case_id = e.case_id)"""
    return ",\n".join([_analyses_cte(), rows, runlog, conc1, stats, wc,
                       ev, counts, evidence, checks, verdict, best, found])


from kpiscope.functions.fixed import CAVEAT_CORRELATION as CAVEAT_CORRELATION_  # noqa: E402
from kpiscope.functions.fixed import CAVEAT_SMALL_SAMPLE as CAVEAT_SMALL_SAMPLE_  # noqa: E402


def decision_base() -> str:
    return with_(STAR, cases_cte(), CALENDAR, cube_cte(), LABEL_CAL, slices_cte(), decision_ctes())


# ---------------------------------------------------------------- BM25
_HWS = r"[ \t\x0B\f\r]"


def chunks_cte(source_sql: str) -> str:
    """source_sql yields (source, value); sections split line by line."""
    strip = lambda x: regexp_strip(x)
    return f"""src AS ({source_sql}),
lines AS (
  SELECT source, i AS line_no, parts[i] AS line,
         regexp_matches(parts[i], {q('^#{1,3}' + _HWS + '+[^' + chr(10) + ']')}) AS is_head
  FROM (SELECT source, string_split(value, chr(10)) AS parts FROM src) t,
       unnest(range(1, len(parts) + 1)) AS u(i)),
lines2 AS (
  SELECT *, sum(CAST(is_head AS INTEGER)) OVER (PARTITION BY source ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            - max(CASE WHEN line_no = 1 AND is_head THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS section_no
  FROM lines),
chunks AS (
  SELECT source, CAST(section_no AS BIGINT) AS section_no,
         coalesce(max(CASE WHEN is_head THEN {strip(f"regexp_extract(line, {q('^#{1,3}' + _HWS + '+(.+)')}, 1)")} END), 'overview') AS section,
         {strip("string_agg(line, chr(10) ORDER BY line_no)")} AS content
  FROM lines2 GROUP BY source, section_no
  HAVING {strip("string_agg(line, chr(10) ORDER BY line_no)")} <> '')"""


def regexp_strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'x0B' + chr(92) + 'f' + chr(92) + 'r]+|[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'x0B' + chr(92) + 'f' + chr(92) + 'r]+$')}, '', 'g')"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9_]+'), lambda t: length(t) > 1)"


BM25_CORE = """toks AS (SELECT source, section_no, {tok} AS tk FROM chunks),
lens AS (SELECT source, section_no, CAST(len(tk) AS BIGINT) AS dl FROM toks),
tf AS (SELECT source, section_no, term, count(*) AS tf
       FROM (SELECT source, section_no, unnest(tk) AS term FROM toks) GROUP BY source, section_no, term),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM lens),
rawidf AS (SELECT term, count(*) AS df,
                  ln((SELECT CAST(n_docs AS DOUBLE) FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf
           FROM tf GROUP BY term),
eps AS (SELECT {eps} * avg(raw_idf) AS eps FROM rawidf),
idf AS (SELECT term, df, CASE WHEN raw_idf < 0 THEN (SELECT eps FROM eps) ELSE raw_idf END AS idf FROM rawidf),
qterms AS (SELECT query_id, term, count(*) AS qtf
           FROM (SELECT query_id, unnest({qtok}) AS term FROM queries) GROUP BY query_id, term),
impacts AS (
  SELECT tf.source, tf.section_no, tf.term,
         CAST(round(i.idf * (CAST(tf.tf AS DOUBLE) * ({k1} + 1.0) /
             (CAST(tf.tf AS DOUBLE) + {k1} * (1.0 - {b} + {b} * l.dl / (SELECT avgdl FROM corpus))))
             * CAST(1e9 AS DOUBLE)) AS BIGINT) AS impact
  FROM tf JOIN idf i ON tf.term = i.term JOIN lens l ON tf.source = l.source AND tf.section_no = l.section_no),
scores AS (
  SELECT qt.query_id, im.source, im.section_no,
         CAST(sum(qt.qtf * im.impact) AS DOUBLE) / CAST(1e9 AS DOUBLE) AS score
  FROM impacts im JOIN qterms qt ON im.term = qt.term
  GROUP BY qt.query_id, im.source, im.section_no),
topk AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, section_no) AS rk
                 FROM scores) WHERE rk <= {k} AND score > 0)"""


def bm25_sql(queries_sql: str, k: int = 5) -> str:
    from kpiscope.functions.fixed import BM25_B, BM25_EPSILON, BM25_K1
    core = BM25_CORE.format(tok=tokens_sql("content"), qtok=tokens_sql("text"), eps=f"CAST({BM25_EPSILON} AS DOUBLE)",
                            k1=f"CAST({BM25_K1} AS DOUBLE)", b=f"CAST({BM25_B} AS DOUBLE)", k=k)
    return (with_(chunks_cte("SELECT doc_id AS source, text AS value FROM documents"),
                  f"queries AS ({queries_sql})", core))


# ---------------------------------------------------------------- evaluation
from kpiscope.functions.fixed import STOP_WORDS, SUFFIXES  # noqa: E402

SUFFIX_RE = "^(.{3,}?)(" + "|".join(SUFFIXES) + ")$"


def cause_tokens_sql(x: str) -> str:
    words = f"list_distinct(regexp_extract_all(regexp_replace(lower({x}), '[_-]', ' ', 'g'), '[a-z]+'))"
    kept = f"list_filter({words}, lambda w: length(w) > 2 AND NOT list_contains({sql_list(STOP_WORDS)}, w))"
    stemmed = f"list_transform({kept}, lambda w: regexp_replace(w, {q(SUFFIX_RE)}, '\\1'))"
    return f"list_sort(list_distinct({stemmed}))"


def cause_hit_sql(pred: str, exp: str) -> str:
    e, p = cause_tokens_sql(exp), cause_tokens_sql(pred)
    return (f"coalesce(CASE WHEN len({e}) > 0 THEN CAST(len(list_intersect({p}, {e})) AS DOUBLE) "
            f"/ CAST(len({e}) AS DOUBLE) END >= 0.25, FALSE)")


GRADES = f"""grades AS (
  SELECT f.case_id,
    (f.primary_finding IS NOT NULL AND {cause_hit_sql('f.primary_finding', 'c.expected_primary_cause')})
      OR {cause_hit_sql("coalesce(f.conclusion, '')", 'c.expected_primary_cause')} AS primary_cause_hit,
    CASE WHEN f.n_sql > 0 THEN CAST(f.n_sql_ok AS DOUBLE) / CAST(f.n_sql AS DOUBLE) ELSE 0.0 END AS sql_success_rate,
    f.n_support1 * f.passes >= 2 AS evidence_sufficient,
    CAST(0 AS BIGINT) AS unsupported_claim_count,
    f.review_status <> 'not_required' AS human_review_triggered,
    f.elapsed_seconds AS runtime_seconds,
    substring(CASE WHEN f.primary_finding IS NOT NULL THEN f.primary_finding
                   WHEN {cause_hit_sql("coalesce(f.conclusion, '')", 'c.expected_primary_cause')} THEN substring(f.conclusion, 1, 200)
                   ELSE '' END, 1, 500) AS predicted_primary_cause,
    CASE WHEN f.primary_finding IS NOT NULL THEN f.primary_finding
         WHEN {cause_hit_sql("coalesce(f.conclusion, '')", 'c.expected_primary_cause')} THEN f.conclusion ELSE '' END AS predicted_cause_full,
    f.confidence
  FROM found f JOIN casesd c ON f.case_id = c.case_id)"""
