"""Registered jobs: key -> (spark, sf_dir) -> DataFrame, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiscope import oracle as O
from kpiscope.functions.fixed import TXT_CONCENTRATION, TXT_NO_CHANGE, TXT_SMALL_SAMPLE
from kpiscope.operators import compare as C
from kpiscope.operators.windows import with_baseline
from kpiscope.plans import base as B

QUERIES: dict = {}
ORACLE: dict = {}


def register(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


_SLICE_OUT = ["case_id", "kpi_name", "dimension", "dimension_value", "baseline_daily",
              "anomaly_daily", "absolute_change", "percent_change", "sample_size_baseline",
              "sample_size_anomaly", "contribution_pct", "driver_rank"]


def _slice_out(df):
    return df.select(*_SLICE_OUT[:-1], F.col("driver_rank").cast("bigint").alias("driver_rank"))


# ----------------------------------------------------------------- S1 scan
@register("scan_orders_canonical", O.with_(O.STAR) + "SELECT * FROM canon")
def scan_orders_canonical(spark, sf):
    return B.fact(spark, sf)


# ----------------------------------------------------------------- V0
@register("default_baseline", O.with_(O.STAR, O.cases_cte(), O.CALENDAR, O.cube_cte()) + """SELECT c.case_id,
  c.kpi_name, c.affected_start_date, c.affected_end_date, c.baseline_start, c.baseline_end,
  CAST(c.baseline_days AS BIGINT) AS baseline_days, CAST(c.anomaly_days AS BIGINT) AS anomaly_days,
  CAST(coalesce(w.bl, 0) AS BIGINT) AS baseline_orders, CAST(coalesce(w.an, 0) AS BIGINT) AS anomaly_orders
FROM casesd c LEFT JOIN (
  SELECT k.case_id, sum(CASE WHEN k.win = 'baseline' THEN cb.n_rows END) AS bl,
         sum(CASE WHEN k.win = 'anomaly' THEN cb.n_rows END) AS an
  FROM cube cb JOIN cal k ON cb.order_date = k.order_date WHERE cb.dimension = '__total__'
  GROUP BY k.case_id) w ON c.case_id = w.case_id""")
def default_baseline(spark, sf):
    """V0: filled-in baseline windows, with the orders each window holds."""
    from kpiscope.operators.windows import join_calendar, window_calendar
    cases = B.incidents(spark)
    c = with_baseline(cases)
    cube = B.cube(spark, sf).where(F.col("dimension") == C.TOTAL)
    j = join_calendar(cube, window_calendar(cases), cases)
    w = j.groupBy("case_id").agg(
        F.sum(F.when(F.col("window") == "baseline", F.col("n_rows"))).alias("bl"),
        F.sum(F.when(F.col("window") == "anomaly", F.col("n_rows"))).alias("an"))
    return c.join(w, "case_id", "left").select(
        "case_id", "kpi_name", "affected_start_date", "affected_end_date", "baseline_start", "baseline_end",
        F.col("baseline_days").cast("bigint").alias("baseline_days"),
        F.col("anomaly_days").cast("bigint").alias("anomaly_days"),
        F.coalesce("bl", F.lit(0)).cast("bigint").alias("baseline_orders"),
        F.coalesce("an", F.lit(0)).cast("bigint").alias("anomaly_orders"))


# ----------------------------------------------------------------- A11 / W1 / W2
for _agg in ("sum", "mean", "count"):
    def _mk(agg):
        def q(spark, sf):
            return _slice_out(B.slices(spark, sf, "order_total", agg))
        return q
    register(f"slice_compare_{_agg}",
             O.slice_base("order_total", _agg) + f"SELECT {O.SLICE_COLS} FROM slices")(_mk(_agg))


@register("contribution_multi_dim", O.slice_base() + f"SELECT {O.SLICE_COLS} FROM slices")
def contribution_multi_dim(spark, sf):
    """Each incident's KPI (raw mode) over all six dimensions."""
    return _slice_out(B.slices(spark, sf))


@register("kpi_by_dim_governed", O.slice_base(mode="governed") + f"SELECT {O.SLICE_COLS} FROM slices")
def kpi_by_dim_governed(spark, sf):
    """A10: the same contribution job with governed KPI definitions."""
    return _slice_out(B.slices(spark, sf, mode="governed"))


_STATS_SQL = O.slice_base() + f"""SELECT case_id, dimension,
  CAST(sum(chg_c) AS DOUBLE) / CAST(100.0 AS DOUBLE) AS total_change,
  count(*) AS n_slices,
  {O.round2('max(CASE WHEN driver_rank = 1 THEN abs(contribution_pct) END)')} AS top_1_contribution_pct,
  {O.round2('max(CASE WHEN driver_rank = 1 THEN abs(contribution_pct) END)')} > 50.0 AS concentrated
FROM slices GROUP BY case_id, dimension"""


@register("contribution_stats", _STATS_SQL)
def contribution_stats(spark, sf):
    return C.contribution_stats(B.slices(spark, sf))


@register("driver_rank", O.slice_base() +
          "SELECT case_id, dimension, dimension_value, absolute_change, driver_rank "
          "FROM slices")
def driver_rank(spark, sf):
    """Every slice of each (incident, dimension) with its rank."""
    s = B.slices(spark, sf)
    return (s.select("case_id", "dimension", "dimension_value", "absolute_change",
                     F.col("driver_rank").cast("bigint").alias("driver_rank")))


_DIMS_ARRAY = "[" + ", ".join(f"'{d}'" for d in O.DIMENSIONS) + "]"
_BEST_SQL = O.slice_base() + f"""SELECT case_id, dimension, dimension_value, percent_change,
  contribution_pct, baseline_daily, anomaly_daily, absolute_change FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY abs(contribution_pct) DESC,
                               list_position({_DIMS_ARRAY}, dimension) ASC) AS r
  FROM slices WHERE driver_rank = 1 AND contribution_pct <> 0) WHERE r = 1"""


@register("best_driver", _BEST_SQL)
def best_driver(spark, sf):
    return C.best_driver(B.slices(spark, sf))


def _conc_sql(n: int) -> str:
    return O.slice_base() + f"""SELECT case_id, dimension, CAST({n} AS BIGINT) AS top_n,
  {O.round2('top_sum')} AS top_n_contribution_pct, total_slices, top_sum > 50.0 AS concentrated,
  top_slices,
  CASE WHEN top_sum > 0 THEN printf({O.q(TXT_CONCENTRATION)}, {n}, {O.fmt_fixed('top_sum', 1)})
       ELSE {O.q(TXT_NO_CHANGE)} END AS detail
FROM (
  SELECT case_id, dimension,
         sum(CASE WHEN crank <= {n} THEN abs(contribution_pct) END) AS top_sum,
         count(*) AS total_slices,
         coalesce(string_agg(CASE WHEN crank <= {n} THEN dimension_value END, '; ' ORDER BY crank), '') AS top_slices
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id, dimension
                                     ORDER BY abs(contribution_pct) DESC, dimension_value ASC) AS crank
        FROM slices)
  GROUP BY case_id, dimension)"""


@register("concentration_top1", _conc_sql(1))
def concentration_top1(spark, sf):
    return _conc(spark, sf, 1)


@register("concentration_topn", _conc_sql(3))
def concentration_topn(spark, sf):
    return _conc(spark, sf, 3)


def _conc(spark, sf, n):
    c = C.concentration(B.slices(spark, sf), n)
    return c.withColumn("top_n", F.col("top_n").cast("bigint"))


@register("small_sample_flags", O.slice_base() + f"""SELECT case_id, dimension, dimension_value,
  driver_rank, sample_size_baseline, sample_size_anomaly,
  printf({O.q(TXT_SMALL_SAMPLE)}, dimension_value, sample_size_baseline, sample_size_anomaly) AS flag
FROM slices WHERE sample_size_anomaly < 30 OR sample_size_baseline < 30""")
def small_sample_flags(spark, sf):
    f = C.small_sample_flags(B.slices(spark, sf))
    return f.withColumn("driver_rank", F.col("driver_rank").cast("bigint"))


# ----------------------------------------------------------------- A7
def _wc_sql(agg, metric="order_total"):
    return O.with_(O.STAR, O.cases_cte(), O.CALENDAR, O.cube_cte(),
                   O.window_sums_cte(metric, agg, total=True)) + f"""SELECT case_id,
  'order_total' AS metric, CAST(baseline_days AS BIGINT) AS baseline_days,
  CAST(anomaly_days AS BIGINT) AS anomaly_days,
  {O.round2('bl_val')} AS baseline_daily, {O.round2('an_val')} AS anomaly_daily,
  {O.round2('an_val - bl_val')} AS absolute_change,
  {O.round2(O.pct_change('an_val', 'bl_val'))} AS percent_change
FROM vals"""


for _agg in ("sum", "mean", "count"):
    def _mkw(agg):
        def q(spark, sf):
            w = C.window_compare(B.cube(spark, sf), B.incidents(spark), "order_total", agg)
            return (w.withColumn("baseline_days", F.col("baseline_days").cast("bigint"))
                     .withColumn("anomaly_days", F.col("anomaly_days").cast("bigint")))
        return q
    register(f"window_compare_{_agg}", _wc_sql(_agg))(_mkw(_agg))


def _wc_metric_sql(metric, agg):
    return _wc_sql(agg, metric).replace("'order_total' AS metric", f"'{metric}' AS metric")


_METRICS = ["order_total", "is_refunded", "is_cancelled", "paid_total"]


@register("window_compare_metrics", "\nUNION ALL\n".join(f"SELECT * FROM ({_wc_metric_sql(m, 'sum')})" for m in _METRICS))
def window_compare_metrics(spark, sf):
    """A7 for a list of metrics in one pass over the cube."""
    w = C.window_compare(B.cube(spark, sf), B.incidents(spark), _METRICS, "sum")
    return (w.withColumn("baseline_days", F.col("baseline_days").cast("bigint"))
             .withColumn("anomaly_days", F.col("anomaly_days").cast("bigint")))


# ----------------------------------------------------------------- views J1, A1-A6
from kpiscope.operators import rollups as RU  # noqa: E402
from kpiscope.operators import views as V  # noqa: E402
from kpiscope.sources import binding as SB  # noqa: E402


_VIEW_SQL = {
    "daily_kpi_summary": ("order_date", ["total_orders", "paid_orders", "gmv", "aov", "refund_rate",
                                         "cancellation_rate", "new_customer_ratio", "revenue"]),
    "channel_performance": ("order_date, channel", ["total_orders", "paid_orders", "gmv", "aov",
                                                    "refund_rate", "new_customer_ratio"]),
    "category_performance": ("order_date, category", ["total_orders", "paid_orders", "gmv", "aov",
                                                      "refund_rate", "cancellation_rate"]),
    "region_performance": ("order_date, region", ["total_orders", "paid_orders", "gmv", "aov",
                                                  "refund_rate"]),
    "customer_segment_performance": ("order_date, customer_type, channel",
                                     ["total_orders", "paid_orders", "gmv", "aov"]),
}

for _name, (_keys, _cols) in _VIEW_SQL.items():
    def _mkv(name):
        def q(spark, sf):
            return V.VIEW_BUILDERS[name]({"orders": B.fact(spark, sf, *V.VIEW_COLUMNS[name])})
        return q
    register(_name, O.with_(O.STAR) + f"SELECT {_keys}, {O.kpi_sql(_cols)} FROM canon GROUP BY {_keys}")(
        _mkv(_name))


@register("fact_orders_enriched", O.with_(O.FULL_STAR, O.ENRICHED) + "SELECT * FROM enriched")
def fact_orders_enriched(spark, sf):
    """One line roll-up joined once (refunds / payments are 1:1 per order here)."""
    return SB.enriched_orders(spark, sf)


@register("fact_orders_enriched_salted", O.with_(O.FULL_STAR, O.ENRICHED) + "SELECT * FROM enriched")
def fact_orders_enriched_salted(spark, sf):
    """J1 with the customer side joined on measured heavy keys, as it runs where Spark does not split skew itself."""
    return SB.enriched_orders(spark, sf, salted=True)


@register("fact_orders_enriched_bucketed", O.with_(O.FULL_STAR, O.ENRICHED) + "SELECT * FROM enriched")
def fact_orders_enriched_bucketed(spark, sf):
    """J1 over orders and lineitem laid out in buckets by order key: their join has no exchange."""
    from kpiscope.sources.bucketed import lay_out
    return SB.enriched_orders(spark, lay_out(spark, sf, int(spark.conf.get("spark.sql.shuffle.partitions"))))


@register("refund_summary", O.with_(O.FULL_STAR) + f"""SELECT r.refund_date, o.category, o.region, o.channel,
  r.reason AS refund_reason, count(*) AS refund_count,
  {O.money(f"sum({O.cents('r.refund_amount')})")} AS total_refund_amount,
  {O.money(f"sum({O.cents('r.refund_amount')})")} / CAST(count(*) AS DOUBLE) AS avg_refund_amount
FROM refunds r JOIN canon o ON r.order_id = o.order_id
GROUP BY r.refund_date, o.category, o.region, o.channel, r.reason""")
def refund_summary(spark, sf):
    """A6 (with J2) from the single-pass enriched fact."""
    return V.refund_summary_from_enriched(SB.enriched_orders(spark, sf))


@register("fact_orders_enriched_fanout", O.with_(O.STAR, O.LINE_LEVEL, O.ENRICHED) + "SELECT * FROM enriched")
def fact_orders_enriched_fanout(spark, sf):
    """J1 as two joins over several refunds and payments per order: each pair of them is a row."""
    return V.fact_orders_enriched(B.fact(spark, sf), SB.line_refunds(spark, sf), SB.line_payments(spark, sf))


@register("refund_summary_fanout", O.with_(O.STAR, O.LINE_LEVEL) + f"""SELECT r.refund_date, o.category, o.region, o.channel,
  r.reason AS refund_reason, count(*) AS refund_count,
  {O.money(f"sum({O.cents('r.refund_amount')})")} AS total_refund_amount,
  {O.money(f"sum({O.cents('r.refund_amount')})")} / CAST(count(*) AS DOUBLE) AS avg_refund_amount
FROM refunds r JOIN canon o ON r.order_id = o.order_id
GROUP BY r.refund_date, o.category, o.region, o.channel, r.reason""")
def refund_summary_fanout(spark, sf):
    """A6 with J2 as a join over several refunds per order."""
    return V.refund_summary(SB.line_refunds(spark, sf), B.fact(spark, sf, "order_id", "category", "region", "channel"))


@register("paid_orders", O.with_(O.STAR) +
          f"SELECT order_id, order_date, order_total, order_status FROM canon WHERE {O.PAID_SQL}")
def paid_orders(spark, sf):
    """paid = not cancelled and not pending."""
    return (B.fact(spark, sf, "order_id", "order_date", "order_total", "order_status", "is_cancelled", "is_pending")
             .where(V.paid_predicate())
             .select("order_id", "order_date", "order_total", "order_status"))


@register("order_status_derive", O.with_(O.STAR) +
          "SELECT order_status, is_cancelled, is_pending, is_refunded, count(*) AS n_orders "
          "FROM canon GROUP BY ALL")
def order_status_derive(spark, sf):
    """P5: status precedence cancelled > pending > refunded > completed."""
    return (B.fact(spark, sf, "order_status", "is_cancelled", "is_pending", "is_refunded")
             .groupBy("order_status", "is_cancelled", "is_pending", "is_refunded")
             .agg(F.count(F.lit(1)).alias("n_orders")))


@register("customer_type_derive", O.with_(O.STAR) +
          "SELECT customer_type, count(*) AS n_orders, count(DISTINCT customer_id) AS n_customers "
          "FROM canon GROUP BY customer_type")
def customer_type_derive(spark, sf):
    """A customer's first order (by date, then id) is 'new'."""
    return (B.fact(spark, sf, "customer_type", "customer_id").groupBy("customer_type")
             .agg(F.count(F.lit(1)).alias("n_orders"),
                  F.countDistinct("customer_id").alias("n_customers")))


@register("campaign_attribution", O.with_(O.STAR) +
          "SELECT campaign, min(order_date) AS first_day, max(order_date) AS last_day, "
          "count(*) AS n_orders FROM canon GROUP BY campaign")
def campaign_attribution(spark, sf):
    """Campaign by purchase date."""
    return (B.fact(spark, sf, "campaign", "order_date").groupBy("campaign")
             .agg(F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day"),
                  F.count(F.lit(1)).alias("n_orders")))


# ----------------------------------------------------------------- A8 / A9
_CAL_BASE = O.with_(O.STAR, O.cases_cte(), O.cube_cte(), O.LABEL_CAL)


@register("agg_by_time_window", _CAL_BASE + f"""SELECT l.case_id, l.time_window, {O.WINDOW_AGGS}
FROM cube c JOIN lcal l ON c.order_date = l.order_date WHERE c.dimension = '__total__'
GROUP BY l.case_id, l.time_window""")
def agg_by_time_window(spark, sf):
    return RU.agg_by_time_window(B.cube(spark, sf), B.incidents(spark))


@register("agg_by_dim_window", _CAL_BASE + f"""SELECT *, row_number() OVER (PARTITION BY case_id, dimension
  ORDER BY gmv DESC NULLS LAST, slice, time_window) AS gmv_rank FROM (
  SELECT l.case_id, c.dimension, c.slice, l.time_window, {O.WINDOW_AGGS}
  FROM cube c JOIN lcal l ON c.order_date = l.order_date WHERE c.dimension IN ('channel', 'region')
  GROUP BY l.case_id, c.dimension, c.slice, l.time_window)""")
def agg_by_dim_window(spark, sf):
    return RU.agg_by_dim_window(B.cube(spark, sf), B.incidents(spark))


# ----------------------------------------------------------------- A13-A17
@register("daily_series", O.with_(O.STAR) +
          f"SELECT order_date, {O.money('sum(' + O.cents('order_total') + ')')} AS value FROM canon GROUP BY order_date")
def daily_series(spark, sf):
    return RU.daily_series(B.fact(spark, sf, "order_date", "order_total"))


@register("daily_series_by_group", O.with_(O.STAR) +
          "SELECT channel AS series, order_date, order_total AS value FROM canon")
def daily_series_by_group(spark, sf):
    return RU.daily_series_by_group(B.fact(spark, sf, "channel", "order_date", "order_total"))


@register("order_rollup", O.with_(O.FULL_STAR) + f"""SELECT order_id,
  {O.money('sum(CAST(round(quantity * unit_price * CAST(100.0 AS DOUBLE)) AS BIGINT))')} AS order_total,
  count(*) AS n_items FROM order_items GROUP BY order_id""")
def order_rollup(spark, sf):
    return RU.order_rollup(SB.order_items(spark, sf))


def _period_sql(unit):
    return O.with_(O.STAR) + f"""SELECT CAST(date_trunc('{unit}', order_date) AS DATE) AS period,
  {O.money('sum(' + O.cents('order_total') + ')')} AS gmv, count(*) AS paid_orders,
  {O.money('sum(' + O.cents('order_total') + ')')} / CAST(count(*) AS DOUBLE) AS aov
FROM canon WHERE {O.PAID_SQL} GROUP BY 1"""


@register("gmv_weekly", _period_sql("week"))
def gmv_weekly(spark, sf):
    return RU.gmv_by_period(B.fact(spark, sf, "order_date", "order_total", "is_cancelled", "is_pending"), "week")


@register("gmv_monthly", _period_sql("month"))
def gmv_monthly(spark, sf):
    return RU.gmv_by_period(B.fact(spark, sf, "order_date", "order_total", "is_cancelled", "is_pending"), "month")


@register("net_revenue_monthly", O.with_(O.FULL_STAR) + f"""SELECT coalesce(g.period, r.period) AS period,
  {O.money('coalesce(g.gmv_c, 0)')} AS gmv, {O.money('coalesce(r.ref_c, 0)')} AS refunds,
  {O.money('coalesce(g.gmv_c, 0) - coalesce(r.ref_c, 0)')} AS net_revenue
FROM (SELECT CAST(date_trunc('month', order_date) AS DATE) AS period, sum({O.cents('order_total')}) AS gmv_c
      FROM canon WHERE {O.PAID_SQL} GROUP BY 1) g
FULL OUTER JOIN (SELECT CAST(date_trunc('month', refund_date) AS DATE) AS period,
      sum({O.cents('refund_amount')}) AS ref_c FROM refunds GROUP BY 1) r ON g.period = r.period""")
def net_revenue_monthly(spark, sf):
    return RU.net_revenue_monthly(B.fact(spark, sf, "order_date", "order_total", "is_cancelled", "is_pending"), SB.refunds(spark, sf))


@register("aov_median", O.with_(O.STAR) + f"""SELECT period, paid_orders,
  v_lo + (v_hi - v_lo) * frac AS median_aov FROM (
  SELECT period, max(n) AS paid_orders,
    max(CASE WHEN pos_lo >= 0 AND rn = pos_lo THEN order_total END) AS v_lo,
    max(CASE WHEN rn = pos_hi THEN order_total END) AS v_hi,
    max(frac) AS frac
  FROM (SELECT CAST(date_trunc('month', order_date) AS DATE) AS period, order_total,
           row_number() OVER (PARTITION BY date_trunc('month', order_date) ORDER BY order_total) - 1 AS rn,
           count(*) OVER (PARTITION BY date_trunc('month', order_date)) AS n,
           floor(CAST(count(*) OVER (PARTITION BY date_trunc('month', order_date)) - 1 AS DOUBLE) * 0.5) AS pos_lo,
           ceil(CAST(count(*) OVER (PARTITION BY date_trunc('month', order_date)) - 1 AS DOUBLE) * 0.5) AS pos_hi,
           CAST(count(*) OVER (PARTITION BY date_trunc('month', order_date)) - 1 AS DOUBLE) * 0.5
             - floor(CAST(count(*) OVER (PARTITION BY date_trunc('month', order_date)) - 1 AS DOUBLE) * 0.5) AS frac
        FROM canon WHERE {O.PAID_SQL} AND order_total IS NOT NULL)
  GROUP BY period)""")
def aov_median(spark, sf):
    return RU.aov_median(B.fact(spark, sf, "order_date", "order_total", "is_cancelled", "is_pending"))


@register("chart_contribution_rows", O.slice_base() + f"""SELECT case_id, dimension, dimension_value,
  contribution_pct, driver_rank,
  CASE WHEN contribution_pct < 0 THEN 'negative' ELSE 'positive' END AS bar_sign,
  {O.fmt_fixed('contribution_pct', 1, True)} || '%' AS bar_label
FROM slices WHERE driver_rank <= 10""")
def chart_contribution_rows(spark, sf):
    return RU.chart_contribution_rows(B.slices(spark, sf))


@register("report_driver_rows", O.slice_base() + f"""SELECT case_id, dimension, driver_rank,
  dimension_value AS slice, printf('%.2f', baseline_daily) AS baseline, printf('%.2f', anomaly_daily) AS anomaly,
  printf('%+.2f', absolute_change) AS change,
  {O.fmt_fixed('percent_change', 1, True)} || '%' AS pct_change,
  {O.fmt_fixed('contribution_pct', 1)} || '%' AS contribution
FROM slices WHERE driver_rank <= 8""")
def report_driver_rows(spark, sf):
    return RU.report_driver_rows(B.slices(spark, sf))


# ----------------------------------------------------------------- G1-G6 SQL-text audit
from kpiscope.operators import audit as AU  # noqa: E402
from kpiscope.sources.tables import read_table, spread  # noqa: E402


def _documents(spark, sf):
    return read_table(spark, sf, "documents")


def _doc_texts(spark, sf):
    d = spread(_documents(spark, sf).select("doc_id", "text"))
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("query_id"),
                    F.col("text").alias("sql"))


@register("sql_audit", O.with_(O.audit_cte(O.DOC_SQL_SOURCE)) + """SELECT query_id,
  len(errors) = 0 AS is_valid, CAST(len(errors) AS BIGINT) AS n_errors,
  array_to_string(errors, ' | ') AS error_text FROM a4""")
def sql_audit(spark, sf):
    """G1 over every document text, read as a submitted query (whole texts)."""
    v = AU.validate(_doc_texts(spark, sf))
    return v.select("query_id", "is_valid", F.size("errors").cast("bigint").alias("n_errors"),
                    F.array_join("errors", " | ").alias("error_text"))


@register("sql_sanitize", O.with_(O.audit_cte(O.DOC_SQL_SOURCE)) +
          "SELECT query_id, sanitized_sql FROM a4")
def sql_sanitize(spark, sf):
    """Stripped text with the row cap appended when no LIMIT is present."""
    return AU.validate(_doc_texts(spark, sf)).select("query_id", "sanitized_sql")


@register("sql_table_refs", O.with_(O.audit_cte(O.DOC_SQL_SOURCE)) + f"""SELECT query_id,
  CAST(i AS BIGINT) AS ref_pos, table_refs[i + 1] AS table_name,
  list_contains(cte_names, lower(table_refs[i + 1])) AS is_cte,
  list_contains({O.sql_list(O.ALLOWED_TABLES)}, lower(table_refs[i + 1])) AS is_allowed
FROM (SELECT query_id, table_refs, cte_names, unnest(range(len(table_refs))) AS i FROM a3)""")
def sql_table_refs(spark, sf):
    """Referenced names per text."""
    return AU.table_refs(_doc_texts(spark, sf))


_K, _D, _DT = O.request_sql("text")


@register("request_extract", f"""SELECT doc_id, {_K} AS kpi, array_to_string({_D}, ',') AS dimensions,
  array_to_string({_DT}, ',') AS dates FROM documents""")
def request_extract(spark, sf):
    """G5 over every document text."""
    d = _documents(spark, sf).select("doc_id", "text")
    r = AU.request_extract(d, "text")
    return r.select("doc_id", "kpi", F.array_join("dimensions", ",").alias("dimensions"),
                    F.array_join("dates", ",").alias("dates"))


@register("reply_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def reply_json(spark, sf):
    """G6 over the JSON payloads of the events table."""
    e = read_table(spark, sf, "events").select("event_id", "props")
    p = AU.reply_json(e, "props", "k BIGINT")
    return p.select("event_id", F.col("parsed.k").alias("k"))


from kpiscope.plans import texts as TX  # noqa: E402

_STATEMENTS = f"SELECT {TX.STATEMENT_ID} AS query_id, {TX.STATEMENT} AS sql FROM orders"


def _statements(spark, sf):
    return read_table(spark, sf, "orders").selectExpr(f"{TX.STATEMENT_ID} AS query_id", f"{TX.STATEMENT} AS sql")


@register("sql_audit_statements", O.with_(O.audit_cte(_STATEMENTS)) + """SELECT query_id,
  len(errors) = 0 AS is_valid, array_to_string(errors, ' | ') AS error_text, sanitized_sql FROM a4""")
def sql_audit_statements(spark, sf):
    """G1, G3 over statements built from orders: each verdict, message and cap fires in volume."""
    return AU.validate(_statements(spark, sf)).select(
        "query_id", "is_valid", F.array_join("errors", " | ").alias("error_text"), "sanitized_sql")


@register("sql_table_refs_statements", O.with_(O.audit_cte(_STATEMENTS)) + f"""SELECT query_id,
  CAST(i AS BIGINT) AS ref_pos, table_refs[i + 1] AS table_name,
  list_contains(cte_names, lower(table_refs[i + 1])) AS is_cte,
  list_contains({O.sql_list(O.ALLOWED_TABLES)}, lower(table_refs[i + 1])) AS is_allowed
FROM (SELECT query_id, table_refs, cte_names, unnest(range(len(table_refs))) AS i FROM a3)""")
def sql_table_refs_statements(spark, sf):
    """G2, J7, U4 over the same statements."""
    return AU.table_refs(_statements(spark, sf))


@register("request_extract_orders", f"""SELECT o_orderkey, {_K} AS kpi, array_to_string({_D}, ',') AS dimensions,
  array_to_string({_DT}, ',') AS dates FROM (SELECT o_orderkey, {TX.QUESTION} AS text FROM orders)""")
def request_extract_orders(spark, sf):
    """G5 over questions built from orders."""
    asked = read_table(spark, sf, "orders").selectExpr("o_orderkey", f"{TX.QUESTION} AS text")
    return AU.request_extract(asked, "text").select(
        "o_orderkey", "kpi", F.array_join("dimensions", ",").alias("dimensions"), F.array_join("dates", ",").alias("dates"))


@register("reply_json_fenced", """SELECT event_id,
  CASE WHEN event_id % 6 IN (0, 1, 2, 3, 5) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def reply_json_fenced(spark, sf):
    """G6 over plain, fenced, unclosed and unparsable replies built from events."""
    replies = read_table(spark, sf, "events").selectExpr("event_id", f"{TX.REPLY} AS reply")
    return AU.reply_json(replies, "reply", "k BIGINT").select("event_id", F.col("parsed.k").alias("k"))


@register("section_chunks_markdown", O.with_(O.chunks_cte(f"SELECT doc_id AS source, {TX.MARKDOWN} AS value FROM documents")) +
          "SELECT source, section_no, section, content FROM chunks")
def section_chunks_markdown(spark, sf):
    """T1 over Markdown built from documents: every heading level, empty and false headings."""
    from kpiscope.operators.retrieval import section_chunks as split
    return split(_documents(spark, sf).selectExpr("doc_id AS source", f"{TX.MARKDOWN} AS value"))


# ----------------------------------------------------------------- V1-V10 decisions
from kpiscope.plans import investigate as INV  # noqa: E402


def _inv(spark, sf):
    cases = B.incidents(spark)
    return INV.investigate(B.cube(spark, sf), cases), cases


@register("analysis_row_counts", O.decision_base() + """SELECT case_id, CAST(seq AS BIGINT) AS seq, query_id, purpose,
  row_count, CAST(least(row_count, 10) AS BIGINT) AS rows_shown,
  CAST(greatest(row_count - 10, 0) AS BIGINT) AS rows_more FROM runlog""")
def analysis_row_counts(spark, sf):
    """G4 + O5: every analysis of every incident with the rows of its result, the rows that a
    report shows (first 10) and the count of the rest."""
    inv, _ = _inv(spark, sf)
    return inv.run_log.select("case_id", F.col("seq").cast("bigint").alias("seq"), "query_id", "purpose", "row_count",
                              F.least("row_count", F.lit(10)).cast("bigint").alias("rows_shown"),
                              F.greatest(F.col("row_count") - 10, F.lit(0)).cast("bigint").alias("rows_more"))


@register("evidence_registry", O.decision_base() + """SELECT case_id, pass_no, seq, evidence_id, source_type,
  source_ref, description, supports_conclusion, strength FROM evidence""")
def evidence_registry(spark, sf):
    """V1 (+ V9 passes): every evidence item of every incident."""
    inv, _ = _inv(spark, sf)
    return inv.evidence.select("case_id", "pass_no", "seq", "evidence_id", "source_type", "source_ref",
                               "description", "supports_conclusion", "strength")


@register("verification_checks", O.decision_base() + "SELECT * FROM checks")
def verification_checks(spark, sf):
    inv, _ = _inv(spark, sf)
    return inv.checks


@register("confidence_ladder", O.decision_base() +
          "SELECT case_id, checks_passed, confidence, overall_supported FROM verdict2")
def confidence_ladder(spark, sf):
    inv, _ = _inv(spark, sf)
    return inv.verdicts.select("case_id", "checks_passed", "confidence", "overall_supported")


@register("review_triggers", O.decision_base() + """SELECT case_id, needs_review,
  array_to_string(review_reasons, ',') AS review_reasons, sql_failure_count FROM verdict2""")
def review_triggers(spark, sf):
    inv, _ = _inv(spark, sf)
    return inv.verdicts.select("case_id", "needs_review",
                               F.array_join("review_reasons", ",").alias("review_reasons"),
                               "sql_failure_count")


@register("review_routing", O.decision_base() + "SELECT case_id, needs_review, review_status FROM verdict2")
def review_routing(spark, sf):
    inv, _ = _inv(spark, sf)
    return inv.verdicts.select("case_id", "needs_review", "review_status")


@register("primary_finding", O.decision_base() + """SELECT case_id, primary_finding, confidence,
  array_to_string(finding_evidence_ids, ',') AS evidence_ids,
  array_to_string(finding_caveats, ' | ') AS caveats FROM found WHERE dimension IS NOT NULL""")
def primary_finding(spark, sf):
    inv, _ = _inv(spark, sf)
    f = inv.findings.where(F.col("dimension").isNotNull())
    return f.select("case_id", "primary_finding", "confidence",
                    F.array_join("finding_evidence_ids", ",").alias("evidence_ids"),
                    F.array_join("finding_caveats", " | ").alias("caveats"))


@register("conclusion_text", O.decision_base() + "SELECT case_id, conclusion FROM found")
def conclusion_text(spark, sf):
    inv, _ = _inv(spark, sf)
    return inv.findings.select("case_id", "conclusion")


@register("investigate_all", O.decision_base() + """SELECT c.case_id, f.kpi_name, c.affected_start_date,
  c.affected_end_date, c.baseline_start, c.baseline_end, f.dimension AS driver_dimension,
  f.dimension_value AS driver_slice, f.contribution_pct AS driver_contribution_pct,
  f.percent_change AS driver_percent_change, f.checks_passed, f.confidence, f.needs_review,
  array_to_string(f.review_reasons, ',') AS review_reasons, f.review_status, f.passes,
  f.n_support1 * f.passes AS n_supporting, f.primary_finding, f.conclusion
FROM casesd c JOIN found f ON c.case_id = f.case_id""")
def investigate_all(spark, sf):
    """V10 flagship: every incident investigated in one plan."""
    inv, cases = _inv(spark, sf)
    return INV.summary(inv, cases)


# ----------------------------------------------------------------- T1-T6 retrieval
from kpiscope.operators import retrieval as RT  # noqa: E402

_BENCH_Q = "SELECT item_id AS query_id, text FROM benchmark"
_CASE_Q = ("WITH " + O.cases_cte() +
           " SELECT case_id AS query_id, concat_ws(' ', kpi_name, description) AS text FROM cases0")


def _corpus(spark, sf):
    return RT.documents_as_chunks(spread(read_table(spark, sf, "documents").select("doc_id", "text")))


def _bench_queries(spark, sf):
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@register("section_chunks", O.with_(O.chunks_cte("SELECT doc_id AS source, text AS value FROM documents")) +
          "SELECT source, section_no, section, content FROM chunks")
def section_chunks(spark, sf):
    """T1 over every document."""
    return _corpus(spark, sf)


@register("tokenize_docs", O.with_(O.chunks_cte("SELECT doc_id AS source, text AS value FROM documents")) +
          f"""SELECT source, section_no, CAST(len({O.tokens_sql('content')}) AS BIGINT) AS n_tokens,
  array_to_string({O.tokens_sql('content')}, ' ') AS tokens FROM chunks""")
def tokenize_docs(spark, sf):
    """The whole token sequence of every chunk."""
    c = _corpus(spark, sf).select("source", "section_no", RT.tokens(F.col("content")).alias("t"))
    return c.select("source", "section_no", F.size("t").cast("bigint").alias("n_tokens"),
                    F.array_join("t", " ").alias("tokens"))


@register("bm25_idf", O.bm25_sql("SELECT 0 AS query_id, '' AS text") +
          f"SELECT term, df, {O.round_to('idf', 9)} AS idf FROM idf")
def bm25_idf(spark, sf):
    """Document frequency and floored idf of every term."""
    ix = RT.BM25Index(_corpus(spark, sf))
    return ix.idf.select("term", "df", RT.round_to("idf", 9).alias("idf"))


@register("bm25_scores", O.bm25_sql(_BENCH_Q) +
          f"SELECT query_id, source, section_no, {O.round_to('score', 6)} AS score FROM scores")
def bm25_scores(spark, sf):
    """T4: every benchmark item scored against every chunk sharing a term."""
    ix = RT.BM25Index(_corpus(spark, sf))
    s = ix.scores(_bench_queries(spark, sf))
    return s.select("query_id", "source", "section_no", RT.round_to("score", 6).alias("score"))


_TOPK_SELECT = f"""SELECT t.query_id, CAST(t.rk AS BIGINT) AS rank, t.source, t.section_no, c.section,
  {O.round_to('t.score', 4)} AS relevance_score
FROM topk t JOIN chunks c ON t.source = c.source AND t.section_no = c.section_no"""


@register("bm25_topk", O.bm25_sql(_BENCH_Q) + _TOPK_SELECT)
def bm25_topk(spark, sf):
    """T5: top 5 chunks per benchmark item."""
    return RT.BM25Index(_corpus(spark, sf)).top_k(_bench_queries(spark, sf))


@register("case_context", O.bm25_sql(_CASE_Q) + _TOPK_SELECT)
def case_context(spark, sf):
    """Context retrieval for every incident (KPI name + description)."""
    q = B.incidents(spark).select(F.col("case_id").alias("query_id"),
                                  F.concat_ws(" ", "kpi_name", "description").alias("text"))
    return RT.BM25Index(_corpus(spark, sf)).top_k(q)


# ----------------------------------------------------------------- E0-E3 evaluation
from kpiscope.operators import evaluate as EV  # noqa: E402


@register("cause_tokens", f"""SELECT doc_id, array_to_string({O.cause_tokens_sql('text')}, ' ') AS tokens,
  CAST(len({O.cause_tokens_sql('text')}) AS BIGINT) AS n_tokens FROM documents""")
def cause_tokens(spark, sf):
    """E0 over every document text."""
    d = _documents(spark, sf).select("doc_id", EV.cause_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.array_join("t", " ").alias("tokens"),
                    F.size("t").cast("bigint").alias("n_tokens"))


def _grades(spark, sf):
    inv, cases = _inv(spark, sf)
    return EV.with_failed(EV.grade_cases(inv.findings, cases), cases), cases, inv


@register("cause_hit", O.decision_base() + f""", hits AS (
  SELECT f.case_id, f.primary_finding, c.expected_primary_cause,
    CASE WHEN len({O.cause_tokens_sql('c.expected_primary_cause')}) > 0 THEN
      CAST(len(list_intersect({O.cause_tokens_sql('f.primary_finding')}, {O.cause_tokens_sql('c.expected_primary_cause')})) AS DOUBLE)
      / CAST(len({O.cause_tokens_sql('c.expected_primary_cause')}) AS DOUBLE) END AS overlap_ratio
  FROM found f JOIN casesd c ON f.case_id = c.case_id WHERE f.primary_finding IS NOT NULL)
SELECT *, coalesce(overlap_ratio >= 0.25, FALSE) AS hit FROM hits""")
def cause_hit(spark, sf):
    """Overlap of the predicted cause's words with the expected cause's."""
    inv, cases = _inv(spark, sf)
    f = inv.findings.where(F.col("primary_finding").isNotNull()).join(
        cases.select("case_id", "expected_primary_cause"), "case_id")
    ratio = EV.hit_ratio(EV.cause_tokens(F.col("primary_finding")), EV.cause_tokens(F.col("expected_primary_cause")))
    return f.select("case_id", "primary_finding", "expected_primary_cause", ratio.alias("overlap_ratio"),
                    F.coalesce(ratio >= 0.25, F.lit(False)).alias("hit"))


@register("grade_cases", O.decision_base() + ", " + O.GRADES + """
SELECT case_id, primary_cause_hit, primary_cause_hit AS top_k_hit, sql_success_rate, evidence_sufficient,
  unsupported_claim_count, human_review_triggered, runtime_seconds, predicted_primary_cause, predicted_cause_full, confidence
FROM grades""")
def grade_cases(spark, sf):
    g, _, _ = _grades(spark, sf)
    return g


@register("eval_summary", O.decision_base() + ", " + O.GRADES + """
SELECT count(*) AS total_cases,
  coalesce(avg(CAST(primary_cause_hit AS DOUBLE)), 0.0) AS primary_hit_rate,
  coalesce(avg(CAST(primary_cause_hit AS DOUBLE)), 0.0) AS top_k_hit_rate,
  coalesce(avg(sql_success_rate), 0.0) AS avg_sql_success_rate,
  coalesce(avg(CAST(evidence_sufficient AS DOUBLE)), 0.0) AS evidence_sufficiency_rate,
  coalesce(avg(CAST(unsupported_claim_count AS DOUBLE)), 0.0) AS avg_unsupported_claims,
  coalesce(avg(CAST(human_review_triggered AS DOUBLE)), 0.0) AS human_review_trigger_rate,
  coalesce(avg(runtime_seconds), 0.0) AS avg_runtime_seconds
FROM grades""")
def eval_summary(spark, sf):
    g, _, _ = _grades(spark, sf)
    return EV.eval_summary(g)


@register("eval_per_case", O.decision_base() + ", " + O.GRADES + """
SELECT g.case_id, coalesce(c.kpi_name, '?') AS kpi, CASE WHEN g.primary_cause_hit THEN 'Y' ELSE 'N' END AS primary_hit,
  g.sql_success_rate, CASE WHEN g.evidence_sufficient THEN 'Y' ELSE 'N' END AS evidence, g.confidence,
  g.runtime_seconds
FROM grades g LEFT JOIN casesd c ON g.case_id = c.case_id""")
def eval_per_case(spark, sf):
    """E3 detail rows with the J4 lookup of the KPI."""
    g, cases, _ = _grades(spark, sf)
    return EV.per_case_rows(g, cases)


# ----------------------------------------------------------------- C2, C3, J5
from kpiscope.operators import calendar as CAL  # noqa: E402
from kpiscope.functions.kpi import MEASURE_COLUMNS  # noqa: E402
from kpiscope.operators.windows import incident_tagging as _tagging  # noqa: E402


@register("seasonal_adjusted_volume", O.with_(O.STAR) + f"""SELECT order_date, count(*) AS n_orders,
  {O.seasonal_sql('order_date')} AS seasonal_index,
  {O.round2('CAST(count(*) AS DOUBLE) / ' + O.seasonal_sql('order_date'))} AS adjusted_orders
FROM canon GROUP BY order_date""")
def seasonal_adjusted_volume(spark, sf):
    return CAL.seasonal_adjusted_volume(B.fact(spark, sf, "order_date"))


_TAGGING_SQL = O.with_(O.STAR, O.cases_cte()) + f"""SELECT c.case_id, c.i_type AS injection_type,
  o.order_id, o.order_date, o.channel, o.region, o.category, o.payment_type, o.campaign, o.order_total
FROM canon o JOIN casesd c ON o.order_date BETWEEN c.affected_start_date AND c.affected_end_date
WHERE {" AND ".join(f"(c.i_{d} IS NULL OR c.i_{d} = o.{d})" for d in ["channel", "region", "category", "payment_type", "campaign"])}"""


def _tagged_fact(spark, sf):
    return B.fact_in_anomaly_windows(
        spark, sf, "order_id", "order_date", "channel", "region", "category", "payment_type", "campaign", "order_total")


@register("incident_tagging", _TAGGING_SQL)
def incident_tagging(spark, sf):
    """Orders inside each incident window matching its slice predicate."""
    return _tagging(_tagged_fact(spark, sf), B.incidents(spark))


@register("incident_tagging_ranges", _TAGGING_SQL)
def incident_tagging_ranges(spark, sf):
    """J5 by dyadic ranges of the windows, as it runs where there are too many incidents for a calendar of days."""
    return _tagging(_tagged_fact(spark, sf), B.incidents(spark), limit=0)


@register("daily_cube_refreshed", O.with_(O.STAR, O.cube_cte(bounded=False)) + "SELECT order_date, dimension, slice, "
          + ", ".join(f"CAST({m} AS BIGINT) AS {m}" for m in MEASURE_COLUMNS) + " FROM cube")
def daily_cube_refreshed(spark, sf):
    """The stored cube, built from the orders before 1998 and refreshed by the months after them."""
    from kpiscope.sources import cube_store
    from kpiscope.sources.sinks import scratch_path
    fact, base = B.fact(spark, sf), scratch_path(spark, "cube")
    late = F.coalesce(F.col("order_date") >= F.lit("1998-01-01").cast("date"), F.lit(False))
    for rows, mode in ((~late, "overwrite"), (late, "append")):
        cube_store.write_fact(fact.where(rows), f"{base}/fact", cube_store.MONTH, mode)
        refreshed = cube_store.refresh_cube(spark, f"{base}/fact", f"{base}/cube", fact.schema, cube_store.MONTH)
    return refreshed.cube


# ----------------------------------------------------------------- DQ1-DQ3
from kpiscope.operators import quality as QA  # noqa: E402

_STATUSES = ["completed", "cancelled", "pending", "refunded"]


def _key_source(spark, sf, table, key, name):
    """Every row of a raw table belongs to one table of the star."""
    return read_table(spark, sf, table), F.col(key), {name: F.lit(True)}


def _line_source(spark, sf, key):
    """A line is an order item and a payment; a returned one is a refund too."""
    return read_table(spark, sf, "lineitem"), key, {
        "order_items": F.lit(True), "payments": F.lit(True), "refunds": F.coalesce(F.col("l_returnflag") == "R", F.lit(False))}


_LINE_ID = "SELECT l_orderkey * 10 + l_linenumber AS {} FROM lineitem"
_PK = [("orders", "(SELECT o_orderkey AS order_id FROM orders)", "order_id"),
       ("order_items", f"({_LINE_ID.format('line_id')})", "line_id"),
       ("payments", f"({_LINE_ID.format('line_id')})", "line_id"),
       ("refunds", f"({_LINE_ID.format('line_id')} WHERE l_returnflag = 'R')", "line_id"),
       ("products", "(SELECT p_partkey AS product_id FROM part)", "product_id"),
       ("customers", "(SELECT c_custkey AS customer_id FROM customer)", "customer_id"),
       ("regions", "(SELECT r_name AS region FROM region)", "region"),
       ("channels", "(SELECT lower(trim(channel)) AS channel FROM (SELECT DISTINCT channel FROM canon))", "channel"),
       ("campaigns", "(SELECT lower(trim(campaign)) AS campaign FROM (SELECT DISTINCT campaign FROM canon))", "campaign")]


@register("dq_pk", O.with_(O.STAR) + "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS table_name, '{k}' AS key_column, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_rows,
  count(*) AS n_keys, count_if(c > 1) AS n_duplicate_keys, count_if(k IS NULL) AS n_null_keys
FROM (SELECT {k} AS k, count(*) AS c FROM {src} GROUP BY {k})""" for n, src, k in _PK))
def dq_pk(spark, sf):
    """DQ1: primary-key uniqueness of the raw star tables; payments and refunds at line level, dimension
    tables keyed by name."""
    line_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    found = QA.key_integrity("order_id", [_key_source(spark, sf, "orders", "o_orderkey", "orders")])
    for key, source in (("line_id", _line_source(spark, sf, line_id)),
                        ("product_id", _key_source(spark, sf, "part", "p_partkey", "products")),
                        ("customer_id", _key_source(spark, sf, "customer", "c_custkey", "customers")),
                        ("region", _key_source(spark, sf, "region", "r_name", "regions"))):
        found = found.unionByName(QA.key_integrity(key, [source]))
    names = QA.name_integrity(B.fact(spark, sf, "channel", "campaign"), ["channel", "campaign"], ["channels", "campaigns"])
    return found.drop("n_orphans").unionByName(names)


@register("dq_rules", O.with_(O.FULL_STAR) + """SELECT rule, n_violations FROM (
  SELECT 'refund_exceeds_order_total' AS rule, CAST(count_if(r.refund_amount > o.order_total) AS BIGINT) AS n_violations
  FROM refunds r LEFT JOIN canon o ON r.order_id = o.order_id
  UNION ALL SELECT 'refund_outside_1_14_days', CAST(count_if(NOT ((r.refund_date - o.order_date) BETWEEN 1 AND 14)) AS BIGINT)
  FROM refunds r LEFT JOIN canon o ON r.order_id = o.order_id
  UNION ALL SELECT 'refund_reason_out_of_domain', CAST(count_if(NOT (r.reason IN ('O', 'F'))) AS BIGINT)
  FROM refunds r LEFT JOIN canon o ON r.order_id = o.order_id
  UNION ALL SELECT 'order_status_out_of_domain',
    CAST(count_if(NOT (order_status IN ('completed', 'cancelled', 'pending', 'refunded'))) AS BIGINT) FROM canon
  UNION ALL SELECT 'orders_with_multiple_payments', CAST(count_if(n > 1) AS BIGINT)
  FROM (SELECT order_id, count(*) AS n FROM payments GROUP BY order_id)
  UNION ALL SELECT 'payment_status_out_of_domain',
    CAST(count_if(NOT (payment_status IN ('completed', 'failed', 'pending'))) AS BIGINT) FROM payments)""")
def dq_rules(spark, sf):
    """DQ2: business-rule violations."""
    return QA.rule_violations(SB.enriched_orders(spark, sf, ["order_id", "order_date", "order_total", "order_status"]),
                              ["O", "F"], _STATUSES)


_LINES_OF = "(SELECT l_orderkey AS order_id, l_partkey AS product_id, l_returnflag FROM lineitem)"
_ORPHANS = [("orders_customer", "(SELECT o_custkey AS customer_id FROM orders)", "customer_id", "customer", "c_custkey"),
            ("order_items_order", _LINES_OF, "order_id", "orders", "o_orderkey"),
            ("payments_order", _LINES_OF, "order_id", "orders", "o_orderkey"),
            ("refunds_order", _LINES_OF + " ch WHERE l_returnflag = 'R' AND", "order_id", "orders", "o_orderkey"),
            ("order_items_product", _LINES_OF, "product_id", "part", "p_partkey")]


@register("dq_orphans", "\nUNION ALL\n".join(
    f"""SELECT '{r}' AS rule, count(*) AS n_orphans FROM {c if c.endswith('AND') else c + ' ch WHERE'}
  ch.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} pa WHERE pa.{pk} = ch.{fk})""" for r, c, fk, p, pk in _ORPHANS))
def dq_orphans(spark, sf):
    """DQ3: foreign keys without a parent row; one aggregate for each key."""
    lines = read_table(spark, sf, "lineitem")
    by_key = [("order_id", "orders", [_key_source(spark, sf, "orders", "o_orderkey", "orders"),
                                      _line_source(spark, sf, F.col("l_orderkey"))]),
              ("product_id", "products", [_key_source(spark, sf, "part", "p_partkey", "products"),
                                          (lines, F.col("l_partkey"), {"order_items": F.lit(True)})]),
              ("customer_id", "customers", [_key_source(spark, sf, "customer", "c_custkey", "customers"),
                                            _key_source(spark, sf, "orders", "o_custkey", "orders")])]
    parts = []
    for key, parent, sources in by_key:
        rule = F.concat(F.col("table_name"), F.lit("_" + key.removesuffix("_id")))
        parts.append(QA.key_integrity(key, sources, parent).where(F.col("table_name") != parent)
                     .select(rule.alias("rule"), "n_orphans"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ----------------------------------------------------------------- sinks, SQL entry
from kpiscope.sources import sinks as SK  # noqa: E402


@register("sink_full_refresh", O.with_(O.STAR) + "SELECT * FROM canon")
def sink_full_refresh(spark, sf):
    """Full-refresh Parquet write of the canonical orders, read back."""
    path = SK.scratch_path(spark, "orders")
    SK.full_refresh(B.fact(spark, sf).where("is_cancelled"), path, "order_date")     # a filled table is replaced
    return SK.full_refresh(B.fact(spark, sf), path, "order_date")[0]


@register("sink_results_json", O.decision_base() + ", " + O.GRADES + """
SELECT case_id, primary_cause_hit, primary_cause_hit AS top_k_hit, sql_success_rate, evidence_sufficient,
  unsupported_claim_count, human_review_triggered, runtime_seconds, predicted_primary_cause, predicted_cause_full, confidence
FROM grades""")
def sink_results_json(spark, sf):
    """Per-case grades written as JSON and read back."""
    g, _, _ = _grades(spark, sf)
    return SK.json_round_trip(g, SK.scratch_path(spark, "grades"))


_CAPPED_SQL = ("SELECT order_id, order_date, channel, order_total FROM fact_orders_enriched "
               "WHERE NOT is_cancelled ORDER BY order_total DESC, order_id")


@register("capped_query", O.with_(O.FULL_STAR, O.ENRICHED) +
          "SELECT order_id, order_date, channel, order_total FROM enriched WHERE NOT is_cancelled "
          "ORDER BY order_total DESC, order_id LIMIT 10000")
def capped_query(spark, sf):
    """S10 + S11 + O3: register the views, validate an analyst query, run it
    with the row cap appended."""
    V.register_views(spark, sf)
    df, errors, _ = SK.run_sql(spark, _CAPPED_SQL)
    if df is None:
        raise ValueError("; ".join(errors))
    return df


_BATCH = [("paid", "SELECT order_id, order_total FROM fact_orders_enriched WHERE NOT is_cancelled AND NOT is_pending"),
          ("by_channel", "SELECT channel, count(*) AS n FROM fact_orders_enriched GROUP BY channel"),
          ("limited", "SELECT order_id FROM fact_orders_enriched ORDER BY order_id LIMIT 7"),
          ("forbidden", "DELETE FROM orders"), ("unknown_column", "SELECT no_such_column FROM orders"),
          ("failing_row", "SELECT order_id FROM orders WHERE assert_true(order_id < 0) IS NULL")]
_BATCH_COUNTS = {"paid": f"SELECT count(*) AS n FROM canon WHERE {O.PAID_SQL}",
                 "by_channel": "SELECT count(*) AS n FROM (SELECT DISTINCT channel FROM canon)",
                 "limited": "SELECT least(count(*), 7) AS n FROM canon"}


@register("batch_run_records", O.with_(O.STAR) + "\nUNION ALL\n".join(
    f"SELECT '{q}' AS query_id, TRUE AS success, CAST(least(n, 10000) AS BIGINT) AS row_count, CAST(n AS BIGINT) AS full_count, "
    f"n > 10000 AS truncated FROM ({_BATCH_COUNTS[q]})" if q in _BATCH_COUNTS else
    f"SELECT '{q}', FALSE, CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE" for q, _ in _BATCH))
def batch_run_records(spark, sf):
    """Texts over the registered views run side by side; failures are records, a cut
    result says so and gives the full count."""
    from kpiscope.sources.runner import run_batch
    V.register_views(spark, sf)
    texts = spark.createDataFrame(_BATCH, "query_id string, sql string")
    return run_batch(texts).select("query_id", "success", "row_count", "full_count", "truncated")


# ----------------------------------------------------------------- P3, P7, J3, V11
from kpiscope.functions.numeric import cents_to_money, to_cents  # noqa: E402
from kpiscope.operators.windows import join_calendar as _join_cal  # noqa: E402

_SUBSET = ["INC-001", "INC-004", "INC-008"]


@register("window_filter", O.with_(O.STAR, O.cases_cte()) + f"""SELECT c.case_id, count(*) AS n_orders,
  {O.money('sum(' + O.cents('o.order_total') + ')')} AS gmv, min(o.order_date) AS first_day, max(o.order_date) AS last_day
FROM canon o JOIN casesd c ON o.order_date BETWEEN c.affected_start_date AND c.affected_end_date
GROUP BY c.case_id""")
def window_filter(spark, sf):
    """Orders inside each anomaly window (inclusive), via the day calendar."""
    cases = B.incidents(spark)
    cal = (cases.select("case_id", F.explode(F.sequence("affected_start_date", "affected_end_date"))
                        .alias("order_date")))
    j = _join_cal(B.fact_in_anomaly_windows(spark, sf, "order_date", "order_total"), cal, cases)
    return j.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_orders"),
        cents_to_money(F.sum(to_cents("order_total"))).alias("gmv"),
        F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day"))


@register("case_subset", _BEST_SQL.replace("WHERE r = 1", "WHERE r = 1 AND case_id IN (" +
                                           ", ".join(f"'{c}'" for c in _SUBSET) + ")"))
def case_subset(spark, sf):
    """Investigate only the requested incidents (semi join on ids)."""
    from kpiscope.sources.cases import select_cases
    return C.best_driver(C.slice_compare(B.cube(spark, sf), select_cases(B.incidents(spark), _SUBSET)))


@register("slice_full_outer", O.slice_base() + """SELECT case_id, dimension, slice,
  CAST(coalesce(bl_n, 0) AS BIGINT) AS baseline_orders, CAST(coalesce(an_n, 0) AS BIGINT) AS anomaly_orders
FROM (SELECT case_id, dimension, slice,
             sum(CASE WHEN win = 'baseline' THEN n_rows END) AS bl_n,
             sum(CASE WHEN win = 'anomaly' THEN n_rows END) AS an_n
      FROM (SELECT c.case_id, c.win, cb.dimension, cb.slice, cb.n_rows
            FROM cube cb JOIN cal c ON cb.order_date = c.order_date WHERE cb.dimension <> '__total__' AND cb.slice IS NOT NULL)
      GROUP BY case_id, dimension, slice)""")
def slice_full_outer(spark, sf):
    """Baseline and anomaly slice counts aligned with a full outer join
    (a slice missing on one side counts 0)."""
    from kpiscope.operators.windows import window_calendar
    cases = B.incidents(spark)
    cube = B.cube(spark, sf).where((F.col("dimension") != C.TOTAL) & F.col("slice").isNotNull())
    j = _join_cal(cube, window_calendar(cases), cases)
    keys = ["case_id", "dimension", "slice"]
    bl = j.where(F.col("window") == "baseline").groupBy(*keys).agg(F.sum("n_rows").alias("bl_n"))
    an = j.where(F.col("window") == "anomaly").groupBy(*keys).agg(F.sum("n_rows").alias("an_n"))
    return bl.join(an, keys, "full_outer").select(
        *keys, F.coalesce("bl_n", F.lit(0)).cast("bigint").alias("baseline_orders"),
        F.coalesce("an_n", F.lit(0)).cast("bigint").alias("anomaly_orders"))


@register("investigation_record")
def investigation_record(spark, sf):
    """One nested record per incident (windows, finding, checks, review)."""
    inv, cases = _inv(spark, sf)
    checks = (inv.checks.groupBy("case_id")
                 .agg(F.sort_array(F.collect_list(F.struct("check_no", "check_name", "passed", "detail")))
                      .alias("checks")))
    from kpiscope.operators.windows import with_baseline as _wb
    c = _wb(cases).select("case_id", "affected_start_date", "affected_end_date", "baseline_start", "baseline_end")
    f = inv.findings.join(checks, "case_id").join(c, "case_id")
    return f.select(
        "case_id", "kpi_name",
        F.struct("affected_start_date", "affected_end_date", "baseline_start", "baseline_end").alias("windows"),
        F.struct(F.col("primary_finding").alias("description"), "confidence",
                 F.col("finding_evidence_ids").alias("evidence_ids"),
                 F.col("finding_caveats").alias("caveats")).alias("finding"),
        "conclusion",
        F.struct("overall_supported", "checks").alias("verification"),
        F.struct("needs_review", "review_reasons", "review_status").alias("review"))


@register("investigation_record_json", O.decision_base() + """SELECT c.case_id, f.kpi_name, c.affected_start_date,
  c.affected_end_date, c.baseline_start, c.baseline_end, f.primary_finding, f.confidence,
  array_to_string(f.finding_evidence_ids, ',') AS evidence_ids, array_to_string(f.finding_caveats, ' | ') AS caveats,
  f.conclusion, f.overall_supported, k.checks, f.needs_review,
  array_to_string(f.review_reasons, ',') AS review_reasons, f.review_status
FROM casesd c JOIN found f ON c.case_id = f.case_id JOIN (
  SELECT case_id, string_agg(check_no || ':' || check_name || ':' || CASE WHEN passed THEN 'Y' ELSE 'N' END || ':' || detail,
                             ' | ' ORDER BY check_no) AS checks FROM checks GROUP BY case_id) k ON c.case_id = k.case_id""")
def investigation_record_json(spark, sf):
    """V11 + S7: the nested records written as JSON, read back, their leaves as columns."""
    r = SK.json_round_trip(investigation_record(spark, sf), SK.scratch_path(spark, "records"))
    lines = F.transform("verification.checks", lambda k: F.concat_ws(
        ":", k["check_no"].cast("string"), k["check_name"], F.when(k["passed"], "Y").otherwise("N"), k["detail"]))
    return r.select(
        "case_id", "kpi_name", "windows.*", F.col("finding.description").alias("primary_finding"), "finding.confidence",
        F.array_join("finding.evidence_ids", ",").alias("evidence_ids"),
        F.array_join("finding.caveats", " | ").alias("caveats"), "conclusion", "verification.overall_supported",
        F.array_join(lines, " | ").alias("checks"), "review.needs_review",
        F.array_join("review.review_reasons", ",").alias("review_reasons"), "review.review_status")
