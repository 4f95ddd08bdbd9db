"""The default incidents, as plain literals over the driver tables.

Written from what the tables hold (orders from 1995 to mid 2001, five order
priorities, regions, market segments and nations). They cover the window rules:
an incident of 14 days, one with a given baseline, one of which only one end is
given (both ends are then replaced), one whose baseline lies after the affected
days, and one in days without orders.
"""

DEFAULT_CASES = [
    dict(case_id="INC-001", kpi_name="gmv", start="1995-04-10", end="1995-06-18",
         description="Turnover of 3-MEDIUM orders against the ten weeks before",
         cause="3-MEDIUM orders carry the change of gmv",
         secondary=["one priority moves alone"], dims=["channel"], review=False,
         tag=dict(type="priority_watch", channel="3-MEDIUM")),
    dict(case_id="INC-002", kpi_name="order_count", start="1996-02-05", end="1996-04-21",
         description="Orders from ASIA in late winter",
         cause="ASIA places fewer orders per day",
         secondary=[], dims=["region", "channel"], review=False,
         tag=dict(type="region_watch", region="ASIA")),
    dict(case_id="INC-003", kpi_name="aov", start="1997-05-12", end="1997-07-27",
         description="Mean order value of HOUSEHOLD customers",
         cause="HOUSEHOLD customers order at another value",
         secondary=["segment share is stable"], dims=["category"], review=False,
         tag=dict(type="segment_watch", category="HOUSEHOLD")),
    dict(case_id="INC-004", kpi_name="refund_rate", start="1998-03-02", end="1998-05-17",
         description="Share of returned orders among AUTOMOBILE customers",
         cause="AUTOMOBILE orders come back more often",
         secondary=["no other segment moves"], dims=["category"], review=True,
         tag=dict(type="segment_watch", category="AUTOMOBILE")),
    dict(case_id="INC-005", kpi_name="cancellation_rate", start="1999-08-16", end="1999-10-31",
         description="Share of withdrawn orders, all segments together",
         cause="no single segment stands out",
         secondary=[], dims=["category"], review=True, tag=dict(type="overall_watch")),
    dict(case_id="INC-006", kpi_name="new_customer_ratio", start="2000-03-06", end="2000-05-07",
         description="First orders placed with priority 5-LOW",
         cause="5-LOW orders bring first orders",
         secondary=[], dims=["channel", "customer_type"], review=False,
         tag=dict(type="priority_watch", channel="5-LOW")),
    dict(case_id="INC-007", kpi_name="revenue", start="1995-10-30", end="1995-12-24",
         description="Revenue of the last eight weeks of a year",
         cause="campaign months and BUILDING customers raise revenue",
         secondary=["weekends weigh less"], dims=["campaign", "category"], review=False,
         tag=dict(type="season_watch")),
    dict(case_id="INC-008", kpi_name="order_count", start="2001-05-07", end="2001-05-20",
         description="Two weeks of orders from customers of NATION_12",
         cause="NATION_12 customers order less",
         secondary=["a short window has few orders"], dims=["payment_type"], review=True,
         tag=dict(type="nation_watch", payment_type="NATION_12")),
    dict(case_id="INC-009", kpi_name="conversion_rate", start="1996-08-05", end="1996-09-29",
         description="Order counts of eight weeks against the first half of the year",
         cause="all priorities move together",
         secondary=[], dims=["channel"], review=True, baseline=("1996-01-01", "1996-06-30"),
         tag=dict(type="overall_watch")),
    dict(case_id="INC-010", kpi_name="order_count", start="1996-10-01", end="1996-12-31",
         description="A quarter for which only the first baseline day is given",
         cause="orders per day stay the same",
         secondary=[], dims=["region"], review=False, baseline=("1996-09-15", None),
         tag=dict(type="overall_watch")),
    dict(case_id="INC-011", kpi_name="gmv", start="1997-09-01", end="1997-09-21",
         description="Three weeks against the three weeks after",
         cause="turnover recovers afterwards",
         secondary=[], dims=["channel", "region"], review=False, baseline=("1997-09-29", "1997-10-19"),
         tag=dict(type="overall_watch")),
    dict(case_id="INC-012", kpi_name="revenue", start="2030-01-01", end="2030-01-31",
         description="Days without any order",
         cause="there are no orders",
         secondary=[], dims=["channel"], review=True, tag=dict(type="overall_watch")),
]
