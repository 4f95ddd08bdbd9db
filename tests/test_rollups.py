"""Line-item roll-up on a tiny frame."""

from kpiscope.operators.rollups import order_rollup


def test_order_rollup_in_cents(spark):
    items = spark.createDataFrame(
        [(1, 10, 3, 19.99), (1, 11, 2, 0.1), (2, 12, 1, 5.55)],
        "order_id long, product_id long, quantity int, unit_price double")
    r = {x["order_id"]: x for x in order_rollup(items).collect()}
    assert r[1]["order_total"] == 60.17 and r[1]["n_items"] == 2
    assert r[2]["order_total"] == 5.55
