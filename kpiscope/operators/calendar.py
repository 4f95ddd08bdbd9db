"""Calendar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.functions.dates import seasonal_index
from kpiscope.functions.numeric import round2

def seasonal_adjusted_volume(orders: DataFrame) -> DataFrame:
    """Daily order count divided by the seasonal index of the day."""
    d = orders.groupBy("order_date").agg(F.count(F.lit(1)).alias("n_orders"))
    idx = seasonal_index("order_date")
    return d.select("order_date", "n_orders", idx.alias("seasonal_index"),
                    round2(F.col("n_orders").cast("double") / idx).alias("adjusted_orders"))
