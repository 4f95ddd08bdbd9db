"""Data-quality rules as aggregate jobs (DQ1-DQ3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KeySource = tuple[DataFrame, Column, dict[str, Column]]


def key_integrity(key_column: str, sources: list[KeySource], parent: str | None = None) -> DataFrame:
    """Duplicates, nulls and orphans of every table that carries one key, from one aggregate by that key.

    A source is a frame, its key, and the tables whose rows it holds, each with a condition for the
    rows that belong to it. All sources are stacked with a count column for each table and summed by key,
    so a raw table is scanned once and there is one exchange, after partial sums. ``parent`` names the table
    that must hold the keys of the others; without one nothing is an orphan.

    One row for each table: n_rows, n_keys (a null key is one), n_duplicate_keys, n_null_keys (0 or 1),
    n_orphans (rows whose key is not null and not in the parent).
    """
    names = [n for _, _, tables in sources for n in tables]
    stacked = reduce(DataFrame.unionByName, [
        df.select(key.alias("k"), *[(tables[n].cast("int") if n in tables else F.lit(0)).cast("bigint").alias(n) for n in names])
        for df, key, tables in sources])
    per_key = stacked.groupBy("k").agg(*[F.sum(n).alias(n) for n in names])
    held, null_key = (lambda n: F.col(n) > 0), F.col("k").isNull()

    def facts(n: str) -> list[Column]:
        missing = ~null_key & (F.col(parent) == 0) if parent and n != parent else F.lit(False)
        return [F.coalesce(F.sum(n), F.lit(0)).alias(f"{n}_rows"), F.count_if(held(n)).alias(f"{n}_keys"),
                F.count_if(F.col(n) > 1).alias(f"{n}_duplicates"), F.count_if(null_key & held(n)).alias(f"{n}_nulls"),
                F.coalesce(F.sum(F.when(missing, F.col(n))), F.lit(0)).alias(f"{n}_orphans")]

    one = per_key.agg(*[c for n in names for c in facts(n)])
    rows = [F.struct(F.lit(n).alias("table_name"), F.lit(key_column).alias("key_column"), F.col(f"{n}_rows").alias("n_rows"),
                     F.col(f"{n}_keys").alias("n_keys"), F.col(f"{n}_duplicates").alias("n_duplicate_keys"),
                     F.col(f"{n}_nulls").alias("n_null_keys"), F.col(f"{n}_orphans").alias("n_orphans")) for n in names]
    return one.select(F.inline(F.array(*rows)))


def name_integrity(values: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """DQ1 for dimensions that are only spelled out in a fact: a name is a key, its spellings (but for
    case and outer blanks) are its rows, so two spellings of one name are a duplicate."""
    spelled = values.unpivot([], columns, "column", "raw").groupBy("column", "raw").agg(F.lit(1).alias("one"))
    keyed = spelled.select("column", F.lower(F.trim("raw")).alias("k"))
    per_key = keyed.groupBy("column", "k").agg(F.count(F.lit(1)).alias("c"))
    one = per_key.groupBy("column").agg(
        F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("c") > 1).alias("n_duplicate_keys"),
        F.count_if(F.col("k").isNull()).alias("n_null_keys"))
    table = F.element_at(F.create_map(*[F.lit(x) for pair in zip(columns, names) for x in pair]), F.col("column"))
    return one.select(table.alias("table_name"), F.col("column").alias("key_column"), "n_rows", "n_keys", "n_duplicate_keys",
                      "n_null_keys")


RULES = ["refund_exceeds_order_total", "refund_outside_1_14_days", "refund_reason_out_of_domain",
         "order_status_out_of_domain", "orders_with_multiple_payments", "payment_status_out_of_domain"]


def rule_violations(enriched: DataFrame, reasons: list[str], statuses: list[str]) -> DataFrame:
    """DQ2 over the enriched orders, one row per order with its refund and its payment: refund <= order
    total; refund 1-14 days after the order; refund reason, order status and payment status in their
    domains; one payment per order. The count of payments by order is on the key that the enriched
    orders are joined by, so it needs no exchange of its own."""
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    refunded, paid = F.col("refund_reason").isNotNull(), F.col("payment_status").isNotNull()
    lag = F.datediff("refund_date", "order_date")
    per_order = enriched.groupBy("order_id").agg(
        flag(refunded & (F.col("refund_amount") > F.col("order_total"))).alias(RULES[0]),
        flag(refunded & ~lag.between(1, 14)).alias(RULES[1]),
        flag(refunded & ~F.col("refund_reason").isin(*reasons)).alias(RULES[2]),
        flag(~F.col("order_status").isin(*statuses)).alias(RULES[3]),
        (flag(paid) > 1).cast("int").alias(RULES[4]),
        flag(paid & ~F.col("payment_status").isin("completed", "failed", "pending")).alias(RULES[5]))
    one = per_order.agg(*[F.coalesce(F.sum(r), F.lit(0)).cast("bigint").alias(r) for r in RULES])
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_violations")) for r in RULES])))
