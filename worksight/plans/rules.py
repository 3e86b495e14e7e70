"""Neutral, threshold-based rules over works and their bills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.tables import table

MONEY = "decimal(18,2)"


def paid_per_work(bills: DataFrame, key: str, amount: str) -> DataFrame:
    return bills.groupBy(key).agg(F.sum(F.col(amount).cast(MONEY)).alias("paid"), F.count("*").alias("n_bills"))


def sig_paid_over_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid more than 125 % of the contract value; above 160 % it needs attention."""
    paid = paid_per_work(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast(MONEY).alias("contract"))
    ratio = F.expr("try_divide(cast(paid as double), cast(contract as double))")
    return (
        paid.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("r", ratio)
        .filter("r > 1.25")
        .select("o_orderkey", F.col("paid").cast("double").alias("paid"), F.col("contract").cast("double").alias("contract"), "n_bills", F.when(F.col("r") > 1.6, "attention").otherwise("notice").alias("severity"))
    )


QUERIES = {"sig_paid_over_contract": sig_paid_over_contract}
ORACLE_SQL = {
    "sig_paid_over_contract": """
SELECT o_orderkey, CAST(paid AS DOUBLE) AS paid, CAST(contract AS DOUBLE) AS contract, n_bills,
  CASE WHEN CAST(paid AS DOUBLE) / CAST(contract AS DOUBLE) > 1.6 THEN 'attention' ELSE 'notice' END AS severity
FROM (SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS paid, COUNT(*) AS n_bills FROM lineitem GROUP BY l_orderkey) b
JOIN (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS contract FROM orders) o ON l_orderkey = o_orderkey
WHERE contract <> 0 AND CAST(paid AS DOUBLE) / CAST(contract AS DOUBLE) > 1.25
""",
}
