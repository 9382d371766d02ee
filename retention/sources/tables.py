"""Scans of the driver tables and the customer fixture view.

The driver tables carry no telecom customer table, so the raw 21-column customer
table is derived from ``customer``, ``orders`` and ``lineitem`` (FIXTURES.md F2).
The derivation is written for scale:

* lineitem is reduced to one row per order *before* it meets orders (partial
  aggregation map-side; the join then sees one row per key on both sides, so a hot
  customer cannot skew it);
* all per-customer measures come out of ONE aggregation keyed by ``o_custkey``
  (the "latest order" is ``max(struct(date, key, ...))`` instead of a
  ``row_number`` window, so there is no per-customer sort and the aggregate is
  partial / map-side combinable even for a customer holding a third of all orders);
* only the needed columns are read (parquet column pruning).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def _yes_no(cond) -> F.Column:
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def customer_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer that has orders: order months, spend, latest order, line flags."""
    li = (read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag", "l_linestatus"])
          .groupBy("l_orderkey")
          .agg(F.sum((F.col("l_returnflag") == "R").cast("int")).alias("r_o"),
               F.sum((F.col("l_returnflag") == "A").cast("int")).alias("a_o"),
               F.sum((F.col("l_returnflag") == "N").cast("int")).alias("n_o"),
               F.sum((F.col("l_linestatus") == "F").cast("int")).alias("f_o"),
               F.count(F.lit(1)).alias("c_o")))
    orders = (read_table(spark, sf_dir, "orders",
                         ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
              .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
                      F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
                      (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month_idx")))
    joined = orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
    return (joined.groupBy("o_custkey")
            .agg(F.size(F.collect_set("month_idx")).alias("am"),
                 F.sum("cents").alias("total"),
                 F.max(F.struct("o_orderdate", "o_orderkey", "cents", "o_orderpriority")).alias("last"),
                 F.sum("r_o").alias("r"), F.sum("a_o").alias("a"), F.sum("n_o").alias("n"),
                 F.sum("f_o").alias("f"), F.sum("c_o").alias("c"))
            .select("o_custkey", "am", "total", "r", "a", "n", "f", "c",
                    F.col("last.cents").alias("last_cents"),
                    F.col("last.o_orderpriority").alias("prio")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw customer table (21 columns of FIXTURES F1) plus ``c_custkey`` and ``u``."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    m = customer_measures(spark, sf_dir)
    b = cust.join(m, cust.c_custkey == m.o_custkey, "left")
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    am = F.coalesce(F.col("am"), F.lit(0))
    no_inet = nk % 3 == 2

    def svc(cnt: str, mod: int):
        return (F.when(no_inet, F.lit("No internet service"))
                .otherwise(_yes_no(F.coalesce(F.col(cnt), F.lit(0)) % mod == 0)))

    prio = F.col("prio")
    contract = (F.when(prio.isin("1-URGENT", "2-HIGH") | prio.isNull(), F.lit("Month-to-month"))
                .when(prio.isin("3-MEDIUM", "4-NOT SPECIFIED"), F.lit("One year"))
                .otherwise(F.lit("Two year")))
    seg = F.col("c_mktsegment")
    payment = (F.when(seg == "AUTOMOBILE", F.lit("Bank transfer (automatic)"))
               .when(seg == "BUILDING", F.lit("Credit card (automatic)"))
               .when(seg == "HOUSEHOLD", F.lit("Mailed check"))
               .otherwise(F.lit("Electronic check")))
    monthly = F.floor(F.coalesce(F.col("last_cents"), F.lit(5000000)) / F.lit(2500.0)) / F.lit(100.0)
    total = F.when(F.col("total").isNull(), F.lit(" ")).otherwise(
        (F.floor(F.col("total") / F.lit(2500.0)) / F.lit(100.0)).cast("string"))
    base = b.select(
        "c_custkey",
        F.concat(F.lit("C"), k.cast("string")).alias("customerID"),
        F.when(k % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.when(F.col("c_acctbal") < 0, F.lit(1)).otherwise(F.lit(0)).alias("SeniorCitizen"),
        _yes_no(k % 3 == 0).alias("Partner"),
        _yes_no(k % 5 == 0).alias("Dependents"),
        F.floor(am * am / F.lit(5.0)).cast("int").alias("tenure"),
        F.when(nk % 7 == 0, F.lit("No")).otherwise(F.lit("Yes")).alias("PhoneService"),
        F.when(nk % 7 == 0, F.lit("No phone service"))
         .otherwise(_yes_no(F.coalesce(F.col("c"), F.lit(0)) % 2 == 0)).alias("MultipleLines"),
        F.when(nk % 3 == 0, F.lit("DSL")).when(nk % 3 == 1, F.lit("Fiber optic"))
         .otherwise(F.lit("No")).alias("InternetService"),
        svc("a", 2).alias("OnlineSecurity"),
        svc("n", 2).alias("OnlineBackup"),
        svc("f", 2).alias("DeviceProtection"),
        svc("r", 2).alias("TechSupport"),
        svc("r", 3).alias("StreamingTV"),
        svc("a", 3).alias("StreamingMovies"),
        contract.alias("Contract"),
        F.when(k % 4 == 0, F.lit("No")).otherwise(F.lit("Yes")).alias("PaperlessBilling"),
        payment.alias("PaymentMethod"),
        monthly.alias("MonthlyCharges"),
        total.alias("TotalCharges"),
        ((k * 7919 + 13) % 1009).alias("u"),
    )
    score = (F.lit(60)
             + 250 * (F.col("Contract") == "Month-to-month").cast("int")
             + 150 * (F.col("InternetService") == "Fiber optic").cast("int")
             + 100 * (F.col("TechSupport") == "No").cast("int")
             + 150 * (F.col("tenure") <= 6).cast("int"))
    return base.withColumn("Churn", F.when(F.col("u") < score, F.lit("Yes")).otherwise(F.lit("No")))
