"""Borrower-year statements derived from the order tables, so that accounting operators run on data that grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AMOUNT = "decimal(20,4)"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer (k) and order year (y): amounts as DECIMAL(20,4), absent ones null.

    Lineitems are summed by order before they meet the orders, so the large join moves one row an order.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    e = F.col("l_extendedprice").cast(AMOUNT)
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    part = lambda c, x=e: F.sum(F.when(c, x))
    exact = lambda rate: (e * rate.cast("decimal(6,4)")).cast(AMOUNT)
    by_order = read("lineitem").groupBy("l_orderkey").agg(
        F.sum(e).alias("ca"), part(flag == "A").alias("achats"), part((flag == "N") & (status == "O")).alias("clients"),
        part((flag == "A") & (status == "O")).alias("fourn"), F.sum(exact(F.col("l_discount") - F.col("l_tax"))).alias("rn"), F.sum(exact(F.col("l_tax"))).alias("am"),
        part((flag == "R") & (status == "F")).alias("ta"), part((flag == "R") & (status == "O")).alias("tp"),
    )
    total = F.col("o_totalprice")
    own = lambda s, x: F.when(F.col("o_orderstatus") == s, x.cast(AMOUNT))
    orders = read("orders").select(
        "o_orderkey", F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), total.cast(AMOUNT).alias("tb"), own("P", total / 2).alias("df"), own("F", total * F.lit(0.3)).alias("ai")
    )
    sums = [F.sum(c).cast(AMOUNT).alias(c) for c in ("ca", "achats", "clients", "fourn", "rn", "am", "ta", "tp", "tb", "df", "ai")]
    yearly = orders.join(by_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("k", "y").agg(*sums)
    customer = read("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), (F.col("c_acctbal") * 20).cast(AMOUNT).alias("fp"))
    money = lambda x: x.cast(AMOUNT)
    out = yearly.join(customer, "k")
    c: dict[str, Column] = {name: F.col(name) for name in out.columns}
    return out.withColumns({"caf": money(c["rn"] + c["am"]), "tn": money(c["ta"] - c["tp"]), "fdr": money(c["fp"] + c["df"] - c["ai"])})


#: The same in SQL, as a common table expression named st.
ST_SQL = """l AS (SELECT o_custkey k, year(o_orderdate) y, CAST(l_extendedprice AS DECIMAL(20,4)) e, CAST(l_tax AS DECIMAL(6,4)) t,
  CAST(l_discount - l_tax AS DECIMAL(6,4)) d, l_returnflag rf, l_linestatus ls FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT k, y, sum(e) ca, sum(CASE WHEN rf='A' THEN e END) achats, sum(CASE WHEN rf='N' AND ls='O' THEN e END) clients,
  sum(CASE WHEN rf='A' AND ls='O' THEN e END) fourn, sum(CAST(e*d AS DECIMAL(20,4))) rn, sum(CAST(e*t AS DECIMAL(20,4))) am,
  sum(CASE WHEN rf='R' AND ls='F' THEN e END) ta, sum(CASE WHEN rf='R' AND ls='O' THEN e END) tp FROM l GROUP BY k, y),
o AS (SELECT o_custkey k, year(o_orderdate) y, sum(CAST(o_totalprice AS DECIMAL(20,4))) tb,
  sum(CASE WHEN o_orderstatus='P' THEN CAST(o_totalprice/2 AS DECIMAL(20,4)) END) df,
  sum(CASE WHEN o_orderstatus='F' THEN CAST(o_totalprice*0.3::DOUBLE AS DECIMAL(20,4)) END) ai FROM orders GROUP BY 1, 2),
st AS (SELECT o.k, o.y, c_mktsegment seg, ca, achats, clients, fourn, rn, am, rn+am caf, ta, tp, ta-tp tn, tb, df, ai,
  CAST(c_acctbal*20 AS DECIMAL(20,4)) fp, CAST(c_acctbal*20 AS DECIMAL(20,4))+df-ai fdr
  FROM o LEFT JOIN a ON o.k = a.k AND o.y = a.y JOIN customer ON c_custkey = o.k)"""
