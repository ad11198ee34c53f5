"""The business model over the driver's TPC-H-like tables, as lazy DataFrames, and the same as DuckDB SQL.

Ids stay numbers here (the model's string ids would only cost time). fact_inventory is synthetic: a
supplier's shipments of a part on a day. Targets are monthly plans: a cell's mean times a bias that
comes from plain arithmetic on the names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import half_even, money_sum
from ..functions.staging import dealt, of_shares, with_totals


#: Bytes of Parquet that a task joins and adds up; below FEW tasks Spark's own choice stands.
PART_BYTES, FEW = 4 << 20, 24
#: Bytes of products' Parquet from which joins by product are dealt as well; fewer are mostly broadcast.
MANY_PRODUCTS = 16 << 20


@dataclass
class Model:
    """Tables of one dataset, read on demand."""

    spark: SparkSession
    folder: str

    @property
    def suffix(self) -> str:
        """Of the names of this dataset's views."""
        return f"_{zlib.crc32(self.folder.encode()):08x}"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def held(self, name: str) -> int:
        """Bytes of a table's files."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def parts(self, name: str) -> int:
        """How many tasks share a table, so that each has about PART_BYTES of its files."""
        return -(-self.held(name) // PART_BYTES)

    def shared(self) -> int:
        """Parts of the lines; 0 leaves few to Spark."""
        return parts if (parts := self.parts("lineitem")) > FEW else 0

    def many_products(self) -> bool:
        """Too many for the driver to hold and send to every task, however few bytes a column of them has in its files."""
        return self.held("part") > MANY_PRODUCTS

    def lines(self, categories: bool = False) -> DataFrame:
        """Every order line with its customer's region; small tables broadcast by their size. A task's share of large ones does not grow with them.

        Categories are joined before the orders are: so lines of an order stay together.
        """
        place = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
        buyer = self.raw("customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows; Spark may take a column of customers for less
        orders = dealt(self.raw("orders").join(buyer, F.col("o_custkey") == F.col("c_custkey")), "o_orderkey", parts := self.shared())
        rows, more = self.raw("lineitem"), []
        if categories:
            skus = self.dim_sku().select("sku_id", "category")
            rows, more = rows.join(skus.hint("merge") if self.many_products() else skus, F.col("l_partkey") == F.col("sku_id")).drop("sku_id"), ["category"]
        units = F.col("l_quantity").cast("long")
        shipped = F.when(F.col("l_linestatus") == "F", units).otherwise(F.lit(0))
        return dealt(rows, "l_orderkey", parts).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("customer_id"),
            F.col("r_name").alias("region_code"), F.col("c_mktsegment").alias("channel"), kam_of("c_custkey").alias("kam_id"), F.col("l_partkey").alias("sku_id"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "PRIMARY").otherwise("SECONDARY").alias("sales_type"),
            units.alias("ordered_units"), shipped.alias("fulfilled_units"), (units - shipped).alias("cancelled_units"), F.col("o_orderstatus").alias("order_status"),
            (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("unit_price"), F.col("l_discount").alias("discount_pct"),
            half_even(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("net_sales"), F.col("l_returnflag").alias("return_flag"), "l_linenumber", *more,
        )

    def invoices(self) -> DataFrame:
        """The lines as a published invoice file would have them: text, with its usual faults, and _row."""
        c = F.col
        place = self.raw("customer").join(self.raw("nation"), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name")
        rows = self.raw("lineitem").join(self.raw("orders"), c("l_orderkey") == c("o_orderkey")).join(place, c("o_custkey") == c("c_custkey")).join(self.raw("part").select("p_partkey", "p_name"), c("l_partkey") == c("p_partkey"))
        line, text = c("l_linenumber"), lambda x: x.cast("string")
        return rows.select(
            F.concat(F.when((c("l_returnflag") == "R") & (line == 1), "c").otherwise(""), text(c("l_orderkey"))).alias("Invoice"),
            F.concat(F.when(c("l_partkey") % 2 == 0, " sku").otherwise("Sku"), text(c("l_partkey") % 40), F.when(c("l_partkey") % 3 == 0, "\t").otherwise("\u00a0")).alias("StockCode"),
            F.when(c("l_partkey") % 7 == 0, F.lit(None)).when(c("l_partkey") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), c("p_name"))).alias("Description"),
            text(F.when(line == 3, -1).otherwise(1) * c("l_quantity").cast("long")).alias("Quantity"),
            F.when(line == 2, F.date_format("o_orderdate", "M/d/yyyy H:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("InvoiceDate"),
            text(F.when(line == 7, 0.0).otherwise(half_even(c("l_extendedprice") / F.nullif(c("l_quantity"), F.lit(0.0)), 2))).alias("Price"),
            F.when(c("o_custkey") % 5 != 0, F.concat(text(c("o_custkey")), F.lit(".0"))).alias("Customer ID"), F.when(c("o_custkey") % 13 != 0, c("n_name")).alias("Country"),
            (c("l_orderkey") * 10 + line).alias("_row"),
        )

    def dim_sku(self) -> DataFrame:
        """Products; many are dealt to as many tasks as lines are, and a join takes the lines to them."""
        skus = self.raw("part").select(
            F.col("p_partkey").alias("sku_id"), F.col("p_name").alias("sku_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("sub_category"),
            F.col("p_size").cast("double").alias("pack_size_kg"), half_even(F.col("p_retailprice") * 0.6, 2).alias("unit_cost"), F.col("p_retailprice").alias("list_price"), F.lit(1).alias("active_flag"),
        )
        parts = self.shared() if self.many_products() else 0
        return of_shares(dealt(skus, "sku_id", parts), parts)

    def dim_customer(self) -> DataFrame:
        place = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.raw("customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.lit("Standard").alias("customer_type"), F.col("c_mktsegment").alias("channel"),
            F.col("r_name").alias("region_code"), F.col("n_name").alias("city"), F.col("r_name").alias("zone"), kam_of("c_custkey").alias("kam_id"),
        )

    def dim_region(self) -> DataFrame:
        return self.raw("region").select(F.col("r_name").alias("region_code"), F.col("r_name").alias("city"), F.col("r_name").alias("zone"))

    def dim_kam(self) -> DataFrame:
        return self.spark.range(4).select(F.concat(F.lit("K"), F.col("id")).alias("kam_id"), F.concat(F.lit("Manager "), F.col("id")).alias("kam_name"))

    def dim_date(self) -> DataFrame:
        return self.raw("orders").select(F.to_date("o_orderdate").alias("date")).distinct().select(
            "date", F.weekofyear("date").alias("week"), F.month("date").alias("month"), F.concat(F.lit("Q"), F.quarter("date")).alias("quarter"), F.year("date").alias("year")
        )

    def fact_orders(self) -> DataFrame:
        return self.lines().select("order_id", "date", "customer_id", "region_code", "channel", "sku_id", "ordered_units", "fulfilled_units", "cancelled_units", "order_status", "sales_type")

    def fact_sales(self) -> DataFrame:
        """Lines with something fulfilled; category and manager are columns of the fact."""
        sold = self.lines(categories=True).where(F.col("fulfilled_units") > 0)
        return sold.select("order_id", "date", "customer_id", "region_code", "channel", "kam_id", "sku_id", "category", "sales_type", F.col("fulfilled_units").alias("units"), "unit_price", "discount_pct", "net_sales")

    def returns(self) -> DataFrame:
        back = self.lines(categories=True).where(F.col("return_flag") == "R")
        return back.select("order_id", "sku_id", "region_code", "category", "customer_id", "date", F.col("ordered_units").alias("returned_units"))

    def fact_inventory(self) -> DataFrame:
        place = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        home = self.raw("supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("region_code"))
        units = F.col("l_quantity").cast("long")
        some = lambda c: F.sum(F.when(c, units).otherwise(F.lit(0)))
        daily = self.raw("lineitem").groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_partkey").alias("sku_id"), "l_suppkey").agg(
            F.sum(units).alias("opening_stock"), some(F.col("l_returnflag") == "N").alias("received_units"), some(F.col("l_linestatus") == "O").alias("available_stock"),
            F.sum(units).alias("ordered_units"), some(F.col("l_linestatus") == "F").alias("fulfilled_units"),
        )
        return daily.join(home, F.col("l_suppkey") == F.col("s_suppkey")).select(
            "date", "sku_id", F.concat(F.lit("W"), F.col("l_suppkey")).alias("warehouse"), "region_code", "opening_stock", "received_units", "available_stock", "ordered_units", "fulfilled_units",
            (F.col("available_stock") <= 2).cast("int").alias("stockout_flag"),
        )

    def _plan(self, sales: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
        months = self.raw("orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("date")).distinct()
        cells = sales.groupBy(*keys).agg(money_sum("net_sales").alias("net"), F.count_distinct("order_id").alias("orders"))
        bias = 0.9 + 0.05 * (sum((F.length(c) for c in names), F.lit(0)) % 5)
        planned = cells.crossJoin(F.broadcast(with_totals(months, months=F.count("*"))))  # a row for each month of a calendar
        return planned.select("date", *keys, half_even(F.col("net") / F.col("months") * bias, 2).alias("sales_target"), F.floor(F.col("orders") / F.col("months")).cast("int").alias("order_target"))

    def plans(self, sales: DataFrame) -> dict[str, DataFrame]:
        """Both tables of plans, from sales."""
        rate = 0.45 + 0.02 * ((F.length("region_code") + F.length("channel")) % 4)
        dims = ["region_code", "category", "channel"]
        return {"fact_targets": self._plan(sales, dims, dims).withColumn("fill_rate_target", rate), "fact_kam_targets": self._plan(sales, ["kam_id"], ["kam_id"])}

    def fact_targets(self) -> DataFrame:
        return self.plans(self.fact_sales())["fact_targets"]

    def fact_kam_targets(self) -> DataFrame:
        return self.plans(self.fact_sales())["fact_kam_targets"]

    def tables(self) -> dict[str, DataFrame]:
        names = ["dim_date", "dim_kam", "dim_region", "dim_sku", "dim_customer", "fact_sales", "fact_orders", "fact_inventory", "fact_targets", "fact_kam_targets"]
        return {n: getattr(self, n)() for n in names}


def kam_of(key: str):
    return F.concat(F.lit("K"), F.col(key) % 4)


#: The model for DuckDB: CTEs with the same names and columns.
MODEL_SQL = """
line AS (
  SELECT l_orderkey AS order_id, CAST(o_orderdate AS DATE) AS date, o_custkey AS customer_id, r_name AS region_code, c_mktsegment AS channel,
    'K' || (c_custkey % 4) AS kam_id, l_partkey AS sku_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'PRIMARY' ELSE 'SECONDARY' END AS sales_type,
    CAST(l_quantity AS BIGINT) AS ordered_units, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS fulfilled_units,
    CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS cancelled_units, o_orderstatus AS order_status,
    l_extendedprice / nullif(l_quantity, 0) AS unit_price, l_discount AS discount_pct, round_even(l_extendedprice * (1 - l_discount), 2) + 0.0 AS net_sales, l_returnflag AS return_flag, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
dim_sku AS (SELECT p_partkey AS sku_id, p_name AS sku_name, p_type AS category, p_brand AS sub_category, CAST(p_size AS DOUBLE) AS pack_size_kg,
    round_even(p_retailprice * CAST(0.6 AS DOUBLE), 2) + 0.0 AS unit_cost, p_retailprice AS list_price FROM part),
dim_customer AS (SELECT c_custkey AS customer_id, c_name AS customer_name, 'Standard' AS customer_type, c_mktsegment AS channel, r_name AS region_code, n_name AS city, r_name AS zone, 'K' || (c_custkey % 4) AS kam_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
dim_region AS (SELECT r_name AS region_code, r_name AS city, r_name AS zone FROM region),
dim_kam AS (SELECT 'K' || i AS kam_id, 'Manager ' || i AS kam_name FROM range(4) t(i)),
dim_date AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
fact_orders AS (SELECT * FROM line),
fact_sales AS (SELECT order_id, date, customer_id, region_code, channel, kam_id, line.sku_id, category, sales_type, fulfilled_units AS units, unit_price, discount_pct, net_sales FROM line JOIN dim_sku USING (sku_id) WHERE fulfilled_units > 0),
stg_orders AS (SELECT o.*, s.sku_name, s.category, s.sub_category, s.pack_size_kg, c.customer_name, c.customer_type, c.city, c.zone FROM line o JOIN dim_sku s USING (sku_id) JOIN dim_customer c ON o.customer_id = c.customer_id),
sold_back AS (SELECT order_id, line.sku_id, region_code, category, customer_id, date, ordered_units AS returned_units FROM line JOIN dim_sku USING (sku_id) WHERE return_flag = 'R'),
fact_inventory AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS sku_id, 'W' || l_suppkey AS warehouse, any_value(r_name) AS region_code,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS opening_stock, CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS received_units,
    CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS available_stock, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ordered_units,
    CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS fulfilled_units,
    CASE WHEN sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) <= 2 THEN 1 ELSE 0 END AS stockout_flag
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
plan_months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders),
fact_targets AS (
  SELECT m.date, region_code, category, channel, round_even(net / (SELECT count(*) FROM plan_months) * (CAST(0.9 AS DOUBLE) + CAST(0.05 AS DOUBLE) * ((length(region_code) + length(category) + length(channel)) % 5)), 2) + 0.0 AS sales_target,
    CAST(floor(orders / (SELECT count(*) FROM plan_months)) AS INTEGER) AS order_target, CAST(0.45 AS DOUBLE) + CAST(0.02 AS DOUBLE) * ((length(region_code) + length(channel)) % 4) AS fill_rate_target
  FROM plan_months m, (SELECT region_code, category, channel, CAST(sum(CAST(net_sales AS DECIMAL(18, 2))) AS DOUBLE) AS net, count(DISTINCT order_id) AS orders FROM fact_sales GROUP BY 1, 2, 3)),
fact_kam_targets AS (
  SELECT m.date, kam_id, round_even(net / (SELECT count(*) FROM plan_months) * (CAST(0.9 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (length(kam_id) % 5)), 2) + 0.0 AS sales_target, CAST(floor(orders / (SELECT count(*) FROM plan_months)) AS INTEGER) AS order_target
  FROM plan_months m, (SELECT kam_id, CAST(sum(CAST(net_sales AS DECIMAL(18, 2))) AS DOUBLE) AS net, count(DISTINCT order_id) AS orders FROM fact_sales GROUP BY 1))
"""

#: The typed lines of Model.invoices(), and those that are sales.
INVOICE_SQL = """
il0 AS (
  SELECT l_orderkey * 10 + l_linenumber AS rn, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'c' ELSE '' END || l_orderkey AS order_id, 'SKU' || (l_partkey % 40) AS sku_id,
    CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN '  ' ELSE ' ' || p_name END AS sku_name, CASE WHEN l_partkey % 7 = 0 OR l_partkey % 11 = 0 THEN 'UNKNOWN' ELSE upper(split_part(p_name, ' ', 1)) END AS category,
    CAST(o_orderdate AS DATE) AS date, CASE WHEN l_linenumber = 3 THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT) AS units, CASE WHEN l_linenumber = 7 THEN CAST(0 AS DOUBLE) ELSE round_even(l_extendedprice / l_quantity, 2) END AS unit_price,
    CASE WHEN o_custkey % 5 = 0 THEN 'UNKNOWN' ELSE CAST(o_custkey AS VARCHAR) END AS customer_id, CASE WHEN o_custkey % 13 <> 0 THEN n_name END AS region_code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
il AS (SELECT *, units < 0 OR order_id LIKE 'c%' AS is_return, round_even(units * unit_price, 2) + 0.0 AS net_sales FROM il0),
isl AS (SELECT * FROM il WHERE NOT is_return)
"""
