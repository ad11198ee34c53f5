WITH sold AS (SELECT kam_id, CAST(sum(CAST(net_sales AS DECIMAL(18, 2))) AS DOUBLE) AS net_sales FROM stg_sales GROUP BY kam_id),
placed AS (SELECT kam_id, count(DISTINCT order_id) AS orders, sum(ordered_units) AS ordered, sum(fulfilled_units) AS fulfilled FROM stg_orders GROUP BY kam_id),
quota AS (SELECT kam_id, CAST(sum(CAST(sales_target AS DECIMAL(18, 2))) AS DOUBLE) AS sales_target, sum(order_target) AS order_target FROM fact_kam_targets GROUP BY kam_id)
SELECT k.kam_id, k.kam_name, net_sales, sales_target, rint((net_sales - sales_target) * 100) / 100 + 0D AS sales_variance, rint(net_sales / nullif(sales_target, 0) * 10000) / 10000 AS sales_attainment,
  orders, order_target, rint(fulfilled / nullif(CAST(ordered AS DOUBLE), 0) * 10000) / 10000 AS fill_rate
FROM dim_kam k LEFT JOIN sold USING (kam_id) LEFT JOIN placed USING (kam_id) LEFT JOIN quota USING (kam_id)
ORDER BY sales_attainment NULLS FIRST, kam_id
