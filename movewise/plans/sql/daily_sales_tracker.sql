WITH day AS (
  SELECT date, CAST(sum(CAST(net_sales AS DECIMAL(18, 2))) AS DOUBLE) AS net_sales, sum(sales_units) AS units, sum(ordered_units) AS ordered, sum(fulfilled_units) AS fulfilled
  FROM mart_commercial_daily GROUP BY date),
placed AS (SELECT date, count(DISTINCT order_id) AS orders FROM fact_orders GROUP BY date),
plan AS (SELECT date, CAST(sum(CAST(sales_target AS DECIMAL(18, 2))) AS DOUBLE) AS sales_target FROM fact_targets GROUP BY date)
SELECT date, net_sales, units, orders, rint(fulfilled / nullif(CAST(ordered AS DOUBLE), 0) * 10000) / 10000 AS fill_rate, sales_target,
  rint((net_sales - sales_target) * 100) / 100 + 0D AS target_variance, rint((net_sales - sales_target) / nullif(sales_target, 0) * 10000) / 10000 + 0D AS target_variance_pct,
  lag(net_sales) OVER (ORDER BY date) AS prior_day_net_sales, rint((net_sales - lag(net_sales) OVER (ORDER BY date)) * 100) / 100 + 0D AS day_over_day_change
FROM day JOIN placed USING (date) LEFT JOIN plan USING (date)
ORDER BY date
