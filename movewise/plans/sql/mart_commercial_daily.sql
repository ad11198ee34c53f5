-- Both facts become rows of one shape, so one more aggregation joins them without a join.
WITH parts AS (
  SELECT date, region_code, category, channel, sales_type,
    CAST(sum(CAST(rint(units * unit_price * 100) / 100 AS DECIMAL(18, 2))) AS DOUBLE) AS gross_sales, CAST(sum(CAST(net_sales AS DECIMAL(18, 2))) AS DOUBLE) AS net_sales, sum(units) AS sales_units, count(DISTINCT order_id) AS sales_order_count,
    0L AS order_count, 0L AS ordered_units, 0L AS fulfilled_units, 0L AS cancelled_units
  FROM fact_sales GROUP BY ALL
  UNION ALL
  SELECT date, region_code, category, channel, sales_type, 0D, 0D, 0L, 0L, count(DISTINCT order_id), sum(ordered_units), sum(fulfilled_units), sum(cancelled_units)
  FROM stg_orders GROUP BY date, region_code, category, channel, sales_type),
cells AS (
  SELECT date, region_code, category, channel, sales_type, sum(gross_sales) AS gross_sales, sum(net_sales) AS net_sales, sum(sales_units) AS sales_units, sum(sales_order_count) AS sales_order_count,
    sum(order_count) AS order_count, sum(ordered_units) AS ordered_units, sum(fulfilled_units) AS fulfilled_units, sum(cancelled_units) AS cancelled_units
  FROM parts GROUP BY ALL)
SELECT date, region_code, category, channel, sales_type, gross_sales, net_sales, sales_units, sales_order_count, order_count, ordered_units, fulfilled_units, cancelled_units,
  rint(fulfilled_units / nullif(CAST(ordered_units AS DOUBLE), 0) * 10000) / 10000 AS fill_rate,
  rint(cancelled_units / nullif(CAST(ordered_units AS DOUBLE), 0) * 10000) / 10000 AS cancellation_rate,
  rint(net_sales / nullif(CAST(sales_order_count AS DOUBLE), 0) * 100) / 100 AS aov,
  rint((gross_sales - net_sales) * 100) / 100 + 0D AS discount_value
FROM cells
