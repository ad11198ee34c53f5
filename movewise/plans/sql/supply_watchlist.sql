WITH week AS (
  SELECT CAST(trunc(date, 'week') AS DATE) AS week_start, region_code, category, sum(ordered_units) AS ordered_units, sum(fulfilled_units) AS fulfilled_units, count(DISTINCT date) AS days_observed
  FROM mart_commercial_daily GROUP BY ALL),
stock AS (
  SELECT CAST(trunc(date, 'week') AS DATE) AS week_start, region_code, category, rint(avg(available_stock) * 100) / 100 AS available_stock, rint(avg(stockout_flag) * 10000) / 10000 AS stockout_rate
  FROM stg_inventory GROUP BY ALL),
both AS (
  SELECT *, fulfilled_units / nullif(CAST(ordered_units AS DOUBLE), 0) AS rate
  FROM week LEFT JOIN stock USING (week_start, region_code, category)),
step AS (
  SELECT *, lag(rate) OVER w AS prior_rate, lag(ordered_units) OVER w AS prior_ordered_units, lag(available_stock) OVER w AS prior_stock
  FROM both WINDOW w AS (PARTITION BY region_code, category ORDER BY week_start))
SELECT week_start, region_code, category, rint(rate * 10000) / 10000 AS fill_rate, rint(prior_rate * 10000) / 10000 AS prior_fill_rate, rint((rate - prior_rate) * 10000) / 10000 + 0D AS fill_rate_change,
  ordered_units, prior_ordered_units, rint((ordered_units / nullif(CAST(prior_ordered_units AS DOUBLE), 0) - 1) * 10000) / 10000 + 0D AS demand_change_pct, available_stock,
  rint((available_stock / nullif(prior_stock, 0) - 1) * 10000) / 10000 + 0D AS stock_change_pct, stockout_rate, ordered_units - fulfilled_units AS unfulfilled_units, days_observed
FROM step
WHERE rate - prior_rate <= -0.05D AND ordered_units / nullif(CAST(prior_ordered_units AS DOUBLE), 0) >= 0.95D
ORDER BY fill_rate_change, week_start, region_code, category
