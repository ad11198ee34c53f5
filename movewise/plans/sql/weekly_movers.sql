WITH week AS (
  SELECT CAST(trunc(date, 'week') AS DATE) AS week_start, region_code, category, CAST(sum(CAST(net_sales AS DECIMAL(18, 2))) AS DOUBLE) AS net_sales, count(DISTINCT date) AS days_observed
  FROM mart_commercial_daily GROUP BY ALL),
step AS (SELECT *, lag(net_sales) OVER (PARTITION BY region_code, category ORDER BY week_start) AS prior_net_sales FROM week),
move AS (SELECT *, CAST(CAST(net_sales AS DECIMAL(18, 2)) - CAST(prior_net_sales AS DECIMAL(18, 2)) AS DECIMAL(18, 2)) AS moved FROM step WHERE prior_net_sales IS NOT NULL)
SELECT week_start, region_code, category, prior_net_sales, net_sales, CAST(moved AS DOUBLE) AS contribution,
  rint(CAST(moved AS DOUBLE) / nullif(CAST(sum(moved) OVER w AS DOUBLE), 0) * 10000) / 10000 + 0D AS share_of_net_movement,
  rint(CAST(abs(moved) AS DOUBLE) / nullif(CAST(sum(abs(moved)) OVER w AS DOUBLE), 0) * 10000) / 10000 AS share_of_absolute_movement, days_observed
FROM move WINDOW w AS (PARTITION BY week_start)
ORDER BY week_start, contribution, region_code, category
