WITH actual AS (SELECT region_code, category, channel, CAST(sum(CAST(net_sales AS DECIMAL(18, 2))) AS DOUBLE) AS net_sales FROM mart_commercial_daily GROUP BY ALL),
plan AS (SELECT region_code, category, channel, CAST(sum(CAST(sales_target AS DECIMAL(18, 2))) AS DOUBLE) AS sales_target FROM fact_targets GROUP BY ALL)
SELECT region_code, category, channel, coalesce(net_sales, 0D) AS net_sales, sales_target, rint((coalesce(net_sales, 0D) - sales_target) * 100) / 100 + 0D AS variance,
  rint((coalesce(net_sales, 0D) - sales_target) / nullif(sales_target, 0) * 10000) / 10000 + 0D AS variance_pct, rint(coalesce(net_sales, 0D) / nullif(sales_target, 0) * 10000) / 10000 AS attainment
FROM plan LEFT JOIN actual USING (region_code, category, channel)
ORDER BY variance_pct NULLS FIRST, region_code, category, channel
