WITH month AS (
  SELECT date_format(date, 'yyyy-MM') AS month, region_code,
    CAST(coalesce(sum(CAST(net_sales AS DECIMAL(18, 2))) FILTER (WHERE sales_type = 'PRIMARY'), 0) AS DOUBLE) AS primary_sales,
    CAST(coalesce(sum(CAST(net_sales AS DECIMAL(18, 2))) FILTER (WHERE sales_type = 'SECONDARY'), 0) AS DOUBLE) AS secondary_sales,
    CAST(sum(CAST(net_sales AS DECIMAL(18, 2))) AS DOUBLE) AS total_sales
  FROM mart_commercial_daily GROUP BY ALL)
SELECT *, rint(primary_sales / nullif(total_sales, 0) * 10000) / 10000 AS primary_mix, rint(secondary_sales / nullif(total_sales, 0) * 10000) / 10000 AS secondary_mix
FROM month ORDER BY month, region_code
