WITH week AS (
  SELECT CAST(trunc(date, 'week') AS DATE) AS week_start, region_code, category, count(DISTINCT date) AS days_observed, sum(ordered_units) AS ordered_units, sum(fulfilled_units) AS fulfilled_units
  FROM mart_commercial_daily GROUP BY ALL),
plan AS (
  SELECT CAST(trunc(date, 'week') AS DATE) AS week_start, region_code, category, rint(avg(fill_rate_target) * 10000) / 10000 AS fill_rate_target
  FROM fact_targets GROUP BY ALL)
SELECT week_start, region_code, category, days_observed, ordered_units, fulfilled_units, rint(fulfilled_units / nullif(CAST(ordered_units AS DOUBLE), 0) * 10000) / 10000 AS fill_rate, fill_rate_target,
  rint((fulfilled_units / nullif(CAST(ordered_units AS DOUBLE), 0) - fill_rate_target) * 10000) / 10000 + 0D AS fill_rate_variance, ordered_units - fulfilled_units AS unfulfilled_units
FROM week LEFT JOIN plan USING (week_start, region_code, category)
ORDER BY week_start, region_code, category
