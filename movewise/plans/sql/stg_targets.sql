SELECT t.date, t.region_code, t.category, t.channel, t.sales_target, t.order_target, t.fill_rate_target, r.city, r.zone
FROM fact_targets t
JOIN dim_region r ON r.region_code = t.region_code
