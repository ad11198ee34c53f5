SELECT t.date, t.kam_id, k.kam_name, t.sales_target, t.order_target
FROM fact_kam_targets t
JOIN dim_kam k ON k.kam_id = t.kam_id
