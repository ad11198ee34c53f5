SELECT o.order_id, o.date, o.customer_id, o.region_code, o.channel, o.sku_id, o.ordered_units, o.fulfilled_units, o.cancelled_units, o.order_status, o.sales_type,
  p.sku_name, p.category, p.sub_category, p.pack_size_kg, c.customer_name, c.customer_type, c.kam_id, k.kam_name, r.city, r.zone
FROM fact_orders o
JOIN dim_sku p ON p.sku_id = o.sku_id
JOIN dim_customer c ON c.customer_id = o.customer_id
JOIN dim_kam k ON k.kam_id = c.kam_id
JOIN dim_region r ON r.region_code = o.region_code
