SELECT s.order_id, s.date, s.customer_id, s.region_code, s.channel, s.kam_id, s.sku_id, s.category, s.sales_type, s.units, s.unit_price, s.discount_pct, s.net_sales,
  s.units * s.unit_price AS gross_sales, s.units * s.unit_price - s.net_sales AS discount_value,
  p.sku_name, p.sub_category, p.pack_size_kg, p.unit_cost, p.list_price, c.customer_name, c.customer_type, k.kam_name, r.city, r.zone
FROM fact_sales s
JOIN dim_sku p USING (sku_id)
JOIN dim_customer c ON c.customer_id = s.customer_id
JOIN dim_kam k ON k.kam_id = s.kam_id
JOIN dim_region r ON r.region_code = s.region_code
