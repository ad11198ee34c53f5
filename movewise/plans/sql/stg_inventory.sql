SELECT i.*, p.sku_name, p.category, p.sub_category, r.city, r.zone
FROM fact_inventory i
JOIN dim_sku p ON p.sku_id = i.sku_id
JOIN dim_region r ON r.region_code = i.region_code
