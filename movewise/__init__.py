"""movewise: a PySpark-native engine for explaining why a business metric moved."""
