"""gridcast: hourly demand forecasting for many zones as Spark DataFrame operations."""
