"""hourcast: day-ahead forecasting of hourly series as PySpark DataFrame jobs."""
