"""Panel forecasting analytics and corpus preparation on Spark."""
