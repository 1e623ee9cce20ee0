"""panelflow: Spark-native analytics on panels of time series, and corpus preparation."""
