"""Point-in-time data, features, forecasts and evidence as plain PySpark DataFrame operators."""
