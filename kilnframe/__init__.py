"""Spark-first profiling, preparation, forecasting and classification over DataFrames."""
