"""Unsupervised anomaly analytics over event logs, as Spark jobs."""
