"""Paideia: adaptive-learning analytics on Spark, with operators for training-data pipelines."""
