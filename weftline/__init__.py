"""Workflow-state analytics and training-data operators on Spark DataFrames."""
