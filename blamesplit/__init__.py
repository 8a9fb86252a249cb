"""Blame attribution for data pipelines, written as Spark DataFrame plans."""
