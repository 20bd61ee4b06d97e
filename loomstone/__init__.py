"""Spark-native analytics for durable, verifiable knowledge records.

Every public operator takes DataFrames and returns DataFrames.  The subpackage
``llm`` (training-data operators) is optional: nothing else imports it.
"""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
