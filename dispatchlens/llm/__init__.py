"""Operators for preparing language-model training text, on Spark.

Nothing else in the library imports this package; ``registry`` lists its queries.
"""
