"""Operators of a training-data pipeline, as Spark DataFrame jobs.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only where it can be imported.
"""
