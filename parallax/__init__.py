"""parallax: parallel-corpus preparation, selection and evaluation on Spark.

Every public operator takes and returns DataFrames (or Columns for the scalar
text functions).  Nothing here creates a SparkSession except `session.get_spark`,
which is meant for tests, benchmarks and scripts.
"""
__version__ = "0.1.0"
