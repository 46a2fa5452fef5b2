"""gradelens: student-performance analytics on Spark DataFrames and Spark ML."""
__version__ = "0.1.0"
