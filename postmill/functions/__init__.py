"""Column-level building blocks; everything here returns pyspark Columns."""
