"""A sequence-lake analytics engine on PySpark DataFrames."""
