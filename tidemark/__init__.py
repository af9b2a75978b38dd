"""Market-data analytics on PySpark DataFrames."""
