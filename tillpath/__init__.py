"""Web-shop funnel and marketing analytics on PySpark DataFrames."""
