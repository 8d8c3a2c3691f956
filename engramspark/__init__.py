"""A property-graph memory engine on PySpark DataFrames."""
