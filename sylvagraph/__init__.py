"""Code-property-graph analytics on PySpark DataFrames."""
