"""parcelgraph: property-graph analytics and rule evaluation on PySpark DataFrames."""
