"""Point-in-time entity-period panels as Spark DataFrames."""
