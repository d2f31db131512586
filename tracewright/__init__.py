"""Event-log detection and analytics on Spark DataFrames."""
