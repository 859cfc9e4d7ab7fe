"""tracklake: detection, tracking and annotation analytics as Spark DataFrames."""
