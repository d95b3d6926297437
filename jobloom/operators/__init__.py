"""Jobs on tables: DataFrames in, DataFrames out."""
