"""Question/answer dataset curation on Spark: DataFrames in, DataFrames out."""
