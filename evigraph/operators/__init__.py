"""Table operations: DataFrames in, lazily planned DataFrames out."""
