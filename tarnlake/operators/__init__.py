"""Statistics, models and data preparation on DataFrames."""
