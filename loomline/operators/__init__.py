"""Plans to DataFrames, and statements that change tables."""
