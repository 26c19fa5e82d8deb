"""Reading and writing review data."""
