"""Reading and writing: JSON, CSV, text and Parquet."""
