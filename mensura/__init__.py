"""Units of measure for source code and tables, and data-preparation operators, on Spark DataFrames."""
