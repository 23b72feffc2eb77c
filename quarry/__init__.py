"""Binary and text content analysis on Spark DataFrames."""
