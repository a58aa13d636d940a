"""foliospark: page-document analytics as Spark DataFrames."""
