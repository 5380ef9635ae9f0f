"""Context-length analytics for sequence models, as Spark DataFrames."""
