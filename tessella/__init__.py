"""Text-corpus similarity and pattern analytics, expressed with Spark DataFrames."""
