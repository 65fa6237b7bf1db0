"""smoothlake: additive models and their relatives, fitted on Spark DataFrames."""
