"""barlake: strength-sensor analytics on Spark DataFrames."""
