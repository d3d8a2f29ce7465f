"""Section morphometry on Spark: traced outlines in, measured sections out."""
